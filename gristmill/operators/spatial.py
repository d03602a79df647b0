"""Range joins of boxes by a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import geometry as G

#: Width of a cell in distances: a box is dealt into few cells, and meets boxes of few more than it must.
WIDE = 4


def _cells(low: Column, high: Column, cell: Column) -> tuple[Column, Column]:
    return F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long")


def _dealt(rows: DataFrame, box: Column, side: str) -> DataFrame:
    """A row for each cell that a box touches, and whether that is in the box's first column and row."""
    x, y = _cells(box[0], box[2], F.col("_cell")), _cells(box[1], box[3], F.col("_cell"))
    first = rows.withColumns({"_x1": x[0], "_y1": y[0], "_x2": x[1], "_y2": y[1]})
    wide = first.withColumn("_cx", F.explode(F.sequence("_x1", "_x2"))).withColumn("_cy", F.explode(F.sequence("_y1", "_y2")))
    wide = wide.withColumns({f"_{side}x": F.col("_cx") == F.col("_x1"), f"_{side}y": F.col("_cy") == F.col("_y1")})
    return wide.drop("_x1", "_y1", "_x2", "_y2", "_cell")


def near_pairs(left: DataFrame, right: DataFrame, key: str, most: float, left_box: str = "box", right_box: str = "other_box") -> DataFrame:
    """Pairs of a key whose boxes are at most ``most`` of the left row's diagonal apart; adds ``distance``.

    left: key, a box, width, height; right: key, a box; other names must differ. Both sides are dealt into the cells of a grid, the
    left boxes grown by the distance, and meet by key and cell, so a crowded key is many tasks' work. A key's cells are ``WIDE`` times as
    wide as its greatest distance, at least as its mean box. A pair that shares several cells is made in the first of them alone: the
    only one that is in the first column of one of both boxes, and in the first row of one. Boxes that are null or not in order of their ends, and rows
    without a key, meet nothing.
    """
    good = lambda c: G.valid_box(F.transform(c, lambda v: v.cast("double"))) | (F.size(c) == 4) & (c[2] >= c[0]) & (c[3] >= c[1])
    lb, rb, reach = F.col(left_box), F.col(right_box), F.lit(most) * F.hypot(F.col("width").cast("double"), F.col("height").cast("double"))
    left, right = left.filter(good(lb)), right.filter(good(rb))
    side = F.avg(F.greatest(lb[2] - lb[0], lb[3] - lb[1]).cast("double"))
    cells = left.groupBy(key).agg(F.greatest(WIDE * F.max(reach), side, F.lit(1.0)).alias("_cell"))
    grown = F.array(lb[0] - reach, lb[1] - reach, lb[2] + reach, lb[3] + reach)
    a = _dealt(left.join(cells, key), grown, "a")
    b = _dealt(right.join(cells, key), rb, "b")
    meet = a.join(b, [key, "_cx", "_cy"]).filter((F.col("_ax") | F.col("_bx")) & (F.col("_ay") | F.col("_by")))
    near = meet.withColumn("distance", G.edge_distance(lb, rb, F.col("width"), F.col("height"))).filter(F.col("distance") <= most)
    return near.drop("_cx", "_cy", "_ax", "_ay", "_bx", "_by")
