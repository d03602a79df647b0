"""Conversations to elements, plans and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gristmill.functions.arrays import running

TAG = "<image>"


def turns(conversation: Column, fields: list[str]) -> Column:
    """array<struct<role,text>> of turns in one of three shapes, by the fields that there are.

    {user, assistant} gives two turns each; {from, value} and {role, content} one. Other roles have no turn.
    """
    has = set(fields)
    get = lambda t, f: t[f] if f in has else F.lit(None).cast("string")

    def one(role: str, text: Column) -> Column:
        return F.when(F.coalesce(text, F.lit("")) != "", F.struct(F.lit(role).alias("role"), text.alias("text")))

    def split(t):
        who = F.coalesce(get(t, "from"), get(t, "role"))
        text = F.when(get(t, "from").isNotNull(), get(t, "value")).otherwise(get(t, "content"))
        user = F.when(get(t, "user").isNotNull(), get(t, "user")).when(who.isin("human", "user"), text)
        assistant = F.when(get(t, "user").isNotNull(), get(t, "assistant")).when(who.isin("gpt", "assistant"), text)
        bare = F.trim(F.replace(user, F.lit(TAG), F.lit("")))
        return F.array_compact(F.array(one("user", bare), one("assistant", assistant)))

    return F.flatten(F.transform(conversation, split))


def rounds(conversation: Column, fields: list[str]) -> Column:
    """Turns of the pair shape, else half the turns, unknown roles included."""
    paired = (F.size(conversation) > 0) & conversation[0]["user"].isNotNull() if "user" in fields else F.lit(False)
    return F.when(paired, F.size(conversation)).otherwise(F.floor(F.size(conversation) / 2)).cast("int")


def element_fields(schema: StructType, column: str) -> list[str]:
    return schema[column].dataType.elementType.fieldNames()


def elements(turn_list: Column, images: Column, round_count: Column) -> Column:
    """Images first, then texts; answers carry loss."""
    image = F.struct(F.lit("image").alias("type"), F.lit(0).alias("loss"), F.lit(None).cast("string").alias("text"), round_count.alias("round"))
    text = lambda t: F.struct(F.lit("text").alias("type"), (t["role"] == "assistant").cast("int").alias("loss"), t["text"].alias("text"), round_count.alias("round"))
    return F.concat(F.array_repeat(image, images), F.transform(turn_list, text))


def has_loss(element_list: Column) -> Column:
    return F.exists(element_list, lambda e: e["loss"] == 1)


def interleaved(text: Column, images: Column) -> Column:
    """Text split at image tags: pieces and, between them, as many images as there are."""
    pieces = F.split(text, TAG, -1)

    def one(p, i):
        own = F.when(F.trim(p) != "", F.struct(F.lit("text").alias("type"), F.trim(p).alias("text")))
        image = F.when((i > 0) & (i <= images), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))
        return F.array_compact(F.array(image, own))

    return F.flatten(F.transform(pieces, one))


def running_offsets(lengths: Column) -> Column:
    """Where each of the lengths begins."""
    return running(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def image_plan(need_loss: Column, need_vae: Column, need_vit: Column) -> Column:
    """Up to three plan rows of one image, in a fixed order."""
    row = lambda kind, loss: F.struct(F.lit(kind).alias("type"), F.lit(loss).alias("loss"))
    return F.array_compact(F.array(F.when(need_loss, row("vae_image", 1)), F.when(need_vae, row("vae_image", 0)), F.when(need_vit, row("vit_image", 0))))


def attention(split_lens: Column, modes: Column) -> Column:
    """array of rows of booleans: whether a position sees another.

    Causal and full segments see all before them, full and noise ones themselves as a whole, causal ones up to the
    position; positions of a noise segment are seen by that segment only.
    """
    seg = F.flatten(F.transform(split_lens, lambda n, i: F.array_repeat(i, n)))

    def row(q, qi):
        def cell(k, ki):
            own = q == k
            mode = F.get(modes, q)
            inside = own & ((mode != "causal") | (ki <= qi))
            return inside | ((k < q) & (F.get(modes, k) != "noise"))

        return F.transform(seg, cell)

    return F.transform(seg, row)


def normalized(rows: DataFrame, column: str) -> DataFrame:
    """Adds turns and rounds; the shape is settled on the schema."""
    fields = element_fields(rows.schema, column)
    return rows.withColumns({"turns": turns(F.col(column), fields), "rounds": rounds(F.col(column), fields)})
