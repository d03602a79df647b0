"""Known answers of the operators on records, and queries without SQL against plain Python."""

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import packing
from gristmill.operators import records as R

SF = "/root/testdata/sf0.001"


def one(spark, **columns):
    return next(iter(spark.range(1).select(*(c.alias(n) for n, c in columns.items())).collect()))


def test_options():
    assert R.whole_steps(" 1, ,20") == (1, 20) and R.whole_steps(None) == ()
    for bad in ("-1", "1,1"):
        with pytest.raises(ValueError):
            R.whole_steps(bad)
    assert R.fraction_or_none("OFF") is None and R.fraction_or_none("0.5") == 0.5
    with pytest.raises(ValueError):
        R.fraction_or_none("1.5")
    assert R.chosen("a, x", ["a", "b"]) == (["a"], ["x"]) and R.chosen(None, ["a", "b"]) == (["a", "b"], [])
    with pytest.raises(ValueError):
        R.chosen("x", ["a"])
    assert R.expected_counts({"sources": {"a": {"rows": 3}, "b": 1}}, ["c"], 9) == {"a": 3}
    assert R.expected_counts(None, ["c", "b"], 9) == {"b": 9, "c": 9}


def test_errors_are_raised(spark):
    df = spark.createDataFrame([(1, 5), (2, 5)], "line int, id int")
    with pytest.raises(Exception, match="duplicate id: 5"):
        R.ordered_prefix(df, "line", "id").collect()
    assert R.ordered_prefix(df, "line", "id", 1).count() == 1
    with pytest.raises(Exception, match="unknown protocol"):
        one(spark, p=R.prompt_by(F.lit("x"), *[F.lit("a")] * 4, F.array(F.lit("a")), F.lit("0")))
    with pytest.raises(Exception, match="names no video"):
        one(spark, p=T.with_frames(F.array(F.lit("hello")), F.lit(2)))
    with pytest.raises(KeyError):
        R.lookup(df, "line", 7)
    with pytest.raises(Exception, match="no answer"):
        talk = F.array(F.struct(F.lit("human").alias("from"), F.lit("x").alias("value")))
        one(spark, c=R.with_last_answer(talk, F.array(F.lit(1))))


def test_names_and_cursors(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert R.same_names(names("a", "b"), names("b", "a")) and not R.same_names(names("a"), names("a", "b"))
    saved = spark.createDataFrame([(0, 5), (1, 9)], "rank int, position long")
    assert R.cursor_of(saved, "rank", 1) == 9 and R.cursor_of(saved, "rank", 2) is None


def packed(rows, mandatory=False, expected=4000, most=6000, most_per_sample=5000, buffer_size=5, prefer=2000, drop=True):
    """Sequences of (key, tokens) by the rules as they are told, one sample at a time."""
    groups = {}
    for key, n, kind in rows:
        if mandatory and kind:
            groups.setdefault(kind, []).append((key, n))
    turns, stream = dict.fromkeys(sorted(groups), 0), [(k, n) for k, n, kind in rows if not (mandatory and kind)]
    out, curr, waiting, i, size = [], [], [], 0, buffer_size
    total = lambda: sum(n for _, n in curr)
    while i < len(stream) or waiting:
        late = i >= len(stream)
        size = 0 if late else size
        if waiting and (late or total() < prefer):
            (key, n), waited = waiting.pop(0), True
        else:
            (key, n), waited = stream[i], False
            i += 1
        if not curr:
            for g in turns:
                for _ in groups[g]:
                    k, m = groups[g][turns[g] % len(groups[g])]
                    turns[g] += 1
                    if m < most_per_sample:
                        curr.append((k, m))
                        break
        if n > most_per_sample:
            continue
        if total() + n > most:
            if len(waiting) < size and not waited:
                waiting.append((key, n))
                continue
            out.append(curr)
            curr = []
            if drop or n > most:
                continue
        curr.append((key, n))
        if total() >= expected:
            out.append(curr)
            curr = []
    return out + ([curr] if curr else [])


@pytest.mark.parametrize("name", ["pack_sequences", "pack_sequences_keep", "pack_mandatory"])
def test_packing_queries_equal_the_rules(spark, name):
    from gristmill.plans import catalogue

    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        kind = "toxic" if r["toxic"] == 1 else "good" if r["quality"] == 1 else None
        labels[r["doc_id"]] = min(filter(None, (labels.get(r["doc_id"]), kind)), default=None)
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("source", "doc_id", "n_chars").collect(), key=lambda r: r["doc_id"])
    want = []
    for source in sorted({r["source"] for r in docs}):
        rows = [(r["doc_id"], r["n_chars"], labels.get(r["doc_id"])) for r in docs if r["source"] == source]
        found = packed(rows, name == "pack_mandatory", drop=name != "pack_sequences_keep")
        want += [(source, i, j, k, n) for i, members in enumerate(found) for j, (k, n) in enumerate(members)]
    assert sorted(map(tuple, catalogue.queries()[name](spark, SF).collect())) == want


def test_mandatory_samples_come_round():
    p = packing.Packer(expected=10, most=12, most_per_sample=12, mandatory=[[("m", 12), ("n", 3)], [("o", 2)]])
    found = [[k for k, _ in s] for s in packing.pack_stream([(i, 5) for i in range(5)], p)]
    assert found == [["n", "o", 0], ["n", "o", 1], ["n", "o", 2], ["n", "o", 3], ["n", "o", 4]]
