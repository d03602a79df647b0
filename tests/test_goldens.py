"""Known answers for single operators."""

import pytest
from pyspark.sql import functions as F

from gristmill.functions import actions as A
from gristmill.functions import geometry as G
from gristmill.functions import hashing as H
from gristmill.functions import text as T
from gristmill.operators import genbench as B
from gristmill.operators import linking as L
from gristmill.operators import sampling as P
from gristmill.operators import scoring as S
from gristmill.operators.packing import Packer, pack_stream


def one(spark, **columns):
    r = spark.range(1).select(*((c if not isinstance(c, (str, int, float)) else F.lit(c)).alias(n) for n, c in columns.items())).first()
    return r[0] if len(columns) == 1 else r


def box(*v):
    return F.array(*(F.lit(float(x)) for x in v))


@pytest.mark.parametrize(
    "text,action,value,error",
    [
        ("<|startoftext|>type_in [10, 20, 110, 220] hello world</s>", "type_in", "hello world", None),
        ("LCLICK [10,20,5,30]", "lclick", "", "degenerate_bbox"),
        ("hover [0,0,1001,5]", "hover", "", "bbox_out_of_range"),
        ("hover [-1,0,10,5]", "hover", "", "bbox_out_of_range"),
        ("just prose", None, "", "action_or_bbox_not_found"),
        ("xlclick [1,2,3,4]", None, "", "action_or_bbox_not_found"),
        ("  ", None, "", "empty_prediction"),
        (None, None, "", "empty_prediction"),
    ],
)
def test_parse_prediction(spark, text, action, value, error):
    p = A.parse_prediction(F.lit(text).cast("string"))
    r = one(spark, action=p["action"], value=p["value"], error=p["error"])
    assert tuple(r) == (action, value, error)


def test_points(spark):
    b = box(0, 0, 20, 20)
    assert one(spark, v=G.point_in_box(F.lit(0.0), F.lit(10.0), b)) is True
    assert one(spark, v=G.point_in_box(F.lit(0.0), F.lit(10.0), b, inclusive=False)) is False


def scores(spark, rows):
    df = spark.createDataFrame(rows, "target_action string, target_box array<double>, prediction string")
    return S.judged(df).agg(*S.score_columns()).first().asDict()


def test_scores_of_three_rows(spark):
    b = [0.0, 0.0, 100.0, 100.0]
    got = scores(spark, [("lclick", b, "lclick [10,10,30,30]"), ("hover", b, "lclick [10,10,30,30]"), ("type_in", b, "?")])
    assert got["ssr_point_only"] == pytest.approx(2 / 3) and got["joint_success"] == pytest.approx(1 / 3)
    assert got["action_accuracy"] == pytest.approx(1 / 3) and got["macro_all"] == pytest.approx(2 / 9)
    got = scores(spark, [("lclick", b, "lclick [10,10,30,30]"), ("lclick", b, "hover [10,10,30,30]")])
    assert got["macro_present"] == pytest.approx(2 / 3) and got["macro_all"] == pytest.approx(2 / 9)
    assert scores(spark, [])["parse_rate"] == 0


def test_parsed_fields_count_nulls_as_misses(spark):
    df = spark.createDataFrame([("hover", [0.0, 0.0, 9.0, 9.0], None, None, None)], "target_action string, target_box array<double>, predicted_action string, predicted_box array<double>, parse_error string")
    r = S.judged(df, has_parsed=True).first()
    assert (r["error"], r["action_hit"], r["point_hit"]) == ("invalid_parsed_prediction", False, False)


def test_single_value_percentile_and_non_finite(spark):
    df = spark.createDataFrame([(3.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert tuple(df.agg(*S.value_block("v")).first()) == (1, 3.0, 3.0, 3.0, 3.0, 3.0)


@pytest.mark.parametrize(
    "text,original,op,value,fallback,want",
    [
        ("[link] Sign in -> CLICK", "", "", "", None, ("lclick", "CLICK", "", "Sign in", "link", "Click on Sign in.")),
        ("[textbox] Search -> TYPE: red  shoes", "", "TYPE", "", None, ("type_in", "TYPE", "red shoes", "Search", "textbox", 'Type "red shoes" into Search.')),
        ("[combobox] Size -> SELECT: L", "", "", "XL", None, ("type_in", "SELECT", "XL", "Size", "combobox", 'Select "XL" from Size.')),
        ("[menu] File -> CLICK", "HOVER", "CLICK", "", None, ("hover", "HOVER", "", "File", "menu", "Hover over File.")),
        ("[button]  -> CLICK", "", "", "", "Save", ("lclick", "CLICK", "", "Save", "button", "Click on Save.")),
        ("[button]  -> CLICK", "", "", "", None, ("lclick", "CLICK", "", "the button", "button", "Click on the button.")),
        ("a -> b -> ENTER", "", "", "", None, ("lclick", "ENTER", "", "a -> b", "", "Press Enter on a -> b.")),
        (None, None, None, None, None, ("lclick", "CLICK", "", "the target UI element", "", "Click on the target UI element.")),
    ],
)
def test_targets(spark, text, original, op, value, fallback, want):
    p = A.parse_target(*(F.lit(v).cast("string") for v in (text, original, op, value, fallback)))
    r = one(spark, **p, prompt=A.grounding_prompt(p["operation"], p["description"], p["value"]))
    assert tuple(r) == want


def test_compact_redacts_then_cuts(spark):
    t = F.lit("a\x00b\t  c  me@x.org password: hunter2, PASSWORD=x y")
    assert one(spark, v=T.compact(t)) == "a b c <EMAIL> password: <REDACTED>, PASSWORD=<REDACTED> y"
    assert one(spark, v=T.compact(t, 9)) == "a b c <EM"


def test_boxes(spark):
    assert one(spark, v=G.normalize_box(box(20, 10, 100, 60), F.lit(200), F.lit(100))) == [100, 100, 500, 600]
    assert one(spark, v=G.unscale(box(100, 100, 500, 600), F.lit(200), F.lit(100))) == [20, 10, 100, 60]
    assert one(spark, v=G.scaled_box(*(F.lit(v) for v in (0.5, 1.5, 2.5, 2.5)))) == [0, 2, 2, 3]
    assert one(spark, v=G.scaled_box(*(F.lit(v) for v in (2000.0, 5.0, 3000.0, 5.0)))) == [999, 5, 1000, 6]
    assert one(spark, v=G.normalize_box(box(300, 0, 400, 10), F.lit(200), F.lit(100))) is None
    assert one(spark, v=G.polygon_box(F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((1, 2), (5, 0), (3, 9)))))) == [1, 0, 5, 9]


def test_replace_box(spark):
    new = F.array(*(F.lit(v) for v in (1, 2, 3, 4)))
    assert one(spark, v=A.replace_box(F.lit("type_in [5,6,7,8] keep me"), new)) == "type_in [1,2,3,4] keep me"
    assert one(spark, v=A.replace_box(F.lit("prose"), new)) is None


def test_tiles_cover_without_overlap(spark):
    tiles = one(spark, v=G.tile_layout(F.lit(1318), F.lit(5283)))
    boxes = [t["box_xyxy"] for t in tiles]
    assert sum((b[2] - b[0]) * (b[3] - b[1]) for b in boxes) == 1318 * 5283
    assert all(a[2] <= b[0] or b[2] <= a[0] or a[3] <= b[1] or b[3] <= a[1] for i, a in enumerate(boxes) for b in boxes[:i])
    assert [one(spark, v=G.context_bucket(F.lit(n))) for n in (20000, 40000, 60000, 70000)] == ["16k_32k", "32k_48k", "48k_64k", "over_64k"]


@pytest.mark.parametrize("a,b,low,high", [("Downloads", "downloads", 1, 1), ("Download all files", "Download all", 0.85, 1), ("Checkout", "Weather", 0, 0.68), ("", "x", 0, 0)])
def test_similarity(a, b, low, high):
    assert low <= L.similarity(a, b) <= high
    assert L.normalized("Zip Code™") == "zip codetm"


def test_links(spark):
    t = spark.createDataFrame([(1, "Submit order", [100.0, 100.0, 140.0, 120.0]), (2, "Submit order", [0.0, 0.0, 10.0, 10.0]), (3, "", [0.0, 0.0, 9.0, 9.0])], "k int, text string, box array<double>")
    t = t.withColumns({"width": F.lit(1000), "height": F.lit(800)})
    d = spark.createDataFrame(
        [(1, 0, "Cancel", 0.99, [100.0, 100.0, 140.0, 120.0]), (1, 1, "Submit order", 0.9, [105.0, 122.0, 150.0, 140.0]), (1, 2, "Submit orders", 0.95, [700.0, 700.0, 750.0, 720.0]), (2, 0, "Submit ordre now", 0.9, [900.0, 700.0, 950.0, 720.0]), (1, 3, "Submit order", 0.1, [100.0, 100.0, 140.0, 120.0])],
        "k int, index int, text string, confidence double, box array<double>",
    )
    got = {r["k"]: r for r in L.best_links(t, d, "k").collect()}
    assert (got[1]["accepted"], got[1]["link"]["index"], got[1]["reason"]) == (True, 1, "matched_nearby_ocr_text")
    assert (got[2]["accepted"], got[2]["box"], got[2]["reason"]) == (False, [0.0, 0.0, 10.0, 10.0], "no_credible_nearby_text")
    assert got[3]["reason"] == "empty_target_text"


def test_balanced_repeat(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    plan = [(r["id"], r["variant"]) for r in P.balanced_repeat(rows, 8, 42, "id").collect()]
    assert len(set(plan)) == 8
    counts = {}
    for k, v in plan:
        counts.setdefault(k, []).append(v)
    assert sorted(len(v) for v in counts.values()) == [2, 3, 3] and all(sorted(v) == list(range(len(v))) for v in counts.values())
    again = [(r["id"], r["variant"]) for r in P.balanced_repeat(rows.orderBy(F.desc("id")), 8, 42, "id").collect()]
    assert sorted(plan) == sorted(again)
    with pytest.raises(ValueError):
        P.balanced_repeat(rows.limit(0), 8, 42, "id")


def test_hashes(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"42\x1fkey").digest()[:8], "big")
    assert int(one(spark, v=H.stable_int(42, F.lit("key")))) == want
    assert one(spark, v=H.stable_choice(7, 42, F.lit("key"))) == want % 7
    a, b = one(spark, a=H.paired_seed(1, F.lit("u")), b=H.paired_seed(2, F.lit("u")))
    assert a != b


def test_coverage_guards(spark):
    a, b = spark.range(5), spark.range(4)
    with pytest.raises(ValueError):
        S.require_coverage(a, b, "id")
    assert S.require_coverage(a, b, "id", allow_partial=True)["missing"] == 1
    with pytest.raises(ValueError):
        S.require_coverage(b, a, "id", allow_partial=True)
    with pytest.raises(ValueError):
        S.unique(b.union(b), "id")


def packed(samples, **kw):
    return [[k for k, _ in m] for m in pack_stream(enumerate(samples), Packer(**{"expected": 10, "most": 12, "most_per_sample": 12, "buffer_size": 2} | kw))]


def test_packer():
    assert packed([5, 5, 12, 3]) == [[0, 1], [2], [3]]
    assert packed([13, 10]) == [[1]]
    assert packed([9, 9, 3]) == [[0, 2], [1]]  # the second waits, the third fills the sequence to its limit
    assert packed([9, 9, 9, 9], buffer_size=1) == [[0], [1]] or len(packed([9, 9, 9, 9], buffer_size=1)) >= 2
    kept = packed([9, 9, 9, 9, 9], buffer_size=1, drop_overflow=False)
    assert sorted(k for m in kept for k in m) == [0, 1, 2, 3, 4]
    p = Packer(expected=10, most=12, most_per_sample=12)
    assert not p.add_mandatory("m", 12) and p.add_mandatory("m", 11)


def test_rules_over_objects(spark):
    things = [("cat", [0.0, 0.0, 10.0, 10.0], "red"), ("dog", [50.0, 0.0, 60.0, 10.0], "blue"), ("dog", [80.0, 0.0, 90.0, 10.0], "blue")]

    def ok(include, exclude=()):
        clause = lambda c: (c["class"], c["count"], c.get("color"), *c.get("position", (None, None)))
        kind = "array<struct<class:string,count:int,color:string,side:string,of:int>>"
        df = spark.createDataFrame([(things, [clause(c) for c in include], [clause(c) for c in exclude])], f"objects array<struct<class:string,box:array<double>,color:string>>, include {kind}, exclude {kind}")
        return df.select(B.judged_rules("objects", "include", "exclude").alias("r")).first()["r"]["correct"]

    cat = {"class": "cat", "count": 1}
    assert ok([cat, {"class": "dog", "count": 2, "position": ("right of", 0)}])
    assert not ok([cat, {"class": "dog", "count": 1, "position": ("above", 0)}])
    assert not ok([{"class": "cow", "count": 1}, {**cat, "position": ("left of", 0)}])
    assert ok([{**cat, "color": "red"}]) and not ok([{**cat, "color": "blue"}])
    assert ok([cat], [{"class": "dog", "count": 3}]) and not ok([cat], [{"class": "dog", "count": 2}])


def gate(spark, scores, parents):
    rows = [(1, i, q, scores[q], p) for i, (q, p) in enumerate(parents.items())]
    df = spark.createDataFrame(rows, "item int, order int, question int, score double, parents array<int>")
    return {r["question"]: r["gated"] for r in B.gated(df, "item").collect()}


def test_gate_cascades_in_order(spark):
    assert gate(spark, {1: 0.0, 2: 1.0, 3: 1.0}, {1: [0], 2: [1], 3: [2]}) == {1: 0.0, 2: 0.0, 3: 0.0}
    assert gate(spark, {1: 1.0, 2: 1.0, 3: 0.0}, {1: [2], 2: [3], 3: [0]}) == {1: 1.0, 2: 0.0, 3: 0.0}
    with pytest.raises(Exception, match="no question 9"):
        gate(spark, {1: 1.0}, {1: [9]})


def test_suppression(spark):
    boxes = [[0, 0, 10, 10], [1, 1, 10, 10], [50, 50, 60, 60]]
    df = spark.createDataFrame([("k", i + 1, [float(v) for v in x]) for i, x in enumerate(boxes)], "k string, rank int, box array<double>")
    kept = lambda t: sorted(r["rank"] for r in B.suppressed(df, ["k"], t).collect())
    assert kept(0.5) == [1, 3] and kept(1) == [1, 2, 3]
    box = F.array(*(F.lit(float(v)) for v in (0, 0, 9, 9)))
    assert one(spark, v=B.pixel_iou(box, box)) == 1


def test_prediction_of_other_white_space(spark):
    p = A.parse_prediction(F.lit("\n\t "))
    assert one(spark, v=p["error"]) == "empty_prediction"
    p = A.parse_prediction(F.lit("lclick [1,2,3,4] \tx\t"))
    assert one(spark, v=p["value"]) == "x"


def test_answer_text(spark):
    assert one(spark, v=T.final_answer(F.lit("a</think> b </think> c <|endoftext|>"))) == "c"
    assert one(spark, a=T.with_article(F.lit("apple")), b=T.plural(F.lit("bus"))) == ("an apple", "buses")
    assert one(spark, a=T.broad_category(F.lit("entity - whole (x)")), b=T.detailed_category(F.lit("entity - whole (x)"))) == ("entity", "entity - whole")
    assert one(spark, v=T.canonicalize(F.lit(" a, b.  c!"))) == "a b c"


def test_web_calls_and_boxes(spark):
    from gristmill.functions import web as B

    df = spark.createDataFrame([('click(uid="a", x=1)',), ("os.system(1)",), ("oops(",), (None,)], "t string")
    got = [r[0] for r in df.select(B.parse_call("t")).collect()]
    assert got == ['{"name": "click", "arguments": {"uid": "a", "x": 1}}', None, None, None]
    calls = [("Say(text='it\\'s \\x41', n=-1.5e2, ok=True, none=None, l=[1, 'b'], d={'k': 2})",), ('load(1, "u", url="x")',), ("f(a=b)",), ("f(a=1) + 1",), ("f()",)]
    got = [r[0] for r in spark.createDataFrame(calls, "t string").select(B.parse_call("t")).collect()]
    assert got[0] == '{"name": "say", "arguments": {"text": "it\'s A", "n": -150.0, "ok": true, "none": null, "l": [1, "b"], "d": {"k": 2}}}'
    assert got[1:] == ['{"name": "load", "arguments": {"url": "x"}}', None, None, '{"name": "f", "arguments": {}}']
    text = F.lit("(uid = a.b) one [[bbox]] x=1 y=2 width=3 height=4\n(uid = axb) two")
    assert one(spark, v=B.candidate_box(text, F.lit("a.b"))) == [1, 2, 4, 6]
    assert one(spark, v=B.candidate_box(text, F.lit("axb"))) is None
    assert one(spark, v=B.candidate_box(F.lit(None).cast("string"), F.lit("q"))) is None
    assert one(spark, w=B.viewport(F.lit(" 720.5h x 1280w "))[0], h=B.viewport(F.lit("x"))[1]) == (1280, None)


LITERALS = [
    "(1)", "(1,)", "()", "((1))", "[(1), (2,)]", r"'\a\v\101\7\0x\q'", "1_0", "1_0.5_0e1_0", "'a' \"b\" 'c'", "0x1F", "-0b11", "0o17", "- 5", "+.5", "00", "1.", "r'\\n'", "u'x'",
    "{1: 2, 1: 3}", "{}", "{'a': (1), 'b': [None, True]}", r"'\U0001F600\u00e9\xe9'", r"'\N{BULLET}'", "'''a'b\nc'''", '"""x"""', "''", "'a\\\nb'", "\n [1,\n 2]",
]


@pytest.mark.parametrize("literal", LITERALS)
def test_literals_of_a_call(literal):
    import ast

    from gristmill.functions import web as B

    want = ast.literal_eval(literal.strip())
    listed = lambda v: [listed(x) for x in v] if isinstance(v, (list, tuple)) else {k: listed(x) for k, x in v.items()} if isinstance(v, dict) else v
    assert B._Call(f"F(x={literal})").read() == {"name": "f", "arguments": {"x": listed(want)}}


def test_sets_and_rejected_calls():
    from gristmill.functions import web as B

    assert B._Call("f(x={2, 1, 2}, y={1: 2, 1: 3})").read()["arguments"] == {"x": [2, 1], "y": {1: 3}}
    for bad in ("f(a=1, a=2)", "f(a=1, 2)", "f(x=01)", "f(x=1__0)", "f(x=1_)", r"f(x='\x4')", "f(x=--1)", "f(x=1 2)", "f(x=[1)", "f(x=(1,,))", "f(x=1x)", "f()()", "f", "f(x=b'a')", "f(x={1: 2, 3})", "a.f()", "f(x='a\nb')"):
        with pytest.raises((ValueError, TypeError, KeyError)):
            B._Call(bad).read()


def test_random_literals_round_trip():
    import ast
    import random

    from gristmill.functions import web as B

    r = random.Random(11)

    def made(depth):
        kind = r.randrange(8 if depth else 5)
        if kind < 2:
            return repr(r.choice([0, -7, 10**20, 1.5, -2e-9, True, None, False]))
        if kind < 5:
            return ascii("".join(r.choice("ab'\"\\\n\té\x07\U0001F600 ") for _ in range(r.randrange(8)))) if kind == 2 else repr("".join(r.choice("ab'\"\\\n\té\x07 ") for _ in range(r.randrange(8))))
        parts = [made(depth - 1) for _ in range(r.randrange(4))]
        return {5: f"[{', '.join(parts)}]", 6: f"({', '.join(parts)})", 7: "{" + ", ".join(f"'{i}': {p}" for i, p in enumerate(parts)) + "}"}[kind]

    listed = lambda v: [listed(x) for x in v] if isinstance(v, (list, tuple)) else {k: listed(x) for k, x in v.items()} if isinstance(v, dict) else v
    for _ in range(500):
        text = made(3)
        assert B._Call(f"go(a={text}, b=1)").read()["arguments"] == {"a": listed(ast.literal_eval(text)), "b": 1}, text


def test_token_arrays(spark):
    from gristmill.functions import sequences as Q

    ids = F.array(*(F.lit(i) for i in (5, 6, 7)))
    assert one(spark, v=Q.until(ids, 6)) == [5, 6] and one(spark, v=Q.until(ids, 9)) == [5, 6, 7]
    assert one(spark, v=Q.padded(ids, 5, 0)) == [5, 6, 7, 0, 0]
    assert one(spark, v=Q.middle_frames(F.lit(4), F.lit(2))) == [0, 1, 1, 1]
    assert one(spark, v=Q.largest_number(F.array(F.lit("image_2.jpg"), F.lit("image_10.jpg"), F.lit("x.jpg")))) == 10
    assert len(one(spark, v=Q.masked_places(F.lit(5), F.lit(0.0), 1))) == 1
    ends = one(spark, v=Q.with_end(ids, 9, F.lit(True), 3))
    assert ends[:4] == [5, 6, 7, 9] and set(ends[4:]) <= {9} and len(ends) <= 8
