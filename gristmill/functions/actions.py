"""Actions written as text: ``name [x1,y1,x2,y2] value``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.arrays import bound
from gristmill.functions.text import compact, first_filled, strip

# The actions, the grammar of a prediction and of an answer, and the prompts' wording.
ACTIONS = ("lclick", "hover", "type_in")
NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"
PREDICTION = r"(?i)(?<![A-Za-z0-9_])(lclick|hover|type_in)\s*\[\s*(N)\s*,\s*(N)\s*,\s*(N)\s*,\s*(N)\s*\](?:\s+([^\r\n<]*))?".replace("N", NUMBER)
ANSWER = r"\A(lclick|hover|type_in) \[(\d+),(\d+),(\d+),(\d+)\](?: ([^\n]*))?\z"
REPLACEABLE = r"(?s)\A(lclick|hover|type_in)\s+\[\s*[-+0-9., ]+\s*\](.*)\z"
OPERATION = r"(?is)\A\s*(CLICK|HOVER|TYPE|SELECT|ENTER)\s*(?::\s*(.*))?\z"
ROLE = r"(?s)\A\s*\[([^\]]+)\]\s*(.*)\z"
TASK_HEAD = "Complete the following web task by predicting the next GUI action.\nTask: "
HISTORY_HEAD = "\nPrevious actions:\n"


def parsed_prediction(text: Column) -> Column:
    """struct action, box, value, error: of the first action in a text; an action with a bad box keeps its name.

    The text is bound once, so that an expensive expression isn't repeated for every field.
    """

    def parse(t):
        get = lambda i: F.regexp_extract(t, PREDICTION, i)
        blank = F.length(strip(F.coalesce(t, F.lit("")))) == 0
        found = ~blank & t.rlike(PREDICTION)
        box = F.array(*(get(i).cast("double") for i in range(2, 6)))
        return F.struct(
            F.when(found, F.lower(get(1))).alias("action"), F.when(found, box).alias("box"),
            F.when(found, strip(get(6))).otherwise("").alias("value"), blank.alias("blank"),
        )

    def judge(r):
        box = r["box"]
        error = (
            F.when(r["blank"], "empty_prediction")
            .when(r["action"].isNull(), "action_or_bbox_not_found")
            .when(F.exists(box, lambda v: F.abs(v) == float("inf")), "non_finite_bbox")
            .when(F.exists(box, lambda v: (v < 0) | (v > 1000)), "bbox_out_of_range")
            .when((box[2] <= box[0]) | (box[3] <= box[1]), "degenerate_bbox")
        )
        return F.struct(r["action"].alias("action"), box.alias("box"), r["value"].alias("value"), error.alias("error"))

    return F.get(F.transform(F.transform(F.array(text), parse), judge), F.lit(0))


def parse_prediction(text: Column) -> dict[str, Column]:
    """The fields of parsed_prediction() as columns."""
    parsed = parsed_prediction(text)
    return {name: parsed[name] for name in ("action", "box", "value", "error")}


def render_action(action: Column, box: Column, value: Column | None = None) -> Column:
    coords = F.array_join(F.transform(box, lambda v: v.cast("int").cast("string")), ",")
    out = F.concat(action, F.lit(" ["), coords, F.lit("]"))
    if value is None:
        return out
    shown = F.coalesce(value, F.lit(""))
    return F.when((action == "type_in") & (shown != ""), F.concat(out, F.lit(" "), compact(shown, 512))).otherwise(out)


def is_answer(text: Column) -> Column:
    return F.coalesce(text.rlike(ANSWER), F.lit(False))


def replace_box(answer: Column, box: Column) -> Column:
    """The answer with another box; null if it isn't an action."""
    coords = F.array_join(F.transform(box, lambda v: v.cast("int").cast("string")), ",")
    get = lambda i: F.regexp_extract(answer, REPLACEABLE, i)
    return F.when(answer.rlike(REPLACEABLE), F.concat(get(1), F.lit(" ["), coords, F.lit("]"), get(2)))


def canonical_action(operation: Column) -> Column:
    op = F.upper(first_filled(operation, F.lit("CLICK")))
    return F.when(op == "HOVER", "hover").when(op.isin("TYPE", "SELECT"), "type_in").otherwise("lclick")


def parsed_target(repr_text: Column, original_op: Column, op: Column, value: Column, fallback: Column) -> Column:
    """struct action, operation, value, description, role of ``[role] text -> OPERATION: value``; structured fields win.

    Every step is bound once, as in parsed_prediction().
    """
    given = F.struct(compact(repr_text).alias("raw"), original_op.alias("original"), op.alias("op"), value.alias("value"), fallback.alias("fallback"))

    def cut(g):
        raw = g["raw"]
        has = raw.contains("->")
        part = lambda i, none: F.when(has, F.regexp_extract(raw, r"(?s)\A(.*)->(.*)\z", i)).otherwise(none)
        return F.struct(g.alias("given"), compact(part(1, raw)).alias("head"), part(2, F.lit("")).alias("tail"))

    def named(c):
        head, g = c["head"], c["given"]
        with_role = head.rlike(ROLE)
        role = F.when(with_role, compact(F.regexp_extract(head, ROLE, 1), 128)).otherwise("")
        text = F.when(with_role, compact(F.regexp_extract(head, ROLE, 2))).otherwise(head)
        operation = F.upper(first_filled(g["original"], g["op"], F.upper(F.regexp_extract(c["tail"], OPERATION, 1)), F.lit("CLICK")))
        said = compact(F.regexp_extract(c["tail"], OPERATION, 2), 512)
        return F.struct(operation.alias("operation"), role.alias("role"), text.alias("text"), g["value"].alias("value"), said.alias("said"), g["fallback"].alias("fallback"))

    def described(n):
        role = n["role"]
        other = F.when(role != "", F.concat(F.lit("the "), role)).otherwise("the target UI element")
        shown = F.when(n["text"] != "", n["text"]).otherwise(F.coalesce(bound(compact(n["fallback"]), lambda f: first_filled(f)), other))
        return F.struct(
            canonical_action(n["operation"]).alias("action"), n["operation"].alias("operation"),
            compact(F.coalesce(first_filled(n["value"], n["said"]), F.lit("")), 512).alias("value"), shown.alias("description"), role.alias("role"),
        )

    return bound(bound(bound(given, cut), named), described)


def parse_target(repr_text: Column, original_op: Column, op: Column, value: Column, fallback: Column) -> dict[str, Column]:
    """The fields of parsed_target() as columns."""
    parsed = parsed_target(repr_text, original_op, op, value, fallback)
    return {name: parsed[name] for name in ("action", "operation", "value", "description", "role")}


def grounding_prompt(operation: Column, description: Column, value: Column) -> Column:
    what = F.rtrim(description, F.lit(" ."))
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    filled = value != ""
    return (
        F.when(operation == "HOVER", say("Hover over ", what, "."))
        .when((operation == "TYPE") & filled, say('Type "', value, '" into ', what, "."))
        .when(operation == "TYPE", say("Type into ", what, "."))
        .when((operation == "SELECT") & filled, say('Select "', value, '" from ', what, "."))
        .when(operation == "SELECT", say("Select an option from ", what, "."))
        .when(operation == "ENTER", say("Press Enter on ", what, "."))
        .otherwise(say("Click on ", what, "."))
    )


def history_prompt(task: Column, actions: Column, index: Column, most: int = 8) -> Column:
    """The task and the last actions before an index; without a number, before the last action."""
    at = F.coalesce(index.try_cast("int"), F.greatest(F.lit(0), F.size(actions) - 1))
    before = F.slice(actions, 1, F.greatest(F.lit(0), F.when(at < 0, F.size(actions) + at).otherwise(F.least(at, F.size(actions)))))
    last = F.slice(before, F.greatest(F.lit(1), F.size(before) - most + 1), F.lit(most))
    lines = F.array_join(F.transform(last, lambda a: F.concat(F.lit("- "), compact(a, 300))), "\n")
    head = F.concat(F.lit(TASK_HEAD), compact(task, 1000))
    return F.when(F.size(last) > 0, F.concat(head, F.lit(HISTORY_HEAD), lines)).otherwise(head)


# The wording of prompts for elements and whole pages.
ELEMENT = ('Locate and click the ', ' UI element described as: "', '".')
PAGE = ("The following ", " images are non-overlapping tiles from one ", " webpage screenshot, ordered left-to-right and then top-to-bottom. Treat them as one complete page. ")
PAGE_END = " Return the action and bounding box with coordinates normalized to the complete original screenshot in [0,1000]."


def element_prompt(domain: Column, instruction: Column) -> Column:
    return F.concat(F.lit(ELEMENT[0]), domain, F.lit(ELEMENT[1]), instruction, F.lit(ELEMENT[2]))


def page_prompt(instruction: Column, width: Column, height: Column, tiles: Column) -> Column:
    size = F.concat_ws("x", width.cast("string"), height.cast("string"))
    return F.concat(F.lit(PAGE[0]), tiles.cast("string"), F.lit(PAGE[1]), size, F.lit(PAGE[2]), instruction, F.lit(PAGE_END))
