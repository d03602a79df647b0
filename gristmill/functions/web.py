"""Recorded web actions: candidates, calls, viewports, histories."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from gristmill.functions.arrays import bound
from gristmill.functions.text import compact, first_filled

# Intents that are taken; the attributes that describe an element, the first filled one first; how numbers,
# boxes, viewports and the blocks of candidates are written; depths of history; and the prompts' wording.
INTENTS = {"click": "lclick", "submit": "lclick", "text_input": "type_in", "change": "type_in"}
DESCRIBING = ("aria-label", "aria_label", "text", "title", "placeholder", "alt", "value")
NUMBER = r"([-+0-9.eE]+)"
BOX = rf"\[\[bbox\]\]\s*x={NUMBER}\s+y={NUMBER}\s+width={NUMBER}\s+height={NUMBER}"
VIEWPORT = r"\A\s*([0-9.]+)h\s*x\s*([0-9.]+)w\s*\z"
BLOCK_HEAD, BLOCK_BODY = r"(?s)\(uid\s*=\s*", r"\)\s*(.*?)(?=\n\(uid\s*=|\z)"
HISTORY_DEPTHS = (0, 2, 4, 8)
REQUEST = "Follow the user's instruction and predict the next GUI action."
INSTRUCTION, NO_INSTRUCTION, RECENT, ITEM = "Instruction: ", "Continue the current web task.", "Recent actions:", "- "

#: Tokens of a call and, by kind, how a literal is read.
TOKEN = re.compile(
    r"""\s*(?:(?P<text>(?P<raw>[rRuU]?)(?:\'\'\'(?:[^\\]|\\.)*?\'\'\'|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"))
    |(?P<number>[-+]?\s*(?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][-+]?\d[\d_]*)?)(?!\w))
    |(?P<name>[^\W\d]\w*)|(?P<mark>[()\[\]{}=,:]))\s*""",
    re.X | re.S,
)
ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{1,3})|N\{([^}]+)\}|(\r\n|.))", re.S)
#: What a backslash and one more character stand for; a line break after one stands for nothing.
PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "a": "\a", "v": "\v", "\\": "\\", "'": "'", '"': '"', "\n": "", "\r": "", "\r\n": ""}
WORDS = {"True": True, "False": False, "None": None}
CLOSING = {"[": "]", "(": ")", "{": "}"}
DIGITS = re.compile(r"\d+(?:_\d+)*")


def _number(text: str) -> int | float:
    """A number with its sign; underlines only between digits, no leading zeros of whole numbers but zero's."""
    sign, bare = (-1 if text[0] == "-" else 1), text.lstrip("+-").strip()
    if re.match("0[xXoObB]", bare):
        return sign * int(bare, 0)
    if re.search(r"_(?!\d)|(?<!\d)_", bare):
        raise ValueError(text)
    return sign * (int(bare, 0 if bare.strip("0_") else 10) if DIGITS.fullmatch(bare) else float(bare))


def _unescaped(m: re.Match) -> str:
    if m[4]:
        return chr(int(m[4], 8))
    if m[5]:
        return unicodedata.lookup(m[5])
    if m[1] or m[2] or m[3]:
        return chr(int(m[1] or m[2] or m[3], 16))
    if m[6] in ("x", "u", "U", "N"):  # not followed by what they need
        raise ValueError(m[0])
    return PLAIN.get(m[6], m[0])


def _text(token: str) -> str:
    prefix = token[0] if token[0] in "rRuU" else ""
    body = token[len(prefix) :]
    marks = 3 if len(body) >= 6 and body[:3] in ("\'\'\'", '"""') else 1
    body = body[marks:-marks].replace("\r\n", "\n")
    return body if prefix in ("r", "R") else ESCAPE.sub(_unescaped, body)


class _Call:
    """Reads ``name(literal, key=literal, ...)`` token by token; raises ValueError on anything else."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if m is None:
                raise ValueError(text[at : at + 20])
            kind = next(k for k in ("text", "number", "name", "mark") if m[k] is not None)
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def take(self, kind: str, value: str | None = None) -> str:
        found = self.tokens[self.at]
        if found[0] != kind or (value is not None and found[1] != value):
            raise ValueError(f"{kind} {value or ''} expected, found {found[1]!r}")
        self.at += 1
        return found[1]

    def sees(self, *tokens: str) -> bool:
        return tuple(t[1] for t in self.tokens[self.at : self.at + len(tokens)] if t[0] in ("mark", "name")) == tokens

    def listed(self, close: str, item) -> tuple[list, bool]:
        """The items up to the closing mark, and whether a comma came last."""
        out, comma = [], False
        while not self.sees(close):
            out.append(item())
            comma = not self.sees(close)
            if comma:
                self.take("mark", ",")
        self.take("mark", close)
        return out, comma

    def pair(self):
        key = self.literal()
        self.take("mark", ":")
        return key, self.literal()

    def literal(self):
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return _number(value)
        if kind == "text":  # texts beside each other are one
            more = self.literal() if self.tokens[self.at][0] == "text" else ""
            return _text(value) + more
        if kind == "name" and value in WORDS:
            return WORDS[value]
        if kind == "mark" and value == "{":
            return self.braces()
        if kind == "mark" and value in CLOSING:
            found, comma = self.listed(CLOSING[value], self.literal)
            return found[0] if value == "(" and len(found) == 1 and not comma else found
        raise ValueError(f"a literal expected, found {value!r}")

    def braces(self) -> dict | list:
        """A dictionary, of equal keys the last; or a set, as the list of its elements in order."""
        if self.sees("}"):
            return dict(self.listed("}", self.pair)[0])
        start = self.at
        self.literal()
        is_dict, self.at = self.sees(":"), start
        found, _ = self.listed("}", self.pair if is_dict else self.literal)
        return dict(found) if is_dict else list(dict.fromkeys(found))

    def argument(self):
        """(key, value), or None for a value without a key, which is passed over."""
        if self.tokens[self.at][0] == "name" and self.tokens[self.at + 1] == ("mark", "="):
            key = self.take("name")
            self.take("mark", "=")
            return key, self.literal()
        self.literal()
        return None

    def read(self) -> dict:
        name = self.take("name")
        self.take("mark", "(")
        found, _ = self.listed(")", self.argument)
        self.take("end")
        named = [a is not None for a in found]
        keys = [a[0] for a in found if a is not None]
        if len(set(keys)) < len(keys) or named != sorted(named):
            raise ValueError("a repeated key, or a value without a key after one with a key")
        return {"name": name.lower(), "arguments": dict(a for a in found if a is not None)}


@pandas_udf(StringType())
def parse_call(text: pd.Series) -> pd.Series:
    """``name(key=literal, ...)`` as a JSON object with name and arguments; null if it isn't one."""

    def one(t):
        try:
            return json.dumps(_Call(t or "").read())
        except (ValueError, TypeError, IndexError, KeyError, OverflowError, RecursionError):
            return None

    return text.map(one)


def candidate_box(candidates: Column, uid: Column) -> Column:
    """Box of the block that a uid heads; null without block or box."""
    quoted = F.regexp_replace(uid, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    pattern = F.concat(F.lit(BLOCK_HEAD), quoted, F.lit(BLOCK_BODY))
    block = F.call_function("regexp_extract", F.coalesce(candidates, F.lit("")), pattern, F.lit(1))

    def corners(b):
        x, y, w, h = (F.regexp_extract(b, BOX, i).try_cast("double") for i in range(1, 5))
        return F.when(h.isNotNull(), F.array(x, y, x + w, y + h))

    return bound(block, corners)  # the pattern is made for each row: it is looked for once


def viewport(text: Column) -> tuple[Column, Column]:
    """(width, height); the text names the height first."""
    height, width = (F.regexp_extract(text, VIEWPORT, i).try_cast("double") for i in (1, 2))
    return width, height


CANDIDATE = "tag string, is_original_target boolean, attributes string"


def choose_candidate(candidates: Column) -> Column:
    """Of JSON candidates the one flagged as original, else the first, among those with a rectangle; null if none has."""
    parsed = F.transform(candidates, lambda c: F.from_json(c, CANDIDATE))
    rect = lambda c: F.coalesce(F.get_json_object(c["attributes"], "$.bounding_box_rect"), F.lit(""))
    good = F.filter(parsed, lambda c: c.isNotNull() & (rect(c) != ""))
    flagged = F.filter(good, lambda c: F.coalesce(c["is_original_target"], F.lit(False)))
    return F.coalesce(F.get(flagged, F.lit(0)), F.get(good, F.lit(0)))


def rectangle(candidate: Column) -> Column:
    """x, y, width, height as corners; null without a positive extent."""
    v = F.transform(F.split(F.get_json_object(candidate["attributes"], "$.bounding_box_rect"), ","), lambda s: F.trim(s).try_cast("double"))
    return F.when((F.size(v) == 4) & (v[2] > 0) & (v[3] > 0), F.array(v[0], v[1], v[0] + v[2], v[1] + v[3]))


def description(candidate: Column) -> Column:
    own = [F.get_json_object(candidate["attributes"], f"$['{k}']") for k in DESCRIBING]
    return F.coalesce(first_filled(*own), candidate["tag"], F.lit(""))


def web_prompt(messages: Column, actions: Column, depth: Column) -> Column:
    """The last message that says something and up to depth last actions, as the lines of a prompt."""
    asked = F.element_at(F.concat(F.array(F.lit(NO_INSTRUCTION)), F.filter(F.transform(messages, lambda m: compact(m, 1000)), lambda m: F.length(m) > 0)), -1)
    fixed = F.array(F.lit(REQUEST), F.concat(F.lit(INSTRUCTION), asked))
    skipped = F.size(actions) - F.greatest(depth, F.lit(0))
    shown = F.transform(F.filter(actions, lambda _, i: i >= skipped), lambda a: F.concat(F.lit(ITEM), compact(a, 300)))
    history = F.when(F.size(shown) > 0, F.concat(F.array(F.lit(RECENT)), shown)).otherwise(shown)
    return F.array_join(F.concat(fixed, history), "\n")
