"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

A kind has a base score; a word that goes with it, shortly before the span, raises it. Email, address, card, phone and
account numbers have patterns or checksums that suffice, so their base scores pass the threshold. National numbers,
phones without a country and secrets look like much else: they pass only with such a word before them.

Only DataFrame functions run here. Defined results for odd input: a null text counts as empty and has no
span; positions are code points; equal texts give equal spans; an empty table gives an empty table; other
columns of the input are ignored, whatever they are called; very long texts and texts of very many spans are whole, and
their work is linear in both: no position is searched from the start of a text. The character U+0001 in a text is treated as
U+0002 while matching (no pattern holds either), so positions do not move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm._shared import table

#: Kinds in the order that breaks ties between spans with one start.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local", "secret")

#: Group loops are possessive: Java runs these without recursion, so long runs can't overflow the stack. The
#: look-behinds only skip starts that can't match when the start of their run doesn't, which keeps runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9])",
    "local": r"(?<![A-Za-z0-9])[0-9]{2,5}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}",
}

#: What a text must hold for the pattern to be worth running.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-", "local": None, "secret": None}

#: Percents: the score of a confirmed span, and what is added (up to 100) if a word of its kind stands close before it.
BASE_SCORE = {"email": 90, "ip": 60, "card": 70, "phone": 60, "iban": 80, "ssn": 40, "local": 40, "secret": 35}
CONTEXT_WORDS = {
    "email": "e-?mail|mail|contact|write",
    "ip": "ip|host|server|address|addr",
    "card": "card|credit|visa|mastercard|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "ssn": "ssn|social security|national id|tax id",
    "local": "phone|tel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone",
    "secret": "token|secret|password|passwd|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer|credentials?",
}
CONTEXT = {k: f"(?i)(^|[^A-Za-z0-9])({words})([^A-Za-z0-9]|$)" for k, words in CONTEXT_WORDS.items()}
CONTEXT_GAIN, CONTEXT_CHARS, LEAST_SCORE = 25, 40, 50


#: Entries whose running totals are taken together, and characters of a piece of text that is cut out at once.
BLOCK, CHUNK = 128, 256
SPANS = "array<struct<start:int,stop:int,match:string,score:int>>"


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _div(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("int")


def _running(values: Column, add, deep: int = 1) -> Column:
    """What add (of whole numbers, from 0) makes of all values before each one; by blocks, and blocks of blocks, so the work is linear."""
    total = lambda xs: F.aggregate(xs, F.lit(0), add)

    def blocks(n):
        firsts = F.sequence(F.lit(0), _div(F.size(n) - 1, BLOCK))
        sums = F.transform(firsts, lambda b: total(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))
        if deep:
            base = _running(sums, add, deep - 1)
        else:
            base = _bound(sums, lambda m: F.transform(m, lambda _, i: total(F.slice(m, F.lit(1), i))))
        within = lambda i: total(F.slice(n, _div(i, BLOCK) * BLOCK + 1, i % BLOCK))
        return _bound(base, lambda before: F.transform(n, lambda _, i: add(before[_div(i, BLOCK)], within(i))))

    return _bound(values, lambda n: F.when(F.size(n) > 0, blocks(n)).otherwise(F.array().cast("array<int>")))


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _cut(chunks: Column, begin: Column, end: Column) -> Column:
    """The characters from begin to end (exclusive) of a text in chunks, without a walk from its start."""
    first = _div(begin, CHUNK)
    held = F.array_join(F.slice(chunks, first + 1, _div(end - 1, CHUNK) - first + 1), "")
    return F.when(end > begin, F.substring(held, begin - first * CHUNK + 1, end - begin)).otherwise("")


def _found(text: Column, safe: Column, kind: str, min_score: int) -> Column:
    """array<struct<start,stop,match,score>> of a kind: mark the matches, split at the marks, add up lengths."""
    marked = F.regexp_replace(safe, PATTERNS[kind], "\u0001$0\u0001")

    def spans(pieces, hits):
        def one(starts, chunks):
            def span(i):
                start = starts[i]
                before = _cut(chunks, F.greatest(start - CONTEXT_CHARS, F.lit(0)), start)
                score = F.when(before.rlike(CONTEXT[kind]), min(BASE_SCORE[kind] + CONTEXT_GAIN, 100)).otherwise(BASE_SCORE[kind])
                return F.struct(start.alias("start"), (start + F.char_length(pieces[i])).alias("stop"), pieces[i].alias("match"), score.alias("score"))

            return F.filter(F.transform(hits, span), lambda s: s["score"] >= min_score)

        lengths = F.transform(pieces, lambda p: F.char_length(p))
        return _bound(_running(lengths, lambda a, x: a + x), lambda starts: _bound(_chunks(text), lambda chunks: one(starts, chunks)))

    def confirmed(pieces):
        return F.array_compact(F.transform(pieces, lambda p, i: F.when((i % 2 == 1) & _confirmed(p, kind), i)))

    none = F.array().cast(SPANS)
    some = lambda pieces: _bound(confirmed(pieces), lambda hits: F.when(F.size(hits) > 0, spans(pieces, hits)).otherwise(none))
    worth = text.contains(HINTS[kind]) if HINTS[kind] else F.lit(True)
    return F.when(worth & safe.rlike(PATTERNS[kind]), _bound(F.split(marked, "\u0001", -1), some)).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits passes Luhn's check."""
    n = F.char_length(digits)

    def add(acc, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 1
        return acc + F.when(twice & (d > 4), d * 2 - 9).when(twice, d * 2).otherwise(d)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def mod97(account: Column) -> Column:
    """Whether an account number in capitals and digits leaves 1 by 97, its first four characters moved to the end."""
    bare = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.char_length(bare)), F.substring(bare, 1, 4))

    def add(acc, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    n = F.char_length(turned)
    return F.when(n > 4, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) == 1).otherwise(False)


def _confirmed(m: Column, kind: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}")
    if kind == "card":
        return F.char_length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "ssn":  # numbers that are given to no one
        return ~m.rlike("^(000|666|9)|-00-|-0000$")
    if kind == "local":
        return F.char_length(digits).between(9, 12)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def find_spans(text: Column, kinds: tuple[str, ...] = KINDS, min_score: int = LEAST_SCORE) -> dict[str, Column]:
    """Per kind an array<struct<start,stop,match,score>>; text must not be null."""
    safe = F.translate(text, "\u0001", "\u0002")
    return {kind: _found(text, safe, kind, min_score) for kind in kinds}


def _ranked(spans: Column, kind: str) -> Column:
    def with_kind(s):
        return F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["stop"].alias("stop"),
            F.lit(kind).alias("kind"), s["match"].alias("match"), s["score"].alias("score"),
        )

    return F.transform(spans, with_kind)


def _merged(found: dict[str, Column]) -> Column:
    """One array<struct<start,rank,stop,kind,match,score>> of the kinds' arrays, by start, then kind."""
    return F.array_sort(F.concat(*(_ranked(found[k], k) for k in KINDS)))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: int = LEAST_SCORE) -> DataFrame:
    """id and ``spans``: array<struct<start,rank,stop,kind,match,score>> by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(id_col, *(c.alias(f"_{k}") for k, c in find_spans(text, min_score=min_score).items()))
    return found.select(id_col, _merged({k: F.col(f"_{k}") for k in KINDS}).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """The input with every span replaced by <KIND>; of overlapping spans the first to start names the gap.

    Every column stays, in its place; a null text stays null; count_col, where the input has it, follows the text.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    rows = rows.select("row", text.alias("t"), *(c.alias(k) for k, c in find_spans(text).items()))
    rows = rows.select("row", "t", _merged({k: F.col(k) for k in KINDS}).alias("spans"))

    def clean(spans):
        def parts(at, chunks):  # at: where the spans before each one end, at most
            gap = lambda s, i: F.when(s["start"] >= at[i], F.array(_cut(chunks, at[i], s["start"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).otherwise(F.array().cast("array<string>"))
            last = F.greatest(F.element_at(at, -1), F.element_at(spans, -1)["stop"])
            return F.array_join(F.concat(F.flatten(F.transform(spans, gap)), F.array(_cut(chunks, last, F.char_length(F.col("t"))))), "")

        ends = _running(F.transform(spans, lambda s: s["stop"]), lambda a, x: F.greatest(a, x))
        return _bound(ends, lambda at: _bound(_chunks(F.col("t")), lambda chunks: parts(at, chunks)))

    rows = rows.select("row", F.when(F.size("spans") > 0, _bound(F.col("spans"), clean)).otherwise(F.col("row")[text_col]).alias("new"))
    changed = {text_col: F.col("new")}
    if count_col in docs.columns:
        kind = docs.schema[count_col].dataType
        changed[count_col] = F.when(F.col("new").isNotNull(), F.char_length("new").cast(kind)).otherwise(F.col("row")[count_col])
    return rows.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def _digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of personal data in every document."""
    found = detect(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:4]),
        F.sha2(_digest(F.col("spans"), KINDS[:4]), 256).alias("base_sha256"),
        _digest(F.col("spans"), KINDS).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


#: The kinds' patterns without look-behind and possessive loops, for an engine that needs neither.
_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "local": r"\b[0-9]{2,5}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}\b",
    "secret": r"[A-Za-z0-9+/_-]{16,}={0,2}",
}
#: Underlines that these turn into other marks, so that a word's border is that of letters and digits.
_SQL_TEXT = {"iban": "translate(t, '_', '-')", "ssn": "translate(t, '_', ',')", "local": "translate(t, '_', ',')"}
_SQL_GOOD = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR try_cast(p AS HUGEINT) > 255)) = 0",
    "card": """length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN d[length(d) - i]::INT
      WHEN d[length(d) - i]::INT > 4 THEN d[length(d) - i]::INT * 2 - 9 ELSE d[length(d) - i]::INT * 2 END)) % 10 = 0""",
    "phone": "length(d) BETWEEN 9 AND 15",
    "iban": """list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)),
      lambda a, b: (a * (CASE WHEN b > 9 THEN 100 ELSE 10 END) + b) % 97) = 1""",
    "ssn": "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')",
    "local": "length(d) BETWEEN 9 AND 12",
    "secret": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')",
}


def oracle_sql() -> str:
    """The query's rows in SQL: matches and what lies between them, whose lengths add up to positions."""
    parts = []
    for rank, kind in enumerate(KINDS):
        text = _SQL_TEXT.get(kind, "t")
        found = f"SELECT doc_id, t, regexp_extract_all({text}, '{_SQL_PATTERNS[kind]}') AS ms, string_split_regex({text}, '{_SQL_PATTERNS[kind]}') AS gaps FROM docs"
        each = f"SELECT doc_id, t, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM ({found}) WHERE len(ms) > 0"
        placed = f"""SELECT doc_id, t, ms[i] AS m, regexp_replace(ms[i], '[^0-9]', '', 'g') AS d,
          list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start FROM ({each})"""
        before = f"substr(t, (greatest(start - {CONTEXT_CHARS}, 0) + 1)::BIGINT, least(start, {CONTEXT_CHARS})::BIGINT)"
        score = f"CASE WHEN regexp_matches({before}, '{CONTEXT[kind]}') THEN {min(BASE_SCORE[kind] + CONTEXT_GAIN, 100)} ELSE {BASE_SCORE[kind]} END"
        parts.append(
            f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, start::BIGINT AS start, (start + length(m))::BIGINT AS stop, {score} AS score FROM ({placed}) WHERE {_SQL_GOOD[kind]} AND score >= {LEAST_SCORE}"
        )
    spans = " UNION ALL ".join(parts)
    counts = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in KINDS[:4])
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({spans}),
      per_doc AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS[:4])},
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 4) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS every,
        count(*) AS n_spans, string_agg(score::VARCHAR, ',' ORDER BY start, rank) AS scores FROM spans GROUP BY doc_id)
      SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(scores, '') AS scores FROM docs LEFT JOIN per_doc USING (doc_id)"""
