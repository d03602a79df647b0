"""Jaccard join on word shingles by token-combination prefixes.

Documents with one set of shingles are one node. Shingles are ordered from rare to frequent; how frequent one is
at most is read from a count sketch of fixed size over the words of all documents, by its rarest word. If two sets
of which one has n shingles share ceil(t n), then of any n - ceil(t n) + 1 shingles of the one at least one is in
the other. Rare shingles are indexed alone. Frequent ones would make long lists, so they are dealt into buckets
and indexed as pairs within a bucket: a bucket of p shingles shares no pair only once p - 1 of them are missing.
A prefix is therefore extended until its rare shingles plus, over buckets, its frequent ones less one exceed the
shingles that may be missing. Both prefixes follow one order, so two similar sets share an index entry within
the shorter of the two: no link is lost. As the number of buckets follows the size of a set, entries are
kept apart by size class (powers of two); a set whose partners may be in the next class is indexed in both.

Entries are not expanded into pairs. In each, all nodes are first verified against its least and its greatest
node; nodes found linked become one component, and only nodes of an entry that are still in different components
are paired, in blocks of ``BLOCK`` nodes; its least and its greatest node have met all others by then, so these two are left out. Every set also has the parities of its shingles in 2,048 buckets: two sets differ in at least as many
shingles as parities, so a pair with too many different ones, or of sizes too far apart, is never made. Pairs that
are left are verified on the exact sets.

Defined results for odd input: a null or empty text, or one of white space alone, has the empty set and no link;
copies and repeated rows get one component; rows that share an id are one document; a row without id has no
component; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import hashing
from gristmill.llm._shared import discard, pieces, release, table, written
from gristmill.llm.graphs import components, dealt_blocks

#: log2 of the sketch's width (it has two rows of 32-bit counts), and buckets of it that travel together.
SKETCH_BITS, CHUNK = 21, 8192
#: A shingle is frequent if its rarest word has at least this count plus this many times the mean of the sketch.
FREQUENT, FREQUENT_LOAD = 256, 4
#: 64-bit words of parities: unrelated sets of up to some 4,000 shingles have too many different ones for any similarity of 0.8.
PARITY_WORDS = 32
#: Of these, how many turn most pairs down before all are compared.
FIRST_WORDS = 8
#: log2 of the width of the table of nodes under verification, and nodes of an open entry that meet in one task.
NODE_BITS, BLOCK = 23, 1024
#: Pairs of an open entry whose parities a task compares at once.
PAIRS_AT_ONCE = 1 << 16


def bucket_counts(rows: DataFrame, places, width: int, dtype: str = "<u4") -> np.ndarray:
    """How many values fall into each of width buckets; places(batch) yields arrays of bucket numbers.

    Partitions count for themselves; their counts, of fixed size, are summed in two rounds. Counts beyond what
    dtype holds stay at its most, also on the way.
    """
    most = np.iinfo(dtype).max

    def count(batches):
        from pyspark import TaskContext

        release()
        counts, part = np.zeros(width, np.int32), TaskContext.get().partitionId() % 32
        for b in pieces(batches):
            for at in places(b):
                np.add.at(counts, at, 1)
        for lo in range(0, width // CHUNK, 16):
            full = [i for i in range(lo, min(lo + 16, width // CHUNK)) if counts[i * CHUNK : (i + 1) * CHUNK].any()]
            if full:
                data = [np.minimum(counts[i * CHUNK : (i + 1) * CHUNK].astype(np.int64), most).astype(dtype).tobytes() for i in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([part] * len(full), pa.int32()), pa.array(data, pa.binary())], ["chunk", "part", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in t.column("counts"):
            total += np.frombuffer(x.as_buffer(), dtype)
        return t.slice(0, 1).set_column(2, "counts", pa.array([np.minimum(total, most).astype(dtype).tobytes()], pa.binary()))

    schema = "chunk int, part int, counts binary"
    summed = rows.mapInArrow(count, schema).groupBy("chunk", "part").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    out = np.zeros(width, dtype)
    for r in summed.collect():  # width numbers, whatever the input
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], dtype)
    return out


def _rows_of(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A word's places in the two rows of the sketch."""
    return (words >> np.uint64(64 - bits)).astype(np.int64), ((words >> np.uint64(8)) & np.uint64((1 << bits) - 1)).astype(np.int64) + (1 << bits)


def word_sketch(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of all words of all texts (the one column of docs), as two rows one after the other."""

    def places(batch):
        for words, _, _ in hashing.words_of(batch.column(0).to_pylist()):
            yield from _rows_of(words, bits)

    return bucket_counts(docs, places, 2 << bits)


def needed(n: int, num: int, den: int) -> int:
    """Shingles that a set of n may lack in a partner, plus one."""
    return n - -(-num * n // den) + 1


def entries(tokens: np.ndarray, counts: np.ndarray, frequent: float, num: int, den: int) -> np.ndarray:
    """Index entries of a set. tokens: sorted hashes, counts: an upper bound of the frequency of each."""
    n = len(tokens)
    low, need_all = n.bit_length() - 1, needed(n, num, den)
    high = (den * n // num).bit_length() - 1
    if high == low and need_all == 1 and den * n // num == n:
        return tokens[:0]  # no other set is similar enough
    level = np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), 31)
    rare = counts < frequent
    alone = tokens[rare][np.argsort(level[rare], kind="stable")]
    out = []
    for size_class in range(low, high + 1):
        salt = np.uint64((size_class * 2 + 1) * 0xA0761D6478BD642F % (1 << 64))
        need = need_all
        out.append(hashing.mix(alone[:need] ^ salt))
        need -= min(need, len(alone))
        if need:
            m = max(1, (1 << size_class) // 2)
            often = tokens[~rare]
            bucket = (often >> np.uint64(20)) % np.uint64(m)
            order = np.argsort(bucket, kind="stable")
            often, bucket = often[order].tolist(), bucket[order]
            bounds = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(often)]
            left, right = [], []
            for a, b in zip(bounds, bounds[1:], strict=False):
                if not need:
                    break
                b = min(b, a + need + 1)
                for x, y in combinations(often[a:b], 2):
                    left.append(x)
                    right.append(y)
                need -= b - a - 1
            if need > 0:
                raise ValueError("pairs can't cover this similarity; use 0.7 or more")
            x, y = np.array(left, np.uint64), np.array(right, np.uint64)
            out.append(hashing.mix(hashing.mix(x ^ salt) + y * np.uint64(0xE7037ED1A0B428DB)))
    return np.concatenate(out)


def parities(tokens: np.ndarray) -> np.ndarray:
    """Whether each of the buckets has an odd number of the shingles, as 64-bit words."""
    counts = np.bincount((tokens >> np.uint64(11)) % np.uint64(64 * PARITY_WORDS), minlength=64 * PARITY_WORDS)
    return np.packbits((counts & 1).astype(bool)).view("<i8")


def words_of_parity(marks: list[np.ndarray]) -> pa.Array:
    offsets = np.arange(len(marks) + 1, dtype=np.int32) * PARITY_WORDS
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(marks) if marks else np.zeros(0, np.int64)))


def may_link(p, m, q, n, num: int, den: int):
    """Whether sets of m and n shingles with parities p and q can be similar enough.

    Few words come first and stand for themselves; all of them written out would make a method too long for the JVM to compile.
    """
    few = lambda apart: apart * (den + num) <= (m + n) * (den - num)
    first = sum(F.bit_count(p[i].bitwiseXOR(q[i])) for i in range(FIRST_WORDS))
    each = F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return (F.least(m, n) * den >= F.greatest(m, n) * num) & few(first) & few(F.aggregate(each, F.lit(0), lambda x, y: x + y))


def _close(node, component, own, n, parity, within: bool, num: int, den: int):
    """(a, b) of the rows of two blocks (of one, if within) that are of different components and may link; see may_link()."""
    first, step = np.ascontiguousarray(parity[:, :FIRST_WORDS]), max(1, PAIRS_AT_ONCE // len(node))
    for lo in range(0, len(node), step):
        some = np.s_[lo : lo + step, None]
        sized = np.minimum(n[some], n) * den >= np.maximum(n[some], n) * num
        x, y = np.nonzero(sized & (node[some] < node) & (component[some] != component) & (within | (own[some] != own)))
        x += lo
        for words in (first, parity):
            apart = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64)
            few = apart * (den + num) <= (n[x] + n[y]) * (den - num)
            x, y = x[few], y[few]
        if len(x):
            yield node[x], node[y]


def close_pairs(rows: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(a, b) of the nodes of an entry that are of different components and may link; rows: entry, node, component, n, parity, m (of the entry).

    A task holds two blocks of an entry at a time, and compares their parities in numpy.
    """
    names = ("entry", "_i", "_j", "node", "component", "_own", "n")

    def groups(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            parity = b.column(len(names)).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, PARITY_WORDS)
            columns = [*(b.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))), parity]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            entry, i, j = columns[:3]
            cuts = np.flatnonzero((entry[1:] != entry[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for lo, hi in zip([0, *cuts[:-1].tolist()] if len(cuts) else [], cuts.tolist(), strict=True):
                yield [c[lo:hi] for c in columns]
            held = [c[cuts[-1] if len(cuts) else 0 :].copy() for c in columns]
        if held is not None:
            yield held

    def run(batches):
        release()
        for _, i, j, node, component, own, n, parity in groups(batches):
            for a, b in _close(node, component, own, n, parity, bool(i[0] == j[0]), num, den):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = dealt_blocks(rows, "entry", "m", block).sortWithinPartitions("entry", "_i", "_j")
    return dealt.select(*names, "parity").mapInArrow(run, "a long, b long")


def _sets(texts: list[str | None], k: int):
    """For each text: sorted distinct shingles, and for each of these the place of its first shingle's words."""
    for words, bounds, n in hashing.words_of(texts):
        for i in range(n):
            own = words[bounds[i] : bounds[i + 1]]
            yield own, *np.unique(hashing.shingles(own, k), return_index=True)


def index(docs: DataFrame, k: int, num: int, den: int, bits: int = SKETCH_BITS) -> DataFrame:
    """docs (doc_id long, text): doc_id, n, key (of the set; null if empty), parity, entries."""
    import xxhash

    spark = docs.sparkSession
    sketch = word_sketch(docs.select("text"), bits)
    frequent = FREQUENT + FREQUENT_LOAD * float(sketch.sum(dtype=np.float64)) / len(sketch)
    shared = spark.sparkContext.broadcast(sketch)  # of fixed size

    def run(batches):
        release()
        counts = shared.value
        for b in pieces(batches):
            ns, keys, marks, found = [], [], [], []
            for words, tokens, at in _sets(b.column(1).to_pylist(), k):
                ns.append(len(tokens))
                marks.append(parities(tokens))
                keys.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                if len(tokens):
                    one, two = _rows_of(words, bits)
                    by_word = np.minimum(counts[one], counts[two])
                    least = by_word
                    if len(words) >= k:
                        least = by_word[: len(words) - k + 1]
                        for j in range(1, k):
                            least = np.minimum(least, by_word[j : len(words) - k + 1 + j])
                        least = least[at]
                    else:
                        least = least.min(keepdims=True)
                    found.append(entries(tokens, least, frequent, num, den).astype(np.int64))
                else:
                    found.append(np.zeros(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), words_of_parity(marks), lists],
                ["doc_id", "n", "key", "parity", "entries"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, parity array<long>, entries array<long>")


def _node_places(batch):
    ids = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
    yield (hashing.mix(ids) >> np.uint64(64 - NODE_BITS)).astype(np.int64)


def verify(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of document ids whose sets are similar enough, as a written table."""
    spark = pairs.sparkSession
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = spark.sparkContext.broadcast(np.packbits(bucket_counts(nodes, _node_places, 1 << NODE_BITS, "<u1") > 0))  # of fixed size

    def sets(batches):
        release()
        bitmap = np.unpackbits(wanted.value).view(bool)
        for b in pieces(batches):
            b = b.filter(b.column(0).is_valid())
            if b.num_rows:
                b = b.filter(pa.array(bitmap[next(_node_places(b))]))
            found = [tokens.tobytes() for _, tokens, _ in _sets(b.column(1).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["node", "tokens"])

    def similar(batches):
        release()
        for b in pieces(batches):
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # merges the two runs
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(common > 0 and den * common >= num * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = docs.select("doc_id", "text").mapInArrow(sets, "node long, tokens binary").join(nodes, "node", "left_semi")
    own = written(own, "sets")
    joined = pairs.join(own.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    joined = joined.join(own.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").select("a", "b", "x", "y")
    out = written(joined.mapInArrow(similar, "a long, b long").distinct(), "similar")
    discard(own)
    return out


def similarity_classes(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id: the least id that links of similarity num/den or more lead to."""
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = written(index(base, k, num, den), "entries")
    by_set = rows.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("key")
    nodes = written(by_set.agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("parity").alias("parity")), "nodes")
    listed = by_set.agg(F.min("doc_id").alias("node"), F.first("entries").alias("entries")).select("node", F.explode("entries").alias("entry"))
    ends = listed.groupBy("entry").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    shared = written(listed.join(ends, "entry"), "shared")

    # A node may stand for several sets, of which any may link.
    star = lambda end: shared.filter(F.col("node") != F.col(end)).select(F.least("node", end).alias("a"), F.greatest("node", end).alias("b"))
    side = lambda name, n, p: nodes.select(F.col("node").alias(name), F.col("n").alias(n), F.col("parity").alias(p))
    stars = star("lo").union(star("hi")).distinct().join(side("a", "m", "p"), "a")
    other = side("b2", "n", "q")
    stars = stars.join(other, (F.col("b") == F.col("b2")) & may_link(F.col("p"), F.col("m"), F.col("q"), F.col("n"), num, den))
    stars = written(stars.select("a", "b").distinct(), "pairs")
    by_row = rows.select("doc_id", "key").join(nodes.select("key", "node"), "key")
    same = by_row.join(by_row.groupBy("doc_id").agg(F.min("node").alias("least")), "doc_id").filter("node <> least")
    links = verify(stars, base, k, num, den).union(same.select(F.col("least").alias("a"), F.col("node").alias("b")))
    links = written(links, "links")
    found = components(links)

    classed = shared.select("entry", "node", ((F.col("node") == F.col("lo")) | (F.col("node") == F.col("hi"))).alias("met")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classed = classed.filter("NOT met").drop("met")
    open_entries = classed.groupBy("entry").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("m"))
    classed = classed.join(open_entries.filter("c0 <> c1"), "entry").join(nodes.select("node", "n", "parity"), "node")
    classed = written(classed.select("entry", "node", "component", "n", "parity", "m"), "open")
    rest = close_pairs(classed, num, den, BLOCK).distinct().join(stars, ["a", "b"], "left_anti")
    rest = written(rest, "pairs")
    discard(shared)
    discard(classed)
    if not rest.isEmpty():
        links = links.union(verify(rest, base, k, num, den))
        found = components(links)

    by_key = nodes.select("key", "node").join(found, "node", "left").select("key", F.coalesce("component", "node").alias("by_key"))
    out = rows.select("doc_id", "n", "key").join(by_key, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("by_key", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class: the one with the least id; documents without words or id all stay."""
    classes = similarity_classes(docs, k, num, den, id_col, text_col)
    gone = classes.filter((F.col("component_id") != F.col("doc_id")) & (F.col("n_shingles") > 0)).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of 0.9 or more on three-word shingles."""
    return similarity_classes(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


#: The query's rows by comparing all pairs that share a shingle; for small tables.
OP2_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
  x AS (SELECT doc_id, len(s) AS n, md5(unnest(s)) AS t FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
  e AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)),
  ends AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT doc_id, b FROM reach JOIN ends ON r = a),
  c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
  SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN c USING (doc_id)"""
