"""Byte-level BPE from a rank file: encoding in linear time by longest matches and backtracking, and decoding.

Bytes are read as Latin-1 characters, so an Aho-Corasick automaton over strings finds every token that ends at
every byte. Encoding takes the longest token at a place and keeps it if it may stand after the one before it:
whether two tokens may be neighbours in a BPE result depends on the two alone and is memoised. If none fits,
the last token gives way to its next shorter prefix; a place that failed is never tried again. The result is
the one that merging by rank gives.

Defined results for odd input: a null or empty text has no ids; equal texts have equal ids; repeated rows stay
repeated; very long texts, and very long matches in them, are encoded whole in linear time; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gristmill.llm._shared import kept, pieces, table
from gristmill.llm.chunking import BYTE_CHUNK, OTHER_SPACE, ChunkEncoder

VOCABULARY = "byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBPE:
    """ranks: token bytes -> id, where a lower id merges first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.token = {i: t for t, i in ranks.items()}
        self.ids = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.length = {i: len(t) for i, t in self.token.items()}
        # White space is Unicode's property, as in the library this agrees with.
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.machine = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.machine.add_word(text, i)
        self.machine.make_automaton()
        self.shorter: dict[int, int] = {}  # the longest proper prefix that is a token
        for text, i in self.ids.items():
            for n in range(len(text) - 1, 0, -1):
                if (p := self.ids.get(text[:n])) is not None:
                    self.shorter[i] = p
                    break
        self.memo: dict[tuple[int, int], bool] = {}
        self.joined: dict[tuple[int, int], int] = {}  # the token that two tokens merge into
        self.halves: dict[int, tuple[int, int]] = {}  # the merge that makes a token; a byte is its own halves
        for i in sorted(self.token):
            text = self.token[i].decode("latin-1")
            self.halves[i] = (i, i)
            left = self.shorter.get(i)
            while left is not None:
                right = self.ids.get(text[self.length[left] :])
                if right is not None and left < i and right < i and self._fits(left, right):
                    self.halves[i] = (left, right)
                    self.joined[left, right] = i
                    break
                left = self.shorter.get(left)
        self.memo.clear()

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging by rank can end with these neighbours.

        Undo the merges on both sides of the seam, the latest first. If at some time the tokens at the seam
        could have merged before the merge just undone, they would have.
        """
        limit = 1 << 62
        while True:
            over = self.joined.get((left, right))
            if over is not None and over < limit:
                return False
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left":
                    inner = self.halves[left][1]
                    if inner != left:
                        limit, left = left, inner
                        break
                else:
                    inner = self.halves[right][0]
                    if inner != right:
                        limit, right = right + 1, inner
                        break
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) > 1_000_000:
                self.memo.clear()
            known = self.memo[key] = self._fits(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        text = piece.decode("latin-1")
        whole = self.ids.get(text)
        if whole is not None:
            return [whole]
        n, length, shorter = len(text), self.length, self.shorter
        longest = [0] * n
        for end, i in self.machine.iter(text):  # of matches with one start, the last to end is the longest
            longest[end - length[i] + 1] = i
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else None
            t: int | None = token
            while t is not None and not (open_at[at + length[t]] and (last is None or self.fits(last, t))):
                t = shorter.get(t)
            if t is None:
                open_at[at] = 0
                token = out.pop()
                at -= length[token]
            else:
                out.append(t)
                at += length[t]
                if at < n:
                    token = longest[at]
        return out

    def encode_chunk(self, text: str) -> bytes:
        ids = [i for piece in self.pieces(text) for i in self.encode_piece(piece.encode())]
        return np.array(ids, "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def loaded(path: str, pattern: str) -> tuple[ByteBPE, ChunkEncoder]:
    """One per worker process, as long as its tasks encode or decode."""

    def load():
        bpe = ByteBPE(read_ranks(path), pattern)
        many = lambda chunks: [bpe.encode_chunk(c) for c in chunks]
        return bpe, ChunkEncoder(many, BYTE_CHUNK, OTHER_SPACE)

    return kept((path, pattern), load)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``ids`` (binary: little-endian unsigned 32-bit)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        _, chunks = loaded(path, pattern)
        for b in pieces(batches):
            ids = list(chunks.texts(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    out = docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"id {kind}, ids binary")
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ``bytes`` that the ids stand for."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe, _ = loaded(path, pattern)
        for b in pieces(batches):
            raw = [bpe.decode(i or b"") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["id", "bytes"])

    out = tokens.select(tokens[id_col], tokens[ids_col]).mapInArrow(run, f"id {kind}, bytes binary")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded in one pass, so neither leaves the worker."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe, chunks = loaded(path, pattern)
        for b in pieces(batches):
            n, of_ids, of_bytes = [], [], []
            for ids in chunks.texts(b.column(1).to_pylist()):
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = docs.select(docs[id_col], docs[text_col]).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return out.withColumnRenamed("id", id_col)


def op5_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document encoded and decoded."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
