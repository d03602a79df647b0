"""Whole texts to token ids through a cache of chunks.

A chunk starts where white space follows other text. No match of the pre-tokenising patterns spans such a
place, so encoding chunk by chunk equals encoding the whole text, and a chunk that was seen costs one lookup.
Only space, tab, newline and return count here. For byte-level vocabularies, whose matches may join several
white-space characters, a text that holds any other white space is encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

from gristmill.llm._shared import kept

BYTE_CHUNK = re.compile("[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
WORD_CHUNK = re.compile("[^ \t\n\r]+")
_SPACES = [0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER_SPACE = re.compile("[" + "".join(map(chr, _SPACES)) + "]")

#: Chunks that a worker keeps, and the longest one worth keeping; a full cache starts anew.
MOST_CHUNKS, LONGEST_KEPT = 1_000_000, 48
#: Characters of text whose chunks are looked up together.
GROUP_CHARS = 1 << 20
#: Chunks that are encoded as one text.
JOINED = 512


class ChunkEncoder:
    """encode(list of chunks) -> list of ids as little-endian unsigned 32-bit bytes; texts() applies it to texts."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], pattern: re.Pattern, whole_if: re.Pattern | None = None):
        self.encode, self.find, self.whole_if, self.kept = encode, pattern.findall, whole_if, {}

    def _group(self, texts: list[str]) -> list[bytes]:
        split = [[t] if self.whole_if and self.whole_if.search(t) else self.find(t) for t in texts]
        kept = self.kept
        new = list(set().union(*split).difference(kept)) if kept else list(set().union(*split))
        own = {}
        for i in range(0, len(new), 8192):
            part = new[i : i + 8192]
            for chunk, ids in zip(part, self.encode(part), strict=True):
                (kept if len(chunk) <= LONGEST_KEPT else own)[chunk] = ids
        if own:
            out = [b"".join([own[c] if c in own else kept[c] for c in chunks]) for chunks in split]
        else:
            get = kept.__getitem__
            out = [b"".join(map(get, chunks)) for chunks in split]
        if len(kept) > MOST_CHUNKS:
            kept.clear()
        return out

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, in order; a null text is empty."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)


class _Joined:
    """Encodes chunks many at a time, as one text, and cuts the ids at the chunks' ends by the bytes that ids stand for.

    Only chunks whose ids stand for just their own bytes are joined; all others are encoded by themselves (see
    ``alone``). If the ends of all chunks of a text don't fall on ends of ids, it is halved, down to single chunks.
    """

    def __init__(self, tokenizer, byte_level: bool):
        import numpy as np

        self.np, self.t, self.byte_level = np, tokenizer, byte_level
        self.sep = "" if byte_level else " "
        self.size = np.zeros(tokenizer.get_vocab_size(), np.int64)
        special = tokenizer.get_added_tokens_decoder()
        for token, i in tokenizer.get_vocab().items():
            plain = token if byte_level or i in special else token.removesuffix("</w>")
            self.size[i] = len(plain.encode()) if i in special else len(plain)

    def alone(self, chunk: str) -> bool:
        """Whether a chunk is encoded by itself.

        Byte-level: one that doesn't begin with white space would join the one before it; nor may it end with any.
        Words: a normaliser may change the length of what isn't printable ASCII, so that ends can't be told by sums.
        """
        if self.byte_level:
            return chunk[0] not in " \t\n\r" or chunk[-1] in " \t\n\r" or bool(OTHER_SPACE.search(chunk))
        return not (chunk.isascii() and chunk.isprintable())

    def _each(self, chunks: list[str]) -> list[bytes]:
        found = self.t.encode_batch_fast(chunks, add_special_tokens=False)
        return [self.np.array(e.ids, "<u4").tobytes() for e in found]

    def _run(self, chunks: list[str]) -> list[bytes]:
        if len(chunks) <= 4:
            return self._each(chunks)
        np = self.np
        ids = np.array(self.t.encode_batch_fast([self.sep.join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        have = np.cumsum(self.size[ids])
        ends = np.cumsum(np.fromiter((len(c) if c.isascii() else len(c.encode()) for c in chunks), np.int64, len(chunks)))
        at = np.searchsorted(have, ends)
        if not len(have) or have[-1] != ends[-1] or not (have[at] == ends).all():
            half = len(chunks) // 2
            return self._run(chunks[:half]) + self._run(chunks[half:])
        raw, cut = ids.tobytes(), ((at + 1) * 4).tolist()
        return [raw[x:y] for x, y in zip([0, *cut], cut, strict=False)]

    def __call__(self, chunks: list[str]) -> list[bytes]:
        out: dict[int, bytes] = {}
        single = [i for i, c in enumerate(chunks) if self.alone(c)]
        out.update(zip(single, self._each([chunks[i] for i in single]), strict=True))
        rest = [i for i in range(len(chunks)) if i not in out] if out else list(range(len(chunks)))
        for lo in range(0, len(rest), JOINED):
            part = rest[lo : lo + JOINED]
            out.update(zip(part, self._run([chunks[i] for i in part]), strict=True))
        return [out[i] for i in range(len(chunks))]


def tokenizer_encoder(path: str, byte_level: bool) -> ChunkEncoder:
    """Of a tokenizers file; one per worker process, as long as its tasks encode."""

    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encode = _Joined(Tokenizer.from_file(path), byte_level)
        return ChunkEncoder(encode, BYTE_CHUNK, OTHER_SPACE) if byte_level else ChunkEncoder(encode, WORD_CHUNK)

    return kept((path, byte_level), load)
