"""Token-budget packing of an ordered stream of samples, as a batch operator and as its state machine.

A sequence is emitted once it holds the expected number of tokens. A sample that would overflow the maximum waits
in a bounded buffer; if it came from the buffer, or the buffer is full, the sequence is emitted as it is and that
sample is lost (compatible) or opens the next sequence. While a sequence is short of a bound, waiting samples are
taken first, in order of arrival. Mandatory groups give one sample at the start of every sequence.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class Packer:
    expected: int
    most: int
    most_per_sample: int
    buffer_size: int = 50
    prefer_buffer_before: int = 0
    drop_overflow: bool = True
    curr: int = 0
    members: list = field(default_factory=list)
    waiting: deque = field(default_factory=deque)
    #: For each mandatory group its samples, which come round and round.
    mandatory: list[list] = field(default_factory=list)
    turns: list[int] = field(default_factory=list)

    def _open(self) -> None:
        """One sample of each mandatory group; those that are too long are passed over."""
        self.turns = self.turns or [0] * len(self.mandatory)
        for g, samples in enumerate(self.mandatory):
            for _ in samples:
                taken = self.add_mandatory(*samples[self.turns[g] % len(samples)])
                self.turns[g] += 1
                if taken:
                    break

    def _emit(self) -> list:
        out, self.members, self.curr = self.members, [], 0
        return out

    def _offer(self, key, tokens: int, waited: bool) -> Iterator[list]:
        if self.mandatory and not self.members:
            self._open()
        if tokens > self.most_per_sample:
            return
        if self.curr + tokens > self.most:
            if len(self.waiting) < self.buffer_size and not waited:
                self.waiting.append((key, tokens))
                return
            yield self._emit()
            if self.drop_overflow or tokens > self.most:
                return
        self.members.append((key, tokens))
        self.curr += tokens
        if self.curr >= self.expected:
            yield self._emit()

    def add(self, key, tokens: int) -> Iterator[list]:
        """Take a new sample; yields the sequences that are done, each a list of (key, tokens)."""
        while self.waiting and self.curr < self.prefer_buffer_before:
            yield from self._offer(*self.waiting.popleft(), True)
        yield from self._offer(key, tokens, False)

    def add_mandatory(self, key, tokens: int) -> bool:
        """A sample of a mandatory group; here the bound itself is too long."""
        if tokens >= self.most_per_sample:
            return False
        self.members.append((key, tokens))
        self.curr += tokens
        return True

    def finish(self) -> Iterator[list]:
        """The stream is over: waiting samples are packed, the last sequence is emitted short."""
        while self.waiting:
            size = len(self.waiting)
            self.buffer_size = 0
            yield from self._offer(*self.waiting.popleft(), True)
            if len(self.waiting) == size:
                break
        if self.members:
            yield self._emit()


def pack_stream(samples: Iterable[tuple], packer: Packer) -> Iterator[list]:
    for key, tokens in samples:
        yield from packer.add(key, tokens)
    yield from packer.finish()


def pack(rows: DataFrame, shard: str, order: str, key: str, tokens: str, mandatory: str | None = None, **limits) -> DataFrame:
    """shard, sequence, position, key, tokens: every shard is packed on its own, in its order.

    A shard is what one reader would read; it must fit a task's memory as (key, tokens) pairs. mandatory: a column that
    names the mandatory group of a row; null for the others.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"`{shard}` {kinds[shard]}, sequence long, position long, `{key}` {kinds[key]}, tokens long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out, groups, free = [], [], pdf
        if mandatory:
            free = pdf[pdf[mandatory].isna()]
            groups = [list(zip(g[key], g[tokens], strict=True)) for _, g in pdf[pdf[mandatory].notna()].groupby(mandatory)]
        for i, members in enumerate(pack_stream(zip(free[key], free[tokens], strict=True), Packer(**limits, mandatory=groups))):
            out += [(pdf[shard].iloc[0], i, j, k, n) for j, (k, n) in enumerate(members)]
        return pd.DataFrame(out, columns=[shard, "sequence", "position", key, "tokens"])

    return rows.select(*dict.fromkeys((shard, order, key, tokens, *([mandatory] if mandatory else [])))).groupBy(shard).applyInPandas(run, schema)
