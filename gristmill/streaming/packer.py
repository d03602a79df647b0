"""The token-budget packer on a stream: its state is tables by shard, survives a restart and can be read.

For each shard the state store holds the open sequence and the waiting samples as lists, the samples of mandatory groups with whose turn
it is, and its place: the next sequence's number, the rows taken and the last key. A shard that gets no rows for a while is
finished by a timer: what waits is packed, and the last sequence is emitted short. A stream that has ended is finished by
``leftover``, which reads the state of its checkpoint.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gristmill.operators.packing import Packer

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Packing(StatefulProcessor):
    """The packer of one shard at a time; rows of a micro-batch are taken in order of key."""

    def __init__(self, shard: str, key: str, tokens: str, mandatory: str | None, key_kind: str, idle_ms: int, limits: dict):
        self.shard, self.key, self.tokens, self.mandatory = shard, key, tokens, mandatory
        self.key_kind, self.idle_ms, self.limits = key_kind, idle_ms, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        pair = f"key {self.key_kind}, tokens long"
        self.handle = handle
        self.place = handle.getValueState("place", f"sequence long, rows long, last {self.key_kind}")
        self.members, self.waiting = handle.getListState("members", pair), handle.getListState("waiting", pair)
        self.groups = handle.getListState("groups", f"name string, {pair}")
        self.turns = handle.getMapState("turns", "name string", "turn long")

    def _packer(self) -> tuple[Packer, list[str]]:
        groups: dict[str, list] = {}
        for name, key, tokens in self.groups.get():
            groups.setdefault(name, []).append((key, tokens))
        names, members = sorted(groups), [tuple(m) for m in self.members.get()]
        turns = [self.turns.getValue((n,))[0] if self.turns.containsKey((n,)) else 0 for n in names]
        waiting = deque(tuple(w) for w in self.waiting.get())
        return Packer(**self.limits, curr=sum(t for _, t in members), members=members, waiting=waiting, mandatory=[groups[n] for n in names], turns=turns), names

    def _keep(self, packer: Packer, names: list[str]) -> None:
        for state, rows in ((self.members, packer.members), (self.waiting, list(packer.waiting))):
            state.put(rows) if rows else state.clear()
        for name, turn in zip(names, packer.turns, strict=False):
            self.turns.updateValue((name,), (turn,))

    def _rows(self, shard, sequences, sequence: int) -> tuple[pd.DataFrame, int]:
        out = []
        for members in sequences:
            out += [(shard, sequence, j, k, t) for j, (k, t) in enumerate(members)]
            sequence += 1
        return pd.DataFrame(out, columns=[self.shard, "sequence", "position", self.key, "tokens"]), sequence

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(self.key)
        if self.mandatory:
            named = new[new[self.mandatory].notna()]
            if len(named):
                self.groups.appendList(list(zip(named[self.mandatory].tolist(), named[self.key].tolist(), named[self.tokens].tolist(), strict=True)))
            new = new[new[self.mandatory].isna()]
        sequence, seen, last = self.place.get() if self.place.exists() else (0, 0, None)
        packer, names = self._packer()
        pairs = list(zip(new[self.key].tolist(), new[self.tokens].tolist(), strict=True))
        out, sequence = self._rows(key[0], (s for k, n in pairs for s in packer.add(k, n)), sequence)
        self._keep(packer, names)
        self.place.update((sequence, seen + len(pairs), pairs[-1][0] if pairs else last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sequence, seen, last = self.place.get() if self.place.exists() else (0, 0, None)
        packer, names = self._packer()
        out, sequence = self._rows(key[0], packer.finish(), sequence)
        packer.members, packer.waiting = [], deque()
        self._keep(packer, names)
        self.place.update((sequence, seen, last))
        yield out

    def close(self) -> None:
        pass


def _schema(samples: DataFrame, shard: str, key: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    return f"`{shard}` {kinds[shard]}, sequence long, position long, `{key}` {kinds[key]}, tokens long"


def pack_stream(samples: DataFrame, shard: str, key: str, tokens: str, mandatory: str | None = None, idle_ms: int = 60_000, **limits) -> DataFrame:
    """shard, sequence, position, key, tokens of sequences as they are done.

    A micro-batch is taken in order of key, its samples of mandatory groups (named by the column ``mandatory``) before the others. A
    shard without rows for idle_ms is finished. The session's state store is set to RocksDB, which these states need.
    """
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    rows = samples.select(shard, key, F.col(tokens).cast("long").alias(tokens), *([mandatory] if mandatory else []))
    processor = _Packing(shard, key, tokens, mandatory, kinds[key], idle_ms, limits)
    return rows.groupBy(shard).transformWithStateInPandas(processor, _schema(samples, shard, key), "Append", "ProcessingTime")


def run_available(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Process what is there, to Parquet, once each, and stop.

    A query with timers would go on with batches without rows for ever, so these are off for this query.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, before)
    q.awaitTermination()


def _state(spark: SparkSession, checkpoint: str, name: str, **options) -> DataFrame:
    reader = spark.read.format("statestore").option("stateVarName", name)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(checkpoint)


def places(spark: SparkSession, checkpoint: str, shard: str) -> DataFrame:
    """shard, sequence, rows, last: every shard's next sequence, rows taken and last key, from the state of a checkpoint."""
    return _state(spark, checkpoint, "place").select(F.col(f"key.{shard}").alias(shard), "value.sequence", "value.rows", "value.last")


def leftover(spark: SparkSession, checkpoint: str, shard: str, key: str, **limits) -> DataFrame:
    """The sequences that finish a stream that has ended, from the state of its checkpoint; as pack_stream's rows."""
    lists = {n: _state(spark, checkpoint, n, flattenCollectionTypes="false").select(F.col(f"key.{shard}").alias(shard), F.col("list_value").alias(n)) for n in ("members", "waiting")}
    at = places(spark, checkpoint, shard).select(shard, "sequence", "last")
    rows = at.join(lists["members"], shard, "left").join(lists["waiting"], shard, "left").filter("members IS NOT NULL OR waiting IS NOT NULL")
    kinds = {f.name: f.dataType.simpleString() for f in at.schema}
    columns = [shard, "sequence", "position", key, "tokens"]

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = lambda xs: [] if xs is None else [(x["key"], x["tokens"]) for x in xs]
        for pdf in batches:
            out = []
            for own, sequence, members, waiting in zip(pdf[shard].tolist(), pdf["sequence"].tolist(), pdf["members"], pdf["waiting"], strict=True):
                open_ = pairs(members)
                packer = Packer(**limits, curr=sum(t for _, t in open_), members=open_, waiting=deque(pairs(waiting)))
                for i, done in enumerate(packer.finish()):
                    out += [(own, sequence + i, j, k, t) for j, (k, t) in enumerate(done)]
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(finish, f"`{shard}` {kinds[shard]}, sequence long, position long, `{key}` {kinds['last']}, tokens long")
