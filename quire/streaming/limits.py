"""Rate limits and caches with a time to live, over event tables and streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Microseconds that a request waits beyond the end of the window that keeps it out.
MARGIN = 50_000


def would_wait(events: DataFrame, key: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """Events with ``in_window`` (events of the key in the ``seconds`` up to and with it) and ``waits``.

    A limit below one is refused. The window is over the key, ordered by whole microseconds.
    """
    _at_least_one(limit)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    window = Window.partitionBy(key).orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    counted = events.withColumn("_at", at).withColumn("in_window", F.count("*").over(window)).drop("_at")
    return counted.withColumn("waits", F.col("in_window") > limit)


def _at_least_one(limit: int) -> None:
    if limit < 1:
        raise ValueError("a limit must admit at least one event")


def _in_order(events: DataFrame, keys: list[str], ts: str, extra: list[str]) -> DataFrame:
    """Rows (keys, extra, _at) so that each key's stand together in order of time; a key's rows pass a task one after another, and none is held."""
    rows = events.select(*keys, *extra, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "_at", *extra)


class Admissions:
    """Admissions of one key: a request waits while ``limit`` of them lie in the ``span`` before it."""

    def __init__(self, limit: int, span: int, past: list[int] = ()) -> None:
        self.limit, self.span, self.past = limit, span, deque(past, maxlen=limit)

    def admit(self, at: int) -> int:
        at = max(at, self.past[-1]) if self.past else at
        if len(self.past) == self.limit and at - self.past[0] <= self.span:
            at = self.past[0] + self.span + MARGIN
        self.past.append(at)
        return at


def schedule(events: DataFrame, key: str, ts: str, id_col: str, limit: int, seconds: int) -> DataFrame:
    """(key, id, waited): the microseconds that each request of a key waits, one after another.

    The state of a key is its last ``limit`` admissions, so that a key of any size passes through.
    """
    _at_least_one(limit)
    rows = _in_order(events, [key], ts, [id_col])
    kinds = [rows.schema[c].dataType.simpleString() for c in (key, id_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, window = object(), Admissions(limit, seconds * 1_000_000)
        for batch in batches:
            waited = []
            for k, at in zip(batch.column(key).to_pylist(), batch.column("_at").to_pylist(), strict=True):
                if k != now:
                    now, window = k, Admissions(limit, seconds * 1_000_000)
                waited.append(None if at is None else window.admit(at) - at)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(id_col), pa.array(waited, pa.int64())], [key, id_col, "waited"])

    return rows.mapInArrow(run, f"{key} {kinds[0]}, {id_col} {kinds[1]}, waited long")


def cache_hits(events: DataFrame, keys: list[str], ts: str, ttl_seconds: int = 86_400) -> DataFrame:
    """(keys, hits, misses) of a cache per key whose entries live ``ttl_seconds`` after they were written.

    Hits do not refresh an entry. The state of a key is when it was written.
    """
    rows, ttl = _in_order(events, keys, ts, []), ttl_seconds * 1_000_000
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "hits", "misses"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, written, hits, misses, schema = None, None, 0, 0, None
        for batch in batches:
            schema, done = batch.schema, []
            for *k, at in zip(*(batch.column(c).to_pylist() for c in [*keys, "_at"]), strict=True):
                if k != now:
                    if now is not None:
                        done.append([*now, hits, misses])
                    now, written, hits, misses = k, None, 0, 0
                if written is not None and at - written <= ttl:
                    hits += 1
                else:
                    written, misses = at, misses + 1
            if done:
                yield _rows(done, names, schema)
        if now is not None:
            yield _rows([[*now, hits, misses]], names, schema)

    return rows.mapInArrow(run, f"{kinds}, hits int, misses int")


def _rows(rows: list[list], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    kinds = [schema.field(n).type if n in schema.names else pa.int32() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def schedule_stream(events: DataFrame, key: str, ts: str, id_col: str, limit: int, seconds: int) -> DataFrame:
    """``schedule`` over a stream: (key, id, waited) of the requests of each batch, admissions kept as state."""
    _at_least_one(limit)
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))

    def step(keys, batches, state):
        window = Admissions(limit, seconds * 1_000_000, list(state.get[0]) if state.exists else [])
        for some in batches:
            some = some.sort_values(["at", "id"])
            yield pd.DataFrame({"key": some["key"], "id": some["id"], "waited": [window.admit(int(at)) - int(at) for at in some["at"]]})
        state.update((list(window.past),))

    return rows.groupBy("key").applyInPandasWithState(step, "key string, id long, waited long", "past array<long>", "append", "NoTimeout")
