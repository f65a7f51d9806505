"""What came before each event of an entity, kept as state of a stream: last values, first meetings, running totals.

Events may come in any order within the watermark's delay. A late-bound event waits in the state
until the watermark has passed it, so that all events before it are known; then it is given out with
what came before it, and the history moves on. Entities are dealt to shards by a hash, and a shard's
events and histories are packed as Arrow tables: what a call to the state, a timer or a frame costs
comes once for each shard and batch, not for each entity or event. A timer for the earliest waiting
event wakes the shard. State of an entity is bounded: events within the delay, the last values, and
one number for each opponent or kind it has met.

The rows are those that windows over the whole table give (see ``batch``), for all events that the
watermark has passed; a stopped stream goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from orderloom.operators.lineage import ship

OUT = "id long, entity long, kind string, ts timestamp, value double, n_before long, prev_sum double, prev_n long, mean_before double, met_before long, gain double"
COLUMNS = [c.strip().split(" ")[0] for c in OUT.split(",")]
#: Micro-seconds since 1970, identity, entity, kind, value.
_WAITING = pa.schema([("us", pa.int64()), ("id", pa.int64()), ("entity", pa.int64()), ("kind", pa.string()), ("value", pa.float64())])
_MET = pa.schema([("entity", pa.int64()), ("kind", pa.string()), ("met", pa.int64()), ("first", pa.float64())])
#: Rows of a packed piece of what waits, and of a frame given out.
PIECE = 10_000


def _past(last: int) -> pa.Schema:
    """Of an entity: how many events, their total, the last values, oldest first, behind zeros."""
    return pa.schema([("entity", pa.int64()), ("n", pa.int64()), ("total", pa.float64()), *((f"v{i}", pa.float64()) for i in range(last))])


def _pack(df: pd.DataFrame, schema: pa.Schema) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as w:
        w.write_table(pa.Table.from_pandas(df, schema, preserve_index=False))
    return out.getvalue().to_pybytes()


def _unpack(pieces: Iterable[bytes], schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(p).read_all() for p in pieces]
    return (pa.concat_tables(tables) if tables else schema.empty_table()).to_pandas()


def advance(due: pd.DataFrame, past: pd.DataFrame, met: pd.DataFrame, last: int) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """(what came before each event that is due, histories and meetings after them)."""
    due = due.sort_values(["entity", "us", "id"], kind="stable", ignore_index=True)
    entity, start, at, size = np.unique(due["entity"].to_numpy(), return_index=True, return_inverse=True, return_counts=True)
    rows, own = np.arange(len(due)), past.set_index("entity").reindex(entity).fillna(0)
    value = due["value"].to_numpy(float)
    x = np.where(np.isnan(value), 0.0, value)
    n = own["n"].to_numpy(np.int64)
    n_before = n[at] + rows - start[at]
    total, before = own["total"].to_numpy(float).copy(), np.empty(len(due))
    for e, (lo, m) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
        sums = np.cumsum(np.concatenate([total[e : e + 1], x[lo : lo + m]]))  # one by one, in the order of time
        before[lo : lo + m], total[e] = sums[:-1], sums[-1]
    # each entity's last values lie before its events
    laid, to, heads = np.empty(len(due) + len(entity) * last), rows + (at + 1) * last, start + np.arange(len(entity)) * last
    laid[to] = x
    laid[heads[:, None] + np.arange(last)] = own[[f"v{i}" for i in range(last)]].to_numpy(float)
    prev = np.zeros(len(due))
    for k in range(last, 0, -1):
        prev += laid[to - k]
    lately = laid[(heads + size)[:, None] + np.arange(last)]

    code, kinds = pd.factorize(due["kind"], use_na_sentinel=False)
    group = at * len(kinds) + code
    order = np.argsort(group, kind="stable")
    g, lo, pair, many = np.unique(group[order], return_index=True, return_inverse=True, return_counts=True)
    pairs = pd.DataFrame({"entity": entity[g // len(kinds)], "kind": np.asarray(kinds, object)[g % len(kinds)]}).merge(met, "left", ["entity", "kind"])
    known = pairs["met"].fillna(0).to_numpy(np.int64)
    first = np.where(known > 0, pairs["first"].to_numpy(float), value[order][lo])
    seen, gain = np.empty(len(due), np.int64), np.empty(len(due))
    seen[order] = known[pair] + rows - lo[pair]
    gain[order] = value[order] - first[pair]

    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(n_before > 0, before / n_before, np.nan)
    made = due[["id", "entity", "kind"]].assign(ts=pd.to_datetime(due["us"], unit="us"), value=value, n_before=n_before, prev_sum=prev, prev_n=np.minimum(n_before, last), mean_before=mean, met_before=seen, gain=np.where(seen > 0, gain, np.nan))
    now = pd.DataFrame({"entity": entity, "n": n + size, "total": total} | {f"v{i}": lately[:, i] for i in range(last)})
    pairs = pairs.assign(met=known + many, first=first)
    after = lambda old, new, key: pd.concat([old, new], ignore_index=True).drop_duplicates(key, keep="last") if len(old) else new
    return made, after(past, now, ["entity"]), after(met, pairs, ["entity", "kind"])


class History(StatefulProcessor):
    """Gives each event of a shard's entities with what came before it. last: how many earlier values ``prev_sum`` adds up."""

    def __init__(self, last: int):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.past = handle.getValueState("past", "entities binary, met binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for x in rows:
            self.waiting.appendList([(_pack(x[_WAITING.names], _WAITING),)])
            low = int(x["us"].min())
            earliest = low if earliest is None else min(earliest, low)
        if earliest is not None:
            self._wake(earliest)
        yield pd.DataFrame()

    def _wake(self, us: int) -> None:
        at = -(-us // 1000)
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = _unpack((r[0] for r in self.waiting.get()), _WAITING)
        due, rest = held[held["us"] <= mark], held[held["us"] > mark]
        self.waiting.clear()
        for i in range(0, len(rest), PIECE):
            self.waiting.appendList([(_pack(rest[i : i + PIECE], _WAITING),)])
        if len(rest):
            self.handle.registerTimer(-(-int(rest["us"].min()) // 1000))
        if len(due):
            known = self.past.get() if self.past.exists() else None
            past, met = (_unpack([bytes(b)] if known else [], s) for b, s in zip(known or (b"", b""), (_past(self.last), _MET), strict=True))
            made, past, met = advance(due, past, met, self.last)
            self.past.update((_pack(past, _past(self.last)), _pack(met, _MET)))
            for i in range(0, len(made), PIECE):
                yield made[COLUMNS][i : i + PIECE]

    def close(self) -> None:
        pass


def with_history(events: DataFrame, *, late: str, last: int = 10, shards: int = 256) -> DataFrame:
    """``OUT`` of each event that the watermark passes. events: a stream of id, entity, kind, ts, value; missing values count as nothing.

    shards: each holds its entities' state and is worked on as a whole, so their number should grow
    with the events; it stays the same as long as a checkpoint is in use.
    """
    ship(events.sparkSession)
    marked = events.filter("entity is not null and ts is not null").withWatermark("ts", late).withColumns({"us": F.unix_micros("ts"), "shard": F.pmod(F.xxhash64("entity"), F.lit(shards))})
    return marked.groupBy("shard").transformWithStateInPandas(statefulProcessor=History(last), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def batch(events: DataFrame, *, last: int = 10) -> DataFrame:
    """The same of a whole table, by windows."""
    rows = events.filter("entity is not null and ts is not null")
    order = Window.partitionBy("entity").orderBy("ts", "id")
    before, lately = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(-last, -1)
    kinds = Window.partitionBy("entity", "kind").orderBy("ts", "id")
    value = F.coalesce("value", F.lit(0.0))
    met = F.row_number().over(kinds) - 1
    return rows.select(
        "id", "entity", "kind", "ts", "value", F.count("*").over(before).alias("n_before"), F.coalesce(F.sum(value).over(lately), F.lit(0.0)).alias("prev_sum"), F.count("*").over(lately).alias("prev_n"),
        (F.sum(value).over(before) / F.nullif(F.count("*").over(before), F.lit(0))).alias("mean_before"), met.cast("long").alias("met_before"), F.when(met > 0, F.col("value") - F.first("value").over(kinds)).alias("gain"),
    )


def keeps_state(spark: SparkSession) -> None:
    """State of this kind is held by the store that spills to disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
