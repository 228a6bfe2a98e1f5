"""Valid-time sale enrichment: sales take the version of their client that was valid when they were made.

Sales and client changes come in batches. A stateful streaming query, started anew for each batch on one checkpoint, keeps segments
in its state: each version opens one and owns the waiting sales of its validity span, up to the next version. A new version splits the
segment it falls into; H, the smaller of both tables' watermarks, drains sales that it has passed; versions that a later one below H
replaces are pruned, with their segments, which are empty by then.

One client may have a third of all rows, so no key is a client. Time is cut into slots of `slot_hours`, and a shard owns the segments of some
(client, slot); its state is a map whose entries hold the segments of ENTRY_SLOTS slots, packed as Arrow columns, so a batch opens only the spans that it meets or drains.
What goes over the borders of slots is summed up first: a second kind of shard owns timelines, a row per (client, slot) with the number of
versions that are left and the last of them. It answers, per client and slot that sales wait in, how many versions are held and which one came last before the slot.
Both run in the same query. A task holds one client's slots, but never all its rows; the driver holds one row a batch.

A batch: changes below their watermark are late; others are versions; then sales that H has passed, and those without a time, are
emitted, with `n_held`, the client's versions that are not pruned; then versions at or below H but the last are pruned. After the last batch the rest is emitted.

Cases: changes without valid_at count for nothing; equal changes are one; changes of one time and change_id are ordered by balance and op, nulls
first. Sales without a client take nothing and hold 0, and changes without a client can be late but serve nobody. Repeated sales are sales of their own.
A null arrived_at or a time past the end is the last batch, one before the start the first. Null and not-a-number balances give null cents. Other columns
do not matter, but rows of changes that differ in one are different. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import Workspace

HOUR = 3600 * 10**6
#: Slots in one entry of the state: as many as four days have, with slots of two hours.
ENTRY_SLOTS = 48
#: Before and after all times; sales without a time have one of SPREAD slots of their own, below all others.
BEFORE, AFTER, TIMELESS, SPREAD = -(1 << 62), 1 << 62, -(1 << 60), 64
#: Bits of flags: the id, the cents are null; a head segment, which has no version; sales without a client.
NO_ID, NO_CENTS, HEAD, ANONYMOUS = 1, 2, 4, 8
EVENT = "shard long, kind string, client long, slot long, at long, id long, cents long, flags long, op string, n long, first long"
OUT = EVENT.replace("shard long, ", "batch long, ") + ", found boolean, own_at long, own_id long, own_cents long, own_flags long, own_op string"
NAMES = [c.split(" ")[0] for c in EVENT.split(", ")]
VERSION, SALE = ("client", "slot", "at", "id", "cents", "flags", "op"), ("client", "slot", "at", "id", "flags")
TIMELINE = (*VERSION, "n", "first")
#: A shard's state, by span; timelines have two entries.
STATE = "segments map<bigint, binary>"
#: Each start of the query opens as many stores as there are partitions. Those of RocksDB leave half a megabyte of native memory each when they are closed (statistics a core),
#: which no heap limit sees and which grows with partitions and starts; these are on the heap alone, and a task closes its own.
#: A shard's state is about a batch of its rows. All of it is written with each batch, so few of those files are kept.
STORES = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider", "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.minDeltasForSnapshot": "1", "spark.sql.streaming.minBatchesToRetain": "2",
}

Columns = dict[str, np.ndarray]


def _pack(columns: Columns, lists: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> bytes:
    arrays = {k: pa.array(v, pa.string() if k == "op" else pa.int64()) for k, v in columns.items()}
    arrays |= {k: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int64())) for k, (at, v) in (lists or {}).items()}
    batch, sink = pa.record_batch(arrays), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _none(names: tuple[str, ...]) -> Columns:
    return {k: np.array([], object if k == "op" else np.int64) for k in names}


def _join(parts: list[Columns], names: tuple[str, ...]) -> Columns:
    return {k: np.concatenate([p[k] for p in parts]) for k in names} if parts else _none(names)


def _take(columns: Columns, at: np.ndarray) -> Columns:
    return {k: v[at] for k, v in columns.items()}


def _ordered(rows: Columns) -> Columns:
    """By client, slot and time, then change_id, balance and op, nulls first."""
    op = pd.factorize(rows["op"], sort=True)[0]
    flags = rows["flags"]
    return _take(rows, np.lexsort((op, rows["cents"], flags & NO_CENTS == 0, rows["id"], flags & NO_ID == 0, rows["at"], rows["slot"], rows["client"])))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _owners(versions: Columns, sales: Columns) -> np.ndarray:
    """For each sale the index of the version whose segment it lies in, in its client's slot; -1 for none. versions are in order."""
    n = len(versions["at"])
    at, slot, client = (np.concatenate([versions[k], sales[k]]) for k in ("at", "slot", "client"))
    anonymous = np.concatenate([np.zeros(n, np.int64), sales["flags"] & ANONYMOUS])
    order = np.lexsort((at, slot, client, anonymous))  # stable: versions of a sale's own time come before it
    last = np.maximum.accumulate(np.where(order < n, np.arange(len(order)), -1))
    before = np.where(last >= 0, order[last], 0)
    same = (last >= 0) & (client[before] == client[order]) & (slot[before] == slot[order]) & (anonymous[order] == 0)
    out = np.empty(len(order), np.int64)
    out[order] = np.where(same, before, -1)
    return out[n:]


class Segments:
    """What a batch does to one shard: segments of (client, slot) by spans of slots, or timelines of clients. slot: its length in microseconds."""

    def __init__(self, slot: int, shards: int):
        self.slot, self.shards = slot, shards
        self.state: dict[int, bytes] = {}

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        self.state = dict(state.get[0]) if state.exists else {}
        frame = pd.concat(list(rows), ignore_index=True)
        by_kind = {k: {c: g[c].to_numpy() for c in NAMES if c not in ("shard", "kind")} for k, g in frame.groupby("kind")}
        tick = by_kind["tick"]
        work = self._timelines if key[0] >= self.shards else self._segments
        for kind, columns in work(by_kind, *(int(tick[c][0]) for c in ("at", "id", "first"))):
            if size := len(next(iter(columns.values()))):
                yield self._frame(kind, int(tick["n"][0]), size, columns)
        state.update((self.state,))

    @staticmethod
    def _frame(kind: str, batch: int, size: int, columns: Columns) -> pd.DataFrame:
        base = {c.split(" ")[0]: (None if c.endswith("string") else False if c.endswith("boolean") else 0) for c in OUT.split(", ")}
        return pd.DataFrame({k: columns.get(k, np.full(size, kind if k == "kind" else batch if k == "batch" else v)) for k, v in base.items()})

    def _due(self, slot: np.ndarray, until: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots that until has reached, and that it has passed wholly."""
        timeless = slot < TIMELESS + SPREAD
        start = np.where(timeless, BEFORE, slot * self.slot)
        return timeless | (start < until), timeless | (start + self.slot <= until)

    def _segments(self, new: dict[str, Columns], until: int, before: int, late_below: int) -> Iterator[tuple[str, Columns]]:
        changes = [new[k] for k in ("change", "stray") if k in new]
        for c in changes:
            yield "late", _take({k: c[k] for k in ("id", "flags")}, c["at"] < late_below)
        versions = [_take({k: c[k] for k in VERSION}, c["at"] >= late_below) for c in changes[: "change" in new]]
        sales = [{k: new["sale"][k] for k in SALE}] if "sale" in new else []
        met = {int(d) for part in versions + sales for d in np.unique(part["slot"] // ENTRY_SLOTS)}
        spans = {d for d in self.state if d in met or d * ENTRY_SLOTS * self.slot < until}
        for d in spans:
            kept = _unpack(self.state[d])
            columns = {k: np.asarray(kept[k].to_numpy(zero_copy_only=False)) for k in VERSION}
            lengths = np.asarray(kept["sale_at"].value_lengths())
            owned = {k: np.repeat(columns[k], lengths) for k in ("client", "slot")}
            sales.append(owned | {k: np.asarray(kept[f"sale_{k}"].flatten()) for k in ("at", "id", "flags")})
            versions.append(_take(columns, columns["flags"] & HEAD == 0))
        version, sale = _ordered(_join(versions, VERSION)), _join(sales, SALE)
        owner = _owners(version, sale)
        timeless = sale["slot"] < TIMELESS + SPREAD
        out = timeless | (sale["at"] < until)
        taken = _take(version, owner[out]) if len(version["at"]) else {k: np.full(int(out.sum()), None if k == "op" else 0) for k in VERSION}
        found = owner[out] >= 0
        yield "sale", _take(sale, out) | {"found": found, "own_id": taken["id"], "own_cents": taken["cents"], "own_flags": taken["flags"], "own_op": np.where(found, taken["op"], None)}
        # Below or at H only the last version of a client's slot stays; slots that H has passed go over to the timelines.
        low = version["at"] <= until
        last = np.append(_starts(version["client"], version["slot"])[1:], True) if len(low) else low
        replaced = low & ~last
        replaced[:-1] &= low[1:] | last[:-1]
        closed = self._due(version["slot"], until)[1]
        cut = _take(version, replaced & ~closed)
        first = np.flatnonzero(_starts(cut["client"], cut["slot"]))
        yield "pruned", {"client": cut["client"][first], "slot": cut["slot"][first], "n": np.diff(np.append(first, len(cut["at"])))}
        self._store(_take(version, ~replaced & ~closed), _take(sale, ~out), spans)

    def _store(self, version: Columns, sale: Columns, opened: set[int]) -> None:
        owner = _owners(version, sale)
        lone = np.flatnonzero(owner < 0)
        lone = lone[np.lexsort((sale["slot"][lone], sale["client"][lone], sale["flags"][lone] & ANONYMOUS))]
        heads = _starts(sale["flags"][lone] & ANONYMOUS, sale["client"][lone], sale["slot"][lone])
        owner[lone] = len(version["at"]) + np.cumsum(heads) - 1
        at = lone[heads]
        head = {"client": sale["client"][at], "slot": sale["slot"][at], "flags": HEAD | sale["flags"][at] & ANONYMOUS, "op": np.full(len(at), None), **{k: np.zeros(len(at), np.int64) for k in ("at", "id", "cents")}}
        segment = _join([version, head], VERSION)
        span, of_sale = segment["slot"] // ENTRY_SLOTS, np.argsort(owner, kind="stable")
        owned = np.bincount(owner, minlength=len(span))
        ends = np.cumsum(owned)
        for d in np.unique(span):
            mine = np.flatnonzero(span == d)
            sales = of_sale[np.concatenate([np.arange(ends[i] - owned[i], ends[i]) for i in mine])] if owned[mine].any() else of_sale[:0]
            offsets = np.concatenate([[0], np.cumsum(owned[mine])])
            self.state[int(d)] = _pack(_take(segment, mine), {f"sale_{k}": (offsets, sale[k][sales]) for k in ("at", "id", "flags")})
        for d in opened - set(span.tolist()):
            del self.state[d]

    def _timelines(self, new: dict[str, Columns], until: int, before: int, late_below: int) -> Iterator[tuple[str, Columns]]:
        lines, asked = [], []
        for part, at in ((lines, 0), (asked, 1)):
            if at in self.state:
                kept = _unpack(self.state[at])
                part.append({k: np.asarray(kept[k].to_numpy(zero_copy_only=False)) for k in kept.schema.names})
        if "pruned" in new:  # taken off as counts below nothing: their place in the order is before all versions
            lines.append({k: new["pruned"][k] for k in TIMELINE})
        if "added" in new:
            lines.append({k: new["added"][k] for k in TIMELINE})
        if "asked" in new:
            asked.append({k: new["asked"][k] for k in ("client", "slot")})
        line = _ordered(_join(lines, TIMELINE))
        start = np.flatnonzero(_starts(line["client"], line["slot"]))
        if len(start):
            n, first = np.add.reduceat(line["n"], start), np.minimum.reduceat(line["first"], start)
            line = _take(line, np.append(start[1:], len(line["n"])) - 1) | {"n": n, "first": first}
        want = _join(asked, ("client", "slot"))
        want = _take(want, np.lexsort((want["slot"], want["client"])))
        want = _take(want, _starts(want["client"], want["slot"]))
        due, passed = self._due(want["slot"], until)
        yield "held", self._answers(line, _take(want, due), before)
        # Of a client's slots with versions at or below H only the last stays; where H has passed it, one version of it is left.
        low = line["first"] <= until
        keep = np.ones(len(low), bool)
        if len(low):
            base = np.append(line["client"][1:] != line["client"][:-1], True)
            base[:-1] |= ~low[1:]
            keep = ~low | base
            line["n"] = np.where(low & self._due(line["slot"], until)[1], 1, line["n"])
        for at, part in ((0, _take(line, keep)), (1, _take(want, ~passed))):
            self.state[at] = _pack(part)

    def _answers(self, line: Columns, want: Columns, before: int) -> Columns:
        """Per client and slot: versions held, the last one before the slot, and the last one in it where H had passed it before: its segments are gone."""
        n, m = len(line["slot"]), len(want["slot"])
        if not m:
            return {"client": want["client"]}
        client, slot = np.concatenate([line["client"], want["client"]]), np.concatenate([line["slot"], want["slot"]])
        total = np.zeros(m, np.int64)
        chosen = {}
        for name, closed_only in (("", False), ("own_", True)):
            order = np.lexsort((np.arange(n + m) < n if not closed_only else np.arange(n + m) >= n, slot, client))  # a slot's own line after it, or before it
            last = np.maximum.accumulate(np.where(order < n, np.arange(n + m), -1))
            line_at = np.where(last >= 0, order[last], 0)
            ok = (last >= 0) & (client[line_at] == client[order])
            if closed_only:
                ok &= (slot[line_at] == slot[order]) & self._due(slot[order], before)[1] & (slot[order] >= TIMELESS + SPREAD)
            pick = np.full(n + m, -1)
            pick[order] = np.where(ok, line_at, -1)
            chosen[name] = pick[n:]
        if n:
            start = np.flatnonzero(_starts(line["client"]))
            held, known = np.add.reduceat(line["n"], start), line["client"][start]
            at = np.minimum(np.searchsorted(known, want["client"]), len(known) - 1)
            total = np.where(known[at] == want["client"], held[at], 0)
        out = {"client": want["client"], "slot": want["slot"], "n": total}
        for name, at in chosen.items():
            for k in ("at", "id", "cents", "flags", "op"):
                none = None if k == "op" else HEAD if k == "flags" else 0
                out[f"{name}{k}"] = np.where(at >= 0, line[k][np.maximum(at, 0)], none) if n else np.full(m, none)
        return out


def _micros(column: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    t = column.cast("timestamp_ntz")
    return (F.hour(t) + _day(t) * 24).cast("long") * HOUR + F.minute(t).cast("long") * 60_000_000 + (F.date_part(F.lit("SECOND"), t) * F.lit(1_000_000)).cast("long")


def batch_of(day: Column, batches: int, first_day: int, days: int) -> Column:
    at = F.floor((day - first_day) * batches / F.lit(days))
    return F.greatest(F.lit(0), F.least(F.lit(batches - 1), at)).cast("int")


def _day(column: Column) -> Column:
    return F.datediff(column.cast("date"), F.lit("1970-01-01").cast("date"))


class Enrichment:
    """Feeds batches to the streaming query. A new folder under the shared one holds input, checkpoint and output."""

    def __init__(self, spark: SparkSession, slot_hours: int = 2, rows_per_shard: int = 400_000):
        self.spark, self.slot, self.rows_per_shard = spark, slot_hours * HOUR, rows_per_shard
        self.work = Workspace(spark, "sales")

    def _event(self, rows: DataFrame, kind: Column, shard: Column, **columns: Column) -> DataFrame:
        known = {"shard": shard, "kind": kind} | columns
        return rows.select("batch", *(known.get(n, F.lit(None).cast("string") if n == "op" else F.lit(0)).cast("string" if n in ("kind", "op") else "long").alias(n) for n in NAMES))

    def run(self, sales: DataFrame, changes: DataFrame, batches: int, lag_hours: int = 0) -> DataFrame:
        """sales (batch, sale_id, client_id, sold_at), changes (batch, change_id, client_id, valid_at, op, balance, any others)."""
        spark, root = self.spark, self.work.root
        sold, valid = _micros(F.col("sold_at")), _micros(F.col("valid_at"))
        changes = changes.where("valid_at is not null").distinct()
        latest = sales.groupBy("batch").agg(F.max(sold).alias("sold"), F.lit(None).cast("long").alias("valid"), F.count("*").alias("n"))
        latest = latest.unionByName(changes.groupBy("batch").agg(F.lit(None).cast("long").alias("sold"), F.max(valid).alias("valid"), F.count("*").alias("n")))
        # One row a batch comes to the driver.
        seen = {r.batch: r for r in latest.groupBy("batch").agg(F.max("sold").alias("sold"), F.max("valid").alias("valid"), F.sum("n").alias("n")).collect()}
        tops = {k: [max((getattr(r, k) for b, r in seen.items() if b < at and getattr(r, k) is not None), default=None) for at in range(batches)] for k in ("sold", "valid")}
        marks = {k: [BEFORE if x is None else x - lag_hours * HOUR for x in v] for k, v in tops.items()}
        passed = [min(a, b) for a, b in zip(marks["sold"], marks["valid"], strict=True)] + [AFTER]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        shards = max(parts, sum(r.n for r in seen.values()) // self.rows_per_shard)
        self._write(sales, changes, sold, valid, marks["valid"], shards, parts)
        self._ticks(passed, marks["valid"], shards, parts)
        before = {k: spark.conf.get(k, None) for k in STORES}
        for k, v in STORES.items():
            spark.conf.set(k, v)
        try:
            for batch in range(batches + 1):
                if batch:
                    self._hand_over(batch, shards, parts)
                self._publish(batch)
                self._step(batch, shards)
                self.work.drop(f"in/{batch:03d}")  # the query has committed it
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        return self._result(spark.read.schema(OUT).parquet(f"{root}/out/*"))

    def _write(self, sales: DataFrame, changes: DataFrame, sold: Column, valid: Column, late_below: list[int], shards: int, parts: int) -> None:
        """Every batch's rows in a folder of its own, then their sums for the timelines."""
        root, flag = self.work.root, lambda c, bit: F.when(c.isNull(), bit).otherwise(0)
        client, slot = F.coalesce("client_id", F.lit(0)), lambda t: ((t - F.pmod(t, F.lit(self.slot))) / self.slot).cast("long")
        timeless = F.lit(TIMELESS) + F.pmod(F.xxhash64("sale_id"), F.lit(SPREAD))
        when = F.coalesce(slot(F.col("at")), timeless)
        sales = sales.withColumn("at", sold).withColumn("slot", when)
        shard = F.pmod(F.xxhash64(client, "slot"), F.lit(shards))
        sale = self._event(sales, F.lit("sale"), shard, client=client, slot=F.col("slot"), at=F.coalesce("at", F.lit(0)), id=F.coalesce("sale_id", F.lit(0)), flags=flag(F.col("sale_id"), NO_ID) + flag(F.col("client_id"), ANONYMOUS))
        cents = F.when(~F.isnan("balance"), F.floor(F.col("balance") * 100 + 0.5))
        changes = changes.withColumn("at", valid).withColumn("slot", slot(F.col("at"))).withColumn("cents", cents)
        change = self._event(changes, F.when(F.col("client_id").isNull(), "stray").otherwise("change"), shard, client=client, slot=F.col("slot"), at=F.col("at"), id=F.coalesce("change_id", F.lit(0)), cents=F.coalesce("cents", F.lit(0)), flags=flag(F.col("change_id"), NO_ID) + flag(F.col("cents"), NO_CENTS), op=F.col("op"))
        events = sale.unionByName(change)
        deal = ("batch", F.pmod("shard", F.lit(max(4, parts // 4))))
        events.repartition(*deal).write.partitionBy("batch").parquet(f"{root}/all")
        rows = self.spark.read.schema(f"batch int, {EVENT}").parquet(f"{root}/all")
        line = F.pmod(F.xxhash64("client"), F.lit(parts)) + shards
        low = F.element_at(F.array(*(F.lit(x) for x in late_below)), F.col("batch") + 1)
        order = F.struct("at", F.when(F.col("flags").bitwiseAND(NO_ID) == 0, F.col("id")).alias("i"), F.when(F.col("flags").bitwiseAND(NO_CENTS) == 0, F.col("cents")).alias("c"), "op", "id", "cents", "flags")
        added = rows.where("kind = 'change'").where(F.col("at") >= low).groupBy("batch", "client", "slot").agg(F.max(order).alias("x"), F.count("*").alias("n"), F.min("at").alias("first"))
        added = self._event(added, F.lit("added"), line, client=F.col("client"), slot=F.col("slot"), n=F.col("n"), first=F.col("first"), **{k: F.col(f"x.{k}") for k in ("at", "id", "cents", "flags", "op")})
        asked = rows.where("kind = 'sale'").where(F.col("flags").bitwiseAND(ANONYMOUS) == 0).select("batch", "client", "slot").distinct()
        asked = self._event(asked, F.lit("asked"), line, client=F.col("client"), slot=F.col("slot"))
        added.unionByName(asked).repartition(*deal).write.partitionBy("batch").mode("append").parquet(f"{root}/all")

    def _ticks(self, passed: list[int], late_below: list[int], shards: int, parts: int) -> None:
        """Each shard's call of each batch, with H, the H before, and the watermark of changes."""
        n = shards + parts
        pick = lambda xs: F.element_at(F.array(*(F.lit(x) for x in xs)), F.col("batch") + 1)
        rows = self.spark.range(0, n, 1, -(-n // 100_000)).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(len(passed) - 1))).alias("batch"))
        ticks = self._event(rows, F.lit("tick"), F.col("s"), at=pick(passed), id=pick([BEFORE, *passed[:-1]]), first=pick([*late_below, BEFORE]), n=F.col("batch"))
        ticks.write.partitionBy("batch").mode("append").parquet(f"{self.work.root}/all")

    def _hand_over(self, batch: int, shards: int, parts: int) -> None:
        """What segments pruned in the last batch, as input of the timelines: a row per client in the one slot that H lies in."""
        cut = self.spark.read.schema(OUT).parquet(f"{self.work.root}/out/{batch - 1:03d}").where("kind = 'pruned'").withColumn("batch", F.lit(batch))
        rows = self._event(cut, F.lit("pruned"), F.pmod(F.xxhash64("client"), F.lit(parts)) + shards, client=F.col("client"), slot=F.col("slot"), n=-F.col("n"), at=F.lit(BEFORE), first=F.lit(AFTER))
        rows.drop("batch").write.mode("append").parquet(f"{self.work.root}/all/batch={batch}")

    def _publish(self, batch: int) -> None:
        """A batch's folder moves to where the query reads."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path
        source, to = path(f"{self.work.root}/all/batch={batch}"), path(f"{self.work.root}/in/{batch:03d}")
        fs = source.getFileSystem(context._jsc.hadoopConfiguration())
        fs.mkdirs(to.getParent())
        if not fs.rename(source, to):
            raise OSError(f"{source} could not be moved to {to}")

    def _step(self, batch: int, shards: int) -> None:
        root = self.work.root

        def keep(rows: DataFrame, _: int) -> None:  # the same folder again where a batch is run again
            rows.write.mode("overwrite").parquet(f"{root}/out/{batch:03d}")

        events = self.spark.readStream.schema(EVENT).parquet(f"{root}/in/*")
        length = self.slot
        work = lambda key, rows, state: Segments(length, shards)(key, rows, state)
        state = events.groupBy("shard").applyInPandasWithState(work, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
        query = state.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def _result(self, out: DataFrame) -> DataFrame:
        """Sales with their slot's version, else the last one before it, and their client's number of versions."""
        null = lambda c, flags, bit: F.when(F.col(flags).bitwiseAND(bit) == 0, F.col(c))
        sale = out.where("kind = 'sale'").select("batch", F.when(F.col("flags").bitwiseAND(ANONYMOUS) == 0, F.col("client")).alias("client"), "slot", "at", null("id", "flags", NO_ID).alias("id"), F.when(F.col("found"), F.struct(null("own_id", "own_flags", NO_ID).alias("change_id"), null("own_cents", "own_flags", NO_CENTS).alias("balance_cents"), F.col("own_op").alias("op"))).alias("inside"))
        version = lambda p: F.when(F.col(f"{p}flags").bitwiseAND(HEAD) == 0, F.struct(null(f"{p}id", f"{p}flags", NO_ID).alias("change_id"), null(f"{p}cents", f"{p}flags", NO_CENTS).alias("balance_cents"), F.col(f"{p}op").alias("op")))
        held = out.where("kind = 'held'").select("batch", "client", "slot", F.col("n").alias("n_held"), version("").alias("before"), version("own_").alias("own"), F.col("own_at"))
        timed = F.col("slot") >= TIMELESS + SPREAD
        taken = F.coalesce("inside", F.when(timed & (F.col("own_at") <= F.col("at")), F.col("own")), F.when(timed, F.col("before")))
        both = sale.join(held, ["batch", "client", "slot"], "left").withColumn("x", taken)
        done = both.select(F.lit("sale").alias("rec"), "id", "batch", F.coalesce("n_held", F.lit(0).cast("long")).alias("n_held"), "x.change_id", "x.balance_cents", "x.op")
        none = {c: F.lit(None).cast(t) for c, t in (("n_held", "long"), ("change_id", "long"), ("balance_cents", "long"), ("op", "string"))}
        late = out.where("kind = 'late'").select(F.lit("late").alias("rec"), null("id", "flags", NO_ID).alias("id"), "batch", *(v.alias(k) for k, v in none.items()))
        return done.unionByName(late)


def enrich(sales: DataFrame, changes: DataFrame, batches: int = 12, first_day: int = 19723, days: int = 152, lag_hours: int = 0, slot_hours: int = 2) -> DataFrame:
    """(rec, id, batch, n_held, change_id, balance_cents, op) of sales by the day they arrived on, and of late changes."""
    own = sales.select("sale_id", "client_id", "sold_at", batch_of(_day(F.col("arrived_at")), batches, first_day, days).alias("batch"))
    delayed = _day(F.col("valid_at")) + F.pmod(F.crc32(F.coalesce(F.col("change_id").cast("string"), F.lit(""))), F.lit(4))
    dealt = changes.select(batch_of(delayed, batches, first_day, days).alias("batch"), *(F.col(f"`{c}`").alias("in_batch" if c == "batch" else c) for c in changes.columns))
    return Enrichment(sales.sparkSession, slot_hours).run(own, dealt, batches, lag_hours)
