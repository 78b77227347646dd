"""Processing only what was added or changed since the last successful run.

The source is a log of deliveries in partitions (``key``). A delivery's place in the log of its key is told by ``order``, such as
``("ingested_at", "delivery_id")``. ``ChangeLog`` keeps one position per key. A batch is planned before any work: the range
of places per key is written ahead. Its rows are the events (``key``, ``offset``) that are new or changed within the range;
they go to a sink, and the batch is marked done. A plan that is not done is run again with the same ranges, so a
failure neither skips nor repeats records. The sink is deduplicated by key and offset, the latest delivery counting.

What was there before the range is read only for events delivered within it (a semi-join, which Spark
turns into a broadcast or a Bloom filter where the range is small), not for the whole history.

Defined results: a delivery with a null key or null offset is no event and is
left out; deliveries repeated as they are count once; of deliveries at one place in ``order`` but its last column the larger
last one is the later; a delivery with a null in ``order`` has no place: it comes in every batch, and any delivery with a
place is later; runs with a null instant are ignored; a committed run with a null offset has processed nothing (all of
its key is due); fields that are no JSON object, or that name a field twice, compare by their text; JSON numbers compare as decimals (below 18
places by the shortest text of the double), and the number 1 is not the string "1"; empty tables give empty results; extra columns ride along.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.util import bounded_broadcast, shared_folder

LAST = (1 << 63) - 1


def canonical_fields(fields: Column) -> Column:
    """One text for all JSON spellings of equal values: sorted keys, numbers as decimals, nulls left out."""

    def spelled(e: Column) -> Column:
        v = e["value"]
        kind = F.schema_of_variant(v)
        as_ = lambda t: F.try_variant_get(v, "$", t)
        number, exact = as_("double"), as_("decimal(38,18)")
        wide = F.when((kind == "DOUBLE") & (F.abs(number) >= 1e20), as_("decimal(38,0)").cast("string"))
        number = F.when(exact.cast("double") == number, exact.cast("string")).otherwise(F.coalesce(wide, as_("string")))
        is_number = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
        return F.concat(e["key"], F.lit("\u0001"), F.when(is_number, F.concat(F.lit("n"), number)).otherwise(F.concat(F.left(kind, F.lit(1)), as_("string"))))

    entries = F.map_entries(F.try_variant_get(F.try_parse_json(fields), "$", "map<string,variant>"))
    kept = F.filter(entries, lambda e: ~F.is_variant_null(e["value"]))
    return F.coalesce(F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform(kept, spelled)), "\u0002")), fields)


def last_successful_runs(runs: DataFrame, key: str = "session_id", offset: str = "last_event_index", status: str = "status", at: str = "taken_at", run_id: str = "snapshot_id", success: str = "committed") -> DataFrame:
    """(key, at, offset) of each key's latest successful run."""
    ok = runs.where((F.col(status) == success) & F.col(at).isNotNull() & F.col(key).isNotNull())
    last = ok.groupBy(key).agg(F.max(F.struct(F.col(at).alias("at"), F.col(run_id).alias("id"), F.col(offset).alias("offset"))).alias("r"))
    return last.select(F.col(key).alias("__key"), F.col("r.at").alias("__at"), F.col("r.offset").alias("__offset"))


def changed_since(deliveries: DataFrame, runs: DataFrame, key: str = "session_id", offset: str = "event_index", payload: str = "fields", at: str = "ingested_at", delivery_id: str = "delivery_id", root: str | None = None) -> DataFrame:
    """(key, offset) of the events that are new or changed since their key's last run: one batch of a ``ChangeLog``.

    ``runs`` is the result of ``last_successful_runs``, whose positions the log takes over: a run has processed what was ingested
    up to its instant and lies up to its offset. ``root`` is the log's folder, by default a new one in the shared folder.
    """
    log = ChangeLog(deliveries.sparkSession, root or shared_folder(deliveries.sparkSession, "changes"), key, offset, (at, delivery_id), payload)
    id_type = deliveries.schema[delivery_id].dataType
    start = F.struct(F.col("__at").alias(at), F.lit(LAST).cast(id_type).alias(delivery_id))
    log.begin(runs.where(F.col("__offset").isNotNull()).select(F.col("__key").alias("key"), start.alias("end"), F.col("__offset").alias("floor")))
    log.run(deliveries.select(*dict.fromkeys([key, offset, payload, at, delivery_id])))
    return log.read().select(key, offset)


class ChangeLog:
    """Incremental runs over a growing table, with a write-ahead batch plan.

    Below ``root`` (a folder all executors share) every batch ``n`` has
    ``plan/n`` (the range of places per key, written before any work),
    ``sink/n`` (its rows, written over by a replay) and ``done/n`` (present once
    the batch is whole). ``read`` gives one row per (key, offset), the latest delivery counting.

    With a ``payload``, an event that was delivered again with equal values (``canonical_fields``) is not changed and does not come out.
    Without, every new delivery does. Without ``order`` the offset is the place, which
    is right only if an offset comes once and none comes late.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, offset: str, order: Sequence[str] = (), payload: str | None = None, max_keys: int = 100_000):
        self.spark, self.root, self.key, self.offset, self.order = spark, root.rstrip("/"), key, offset, list(order or (offset,))
        self.payload, self.max_keys = payload, max_keys
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: object):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *map(str, parts)]))

    def _numbers(self, kind: str) -> list[int]:
        p = self._path(kind)
        if not self._fs.exists(p):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(p)]
        return sorted(int(n) for n in names if n.isdigit())

    def _write(self, df: DataFrame, kind: str, n: int) -> None:
        """Whole or not at all: written beside its place, then renamed."""
        tmp = self._path(f".tmp-{uuid.uuid4().hex}")
        df.write.mode("overwrite").parquet(tmp.toString())
        self._fs.mkdirs(self._path(kind))
        self._fs.delete(self._path(kind, n), True)
        if not self._fs.rename(tmp, self._path(kind, n)):
            raise OSError(f"cannot place {kind}/{n}")

    def _mark(self, n: int) -> None:
        self._fs.mkdirs(self._path("done"))
        self._fs.create(self._path("done", n), True).close()

    def _place(self) -> Column:
        """Place of a delivery in its key's log; null if it has none."""
        known = F.lit(True)
        for c in self.order:
            known = known & F.col(c).isNotNull()
        return F.when(known, F.struct(*self.order))

    def begin(self, positions: DataFrame) -> None:
        """Take over (key, end, floor) from elsewhere: places up to ``end`` are processed, but for offsets above ``floor``.

        Only a log without batches takes them; again called, it keeps what it has.
        """
        if not self._numbers("plan"):
            self._write(positions.select("key", F.col("end").alias("start"), "end", "floor"), "plan", 0)
            self._mark(0)

    def positions(self) -> DataFrame | None:
        """(key, end, floor) after the last whole batch."""
        done = self._numbers("done")
        if not done:
            return None
        last = self.spark.read.parquet(self._path("plan", done[-1]).toString())
        return last.select("key", "end", "floor" if done[-1] == 0 else F.lit(None).cast(last.schema["floor"].dataType).alias("floor"))

    def plan(self, source: DataFrame) -> int:
        """The number of the batch to run: an unfinished one, else a new one, its plan written ahead."""
        plans, done = self._numbers("plan"), self._numbers("done")
        if plans and (not done or plans[-1] > done[-1]):
            return plans[-1]
        ends = source.where(F.col(self.key).isNotNull() & F.col(self.offset).isNotNull()).groupBy(F.col(self.key).alias("key")).agg(F.max(self._place()).alias("top"))
        before = self.positions()
        if before is None:
            ranges = ends.select("key", F.lit(None).cast(ends.schema["top"].dataType).alias("start"), F.col("top").alias("end"), F.lit(None).cast(source.schema[self.offset].dataType).alias("floor"))
        else:
            ranges = ends.join(before.withColumnRenamed("end", "start"), "key", "full_outer").select("key", "start", F.greatest("start", "top").alias("end"), "floor")
        n = (plans[-1] if plans else 0) + 1
        self._write(ranges, "plan", n)
        return n

    def rows(self, source: DataFrame, n: int) -> DataFrame:
        """The due events of plan ``n``, each as its latest delivery up to the end of the range."""
        p = self.spark.read.parquet(self._path("plan", n).toString()).select(F.col("key").alias("__key"), F.col("start").alias("__start"), F.col("end").alias("__end"), F.col("floor").alias("__floor"))
        at = F.col("__place")
        d = source.where(F.col(self.offset).isNotNull()).withColumn("__place", self._place())
        d = d.join(bounded_broadcast(p, self.max_keys), F.col(self.key) == F.col("__key")).where(at.isNull() | (at <= F.col("__end")))
        fresh = at.isNull() | F.col("__start").isNull() | (at > F.col("__start"))
        anyway = F.coalesce(F.col("__start").isNull() | (F.col(self.offset) > F.col("__floor")), F.lit(False))
        d = d.withColumns({"__fresh": fresh, "__anyway": anyway})
        event = [self.key, self.offset]
        due = d.where(F.col("__fresh") | F.col("__anyway"))
        if self.payload:
            # earlier values matter only for what was delivered in the range
            old = d.where(~F.col("__fresh") & ~F.col("__anyway"))
            due = due.unionByName(old.join(due.where(~F.col("__anyway")).select(*event).distinct(), event, "left_semi").select(*due.columns))
        value = canonical_fields(F.col(self.payload)) if self.payload else F.lit(None).cast("string")
        v = F.struct(F.struct(*self.order).alias("o"), value.alias("v"), F.struct(*source.columns).alias("row"))
        g = due.select(*event, "__fresh", "__anyway", v.alias("__v")).groupBy(*event).agg(
            F.max("__v").alias("latest"),
            F.max(F.when(~F.col("__fresh"), F.struct("__v.o", "__v.v"))).alias("before"),
            F.max("__anyway").alias("anyway"),
        )
        if self.payload:
            g = g.where(F.col("anyway") | F.col("before").isNull() | ~F.col("latest.v").eqNullSafe(F.col("before.v")))
        return g.select(*[F.col(f"latest.row.`{c}`").alias(c) for c in source.columns])

    def run(self, source: DataFrame, process: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
        """Plan or replay one batch, process it and put it into the sink; its number."""
        n = self.plan(source)
        rows = process(self.rows(source, n))
        if lost := {self.key, self.offset, *self.order} - set(rows.columns):
            raise ValueError(f"the sink needs {sorted(lost)}")
        self._write(rows.withColumn("__batch", F.lit(n)), "sink", n)
        self._mark(n)
        return n

    def read(self) -> DataFrame:
        """The sink, one row per (key, offset)."""
        df = self.spark.read.parquet(*[self._path("sink", n).toString() for n in self._numbers("done") if n])
        rest = [c for c in df.columns if c not in (self.key, self.offset)]
        g = df.groupBy(self.key, self.offset).agg(F.max_by(F.struct(*rest), F.struct(F.struct(*self.order), "__batch")).alias("__r"))
        return g.select(self.key, self.offset, *[F.col(f"__r.`{c}`").alias(c) for c in rest if c != "__batch"])
