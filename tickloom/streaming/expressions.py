"""Expressions over streams of bars, by the batch planner.

Every micro-batch is evaluated together with the bars before it that its expressions still remember: the rows of
their windows, or so many that what lies before weighs less than a double can tell (``Plan.memory``). What remembers
everything (cumulative sums, parabolic SAR ...) keeps all bars. So any expression can run on a stream, and gives
what the batch gives.

Below ``root`` (a folder all executors share) ``out/n`` and ``state/n`` belong to micro-batch ``n``; a micro-batch that is run again reads
the state before it and writes over both, so results come once.

Defined results: a bar that is not closed, or not after the last one of its key, or without an instant, gives nothing; of bars
of one instant in a micro-batch one counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.plans.compile import evaluate
from tickloom.plans.planner import plan
from tickloom.schema import KEYS


class ExpressionStream:
    """Named expressions, registered before the stream starts."""

    def __init__(self, spark: SparkSession, root: str, timeframe: str | None = None):
        self.spark, self.root, self.timeframe = spark, root.rstrip("/"), timeframe
        self.named: dict[str, str] = {}

    def register(self, name: str, text: str) -> ExpressionStream:
        if name in self.named:
            raise ValueError(f"{name!r} is registered already")
        plan(text, self.timeframe)
        self.named[name] = text
        return self

    @property
    def memory(self) -> int | None:
        """Bars of each key that are kept; all, if null."""
        all_ = [plan(t, self.timeframe) for t in self.named.values()]
        return None if any(p.memory is None for p in all_) else max([1, *[p.memory for p in all_], *[n for p in all_ for n in p.lookback.values()]])

    def _numbers(self, kind: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()) if fs.exists(path) else []

    def advance(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch; for ``foreachBatch``."""
        new = batch.where("ts is not null")
        if "is_closed" in batch.columns:
            new = new.where(F.coalesce("is_closed", F.lit(True)))
        new = new.dropDuplicates([*KEYS, "ts"]).withColumn("__new", F.lit(True))
        before = [n for n in self._numbers("state") if n < epoch]
        if before:
            history = self.spark.read.parquet(f"{self.root}/state/{before[-1]}")
            last = history.groupBy(*KEYS).agg(F.max("ts").alias("__last"))
            new = new.join(last, KEYS, "left").where("__last is null or ts > __last").drop("__last")
            new = history.withColumn("__new", F.lit(False)).unionByName(new)
        out = evaluate(new, timeframe=self.timeframe, **self.named)
        out.where("__new").select(*KEYS, "ts", *self.named).write.mode("overwrite").parquet(f"{self.root}/out/{epoch}")
        memory = self.memory
        kept = new.drop("__new")
        if memory is not None:
            kept = kept.withColumn("__back", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("ts")))).where(F.col("__back") <= memory).drop("__back")
        kept.write.mode("overwrite").parquet(f"{self.root}/state/{epoch}")

    def start(self, bars: DataFrame, **trigger) -> StreamingQuery:
        """Run over a stream of bars; ``trigger`` as of ``DataStreamWriter.trigger``."""
        return bars.writeStream.foreachBatch(self.advance).option("checkpointLocation", f"{self.root}/checkpoint").trigger(**trigger).start()

    def results(self) -> DataFrame:
        """(keys, ts, the expressions) of all bars so far."""
        return self.spark.read.parquet(*[f"{self.root}/out/{n}" for n in self._numbers("out")])
