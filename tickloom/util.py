"""Small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
DAY = 86_400 * SECOND


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows, which are then read once, here.

    Otherwise the frame is returned as it is, and the join goes by shuffle
    (AQE splits its skewed partitions).
    """
    rows = df.limit(max_rows + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if rows.num_rows <= max_rows else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share (``spark.checkpoint.dir``); one of this machine only where none is set, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = set_before.get() if set_before.isDefined() else f"file://{tempfile.mkdtemp(prefix='tickloom-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: what is read more than once is computed once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def us(ts: Column | str) -> Column:
    """Microseconds since 1970 UTC of a timestamp column."""
    return F.unix_micros(ts)


def floor_div(a: Column, b: Column | int) -> Column:
    """Integer division that rounds down, for negative numbers too."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b)


def timeframe_us(tf: Column) -> Column:
    """Length of a timeframe such as ``15m 1h 1d 1w`` in microseconds; null if it is none."""
    n = F.regexp_extract(tf, r"^(\d{1,6})[mhdw]$", 1)
    unit = F.create_map(*[F.lit(x) for p in (("m", MINUTE), ("h", 60 * MINUTE), ("d", DAY), ("w", 7 * DAY)) for x in p])
    out = F.when(n != "", n.cast("long") * unit[F.right(tf, F.lit(1))])
    return F.when(out > 0, out)


def lead_across(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """``lead(value)`` per ``keys`` by ``order``, without bringing one key into one task.

    ``chunk`` (never null) cuts a key's rows into pieces that follow each other in
    ``order``. Within a piece a first window gives the answer. A second one joins the
    edges: the first and the last row of every piece meet by key, all
    others stay with their piece. The rows are read once.
    """
    w = Window.partitionBy(*keys, chunk).orderBy(*order)
    # a null lead marks the last row of a piece
    inner = df.withColumns({out: F.lead(value).over(w), "__first": F.row_number().over(w) == 1})
    inner = inner.withColumn("__edge", F.col("__first") | F.col(out).isNull())
    inner = inner.withColumn("__meet", F.when(~F.col("__edge"), F.col(chunk)))
    across = F.lead(value).over(Window.partitionBy(*keys, "__meet").orderBy(*order))
    joined = inner.withColumn("__across", across).withColumn(out, F.coalesce(out, F.when(F.col("__edge"), F.col("__across"))))
    return joined.drop("__first", "__edge", "__meet", "__across")
