"""Plan builder: window expressions and ordered scans over keyed, ordered frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.bars import order
from tickloom.functions.kernels import Kernel
from tickloom.schema import KEYS, field


class Build:
    """A frame that grows by temporary columns.

    Window results are put into columns, so that windows can stand on
    windows; all of them share one partitioning and order, hence one exchange and one
    sort. Scans are gathered and run together in one pass over the sorted rows.
    """

    def __init__(self, df: DataFrame, keys: list[str] | None = None, rn: str | None = None):
        self.base = list(df.columns)
        self.keys = keys or KEYS
        self.order = order(df)
        self.df = df
        self._n = 0
        self._pending: list[tuple[Kernel, list[str], list[str]]] = []
        self._spec = Window.partitionBy(*self.keys).orderBy(*self.order)
        self._rn: Column | None = F.col(rn) if rn else None  # the number of the row within its key, if it is known already

    # columns

    def let(self, expr: Column) -> Column:
        """The expression as a column of its own."""
        self.flush()
        self._n += 1
        name = f"__x{self._n}"
        self.df = self.df.withColumn(name, expr)
        return F.col(name)

    def field(self, name: str | Column) -> Column:
        return name if isinstance(name, Column) else field(name, self.df.columns)

    def named(self, expr: Column) -> str:
        return self.df_name(self.let(expr))

    @staticmethod
    def df_name(c: Column) -> str:
        return c._jc.toString()

    # windows

    def over(self, p: int):
        """The row and the ``p`` - 1 before it."""
        return self._spec.rowsBetween(-(p - 1), 0)

    def around(self, left: int, right: int):
        return self._spec.rowsBetween(-left, right)

    @property
    def so_far(self):
        return self._spec.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def whole(self):
        return Window.partitionBy(*self.keys)

    @property
    def everything(self):
        """All rows of the key, in order."""
        return self._spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def whole_with(self, c: Column):
        return Window.partitionBy(*self.keys, c)

    @property
    def rn(self) -> Column:
        if self._rn is None:
            self._rn = self.let(F.row_number().over(self._spec))
        return self._rn

    def lag(self, x: Column, n: int = 1) -> Column:
        return self.let(F.lag(x, n).over(self._spec) if n >= 0 else F.lead(x, -n).over(self._spec))

    def warm(self, x: Column, p: int, value: Column) -> Column:
        """``value`` where the window of ``p`` rows is full and ``x`` is there in each; else null."""
        return self.let(F.when(F.count(x).over(self.over(p)) == p, value))

    # scans

    def scan(self, kernel: Kernel, *inputs: Column | str) -> list[Column]:
        """The outputs of a recursive kernel; run later, with the others."""
        names = []
        for x in inputs:
            c = self.field(x)
            n = self.df_name(c)
            if n not in self.df.columns:
                n = self.named(c) if not self._pending else self._named_beside(c)
            names.append(n)
        outs = []
        for _ in kernel.outputs:
            self._n += 1
            outs.append(f"__x{self._n}")
        self._pending.append((kernel, names, outs))
        return [F.col(o) for o in outs]

    def _named_beside(self, c: Column) -> str:
        """A plain projection below the pending scans."""
        self._n += 1
        name = f"__x{self._n}"
        self.df = self.df.withColumn(name, c)
        return name

    def flush(self) -> None:
        if not self._pending:
            return
        jobs, self._pending = self._pending, []
        keys, order_by = self.keys, self.order
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in self.df.schema]
        outs = [f"`{o}` {t}" for k, _, names in jobs for o, t in zip(names, k.types)]
        names = [o for _, _, outputs in jobs for o in outputs]
        # sorted rows of whole keys follow each other: many small keys share a batch
        rows = self.df.repartition(*keys).sortWithinPartitions(*keys, *order_by)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key: list | None = None
            states: list = [None] * len(jobs)
            for batch in parts:
                size = batch.num_rows
                if not size:
                    continue
                columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
                begins = np.zeros(size, bool)
                begins[0] = key != [c[0] for c in columns]
                for c in columns:
                    begins[1:] |= c[1:] != c[:-1]
                key = [c[-1] for c in columns]
                fresh = np.flatnonzero(begins).tolist()
                arrays: dict[str, np.ndarray] = {}
                added: list[pa.Array] = []
                for n, (kernel, inputs, _) in enumerate(jobs):
                    for c in inputs:
                        if c not in arrays:
                            arrays[c] = batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
                    states[n], results = kernel.run(states[n], [arrays[c] for c in inputs], size, fresh)
                    added += [pa.array(np.array(v, float), from_pandas=True) for v in results]
                # the other columns pass as they are
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

        self.df = rows.mapInArrow(run, ", ".join(fields + outs))

    def done(self, **outputs: Column) -> DataFrame:
        """The input's columns and the outputs."""
        self.flush()
        return self.df.select(*[c for c in self.base if c not in outputs], *[c.alias(n) for n, c in outputs.items()])
