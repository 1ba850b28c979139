"""Ordered series laid out in equal chunks.

Everything here is order dependent, and Spark's own ordered window puts one
whole partition key into one task.  One symbol may hold a third of all rows, so
the key used for ordered work is never the symbol alone: rows are numbered once
by a range shuffle (balanced whatever the skew) and cut into chunks of
``chunk_rows`` rows.  Three ways of working follow:

* bounded look-back or look-ahead: rows near a chunk border are copied into the
  neighbouring chunk (a halo) and ordinary window expressions run per chunk;
* unbounded but summarisable (running sum, maximum, last value): per-chunk
  aggregates, a prefix over the small aggregate table, and a window per chunk;
* stateful scans: see :mod:`tidewheel.operators.scans`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.storage import materialize

DEFAULT_CHUNK_ROWS = 131_072

Stage = Callable[[WindowSpec], dict[str, Column]]


@dataclass(frozen=True)
class Recipe:
    """Window expressions in dependent stages, with the rows they reach back and ahead."""

    out: tuple[str, ...]
    stages: tuple[Stage, ...]
    cols: tuple[str, ...]
    back: int = 0
    fwd: int = 0

    def named(self, *names: str) -> "Recipe":
        """Same recipe with its outputs renamed."""
        mapping = dict(zip(self.out, names))
        last = lambda w: {n: F.col(o) for o, n in mapping.items()}
        return Recipe(tuple(names), (*self.stages, last), self.cols, self.back, self.fwd)


@dataclass(frozen=True)
class Timeline:
    """A numbered series: ``by`` keys, ``order`` keys and a gapless 1-based ``rn``."""

    df: DataFrame
    by: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts", "seq")
    chunk_rows: int = DEFAULT_CHUNK_ROWS
    settled: bool = False

    # ---------------------------------------------------------------- building
    @staticmethod
    def build(
        df: DataFrame,
        by: Sequence[str] = ("symbol",),
        order: Sequence[str] = ("ts", "seq"),
        chunk_rows: int = DEFAULT_CHUNK_ROWS,
        derive: Callable[[DataFrame], DataFrame] | None = None,
    ) -> "Timeline":
        """Number the rows of every key in order without a one-task window.

        The range shuffle evaluates ``df`` twice, first for the sample that sets its borders.
        ``derive`` gets the rows behind it and adds or replaces row-wise columns (not the keys), so
        that costly ones are evaluated once.

        A null key raises.  Rows of a key that are equal in ``order`` are numbered
        by a hash of the whole row, so repeated runs agree.

        A range shuffle sorts the table; within it ``monotonically_increasing_id``
        is partition * 2^33 + position, so counts per (partition, key) and their
        prefix give the row number.  Both passes must see the same placement,
        hence the written table in between.  The count table has at most
        (#partitions + #keys) rows.
        """
        by, order = tuple(by), tuple(order)
        tie = F.xxhash64(*(c for c, t in df.dtypes if "map<" not in t))
        ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order, tie)
        placed = materialize(
            (derive(ranged) if derive else ranged).withColumn("_mid", F.monotonically_increasing_id()),
            "timeline",
        ).withColumn("_pid", F.shiftright("_mid", 33))
        counts = placed.groupBy("_pid", *by).agg(
            F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")
        )
        before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        shift = materialize(
            counts.select(
                "_pid",
                *by,
                (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                "_n",
            ),
            "offsets",
        )
        nameless = shift.where(reduce(or_, (F.col(k).isNull() for k in by))).agg(F.sum("_n")).head()[0]
        if nameless:
            raise ValueError(f"{nameless} rows have a null among the keys {list(by)}")
        numbered = (
            placed.join(shift.drop("_n"), ["_pid", *by])
            .withColumn("rn", F.col("_mid") + F.col("_shift") + 1)
            .drop("_mid", "_pid", "_shift")
        )
        return Timeline(numbered, by, order, chunk_rows, True)

    def with_df(self, df: DataFrame, settled: bool = False) -> "Timeline":
        """Same numbering, other columns (``df`` keeps ``by`` and ``rn``)."""
        return Timeline(df, self.by, self.order, self.chunk_rows, settled)

    def extend(self, **cols: Column) -> "Timeline":
        """Add row-wise columns."""
        return self.with_df(self.df.withColumns(cols), self.settled)

    def narrow(self, *cols: str) -> "Timeline":
        """Only keys, row number and these columns."""
        return self.with_df(self.df.select(*self._keep(cols)), self.settled)

    def settle(self, cols: Iterable[str] | None = None) -> "Timeline":
        """Write a derived series once before an operator that reads it more than once.

        Without this every two-pass step would run all earlier steps twice, and a
        chain of them would double each time.  A series that is a scan with
        row-wise columns is left alone.
        """
        if self.settled:
            return self if cols is None else self.narrow(*cols)
        keep = self.df if cols is None else self.df.select(*self._keep(cols))
        return self.with_df(materialize(keep, "series"), True)

    # ------------------------------------------------------------------ pieces
    @property
    def chunk(self) -> Column:
        return F.expr(f"(rn - 1) div {self.chunk_rows}")

    def chunked(self, cols: Iterable[str] | None = None) -> DataFrame:
        """Rows with their chunk number ``_t`` (no copies)."""
        keep = self._keep(cols)
        return self.df.select(*keep, self.chunk.alias("_t"))

    def halo(self, cols: Iterable[str] | None = None, back: int = 0, fwd: int = 0) -> DataFrame:
        """Rows keyed by ``_t``; border rows are copied so each chunk sees ``back``/``fwd`` rows more."""
        keep = self._keep(cols)
        if back == 0 and fwd == 0:
            return self.df.select(*keep, self.chunk.alias("_t"), F.lit(True).alias("_core"))
        c = self.chunk_rows
        first = F.expr(f"greatest(0L, rn - 1 - {fwd}) div {c}")
        last = F.expr(f"(rn - 1 + {back}) div {c}")
        return self.df.select(*keep, F.explode(F.sequence(first, last)).alias("_t")).withColumn(
            "_core", F.col("_t") == self.chunk
        )

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by, "_t").orderBy("rn")

    def _keep(self, cols: Iterable[str] | None) -> list[str]:
        if cols is None:
            return list(self.df.columns)
        seen = dict.fromkeys([*self.by, "rn", *cols])
        return list(seen)

    # ---------------------------------------------------- bounded-reach windows
    def compute(
        self,
        *stages: Stage,
        cols: Iterable[str] | None = None,
        back: int = 0,
        fwd: int = 0,
    ) -> "Timeline":
        """Run window stages over chunk plus halo: one shuffle for all of them."""
        d = self.halo(cols, back, fwd)
        w = self.window()
        for stage in stages:
            d = d.withColumns(stage(w))
        return self.with_df(d.where("_core").drop("_core", "_t"))

    def apply(self, *recipes: Recipe, keep: Iterable[str] | None = None) -> "Timeline":
        """Evaluate recipes together; equal stage depth shares one window operator."""
        keep = list(self.df.columns) if keep is None else list(keep)
        need = dict.fromkeys([*keep, *(c for r in recipes for c in r.cols)])
        depth = max(len(r.stages) for r in recipes)

        def stage(i: int) -> Stage:
            def run(w: WindowSpec) -> dict[str, Column]:
                out: dict[str, Column] = {}
                for r in recipes:
                    if i < len(r.stages):
                        out.update(r.stages[i](w))
                return out

            return run

        done = self.compute(
            *(stage(i) for i in range(depth)),
            cols=[c for c in need if c not in (*self.by, "rn")],
            back=max(r.back for r in recipes),
            fwd=max(r.fwd for r in recipes),
        )
        outs = dict.fromkeys([*self.by, "rn", *keep, *(o for r in recipes for o in r.out)])
        return self.with_df(done.df.select(*outs))

    # ------------------------------------------------------------ chunk scans
    def map_chunks(
        self,
        fn: Callable,
        out: dict[str, str],
        cols: Iterable[str],
        back: int = 0,
        fwd: int = 0,
        keep: Iterable[str] = (),
        remember: bool = False,
        nonzero: Sequence[str] = (),
    ) -> "Timeline":
        """Arrow-batched helper per chunk: ``fn(pdf)`` gets rows in order and returns
        a dict of arrays (names and Spark types in ``out``); halo rows are dropped.

        With ``remember`` the chunk sees the last ``back`` *values* of every column
        before it (zeros do not count for ``nonzero`` columns), however far back they
        lie; rows without values in between are put back as empty rows, at most ``back`` in a run.
        """
        keep = [c for c in dict.fromkeys([*self.by, "rn", *keep])]
        cols = list(cols)
        d = self.values_halo(cols, keep, back, nonzero) if remember else self.halo([*cols, *keep], back, fwd)
        names = list(out)

        def run(pdf):
            pdf = pdf.sort_values("rn", kind="stable", ignore_index=True)
            core = pdf["_core"].to_numpy(bool)
            block = pdf.loc[core, keep].reset_index(drop=True)
            if remember:
                order = _with_gaps(pdf["rn"].to_numpy(), core, back)
                core = (order >= 0) & core[order]
                pdf = pdf[cols].reindex(order)
            res = fn(pdf)
            for n in names:
                block[n] = np.asarray(res[n])[core]
            return block

        fields = [d.schema[c] for c in keep]
        schema = T.StructType(
            fields + [T.StructField(n, T._parse_datatype_string(t)) for n, t in out.items()]
        )
        return self.with_df(d.groupBy(*self.by, "_t").applyInPandas(run, schema))

    def values_halo(self, cols: Sequence[str], keep: Sequence[str], back: int, nonzero: Sequence[str] = ()) -> DataFrame:
        """Rows keyed by ``_t`` where every chunk also gets the last ``back`` values of each column before it.

        Chunks are summarised by their number of values; a range window over the
        chunks that have any names, for each chunk, the ones that hold the last
        ``back`` values.  At most ``back`` rows per column are copied to a chunk,
        also where a run of nulls spans many chunks.
        """
        base = self.settle([*cols, *keep])
        rows, key = base.chunked(), [*self.by, "_t"]
        valued = {c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & ((F.col(c) != 0) | (F.col("rn") == 1) if c in nonzero else F.lit(True)) for c in cols}
        chunks = materialize(rows.groupBy(*key).agg(*(F.count_if(v).alias(f"_n_{c}") for c, v in valued.items())), "values")
        before = Window.partitionBy(*self.by).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
        copies = []
        for c, v in valued.items():
            so_far = chunks.select(*key, F.col(f"_n_{c}").alias("_n"), F.coalesce(F.sum(f"_n_{c}").over(before), F.lit(0)).alias("_v"))
            near = Window.partitionBy(*self.by).orderBy("_end").rangeBetween(-(back - 1), 0)
            full = so_far.where("_n > 0").withColumn("_end", F.col("_v") + F.col("_n"))
            full = full.select(*key, F.collect_list(F.struct(F.col("_t").alias("src"), F.col("_end").alias("end"))).over(near).alias("_near"))
            known = so_far.join(full, key, "left").select(*key, "_v", F.last("_near", ignorenulls=True).over(before).alias("_near"))
            pairs = known.select(*self.by, F.col("_t").alias("_to"), "_v", F.explode("_near").alias("_s"))
            pairs = pairs.select(*self.by, "_to", F.col("_s.src").alias("_t"), (back - F.col("_v") + F.col("_s.end")).alias("_most")).where("_most > 0")
            last = rows.where(v).withColumn("_j", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("rn")))).where(F.col("_j") <= back)
            copies.append(last.join(pairs, key).where("_j <= _most").drop("_t", "_j", "_most").withColumnRenamed("_to", "_t"))
        halo = reduce(DataFrame.unionByName, copies).dropDuplicates([*key, "rn"]).withColumn("_core", F.lit(False))
        return rows.withColumn("_core", F.lit(True)).unionByName(halo)

    # --------------------------------------------------------------- running
    def running(self, keep: Iterable[str] | None = None, **specs: tuple[str, str]) -> "Timeline":
        """Unbounded running aggregates that are exact across chunks.

        ``specs`` maps output name to (kind, column), kind one of ``sum count
        max min last first_after``: ``last`` is the last non-null value so far
        (forward fill), ``first_after`` the first non-null value from here on
        (backward fill).  Per chunk one aggregate row is made, a prefix runs
        over that table (rows / chunk_rows), and a window finishes the chunk.
        """
        keep = list(self.df.columns) if keep is None else list(keep)
        base = self.settle([*keep, *(c for _, c in specs.values())]).chunked()
        keys = [*self.by, "_t"]
        per = base.groupBy(*keys).agg(*(_total(k, c).alias(f"_a_{o}") for o, (k, c) in specs.items()))
        prev = Window.partitionBy(*self.by).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
        # looking ahead is a running last in descending order: an open-ended frame is rescanned per row
        nxt = Window.partitionBy(*self.by).orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, -1)
        carry = per.select(
            *keys,
            *(
                _prefix(k, F.col(f"_a_{o}"), prev, nxt).alias(f"_c_{o}")
                for o, (k, _) in specs.items()
            ),
        )
        w = self.window()
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy(*self.by, "_t").orderBy(F.desc("rn"))
        frm = down.rowsBetween(Window.unboundedPreceding, 0)
        joined = base.join(carry, keys)
        res = joined.withColumns(
            {o: _finish(k, F.col(c), F.col(f"_c_{o}"), upto, frm) for o, (k, c) in specs.items()}
        )
        return self.with_df(res.select(*dict.fromkeys([*self.by, "rn", *keep, *specs])))

    def rows_per_key(self) -> DataFrame:
        return self.df.groupBy(*self.by).agg(F.max("rn").alias("n_rows"))


def _with_gaps(rn: np.ndarray, core: np.ndarray, most: int) -> np.ndarray:
    """Row indices with -1 for every missing row between halo rows and up to the first core row, at most ``most`` in a run."""
    first = int(np.argmax(core)) if core.any() else len(rn)
    missing = np.zeros(len(rn), np.int64)
    missing[1 : first + 1] = np.minimum(np.diff(rn[: first + 1]) - 1, most)
    order = np.full(len(rn) + int(missing.sum()), -1, np.int64)
    order[np.arange(len(rn)) + np.cumsum(missing)] = np.arange(len(rn))
    return order


def _total(kind: str, c: str) -> Column:
    x = F.col(c)
    if kind == "last":
        return F.max_by(x, F.when(x.isNotNull(), F.col("rn")))
    if kind == "first_after":
        return F.min_by(x, F.when(x.isNotNull(), F.col("rn")))
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](x)


def _prefix(kind: str, a: Column, prev: WindowSpec, nxt: WindowSpec) -> Column:
    if kind == "last":
        return F.last(a, ignorenulls=True).over(prev)
    if kind == "first_after":
        return F.last(a, ignorenulls=True).over(nxt)
    if kind in ("sum", "count"):
        return F.sum(a).over(prev)
    return {"max": F.max, "min": F.min}[kind](a).over(prev)


def _finish(kind: str, x: Column, carry: Column, upto: WindowSpec, frm: WindowSpec) -> Column:
    if kind == "last":
        return F.coalesce(F.last(x, ignorenulls=True).over(upto), carry)
    if kind == "first_after":
        return F.coalesce(F.last(x, ignorenulls=True).over(frm), carry)
    if kind == "sum":
        local = F.sum(x).over(upto)
        return F.coalesce(local + carry, local, carry)
    if kind == "count":
        return F.count(x).over(upto) + F.coalesce(carry, F.lit(0))
    if kind == "max":
        return F.greatest(F.max(x).over(upto), carry)
    return F.least(F.min(x).over(upto), carry)
