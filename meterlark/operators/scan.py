"""A segmented scan: what window functions over a whole key would give, in tasks no larger than a bucket of time of one key.

A series is cut into buckets of time within its key. Each step is a window function inside a bucket, and a second small
pass carries over what the bucket needs from those before it: the last row, the first row after it, sums, counts and
last known values. What is carried is one row for each key and bucket with rows, folded map-side, so a key with a long
history is as many tasks as it has buckets; only the rows of one bucket of one key are ever sorted together.

Within a key rows are ordered by time and then by `ties`; keys hold no nulls. All steps of a scan work on the same
distribution of the rows, which is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


class Scan:
    """Steps over a series; each gives a new Scan, frame() the rows with the columns they made."""

    def __init__(self, df: DataFrame, keys: Sequence[str], time: str = "us", width_us: int = DAY_US, ties: Sequence[str] = ()):
        self.keys, self.time, self.width_us, self.ties = [*keys], time, width_us, [*ties]
        self.df = df.withColumn("_b", F.floor(F.col(time) / width_us))

    def _on(self, df: DataFrame) -> Scan:
        out = Scan.__new__(Scan)
        out.__dict__.update(self.__dict__)
        out.df = df
        return out

    @property
    def _order(self) -> list[str]:
        return [self.time, *self.ties]

    @property
    def _inside(self):
        return Window.partitionBy(*self.keys, "_b").orderBy(*self._order)

    @property
    def _across(self):
        return Window.partitionBy(*self.keys).orderBy("_b")

    def _of_buckets(self, **facts: Column) -> DataFrame:
        return self.df.groupBy(*self.keys, "_b").agg(*[c.alias(name) for name, c in facts.items()])

    def _neighbour(self, columns: dict[str, str], before: bool) -> Scan:
        row = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
        end = F.max_by if before else F.min_by
        step = F.lag if before else F.lead
        carried = self._of_buckets(_end=end(row, F.struct(*self._order))).select(*self.keys, "_b", step("_end").over(self._across).alias("_carried"))
        near = self.df.withColumn("_near", step(row).over(self._inside)).join(carried, [*self.keys, "_b"], "left")
        # The first row of a bucket has no neighbour in it; a neighbour's struct is never null.
        found = F.coalesce("_near", "_carried")
        return self._on(near.withColumns({new: found[new] for new in columns}).drop("_near", "_carried"))

    def lag(self, **columns: str) -> Scan:
        """new=old: the value of a column in the row before, null in the first row of a key."""
        return self._neighbour(columns, True)

    def lead(self, **columns: str) -> Scan:
        """new=old: the value of a column in the row after, null in the last row of a key."""
        return self._neighbour(columns, False)

    def running(self, **sums: Column) -> Scan:
        """new=expression: its sum over the key's rows up to this one; null counts as nothing."""
        put = {f"_t_{name}": F.coalesce(c, F.lit(0)) for name, c in sums.items()}
        staged = self._on(self.df.withColumns(put))
        totals = staged._of_buckets(**{f"_s_{name}": F.sum(f"_t_{name}") for name in sums})
        before = self._across.rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(*self.keys, "_b", *[F.sum(f"_s_{name}").over(before).alias(f"_c_{name}") for name in sums])
        within = self._inside.rowsBetween(Window.unboundedPreceding, 0)
        both = staged.df.withColumns({f"_r_{name}": F.sum(f"_t_{name}").over(within) for name in sums}).join(carried, [*self.keys, "_b"], "left")
        out = both.withColumns({name: F.col(f"_r_{name}") + F.coalesce(f"_c_{name}", F.lit(0)) for name in sums})
        return self._on(out.drop(*[f"_{k}_{name}" for name in sums for k in "trc"]))

    def last(self, before: bool = False, **columns: str) -> Scan:
        """new=old: the latest value that is not null, of the rows up to this one or, with before, of earlier rows."""
        ends = {f"_e_{new}": F.max_by(old, F.when(F.col(old).isNotNull(), F.struct(*self._order))) for new, old in columns.items()}
        past = self._across.rowsBetween(Window.unboundedPreceding, -1)
        carried = self._of_buckets(**ends).select(*self.keys, "_b", *[F.last(f"_e_{new}", ignorenulls=True).over(past).alias(f"_c_{new}") for new in columns])
        within = self._inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        both = self.df.withColumns({f"_r_{new}": F.last(old, ignorenulls=True).over(within) for new, old in columns.items()}).join(carried, [*self.keys, "_b"], "left")
        out = both.withColumns({new: F.coalesce(f"_r_{new}", f"_c_{new}") for new in columns})
        return self._on(out.drop(*[f"_{k}_{new}" for new in columns for k in "rc"]))

    def extreme(self, **columns: Column) -> Scan:
        """new=expression: its greatest value over the key's rows up to this one."""
        tops = {f"_e_{new}": F.max(c) for new, c in columns.items()}
        past = self._across.rowsBetween(Window.unboundedPreceding, -1)
        carried = self._of_buckets(**tops).select(*self.keys, "_b", *[F.max(f"_e_{new}").over(past).alias(f"_c_{new}") for new in columns])
        within = self._inside.rowsBetween(Window.unboundedPreceding, 0)
        both = self.df.withColumns({f"_r_{new}": F.max(c).over(within) for new, c in columns.items()}).join(carried, [*self.keys, "_b"], "left")
        out = both.withColumns({new: F.greatest(f"_r_{new}", f"_c_{new}") for new in columns})
        return self._on(out.drop(*[f"_{k}_{new}" for new in columns for k in "rc"]))

    def derive(self, **columns: Column) -> Scan:
        """Columns computed from a row alone."""
        return self._on(self.df.withColumns(columns))

    def runs(self, prev: dict[str, str], **starts: Column) -> Scan:
        """lag(**prev) and, by those columns and the row's own, name=condition: how many rows up to this one fulfil it.

        One pass for both: only the first row of a bucket waits for what is carried, so a bucket tells its first and
        last row and how many of the others start a run. Numbers count from 0; null is no start.
        """
        row = F.struct(*[F.col(old).alias(new) for new, old in prev.items()])
        near = self.df.withColumns({"_near": F.lag(row).over(self._inside), "_i": F.row_number().over(self._inside)})
        near = near.withColumns({new: F.col("_near")[new] for new in prev})
        flag = lambda c: F.when(c, F.lit(1)).otherwise(0)
        near = near.withColumns({f"_f_{name}": F.when(F.col("_i") > 1, flag(c)).otherwise(0) for name, c in starts.items()})
        order = F.struct(*self._order)
        # Nested, so that what a bucket tells has names of its own.
        told = near.groupBy(*self.keys, "_b").agg(F.max_by(row, order).alias("_end"), F.min_by(F.struct(*self.df.columns), order).alias("_head"), *[F.sum(f"_f_{name}").alias(f"_n_{name}") for name in starts])
        carried = told.withColumn("_carried", F.lag("_end").over(self._across))
        heads = carried.select("_b", "_carried", *[f"_n_{name}" for name in starts], *[F.col("_head")[c].alias(c) for c in self.df.columns if c != "_b"], *[F.col("_carried")[new].alias(new) for new in prev])
        first = heads.withColumns({f"_h_{name}": flag(c) for name, c in starts.items()})
        past = self._across.rowsBetween(Window.unboundedPreceding, -1)
        offsets = {f"_c_{name}": F.col(f"_h_{name}") + F.coalesce(F.sum(F.col(f"_h_{name}") + F.col(f"_n_{name}")).over(past), F.lit(0)) for name in starts}
        both = near.drop(*prev).join(first.withColumns(offsets).select(*self.keys, "_b", "_carried", *offsets), [*self.keys, "_b"], "left")
        within = self._inside.rowsBetween(Window.unboundedPreceding, 0)
        found = F.coalesce("_near", "_carried")
        out = both.withColumns({new: found[new] for new in prev} | {name: F.sum(f"_f_{name}").over(within) + F.col(f"_c_{name}") for name in starts})
        return self._on(out.drop("_near", "_i", "_carried", *[f"_{k}_{name}" for name in starts for k in "fc"]))

    def frame(self) -> DataFrame:
        return self.df.drop("_b")
