"""Pages of an order without sorting all of it for each page.

The order is worked out once: rows are dealt to ranges of it and stored, with how many each range holds. A page is then read from
the one or two ranges that hold it; and the page after a given row is read by its key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.sources.shared import new_path

#: Rows of a range, about, and the most ranges: each is a task and a folder that the driver hears of, so larger orders have larger ranges.
RANGE_ROWS, RANGES = 50_000, 256


class Order:
    """rows in the order of keys (names to columns, all ascending or desc() by name), which together tell rows apart."""

    def __init__(self, rows: DataFrame, keys: dict[str, Column], down: tuple[str, ...] = (), range_rows: int = RANGE_ROWS):
        self.columns, self.names, self.down = rows.columns, [f"__key_{k}" for k in keys], {f"__key_{k}" for k in down}
        self.spark, self.path = rows.sparkSession, new_path(rows.sparkSession, "order")
        keyed = rows.withColumns({f"__key_{k}": c for k, c in keys.items()})
        parts = min(RANGES, max(1, math.ceil(keyed.count() / range_rows)))
        # nulls last upwards, and last downwards too: what is not known comes at the end
        dealt = keyed.repartitionByRange(parts, *self._order()).withColumn("__range", F.spark_partition_id())
        dealt.write.partitionBy("__range").parquet(self.path)
        self.schema = dealt.schema
        counts = self.spark.read.schema(self.schema).parquet(self.path).groupBy("__range").agg(F.count("*").alias("n"))
        self.counts = sorted((r["__range"], r.n) for r in counts.collect())  # one row a range
        self.total = sum(n for _, n in self.counts)

    def _order(self) -> list[Column]:
        return [F.desc_nulls_last(n) if n in self.down else F.asc_nulls_last(n) for n in self.names]

    def _read(self, ranges: list[int]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).filter(F.col("__range").isin(ranges))

    def pages(self, size: int) -> int:
        return max(1, math.ceil(self.total / max(1, size)))

    def ranges_of(self, number: int, size: int) -> tuple[list[int], int]:
        """The ranges that hold a page (from 1), and how many of their rows come before it."""
        start, before, own, skip = max(0, number - 1) * max(1, size), 0, [], 0
        for part, n in self.counts:
            if before < start + size and before + n > start:
                skip = max(0, start - before) if not own else skip
                own.append(part)
            before += n
        return own, skip

    def page(self, number: int, size: int) -> DataFrame:
        """The page's rows; a page behind the last has none."""
        own, skip = self.ranges_of(number, size)
        return self._read(own).orderBy(*self._order()).offset(skip).limit(size).select(*self.columns)

    def after(self, key: dict[str, object] | None, size: int) -> tuple[DataFrame, dict[str, object] | None]:
        """(rows, key): the next rows behind a row's key (from the first, if none) and the key of the last of them, None at the end. Only
        the ranges from the key's on are read, and of them as many as hold the rows."""
        rows, start = None, 0
        if key is None:
            own = [p for p, _ in self.counts]
        else:
            later, equal = F.lit(False), F.lit(True)
            for n in self.names:
                value = F.lit(key[n]).cast(self.schema[n].dataType)
                more = F.col(n) < value if n in self.down else F.col(n) > value
                more = F.lit(False) if key[n] is None else more | F.col(n).isNull()
                later = later | (equal & F.coalesce(more, F.lit(False)))
                equal = equal & F.col(n).eqNullSafe(value)
            at = self.spark.read.schema(self.schema).parquet(self.path).filter(equal).agg(F.min("__range")).first()[0]
            start = at if at is not None else 0
            own, rows = [p for p, _ in self.counts if p >= start], later
        for k in range(1, len(own) + 1):
            some = self._read(own[:k])
            some = some.filter(rows) if rows is not None else some
            found = some.orderBy(*self._order()).limit(size)
            last = found.agg(F.count("*").alias("n")).first().n
            if last == size or k == len(own):
                tail = found.orderBy(*[F.asc_nulls_first(n) if n in self.down else F.desc_nulls_first(n) for n in self.names]).select(*self.names).first() if last == size else None
                return found.select(*self.columns), tail.asDict() if tail else None
        return self._read([]).select(*self.columns), None
