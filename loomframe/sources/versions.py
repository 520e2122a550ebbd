"""Versions of tables that are written together, by group: a reader sees all tables of one version or none of it.

    <path>/<table>/version=<n>/<group columns>/   rows of the groups that version n wrote, never changed afterwards
    <path>/groups/<n>/                            which version of each group counts in version n, for all groups
    <path>/pointers/<n>.json                      written last, by a rename: from then on n is the version to read

A version that fails before its pointer leaves files that nobody reads and that the next one with its number replaces. A group that
was written without rows is in groups but has no files, so it reads as empty. One writer at a time; a second one with the same
number fails at the pointer.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Versions that can be read again.
KEEP = 5


class Versions:
    """Tables named parts at path, of which the columns keys name the group of a row (all strings)."""

    def __init__(self, spark: SparkSession, path: str, parts: tuple[str, ...], keys: list[str]):
        self.spark, self.path, self.parts, self.keys = spark, path.rstrip("/"), parts, list(keys)
        self._map = ", ".join(f"{k} string" for k in self.keys) + ", version long"

    def _at(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Versions that have a pointer, the oldest first: KEEP of them and those not yet cleared."""
        path, fs = self._at("pointers")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _pointer(self, number: int) -> dict[str, StructType]:
        text = self.spark.read.text(f"{self.path}/pointers/{number}.json", wholetext=True).first().value
        return {part: StructType.fromJson(schema) for part, schema in json.loads(text)["schemas"].items()}

    def groups(self, number: int | None = None) -> DataFrame:
        """(keys, version): the version that holds each group's rows."""
        number = number if number is not None else (self.numbers() or [None])[-1]
        if number is None:
            return self.spark.createDataFrame([], self._map)
        return self.spark.read.schema(self._map).parquet(f"{self.path}/groups/{number}")

    def read(self, number: int | None = None, **only: str) -> dict[str, DataFrame]:
        """The tables as of a version (the newest, if not named), of the groups with the values only: their folders alone are listed in
        the plan, those of other versions are pruned by the join with groups."""
        number = number if number is not None else (self.numbers() or [None])[-1]
        if number is None:
            raise FileNotFoundError(f"no version at {self.path}")
        schemas, own = self._pointer(number), self.groups(number)
        for k, v in only.items():
            own = own.filter(F.col(k) == v)
        out = {}
        for part in self.parts:
            schema = StructType(schemas[part].fields).add("version", "long")
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
            for k, v in only.items():
                rows = rows.filter(F.col(k) == v)
            out[part] = rows.join(own, [*self.keys, "version"], "left_semi").select(*schemas[part].names)
        return out

    def _point(self, number: int, schemas: dict[str, StructType]) -> None:
        path, fs = self._at("pointers", f"{number}.json")
        half, _ = self._at("pointers", f"{uuid.uuid4().hex}.half")
        out = fs.create(half)
        out.write(json.dumps({"schemas": {part: json.loads(s.json()) for part, s in schemas.items()}}).encode())
        out.close()
        if fs.exists(path) or not fs.rename(half, path):
            raise FileExistsError(f"version {number} was written meanwhile")

    def write(self, tables: dict[str, DataFrame], groups: DataFrame | None = None) -> int:
        """A new version in which groups (those of the tables' rows, if not named) hold the tables' rows, and only those; other groups
        stay as they are. Its number."""
        number = (self.numbers() or [0])[-1] + 1
        named = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c).cast("string")).otherwise(F.raise_error(F.lit(f"{c} is missing")))
        tables = {part: tables[part].withColumns({k: named(k) for k in self.keys}) for part in self.parts}
        own = [groups] if groups is not None else tables.values()
        fresh = reduce(DataFrame.union, [df.select(*[named(k).alias(k) for k in self.keys]) for df in own]).distinct()
        schemas = {}
        for part, df in tables.items():
            rows = df if groups is None else df.join(fresh, self.keys, "left_semi")
            columns = [c for c in df.columns if c not in self.keys] + self.keys
            rows.select(*columns).write.partitionBy(*self.keys).mode("overwrite").parquet(f"{self.path}/{part}/version={number}")
            schemas[part] = df.select(*columns).schema
        kept = self.groups().join(fresh, self.keys, "left_anti")
        kept.unionByName(fresh.withColumn("version", F.lit(number).cast("long"))).write.mode("overwrite").parquet(f"{self.path}/groups/{number}")
        self._point(number, schemas)
        return number

    def restore(self, number: int, **only: str) -> int:
        """A new version in which the groups with the values only are as of an older version: no rows are copied."""
        new = self.numbers()[-1] + 1
        own, rest = self.groups(number), self.groups()
        for k, v in only.items():
            own = own.filter(F.col(k) == v)
        gone = F.lit(True)
        for k, v in only.items():
            gone = gone & (F.col(k) == v)
        own.unionByName(rest.filter(~gone)).write.mode("overwrite").parquet(f"{self.path}/groups/{new}")
        self._point(new, self._pointer(number))
        return new

    def clear(self, keep: int = KEEP) -> int:
        """Deletes all but the newest versions, and the groups' folders that only those had. How many folders went."""
        numbers = self.numbers()
        old, new = numbers[:-keep], numbers[-keep:]
        if not old:
            return 0
        maps = lambda some: self.spark.read.schema(self._map).parquet(*[f"{self.path}/groups/{n}" for n in some])
        for n in old:  # pointers first: nobody begins to read what goes
            path, fs = self._at("pointers", f"{n}.json")
            fs.delete(path, False)
        gone = maps(old).distinct().join(maps(new).distinct(), [*self.keys, "version"], "left_anti").toLocalIterator()
        count, folder = 0, self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        for row in gone:
            for part in self.parts:
                path, fs = self._at(part, f"version={row.version}", *[folder(k, row[k]) for k in self.keys])
                count += bool(fs.delete(path, True))
        for n in old:
            path, fs = self._at("groups", str(n))
            fs.delete(path, True)
        return count
