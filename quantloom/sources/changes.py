"""A table kept as a log of changes in versions: append, remove, read as of a version, compact.

Each version is a folder of changes: a row (key and value columns, op, seq) puts or removes the row of its key. The state as of a version is
the last change of each key up to it: one aggregation over the last compacted state and the changes after it, of which only the folders between are
read. Compaction writes the state as of a version to a folder of its own and removes what it replaces, so folders stay few. Writing a version
again replaces it, so that a batch of a stream that is run twice changes nothing. One writer at a time is assumed, and compaction keeps a
number of versions for readers that are still at work. A version that was not written is like the one before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.sources import files


class ChangeTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.schema = spark.createDataFrame([], schema).schema
        self.values = [c for c in self.schema.names if c not in self.keys]
        self.stored = StructType([*self.schema.fields]).add("op", "string").add("seq", "long").add("version", "integer")

    def _versions(self, kind: str) -> list[int]:
        return sorted(int(n.removeprefix("version=")) for n in files.complete(self.spark, f"{self.path}/{kind}"))

    def folders(self) -> int:
        return len(self._versions("changes")) + len(self._versions("state"))

    def version(self) -> int:
        """The last one written; -1 before any."""
        return max([*self._versions("changes"), *self._versions("state")], default=-1)

    def write(self, changes: DataFrame, version: int | None = None, op: Column | str = "put", seq: Column | None = None) -> int:
        """Changes as a version, by default the next one. op is 'put' or 'remove'; of several changes of a key the last by seq counts, and without seq it must have one.

        A change takes the whole row of its key; removing needs the key columns only. A version that a compaction holds already is left as it is.
        """
        version = self.version() + 1 if version is None else version
        if version <= max(self._versions("state"), default=-1):
            return version
        known = [F.col(c).cast(self.schema[c].dataType) if c in changes.columns else F.lit(None).cast(self.schema[c].dataType) for c in self.schema.names]
        rows = changes.select(*[v.alias(c) for v, c in zip(known, self.schema.names, strict=True)], (F.lit(op) if isinstance(op, str) else op).alias("op"), (F.lit(0) if seq is None else seq).cast("long").alias("seq"))
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/version={version}")
        return version

    def as_of(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, by default the last; raises if a compaction has replaced it."""
        states = self._versions("state")
        last = self.version() if version is None else version
        base = max((s for s in states if s <= last), default=None)
        if base is None and states:
            raise ValueError(f"version {last} is compacted; {min(states)} is the first that is kept")
        paths = [f"{self.path}/changes/version={v}" for v in self._versions("changes") if (base is None or v > base) and v <= last]
        rows = self.spark.createDataFrame([], self.stored) if base is None else self._read([f"{self.path}/state/version={base}"], "state")
        if paths:
            rows = rows.unionByName(self._read(paths, "changes"))
        # Structs compare from the left; nulls of values stay as they are.
        latest = F.max_by(F.struct("op", *self.values), F.struct("version", "seq"))
        return rows.groupBy(*self.keys).agg(latest.alias("_row")).where("_row.op = 'put'").select(*self.keys, *[F.col("_row")[c].alias(c) for c in self.values]).select(*self.schema.names)

    def _read(self, paths: list[str], kind: str) -> DataFrame:
        return self.spark.read.schema(self.stored).option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def compact(self, keep: int = 0) -> None:
        """Write the state as of the version ``keep`` before the last, and remove the changes and states that it replaces."""
        upto = self.version() - keep
        if upto >= 0 and upto not in self._versions("state"):
            rows = self.as_of(upto).select("*", F.lit("put").alias("op"), F.lit(0).cast("long").alias("seq"))
            rows.write.mode("overwrite").parquet(f"{self.path}/state/version={upto}")
        for kind, old in (("changes", lambda v: v <= upto), ("state", lambda v: v < upto)):
            for v in filter(old, self._versions(kind)):
                files.remove(self.spark, f"{self.path}/{kind}/version={v}")
