"""Versioned Parquet tables that take changes, with one pointer.

A version adds a folder with the rows it puts into each table and the keys it
takes out. The pointer names the folders that make up every table; it's swapped
by an atomic rename once all files are written, so tables of a version belong
together, a crash leaves the version before, and a small change writes little.
Reading merges: a row counts unless a later folder takes its key out. Tables of
many folders are rewritten as one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import together

POINTER = "_CURRENT"


class SnapshotStore:
    """Tables by name under ``root``, any file system Spark can reach; ``keys`` names what changes go by."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, str] | None = None, merge: int = 8) -> None:
        self.spark, self.root, self.schemas, self.keys, self.merge = spark, root.rstrip("/"), schemas, keys or {}, merge
        self.hadoop = spark._jvm.org.apache.hadoop

    def _path(self, *parts: str):
        return self.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return bool(self._fs().exists(self._path(POINTER)))

    def manifest(self) -> dict:
        """version; parts and before: the folders of each table now and in the version before, as [version, whether it takes keys out]."""
        if not self.exists():
            return {"version": 0, "parts": {}, "before": {}}
        stream = self._fs().open(self._path(POINTER))
        try:
            return json.loads(stream.readLine())
        finally:
            stream.close()

    def version(self) -> int:
        return self.manifest()["version"]

    def _columns(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], self.schemas[name]).columns

    def read(self, name: str) -> DataFrame:
        """The table in the current version; empty before the first."""
        return self._merged(name, self.manifest()["parts"].get(name, []))

    def _merged(self, name: str, parts: list) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schemas[name])
        rows = gone = None
        for v, takes in parts:
            own = self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/v={v}/{name}/rows").withColumn("__v", F.lit(v))
            rows = own if rows is None else rows.unionByName(own)
            if takes:
                key = self.keys[name]
                kind = self.spark.createDataFrame([], self.schemas[name]).schema[key].dataType.simpleString()
                own = self.spark.read.schema(f"`{key}` {kind}").parquet(f"{self.root}/v={v}/{name}/gone").select(F.col(key).alias("__key"), F.lit(v).alias("__till"))
                gone = own if gone is None else gone.unionByName(own)
        if gone is not None:  # a folder's own rows come after what it takes out
            rows = rows.join(gone, rows[self.keys[name]].eqNullSafe(gone["__key"]) & (rows["__v"] < gone["__till"]), "left_anti")
        return rows.drop("__v")

    def write(self, tables: dict[str, DataFrame]) -> int:
        """The next version's number: these tables anew, others as they are."""
        return self._next({name: (df, None) for name, df in tables.items()})

    def apply(self, changes: dict[str, tuple[DataFrame, DataFrame]]) -> int:
        """The next version: for each table rows that come in, and keys whose earlier rows go; only those are written.

        ``keys`` are a table with a column of the table's key. A key may stand in both.
        """
        return self._next(changes)

    def _next(self, changes: dict[str, tuple[DataFrame, DataFrame | None]]) -> int:
        old = self.manifest()
        v, parts, writes = old["version"] + 1, dict(old["parts"]), []
        for name, (rows, gone) in changes.items():
            rows = rows.select(*[f"`{c}`" for c in self._columns(name)])
            held = parts.get(name, [])
            if gone is not None and len(held) >= self.merge:  # one folder again
                kept = delete(self._merged(name, held), gone, self.keys[name])
                rows, gone = kept.unionByName(rows), None
            writes.append((rows, f"{self.root}/v={v}/{name}/rows"))
            if gone is not None and held:
                writes.append((gone.select(self.keys[name]).distinct(), f"{self.root}/v={v}/{name}/gone"))
            parts[name] = [[v, False]] if gone is None or not held else [*held, [v, True]]
        together(self.spark, *[lambda df=df, to=to: df.write.mode("overwrite").parquet(to) for df, to in writes])
        self._point({"version": v, "parts": parts, "before": old["parts"]})
        stay = {(n, x) for p in (parts, old["parts"]) for n, folders in p.items() for x, _ in folders}
        for n, folders in old["before"].items():  # readers of the version before may still be at work
            for x, _ in folders:
                if (n, x) not in stay:
                    self._fs().delete(self._path(f"v={x}", n), True)
        return v

    def _point(self, manifest: dict) -> None:
        fs, fresh = self._fs(), self._path(f"{POINTER}.{manifest['version']}")
        out = fs.create(fresh, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        context = self.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration()) if self._path().toUri().getScheme() else \
            self.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        option = self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self.spark._sc._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = option.getEnumConstants()[1]  # OVERWRITE
        context.rename(fresh, self._path(POINTER), options)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """New rows replace old ones of the same key; of new rows with one key the last by ``order`` stays."""
    if order:
        columns = new.columns
        new = new.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*").select(*columns)
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of missing keys are no error."""
    return old.join(keys.select(key).distinct(), key, "left_anti").select(*old.columns)
