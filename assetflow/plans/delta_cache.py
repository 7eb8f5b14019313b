"""A cache that a refresh extends instead of rewriting: row parts, key tombstones, manifests.

Folder layout::

    <root>/rows-<id>/       results of one refresh (Parquet)
    <root>/gone-<id>/       keys that a refresh dropped or replaced
    <root>/_manifest/<version>.json   the parts of a version, in order

A tombstone of version n hides rows of earlier versions with its key.  A version exists
once its manifest does: it is written aside and renamed, and the rename fails if another
writer was faster, so readers see a whole version or the one before.  A refresh writes the
new rows and the dropped keys only; ``compact`` folds all parts into one, ``vacuum``
deletes the folders that no kept version names.
"""

from __future__ import annotations

import json
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from assetflow.plans.cache import CACHE_KEYS
from assetflow.session import scratch_table

MAX_PARTS = 16        # parts after which a refresh compacts


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class DeltaCache:
    """The cache below ``root``; rows are unique by ``keys``, which must not be null."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys=CACHE_KEYS):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, list(keys)

    # --- manifests -------------------------------------------------------------

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("_manifest").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("_manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def parts(self, version: int | None = None) -> list[dict]:
        """``{"kind", "folder", "version", "rows"}`` of the parts of a version, the newest by default."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return []
        stream = self._fs().open(self._path(f"_manifest/{version:08d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, parts: list[dict]) -> int:
        fs = self._fs()
        aside, final = self._path(f"_manifest/.{uuid.uuid4().hex}"), self._path(f"_manifest/{version:08d}.json")
        fs.mkdirs(self._path("_manifest"))
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, False)
            raise Conflict(f"version {version} of {self.root} exists")
        return version

    def _write(self, df: DataFrame, kind: str, version: int) -> list[dict]:
        """Write a part; none if there are no rows."""
        folder = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        many = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}").count()
        if not many:
            self._fs().delete(self._path(folder), True)
            return []
        return [{"kind": kind, "folder": folder, "version": version, "rows": many}]

    # --- rows ------------------------------------------------------------------

    def _union(self, kind: str, schema: StructType, parts: list[dict]) -> DataFrame:
        marked = StructType([*schema.fields, StructField("__version", IntegerType())])
        out = self.spark.createDataFrame([], marked)
        for p in parts:
            if p["kind"] == kind:
                out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.root}/{p['folder']}").withColumn("__version", F.lit(p["version"])))
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; an empty frame if there is none."""
        parts = self.parts(version)
        rows = self._union("rows", self.schema, parts)
        if any(p["kind"] == "gone" for p in parts):
            key = StructType([self.schema[k] for k in self.keys])
            gone = self._union("gone", key, parts).groupBy(*self.keys).agg(F.max("__version").alias("__gone"))
            rows = rows.join(gone.withColumnsRenamed({k: f"__{k}" for k in self.keys}), self._same() & (F.col("__gone") > F.col("__version")), "left_anti")
        return rows.drop("__version")

    def _same(self):
        cond = F.lit(True)
        for k in self.keys:
            cond = cond & (F.col(k) == F.col(f"__{k}"))
        return cond

    def refresh(self, current: DataFrame, compute: Callable[[DataFrame], DataFrame], complete: Callable[[DataFrame], DataFrame] | None = None,
                max_parts: int = MAX_PARTS) -> int:
        """Bring the cache to the files of ``current``; returns the version.

        Rows whose keys are gone are dropped; ``compute`` gets the rows of ``current`` without a
        (``complete``) cached row.  Keys are compared before anything else of ``current`` is read, so
        with few misses its other columns are not shuffled.
        """
        k = self.keys
        version = max(self.versions(), default=0) + 1
        old = self.read()
        have = old.select(*k)
        usable = (complete(old) if complete else old).select(*k)
        here = current.select(*k).distinct()
        missing = scratch_table(here.join(usable, k, "left_anti"), "delta-misses")
        fresh = compute(current.join(missing, k, "left_semi")).select(*self.schema.names)
        stale = have.join(here, k, "left_anti").unionByName(have.join(missing, k, "left_semi"))
        parts = self.parts() + self._write(fresh, "rows", version) + self._write(stale, "gone", version)
        self._commit(version, parts)
        return self.compact() if len(parts) > max_parts else version

    def compact(self) -> int:
        """One part with the rows of the newest version, as a version of its own."""
        version = max(self.versions(), default=0) + 1
        return self._commit(version, self._write(self.read(), "rows", version))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Forget all but the newest ``keep`` versions and delete the folders that none of them names.

        Not to be run beside a refresh: its parts are named by a manifest only at the end.
        """
        fs, versions = self._fs(), self.versions()
        kept = {p["folder"] for v in versions[-keep:] for p in self.parts(v)}
        for v in versions[:-keep]:
            fs.delete(self._path(f"_manifest/{v:08d}.json"), False)
        names = [s.getPath().getName() for s in fs.listStatus(self._path(""))] if versions else []
        dead = sorted(n for n in names if n.split("-")[0] in ("rows", "gone") and n not in kept)
        for n in dead:
            fs.delete(self._path(n), True)
        return dead
