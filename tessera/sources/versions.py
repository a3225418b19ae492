"""Tables that are written by partitions and published by manifests, so that a reader sees a write whole or not at all.

A table's rows are dealt into buckets by a hash of their keys.  Each write makes new files for the buckets that it touches, then a manifest that names the folder
of every bucket; to publish is to give that manifest the next number, which a store does at once and only once.  A write that dies before leaves files that no manifest names
(``vacuum`` deletes them) and the old table; of two writers the second fails and may try again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dml


class Conflict(RuntimeError):
    """Another write was published first."""


class Versioned:
    """A table at a path, with its keys and how many buckets it has."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop.Path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def version(self) -> int:
        """The number of the last manifest; 0 before any."""
        return max((int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"schema": ..., "files": {bucket: folder}} of a version, the last if none is given."""
        n = self.version() if version is None else version
        if not n:
            return {"schema": None, "files": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{n:010d}.json").collect()))

    def _publish(self, manifest: dict, version: int) -> None:
        draft = self._hadoop.Path(f"{self.path}/drafts/{uuid.uuid4().hex}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(self._hadoop.Path(f"{self.path}/manifests"))
        target = self._hadoop.Path(f"{self.path}/manifests/{version:010d}.json")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise Conflict(f"version {version} of {self.path} is another write's")

    def _read(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = self.spark.createDataFrame([], manifest["schema"]).schema
        folders = [f for b, f in manifest["files"].items() if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last if none is given; later writes do not change what a reader has begun."""
        return self._read(self.manifest(version))

    def create(self, rows: DataFrame) -> None:
        """The first version."""
        self._write(rows, {"schema": rows.schema.simpleString().removeprefix("struct<").removesuffix(">"), "files": {}}, 1)

    def _write(self, rows: DataFrame, manifest: dict, version: int) -> None:
        """New files for the buckets of ``rows``, whose old files the next version leaves out."""
        write = uuid.uuid4().hex
        dealt = rows.withColumn("__bucket", self._bucket())
        dealt.repartition(self.buckets, "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{write}")
        made = [int(n.partition("=")[2]) for n in self._names(f"data/{write}") if n.startswith("__bucket=")]
        self._publish({"schema": manifest["schema"], "files": manifest["files"] | {str(b): f"{write}/__bucket={b}" for b in made}}, version)

    def upsert(self, source: DataFrame, guard: Callable[[], Column] | None = None) -> None:
        """Source rows replace those with their keys (where the guard over t.* and s.* holds) or are added; only buckets that they fall into are read and written."""
        version = self.version()
        manifest = self.manifest(version)
        touched = [r[0] for r in source.select(self._bucket().alias("b")).distinct().collect()]  # at most as many as there are buckets
        if touched:
            self._write(dml.upsert(self._read(manifest, touched), source, self.keys, guard), manifest, version + 1)

    def vacuum(self) -> list[str]:
        """Delete the folders of writes that no manifest names, and give their names; no write may run meanwhile."""
        named = {f.partition("/")[0] for v in range(1, self.version() + 1) for f in self.manifest(v)["files"].values()}
        lost = sorted(set(self._names("data")) - named)
        for n in lost:
            self._fs.delete(self._hadoop.Path(f"{self.path}/data/{n}"), True)
        return lost
