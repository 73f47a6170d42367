"""Keyed caches: tables whose rows are put in place of those with the same key, read while they are written.

A cache is a folder of Parquet files in buckets by a hash of the key, and a manifest that names the version of each bucket. Putting
rows rewrites only the buckets that their keys fall into, as a new version, and then replaces the manifest in one rename: readers see all of
it or nothing, and a writer that fails leaves files that no manifest names. Versions that were replaced are deleted one
put later, so that a reader that has just read the manifest can still read them. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import filesystem, kept

MANIFEST = "_manifest.json"


class Cache:
    """``schema`` of all columns, ``keys`` among them; null keys are keys. The number of buckets is fixed when the first rows are put."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def manifest(self) -> dict:
        """buckets: how many; of: the folder of each that has rows; old: folders that the last put replaced."""
        fs, at = filesystem(self.spark, f"{self.path}/{MANIFEST}")
        if not fs.exists(at):
            return {"buckets": self.buckets, "of": {}, "old": []}
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _replace(self, manifest: dict) -> None:
        fs, new = filesystem(self.spark, f"{self.path}/_manifest-{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm.org.apache.hadoop
        context = jvm.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.fs.Options.Rename, 1)
        overwrite[0] = jvm.fs.Options.Rename.OVERWRITE
        context.rename(new, jvm.fs.Path(f"{self.path}/{MANIFEST}"), overwrite)

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, only: DataFrame | None = None) -> DataFrame:
        """All rows; with ``only``, a table of keys, those of their buckets alone (all that a join by key needs)."""
        manifest = self.manifest()
        of = manifest["of"]
        if only is not None:
            wanted = {str(r[0]) for r in only.select(self._bucket(manifest["buckets"])).distinct().collect()}  # a number for each bucket at most
            of = {b: f for b, f in of.items() if b in wanted}
        return self._read(sorted(of.values()))

    def put(self, rows: DataFrame, latest: str | None = None) -> None:
        """Rows take the place of those with their keys; of several new ones with a key, the one with the greatest ``latest``, else the greatest by all columns."""
        names = [f.name for f in self._read([]).schema]
        manifest = self.manifest()
        n = manifest["buckets"]
        rows = rows.select(*names, *([F.col(latest).alias("_latest")] if latest and latest not in names else []))
        rest = [c for c in names if c not in self.keys]
        by = [latest if latest in names else "_latest"] if latest else []
        best = rows.groupBy(*self.keys).agg(F.max(F.struct(*(F.col(b).alias("_by") for b in by), *rest)).alias("_best")).select(*self.keys, *(F.col("_best")[c].alias(c) for c in rest)).select(*names)
        new = kept(best.withColumn("_bucket", self._bucket(n)))
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
        if not touched:
            return
        before = self._read([manifest["of"][str(b)] for b in touched if str(b) in manifest["of"]]).withColumn("_bucket", self._bucket(n))
        same = reduce(lambda a, b: a & b, (before[k].eqNullSafe(new[k]) for k in self.keys))
        stay = before.join(new, same, "left_anti")
        version = f"v-{uuid.uuid4().hex}"
        stay.unionByName(new).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{version}")
        fs, _ = filesystem(self.spark, self.path)
        of = {**manifest["of"], **{str(b): f"{version}/_bucket={b}" for b in touched}}
        replaced = [manifest["of"][str(b)] for b in touched if str(b) in manifest["of"]]
        self._replace({"buckets": n, "of": of, "old": replaced})
        for folder in manifest["old"]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}"), True)
