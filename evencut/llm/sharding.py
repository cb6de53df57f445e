"""Sharded storage with size-tiered compaction and a versioned manifest; DataFrame operations only.

append() writes an arrival as small immutable shards, one for each input partition, without a shuffle.
compact() takes the shards below half the target size, puts them into tiers of similar size, and merges
each tier that has enough of them into files of about the target size; coalescing similar sizes needs no
shuffle either. Every change is a new version of the manifest: it is written aside and renamed into
place, and the rename fails if the version exists; then the change is made anew on the version that
came first (a compaction whose shards are gone by then raises VersionTaken, and nothing is lost). Before a
compaction is committed, the number of rows and the sum of row hashes of its output must equal those of its
input. Readers see whole versions only; files of older versions stay until vacuum().

A writer claims its folder before it writes there and lets go after the commit; vacuum() lists folders first,
then claims, then manifests, so a folder that a commit is still to name is never deleted. A claim that a
lost driver left behind counts for STALE_HOURS.

Any rows, nulls, repeated rows, texts of any length and columns are kept as they are; an empty append commits a version
without new shards, reading an empty store gives an empty table. Columns are never added to the rows,
so no name can clash. The driver holds the names of the files of a version, as it does for any table that Spark reads.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET, MIN_RUNS, GROWTH, BASE = 64 << 20, 4, 4, 1 << 20
ARRIVALS, STALE_HOURS, TRIES = 4, 24, 20
PAGE = 10_000  # shards that one merge job takes: what the driver holds of the manifest
MANIFEST = "path string, rows long, bytes long, check decimal(38,0), first_id string, born long"


class VersionTaken(RuntimeError):
    """Another writer committed this version of the manifest first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        at = self._at(f"{self.root}/_manifest")
        found = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(x[1:]) for x in found if x.startswith("v"))

    def manifest(self, version: int | None = None) -> DataFrame:
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/_manifest/v{versions[-1] if version is None else version:08d}")

    def _commit(self, rows: DataFrame, version: int) -> int:
        aside, to = f"{self.root}/_manifest/.new-{uuid.uuid4().hex}", f"{self.root}/_manifest/v{version:08d}"
        rows.write.parquet(aside)
        gateway, jvm = self.spark.sparkContext._gateway, self.spark.sparkContext._jvm
        none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.root).toUri(), self._conf).rename(self._at(aside), self._at(to), none)
        except Py4JJavaError as e:
            self._fs.delete(self._at(aside), True)
            if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            raise VersionTaken(to) from e
        return version

    def _change(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """Commits change(manifest) as the next version, anew if another writer was first."""
        for left in range(TRIES - 1, -1, -1):
            version = (self.versions() or [0])[-1]
            try:
                return self._commit(change(self.manifest(version) if version else self.manifest()), version + 1)
            except VersionTaken:
                if not left:
                    raise
        raise AssertionError("unreachable")

    def _claim(self, tag: str) -> str:
        """The name of a folder that no vacuum deletes until it is let go."""
        folder = f"{tag}-{uuid.uuid4().hex}"
        self._fs.create(self._at(f"{self.root}/_claims/{folder}")).close()
        return folder

    def _let_go(self, folder: str) -> None:
        self._fs.delete(self._at(f"{self.root}/_claims/{folder}"), False)

    def _claims(self) -> set[str]:
        at, since = self._at(f"{self.root}/_claims"), (time.time() - STALE_HOURS * 3600) * 1000
        return {s.getPath().getName() for s in self._fs.listStatus(at) if s.getModificationTime() > since} if self._fs.exists(at) else set()

    def _write(self, df: DataFrame, folder: str, born: int) -> DataFrame:
        """Manifest rows of the files that df is written to."""
        path = f"{self.root}/data/{folder}"
        df.write.option("compression", "zstd").parquet(path)
        return self._describe(path, df.schema, born)

    def _describe(self, path: str, schema, born: int) -> DataFrame:
        back = self.spark.read.schema(schema).parquet(path)
        first = F.col(f"`{schema.names[0]}`") if schema.names else F.lit(None)
        check = F.xxhash64(*[F.col(f"`{c}`") for c in schema.names]).cast("decimal(38,0)")
        meta = back.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), check.alias("h"), first.cast("string").alias("id"))
        found = meta.groupBy("path", "bytes").agg(F.count("*").alias("rows"), F.sum("h").alias("check"), F.min("id").alias("first_id"))
        return found.select("path", "rows", "bytes", "check", "first_id", F.lit(born).cast("long").alias("born"))

    def append(self, df: DataFrame) -> int:
        """Adds the rows of df as small shards; the new version."""
        folder = self._claim("arrival")
        try:
            new = self._write(df, folder, (self.versions() or [0])[-1] + 1)
            return self._change(lambda manifest: manifest.unionByName(new))
        finally:
            self._let_go(folder)

    def tiers(self, target: int = TARGET) -> DataFrame:
        """The manifest with each shard's tier: powers of GROWTH above BASE; null from half the target on."""
        tier = F.floor(F.log(F.greatest(F.lit(1.0), F.col("bytes") / BASE)) / F.log(F.lit(float(GROWTH))))
        return self.manifest().withColumn("tier", F.when(F.col("bytes") < target // 2, tier.cast("int")))

    def compact(self, schema, target: int = TARGET, min_runs: int = MIN_RUNS) -> int:
        """Merges each tier with min_runs shards or more, PAGE shards at a time; the new version, or the current one if nothing is to merge."""
        marked = self.tiers(target)
        due = {r.tier: r.n for r in marked.filter("tier is not null").groupBy("tier").agg(F.count("*").alias("n")).collect() if r.n >= min_runs}
        if not due:
            return (self.versions() or [0])[-1]
        born, folders, gone, merged = self.versions()[-1] + 1, [], [], []
        try:
            for tier in sorted(due):
                after = ""
                while page := marked.filter((F.col("tier") == tier) & (F.col("path") > after)).orderBy("path").limit(PAGE).collect():
                    after = page[-1].path
                    files, size = [r.path for r in page], sum(r.bytes for r in page)
                    folders.append(self._claim(f"tier{tier}"))
                    rows = self.spark.read.schema(schema).parquet(*files).coalesce(max(1, round(size / target)))
                    new = self._write(rows, folders[-1], born).collect()  # as many rows as files of a page
                    if (sum(r.rows for r in new), sum(r.check or 0 for r in new)) != (sum(r.rows for r in page), sum(r.check or 0 for r in page)):
                        raise RuntimeError("a merge changed the rows; nothing was committed")
                    gone += files
                    merged += new
            out = self.spark.createDataFrame([(f,) for f in gone], "path string")

            def change(manifest: DataFrame) -> DataFrame:
                if manifest.join(out, "path", "left_semi").count() < len(gone):
                    raise VersionTaken("another compaction took some of these shards")
                return manifest.join(out, "path", "left_anti").unionByName(self.spark.createDataFrame(merged, MANIFEST))

            return self._change(change)
        finally:
            for folder in folders:
                self._let_go(folder)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version, with the shard's path and its size as struct column _shard if the store holds any."""
        files = [r.path for r in self.manifest(version).select("path").toLocalIterator()]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def located(self, schema, id_col: str = "doc_id") -> DataFrame:
        """(id, shard_id, shard_rows, version) of each row; shards are numbered by (first id, rows, bytes), a manifest-sized order."""
        from pyspark.sql import Window

        m = self.manifest()
        ranked = m.withColumn("shard_id", F.row_number().over(Window.orderBy("first_id", "rows", "bytes", "path")).cast("long") - 1)
        rows = self.read(schema)
        if rows.isEmpty():
            return rows.select(id_col, F.lit(0).cast("long").alias("shard_id"), F.lit(0).cast("long").alias("shard_rows"), F.lit(0).cast("long").alias("version"))
        at = rows.select(F.col(f"`{id_col}`").alias(id_col), F.col("_metadata.file_path").alias("path"))
        return at.join(ranked, "path").select(id_col, "shard_id", F.col("rows").alias("shard_rows"), F.lit((self.versions() or [0])[-1]).cast("long").alias("version"))

    def vacuum(self, keep: int = 1) -> None:
        """Deletes the manifests but the last keep, and the data folders that none of those kept names and no writer claims."""
        data = self._at(f"{self.root}/data")
        found = [s.getPath() for s in self._fs.listStatus(data)] if self._fs.exists(data) else []
        live = self._claims()  # after the folders, before the manifests: a writer lets go only after its commit
        versions = self.versions()
        for v in versions[-keep:]:
            folders = self.manifest(v).select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()  # one for each arrival or merge
            live |= {r.folder for r in folders.toLocalIterator()}
        for v in versions[:-keep]:
            self._fs.delete(self._at(f"{self.root}/_manifest/v{v:08d}"), True)
        for path in found:
            if path.getName() not in live:
                self._fs.delete(path, True)


def store_and_locate(spark: SparkSession, docs: DataFrame, root: str, target: int = TARGET, arrivals: int = ARRIVALS) -> DataFrame:
    """Stores docs at root in so many arrivals, dealt by hash, each followed by a compaction, and returns each row's shard."""
    store = ShardStore(spark, root)
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.filter(part == k))
        store.compact(docs.schema, target)
        store.vacuum()
    return store.located(docs.schema)
