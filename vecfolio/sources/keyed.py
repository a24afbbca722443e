"""The catalogue as keyed tables: put, delete with what hangs on it, and versions that readers see whole.

Both tables, profiles and their vectors, are dealt to ``buckets`` by a hash of
profile_id. A commit rewrites the buckets that it touches, as folders
``profiles/bucket=B/version=N`` and ``vectors/bucket=B/version=N``, and then
writes its manifest: for each bucket the version that counts. Only with the
manifest does a commit exist; one that failed before has left folders that
nobody reads, and that its repetition writes anew. Readers open one manifest, so
they see profiles and vectors of the same version, and an older one if they ask.
One commit runs at a time.

A profile put replaces the one before and all its vectors; deleting a profile
deletes its vectors. Of a profile put twice in one commit, and of a role given
twice, one row counts (the greatest); a null profile_id is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 256
TABLES = {"profiles": ["profile_id"], "vectors": ["profile_id", "role"]}


class KeyedCatalogue:
    def __init__(self, spark: SparkSession, path: str, profiles: str | StructType, vectors: str | StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schemas = {n: StructType.fromDDL(s) if isinstance(s, str) else s for n, s in (("profiles", profiles), ("vectors", vectors))}

    # --- versions

    def versions(self) -> list[int]:
        """The commits that were finished."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(root):
            return []
        done = [s.getPath() for s in store.listStatus(root) if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def _manifest(self, version: int | None = None) -> dict[int, int]:
        known = [v for v in self.versions() if version is None or v <= version]
        if not known:
            return {}
        rows = self.spark.read.schema("bucket int, made int").parquet(f"{self.path}/manifest/version={known[-1]}").collect()  # a row a bucket
        return {r["bucket"]: r["made"] for r in rows}

    def read(self, name: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A table as of a version, the last by default; only some buckets, if given."""
        made = self._manifest(version)
        paths = [f"{self.path}/{name}/bucket={b}/version={v}" for b, v in sorted(made.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)

    def bucket(self, key: str = "profile_id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def find(self, name: str, profile_id, version: int | None = None) -> DataFrame:
        """A profile's rows, from the one bucket that can hold them."""
        key = F.lit(profile_id).cast(self.schemas[name]["profile_id"].dataType)
        at = self.spark.range(1).select(F.pmod(F.xxhash64(key), F.lit(self.buckets))).first()[0]
        return self.read(name, version, {int(at)}).filter(F.col("profile_id") == key)

    # --- commits

    def commit(self, profiles: DataFrame | None = None, vectors: DataFrame | None = None, deleted: DataFrame | None = None) -> int:
        """Puts profiles with all their vectors, deletes those of ``deleted`` (profile_id), and returns the version.

        Vectors of profiles that aren't put are an error; deleting one that isn't there changes nothing.
        """
        given = {"profiles": profiles, "vectors": vectors}
        none = {n: self.spark.createDataFrame([], s) for n, s in self.schemas.items()}
        new = {n: (given[n] if given[n] is not None else none[n]).select(*[c for c in self.schemas[n].names]) for n in TABLES}
        gone = deleted.select("profile_id") if deleted is not None else none["profiles"].select("profile_id")
        if new["profiles"].filter("profile_id is null").limit(1).count():
            raise ValueError("a profile without an id can't be put")
        if new["vectors"].join(new["profiles"].select("profile_id"), "profile_id", "left_anti").limit(1).count():
            raise ValueError("a commit has vectors of profiles that it doesn't put")
        before = self._manifest()
        version = max(self.versions(), default=-1) + 1
        changed = new["profiles"].select("profile_id").unionByName(gone).distinct()
        touched = {r["b"] for r in changed.select(self.bucket().alias("b")).distinct().collect()}  # at most the buckets
        for name, keys in TABLES.items():
            held = self.read(name, buckets=touched) if before else none[name]
            rows = held.join(changed, "profile_id", "left_anti").unionByName(self._one(new[name], keys))
            self._write(name, rows, touched, version)
        made = [(b, before.get(b, version) if b not in touched else version) for b in sorted(set(before) | touched)]
        self.spark.createDataFrame(made or [(0, version)], "bucket int, made int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return version

    def _one(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        order = [F.col(c).desc() for c in rows.columns if c not in keys]
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")

    def _write(self, name: str, rows: DataFrame, touched: set[int], version: int) -> None:
        """The touched buckets' folders, each by its own tasks; a bucket that has lost all rows gets an empty folder."""
        staged = rows.withColumn("bucket", self.bucket()).withColumn("version", F.lit(version))
        dynamic = staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        dynamic.partitionBy("bucket", "version").parquet(f"{self.path}/{name}")
        filled = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        store = filled.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for b in touched:
            store.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/bucket={b}/version={version}"))
