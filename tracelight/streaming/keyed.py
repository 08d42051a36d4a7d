"""A table with one row a key, kept up to date by the batches of a stream.

Keys are dealt to buckets by hash. A batch reads and rewrites only the buckets it touches, below a
folder of its own, and then writes a manifest that says which batch holds each bucket. Batch N
starts from the newest manifest before N, so a replayed batch overwrites itself and changes
nothing; readers see a batch once its manifest is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """``order`` names the columns that decide which row of a key is the newest; rows that tie on
    them are taken by batch, then by hash, so that a replay picks the same one."""

    def __init__(
        self, spark: SparkSession, folder: str, keys: list[str], order: list[str], buckets: int = 64
    ):
        self.spark, self.folder, self.keys, self.order = spark, folder.rstrip("/"), keys, order
        self.buckets = buckets

    # -- files --------------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _store(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """The batches whose manifest is complete, oldest first."""
        store, place = self._store(), self._path("manifest")
        if not store.exists(place):
            return []
        found = [s.getPath().getName() for s in store.listStatus(place)]
        done = [n for n in found if store.exists(self._path(f"manifest/{n}/_SUCCESS"))]
        return sorted(int(n.partition("=")[2]) for n in done)

    def _manifest(self, batch: int | None) -> dict[int, int]:
        """The batch that holds each bucket: ``buckets`` rows at most."""
        if batch is None:
            return {}
        rows = self.spark.read.parquet(f"{self.folder}/manifest/batch={batch}").collect()
        return {r["bucket"]: r["written"] for r in rows}

    def _read(self, held: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.folder}/data/batch={b}/_bucket={k}" for k, b in sorted(held.items())]
        return self.spark.read.parquet(*paths) if paths else None

    # -- use ----------------------------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Merges ``rows`` as batch number ``batch``."""
        earlier = [b for b in self.batches() if b < batch]
        held = self._manifest(earlier[-1] if earlier else None)
        new = rows.withColumn("_batch", F.lit(batch).cast("long")).persist()  # read twice
        touched = {r[0] for r in new.select(self.bucket()).distinct().collect()}
        old = self._read({k: b for k, b in held.items() if k in touched})
        both = new if old is None else old.unionByName(new, allowMissingColumns=True)
        rest = [c for c in both.columns if c not in self.keys]
        age = F.struct(*self.order, "_batch", F.xxhash64(*rest))
        newest = both.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), age).alias("_r"))
        (
            newest.select(*self.keys, "_r.*")
            .withColumn("_bucket", self.bucket())
            .repartition(max(1, min(self.buckets, len(touched))), "_bucket")
            .write.mode("overwrite")
            .partitionBy("_bucket")
            .parquet(f"{self.folder}/data/batch={batch}")
        )
        held |= dict.fromkeys(touched, batch)
        listing = self.spark.createDataFrame(sorted(held.items()), "bucket int, written long")
        listing.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={batch}")
        new.unpersist()
        self._forget(keep=[*earlier[-1:], batch])

    def _forget(self, keep: list[int]) -> None:
        """Drops buckets that neither this batch nor the one before it refers to."""
        used = {(b, k) for n in keep for k, b in self._manifest(n).items()}
        store, place = self._store(), self._path("data")
        if not store.exists(place):
            return
        for folder in store.listStatus(place):
            batch = int(folder.getPath().getName().partition("=")[2])
            for part in store.listStatus(folder.getPath()):
                name = part.getPath().getName()
                if name.startswith("_bucket=") and (batch, int(name.partition("=")[2])) not in used:
                    store.delete(part.getPath(), True)

    def read(self) -> DataFrame | None:
        """The newest row of every key; None before the first batch."""
        done = self.batches()
        table = self._read(self._manifest(done[-1] if done else None))
        return None if table is None else table.drop("_batch")
