"""The registered queries: one Spark plan and, where SQL can say it, one checking statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return spread(self.__getattr__("documents"), "doc_id")

    @property
    def pages(self) -> DataFrame:
        return spread(self.__getattr__("pages"), "page_id")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Shuffles rows by ``key`` only where the input has fewer splits than the cluster has cores.

    A small table in one file would otherwise keep its whole text work on one core; a large one
    has splits enough and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def flat(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and decimals as DOUBLE, the types the checking SQL returns."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(name)
        if kind in ("int", "smallint", "tinyint"):
            col = col.cast("long")
        elif kind == "float" or kind.startswith("decimal"):
            col = col.cast("double")
        out.append(col.alias(name))
    return df.select(*out)


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # recorded times are UTC throughout; a driver-wide zone would shift them
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return flat(build(Tables(spark, folder)))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register
