"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "tracelight", **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes; extra ``conf`` wins.

    Without ``master`` the cluster's own settings hold (spark-submit). A master given here is one
    of tests and benchmarks: it also gets few shuffle partitions and no user interface.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
        settings |= {
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        }
    settings |= conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a session on a local master (a test) that names none gets a private folder, which is
    removed at exit; on a cluster executors would each write to their own disk, so it raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="tracelight-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor never restarts an iterative job from its scan."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast if its measured bytes are few, else as it is (shuffle join).

    For stored model tables of numbers and strings: measuring reads the table, so cut its lineage
    first. A row counts 16 bytes a column and the bytes of its strings.
    """
    fixed = F.lit(16 * len(df.columns))
    strings = [F.coalesce(F.octet_length(n), F.lit(0)) for n, kind in df.dtypes if kind == "string"]
    total = df.agg(F.sum(sum(strings, fixed)).alias("n")).first()["n"] or 0
    return F.broadcast(df) if total <= max_bytes else df
