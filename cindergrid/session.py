"""Session defaults and the one place that decides where shared files go."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def get_session(app: str = "cindergrid", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # The JVM never compiles a method above 8,000 bytes. Very wide projections (all features of a row)
        # exceed that when fused into one loop; let Spark split those instead of running them interpreted.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="cindergrid-")


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below the folder all executors can reach.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local master may fall
    back to the machine's own temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _local_folder()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut_lineage(df):
    """Write ``df`` to the shared folder and read it back.

    A lost executor then replays no history, several readers share one computation, and the optimizer
    knows the real size, so it broadcasts the table in a join only when it is small.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.parquet(path)
