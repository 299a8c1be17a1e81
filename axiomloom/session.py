"""Session settings and the shared folder that durable intermediate tables use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "axiomloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for.

    Shuffle parallelism is left to the cluster's own default and to AQE, which
    coalesces small partitions and splits skewed ones at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local[...] session without the setting gets a temporary folder of
    its own; a cluster session without it is refused, because a machine-local
    folder would be lost together with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app_id = spark.sparkContext.applicationId
    if app_id not in _LOCAL_DIRS:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        _LOCAL_DIRS[app_id] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_DIRS[app_id]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; never reused between runs."""
    return f"{shared_dir(spark)}/axiomloom/{tag}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, tag: str) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and read it back.

    Unlike an executor-local checkpoint the table outlives lost executors, and
    its file sizes let the planner choose between broadcast and shuffle joins.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_and_count(df: DataFrame, tag: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """Like cut_lineage, also counting rows (and rows meeting conditions)
    while they are written, so a loop needs no extra job to see it is done."""
    seen = Observation()
    conditions = [F.count_if(c).alias(n) for n, c in counts.items()]
    table = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows"), *conditions), tag)
    return table, dict(seen.get)
