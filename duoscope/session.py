"""Session helpers: configuration, the shared scratch folder and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(app: str = "duoscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; extra settings are ``spark_sql_x_y="v"`` style."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Where the cluster names none, a local session gets a temporary folder of its own and a
    cluster gets the home folder of its default file system, unless that is machine-local.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if sc.master.startswith("local"):
        root = "file://" + tempfile.mkdtemp(prefix="duoscope-")
    else:
        fs = sc._jvm.org.apache.hadoop.fs.FileSystem.get(sc._jsc.hadoopConfiguration())
        if fs.getUri().getScheme() == "file":
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = fs.getHomeDirectory().toString() + "/duoscope"
    sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, new on every call."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of executors."""
    shared_root(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Collect model-sized data; refuse, instead of cutting off, when there is more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, too many for the driver")
    return rows


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores, for work per row that is far heavier than the row itself.

    The number is explicit because adaptive execution would merge partitions by their bytes.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)
