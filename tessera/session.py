"""Session helpers: the configuration every job in the package assumes, table
loading by name, and the shared checkpoint folder used to cut lineage in
iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. AQE re-plans joins from runtime sizes (a side
# is broadcast only when its measured shuffle output is under the threshold),
# coalesces small partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # local mode: the driver JVM is the only executor
    "spark.driver.memory": "16g",
}


def get_session(master: str = "local[*]", shuffle_partitions: int | None = None, app: str = "tessera",
                extra: dict | None = None) -> SparkSession:
    """A session with DEFAULT_CONF. The number of shuffle partitions is left to the
    cluster's configuration unless given, as tests and the bench do."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (distributed) folder and
    is used as is. Only when it is unset (local tests) do we create one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for the jobs that run inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is
    cut, columns stay prunable, a lost executor costs no recomputation, and a later
    join shuffles the table anew, so that Spark may split it where a key is hot.
    Spark removes the job's shuffle files as soon as it has ended."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder (survives executor loss) and return the
    frame that reads it."""
    return stored(df, "cut")


def arrow_rows(spark: SparkSession, n: int):
    """At most n rows in an Arrow batch of the jobs that run inside, for rows that are
    whole blocks of data."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
