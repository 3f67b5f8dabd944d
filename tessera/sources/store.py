"""Scenario store (S6-S11): every piece of a built scenario is a Parquet table
under ``<root>/<table>/scenario=<name>/version=<id>``, and a model (projection matrix,
cluster core points) is data, not a pickle.

A save writes new versions of its tables and, last, one small file of the manifest that
names a version of every table. Readers go by the manifest's last entry alone, so a
save that ends between two tables leaves the scenario as it was. The entry also holds
a fingerprint of the parameters and the input, by which a build is reused or not.

``root`` must be a shared folder on a cluster; by default it is a folder under
the session's ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Fixed value: the tables a complete scenario holds.
REQUIRED = ("topics", "topic_doc", "topic_keyword", "keyword_topic", "cluster_topic", "mapping", "reducer", "cluster_model",
            "term_stats", "token_vectors", "topic_vectors", "params")
# Membership tables are range-partitioned and sorted, so that one topic is read from few
# files and a large one is many files (a bucket of it would be one task's).
SORTED = {"topic_doc": ("topic", "doc_id"), "topic_keyword": ("topic", "keyword")}
MODEL = "clusterer"


def default_root(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "tessera-scenarios")


def _path(root: str, name: str, scenario: str, version: str) -> str:
    return os.path.join(root, name, f"scenario={scenario}", f"version={version}")


def _manifest_path(root: str, scenario: str) -> str:
    return os.path.join(root, "manifest", f"scenario={scenario}")


def manifest(spark: SparkSession, root: str, scenario: str) -> tuple[int, str | None, dict[str, str]]:
    """(number of the last entry, its fingerprint, {table: path}); (0, None, {}) if there is none."""
    path = _manifest_path(root, scenario)
    if not folder_exists(spark, path):
        return 0, None, {}
    entry = spark.read.schema("entry LONG, fingerprint STRING, tables MAP<STRING, STRING>").parquet(path).orderBy(F.desc("entry")).first()
    return (entry["entry"], entry["fingerprint"], dict(entry["tables"])) if entry else (0, None, {})


def save(tables: dict[str, DataFrame], root: str, scenario: str, fingerprint: str | None = None, model=None, keep: bool = False) -> None:
    """New versions of the tables, then the manifest's next entry. ``keep`` takes over
    the other tables of the entry before, and its fingerprint unless one is given."""
    spark = next(iter(tables.values())).sparkSession
    number, before, paths = manifest(spark, root, scenario)
    if not keep:
        before, paths = None, {}
    version = uuid.uuid4().hex
    for name, df in tables.items():
        if name in SORTED:
            df = df.repartitionByRange(*SORTED[name]).sortWithinPartitions(*SORTED[name])
        paths[name] = _path(root, name, scenario, version)
        df.write.parquet(paths[name])
    if model is not None:
        paths[MODEL] = _path(root, MODEL, scenario, version)
        model.write().save(paths[MODEL])
    entry = spark.createDataFrame([(number + 1, fingerprint if fingerprint is not None else before, paths)], "entry LONG, fingerprint STRING, tables MAP<STRING, STRING>")
    entry.coalesce(1).write.mode("append").parquet(_manifest_path(root, scenario))  # one file, which appears whole


def folder_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def missing(spark: SparkSession, root: str, scenario: str, required=REQUIRED) -> list[str]:
    """The required parts that the scenario does not have; a KMeans scenario also needs
    its saved model."""
    paths = manifest(spark, root, scenario)[2]
    gone = [n for n in required if n not in paths]
    if set(required) == set(REQUIRED) and "params" in paths and MODEL not in paths:
        if spark.read.parquet(paths["params"]).first()["method"] == "KMeans":
            gone.append(MODEL)
    return gone


def load(spark: SparkSession, root: str, scenario: str, names=REQUIRED) -> dict[str, DataFrame]:
    gone = missing(spark, root, scenario, names)
    if gone:
        raise FileNotFoundError(f"scenario {scenario!r} is incomplete, missing: {', '.join(gone)}")
    paths = manifest(spark, root, scenario)[2]
    return {n: spark.read.parquet(paths[n]) for n in names}


def model_path(spark: SparkSession, root: str, scenario: str) -> str:
    """Where the fitted MLlib clustering model of the scenario is."""
    return manifest(spark, root, scenario)[2][MODEL]


def load_mapping(spark: SparkSession, root: str, scenario: str, topics: DataFrame) -> DataFrame:
    """The saved topic → parent map, or the identity map over the saved
    topics when no map was saved."""
    paths = manifest(spark, root, scenario)[2]
    if "mapping" in paths:
        return spark.read.parquet(paths["mapping"])
    return topics.select("topic").distinct().select("topic", F.col("topic").alias("parent"))


def to_text(table: DataFrame, list_cols=("documents", "topic_keywords")) -> DataFrame:
    """List cells as ', '-joined text (CSV-safe export form)."""
    out = table
    for c in list_cols:
        out = out.withColumn(c, F.concat_ws(", ", F.transform(c, lambda x: x.cast("string"))))
    return out


def from_text(table: DataFrame, list_cols=("documents", "topic_keywords")) -> DataFrame:
    """Text cells back to lists: split on ',', trim, drop empty and 'nan'."""
    out = table
    for c in list_cols:
        parts = F.transform(F.split(F.coalesce(F.col(c).cast("string"), F.lit("")), ","), lambda x: F.trim(x))
        out = out.withColumn(c, F.filter(parts, lambda x: (x != "") & (F.lower(x) != "nan")))
    return out


def write_text(table: DataFrame, path: str) -> None:
    to_text(table).write.mode("overwrite").option("header", True).csv(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return from_text(spark.read.option("header", True).csv(path))
