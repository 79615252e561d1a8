"""Versioned feature stores, their splits and manifest, and report files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import schemas as S
from creditloom.runtime import materialize
from creditloom.sources.raw_text import require_paths

SPLITS = ("train", "valid", "test")


# --- projections -------------------------------------------------------------------------------


def objective_store(master: DataFrame, objective: str) -> DataFrame:
    """Master without the loan id and without the columns that leak the objective's target."""
    return master.drop(S.ID_COLUMN, *S.OBJECTIVE_DROPS[objective])


def lending_store(master: DataFrame, objective: str, keep: list[str] = ()) -> DataFrame:
    """The 20 underwriting features and the target of a lending model."""
    source = F.col(S.LENDING_TARGETS[objective])
    target = F.log1p(source.cast("double")) if objective == "loan_amount" else source
    return master.select(*keep, *S.LENDING_FEATURES, target.alias("target"))


def baseline_variant(df: DataFrame) -> DataFrame:
    """No leaking, unusable or engineered columns."""
    return df.drop(*S.LABEL_LEAKAGE, *S.UNUSABLE, *S.ENGINEERED)


def score_variant(df: DataFrame) -> DataFrame:
    """No leaking or unusable columns; keeps the score itself but not its components."""
    return df.drop(*S.LABEL_LEAKAGE, *S.UNUSABLE, *S.NORM_COLUMNS)


# --- small JSON documents -----------------------------------------------------------------------


def _fs_path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def read_json(spark: SparkSession, path: str) -> dict | None:
    fs, target = _fs_path(spark, path)
    if not fs.exists(target):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def _put(spark: SparkSession, path: str, content: dict, replace: bool) -> bool:
    """Write a small file that appears whole or not at all; without ``replace`` False if it is there already."""
    jvm = spark.sparkContext._jvm
    fs, target = _fs_path(spark, path)
    name = target.getName()
    _, fresh = _fs_path(spark, f"{path[: -len(name)]}.{name}.{uuid.uuid4().hex}")
    stream = fs.create(fresh, False)
    try:
        stream.write(bytearray(json.dumps(content, indent=4), "utf-8"))
    finally:
        stream.close()
    try:
        if not replace and fs.getScheme() == "file":
            # a local rename looks first and then acts; a link is refused by the system itself
            paths = [jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri()) for p in (target, fresh)]
            jvm.java.nio.file.Files.createLink(*paths)
            fs.delete(fresh, False)
        else:
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            how = spark.sparkContext._gateway.new_array(rename, 1)
            how[0] = rename.OVERWRITE if replace else rename.NONE
            conf = spark.sparkContext._jsc.hadoopConfiguration()
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(fresh).toUri(), conf).rename(fresh, target, how)
    except Py4JJavaError as e:
        fs.delete(fresh, False)
        if not replace and "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def write_json(spark: SparkSession, path: str, content: dict) -> None:
    """Write or replace a small file; readers see the old or the new content."""
    _put(spark, path, content, True)


def _commits(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete commits; what a stopped writer left has another kind of name."""
    fs, folder = _fs_path(spark, f"{root}/manifest")
    if not fs.exists(folder):
        return []
    names = [str(f.getPath().getName()) for f in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest manifest of a store: latest_version and versions."""
    commits = _commits(spark, root)
    return read_json(spark, f"{root}/manifest/{commits[-1]:09d}.json") if commits else None


def register_version(spark: SparkSession, root: str, version: str, entry: dict) -> dict:
    """Insert or replace one version in the manifest and make it the latest.

    Every change is a commit of its own, a numbered file that is created only if it is absent. Whoever comes second
    reads the first one's commit and takes the next number, so no entry is lost; a writer that stops leaves nothing.
    """
    fs, folder = _fs_path(spark, f"{root}/manifest")
    fs.mkdirs(folder)
    while True:
        number = max(_commits(spark, root), default=0)
        manifest = read_json(spark, f"{root}/manifest/{number:09d}.json") if number else {"latest_version": version, "versions": {}}
        manifest["latest_version"] = version
        manifest["versions"][version] = entry
        if _put(spark, f"{root}/manifest/{number + 1:09d}.json", manifest, False):
            return manifest


# --- writers -----------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    # rebalancing gathers each partition value in few files and still splits a dominant one
    df = df.hint("rebalance", *partition_by) if partition_by else df
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_feature_store(
    master: DataFrame, root: str, version: str, source: str, description: str = "",
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
) -> dict:
    """Write the four objective stores, partitioned by quarter, with metadata and manifest.

    The rows are gathered by quarter once, for all four.
    """
    spark = master.sparkSession
    gathered = materialize(master.drop(S.ID_COLUMN).hint("rebalance", "quarter"), "gathered")
    for objective in S.OBJECTIVE_DROPS:
        path = f"{root}/{version}/{objective}/feature_store.parquet"
        objective_store(gathered, objective).write.mode("overwrite").option("compression", "zstd").partitionBy("quarter").parquet(path)
    rows = spark.read.parquet(f"{root}/{version}/explainability/feature_store.parquet").count()
    entry = {
        "version": version,
        "created_on": clock().strftime("%Y-%m-%d %H:%M:%S"),
        "source_dataset": source.rstrip("/").rsplit("/", 1)[-1],
        "rows": rows,
        "columns": len(master.columns),
        "description": description,
    }
    write_json(spark, f"{root}/{version}/metadata.json", entry)
    register_version(spark, root, version, entry)
    return entry


def write_splits(tagged: DataFrame, folder: str) -> None:
    """Write a frame tagged with ``split``; each split is one pruned partition."""
    write_table(tagged, f"{folder}/splits.parquet", ["split"])


def load_splits(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """train, valid and test of a written store, or an error naming what is missing."""
    path = f"{folder}/splits.parquet"
    require_paths(spark, [path])
    stored = spark.read.parquet(path)
    absent = set(SPLITS) - {r["split"] for r in stored.select("split").distinct().collect()}
    if absent:
        raise FileNotFoundError(f"{path} holds no rows for {', '.join(sorted(absent))}")
    return {s: stored.where(F.col("split") == s).drop("split") for s in SPLITS}


def write_lending_stores(master: DataFrame, root: str, version: str, seed: int = 42) -> None:
    """Write the three lending stores with their random splits.

    The split is drawn on the loan id before it is projected away, so all three share it.
    """
    from creditloom.operators.ranking import hash_split

    tagged = hash_split(master, [S.ID_COLUMN], seed)
    for objective in S.LENDING_TARGETS:
        store = lending_store(tagged, objective, keep=["split"])
        write_splits(store, f"{root}/{version}/{objective}")


def write_report(df: DataFrame, path: str) -> None:
    """One CSV file with header; for reports of a few thousand rows at most."""
    df.repartition(1).write.mode("overwrite").csv(path, header=True)
