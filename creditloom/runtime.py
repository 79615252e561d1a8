"""Session-level helpers: where intermediates live, and tables whose size is checked."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediates, as named by the cluster in ``spark.checkpoint.dir``.

    A local master without that setting gets a temporary folder; a cluster without it is an error,
    because a machine-local folder would be lost together with the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(root)
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    root = tempfile.mkdtemp(prefix="creditloom-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Used where several passes need the same expensive input. Unlike a cached table it survives the
    loss of executors, keeps column pruning and filter pushdown, and gives the optimizer real sizes.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)  # intermediates share the disk with the shuffles
    return spark.read.schema(df.schema).parquet(path)


def _work_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/creditloom/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path for this application's intermediates."""
    return f"{_work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_intermediates(spark: SparkSession) -> None:
    """Remove everything this application wrote under :func:`work_path`."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_work_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def side_by_side(spark: SparkSession, jobs: list[Callable[[], object]], at_once: bool = True) -> list:
    """What the ``jobs`` return, in their order. ``at_once`` runs each in a thread of its own, for jobs that leave cores idle."""
    if not at_once:
        return [job() for job in jobs]
    checkpoint_root(spark)  # set once, before the threads need it

    def run(job: Callable[[], object]) -> object:
        spark._jvm.org.apache.spark.sql.SparkSession.setActiveSession(spark._jsparkSession)  # each thread has its own
        return job()

    with ThreadPoolExecutor(len(jobs)) as pool:
        begun = [pool.submit(inheritable_thread_target(spark)(run), job) for job in jobs]
        return [b.result() for b in begun]


def local_table(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """A driver-side result (already bounded by its caller) as a broadcastable DataFrame."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def lookup_table(df: DataFrame, label: str) -> DataFrame:
    """Fitted lookup that is computed once. Its written size tells the optimizer whether it can be broadcast."""
    return materialize(df, label)


# Wide reports hold hundreds of expressions. They are written as SQL text: one call per expression
# instead of one per operator.


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float) -> str:
    return f"{float(value)!r}D"


def to_long(df: DataFrame, records: list[dict[str, str]]) -> DataFrame:
    """Turn a one-row wide result into one row per record; record values are SQL expressions."""
    structs = [
        "named_struct(" + ", ".join(f"{quoted(n)}, {expr}" for n, expr in record.items()) + ")"
        for record in records
    ]
    return df.selectExpr(f"inline(array({', '.join(structs)}))")
