"""What jobs share: this package on the executors, tables in the shared folder, bounded broadcasts."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: About how many rows a task sorts or groups where ``dealt`` sets the number of tasks.
TASK_ROWS = 250_000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once, so that Python stages find their modules on every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="gridmark-")) / "gridmark.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="gridmark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again, so that later jobs don't compute it anew."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows allow it; else as it is, so that Spark shuffles it."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def dealt(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as ``n_rows`` rows need at ``TASK_ROWS`` each.

    Adaptive execution merges partitions up to a size in compressed bytes, which is millions of narrow rows, and a task that sorts them holds them all; a stated number stays as it is.
    """
    return df.repartition(max(1, math.ceil(n_rows / TASK_ROWS)), *keys)
