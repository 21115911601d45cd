"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Names of this run's states in the shared folder.
_RUN, _STATES = f"quarrylens-{uuid.uuid4().hex}", itertools.count()
_FOLDERS: set[str] = set()
_LOCAL: str | None = None

#: Settings a local run starts with; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8, app: str = "quarrylens") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see; only a local master may do without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not (spark.conf.get("spark.master", None) or "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    global _LOCAL
    if _LOCAL is None:
        folder = tempfile.mkdtemp(prefix="quarrylens-states-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL = Path(folder).as_uri()
    return _LOCAL


def _remove(folder: str) -> bool:
    """Delete a folder if the driver sees it as a path, as it does a mounted one; elsewhere ``quarrylens-*`` may be deleted after the run."""
    path = Path(folder.removeprefix("file://") if folder.startswith("file:///") else folder.removeprefix("file:"))
    if path.is_dir():
        shutil.rmtree(path, ignore_errors=True)
        return True
    return False


def cut(frame: DataFrame) -> DataFrame:
    """Write ``frame`` as a table in the shared folder and read it back, so that lost executors don't restart a loop.

    The result's plan starts anew: neither lineage nor the constraints inferred so far grow from step to step.
    """
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/{_RUN}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, folder)
    path = f"{folder}/{next(_STATES)}"
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._quarrylens_state = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Free the space of states that a loop has superseded; nothing may read them any more."""
    for frame in frames:
        path = getattr(frame, "_quarrylens_state", None)
        if path and not _remove(path):
            frame.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """A scan with fewer partitions than the cluster has cores, spread over them; others stay as they are, unshuffled.

    For work that costs much more CPU than moving its rows: a table in one small file would otherwise be one task.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_quarrylens_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quarrylens-code-")) / "quarrylens.zip"  # the driver serves it from here
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(here.rglob("*.py")):
            archive.write(path, path.relative_to(here.parent))
    context.addPyFile(str(target))
    context._quarrylens_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
