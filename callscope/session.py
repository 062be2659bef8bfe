"""Session defaults and lineage control."""
from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str = "local[8]", app: str = "callscope", **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own session."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that jobs don't depend on the folder they start in."""
    small_batches(spark)
    sc = spark.sparkContext
    if getattr(sc, "_callscope_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="callscope-"))  # read by the driver's file server only
    with zipfile.ZipFile(folder / "callscope.zip", "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, Path(here.name) / f.relative_to(here))
    sc.addPyFile(str(folder / "callscope.zip"))
    sc._callscope_shipped = True


#: Bytes of one Arrow batch sent to a Python worker, unless the session names another bound.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not by 10,000 rows alone: vectors lie beside the heap and double as they grow."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir``.

    A local session that names none (tests) gets a folder of its own; elsewhere that is an error, because executors would
    write to disks that the others can't read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(spark, "_callscope_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="callscope-")
        spark._callscope_dir = own
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later rounds restart from files, also after an executor is lost."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
