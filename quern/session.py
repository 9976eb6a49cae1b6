"""Session set-up, cut points for lineage, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that may be broadcast once its size has been measured.
BROADCAST_BYTES = 48 << 20
_CUTS: list[str] = []


def build_session(app: str = "quern", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under; on a cluster pass the master and sizes through ``conf``."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("QUERN_DRIVER_MEMORY", "8g"),
    } | conf
    builder = SparkSession.builder.appName(app)
    if "spark.master" not in settings:
        builder = builder.master(f"local[{cores}]")
    spark = builder.config(map=settings).getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once a context, so that it need not be installed or on their path."""
    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quern-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(f"{folder}/quern.zip", "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(f"{folder}/quern.zip")
    context._quern_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; only where that is unset, one of our own (local runs and tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster must name a folder that all executors share in spark.checkpoint.dir")
    own = os.environ.get("QUERN_SHARED_DIR")
    if own is None:
        own = os.environ["QUERN_SHARED_DIR"] = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor costs a re-read, not a re-run."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` wrote so far, once nothing reads them any more; returns their number."""
    n = 0
    while _CUTS:
        place = spark._jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        n += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
    return n


@contextmanager
def cuts(spark: SparkSession) -> Iterator[None]:
    """The tables cut inside are deleted on leaving; write or collect the results before."""
    before = list(_CUTS)
    try:
        yield
    finally:
        own = [p for p in _CUTS if p not in set(before)]
        _CUTS[:] = own
        drop_cuts(spark)
        _CUTS[:] = before


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df``, at ``row_bytes`` a row, fits the broadcast limit. Counts at most one row beyond the limit."""
    most = max(1, limit // max(1, row_bytes))
    return df.limit(most + 1).count() <= most


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    row_bytes: int = 64,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join that broadcasts ``small`` only after counting it; beyond the limit it is a shuffle join, whose skewed partitions AQE splits."""
    return big.join(F.broadcast(small) if small_enough(small, row_bytes, limit) else small.hint("merge"), on, how)
