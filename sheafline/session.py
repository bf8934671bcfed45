"""Session defaults, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "sheafline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the engine relies on (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return ship(b.getOrCreate())


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives the executors this package, once an application, however they were started."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        here = Path(__file__).resolve().parent
        # the driver serves this file to executors as they come, so it has to last
        tmp = tempfile.mkdtemp(prefix="sheafline-")
        atexit.register(shutil.rmtree, tmp, ignore_errors=True)
        kept = shutil.copytree(here, Path(tmp, "src", here.name), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(Path(tmp, here.name)), "zip", kept.parent))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The folder is the cluster's ``spark.checkpoint.dir``; only a session on one
    machine (tests, a laptop) gets a folder of its own where that is unset.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sheafline-ckpt-"))
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Tasks that a Python stage over little data should at least be split into."""
    return max(spark.sparkContext.defaultParallelism, 1)
