"""SparkSession helpers: session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "careflow") -> SparkSession:
    """Local/test session. On a cluster, the launcher's session is used instead."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("CAREFLOW_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by spark.checkpoint.dir.

    The cluster's setting is always respected. A private folder is made only
    in a local session (one machine, as in tests); on a cluster without the
    setting this fails, since executors do not see each other's disks.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="careflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once a session), for launchers that do not install it there."""
    sc = spark.sparkContext
    if getattr(sc, "_careflow_shipped", False):
        return
    folder = os.path.dirname(os.path.abspath(__file__))
    tmp = os.path.realpath(tempfile.mkdtemp(prefix="careflow-src-"))  # the driver serves the archive from here as long as it runs
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    shutil.copytree(folder, os.path.join(tmp, "src", os.path.basename(folder)), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(tmp, "careflow_src"), "zip", os.path.join(tmp, "src")))
    sc._careflow_shipped = True
