"""Spark session defaults shared by jobs, tests and the bench.

On a cluster the session is created by the platform; ``configure`` only fills in what is unset
(time zone, AQE, checkpoint folder) so a cluster's own settings always win.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on for correct results (UTC day/month boundaries) or sane plans.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Local or cluster session. ``master=None`` leaves the master to spark-submit."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Pin UTC and make sure a checkpoint folder exists (own temp folder only when the cluster named none)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application), so that functions it defines can be loaded
    there whatever folder the driver was started from. The archive is built on the driver and served by Spark."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tessera-pkg-"), "tessera_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith((".py", ".txt")):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(archive)
    # Python processes that Spark starts beside the driver (stateful streams) look at the path, not at shipped files
    paths = [archive, sc.environment.get("PYTHONPATH", "")]
    sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in paths if p)
    sc._tessera_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """This application's folder below the one that ``spark.checkpoint.dir`` names (shared by all executors); a fresh
    temp folder only when that is unset (tests). It is removed when the process ends."""
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if not now:
        d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not d:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                # a machine-local folder would not survive a lost executor: the cluster must name a shared one
                raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS / object storage)")
            d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        sc.setCheckpointDir(d)
        now = sc.getCheckpointDir()
    if getattr(sc, "_tessera_checkpoints", None) != now:
        _remove_at_exit(spark, now)
        sc._tessera_checkpoints = now
    return now


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Remove this application's own checkpoint folder (Spark gives each application one of its own below the configured
    one) when the process that runs it ends: intermediate tables are of no use to anyone after that."""
    jvm, pid = spark.sparkContext._jvm, os.getpid()

    def remove() -> None:
        if os.getpid() == pid:
            try:
                at = jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
            except Exception:  # noqa: BLE001 - the JVM is gone already: nothing left to do it with
                pass
    atexit.register(remove)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables and stream checkpoints."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}"
