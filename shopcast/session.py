"""Session helpers.

Library code never creates its own session: every operator takes DataFrames
(or a session passed in).  ``get_spark`` exists for tests, ``bench.py`` and
command-line use only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for this workload at any scale.
#  * AQE re-plans joins from measured shuffle sizes (runtime, size-checked
#    broadcast of small sides), coalesces tiny partitions and splits skewed
#    sort-merge-join partitions (one user may own a third of all rows).
#  * Feature tables are wide; whole-stage codegen is kept for the
#    per-grain aggregates by building one aggregate per grain (see plans/).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def conf_master(master: str | None, cpus: str) -> str:
    return master or f"local[{cpus}]"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "shopcast", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(conf_master(master, cpus)).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf.setdefault("spark.driver.memory", "16g")
    if conf_master(master, cpus).startswith("local"):
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="shopcast-shared-")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, taken from the cluster setting.

    On a cluster ``spark.checkpoint.dir`` names shared storage; we only pick a
    folder of our own when the session leaves it unset (local tests).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        d = tempfile.mkdtemp(prefix="shopcast-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d
