"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", **conf) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("barloom")
    settings = DEFAULTS | {"spark.ui.enabled": "false"} | conf
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


HOTSPOT_BYTES = 8000   # fixed value: HotSpot never compiles a method with more byte code


def compiled(spark: SparkSession) -> None:
    """Have plans whose generated method HotSpot would only interpret run operator by operator, in code cut into small methods.

    Spark's own limit is 65,535 bytes; a table of all features or labels lies between the two.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > HOTSPOT_BYTES:
        spark.conf.set(name, str(HOTSPOT_BYTES))


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; a cluster gets it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(":")
    if root not in known:
        env["PYTHONPATH"] = ":".join(filter(None, [*known, root]))


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in `spark.checkpoint.dir`.

    Only a local session without that setting (tests) gets a private folder;
    executors on other machines would not see it, so elsewhere the setting is required.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return named or sc.getCheckpointDir()
