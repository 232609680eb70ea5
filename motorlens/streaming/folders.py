"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; in local mode without that setting, under a folder that goes at exit."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="motorlens-market-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        root = f"file://{_OWN[app]}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
