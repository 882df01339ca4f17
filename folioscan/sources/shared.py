"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only where the setting is absent in a local session, as in tests, a temporary
    folder of this machine stands in; on a cluster that would be lost to others.
    """
    global _own
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own is None or not os.path.isdir(_own):
        _own = tempfile.mkdtemp(prefix="folioscan-")
    return f"file://{_own}"


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/folioscan/{name}-{uuid.uuid4().hex}"
