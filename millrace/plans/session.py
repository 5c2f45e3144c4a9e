"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from millrace.errors import InvalidQuery


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; a temporary one only where none is set on a single machine (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise InvalidQuery("spark.checkpoint.dir is not set", "name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    context.setCheckpointDir(root)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one."""
    ensure_checkpoint_dir(spark)
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"
