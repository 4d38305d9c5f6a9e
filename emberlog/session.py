"""Session settings the engine relies on, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that change results, so they are set on every session the engine uses.
REQUIRED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # A repeated key inside a JSON object keeps its last value instead of
    # making the whole document unreadable.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Settings that only change speed; a session built elsewhere keeps its own.
PREFERRED_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Checkpoint files go away with the frames that read them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED_SETTINGS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "emberlog", **settings: str) -> SparkSession:
    """Build a session; keyword settings use ``__`` in place of dots."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**PREFERRED_SETTINGS, **REQUIRED_SETTINGS}.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set here only where nothing sets it."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="emberlog-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new path under the shared folder, for tables a job writes on its way."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
