"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # pages can be large: bound Arrow batches by rows and bytes, not by rows alone
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
}


# only read when a session starts; page expressions are large, and capturing the call site of
# every column operation makes building them several times slower
STATIC = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def builder(app: str = "boardwalk") -> SparkSession.Builder:
    """Session builder with all settings of this module."""
    made = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **STATIC}.items():
        made = made.config(key, value)
    return made


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to an existing session."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would not survive the loss of its machine, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="boardwalk-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for small tables that loops go over."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder: columnar, so later steps read only the
    columns they need, and the loss of an executor costs no earlier work."""
    path = f"{shared_folder(df.sparkSession)}/boardwalk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_with(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """``stored``, and aggregates of the rows taken while they are written, so that no figure costs
    a scan of its own. Counts of no rows are zero."""
    seen = Observation()
    path = f"{shared_folder(df.sparkSession)}/boardwalk-{uuid.uuid4().hex}"
    df.observe(seen, *[c.alias(name) for name, c in figures.items()]).write.parquet(path)
    got = seen.get
    return df.sparkSession.read.schema(df.schema).parquet(path), {name: got.get(name) or 0 for name in figures}
