"""Session defaults and the durable cut of a long lineage."""

from __future__ import annotations

import tempfile
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def get_spark(app: str = "tidegauge", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # do not record the Python call site of every column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the cluster names, else (local mode only) a temporary one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="tidegauge-")
    context.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep the rows in the shared checkpoint folder.

    Needed wherever two later steps must see the very same rows (a range partitioning is sampled
    anew each time it is planned), and it survives the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Small row groups, so that a table written by few tasks is still read by many.
SHELF_BLOCK = 16 * 1024 * 1024


def shelve(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it as Parquet in the shared checkpoint folder.

    For a wide frame that many later steps read a few columns of: unlike ``settle`` it is compressed and read by column. A join below it is done once.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/shelf-{uuid4().hex}"
    df.write.option("parquet.block.size", SHELF_BLOCK).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def hold(small: DataFrame) -> DataFrame:
    """Keep a result whose size the schema bounds (a few rows per column) as a local relation.

    Never for frames whose rows grow with the data: those are for ``settle``.
    """
    return small.sparkSession.createDataFrame(small.toArrow(), small.schema)


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    """A local relation from a few driver-side tuples."""
    struct = T._parse_datatype_string(schema)
    columns = {f.name: [v[i] for v in values] for i, f in enumerate(struct.fields)}
    return spark.createDataFrame(pa.Table.from_pydict(columns, schema=to_arrow_schema(struct)), struct)


SPLIT_BYTES = 128 * 1024 * 1024
#: Of a spread input, what a task gets at most.
TASK_BYTES = 8 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Share a small input over all cores before heavy per-row work.

    A file of one row group is read by a single task. Inputs large enough to fill the cores by
    themselves (by the optimiser's own estimate) are left alone, so nothing big is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate >= cores * SPLIT_BYTES:
        return df
    # more tasks, not longer ones, as the input grows
    return df.repartition(max(cores, -(-estimate // TASK_BYTES)))
