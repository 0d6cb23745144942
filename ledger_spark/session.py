"""Session, scratch folder and lineage helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def build_session(app: str = "ledger_spark", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and UTC; sizes are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Long row pipelines: beyond this size the JVM would leave a fused method uncompiled, so Spark splits it.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **{k: str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def sized_for(input_bytes: int, cores: int, partition_bytes: int = 128 * 1024 * 1024) -> dict[str, str]:
    """Settings for an input size: enough shuffle partitions that each holds about `partition_bytes`.

    Adaptive execution merges what turns out small, so the count may be generous; it is at least three tasks
    per core, and scans are split so that every core has work.
    """
    shuffle = max(3 * cores, -(-input_bytes // partition_bytes))
    scan = min(partition_bytes, max(4 * 1024 * 1024, input_bytes // (2 * cores)))
    return {"spark.sql.shuffle.partitions": str(shuffle), "spark.sql.files.maxPartitionBytes": str(scan),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes)}


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`); one of our own only in local mode, where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="ledger-spark-")
    return _own_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet, below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries run inside go when each ends; else they stay until the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: later plans start from the table,
    and a lost executor costs a re-read, not a recompute."""
    path = scratch_path(df.sparkSession, name)
    with _shuffles_cleared(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of `written`, each read by no plan that is still to run."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def local_frame(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """Configuration rows as a local relation, whose true size Catalyst sees when it picks joins."""
    arrays = [pa.array([r[i] for r in rows]) for i in range(len(columns))]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=columns))


def empty_frame(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of a schema.  An empty Python list would do, but its plan starts workers of another kind:
    a second daemon and pool in each executor, which stay."""
    fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
    return spark.range(1).select(*fields).where("false")
