"""Session settings the operators rely on, and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

# Time semantics need UTC and zone-less timestamps.  The skew settings let AQE split a hot key
# (one subject or stay holding a large share of the rows) even where the split costs an extra shuffle.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings to an existing session and return it."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(app_name: str = "clinspark", cores: str | int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="clinspark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Cuts the lineage before work that scans the same rows many times (folds, bags, curves).  The table outlives lost
    executors, and reading it back keeps column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def stage_files(df: DataFrame, name: str) -> list[str]:
    """The files of ``df`` written as by ``stage_table``, in the order of its partitions, for tasks that read them themselves."""
    uri = f"{shared_folder(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(uri)
    fs, path = resolve(uri)
    names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(path)) if f.base_name.startswith("part-")]
    return [f"{uri}/{n}" for n in sorted(names, key=lambda n: (int(n.split("-")[1]), n))]


def staged_batches(uri: str, rows: int, columns: Sequence[str] | None = None) -> Iterator[pa.RecordBatch]:
    """A staged file, at most ``rows`` rows at a time, inside a task."""
    fs, path = resolve(uri)
    with fs.open_input_file(path) as file:
        yield from pq.ParquetFile(file, buffer_size=1 << 20).iter_batches(rows, columns=columns, use_threads=False)
