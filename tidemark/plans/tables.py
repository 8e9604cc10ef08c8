"""Tables in the folder that driver and executors share: durable cuts of plans that are read more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of texts below this many bytes a core may be a single split of its file: its rows are dealt to all cores.
SMALL, TEXTS = 8 << 20, {"text", "html"}
#: Bytes of files of texts that make a bucket of a table that is dealt by source.
BUCKET = 16 << 20
#: Paths of the tables that were saved inside the innermost owned().
_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size_of(df) < cores * SMALL and TEXTS & set(df.columns) else df


def size_of(df: DataFrame) -> int:
    """Bytes of the files that df reads, as the optimizer knows them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(spark: SparkSession, size: int) -> int:
    """So many buckets that one has about BUCKET bytes of the files, and each core some."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-size // BUCKET))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where that is unset a session on one machine, as in tests,
    gets a folder of its own; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def by_source(spark: SparkSession) -> Iterator[None]:
    """Inside, rows that are dealt by a source's id are not dealt anew for a join by that id and further columns, and
    tables dealt by it are read by their buckets."""
    names = ["spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.sources.bucketing.autoBucketedScan.enabled"]
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, "false")
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def saved(df: DataFrame, name: str, buckets: int | None = None, key: str = "source_id") -> DataFrame:
    """df written to a table in the shared folder and read back: cuts lineage, survives lost executors. With buckets the
    table is dealt into them by key, and is read so: what joins or groups it by the key moves none of its rows."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    if (paths := _owner.get()) is not None:
        paths.append(path)
    writer = df.write.option("compression", "zstd")
    if buckets is None:
        with by_source(spark):
            writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    return dealt(df, path, buckets, key)


def dealt(df: DataFrame, path: str, buckets: int, key: str = "source_id") -> DataFrame:
    """df written to path, dealt into buckets by key, and read so."""
    # buckets need a name in the catalog while the table is written and found; the files are those of the path
    spark, named = df.sparkSession, f"tidemark_{uuid.uuid4().hex}"
    with by_source(spark):
        df.write.mode("overwrite").option("compression", "zstd").bucketBy(buckets, key).saveAsTable(named, format="parquet", path=path)
    out = spark.table(named).select(*df.columns)
    spark.sql(f"DROP TABLE {named}")
    return out


def dealt_at(spark: SparkSession, path: str, schema: str, buckets: int, key: str = "source_id") -> DataFrame:
    """The columns of schema of what dealt() wrote there, one table or several in folders of path, read by buckets where a
    plan joins or groups by key. Several are one scan: of a union Spark doesn't know how it is dealt."""
    named = f"tidemark_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {named} ({schema}) USING parquet OPTIONS (recursiveFileLookup 'true') CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    out = spark.table(named)
    spark.sql(f"DROP TABLE {named}")
    return out


def unnamed(df: DataFrame) -> DataFrame:
    """df, whose columns don't bear the name of the table that it is: of a union that begins with those Spark doesn't know
    that it is dealt as its parts are."""
    none = df.sparkSession.createDataFrame([], df.schema).where(F.lit(False))
    return none.unionByName(df)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def owner() -> list[str] | None:
    """The list of the innermost owned(), if there is one."""
    return _owner.get()


@contextmanager
def owned(spark: SparkSession | None = None) -> Iterator[list[str]]:
    """The paths of the tables that are saved inside. With a session they go at the end: what was made inside has to be
    read by then. Without one they pass to the owner around this, if there is one; else whoever opens this decides."""
    paths: list[str] = []
    mark = _owner.set(paths)
    try:
        yield paths
    finally:
        _owner.reset(mark)
        if spark is not None:
            for path in paths:
                deleted(spark, path)
        elif (around := _owner.get()) is not None:
            around.extend(paths)
