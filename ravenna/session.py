"""Session helpers: a configured session, code shipping and materialised tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ravenna.errors import ConfigError

PACKAGE = Path(__file__).resolve().parent

_shipped: set[str] = set()
_roots: dict[str, str] = {}


def get_session(master: str | None = None, app: str = "ravenna", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` uses `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


#: Files of a materialised table for each core of the cluster.
FILES_A_CORE = 4
#: What a session's settings are lowered to, where they aren't lower: bytes of an Arrow batch for a Python worker, and rows that
#: the Parquet reader holds at a time, since texts can be long.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}


def bound_batches(spark: SparkSession) -> None:
    for setting, most in BOUNDS.items():
        now = spark.conf.get(setting).rstrip("b")
        if not now.isdigit() or int(now) > most:
            spark.conf.set(setting, str(most))


def ship_package(spark: SparkSession) -> None:
    """Make a session fit for this package's Python functions: bounded batches, and the code on the executors.

    The code goes there once for each application, in an archive that the driver's own file server serves, so executors
    need no shared disk for it.
    """
    bound_batches(spark)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="ravenna-code-")) / "ravenna_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session in one local process may do without, and gets a temporary folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _roots:
        _roots[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="ravenna-checkpoint-")
    return _roots[sc.applicationId]


def _tables(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/ravenna/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str, files_a_core: int | None = FILES_A_CORE) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again: lineage is cut, and lost executors lose nothing.

    A written table has `files_a_core` files for each core and no more: small results of many partitions would otherwise cost
    more in files than in rows. A task reads the partitions it takes over one after another, so they need no more memory.
    None keeps the partitions as they are, for steps over whole texts, whose tasks should stay short. Tables stay until
    release() or clear_tables().
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{_tables(spark)}/{tag}-{uuid.uuid4().hex}"
    few = df if files_a_core is None else df.coalesce(files_a_core * spark.sparkContext.defaultParallelism)
    few.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path  # for release()
    return out


def bucketed(df: DataFrame, by: str, buckets: int, tag: str) -> DataFrame:
    """materialize() for tables that are joined by one column: rows lie in `buckets` by it, sorted, so such joins shuffle nothing."""
    spark = df.sparkSession
    path, name = f"{_tables(spark)}/{tag}-{uuid.uuid4().hex}", f"ravenna_{uuid.uuid4().hex}"
    df.write.option("path", path).bucketBy(buckets, by).sortBy(by).saveAsTable(name)
    out = spark.table(name)
    out._table, out._name = path, name  # for release()
    return out


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again; frames that materialize() didn't give are left alone."""
    for df in tables:
        if path := getattr(df, "_table", None):
            if name := getattr(df, "_name", None):
                df.sparkSession.sql(f"drop table if exists {name}")
            _delete(df.sparkSession, path)


def clear_tables(spark: SparkSession) -> None:
    """Delete all tables that this application has materialised; results that still read them can't be run any more."""
    _delete(spark, _tables(spark))


def default_cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
