"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphlens")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one named in ``spark.checkpoint.dir``. Only where that is unset and the session is
    local (tests, benchmarks) a temporary folder is made; on a cluster that would be a folder of
    one machine, so there it is an error.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="graphlens-")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give the package to all Python workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_graphlens_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="graphlens-code-")) / "graphlens.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._graphlens_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many tasks as there are cores, where its scan has fewer.

    For rows that cost much more to work on than to move. A scan of large tables has more splits than
    that, and stays as it is: without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


#: Scratch folders and tables by context, for ``forget``.
_MADE: dict[int, tuple[list[str], list[str]]] = {}


def forget(spark: SparkSession) -> None:
    """Drop all scratch tables and folders that operators made in this session.

    To be called when no result is read any more: results are lazy and may read from them.
    """
    roots, tables = _MADE.pop(id(spark.sparkContext), ([], []))
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in roots:
        delete(spark, path)


def open_bucketed(spark: SparkSession, path: str, columns: str, keys: list[str], buckets: int) -> DataFrame:
    """A table that was written in buckets to ``path``, also in an earlier session."""
    name = f"graphlens_open_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    _MADE.setdefault(id(spark.sparkContext), ([], []))[1].append(name)
    return spark.table(name)


class Scratch:
    """Intermediate tables of one operator run, under the shared folder.

    A written table cuts lineage and, unlike executor-local blocks, outlives lost executors.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _MADE.setdefault(id(spark.sparkContext), ([], []))[0].append(self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def save_bucketed(self, df: DataFrame, name: str, keys: list[str], split: str | None = None, placed: bool = False, buckets: int | None = None, path: str | None = None) -> DataFrame:
        """Write ``df`` in buckets of ``keys``, one file for each bucket (and value of ``split``).

        Joins and groupings of such tables by these keys need no shuffle. ``placed``: each task of ``df``
        has just one bucket already, as after a merge of buckets.
        """
        n = buckets or shuffle_partitions(self.spark)
        table_name = f"graphlens_{name}_{uuid.uuid4().hex[:12]}"
        writer = (df if placed else df.repartition(n, *keys)).write.format("parquet").bucketBy(n, *keys).sortBy(*keys)
        if split:
            writer = writer.partitionBy(split)
        writer.option("path", path or self.path(name)).saveAsTable(table_name)
        _MADE[id(self.spark.sparkContext)][1].append(table_name)
        return self.spark.table(table_name)

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete the files of saved tables which nothing reads any more."""
        for df in tables:
            if (path := getattr(df, "_scratch_path", None)) is not None:
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def rename(spark: SparkSession, source: str, to: str) -> bool:
    """Atomic on file systems with an atomic rename; false if ``to`` exists already."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(to)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (not fs.exists(b)) and fs.rename(a, b)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written by the driver."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, read by the driver."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``; none where it does not exist."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
