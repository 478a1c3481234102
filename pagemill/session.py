"""Session helpers: a tuned local session, the shared work folder, and shipping the package to executors."""

from __future__ import annotations

import atexit
import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "8g", app: str = "pagemill") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where that setting is absent an own folder is made and set, but only on one machine: on a cluster it would lie on
    each node apart, so there the setting is required.
    """
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="pagemill-shared-")
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def _work_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    work = f"{shared_dir(spark)}/pagemill-{sc.applicationId}"
    made = getattr(sc, "_pagemill_work", None)
    if made != work:
        sc._pagemill_work = work

        def clean() -> None:
            try:
                path = sc._jvm.org.apache.hadoop.fs.Path(work)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
            except Exception:
                pass

        atexit.register(clean)
    return work


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder; it goes when the application ends."""
    return f"{_work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table in the shared folder and reads it back.

    The table outlives the loss of any executor, and later readers get column pruning.
    It is removed when the application ends.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The complete tables ``path/v<number>``, the oldest first."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place(path)):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(place(path)))
    return [f"{path.rstrip('/')}/{n}" for n in names if re.fullmatch(r"v\d{8}", n) and files.exists(place(f"{path}/{n}/_SUCCESS"))]


def latest_version(spark: SparkSession, path: str) -> str | None:
    """The last complete version of a table that is kept in versions under ``path``, if there is one."""
    return (_versions(spark, path) or [None])[-1]


def next_version(spark: SparkSession, path: str) -> str:
    """Where to write the version after the last complete one; what an interrupted write left there is removed."""
    last = latest_version(spark, path)
    new = f"{path.rstrip('/')}/v{int(last.rpartition('/v')[2]) + 1 if last else 1:08d}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return new


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application has materialized so far; frames that read them cannot be read again."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(_work_dir(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in every executor's Python, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_pagemill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    place = Path(tempfile.mkdtemp(prefix="pagemill-zip-")) / "pagemill_pkg.zip"
    place.write_bytes(data.getvalue())
    sc.addPyFile(str(place))
    sc._pagemill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in far fewer partitions than there are, as from one small file; else itself.

    Work that no shuffle precedes would otherwise run in one task. Large inputs have enough partitions by their size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()  # plans, but runs nothing
    return df.repartition(cores) if parts * 2 <= cores else df


def once(df: DataFrame, name: str, column) -> DataFrame:
    """``df`` with a column that is computed once for each row, even where later filters and columns use it often.

    A filter on a plain column would be pushed down with a copy of its expression; it is not pushed through a generator.
    """
    return df.withColumn(name, F.explode(F.array(column)))
