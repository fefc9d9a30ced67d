"""Session builder and working storage shared by all jobs."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "cladeworks", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where none is set, a temporary one, if all tasks run in this process (tests); on a cluster that is an error, since
    executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-work-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that were written inside of each open ``temporary`` block.
_made: list[list[str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder. Inside of a ``temporary`` block the folder is removed at the block's end."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def settle(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    With ``path`` it is written there, and stays when a ``temporary`` block ends.
    """
    if path is None:
        path = folder(df.sparkSession, name)
    else:
        for made in _made:
            made[:] = [x for x in made if x != path]
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *folders: str) -> None:
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for x in folders:
        path = jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(hadoop).delete(path, True)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is settled inside goes when the block ends; tables read from it can't be used after that."""
    _made.append([])
    try:
        yield
    finally:
        remove(spark, *_made.pop())
