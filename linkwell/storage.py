"""Tables of the driver's data folder, and scratch tables that every executor can read.

Scratch lies below ``spark.checkpoint.dir``.  Only where that setting is absent and the master is ``local`` (tests on
one machine) a temporary folder takes its place; a cluster without the setting is refused.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="linkwell-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return f"file://{_own[app]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/linkwell/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a scratch table and read it back: later jobs start there, whatever executors are lost."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


_stored: dict[tuple, tuple[list, DataFrame]] = {}


def stored(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A frame that ``make`` derives from tables: written at first and read from then on, until one of the tables is written anew."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    stamps = []
    for t in tables:
        where = hadoop.Path(f"{sf_dir}/{t}.parquet")
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        stamps.append((status.getModificationTime(), status.getLen()))
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored or _stored[key][0] != stamps:
        _stored[key] = (stamps, materialize(make(spark, sf_dir), name))
    return _stored[key][1]


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in frames:
        if path := getattr(df, "_scratch_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def listing(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def claim(spark: SparkSession, path: str, text: str) -> None:
    """Make a file at once and whole, or raise FileExistsError if there is one: of several writers one succeeds."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where, draft = hadoop.Path(path), hadoop.Path(f"{path.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    files = where.getFileSystem(conf)
    files.mkdirs(where.getParent())
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    keep = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    keep[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(where.toUri(), conf).rename(draft, where, keep)
    except Exception as e:
        files.delete(draft, False)
        if files.exists(where):
            raise FileExistsError(path) from e
        raise
