"""Tables between jobs, in the folder that the cluster names in ``spark.checkpoint.dir``.

Executors and driver all reach that folder, so a lost executor costs a retry and never a result. Only a single-machine
session (``local[...]``) may do without the setting: it gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[str] = []
#: Paths by the frames that read them, while those live.
_saved: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="cohortlab-"))
    return _own[0]


def fresh_path(spark: SparkSession, name: str, work_dir: str | None = None) -> str:
    """A path that nothing else uses; :func:`clear` removes it."""
    path = f"{work_dir or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def save(df: DataFrame, name: str, work_dir: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that was written: lineage ends here."""
    path = fresh_path(df.sparkSession, name, work_dir)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _saved[out] = path
    return out


def drop(*tables: DataFrame) -> int:
    """Remove tables that :func:`save` returned, once no frame that reads them is needed; returns how many went."""
    paths = [_saved.pop(t, None) for t in tables]
    return sum(_remove(t.sparkSession, p) for t, p in zip(tables, paths, strict=True) if p)


def clear(spark: SparkSession) -> int:
    """Remove all tables and files that this driver has made so far, once no frame that reads them is needed; returns how
    many paths went."""
    return sum(_remove(spark, p) for p in list(_made))


def _remove(spark: SparkSession, name: str) -> int:
    if name not in _made:
        return 0
    _made.remove(name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return int(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
