"""Table readers and tables written to shared storage.

Paths go to Spark's readers and writers only, so any file system that the cluster knows will do.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of long work that ``spread`` gives to one task, about.
TASK_ROWS = 50_000


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Tasks for ``df``, as it is stored, so that each has about ``rows`` rows; a stored table's count is in its files' footers."""
    return max(3 * df.sparkSession.sparkContext.defaultParallelism, 1 + df.count() // rows)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, as it is stored, dealt over all cores by its keys: one task reads a small file, too few where each row is long work.

    There are more tasks for more rows, so that what a task holds does not grow with the table.
    """
    return df.repartition(tasks_for(df), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, the session's warehouse is used, which a cluster shares
    as well. Only a local master, whose executors are the driver, gets a temporary folder of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("galley.shared.dir", None)
    if not named:
        if spark.sparkContext.master.startswith("local"):
            named = f"file://{tempfile.mkdtemp(prefix='galley-')}"
        elif spark.sparkContext.getConf().get("spark.sql.warehouse.dir"):
            named = spark.conf.get("spark.sql.warehouse.dir")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("galley.shared.dir", named)
    return named.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The written table cuts the lineage: whatever is read from it later, any number of times, sees the same rows, and a lost
    executor costs a reread instead of a recomputation. The table stays until ``drop_materialised``; whoever asked for the result
    calls that once the result is written, as a result that is still to be computed reads from it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/galley/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(spark: SparkSession) -> None:
    """Delete what this application has written with ``materialise``; tables read from it can't be read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def publish(df: DataFrame, root: str) -> None:
    """Replace the table at ``root`` as a whole: ``df`` is written to a folder of its own, and then a pointer is moved to it.

    Who reads the table meanwhile (``published``) gets the version before or this one, whole. A writer that fails leaves the pointer
    as it was. Of two writers at once the last to finish stands. Earlier versions stay in ``root``, as somebody may still read them.
    The pointer moves by a rename, which the file systems of a cluster do at once; a store without one needs a table format.
    """
    spark = df.sparkSession
    version = f"{root.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.parquet(version)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, pointer = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{version}.pointer", f"{root.rstrip('/')}/current"))
    out = new.getFileSystem(conf).create(new)
    out.write(bytearray(version, "utf-8"))
    out.close()
    rename = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = next(x for x in rename.getEnumConstants() if x.toString() == "OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, pointer, how)


def published(spark: SparkSession, root: str) -> DataFrame:
    """The version of the table at ``root`` that the pointer names now."""
    version = spark.read.text(f"{root.rstrip('/')}/current", wholetext=True).first()[0]
    return spark.read.parquet(version)
