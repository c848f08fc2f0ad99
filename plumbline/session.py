"""Session helpers: a local session for tests, the shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import gc
import json
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_local_folder: str | None = None


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each context: they may lack it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_plumbline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="plumbline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "plumbline_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._plumbline_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only a local master, whose
    executors are this process, falls back to a temporary folder.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        folder = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_folder = "file://" + folder
    return _local_folder


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/plumbline-{purpose}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file of the shared folder, None where there is none."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """The same replaced by a rename that overwrites, after the new file is complete: a crash leaves the old or the new one."""
    fs, new = _file(spark, f"{path}.new")
    stream = fs.create(new, True)
    stream.write(json.dumps(value).encode())
    stream.close()
    _, final = _file(spark, path)
    jvm = spark._jvm
    overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(final), options)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    fs, p = _file(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    fs, p = _file(spark, path)
    fs.delete(p, True)


def register_bucketed(spark: SparkSession, name: str, schema: dict, keys: Sequence[str], buckets: int, path: str) -> None:
    """Makes files of an earlier session, bucketed by the first key and sorted by all, a table again."""
    if spark.catalog.tableExists(name):
        return
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(schema).fields)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys[0]}) SORTED BY ({', '.join(keys)})"
        f" INTO {buckets} BUCKETS LOCATION '{path}'"
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that losing executors costs no recomputation."""
    sc = df.sparkSession.sparkContext
    ship(df.sparkSession)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of finished stages: Spark deletes their shuffle files, broadcasts and checkpoints when the driver collects its garbage, which a small driver may do late."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def scratch_name() -> str:
    """A name for a temporary column that no input column is likely to have."""
    return f"_pl_{uuid.uuid4().hex[:8]}"


