"""Session factory, table loading and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_written: list[tuple[SparkSession, str]] = []
_stored: dict[tuple[str, str], DataFrame] = {}


def session(master: str = "local[8]", shuffle: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(master).config(
        map={
            "spark.sql.shuffle.partitions": str(shuffle),
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.sql.warehouse.dir": tempfile.gettempdir() + "/minutebook-warehouse",
        }
        | conf
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; zone-less timestamps become UTC instants so that watermarks and casts work."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a session on one machine takes a
    folder of its own; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="minutebook-")
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(shutil.rmtree, named.removeprefix("file://"), ignore_errors=True)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: one evaluation, no lineage, safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/minutebook-{os.getpid()}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that cut() gave, as soon as nothing reads them any more."""
    for t in tables:
        entry = (t.sparkSession, t._cut_path)
        if entry in _written:
            _written.remove(entry)
            _delete(*entry)


def stored(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that many queries read (an index, entities, vectors): built by the first, kept until release()."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _stored:
        _stored[key] = cut(build())
    return _stored[key]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; its owner removes the folder
        pass


def release() -> None:
    """Delete what cut() has written so far; the tables read from it can't be used afterwards."""
    _stored.clear()
    while _written:
        _delete(*_written.pop())


atexit.register(release)
