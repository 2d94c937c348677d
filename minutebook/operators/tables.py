"""Parquet tables with atomic states: bucketed files named by a manifest, so readers see one whole state or the next.

A state is a manifest: for each bucket the folder that holds it. A change writes new folders for the buckets it touches
and then a manifest with the next number, by a rename that fails if another writer was first. Folders that no kept
manifest names are deleted with the state before the last, so a reader of the last state never loses a file.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minutebook.operators import merge


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _states(spark: SparkSession, path: str) -> list[int]:
    _, fs, p = _files(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removeprefix("manifest-").removesuffix(".json")) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def _manifest(spark: SparkSession, path: str, number: int) -> dict[str, str]:
    jvm, fs, p = _files(spark, f"{path}/manifest-{number}.json")
    stream = fs.open(p)
    text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def _commit(spark: SparkSession, path: str, number: int, manifest: dict[str, str]) -> None:
    jvm, fs, ready = _files(spark, f"{path}/manifest-{number}.json")
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/_draft-{number}.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(ready) or not fs.rename(draft, ready):
        raise RuntimeError(f"another writer has made state {number} of {path}")
    kept = set(manifest.values())
    states = _states(spark, path)
    if len(states) > 1:
        kept |= set(_manifest(spark, path, states[-2]).values())
    for old in states[:-2]:
        for folder in set(_manifest(spark, path, old).values()) - kept:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}"), True)
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-{old}.json"), False)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The last state, or None if there is none yet."""
    states = _states(spark, path)
    if not states:
        return None
    folders = sorted(set(_manifest(spark, path, states[-1]).values()))
    return spark.read.parquet(*[f"{path}/{f}" for f in folders])


def publish(rows: DataFrame, path: str) -> None:
    """Replace the whole table."""
    spark = rows.sparkSession
    number = (_states(spark, path) or [0])[-1] + 1
    rows.write.mode("overwrite").parquet(f"{path}/state-{number}")
    _commit(spark, path, number, {"all": f"state-{number}"})


def upsert(batch: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = 64) -> None:
    """Put the last row of each key, by order, into a table; running a batch again changes nothing. Only the buckets
    that the batch touches are read and written; a table is bucketed by its first upsert, and a published one is then
    bucketed as a whole."""
    spark = batch.sparkSession
    states = _states(spark, path)
    manifest = _manifest(spark, path, states[-1]) if states else {}
    number = (states or [0])[-1] + 1
    new = merge.keep_last(batch, keys, order).withColumn("_bucket", _bucket(keys, buckets))
    touched = [r._bucket for r in new.select("_bucket").distinct().collect()]  # at most a row a bucket
    if not touched and states:
        return
    held = [manifest["all"]] if "all" in manifest else [manifest[str(b)] for b in touched if str(b) in manifest]
    if held:
        old = spark.read.parquet(*[f"{path}/{f}" for f in sorted(set(held))]).select(*batch.columns).withColumn("_bucket", _bucket(keys, buckets))
        new = merge.keep_last(old.unionByName(new), [*keys, "_bucket"], order)
    folder = f"state-{number}"
    new.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/{folder}")
    _, fs, p = _files(spark, f"{path}/{folder}")
    fresh = {s.getPath().getName().removeprefix("_bucket="): f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.getPath().getName().startswith("_bucket=")}
    kept = {} if "all" in manifest else manifest
    _commit(spark, path, number, {**kept, **fresh} or {"all": folder})
