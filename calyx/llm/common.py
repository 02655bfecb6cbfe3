"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space between words: space and \t \n \v \f \r (fixed by the word contract).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="calyx-llm-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the
    lineage ends there, and a lost executor costs no earlier work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/calyx-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, most: int) -> DataFrame:
    """``df`` to be sent to every task in a join if it is counted and has at most
    ``most`` rows; else as it is, for a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows of an Arrow batch: whole texts are long, and a batch is held by the JVM and by Python.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH`` rows, where the session doesn't set their size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "-1") == "-1":
        spark.conf.set(key, str(BATCH))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def crc32_sql(value: str) -> str:
    """``bucket_of`` without its modulus in DuckDB SQL, for ASCII: the bits of each character are shifted out one by one."""
    bits = "[x] || [-1, -1, -1, -1, -1, -1, -1, -1]"
    return (f"xor(4294967295, list_reduce(flatten(list_transform(string_split({value}, ''), lambda c: list_transform([ascii(c)], lambda x: {bits})[1])), "
            "lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, 4294967295::bigint))")


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text; bytes.split() splits at exactly the
    six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def batches(frames: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``size`` rows."""
    for b in frames:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, name: str, rounds: int = 50) -> DataFrame:
    """Connected components of ``edges(src, dst)``: (id, component), the
    smallest reachable id, for every id that has an edge.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every
    step is a grouped minimum, which is combined before the shuffle, and a join
    that Spark may split where one id holds a large part of the edges.
    """
    e = stage(edges.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
              .distinct(), f"{name}-edges")
    for _ in range(rounds):
        both = e.union(e.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.toDF("u", "v")).where("u != v").distinct())
        new = stage(small, f"{name}-star")
        same = new.exceptAll(e).limit(1).count() == 0 and new.count() == e.count()
        e = new
        if same:
            ids = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return ids.union(e.select(F.col("v"), F.col("v")).distinct())
    raise RuntimeError(f"{name}: components did not settle in {rounds} rounds")
