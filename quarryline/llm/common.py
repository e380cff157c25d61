"""What several operators share: reading, cutting lineage, tokenising, hashing, components."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of the contracts.
SPACED_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Lower-cases A to Z and nothing else.
ASCII_LOWER = {code: code + 32 for code in range(65, 91)}

U64 = np.uint64
#: Folders of the tables that ``cut`` wrote in this process.
CUTS: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where none is set, one beside the warehouse, which executors reach as well."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows are written as a table in the shared folder and read again, column by column."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    CUTS.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders, wherever Spark finds them."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession, since: int) -> None:
    """Deletes the tables that :func:`cut` wrote from number ``since`` on: what was read from them must be written by now."""
    removed(spark, *CUTS[since:])
    del CUTS[since:]


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt out over all shuffle partitions, however few bytes they are: for what grows in the next step."""
    # by a hash of the columns, for a repartition by columns that already part the rows is optimised away
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*columns))


def merging(df: DataFrame) -> DataFrame:
    """Rows whose joins are by sorting and merging, whatever their estimated size: none of them goes through the driver."""
    return df.hint("merge")


def named(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def boxed(df: DataFrame, **added: Column) -> DataFrame:
    """All columns in one struct ``row``, and those added: none of theirs can clash with one of ours."""
    return df.select(F.struct(*[named(c) for c in df.columns]).alias("row"), *[x.alias(c) for c, x in added.items()])


def unboxed(df: DataFrame, like: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``like`` out of ``row``, with those of ``new`` in place of theirs or after them."""
    inside = [new.get(c, F.col("row").getField(c)).alias(c) for c in like.columns]
    return df.select(*inside, *[x.alias(c) for c, x in new.items() if c not in like.columns])


def crc_fold(doc_id: str = "doc_id"):
    """crc32 of the id written as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def ascii_lower(text: str) -> str:
    if text.isascii():
        return text.lower()
    return text.translate(ASCII_LOWER)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words, so that sums and products can be cut into bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def as_signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column from its flat values and the length of each list."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=kind))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has ``a`` and ``b`` (one orderable type). Returns ``node`` and ``root``, the smallest
    node that can be reached, for each node that has an edge to another. Every step is a few joins
    and aggregations on edges; only the number of edges and a checksum reach the driver (no join broadcasts). An empty
    graph gives no rows. Stops when nothing changes; raises after ``rounds`` steps.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(merging(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(merging(down), "a").select("a", "b", "m")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        links = cut(small.where("a <> b").distinct())
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == now:
            return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
