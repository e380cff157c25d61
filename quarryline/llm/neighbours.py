"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

Every table turns a unit vector by two fast Hadamard pseudo-rotations (three rounds of signs and a Hadamard
transform each) and hashes it to the pair of nearest signed axes. A query probes in every table the
``probes`` pairs of axes with the highest sums of coordinates; what shares a bucket is compared by the exact
distance of the original vectors in double precision. A table has (2 d) ** 2 buckets, so a bucket's share
of the rows does not grow with them.

Of equal vectors only those with the smallest ids, one more than asked for, can be among any query's nearest,
so the others are set aside before hashing (ranked within each task first); no result changes. Buckets are
counted, and one with more than ``block`` rows is split in blocks by a hash; probes go to all its blocks. Blocks
and their probes are dealt out by hash into groups of about ``block`` rows, and what leaves a group is each
query's nearest there: pairs are never rows.

Edge cases: vectors that are null, zero, or hold null, NaN or infinite numbers take no part, nor do null ids;
queries are compared with vectors of their own length only; ids given twice are one candidate; of queries with equal ids the one with the
smallest vector is asked; a query for which fewer than ``k`` are found is compared with all vectors of its length, block by block; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import cut, dealt, table

SEED = 20_11
BLOCK = 50_000
TABLES, PROBES = 16, 400
#: Up to so many buckets above the block size are broadcast (some 50 bytes each).
MOST_LARGE = 100_000


def turned(x: np.ndarray, number: int) -> np.ndarray:
    """Rows turned by pseudo-rotation ``number``: three times random signs and a Hadamard transform."""
    d = x.shape[1]
    signs = np.random.default_rng([SEED, number, d]).choice([-1.0, 1.0], size=(3, d))
    for s in signs:
        x = x * s
        width = 1
        while width < d:
            y = x.reshape(len(x), d // (2 * width), 2, width)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), d)
            width *= 2
        x = x / np.sqrt(d)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, filled up with zeros to a power of two."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def axis_scores(x: np.ndarray, number: int) -> np.ndarray:
    """Coordinates along all signed axes."""
    y = turned(x, number)
    return np.concatenate([y, -y], axis=1)


def buckets(x: np.ndarray, t: int) -> np.ndarray:
    one, two = axis_scores(x, 2 * t), axis_scores(x, 2 * t + 1)
    return one.argmax(axis=1) * one.shape[1] + two.argmax(axis=1)


def probed(x: np.ndarray, t: int, probes: int) -> np.ndarray:
    """The ``probes`` likeliest buckets of each row in table ``t``, the own one first."""
    one, two = axis_scores(x, 2 * t), axis_scores(x, 2 * t + 1)
    n = one.shape[1]
    m = min(n, probes)
    a, b = np.argsort(-one, axis=1, kind="stable")[:, :m], np.argsort(-two, axis=1, kind="stable")[:, :m]
    # how far the sum of squared coordinates falls behind the best pair's
    fall = lambda s, at: (np.take_along_axis(s, at[:, :1], 1) - np.take_along_axis(s, at, 1)) ** 2
    total = fall(one, a)[:, :, None] + fall(two, b)[:, None, :]
    best = np.argsort(total.reshape(len(x), -1), axis=1, kind="stable")[:, :probes]
    i, j = np.divmod(best, m)
    return np.take_along_axis(a, i, 1) * n + np.take_along_axis(b, j, 1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def hashed(tables: int, probes: int):
    """A function for mapInArrow: id, dim, v -> a row a table (and probe): bucket, id, dim, and v where there is one probe."""
    kept = ("id", "dim", "v") if probes == 1 else ("id", "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = whole.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, 2000 if probes == 1 else 200):
                    batch = part.slice(at, 2000 if probes == 1 else 200)
                    x = unit(_matrix(batch.column("v"), dim).astype(np.float64))
                    for t in range(tables):
                        found = buckets(x, t)[:, None] if probes == 1 else probed(x, t, probes)
                        n, width = found.shape
                        rows = batch.take(pa.array(np.repeat(np.arange(n), width)))
                        yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1) * tables + t), *(rows.column(c) for c in kept)], ["bucket", *kept])

    return run


FOUND = "query_id long, vec_id long, score double"


def nearest_within(k: int):
    """A function for cogroup: a group's blocks and probes -> the k nearest of each query there."""

    def run(rows: pa.Table, probes: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not rows.num_rows or not probes.num_rows:
            return none
        out: list[tuple] = []
        dims = rows.column("dim").to_numpy()
        for dim in np.intersect1d(dims, probes.column("dim").to_numpy()).tolist():
            have, ask = (x.filter(pa.array(x.column("dim").to_numpy() == dim)).combine_chunks() for x in (rows, probes))
            order = np.argsort(have.column("place").to_numpy(), kind="stable")
            places, ids = have.column("place").to_numpy()[order], have.column("id").to_numpy()[order]
            v = _matrix(have.column("v").chunk(0), dim)[order]
            w, q = _matrix(ask.column("v").chunk(0), dim).astype(np.float64), ask.column("id").to_numpy()
            for row in range(len(q)):
                probe = ask.column("places").chunk(0)[row].values.to_numpy()
                lo, hi = np.searchsorted(places, probe, side="left"), np.searchsorted(places, probe, side="right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                _, first = np.unique(ids[at], return_index=True)  # a row comes from several tables
                at = at[first]
                at = at[ids[at] != q[row]]
                score = np.sqrt(((v[at].astype(np.float64) - w[row]) ** 2).sum(axis=1))
                best = np.lexsort((ids[at], score))[:k]
                out.append((np.full(len(best), q[row]), ids[at][best], score[best]))
        if not out:
            return none
        q, i, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """vectors, queries (vec_id, embedding) -> query_id, rank, vec_id, score: each query's ``k`` nearest found, its own id left out."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<float>" if single else "array<double>")
        sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & sound).select("id", F.size("v").alias("dim"), "v")

    copies = Window.partitionBy("v").orderBy("id")
    kept = cut(clean(vectors).distinct().withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).select("id", "dim", "v"))
    schema = f"bucket long, id long, dim int, v array<{'float' if single else 'double'}>"
    index = cut(dealt(kept, "id").mapInArrow(hashed(tables, 1), schema))
    rows = index.count()
    groups = max(1, -(-rows // block))
    large = cut(index.groupBy("bucket", "dim").count().where(F.col("count") > block).select("bucket", "dim", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    if large.count() <= MOST_LARGE:
        large = F.broadcast(large)
    split = F.coalesce(F.col("blocks"), F.lit(1))
    filed = index.join(large, ["bucket", "dim"], "left").withColumn("block", F.pmod(F.xxhash64("id"), split).cast("int"))
    own = cut(clean(queries).groupBy("id").agg(F.min("v").alias("v")).select("id", F.size("v").alias("dim"), "v"))
    asked = dealt(own, "id").mapInArrow(hashed(tables, probes), "bucket long, id long, dim int").join(large, ["bucket", "dim"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), split - 1)))
    group = F.pmod(F.xxhash64("bucket", "dim", "block"), F.lit(groups)).alias("g")
    place = F.col("bucket") * (1 << 20) + F.col("block")
    left = filed.select(group, place.alias("place"), "id", "dim", "v")
    right = asked.select(group, place.alias("place"), "id").groupBy("g", "id").agg(F.collect_list("place").alias("places")).join(own, "id").select("g", "id", "dim", "v", "places")
    found = left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(lambda a, b: nearest_within(k)(a, b), FOUND)
    met = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = cut(met.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    short = cut(own.join(ranked.where(F.col("rank") == k), F.col("id") == F.col("query_id"), "left_anti"))
    if short.isEmpty():
        return ranked
    left = kept.select(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g"), F.lit(0).cast("long").alias("place"), "id", "dim", "v")
    right = short.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), "id", "dim", "v", F.array(F.lit(0).cast("long")).alias("places"))
    exact = left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(lambda a, b: nearest_within(k)(a, b), FOUND)
    exact = exact.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(rank))
    full = ranked.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    return full.unionByName(exact.where(F.col("rank") <= k)).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
