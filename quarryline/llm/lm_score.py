"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs are gathered from all training texts: each task counts hashes in
pieces and ships one row a piece and part (packed hashes and counts), so a very common word costs a
few bytes a piece. A part is a range of hashes of one kind, of which there are the more the more there is to learn from; its task sums the counts exactly and writes its
part of the filter. The count c of an n-gram is quantised to q = 1 + floor(log(c) / log(base)); the n-gram
is stored with each level 1..q. All probes of an n-gram stay in its part of the filter, so
parts are built apart and put side by side. A count is read back by probing levels until one is missing.

Every part has ``bits_each`` bits for each level it holds, so the share of false positives is the same at every size of input
and the filter grows with what is learnt. Up to ``max_bytes`` it is broadcast. A larger one stays a table: the distinct
n-grams of each batch of texts are sent to their parts (a range of parts takes all its questions at once), probed there, and the levels sent back to the batch. Both ways
give the same scores. The plain base score needs exact counts:
the ``head`` most frequent words are broadcast (a fixed bound), all others are looked up by a join on
the word's hash, after they are summed within each document.

The model: p(w | v) = (c(v w) + mu * p(w)) / (c(v) + mu), p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), with counts read
from the filter; every text ends with one end token, and begins after one.

Edge cases: null and empty texts are one end token; rows given twice are scored twice, and learnt
twice; a null doc_id counts as the empty text for the fold; with nothing to learn from, N = V = 0.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import U64, as_signed, crc_fold, cut, mix64, ragged, table
from quarryline.llm.words import Words, slices

#: The hash of the end token.
END = U64(0xE7037ED1A0B428DB)
PIECE = 1 << 20
PROBES = 3
#: Tokens whose counts one task sums.
TASK_TOKENS = 1 << 22
#: The levels that a count can have.
LEVELS = 64
PAIR = (U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03))
LEVEL = U64(0xA0761D6478BD642F)


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = before * PAIR[0]
        x += word * PAIR[1]
        x += U64(1)
        return mix64(x)


def quantised(counts: np.ndarray, base: float) -> np.ndarray:
    return (1 + np.floor(np.log(counts) / math.log(base) + 1e-9)).astype(np.int64)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, an end after each text, and where each text's tokens begin and the last end."""
    words = Words(column)
    n = len(column)
    edges = words.edges + np.arange(n + 1)
    out = np.full(len(words.starts) + n, END, dtype=U64)
    inside = np.ones(len(out), dtype=bool)
    inside[edges[1:] - 1] = False
    out[inside] = words.hashes(lower=True)
    return out, edges


def counted(segment_bits: int):
    """A function for mapInArrow: texts -> packed counts by part, words first, then pairs. The hash's top bits are the segment."""
    segments = 1 << segment_bits

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(held)
        held.clear()
        for kind in (1, 0):  # words last, for they are sorted in place
            hashes = pair_hash(np.concatenate([[END], flat[:-1]]), flat) if kind else flat
            hashes.sort()
            head = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            seen, n = hashes[head], np.diff(head, append=len(hashes))
            del hashes, head
            edges = np.searchsorted(seen >> U64(64 - segment_bits), np.arange(segments + 1, dtype=U64))
            full = np.flatnonzero(np.diff(edges))
            for at in range(0, len(full), 64):
                part = full[at : at + 64]
                ranges = [(edges[s], edges[s + 1]) for s in part.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(part + kind * segments, pa.int32()), pa.array([seen[a:b].tobytes() for a, b in ranges], pa.binary()), pa.array([packed(n[a:b]) for a, b in ranges], pa.binary())], ["part", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for batch in slices(whole, most=4 << 20):
                held.append(tokens_of(batch.column("text"))[0])
                size += len(held[-1])
                if size >= PIECE:
                    yield from flush(held)
                    size = 0
        if size:
            yield from flush(held)

    return run


def packed(counts: np.ndarray) -> bytes:
    """A byte each; counts from 255 on follow as longs."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data[:n], dtype=np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[n:], dtype=np.int64)
    return counts


def summed(parts: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and exact counts of one part, its pieces merged a few at a time."""
    seen, total = np.zeros(0, U64), np.zeros(0, np.int64)
    wait: list[tuple] = []
    held = 0

    def merge() -> None:
        nonlocal seen, total, held
        h = np.concatenate([seen, *(x[0] for x in wait)])
        c = np.concatenate([total, *(x[1] for x in wait)])
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        fresh = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        seen, total = h[fresh], np.add.reduceat(c, fresh) if len(fresh) else c
        wait.clear()
        held = 0

    for batch in parts:
        for hashes, counts in zip(batch.column("hashes"), batch.column("counts"), strict=True):
            h = np.frombuffer(hashes.as_py(), dtype=U64)
            wait.append((h, unpacked(counts.as_py(), len(h))))
            held += len(h)
            if held > max(500_000, len(seen)):
                merge()
    merge()
    return seen, total


def levels_hash(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = mix64(hashes + LEVEL * U64(level))
        return x, mix64(x) | U64(1)


def levels_in(data: np.ndarray, hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The highest level of each hash before the first missing one; its bits are ``size`` from ``first`` on."""
    out = np.zeros(len(hashes), dtype=np.uint8)
    alive = np.arange(len(hashes))
    for level in range(1, LEVELS):
        if not len(alive):
            break
        x, y = levels_hash(hashes[alive], level)
        at, width = first[alive], size[alive]
        held = width > 0
        for k in range(PROBES):
            bit = at + placed(x, y, k, width)
            held &= (data[np.where(held, bit >> 3, 0)] >> (bit & 7).astype(np.uint8)) & 1 == 1
        alive = alive[held]
        out[alive] = level
    return out


def placed(x: np.ndarray, y: np.ndarray, k: int, size: np.ndarray) -> np.ndarray:
    """The place of probe ``k`` among ``size`` bits (fewer than 2 ** 32)."""
    with np.errstate(over="ignore"):
        return ((((x + y * U64(k)) >> U64(32)) * size.astype(U64)) >> U64(32)).astype(np.int64)


def middles(base: float) -> np.ndarray:
    """The count that each level stands for: the middle of those quantised to it; 0 for none."""
    low = [math.ceil(base ** (q - 1) - 1e-9) for q in range(1, LEVELS)]
    return np.array([0.0] + [(a + max(a, math.ceil(base ** (k + 1) - 1e-9) - 1)) / 2 for k, a in enumerate(low)])


class CountFilter:
    """The filter's bits, its parts one after the other."""

    def __init__(self, segment_bits: int, parts: list) -> None:
        self.segment_bits = segment_bits
        held = {row["part"]: row["bits"] for row in parts}
        sizes = np.array([len(held.get(k, b"")) for k in range(2 << segment_bits)], dtype=np.int64)
        self.first, self.size = (np.cumsum(sizes) - sizes) * 8, sizes * 8
        self.bytes = np.frombuffer(b"".join(held[k] for k in sorted(held)) or bytes(1), dtype=np.uint8)

    def levels(self, hashes: np.ndarray, kind: int) -> np.ndarray:
        part = (hashes >> U64(64 - self.segment_bits)).astype(np.int64) + (kind << self.segment_bits)
        return levels_in(self.bytes, hashes, self.first[part], self.size[part])


class Model:
    def __init__(self, n: int, v: int, head: tuple[np.ndarray, np.ndarray], mu: float, base: float) -> None:
        self.n, self.v, self.head, self.mu, self.middles = n, v, head, mu, middles(base)

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.n + 0.5 * (self.v + 1))

    def log_probability(self, tokens: np.ndarray, grams: Grams, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """log10 p of every token after the one before it, from the levels of all distinct words and pairs."""
        c1 = self.middles[words][grams.word_of]
        cb = np.concatenate([[self.middles[words[grams.end]]], c1[:-1]]) if len(c1) else c1
        c2 = np.minimum(self.middles[pairs][grams.pair_of], np.minimum(c1, cb))
        return np.log10((c2 + self.mu * self.base(c1)) / (cb + self.mu))

    def known(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact counts of the frequent words; whether each token is one."""
        hashes, counts = self.head
        if not len(hashes):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        at = np.minimum(np.searchsorted(hashes, tokens), len(hashes) - 1)
        hit = hashes[at] == tokens
        return np.where(hit, counts[at], 0), hit


class Grams:
    """The distinct words and pairs of a batch, sorted, and which of them stands where."""

    def __init__(self, tokens: np.ndarray, words: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.words, self.word_of = words or np.unique(tokens, return_inverse=True)
        self.pairs, self.pair_of = np.unique(pair_hash(np.concatenate([[END], tokens[:-1]]), tokens) if len(tokens) else tokens, return_inverse=True)
        self.end = int(np.searchsorted(self.words, END))  # every batch has an end token


def gathered(pieces: DataFrame, segment_bits: int, base: float, bits_each: int) -> DataFrame:
    """Sums every part exactly: its range of the filter (part, bits), and for words each hash and count (h, c)."""

    def run(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        seen, total = summed(parts)
        q = quantised(total, base)
        size = 8 * max(8, -(-int(q.sum()) * bits_each // 8))
        bits = np.zeros(size, dtype=bool)
        for level in range(1, int(q.max(initial=0)) + 1):
            x, y = levels_hash(seen[q >= level], level)
            for k in range(PROBES):
                bits[placed(x, y, k, np.array(size))] = True
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], ["part", "bits", "h", "c"])
        for at in range(0, len(seen) if part < 1 << segment_bits else 0, 100_000):
            h, c = seen[at : at + 100_000], total[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.binary()), as_signed(h), pa.array(c)], ["part", "bits", "h", "c"])

    return pieces.groupBy("part").applyInArrow(run, "part int, bits binary, h long, c long")


def learn(training: DataFrame, base: float = 2.0, mu: float = 50.0, head: int = 1 << 18, bits_each: int = 12, part_tokens: int = 1 << 19) -> tuple[Model, int, DataFrame, DataFrame]:
    """The model, how many bits number a segment, the filter's parts (part, bits) and the exact word counts (h, c). ``training`` has ``text``."""
    # the number of parts follows the number of words, of which there are about a sixth as many as characters
    size = training.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("texts")).first()
    tokens = (size["chars"] or 0) / 6 + size["texts"]
    segment_bits = int(np.clip(np.ceil(np.log2(max(1, tokens / part_tokens))), 8, 24))
    pieces = training.select("text").mapInArrow(counted(segment_bits), "part int, hashes binary, counts binary")
    # the tasks that sum grow in number, not in size
    tasks = max(int(training.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(tokens / TASK_TOKENS))
    pieces = pieces.repartition(tasks, "part")
    found = cut(gathered(pieces, segment_bits, base, bits_each))
    counts, parts = found.where("h IS NOT NULL").select("h", "c"), found.where("bits IS NOT NULL").select("part", "bits")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(head).toArrow()  # the frequent words' fixed bound
    h, c = top.column("h").to_numpy().view(U64), top.column("c").to_numpy()
    order = np.argsort(h)
    return Model(totals["n"] or 0, totals["v"], (h[order], c[order]), mu, base), segment_bits, parts, counts


SCORED = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, times array<int>"


def scored(model: Model, flat: np.ndarray, sizes: np.ndarray, grams: Grams, words: np.ndarray, pairs: np.ndarray, ids: pa.Array, held_out: pa.Array) -> pa.RecordBatch:
    """A batch's rows: exact sums over the frequent words, the others with how often they come, and the score."""
    edges = np.concatenate([[0], np.cumsum(sizes)])
    c, hit = model.known(flat)
    add = lambda x: np.add.reduceat(x, edges[:-1])
    base = add(np.where(hit, np.log10(model.base(c)), 0.0))
    at = np.flatnonzero(~hit)
    owner = np.searchsorted(edges, at, side="right") - 1
    order = np.lexsort((flat[at], owner))
    h, o = flat[at][order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, np.int64)
    lengths = np.bincount(o[head], minlength=len(sizes))
    lists = [ragged(h[head].view(np.int64), lengths, pa.int64()), ragged(np.diff(head, append=len(h)), lengths, pa.int32())]
    score = add(model.log_probability(flat, grams, words, pairs))
    return pa.RecordBatch.from_arrays([ids, held_out, pa.array(sizes), pa.array(add(hit.astype(np.int64))), pa.array(base), pa.array(score), *lists], [x.split()[0] for x in SCORED.split(", ")])


def by_broadcast(documents: DataFrame, model: Model, segment_bits: int, parts: DataFrame) -> DataFrame:
    """Scores with the whole filter on every worker."""
    held = documents.sparkSession.sparkContext.broadcast((model, CountFilter(segment_bits, parts.toLocalIterator())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, counts = held.value
        for whole in batches:
            for batch in slices(whole, most=2 << 20):
                flat, edges = tokens_of(batch.column("text"))
                grams = Grams(flat)
                yield scored(m, flat, np.diff(edges), grams, counts.levels(grams.words, 0), counts.levels(grams.pairs, 1), batch.column("doc_id"), batch.column("held_out"))

    return documents.select("doc_id", "held_out", "text").mapInArrow(run, SCORED)


def by_part(documents: DataFrame, model: Model, segment_bits: int, parts: DataFrame) -> DataFrame:
    """Scores with each shelf of the filter in one place: a batch's distinct n-grams go there, and their levels come back.

    A shelf is a range of parts, learnt from some ``TASK_TOKENS`` tokens. Its questions are answered together, so the
    steps that are taken are as many as there are shelves, not as there are batches times parts.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    names = ["batch", "shelf", "hashes", "words", "ids", "held", "sizes"]
    kinds = [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
    shelf_bits = min(segment_bits, max(0, math.ceil(math.log2(max(1, model.n / TASK_TOKENS)))))
    shelves = 1 << shelf_bits

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=4 << 20):
                name = os.urandom(16)  # the rows are written before they are read, so each batch has one name
                flat, edges = tokens_of(batch.column("text"))
                grams = Grams(flat)
                own = [[name], [-1], [grams.words.tobytes()], [grams.word_of.astype(np.uint32).tobytes()], [batch.column("doc_id").to_pylist()], [batch.column("held_out").to_pylist()], [np.diff(edges).tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(own, kinds, strict=True)], names)
                for kind, hashes in enumerate((grams.words, grams.pairs)):
                    top = hashes >> U64(64 - shelf_bits) if shelf_bits else np.zeros(len(hashes), U64)
                    bounds = np.searchsorted(top, np.arange(shelves + 1, dtype=U64))
                    full = np.flatnonzero(np.diff(bounds))
                    rows = [hashes[bounds[s] : bounds[s + 1]].tobytes() for s in full.tolist()]
                    none = [pa.nulls(len(full), k) for k in kinds[3:]]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.binary()), pa.array(full + kind * shelves, pa.int32()), pa.array(rows, pa.binary()), *none], names)

    def answered(rows: pa.Table, some: pa.Table) -> pa.Table:
        out, at = [], 0
        counts = CountFilter(segment_bits, [{"part": p.as_py(), "bits": x.as_py()} for p, x in zip(some.column("part"), some.column("bits"), strict=True)])
        asked_for = [np.frombuffer(x.as_py(), dtype=U64) for x in rows.column("hashes")]
        ends = np.cumsum([0, *(len(x) for x in asked_for)])
        while at < len(asked_for):  # about PIECE hashes at a time
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, side="right")) - 1)
            found = counts.levels(np.concatenate(asked_for[at:to]), int(rows.column("shelf")[0].as_py() >= shelves)).tobytes()
            out += [found[a:b] for a, b in zip((ends[at:to] - ends[at]).tolist(), (ends[at + 1 : to + 1] - ends[at]).tolist(), strict=True)]
            at = to
        return pa.table({"batch": rows.column("batch"), "shelf": rows.column("shelf"), "levels": pa.array(out, pa.binary())})

    def put_together(own: pa.Table, answers: pa.Table) -> pa.Table:
        distinct, word_of = np.frombuffer(own.column("hashes")[0].as_py(), dtype=U64), np.frombuffer(own.column("words")[0].as_py(), dtype=np.uint32).astype(np.int64)
        flat = distinct[word_of]
        shelf = answers.column("shelf").to_numpy()
        order, split = np.argsort(shelf), int((shelf < shelves).sum())
        found = answers.column("levels").to_pylist()
        words, pairs = (np.frombuffer(b"".join(found[k] for k in some), dtype=np.uint8) for some in (order[:split], order[split:]))
        sizes = np.array(own.column("sizes")[0].as_py(), dtype=np.int64)
        ids, flags = (pa.array(own.column(c)[0].as_py(), k) for c, k in (("ids", pa.int64()), ("held", pa.bool_())))
        return pa.Table.from_batches([scored(held.value, flat, sizes, Grams(flat, (distinct, word_of)), words, pairs, ids, flags)])

    rows = cut(documents.select("doc_id", "held_out", "text").mapInArrow(asked, "batch binary, shelf int, hashes binary, words binary, ids array<long>, held array<boolean>, sizes array<long>"))
    shelved = parts.select(F.shiftright("part", segment_bits - shelf_bits).alias("shelf"), "part", "bits")
    levels = rows.where("shelf >= 0").select("batch", "shelf", "hashes").groupBy("shelf").cogroup(shelved.groupBy("shelf")).applyInArrow(lambda a, b: answered(a, b), "batch binary, shelf int, levels binary")
    return rows.where("shelf < 0").groupBy("batch").cogroup(levels.groupBy("batch")).applyInArrow(lambda a, b: put_together(a, b), SCORED)


def score(documents: DataFrame, learnt: tuple[Model, int, DataFrame, DataFrame], max_bytes: int = 1 << 27) -> DataFrame:
    """Adds n_tokens, n_known, base_score and score to doc_id and held_out. A filter above ``max_bytes`` is not broadcast."""
    model, segment_bits, parts, counts = learnt
    size = parts.agg(F.sum(F.length("bits"))).first()[0] or 0
    found = (by_broadcast if size <= max_bytes else by_part)(documents, model, segment_bits, parts)
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))  # rows without texts; read twice below
    unseen = F.lit(math.log10(0.5 / (model.n + 0.5 * (model.v + 1))))
    rare = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    met = rare.join(counts, "h", "left")
    p = F.when(F.col("c").isNull(), unseen).otherwise(F.log10((F.col("c") + 0.5) / F.lit(model.n + 0.5 * (model.v + 1))))
    tail = met.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"), F.sum(p * F.col("times")).alias("tail_base"))
    done = found.drop("rare", "times").join(tail, "row", "left")
    zero = F.lit(0)
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", zero)).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("tail_base", zero)).alias("base_score"), "score",
    )


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_fold() == 1).alias("held_out"))
    return score(documents, learn(documents.where("not held_out")))
