"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

Fingerprints are computed once a document and collapsed to distinct values at once, so a group of
copies is one row from there on. Two fingerprints within ``radius`` bits agree, up to
``radius // segments`` bits, on at least one of their segments. So every distinct fingerprint is
filed under each segment's value, looks up the small Hamming ball around it, and the full distance of
what it meets is checked. Links join distinct fingerprints only; components come from star steps. No join
broadcasts a side, for each may have as many rows as there are documents, however few bytes their files have.

The pipeline's stage is on sets of five-word shingles at a similarity of 0.8 (``near_copies``). The prints of such
texts differ in 15 % of their bits, a radius that no few segments of 64 bits serve. So a set has a print of some 200 bits or more, in
segments about as long as the number of texts in bits, and all of a segment's values in a ball of two bits are looked up; there are
so many segments that by calculation one in 10,000 pairs of similarity 0.8 meets in none (of sets under eight shingles, whose majorities turn more often, up to one in
a hundred). The distance over 192 bits is checked first, then every link on the whole sets.

Edge cases: a null or empty text has no words and fingerprint zero, linked like any other; texts of
fewer than three words are one shingle; a null doc_id is fingerprinted but names no component; rows
given twice are in one component. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import as_signed, components, cut, dealt, merging, mix64, ragged, table
from quarryline.llm.words import Words, slices, xxh64

SEED = 42
PIECE = 1 << 17
#: The pipeline's stage: bits of a segment that may differ in a lookup; the share of pairs of the least similarity that no segment may meet;
#: bits that travel with each segment; sets so small that majorities differ more often than angles say; texts a group is made for.
BALL, MISSED, CHECKED, SMALL, TOGETHER = 2, 1e-4, 192, 8, 1 << 18
CHECKS = [f"check{k}" for k in range(CHECKED // 64)]


def shingles(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles, one text after the other, and where each text's begin."""
    words = Words(column)
    data, _ = words.joined(lower=True)
    counts = words.counts()
    lengths = words.ends - words.starts
    firsts = words.edges[:-1]
    gap = np.ones(len(lengths), dtype=np.int64)
    gap[firsts[counts > 0]] = 0
    ends = np.cumsum(lengths + gap)
    starts = ends - lengths
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    at = np.repeat(firsts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    hashes = xxh64(data, starts[at], ends[np.minimum(at + shingle, np.repeat(words.edges[1:], n)) - 1], SEED)
    return hashes, np.concatenate([[0], np.cumsum(n)])


def simhash(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is set if more than half of its shingles' hashes have it."""
    hashes, begins = shingles(column, shingle)
    n = np.diff(begins)
    prints = np.zeros(len(n), dtype=np.uint64)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    full = np.flatnonzero(n)
    edges = np.concatenate([[0], np.cumsum(n[full])])
    k = 0
    while k < len(full):  # documents with about PIECE shingles at a time; a longer one by itself, in parts
        to = max(k + 1, int(np.searchsorted(edges, edges[k] + PIECE, side="right")) - 1)
        ones = np.zeros((to - k, 64), dtype=np.int64)
        for lo in range(edges[k], edges[to], PIECE):
            hi = min(lo + PIECE, edges[to])
            bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            heads = np.maximum(edges[k:to], lo) - lo if to - k > 1 else np.array([0])
            ones += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
        prints[full[k:to]] = ((ones * 2 > n[full[k:to], None]) * weight).sum(axis=1, dtype=np.uint64)
        k = to
    return prints


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, most=4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), as_signed(simhash(batch.column("text")))], ["doc_id", "print"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, print (the fingerprint as a signed long)."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, print long")


def links(prints: DataFrame, radius: int = 2, segments: int = 2) -> DataFrame:
    """Pairs a < b of distinct fingerprints that differ in ``radius`` bits or fewer. ``prints`` has distinct ``print``."""
    width, ball = 64 // segments, radius // segments
    if 64 % segments or ball > 1:
        raise ValueError("segments must divide 64, and at most one bit a segment may differ")
    mask = (1 << width) - 1
    parts = F.array(*[F.shiftrightunsigned("print", width * k).bitwiseAND(F.lit(mask).cast("long")) for k in range(segments)])
    filed = dealt(prints, "print").select("print", F.posexplode(parts).alias("segment", "value"))
    flips = F.array(F.lit(0).cast("long"), *([F.lit(1 << k).cast("long") for k in range(width)] if ball else []))
    probes = filed.select(F.col("print").alias("other"), "segment", F.explode(flips).alias("flip"), "value").select("other", "segment", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    near = (F.col("other") < F.col("print")) & (F.bit_count(F.col("other").bitwiseXOR(F.col("print"))) <= radius)
    return probes.join(merging(filed), ["segment", "value"]).where(near).select(F.col("other").alias("a"), F.col("print").alias("b")).distinct()


def groups(documents: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, print, component_id: the smallest doc_id that can be reached over links."""
    found = cut(fingerprints(documents))  # two numbers a document; texts are read once
    classes = found.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes.select("print"), radius))
    named = classes.join(merging(roots), classes.print == roots.node, "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(merging(smallest), "root").select("print", "component_id")
    return found.join(merging(labels), "print").select("doc_id", "print", "component_id")


def shape(n: int, similarity: float, together: int = TOGETHER) -> tuple[int, int, int]:
    """For ``n`` texts: bits a segment, segments, and how many bits of a segment all texts of a group share (none if they fit in one)."""
    p = differing(similarity)
    bits = max(12, n.bit_length())
    met = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(BALL + 1))
    segments = max(math.ceil(math.log(MISSED) / math.log(1 - met)), math.ceil(CHECKED / bits))
    return bits, segments, min((n // together).bit_length(), bits // (BALL + 1))


def differing(similarity: float) -> float:
    """The share of bits in which the SimHashes of two sets of this Jaccard similarity differ, at most: their angle, greatest for sets of one size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radii(similarity: float) -> tuple[int, int]:
    """How many of ``CHECKED`` bits may differ, of sets of any size and of those under ``SMALL``: four deviations above the mean."""
    shares = (differing(similarity), max(differing(similarity), 3 / 16))
    near, small = (int(CHECKED * p + 4 * math.sqrt(CHECKED * p * (1 - p))) for p in shares)
    return near, small


def _sets_of(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, one text after the other, and how many each has."""
    hashes, begins = shingles(column, shingle)
    sets = [np.unique(hashes[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]
    return np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), np.array([len(x) for x in sets], dtype=np.int64)


def long_simhash(flat: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The SimHash of each set in ``width`` bits (one row a set, one column a bit). The bits of an element are mixed from its hash."""
    words = -(-width // 64)
    salts = mix64(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    factors = mix64(salts) | np.uint64(1)
    prints = np.zeros((len(sizes), width), dtype=bool)
    full = np.flatnonzero(sizes)
    edges = np.concatenate([[0], np.cumsum(sizes[full])])
    most, k = PIECE >> 3, 0
    while k < len(full):  # sets of about ``most`` elements at a time; a larger one by itself, in parts
        to = max(k + 1, int(np.searchsorted(edges, edges[k] + most, side="right")) - 1)
        ones = np.zeros((to - k, 64 * words), dtype=np.int64)
        for lo in range(edges[k], edges[to], most):
            hi = min(lo + most, edges[to])
            n = np.diff(edges[k : to + 1]) if to - k > 1 else np.array([hi - lo])
            blocks = -(-n // 255)  # sums of up to 255 bits fit their byte, eight of them in one word
            begins = np.cumsum(blocks) - blocks
            heads = np.repeat(np.cumsum(n) - n - 255 * begins, blocks) + 255 * np.arange(int(blocks.sum()))
            mixed = np.empty((hi - lo, words), dtype=np.uint64)
            for w in range(words):
                mixed[:, w] = mix64((flat[lo:hi] ^ salts[w]) * factors[w])
            lanes = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
            ones += np.add.reduceat(np.add.reduceat(lanes, heads, axis=0).view(np.uint8), begins, axis=0, dtype=np.int64)
        prints[full[k:to]] = (ones * 2 > sizes[full[k:to], None])[:, :width]
        k = to
    return prints


def _prints(batches: Iterator[pa.RecordBatch], shingle: int, bits: int, segments: int) -> Iterator[pa.RecordBatch]:
    weights = np.float64(2) ** np.arange(bits)
    for whole in batches:
        for batch in slices(whole, most=4 << 20):
            flat, sizes = _sets_of(batch.column("text"), shingle)
            prints = long_simhash(flat, sizes, bits * segments)
            parts = (prints.reshape(len(sizes), segments, bits).astype(np.float64) @ weights).astype(np.int64)
            checks = np.packbits(prints[:, :CHECKED], axis=1, bitorder="little").view(np.uint64).reshape(-1, CHECKED // 64)
            n = np.where(sizes > 0, segments, 1)  # texts without words are alike in one segment as in all
            columns = [batch.column("node"), pa.array(sizes), *[as_signed(checks[:, k]) for k in range(CHECKED // 64)], ragged(parts[np.arange(segments) < n[:, None]], n)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "size", *CHECKS, "parts"])


def _spread(counts: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each index as often as its count says, and numbers from 0 for each, some ``most`` at a time."""
    ends = np.cumsum(counts)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, most):
        at = np.arange(lo, min(lo + most, int(ends[-1])))
        which = np.repeat(np.arange(len(counts)), counts) if ends[-1] <= most else np.searchsorted(ends, at, side="right")
        yield which, at - (ends - counts)[which]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one segment, side and shard after the other."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("segment", "side", "shard")], axis=1)
        heads = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), batch.num_rows]
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            if held and tuple(keys[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(keys[a])
    if held:
        yield pa.Table.from_batches(held)


def _head_pairs(rows: pa.Table, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each value one member, with each other one."""
    node = rows.column("node").to_numpy()
    order = np.lexsort((mix64(node.view(np.uint64) ^ mix64(rows.column("segment").to_numpy()[:1].astype(np.uint64) + np.uint64(1))), value))
    first = np.concatenate([[True], value[order][1:] != value[order][:-1]])
    heads = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    yield heads[~first], order[~first]


def _ball_pairs(rows: pa.Table, value: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs across components whose values differ in at most ``BALL`` of ``width`` bits."""
    root = rows.column("root").to_numpy()
    order = np.lexsort((root, value))
    value, root = value[order], root[order]
    starts = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (root[1:] != root[:-1])]))
    sizes = np.diff(np.concatenate([starts, [len(value)]]))  # of one value's members those of one component are a class
    value, root = value[starts], root[starts]
    table = np.searchsorted(value, np.arange((1 << width) + 1)).astype(np.int32)
    ones = 1 << np.arange(width)
    for flip in [0, *ones, *(ones[a] | ones[b] for a in range(width) for b in range(a))]:
        left = np.flatnonzero(value & (1 << int(flip).bit_length() >> 1) == 0) if flip else np.arange(len(value))
        from_ = table[value[left] ^ flip] if flip else left + 1
        for which, offset in _spread(table[(value[left] ^ flip) + 1] - from_):
            i, j = left[which], from_[which] + offset
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            for pair, k in _spread(sizes[i] * sizes[j]):
                x, y = i[pair], j[pair]
                yield order[starts[x] + k // sizes[y]], order[starts[y] + k % sizes[y]]


def _near(rows: pa.Table, across: bool, bits: int, shared: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a group whose sizes allow the similarity and whose prints are near: of all pairs across components, or of each value's one member with the others."""
    value = rows.column("value").to_numpy()
    segment, side = (int(rows.column(c)[0].as_py()) for c in ("segment", "side"))
    low = shared * side  # bits that the whole group shares are left out
    local = value & ((1 << low) - 1) | value >> (low + shared) << low
    size = rows.column("size").to_numpy()
    checks = np.stack([rows.column(c).to_numpy().view(np.uint64) for c in CHECKS], axis=1)
    near, small = radii(similarity)
    for x, y in _ball_pairs(rows, local, bits - shared) if across else _head_pairs(rows, local):
        least = np.minimum(size[x], size[y])
        alike = least >= similarity * np.maximum(size[x], size[y])  # or they cannot be similar
        x, y, least = x[alike], y[alike], least[alike]
        differ = checks[x] ^ checks[y]
        close = np.bitwise_count(differ).sum(axis=1) <= np.where(least < SMALL, small, near)
        x, y, differ = x[close], y[close], differ[close]
        if across:  # where they have met before, in an earlier segment or side, is not here
            new = np.ones(len(x), dtype=bool)
            for at in range(0, min(segment, CHECKED // bits) * bits, bits):
                part = differ[:, at // 64] >> np.uint64(at % 64)
                if at % 64 + bits > 64:
                    part |= differ[:, at // 64 + 1] << np.uint64(64 - at % 64)
                new &= np.bitwise_count(part & np.uint64((1 << bits) - 1)) > BALL
            for k in range(side):
                new &= (value[x] ^ value[y]) >> (k * shared) & ((1 << shared) - 1) != 0
            x, y = x[new], y[new]
        if len(x):
            yield x, y


def _first_pairs(batches: Iterator[pa.RecordBatch], *how) -> Iterator[pa.RecordBatch]:
    for rows in _runs(batches):
        node = rows.column("node").to_numpy()
        for x, y in _near(rows, False, *how):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], ["a", "b"])


def _meeting(batches: Iterator[pa.RecordBatch], *how) -> Iterator[pa.RecordBatch]:
    """The rows of each group that meet others there: as many as rows at most, however many pairs they form."""
    for rows in _runs(batches):
        meets = np.zeros(rows.num_rows, dtype=bool)
        for x, y in _near(rows, True, *how):
            meets[x] = meets[y] = True
        if meets.any():
            yield from rows.filter(pa.array(meets)).to_batches()


def _links(batches: Iterator[pa.RecordBatch], bits: int, shared: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links between components, found on the whole sets; as many as are needed to join what is linked within a group."""
    for rows in _runs(batches):
        node = rows.column("node").to_numpy()
        lists = rows.column("shingles").combine_chunks()
        ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
        size = np.diff(ends, prepend=0)
        label = np.unique(rows.column("root").to_numpy(), return_inverse=True)[1]
        mark = np.zeros(len(ids) + 1, dtype=bool)
        found = []
        for xs, ys in _near(rows, True, bits, shared, similarity):
            order = np.argsort(xs, kind="stable")
            xs, ys = xs[order], ys[order]
            heads = np.flatnonzero(np.diff(xs, prepend=-1))
            for lo, hi in zip(heads, [*heads[1:], len(xs)], strict=True):
                x = xs[lo]
                own = ids[ends[x] - size[x] : ends[x]]
                mark[own] = True
                step = max(1, (1 << 22) // max(1, int(size[ys[lo:hi]].max())))
                for k in range(lo, hi, step):
                    y = ys[k : min(k + step, hi)]
                    y = y[label[y] != label[x]]
                    if not len(y):
                        continue
                    at = np.arange(int(size[y].sum())) + np.repeat(ends[y] - np.cumsum(size[y]), size[y])
                    sums = np.concatenate([[0], np.cumsum(mark[ids[at]])])[np.concatenate([[0], np.cumsum(size[y])])]
                    common = np.diff(sums)
                    for other in y[common >= similarity * (size[x] + size[y] - common)]:
                        if label[other] != label[x]:
                            label[label == label[other]] = label[x]
                            found.append((x, other))
                mark[own] = False
        if found:
            x, y = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, most=4 << 20):
            flat, sizes = _sets_of(batch.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("node"), ragged(flat.view(np.int64), sizes)], ["node", "shingles"])


def similar(texts: DataFrame, n: int, shingle: int = 5, similarity: float = 0.8, together: int = TOGETHER) -> DataFrame:
    """Pairs a < b of nodes that link texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    ``texts`` has ``node`` (a hash of the text; about ``n`` of them) and ``text``; texts without words are alike. Candidates' SimHashes are near,
    and within ``BALL`` bits in one of the segments (see :func:`shape`); each is checked on the whole sets. Of texts that share a segment's
    value one is compared with all others; then all pairs are that are still in different components, where they meet first.
    """
    bits, segments, shared = shape(n, similarity, together)
    made = texts.select("node", "text").mapInArrow(lambda x: _prints(x, shingle, bits, segments), f"node long, size long, {' long, '.join(CHECKS)} long, parts array<long>")
    made = cut(made.dropDuplicates(["node"]))
    keys = ("segment", "side", "shard")

    def filed(prints: DataFrame, sides: int) -> DataFrame:
        # values that differ in BALL bits agree in one of BALL + 1 pieces
        pieces = [F.struct(F.lit(k).alias("side"), F.shiftrightunsigned("value", k * shared).bitwiseAND(F.lit((1 << shared) - 1).cast("long")).alias("shard")) for k in range(sides)]
        spread = prints.select("node", "root", "size", *CHECKS, F.posexplode("parts").alias("segment", "value"))
        return spread.withColumn("at", F.explode(F.array(*pieces))).select("*", "at.*").drop("at")

    def grouped(rows: DataFrame, step, schema: str) -> DataFrame:
        return dealt(rows, *keys).sortWithinPartitions(*keys).mapInArrow(lambda x: step(x, bits, shared, similarity), schema)

    def held(nodes: DataFrame) -> DataFrame:
        once = texts.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
        return cut(once.mapInArrow(lambda x: _sets(x, shingle), "node long, shingles array<long>"))

    firsts = cut(grouped(filed(made.withColumn("root", F.col("node")), 1), _first_pairs, "a long, b long").distinct())
    sets = held(firsts.select(F.explode(F.array("a", "b")).alias("node")))
    x, y = (merging(sets.select(F.col("node").alias(k), F.col("shingles").alias(v))) for k, v in ("ax", "by"))
    both = firsts.join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("x", "y"))
    linked = cut(both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"))
    rooted = made.join(merging(components(linked)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = filed(rooted, BALL + 1 if shared else 1)
    meeting = cut(grouped(rows, _meeting, rows.schema))
    rest = grouped(meeting.join(merging(held(meeting.select("node"))), "node"), _links, "a long, b long")
    return linked.unionByName(rest)


def near_copies(documents: DataFrame, **settings) -> DataFrame:
    """doc_id, text_hash, component: of each (doc_id, text), the smallest such pair reached over similar texts."""
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", "text", F.xxhash64("text").alias("node"))
    found = cut(keyed.select("doc_id", "node").distinct())
    roots = components(similar(keyed.select("node", "text"), found.select("node").distinct().count(), **settings))
    named = found.join(roots, "node", "left").select("doc_id", F.col("node").alias("text_hash"), F.coalesce("root", "node").alias("root"))
    least = named.where("doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("component"))
    return named.join(least, "root", "left").select("doc_id", "text_hash", "component")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
