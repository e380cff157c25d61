"""Removal of repeated word windows, with a count-min prefilter.

1. Every window has a minimiser: the smallest hash among the ``gram``-word runs in it. Equal windows
   have equal minimisers at different places, so the count of a minimiser's places is never below the
   count of a window that has it. Every task counts the places of its documents' minimisers in a
   sparse count-min sketch: for each of two rows the touched cells in order, as byte-sized gaps, and
   those touched again. Sketches are merged segment by segment into one bit a cell: counted twice or more.
2. A second pass keeps the windows that the merged sketch, broadcast at a bounded size, estimates
   as repeated: all that are, and few others. Each task keeps the earliest place of every such window
   and marks its other places at once; so one window has at most one row a task part, however common.
3. The rest is dealt out by minimiser, sorted and streamed: of windows that are equal (128 bits of
   hashes) the earliest place stays, the others are marked. Neighbours mostly share a minimiser, so
   marks come in runs, a row a run. Marks are joined to the documents.

The sketch has ``cells_per_word`` cells a word and row, up to ``max_cells``. Beyond that it lets more
windows through; the exact step then does more work and the result is the same.

Edge cases: a null text has no words; a document under ``window`` words loses none; rows with equal
doc_id and equal text are one document and get equal results; rows with equal doc_id and other texts
are ordered by a hash of the text; a null doc_id comes after all others. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import U64, as_signed, mix64, table
from quarryline.llm.words import Words, pieces, slices, texts

LAST = np.iinfo(np.int64).max
SEGMENT_BITS = 20
GRAM = 10
#: Odd multipliers of the hashes of windows and of their runs.
BASES = (U64(0x9E3779B97F4A7C15), U64(0xA24BAED4963EE407))


def rolling(words: np.ndarray, window: int, base: np.uint64) -> np.ndarray:
    """The polynomial hash of every ``window`` words in a row, by doubling."""
    if len(words) < window:
        return np.zeros(0, dtype=U64)
    part, size, have, got = words, 1, None, 0
    power, left = base, window
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if have is None:
                    have = part
                else:
                    n = min(len(have), len(part) - got)
                    have = have[:n] * power + part[got : got + n]
                got += size
            left >>= 1
            if left:
                part = part[: len(part) - size] * power + part[size:]
                power = power * power
                size *= 2
        return mix64(have[: len(words) - window + 1])


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The smallest (or largest) of every ``width`` values in a row."""
    part, size = values, 1
    while size * 2 <= width:
        part = pick(part[: len(part) - size], part[size:])
        size *= 2
    rest = width - size
    return pick(part[: len(part) - rest], part[rest:]) if rest else part


def packed(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gaps as bytes, where 255 means: add 255 and go on; and where each gap begins."""
    more = gaps // 255
    ends = np.cumsum(more + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, dtype=np.uint8)
    out[ends - 1] = gaps % 255
    return out, ends - more - 1


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values that each element's gaps lead to, and the number of the element of each value."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or edges[-1] == edges[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    sums = np.concatenate([[0], np.cumsum(raw, dtype=np.int64)])
    at = np.flatnonzero(raw != 255)
    owner = np.searchsorted(edges, at, side="right") - 1
    return sums[at + 1] - sums[edges[owner]], owner


class Windows:
    """Windows of some documents: ``minimiser`` of each window, ``at`` its first word among all words."""

    def __init__(self, batch: pa.RecordBatch, window: int) -> None:
        words = Words(batch.column("text"))
        self.hashes, self.window = words.hashes(), window
        counts = np.maximum(words.counts() - window + 1, 0)
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.start = np.arange(len(self.owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at = words.edges[:-1][self.owner] + self.start
        gram = min(GRAM, window)
        if len(self.at):
            self.grams = rolling(self.hashes, gram, BASES[1])
            self.least = sliding(self.grams, window - gram + 1)
            self.minimiser = self.least[self.at]

    def counted(self) -> np.ndarray:
        """The hash of every place that is the minimiser of some window, once a place."""
        span = len(self.grams) - len(self.least) + 1
        used = np.zeros(len(self.least) + 2 * (span - 1), dtype=U64)
        used[self.at + span - 1] = self.minimiser
        return self.grams[sliding(used, span, np.maximum) == self.grams]


def rows_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes that choose a cell in each row of the sketch."""
    return hashes, mix64(hashes ^ BASES[0])


def sketches(window: int, bits: int):
    """A function for mapInArrow: documents' texts -> (segment, once, more)."""

    def column(cells: np.ndarray, segments: np.ndarray) -> pa.Array:
        """Gaps of sorted cells, for each segment in order."""
        marks = cells >> SEGMENT_BITS
        gaps = np.diff(cells, prepend=0)
        head = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]])) if len(cells) else np.zeros(0, np.int64)
        gaps[head] = cells[head] & ((1 << SEGMENT_BITS) - 1)
        data, begins = packed(gaps)
        return pieces(data, np.concatenate([begins, [len(data)]])[np.searchsorted(marks, segments)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = Windows(batch, window)
                if not len(found.at):
                    continue
                for row, hashes in enumerate(rows_of(found.counted())):
                    cells = np.sort((hashes >> U64(64 - bits)).astype(np.int64))
                    fresh = np.concatenate([[True], cells[1:] != cells[:-1]])
                    again = np.unique(cells[~fresh])
                    segments = np.unique(cells >> SEGMENT_BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(segments * 2 + row), column(cells[fresh], segments), column(again, segments)], ["segment", "once", "more"])

    return run


def merged(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One segment's sketches -> a bit a cell: count of two or more. Parts come batch by batch."""
    counts = np.zeros(1 << SEGMENT_BITS, dtype=np.uint8)
    for part in parts:
        for k in range(part.num_rows):
            cells, _ = unpacked(part.column("once").slice(k, 1))
            counts[cells] = np.minimum(counts[cells] + 1, 2)
        counts[unpacked(part.column("more"))[0]] = 2
    bits = np.packbits(counts >= 2, bitorder="little").tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([bits], pa.binary())], ["segment", "bits"])


class Repeats:
    """The merged sketch: tells which windows may be repeated."""

    def __init__(self, bits: int, rows) -> None:
        self.bits = bits
        self.table = np.zeros((2, 1 << (bits - 3)), dtype=np.uint8)
        size = 1 << (SEGMENT_BITS - 3)
        for row in rows:
            at = (row["segment"] >> 1) * size
            self.table[row["segment"] & 1, at : at + size] = np.frombuffer(row["bits"], dtype=np.uint8)

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for row, x in enumerate(rows_of(hashes)):
            cells = x >> U64(64 - self.bits)
            found &= (self.table[row, (cells >> U64(3)).astype(np.int64)] >> (cells & U64(7)).astype(np.uint8)) & 1 == 1
        return found


NAMES = ["m", "h", "doc", "t", "start", "n"]
MARKS = ["doc", "t", "start", "n"]


def runs(doc: np.ndarray, t: np.ndarray, start: np.ndarray) -> list[pa.Array]:
    """Marked starts as runs: doc, t, first start, how many in a row."""
    order = np.lexsort((start, t, doc))
    doc, t, start = doc[order], t[order], start[order]
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (t[1:] != t[:-1]) | (start[1:] > start[:-1] + 1)]))
    length = start[np.append(head[1:], len(start)) - 1] - start[head] + 1
    return [pa.array(doc[head], pa.int64()), pa.array(t[head], pa.int64()), pa.array(start[head], pa.int32()), pa.array(length, pa.int32())]


def candidates(window: int, repeats):
    """A function for mapInArrow: (text, doc, t) -> places of windows that may be repeated (n is null), and marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = Windows(batch, window)
                keep = np.flatnonzero(repeats.value.maybe(found.minimiser)) if len(found.at) else ()
                if not len(keep):
                    continue
                m, h = found.minimiser[keep], rolling(found.hashes, window, BASES[0])[found.at[keep]]
                start, owner = found.start[keep], found.owner[keep]
                docs, ts = batch.column("doc").to_numpy()[owner], batch.column("t").to_numpy()[owner]
                order = np.lexsort((start, ts, docs, m, h))
                a, b, d, t, s = m[order], h[order], docs[order], ts[order], start[order]
                fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                # a place that only repeats itself (a row given twice) is not a repetition
                other = (d != d[first]) | (t != t[first]) | (s != s[first])
                kept = np.sort(order[fresh])  # in the documents' order, which compresses best
                for lo in range(0, len(kept), 100_000):
                    part = kept[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([as_signed(m[part]), as_signed(h[part]), pa.array(docs[part]), pa.array(ts[part]), pa.array(start[part], pa.int32()), pa.nulls(len(part), pa.int32())], NAMES)
                if other.any():
                    cols = runs(d[other], t[other], s[other])
                    yield pa.RecordBatch.from_arrays([as_signed(mix64(cols[0].to_numpy().view(U64))), pa.nulls(len(cols[0]), pa.int64()), *cols], NAMES)

    return run


def later_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted places -> marks of all but each window's earliest. Holds a million marks at a time."""
    last, held, size = None, [], 0
    for batch in batches:
        passed = batch.filter(pc.is_valid(batch.column("n")))
        if passed.num_rows:
            yield passed.select(MARKS)
        batch = batch.filter(pc.is_null(batch.column("n")))
        if not batch.num_rows:
            continue
        m, h, doc, t, start = (batch.column(n).to_numpy() for n in NAMES[:5])
        fresh = np.concatenate([[last is None or (m[0], h[0]) != last[:2]], (m[1:] != m[:-1]) | (h[1:] != h[:-1])])
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), -1))
        head, first = at < 0, np.maximum(at, 0)
        fd, ft, fs = doc[first], t[first], start[first]
        if head.any():
            fd[head], ft[head], fs[head] = last[2:]
        last = (m[-1], h[-1], fd[-1], ft[-1], fs[-1])
        other = (doc != fd) | (t != ft) | (start != fs)
        held.append((doc[other], t[other], start[other]))
        size += len(held[-1][0])
        if size >= 1_000_000:
            yield pa.RecordBatch.from_arrays(runs(*(np.concatenate(x) for x in zip(*held, strict=True))), MARKS)
            held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays(runs(*(np.concatenate(x) for x in zip(*held, strict=True))), MARKS)


def repeated_windows(docs: DataFrame, window: int = 20, cells_per_word: float = 0.75, max_cells: int = 1 << 29) -> DataFrame:
    """Runs of windows that also start earlier: doc, t, start of the first, n in a row.

    ``docs`` has text, doc (id, or the largest long) and t (a hash of the text).
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, chars / 6 * cells_per_word))), SEGMENT_BITS, np.log2(max_cells)))
    parts = docs.select("text").mapInArrow(sketches(window, bits), "segment long, once binary, more binary")
    rows = parts.groupBy("segment").applyInArrow(merged, "segment long, bits binary").toLocalIterator()  # at most max_cells / 4 bytes
    repeats = spark.sparkContext.broadcast(Repeats(bits, rows))
    places = docs.select("text", "doc", "t").mapInArrow(candidates(window, repeats), "m long, h long, doc long, t long, start int, n int")
    return places.repartition("m").sortWithinPartitions(*NAMES[:5]).mapInArrow(later_places, "doc long, t long, start int, n int")


def keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias("t"))


def remove_repeats(documents: DataFrame, window: int = 20, **sketch) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_words, n_removed, kept (array of the words that stay, joined by one space)."""
    docs = keyed(documents)
    marks = repeated_windows(docs, window, **sketch).groupBy("doc", "t").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("lengths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                words = Words(batch.column("text"))
                starts, lengths = (batch.column(c) for c in ("starts", "lengths"))
                starts, lengths = (x.fill_null([]) if x.null_count else x for x in (starts, lengths))
                owner = np.repeat(np.arange(len(starts)), pc.list_value_length(starts).to_numpy(zero_copy_only=False))
                at = words.edges[owner] + starts.flatten().to_numpy()
                n = len(words.starts)
                steps = np.bincount(at, minlength=n + 1) - np.bincount(at + lengths.flatten().to_numpy() - 1 + window, minlength=n + 1)
                keep = np.cumsum(steps[:n]) == 0
                data, edges = words.joined(keep)
                counts, gone = words.counts(), np.concatenate([[0], np.cumsum(~keep)])[words.edges]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(np.diff(gone)), texts(data, edges)], ["doc_id", "n_words", "n_removed", "kept"])

    joined = docs.join(marks, ["doc", "t"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "starts", "lengths")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


REPEATS_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20),
windows AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 19], ' ')) AS passage FROM starts JOIN words USING (doc_id)),
later AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY passage ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS k FROM later),
left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM words) ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN n USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
