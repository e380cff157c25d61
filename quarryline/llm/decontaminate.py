"""Benchmark decontamination over a distributed positional inverted index.

The index is a table that is written once: documents are read in segments of a few megabytes of text, and a row holds one
term's postings in one segment, the places where it stands, in order. One more row a segment tells of its documents. Places
count through a segment, with a gap after each document.

Test items are read in blocks of at most ``block_words`` words; one block is held at a time. Its terms select the postings
(a join with a broadcast list of at most that many hashes), which come together by segment. There every phrase is answered from its rarest
term: that term's places, less its offset, are the possible starts; the other lists, adjusted by their offsets, are intersected
from the next rarest on, for all phrases of one length at once. A proximity match lets every term be up to ``slop`` words away from its
place. Which term is rarest changes the work, never the answer. What is found is written down before the next block is read.

Edge cases: a null or empty text has no words; an item without words, or with a null id, matches
nothing; items with equal ids are one item; phrases shared by items count for each; rows given twice
are judged twice. Columns of documents that are not kept are ignored; those kept may have any name.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import PLAIN_WORD, U64, as_signed, ascii_lower, cut, named, table
from quarryline.llm.words import PLAIN, Words, pieces, slices, word_hash

GAP = 64
#: Bytes of text in a segment, and possible starts that are looked at together.
SEGMENT, AT_ONCE = 4 << 20, 2_000_000


class Block:
    """The phrases of some test items: windows of ``window`` words, or the whole of a shorter item."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int) -> None:
        terms: dict[str, int] = {}
        self.items = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.items)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for name, words in items:
            ids = [terms.setdefault(w, len(terms)) for w in words]
            for at in range(max(1, len(ids) - window + 1)):
                owners.setdefault(tuple(ids[at : at + window]), set()).add(number[name])
        self.by_length: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for n in sorted({len(p) for p in owners}):
            some = [p for p in owners if len(p) == n]
            self.by_length[n] = (np.array(some, dtype=np.int32), [np.array(sorted(owners[p]), dtype=np.int32) for p in some])
        self.hashes = np.array([word_hash(t) for t in terms], dtype=U64)
        self.order = np.argsort(self.hashes)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of terms by their hashes; all of them must be terms."""
        return self.order[np.searchsorted(self.hashes, hashes, sorter=self.order)]


def blocks(items: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    """One block after the other; rows of the items come to the driver a partition at a time."""
    held, size = [], 0
    for row in items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words = PLAIN_WORD.findall(ascii_lower(row.text or ""))
        if words:
            held.append((row.item_id, words))
            size += len(words)
        if size >= block_words:
            yield Block(held, window)
            held, size = [], 0
    if held:
        yield Block(held, window)


class Postings:
    """Posting lists of one segment for a block's terms, as one sorted array of term and place."""

    def __init__(self, terms: np.ndarray, places: list[np.ndarray], n_terms: int) -> None:
        counts = np.zeros(n_terms, dtype=np.int64)
        counts[terms] = [len(p) for p in places]
        self.counts, self.edges = counts, np.concatenate([[0], np.cumsum(counts)])
        order = np.argsort(terms)
        self.places = np.concatenate([*(places[k] for k in order), np.zeros(0, np.int32)]).astype(np.int64)
        self.span = int(self.places.max(initial=0)) + 4 * GAP
        self.keys = np.repeat(np.arange(n_terms), counts) * self.span + self.places + GAP

    def nearest(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How far the nearest place of each term is from the one given; GAP for farther ones. Each term has a place."""
        low, high = self.edges[term], self.edges[term + 1]
        at = np.clip(np.searchsorted(self.keys, term.astype(np.int64) * self.span + place + GAP), low, high)  # terms are 32 bits wide, keys are not
        after = self.places[np.minimum(at, high - 1)] - place
        before = self.places[np.maximum(at - 1, low)] - place
        return np.minimum(np.minimum(np.abs(after), np.abs(before)), GAP)

    def matches(self, phrases: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Number of the phrase, start, and whether it is exact, of all places where its terms are within ``slop`` of theirs."""
        frequency = self.counts[phrases]
        possible = np.flatnonzero(frequency.min(axis=1) > 0)
        order = np.argsort(frequency[possible], axis=1, kind="stable")
        least = np.take_along_axis(frequency[possible], order[:, :1], 1)[:, 0]
        total = np.concatenate([[0], np.cumsum(least * (2 * slop + 1))])
        at = 0
        while at < len(possible):
            to = max(at + 1, int(np.searchsorted(total, total[at] + AT_ONCE, side="right")) - 1)
            rows, n = np.arange(at, to), least[at:to]
            row = np.repeat(rows, n)
            rarest = phrases[possible[row], order[row, 0]]
            start = self.places[self.edges[rarest] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] - order[row, 0]
            if slop:
                row, start = np.repeat(row, 2 * slop + 1), (start[:, None] + np.arange(-slop, slop + 1)).ravel()
                pad = phrases.shape[1] + GAP
                key = np.unique(row * (self.span + 2 * pad) + start + pad)  # a start is met from several places
                row, start = key // (self.span + 2 * pad), key % (self.span + 2 * pad) - pad
            exact = np.ones(len(row), dtype=bool)
            for k in range(phrases.shape[1]):
                offset = order[row, k]
                far = self.nearest(phrases[possible[row], offset], start + offset)
                keep = far <= slop
                row, start, exact = row[keep], start[keep], (exact & (far == 0))[keep]
            yield possible[row], start, exact
            at = to


def union_of(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [first, last) as the fewest ranges that cover the same, in order."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order]) if len(last) else last
    head = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]])) if len(first) else np.zeros(0, np.int64)
    return first[head], reach[np.append(head[1:], len(first)) - 1] if len(first) else reach


HITS = "segment binary, k int, spans array<array<int>>, items array<string>, near array<string>"


def searched(segment: bytes, begins: np.ndarray, postings: Postings, block: Block, slop: int) -> pa.Table:
    """Documents of a segment (numbered by where they begin) with their hit spans and the items that occur exactly and nearly."""
    firsts, lasts, exact_items, near_items = [], [], set(), set()
    for n, (phrases, owners) in block.by_length.items():
        for phrase, start, exact in postings.matches(phrases, slop):
            doc = np.searchsorted(begins, start + GAP // 2, side="right") - 1  # a start can be ``slop`` words before its document
            firsts.append(start[exact])
            lasts.append(start[exact] + n)
            pairs = np.unique(np.stack([doc, phrase, ~exact], axis=1), axis=0)
            for d, p, near in pairs.tolist():
                (near_items if near else exact_items).update((d, x) for x in owners[p].tolist())
    first, last = union_of(np.concatenate([*firsts, np.zeros(0, np.int64)]), np.concatenate([*lasts, np.zeros(0, np.int64)]))
    doc = np.searchsorted(begins, first, side="right") - 1
    out: dict[int, tuple[list, list, list]] = {}
    for d, a, b in zip(doc.tolist(), (first - begins[doc]).tolist(), (last - begins[doc]).tolist(), strict=True):
        out.setdefault(d, ([], [], []))[0].append([a, b])
    for place, found in ((1, exact_items), (2, exact_items | near_items)):
        for d, x in sorted(found):
            out.setdefault(d, ([], [], []))[place].append(block.items[x])
    kinds = [pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()), pa.list_(pa.string())]
    columns = [pa.array([v[k] for v in out.values()], kind) for k, kind in enumerate(kinds)]
    return pa.Table.from_arrays([pa.array([segment] * len(out), pa.binary()), pa.array(list(out), pa.int32()), *columns], names=["segment", "k", "spans", "items", "near"])


def build_index(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The stored index: segment, term, places of postings, and docs (the columns ``keep``, as _0, _1 and so on, and words) of segments."""
    own = [f"_{n}" for n in range(len(keep))]  # no name of theirs can clash with ours
    read = documents.select(*[named(c).alias(n) for c, n in zip(keep, own, strict=True)], F.col("text").cast("string").alias("text"))
    entry = T.StructType([*read.schema.fields[:-1], T.StructField("words", T.LongType())])
    schema = T.StructType([T.StructField("segment", T.BinaryType()), T.StructField("term", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("docs", T.ArrayType(entry))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=SEGMENT):
                segment = os.urandom(16)  # the index is written before it is read, so a segment has one name
                words = Words(batch.column("text"), PLAIN)
                n, hashes = words.counts(), words.hashes(lower=True)
                docs = pa.StructArray.from_arrays([*(batch.column(c) for c in own), pa.array(n)], [*own, "words"])
                listed = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), listed], ["segment", "term", "places", "docs"])
                place = (np.arange(len(hashes)) + np.repeat(np.arange(len(n)) * GAP, n)).astype("<i4")
                order = np.argsort(hashes, kind="stable")
                hashes, place = hashes[order], place[order]
                head = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
                for at in range(0, len(head), 20_000):
                    part = head[at : at + 20_000]
                    stop = head[at + 20_000] if at + 20_000 < len(head) else len(hashes)
                    lists = pieces(place[part[0] : stop].view(np.uint8), (part - part[0]) * 4)
                    yield pa.RecordBatch.from_arrays([pa.array([segment] * len(part), pa.binary()), as_signed(hashes[part]), lists, pa.nulls(len(part), listed.type)], ["segment", "term", "places", "docs"])

    return cut(read.mapInArrow(run, schema))


def search_index(index: DataFrame, items: DataFrame, window: int = 8, slop: int = 1, block_words: int = 200_000) -> DataFrame:
    """segment, k (from 0), spans, items, near of the documents in which some item occurs, nearly at least.

    ``spans``: [start, end) of the words inside exact matches, merged. ``items``: ids, as sorted strings,
    of the items with an exactly matching phrase; ``near``: with a match within ``slop``, exact ones included.
    """
    if not 0 <= slop < GAP // 2:
        raise ValueError(f"slop must be below {GAP // 2}")
    spark = index.sparkSession
    begins = index.where("docs IS NOT NULL").select("segment", F.transform("docs", lambda d: d["words"]).alias("words"), F.lit(None).cast("long").alias("term"), F.lit(None).cast("binary").alias("places"))
    found = spark.createDataFrame([], HITS)
    for number, block in enumerate(blocks(items, window, block_words)):
        held = spark.sparkContext.broadcast(block)
        terms = F.broadcast(spark.createDataFrame(pa.table({"term": as_signed(block.hashes)})))  # at most block_words

        def run(key: tuple, rows: pa.Table) -> pa.Table:  # runs before the next block is read
            block = held.value
            own = rows.filter(pc.is_valid(rows.column("words")))
            rows = rows.filter(pc.is_valid(rows.column("term"))).combine_chunks()
            if not own.num_rows or not rows.num_rows:
                return pa.schema([("segment", pa.binary()), ("k", pa.int32()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))]).empty_table()
            words = np.array(own.column("words")[0].as_py(), dtype=np.int64)
            numbers = block.numbers(rows.column("term").to_numpy().view(U64))
            places = [np.frombuffer(p.as_py(), dtype="<i4") for p in rows.column("places")]
            postings = Postings(numbers, places, len(block.hashes))
            return searched(key[0].as_py(), np.cumsum(words + GAP) - words - GAP, postings, block, slop)

        chosen = index.where("term IS NOT NULL").join(terms, "term", "left_semi").select("segment", F.lit(None).cast("array<long>").alias("words"), "term", "places")
        hits = cut(chosen.unionByName(begins).groupBy("segment").applyInArrow(run, HITS))
        held.destroy()
        if number:  # what a document has of several blocks is put together
            both = found.unionByName(hits).groupBy("segment", "k")
            merged = both.agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")])
            hits = cut(merged.select("segment", "k", merged_spans(F.col("spans")).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"), F.array_sort(F.array_distinct("near")).alias("near")))
        found = hits
    return found


def merged_spans(spans: Column) -> Column:
    """Ranges as the fewest ranges that cover the same, in order."""

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], x[1]))))
        return F.when((F.size(done) > 0) & (x[0] <= last[1]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<array<int>>"), step)


def matches(documents: DataFrame, items: DataFrame, window: int = 8, slop: int = 1, block_words: int = 200_000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """documents (doc_id, text), items (item_id, text) -> found: a struct of n_words, spans, items, near, and kept: one of the columns ``keep``."""
    index = build_index(documents, keep)
    hits = search_index(index, items, window, slop, block_words)
    docs = index.where("docs IS NOT NULL").select("segment", F.posexplode("docs").alias("k", "doc"))
    none, empty = F.array().cast("array<string>"), F.array().cast("array<array<int>>")
    found = F.struct(F.col("doc.words").alias("n_words"), F.coalesce("spans", empty).alias("spans"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"))
    kept = F.struct(*[F.col(f"doc._{n}").alias(c) for n, c in enumerate(keep)]) if keep else F.struct(F.lit(None).alias("none"))
    return docs.join(hits, ["segment", "k"], "left").select(kept.alias("kept"), found.alias("found"))


def report(found: DataFrame, least_items: int = 2) -> DataFrame:
    """The digest of :func:`matches`, without the kept columns but ``kept``; a document with ``least_items`` items or more is contaminated."""
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]).cast("long"))
    n = F.size("found.items").cast("long")
    return found.select("kept", F.col("found.n_words").alias("n_words"), hit.alias("n_hit"), n.alias("n_items"), F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"), (n >= least_items).alias("contaminated"), F.size("found.near").cast("long").alias("n_near_items"))


def text_key() -> tuple[Column, Column]:
    """Two hashes that tell texts apart."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text).alias("a"), F.xxhash64(F.lit("key"), F.reverse(text)).alias("b")


def contaminated_texts(documents: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The keys (a, b) of all texts in which some item occurs exactly, once each."""
    index = build_index(documents.select(*text_key(), "text"), ("a", "b"))
    hits = search_index(index, items, slop=0, **settings).where(F.size("items") > 0)
    docs = index.where("docs IS NOT NULL").select("segment", F.posexplode("docs").alias("k", "doc"))
    return docs.join(hits, ["segment", "k"], "left_semi").select(F.col("doc._0").alias("a"), F.col("doc._1").alias("b")).distinct()


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return report(matches(documents, table(spark, sf_dir, "benchmark"))).select("kept.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")


_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format(text="text")}, []) AS w FROM documents),
places AS (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM words),
items AS (SELECT DISTINCT item_id::VARCHAR AS item, {_WORDS.format(text="text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT item, w[s:s + 7] AS phrase FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS s FROM items WHERE len(w) > 0)),
phrases AS (SELECT phrase, row_number() OVER () AS p, list(DISTINCT item) AS owners FROM windows GROUP BY phrase),
parts AS (SELECT p, len(phrase) AS n, unnest(phrase) AS term, generate_subscripts(phrase, 1) AS k FROM phrases),
off AS (SELECT unnest([-1, 0, 1]) AS d),
often AS (SELECT term, count(*) AS f FROM places GROUP BY term),
rarest AS (SELECT p, n, term, k FROM parts LEFT JOIN often USING (term) QUALIFY row_number() OVER (PARTITION BY p ORDER BY coalesce(f, 0), k) = 1),
possible AS (SELECT DISTINCT r, p, n, place - k + d AS start FROM places JOIN rarest USING (term), off),
met AS (
  SELECT x.r, x.p, x.n, x.start, parts.k, d = 0 AS exact
  FROM possible x JOIN parts ON parts.p = x.p, off JOIN places ON places.r = x.r AND places.term = parts.term AND places.place = x.start + parts.k + d),
starts AS (
  SELECT r, p, n, start, count(DISTINCT k) FILTER (WHERE exact) = n AS exact FROM met GROUP BY r, p, n, start HAVING count(DISTINCT k) = n),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(start + 1, start + n + 1)) AS place FROM starts WHERE exact) GROUP BY r),
owned AS (
  SELECT r, list(DISTINCT item) FILTER (WHERE exact) AS items, count(DISTINCT item) AS near
  FROM (SELECT DISTINCT r, exact, unnest(owners) AS item FROM starts JOIN phrases USING (p)) GROUP BY r)
SELECT doc_id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256, coalesce(len(items), 0) >= 2 AS contaminated, coalesce(near, 0)::BIGINT AS n_near_items
FROM words LEFT JOIN hits USING (r) LEFT JOIN owned USING (r)
"""
