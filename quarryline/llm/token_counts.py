"""Token counts that follow edits.

A text is cut into pre-tokens by the tokenizer's pattern; each is encoded by itself, so a text's count is a sum.
Lengths and counts of a document's pre-tokens are stored, a row a document. An edited document is read with what is stored of it:
blocks of pre-tokens are the leaves of a segment tree that sums characters and tokens. An edit descends to its
place by characters, starts over a few pre-tokens before it (the pattern looks ahead, never back) and encodes until
a pre-token begins where an old one did beyond the edit; from there on all is as before. Then the sums above the
touched leaves are set anew. Only the text of the leaves around an edit is put together, so many edits of a long text
cost no more than their surroundings. Counts of pre-tokens are remembered within a worker.

The ranks file is read on the driver, at ``path``, and broadcast: its size is fixed.

Edge cases: null and empty texts have no tokens; edits are (start, end, text) in characters of the text as it was,
and must not overlap, else ValueError; several edits are applied from the last to the first; null edits are none;
special tokens' strings are ordinary text; rows given twice are counted twice; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import cut, table
from quarryline.llm.words import slices

#: The tokenizer's published pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: What the query edits: electronic mail addresses.
ADDRESS = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
LEAF = 64
BACK = 3


class Encoder:
    """Cuts texts and counts tokens of pre-tokens."""

    KEPT = 500_000

    def __init__(self, ranks: bytes) -> None:
        held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.coder = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=held, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.coder.encode_ordinary(piece))
            if len(self.known) >= self.KEPT:
                self.known.clear()
            self.known[piece] = n
        return n

    def pieces(self, text: str) -> tuple[list[int], list[int]]:
        """Length and token count of every pre-token."""
        found = self.pattern.findall(text)
        get = self.known.get
        return list(map(len, found)), [get(p) or self.count(p) for p in found]


class Tree:
    """A text with its pre-tokens in blocks and a segment tree over them; from the stored pre-tokens, if there are such."""

    def __init__(self, text: str, encoder: Encoder, stored: tuple[list[int], list[int]] | None = None) -> None:
        self.encoder, self.encoded = encoder, 0
        lengths, counts = stored or encoder.pieces(text)
        self.pieces = len(lengths)
        self._build(text, lengths, counts)

    def _build(self, text: str, lengths: list[int], counts: list[int]) -> None:
        self.lengths = [lengths[k : k + LEAF] for k in range(0, len(lengths), LEAF)] or [[]]
        self.counts = [counts[k : k + LEAF] for k in range(0, len(counts), LEAF)] or [[]]
        self.size = 1 << max(0, (len(self.lengths) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.texts, at = [], 0
        for k in range(len(self.lengths)):
            self.chars[self.size + k], self.tokens[self.size + k] = sum(self.lengths[k]), sum(self.counts[k])
            self.texts.append(text[at : at + self.chars[self.size + k]])
            at += self.chars[self.size + k]
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one for the end), and where it begins."""
        node, begin = 1, 0
        at = min(at, max(0, self.chars[1] - 1))
        while node < self.size:
            node *= 2
            if at - begin >= self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def _renew(self, leaf: int) -> None:
        node = self.size + leaf
        self.chars[node], self.tokens[node] = sum(self.lengths[leaf]), sum(self.counts[leaf])
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, put: str) -> None:
        """Replaces characters start to end."""
        if not 0 <= start <= end <= self.chars[1]:
            raise ValueError("an edit lies outside its text")
        # where to start over: BACK pre-tokens before the one that holds the character before the edit
        first, base = self._leaf(max(0, start - 1))
        at, index = base, 0
        while index < len(self.lengths[first]) and at + self.lengths[first][index] < start:
            at += self.lengths[first][index]
            index += 1
        back = BACK
        while back and (index or first):
            if not index:
                first -= 1
                index = len(self.lengths[first])
                base -= self.chars[self.size + first]
                continue
            index -= 1
            at -= self.lengths[first][index]
            back -= 1
        # the text of the leaves around the edit; more of them, if the pre-tokens do not meet the old ones there
        stop, have, want = first, base, end + 1
        while True:
            while stop < len(self.lengths) and have < want:
                have += self.chars[self.size + stop]
                stop += 1
            old = "".join(self.texts[first:stop])
            new = old[: start - base] + put + old[end - base :]
            met = self._scan(new, at - base, start - base + len(put), first, index, len(old) - len(new), stop == len(self.lengths))
            if met is not None:
                break
            want = have + max(256, 2 * (have - base))
        lengths, counts, leaf, k = met
        self.encoded += len(lengths)
        tail = (self.lengths[leaf][k:], self.counts[leaf][k:])
        rest = self.texts[leaf][len(self.texts[leaf]) - sum(tail[0]) :]
        self.lengths[first], self.counts[first] = self.lengths[first][:index] + lengths, self.counts[first][:index] + counts
        self.texts[first] = new[: sum(self.lengths[first])]
        if leaf == first:
            self.lengths[first] += tail[0]
            self.counts[first] += tail[1]
            self.texts[first] += rest
        else:
            for x in range(first + 1, leaf):
                self.lengths[x], self.counts[x], self.texts[x] = [], [], ""
                self._renew(x)
            self.lengths[leaf], self.counts[leaf], self.texts[leaf] = *tail, rest
            self._renew(leaf)
        self._renew(first)
        if len(self.lengths[first]) > 8 * LEAF:  # cut up anew what has grown too long
            self._build(self.text, [n for x in self.lengths for n in x], [n for x in self.counts for n in x])

    def _scan(self, text: str, at: int, after: int, leaf: int, k: int, shift: int, whole: bool) -> tuple[list[int], list[int], int, int] | None:
        """New pre-tokens from ``at`` on, and leaf and place of the first old one that stays; None if there is none before the end of a part of the text."""
        old, lengths, counts = at, [], []
        for match in self.encoder.pattern.finditer(text, at):
            begin = match.start()
            if begin >= after:
                while old < begin + shift and leaf < len(self.lengths):
                    if k >= len(self.lengths[leaf]):
                        leaf, k = leaf + 1, 0
                        continue
                    old += self.lengths[leaf][k]
                    k += 1
                if old == begin + shift:
                    break
            lengths.append(len(match[0]))
            counts.append(self.encoder.count(match[0]))
        else:
            if not whole:
                return None
            leaf, k = len(self.lengths) - 1, len(self.lengths[-1])
        if leaf >= len(self.lengths):
            leaf, k = len(self.lengths) - 1, len(self.lengths[-1])
        return lengths, counts, leaf, k

    def edit_all(self, edits: list[tuple[int, int, str]]) -> None:
        after = None
        for start, end, put in sorted(edits, reverse=True):
            if after is not None and end > after:
                raise ValueError("edits overlap")
            self.edit(start, end, put)
            after = start


def replaced(text: str, pattern: regex.Pattern, put: str) -> list[tuple[int, int, str]]:
    """Edits that put a text in place of every match."""
    return [(m.start(), m.end(), put) for m in pattern.finditer(text)]


STORED = "doc_id long, a long, b long, touched boolean, n_pretokens long, n_tokens long, lengths binary, counts binary"


def store(documents: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, a, b, touched, text -> these and the pre-tokens' number, tokens, and packed lengths and token counts: what a tree is made from."""
    ranks = _ranks(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for whole in batches:
            for batch in slices(whole):
                cut_up = [encoder.pieces(t or "") for t in batch.column("text").to_pylist()]
                numbers = [pa.array([f(x) for x in cut_up], pa.int64()) for f in (lambda x: len(x[0]), lambda x: sum(x[1]))]
                arrays = [pa.array([packed(np.array(x[k], dtype=np.int64)) for x in cut_up], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "a", "b", "touched")), *numbers, *arrays], [x.split()[0] for x in STORED.split(", ")])

    return documents.mapInArrow(run, STORED)


def recounted(edited: DataFrame, path: str = RANKS, replace: tuple[str, str] | None = None) -> DataFrame:
    """a, b, text, edits (or ``replace``: a pattern and what is put in its place) with what is stored of the text -> a, b and the counts after the edits."""
    ranks = _ranks(edited, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        pattern = regex.compile(replace[0]) if replace else None
        for whole in batches:
            for batch in slices(whole):
                rows = []
                columns = [batch.column(c).to_pylist() for c in ("a", "b", "text", "lengths", "counts", "edits")]
                for a, b, text, lengths, counted, edits in zip(*columns, strict=True):
                    n = packed_size(lengths)
                    tree = Tree(text or "", encoder, (unpacked(lengths[4:], n).tolist(), unpacked(counted[4:], n).tolist()))
                    todo = replaced(text or "", pattern, replace[1]) if pattern else [(e["start"], e["end"], e["put"]) for e in edits or ()]
                    tree.edit_all(todo)
                    rows.append((a, b, len(todo), tree.encoded, tree.total))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "n_edits", "n_reencoded", "n_tokens_edited"])

    return edited.mapInArrow(run, "a long, b long, n_edits long, n_reencoded long, n_tokens_edited long")


def packed(numbers: np.ndarray) -> bytes:
    """How many there are (four bytes), a byte each; those from 255 on follow as longs."""
    small = np.minimum(numbers, 255).astype(np.uint8)
    return len(numbers).to_bytes(4, "little") + small.tobytes() + numbers[numbers >= 255].astype(np.int64).tobytes()


def packed_size(data: bytes) -> int:
    return int.from_bytes(data[:4], "little")


def unpacked(data: bytes, n: int) -> np.ndarray:
    numbers = np.frombuffer(data[:n], dtype=np.uint8).astype(np.int64)
    numbers[numbers == 255] = np.frombuffer(data[n:], dtype=np.int64)
    return numbers


def _ranks(df: DataFrame, path: str):
    with open(path, "rb") as file:  # the tokenizer is a local file of the driver's, not a table
        return df.sparkSession.sparkContext.broadcast(file.read())


def counts(documents: DataFrame, path: str = RANKS, replace: tuple[str, str] | None = None, hint: str = "") -> DataFrame:
    """doc_id, text (and edits, without ``replace``) -> the counts before and after the edits, and how many pre-tokens were encoded again.

    ``replace``: a pattern and what is put in place of its matches, which all hold ``hint``. Only touched documents are read again.
    """
    text = F.coalesce("text", F.lit(""))
    touched = F.contains(text, F.lit(hint)) if replace else F.coalesce(F.size("edits"), F.lit(0)) > 0
    edits = F.lit(None).cast("array<struct<start:int,end:int,put:string>>") if replace else F.col("edits")
    keys = (F.xxhash64(text, edits).alias("a"), F.xxhash64(F.reverse(text), edits).alias("b"))  # what is equal is edited once
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, touched.alias("touched"), "text", edits.alias("edits"))
    stored = cut(store(keyed.drop("edits"), path))
    trees = stored.where("touched").select("a", "b", "lengths", "counts").dropDuplicates(["a", "b"])
    again = keyed.where("touched").select("a", "b", "text", "edits").dropDuplicates(["a", "b"])
    done = recounted(again.join(trees, ["a", "b"]), path, replace)
    zero = F.lit(0).cast("long")
    return stored.join(done, ["a", "b"], "left").select(
        "doc_id", "n_pretokens", "n_tokens", F.coalesce("n_edits", zero).alias("n_edits"), F.coalesce("n_reencoded", zero).alias("n_reencoded"), F.coalesce("n_tokens_edited", "n_tokens").alias("n_tokens_edited")
    )


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents").select("doc_id", "text"), replace=(ADDRESS, "<address>"), hint="@")
