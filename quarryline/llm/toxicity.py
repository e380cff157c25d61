"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

A text is judged by its sentences and a sentence by its units: words, cleared of marks, and runs of single
characters read as one word. Two units are compared by the gap-weighted subsequence kernel: common
subsequences of three characters within four and of four within five, each weighing decay ** span, normalised; a
unit's start counts as a character, fours are told apart by a 20-bit hash. Characters that
are inserted or left out cost weight, not the match.

Learning: labels belong to whole texts, so the sentences that make a text toxic are found step by step. The
first guess for a toxic text is the unit with the character run most particular to toxic texts; then a machine
is fitted on these units against units of clean texts, and the guess becomes the unit it scores highest. The fit
is on Nystroem features, kernels with landmark units times the inverse root of theirs among themselves. As the
machine is linear in them and the kernel an inner product over subsequences, it folds into one weight a
subsequence, by which every unit is scored exactly as by kernels with all landmarks. Found units also train
with a character put in or doubled.

A text's score is the logistic value of its highest sentence. The fit takes at most ``most`` toxic and twice as many
clean labelled rows, those with the smallest hashes, no longer than ``longest`` characters; scoring takes whole
texts and all rows. Training happens on the driver within these bounds.

Edge cases: null and empty texts get the score of a text without units; rows given twice are scored twice; with
no labels of either kind to learn from every score is 0; labels that are null or name no document are left out, and so are ids
that have both labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import ascii_lower, crc_fold, named, table
from quarryline.llm.words import Words, slices

#: Fixed settings of the kernel.
DECAY = 0.6
ALPHABET = 48
START = ALPHABET - 1
TRIPLES = ALPHABET**3
QUADS = 1 << 20
SPACE = TRIPLES + QUADS
SENTENCE = re.compile(r"[.!?\n]+")
#: ASCII marks, which are cleared from units wherever they stand.
MARKS = {code: None for code in range(33, 127) if not chr(code).isalnum()}
#: Index offsets of the subsequences that begin at a character: three within four, four within five.
SHAPES = [(0, *rest) for n in (3, 4) for rest in combinations(range(1, n + 1), n - 1)]


def parts(word: str) -> list[str]:
    """The units of one word between white space: cut where sentences end, cleared of marks."""
    if word.isalpha():
        return [word]
    return [u for u in (p.translate(MARKS) for p in SENTENCE.split(word)) if u]


def units_in(text: str) -> list[str]:
    """All units of a text; three or more single characters in a row are one more unit."""
    out, run = [], []
    for word in ascii_lower(text).split():
        found = parts(word)
        if len(found) == 1 and len(found[0]) == 1:
            run.append(found[0])
        elif found:
            if len(run) > 2:
                out.append("".join(run))
            run = []
        out.extend(found)
    if len(run) > 2:
        out.append("".join(run))
    return out


def variants(unit: str) -> list[str]:
    """A unit with a character put in or doubled, as insults are spelt to slip through."""
    if len(unit) < 4:
        return []
    mid, late = len(unit) // 2, max(2, 2 * len(unit) // 3)
    return [unit[:mid] + "x" + unit[mid:], unit[:late] + "1" + unit[late:], unit[:mid] + unit[mid - 1 :]]


def symbols(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as numbers below ALPHABET, all units end to end after a start each, and where each begins and the last ends."""
    lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units)) + 1
    points = np.frombuffer("".join(["^" + u for u in units]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = (points >= 97) & (points <= 122)
    digits = (points >= 48) & (points <= 57)
    other = 27 + (points * np.uint32(2654435761) >> np.uint32(16)) % (START - 27)
    codes = np.where(letters, points - 97, np.where(digits, 26, np.where(points == 94, START, other)))
    return codes.astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


def features(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit number, subsequence number and weight of all subsequences, summed a unit."""
    codes, edges = symbols(units)
    owner = np.repeat(np.arange(len(units)), np.diff(edges))
    ends = edges[1:][owner]
    rows, cols, weights = [], [], []
    for shape in SHAPES:
        at = np.flatnonzero(np.arange(len(codes)) + shape[-1] < ends)
        number = codes[at]
        for k in shape[1:]:
            number = number * ALPHABET + codes[at + k]
        if len(shape) == 4:
            number = TRIPLES + ((number * 0x9E3779B1) >> 12) % QUADS
        rows.append(owner[at])
        cols.append(number)
        weights.append(np.full(len(at), DECAY ** (shape[-1] + 1)))
    key = np.concatenate(rows) * SPACE + np.concatenate(cols)
    weight = np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    if not len(key):
        return key, key, weight
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key = key[head]
    return key // SPACE, key % SPACE, np.add.reduceat(weight, head)


def kernel(units: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernels of units with landmarks."""

    def dense(some: list[str]) -> tuple[np.ndarray, tuple]:
        found = features(some)
        return np.sqrt(np.maximum(np.bincount(found[0], found[2] ** 2, minlength=len(some)), 1e-30)), found

    norms, (row, col, weight) = dense(units)
    marks, (lrow, lcol, lweight) = dense(landmarks)
    used = np.unique(lcol)  # subsequences that some landmark has
    table = np.zeros((len(used), len(landmarks)), dtype=np.float32)
    table[np.searchsorted(used, lcol), lrow] = lweight / marks[lrow]
    at = np.minimum(np.searchsorted(used, col), len(used) - 1)
    both = used[at] == col
    row, col, weight = row[both], at[both], weight[both]
    out = np.zeros((len(units), len(landmarks)))
    edges = np.searchsorted(row, np.arange(0, len(units) + 1, 2000))
    for a, b in zip(edges, [*edges[1:], len(row)], strict=True):  # some units at a time
        if a < b:
            r = row[a:b]
            head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            out[r[head]] = np.add.reduceat(table[col[a:b]] * (weight[a:b] / norms[r]).astype(np.float32)[:, None], head, axis=0)
    return out


@dataclass
class Machine:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    known: dict = field(default_factory=dict)

    KEPT = 1_500_000

    def margins(self, units: list[str]) -> np.ndarray:
        row, col, weight = features(units)
        norms = np.sqrt(np.maximum(np.bincount(row, weight**2, minlength=len(units)), 1e-30))
        return np.bincount(row, weight * self.weights[col], minlength=len(units)) / norms + self.bias

    def of_units(self, units: list[str]) -> np.ndarray:
        """The highest margin among a word's units; the bias for none."""
        flat = [u for w in units for u in parts(w)]
        owner = [k for k, w in enumerate(units) for _ in parts(w)]
        out = np.full(len(units), self.bias)
        if flat:
            best = np.full(len(units), -np.inf)
            np.maximum.at(best, owner, np.concatenate([self.margins(flat[k : k + 20_000]) for k in range(0, len(flat), 20_000)]))
            out = np.where(np.isfinite(best), best, out)
        return out

    def highest(self, column: pa.Array) -> np.ndarray:
        """The highest margin of each text. Words are told apart by hash, and each is scored once while remembered."""
        words = Words(column)
        hashes = words.hashes(lower=True)
        seen, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        keys = seen.tolist()
        fresh = [k for k, h in enumerate(keys) if h not in self.known]
        if len(self.known) + len(fresh) > self.KEPT:
            self.known.clear()
            fresh = list(range(len(keys)))
        data = words.data.tobytes()
        spelt = [ascii_lower(data[a:b].decode("utf-8", "replace")) for a, b in zip(words.starts[first[fresh]].tolist(), words.ends[first[fresh]].tolist(), strict=True)]
        single = [len(x) == 1 for x in map(parts, spelt)]
        single = [s and len(parts(x)[0]) == 1 for s, x in zip(single, spelt, strict=True)]
        self.known.update(zip((keys[k] for k in fresh), zip(self.of_units(spelt).tolist(), single, strict=True), strict=True))
        margin = np.array([self.known[h][0] for h in keys])[where] if keys else np.zeros(0)
        alone = np.array([self.known[h][1] for h in keys], dtype=bool)[where] if keys else np.zeros(0, bool)
        out = np.full(len(words.docs) - 1, self.bias)
        full = np.flatnonzero(words.counts())
        if len(full):
            out[full] = np.maximum.reduceat(margin, words.edges[:-1][full])
        # runs of three single characters or more, read as one unit; words without units do not end a run
        at = np.flatnonzero(alone)
        third = np.flatnonzero(at[2:] <= at[:-2] + 4) if len(at) > 2 else np.zeros(0, int)
        for doc in np.unique(np.searchsorted(words.edges, at[third], side="right") - 1).tolist():
            text = data[words.docs[doc] : words.docs[doc + 1]].decode("utf-8", "replace")
            out[doc] = max(out[doc], self.margins(units_in(text)).max())
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """A linear support vector machine in its primal form, by Newton steps; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        return float(penalty @ (v * v) + weight @ np.maximum(0, 1 - y * (x @ v)) ** 2)

    for _ in range(40):
        slack = 1 - y * (x @ w)
        on = slack > 0
        step = np.linalg.solve(np.diag(penalty) + (x[on] * weight[on, None]).T @ x[on], penalty * w - x[on].T @ (weight[on] * y[on] * slack[on]))
        size, before = 1.0, loss(w)
        while loss(w - size * step) > before and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def logistic(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of label over margin."""
    centre = (np.median(margin[toxic]) + np.median(margin[~toxic])) / 2
    spread = max(1e-6, float(np.median(margin[toxic]) - np.median(margin[~toxic])))
    z = np.stack([(margin - centre) / spread, np.ones(len(margin))], axis=1)
    # targets of 1 and 0, drawn in by the class sizes
    goal = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    weight = np.full(len(margin), 1 / len(margin))
    w = np.array([4.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - goal)) + 1e-6 * w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 3.0 / max(1e-12, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def runs_of(unit: str, n: int = 4) -> list[str]:
    """Character runs of a unit: all of ``n``, and its beginnings."""
    return [unit[k : k + n] for k in range(max(1, len(unit) - n + 1))] + ["^" + unit[:k] for k in range(3, min(8, len(unit)) + 1)]


def apart(bags: list[list[str]], toxic: list[bool]) -> tuple[list[list[str]], np.ndarray]:
    """One of each group of near copies of a class: those whose long units have the same two smallest hashes."""
    found: dict[tuple, list[str]] = {}
    for bag, flag in zip(bags, toxic, strict=True):
        marks = sorted(hash_of(u) for u in bag if len(u) > 6)[:2]
        found.setdefault((flag, *marks) if len(marks) == 2 else (flag, *bag), bag)
    return list(found.values()), np.array([k[0] for k in found])


class Pool:
    """Units of all training texts with their subsequences, kept in compact arrays, so that a round scores all of them quickly."""

    def __init__(self, bags: list[list[str]]) -> None:
        self.units = list(dict.fromkeys(u for b in bags for u in b))
        number = {u: k for k, u in enumerate(self.units)}
        self.bags = [np.fromiter((number[u] for u in b), dtype=np.int64, count=len(b)) for b in bags]
        rows, cols, weights = [], [], []
        for at in range(0, len(self.units), 20_000):
            r, c, w = features(self.units[at : at + 20_000])
            norm = np.sqrt(np.bincount(r, w**2, minlength=min(20_000, len(self.units) - at)))
            rows.append((r + at).astype(np.int32))
            cols.append(c.astype(np.int32))
            weights.append((w / norm[r]).astype(np.float32))
        self.row, self.col, self.weight = map(np.concatenate, (rows, cols, weights))

    def margins(self, machine: Machine) -> np.ndarray:
        return np.bincount(self.row, self.weight * machine.weights[self.col], minlength=len(self.units)) + machine.bias


def solved(positive: Counter, negative: dict[str, int], picks: list[str], ridge: float) -> Machine:
    """The machine on Nystroem features of the landmarks ``picks``, folded into a weight a subsequence."""
    units = [*positive, *negative]
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    cost = np.concatenate([np.array(list(positive.values()), float) ** 0.5, 0.3 * np.array(list(negative.values()), float) ** 0.5])
    value, vector = np.linalg.eigh(kernel(picks, picks))
    full = value > 1e-6 * value.max()
    root = vector[:, full] / np.sqrt(value[full])
    x = np.hstack([kernel(units, picks) @ root, np.ones((len(units), 1))])
    w = squared_hinge(x, y, cost, ridge)
    row, col, weight = features(picks)
    norms = np.sqrt(np.maximum(np.bincount(row, weight**2, minlength=len(picks)), 1e-30))
    return Machine(np.bincount(col, weight / norms[row] * (root @ w[:-1])[row], minlength=SPACE), float(w[-1]))


def fit(texts: list[str], toxic: list[bool], landmarks: int = 320, rounds: int = 7, ridge: float = 0.003, background: int = 6_000, mined: int = 6_000, variant_weight: float = 0.1) -> Machine | None:
    """A machine from whole texts and their labels; None when a class is missing."""
    bags, flags = apart([list(dict.fromkeys(units_in(t))) for t in texts], toxic)
    some = [k for k, b in enumerate(bags) if b]
    bags, flags = [bags[k] for k in some], flags[some]
    if flags.all() or not flags.any():
        return None
    bad, good = ([b for b, f in zip(bags, flags, strict=True) if f == side] for side in (True, False))
    count = [Counter(g for b in side for g in {g for u in b for g in runs_of(u)}) for side in (bad, good)]
    share = len(bad) / len(bags)

    @cache
    def weight_of(run: str) -> float:
        """The signed log-likelihood ratio of how a run is dealt out between toxic and clean texts."""
        a, b = count[0][run], count[1][run]
        if a <= (a + b) * share:
            return 0.0
        return a * np.log(a / ((a + b) * share)) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0.0)

    seen = Counter(u for b in good for u in b)
    held = Counter(u for b in bad for u in b)

    def possible(unit: str) -> bool:
        """Not a word that clean texts have as well."""
        return seen[unit] * len(bad) * 8 <= held[unit] * len(good)

    def particular(unit: str) -> float:
        return max(map(weight_of, runs_of(unit))) if possible(unit) else -1.0

    score = {u: particular(u) for u in {u for b in bad for u in b}}
    chosen = [max(b, key=lambda u: (score[u], u)) for b in bad]
    common = [u for u, _ in seen.most_common(background // 3)]
    known = set(common)
    negative = common + sorted((u for u in seen if u not in known), key=lambda u: (hash_of(u), u))[: background - len(common)]
    # clean units that look most like the guesses are the first to be told apart
    pool = Pool(bags)
    barred = np.array([not possible(u) for u in pool.units])
    clean = np.unique(np.concatenate([x for x, f in zip(pool.bags, flags, strict=True) if not f]))
    hard = [u for _, u in sorted((-max(map(weight_of, runs_of(pool.units[k]))), pool.units[k]) for k in clean.tolist())[: mined // 3]]
    best, least = None, 0.0
    for _ in range(rounds):
        positive = Counter(chosen)
        for u in list(positive):
            for v in variants(u):
                positive[v] += variant_weight * positive[u]
        picks = list(dict.fromkeys([*[u for u, _ in positive.most_common(landmarks // 2)], *hard[: landmarks // 3], *negative[: landmarks // 6]]))
        machine = solved(positive, {u: max(1, seen[u]) for u in dict.fromkeys([*negative, *hard]) if u not in positive}, picks, ridge)
        margin = pool.margins(machine)
        top = np.array([margin[x].max() for x in pool.bags])
        machine.slope, machine.shift = logistic(top, flags)
        wrong = float((machine.probability(top[flags]) < 0.5).mean() + (machine.probability(top[~flags]) >= 0.5).mean())
        if best is None or wrong <= least:
            best, least = machine, wrong
        likely = np.where(barred, margin - 100, margin)
        chosen = [pool.units[x[int(np.argmax(likely[x]))]] for x, f in zip(pool.bags, flags, strict=True) if f]
        order = clean[np.argsort(-margin[clean], kind="stable")][:mined]
        hard = list(dict.fromkeys([*(pool.units[k] for k in order.tolist()), *hard]))[: 2 * mined]
    return best


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def training_rows(documents: DataFrame, labels: DataFrame, most: int, longest: int) -> tuple[list[str], list[bool]]:
    """A bounded sample of labelled rows of the learning folds: those with the smallest hashes of their ids. Ids with both labels are left out."""
    usable = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(crc_fold() != 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    order = F.xxhash64("doc_id")
    drawn = usable.where("toxic = 1").orderBy(order, "doc_id").limit(most).unionByName(usable.where("toxic = 0").orderBy(order, "doc_id").limit(2 * most))
    texts = documents.where(F.length("text") <= longest).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id", "text").limit(3 * most).toArrow()  # the draw has 3 * most rows
    return rows.column("text").to_pylist(), [t == 1 for t in rows.column("toxic").to_pylist()]


def scores(documents: DataFrame, labels: DataFrame, most: int = 500, longest: int = 6_000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """kept: a struct of the ``keep`` columns of documents; and score."""
    machine = fit(*training_rows(documents, labels, most, longest))
    judged = documents.select(F.struct(*[named(c) for c in keep]).alias("kept"), F.col("text").cast("string").alias("judged"))
    if machine is None:
        return judged.select("kept", F.lit(0.0).alias("score"))
    held = documents.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "judged", 4 << 20):
                p = held.value.probability(held.value.highest(batch.column("judged")))
                yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(p)], ["kept", "score"])

    return judged.mapInArrow(run, T.StructType([judged.schema.fields[0], T.StructField("score", T.DoubleType())]))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_fold() == 0).alias("held_out"))
    judged = scores(documents, table(spark, sf_dir, "labels"), keep=("doc_id", "held_out"))
    return judged.select("kept.doc_id", "kept.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
