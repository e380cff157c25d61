"""The pipeline keeps what it should, stage by stage."""

from __future__ import annotations

import os
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from quarryline.llm import simhash
from quarryline.llm.common import components, mix64

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        stage(spark, docs, DATA).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        after = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(after) <= before and after, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and len(after) == len(set(after))
    none = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0


def test_near_copies(spark):
    rnd = random.Random(8)
    say = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    rows = [(900, ""), (901, None), (902, " \n"), (None, "kept with no id")]
    for k in range(60):  # copies with one to six words changed: similarities on both sides of 0.8
        base = say(100)
        for j in range(4):
            copy = list(base)
            for at in rnd.sample(range(100), (k + j) % 6 + 1):
                copy[at] = "changed"
            rows.append((k * 10 + j, " ".join(copy)))
    rows += [(5, " ".join(base)), (5, "another text of the same id and none of its words"), (5, "another text of the same id and none of its words")]
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = parent[a], parent[b]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    got = Counter(map(tuple, corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()))
    assert max(got.values()) == 1 and got[None, "kept with no id"] == 1
    at = {r: parent[k] for k, r in enumerate(rows)}
    kept = Counter(at[r] for r in got)
    least = {}
    for r in rows:
        if r[0] is not None:
            least[at[r]] = min(least.get(at[r], r[0]), r[0])
    assert set(kept) == set(parent) and max(kept.values()) == 1
    assert all(r[0] == least[at[r]] for r in got if r[0] is not None)


def test_other_text_of_one_id_stays(spark):
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (1, "seven eight nine ten eleven twelve"), (2, "one two three four five six")]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got)) == rows[:2]


def test_long_simhash():
    """Majorities of each bit over a set's elements, with sets larger than a block of sums and than a piece."""
    rnd = np.random.default_rng(3)
    sizes = np.array([0, 1, 4, 255, 256, 0, 700, simhash.PIECE // 8 + 300, 5])
    flat = rnd.integers(0, 1 << 63, int(sizes.sum()), dtype=np.uint64)
    got = simhash.long_simhash(flat, sizes, 130)
    salts = mix64(np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = 0
    for row, n in zip(got, sizes, strict=True):
        for bit in (0, 63, 64, 129):
            word = mix64((flat[at : at + n] ^ salts[bit // 64]) * (mix64(salts) | np.uint64(1))[bit // 64])
            assert row[bit] == (int((word >> np.uint64(bit % 64) & np.uint64(1)).sum()) * 2 > n)
        at += n


def test_spread():
    for most in (1, 3, 100):
        parts = list(simhash._spread(np.array([2, 0, 5, 1]), most))
        assert [(int(i), int(k)) for which, offset in parts for i, k in zip(which, offset, strict=True)] == [(0, 0), (0, 1), *((2, k) for k in range(5)), (3, 0)]


@pytest.mark.parametrize("together", [simhash.TOGETHER, 16])
def test_similar(spark, together):
    """Components of similar texts as by brute force, in one group a segment and in many: copies of few changes, of which many are near and not
    similar, texts that one word more makes five shingles of four, and texts without words."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(900)}" for _ in range(60)]
    texts = ["", " ", "\n "]
    for k in range(90):
        copy = list(base)
        for at in rnd.sample(range(60), 1 + k % 3):
            copy[at] = f"x{rnd.randrange(900)}"
        texts.append(" ".join(copy))
    for k in range(20):
        words = [f"t{rnd.randrange(900)}" for _ in range(9)]
        texts += [" ".join(words), " ".join(words[:8]).upper(), " ".join(words[:4]), "  ".join(words)]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert 1 < len({r for t, r in zip(texts, root, strict=True) if t[:1] in "wx"}) < 91
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    got = {r["node"]: r["root"] for r in components(simhash.similar(rows, len(texts), together=together)).collect()}
    assert [got.get(k, k) for k in range(len(texts))] == root
