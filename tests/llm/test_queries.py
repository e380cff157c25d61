"""The registered queries on the smallest tables, against SQL or brute force; and every stage on columns of clashing names."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from quarryline.llm import decontaminate, line_dedup, mixing, neighbours, registry, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SPACED, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def run(spark):
    held = {}

    def rows(name):
        if name not in held:
            held[name] = registry.queries()[name](spark, DATA).collect()
        return held[name]

    return rows


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equal_to_sql(run, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    norm = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = run(name)
    assert sorted(got[0].asDict()) == sorted(names)
    assert sorted(tuple(norm(r[c]) for c in names) for r in got) == sorted(tuple(map(norm, r)) for r in found.fetchall())


def test_token_counts(run, documents):
    from quarryline.llm import token_counts

    coder = token_counts.Encoder(open(token_counts.RANKS, "rb").read()).coder
    address = re.compile(token_counts.ADDRESS)
    size = lambda t: len(coder.encode_ordinary(t))
    want = {d: (size(t), len(address.findall(t)), size(address.sub("<address>", t))) for d, t, *_ in documents}
    assert {r["doc_id"]: (r["n_tokens"], r["n_edits"], r["n_tokens_edited"]) for r in run("op2_token_counts")} == want
    assert any(n for _, n, _ in want.values())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_neighbours(spark, size):
    import pyarrow.parquet as pq

    table = pq.read_table(f"/root/testdata/{size}/embeddings.parquet")
    ids, x = np.array(table["vec_id"]), np.array(table["embedding"].to_pylist(), dtype=np.float32).astype(np.float64)
    got = {}
    for r in neighbours.op4_neighbours(spark, f"/root/testdata/{size}").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    asked = np.flatnonzero(ids % 100 == 0)
    assert set(got) == set(ids[asked].tolist())
    hit = 0
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        mine = got[ids[q]]
        assert len(mine) == 10 and [s for _, s in mine] == sorted(s for _, s in mine)
        at = {v: k for k, v in enumerate(ids.tolist())}
        assert all(abs(d[at[v]] - s) < 1e-12 for v, s in mine)
        hit += len(best & {v for v, _ in mine})
    assert hit / (10 * len(asked)) >= 0.9


def test_toxicity(run, documents, spark):
    rows = {r["doc_id"]: r for r in run("op5_toxicity")}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for d, r in rows.items())
    assert len(rows) == len(documents) and set(labels) <= set(rows)
    # there are too few labels here to tell how good it is
    found = {r["doc_id"]: r for r in toxicity.op5_toxicity(spark, "/root/testdata/sf0.1").collect()}
    held = [(found[r["doc_id"]]["predicted"], r["toxic"]) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if found[r["doc_id"]]["held_out"]]
    right = Counter(held)
    print("\nheld out (predicted, label):", right)
    assert np.mean([a == b for a, b in held]) >= 0.9 and right[1, 1] >= 0.8 * (right[0, 1] + right[1, 1])


def test_toxicity_kernel_by_hand():
    """The kernel against its definition, and a folded machine's margin against the sum over landmarks."""

    def spectrum(unit):
        out = Counter()
        codes = toxicity.symbols([unit])[0].tolist()
        for shape in toxicity.SHAPES:
            for k in range(len(codes) - shape[-1]):
                out[tuple(codes[k + s] for s in shape)] += toxicity.DECAY ** (shape[-1] + 1)
        return out

    def kernel(a, b):
        x, y = spectrum(a), spectrum(b)
        norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y[k] for k, v in x.items()) / norm if norm else 0.0

    units = ["scumbag", "scu1mbag", "moron", "mormon", "river", "stone", "rivers", "idiotic", "idyllic", "ab"]
    marks = ["scumbag", "moron", "river", "idiotic"]
    direct = np.array([[kernel(u, m) for m in marks] for u in units])
    assert np.allclose(toxicity.kernel(units, marks), direct, atol=1e-6)
    positive, negative = Counter({"scumbag": 2, "moron": 1, "idiotic": 1}), {"river": 3, "stone": 1, "mormon": 1}
    machine = toxicity.solved(positive, negative, marks, 0.003)
    value, vector = np.linalg.eigh(toxicity.kernel(marks, marks))
    root = vector / np.sqrt(value)
    learnt = [*positive, *negative]
    y = np.array([1.0] * 3 + [-1.0] * 3)
    cost = np.concatenate([np.array(list(positive.values()), float) ** 0.5, 0.3 * np.array(list(negative.values()), float) ** 0.5])
    x = np.hstack([np.array([[kernel(u, m) for m in marks] for u in learnt]) @ root, np.ones((6, 1))])
    w = toxicity.squared_hinge(x, y, cost, 0.003)
    assert np.allclose(machine.margins(units), direct @ root @ w[:-1] + w[-1], atol=1e-4)
    assert kernel("scumbag", "scu1mbag") > kernel("scumbag", "stone")


def test_lm_score(run, documents):
    tokens = {d: [*SPACED.findall(low(t)), " end"] for d, t, *_ in documents}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    c = Counter(w for d, t in tokens.items() if not held[d] for w in t)
    n, v = sum(c.values()), len(c)
    rows = run("op7_lm_score")
    assert len(rows) == len(documents)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) < 1e-6 * len(t)
    # the model knows pairs, so it expects held-out texts better than the base does
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_simhash(run, documents):
    prints = {}
    for d, t, *_ in documents:
        w = SPACED.findall(low(t))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[d] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    root = {d: d for d in prints}
    for a in prints:
        for b in prints:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
                x, y = root[a], root[b]
                root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run("op8_simhash")} == {d: (f"{p:016x}", root[d]) for d, p in prints.items()}


# the pipeline, stage by stage in plain Python


def without_lines(docs):
    born = {}

    def template(line):
        w = [x for x in re.split(r"[\x20\x09\x0B-\x0D]+", line) if x]
        m = ["<*>" if re.search("[0-9]", x) else x for x in w]
        open_ = sum(x == "<*>" for x in m) * 2 <= len(w) or not re.search("[0-9]", line)
        return (tuple(m if open_ else w), open_)

    for d, text, *_ in docs:
        for line in text.split("\n"):
            t = template(line)
            if t[0]:
                born.setdefault(t, d)
    under = {}
    for t in born:
        under.setdefault((len(t[0]), t[0][:3]), []).append(t)

    def first(t):
        n, best = len(t[0]), born[t]
        may = 0 if n < 5 or not t[1] else 1 if n < 10 else 2
        for x in under[n, t[0][:3]] if may else ():
            apart = {(k - 3) // max(1, n // 10) for k in range(n) if t[0][k] != x[0][k]}
            if x[1] and len(apart) <= may:
                best = min(best, born[x])
        return best

    out = []
    for d, text, *rest in docs:
        kept = [x for x in text.split("\n") if not template(x)[0] or first(template(x)) >= d]
        out.append((d, "\n".join(kept), *rest[:-1], len("\n".join(kept))))
    return out


def without_copies(docs):
    sets = []
    for _, text, *_ in docs:
        w = SPACED.findall(low(text))
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return [r for k, r in enumerate(docs) if root[k] == k]


def without_leaks(docs, items):
    windows = set()
    for text in items:
        w = PLAIN.findall(low(text or ""))
        windows |= {tuple(w[a : a + 8]) for a in range(max(1, len(w) - 7))} if w else set()
    sizes = {len(w) for w in windows}

    def leaks(text):
        w = PLAIN.findall(low(text))
        return any(tuple(w[a : a + n]) in windows for n in sizes for a in range(len(w) - n + 1))

    return [r for r in docs if not leaks(r[1])]


def mixed(docs):
    def uniform(key):
        return int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 16**13

    chars = Counter()
    for r in docs:
        chars[r[3]] += max(1, len(r[1]))
    weights = {s: math.sqrt(n) for s, n in chars.items()}
    out = []
    for r in docs:
        mean = weights[r[3]] / sum(weights.values()) * sum(chars.values()) / chars[r[3]]
        u, p, f, k = uniform(f"mix-1:{r[0]}"), math.exp(-mean), math.exp(-mean), 0
        while f < u:
            k += 1
            p *= mean / k
            f += p
        out += [(*r, c) for c in range(1, k + 1)]
    return out


def test_pipeline_against_brute_force(spark, run, documents):
    scores = {r["doc_id"]: r["score"] for r in run("op5_toxicity")}  # the classifier is the operator's
    docs = [r for r in documents if scores[r[0]] < 0.5]
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    after = [documents, docs]
    for step in (without_lines, without_copies, lambda d: without_leaks(d, items)):
        after.append(step(after[-1]))
    sizes = [len(x) for x in after]
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] > sizes[3] > sizes[4], sizes
    got = corpus_pipeline.run(spark, DATA).drop("shuffle_key").collect()
    assert Counter(map(tuple, got)) == Counter(mixed(after[-1]))


#: Names that operators use for columns of their own.
CLASHING = "row doc t leaf key n score kept judged copy shuffle_key rate origin a b h g spans items near segment k docs found n_words n_lines n_dropped stays text_hash component node root line_no gone lines lang.x _0 _1 _n _doc _t _rate _source _lines _stays".split()


def test_every_stage_keeps_clashing_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    rows = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars"))
    for c in CLASHING:
        rows = rows.withColumn(c, F.concat(F.lit(c), F.coalesce("source", F.lit(""))))
    plain = rows.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        own = [c for c in rows.columns if c not in ("copy", "shuffle_key")]
        out = stage(spark, rows, DATA)
        assert out.columns == rows.columns, name
        at = lambda df: Counter((r["doc_id"], r["text"], r["n_chars"]) for r in df.collect())
        assert at(out) == at(stage(spark, plain, DATA)), name
        values = out.select(*[F.col(f"`{c}`") for c in own if c in CLASHING], "source").limit(5).collect()
        assert all(r[c] == c + (r["source"] or "") for r in values for c in own if c in CLASHING), name
    assert line_dedup.dedup_lines(plain).columns == [*plain.columns, "n_lines", "n_dropped"]
    assert mixing.mix(plain).columns == [*plain.columns, "copy", "shuffle_key"]
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.matches(rows, bench, keep=tuple(rows.columns)).select("kept.*").columns == rows.columns
    assert toxicity.scores(rows, spark.read.parquet(f"{DATA}/labels.parquet"), keep=tuple(rows.columns)).select("kept.*").columns == rows.columns


def test_stages_of_empty_and_repeated_rows(spark):
    for rows in ([], [(1, None, "en", None, 0)] * 3 + [(None, "", None, "s", 0)] * 2 + [(2, "one two", "en", "s", 7)] * 2):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            assert set(docs.columns) <= set(stage(spark, docs, DATA).columns)
            assert stage(spark, docs, DATA).count() <= max(len(rows), 0) * 4
