"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from quarryline.llm import common, decontaminate, line_dedup, lm_score, mixing, neighbours, simhash, substring_dedup, token_counts, toxicity, url_filter, words

SPACED, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VOCABULARY = "the of and éa über tion Thand wh 12x you're stone river moon lamp".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, _doc string, spans string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def corpus():
    rnd = random.Random(3)
    say = lambda n: " ".join(rnd.choice(VOCABULARY) + rnd.choice(["", "", "s", "er"]) for _ in range(n))
    shared, base = say(30), say(200)
    rows = [(k, say(rnd.randint(1, 90)) + ("\n" + shared if k % 3 == 0 else "") + "\n" + say(9)) for k in range(40)]
    rows += [(100 + k, base + (" x" if k == 3 else "")) for k in range(5)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "a\u00a0b Éé"), (None, base), (205, say(9000)), (206, "a a a " * 30)]
    rows += [rows[0], rows[41]]
    return [(d, t, "en", f"s{(d or 0) % 3}" if d != 7 else None, len(t or ""), 0.5, 1, "x", "y") for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_arrays():
    import pyarrow as pa

    texts = [r[1] for r in corpus()]
    for column in (pa.array(texts), pa.array(["skipped", *texts])[1:], pa.array(texts, pa.large_string())):
        for kind, pattern in ((words.SPACED, SPACED), (words.PLAIN, PLAIN)):
            found = words.Words(column, kind)
            want = [[low(w) for w in pattern.findall(low(t or "") if kind is words.PLAIN else t or "")] for t in texts]
            assert found.counts().tolist() == [len(w) for w in want]
            assert [low(bytes(found.data[a:b]).decode()) for a, b in zip(found.starts, found.ends, strict=True)] == [w for x in want for w in x]
            assert found.hashes(lower=True).tolist() == [words.word_hash(low(w)) for x in want for w in x]
    data = np.frombuffer(bytes(range(256)) * 20, dtype=np.uint8)
    starts = np.repeat(np.arange(100), 40)
    ends = starts + np.tile(np.arange(40) * 3, 100)
    assert words.xxh64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends, strict=True)]


def test_substring_dedup(docs, empty):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs).collect())
    order = sorted({(r[0], r[1]) for r in corpus()}, key=lambda x: (x[0] is None, x[0] or 0))
    seen, want = set(), {}
    for doc, text in order:
        w = SPACED.findall(text or "")
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            if tuple(w[a : a + 20]) in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(tuple(w[a : a + 20]))
        want[doc, text] = (doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert got == Counter(want[r[0], r[1]] for r in corpus())
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_simhash(docs, empty):
    got = {(r["doc_id"], r["print"] % 2**64): r["component_id"] for r in simhash.groups(docs).collect()}
    prints = []
    for r in corpus():
        w = SPACED.findall(low(r[1] or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append((r[0], sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))))
    parent = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                x, y = parent[a], parent[b]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    for k, key in enumerate(prints):
        assert got[key] == min((d for j, (d, _) in enumerate(prints) if parent[j] == parent[k] and d is not None), default=None)
    assert simhash.groups(empty).count() == 0


def test_simhash_broadcasts_nothing(spark, docs, monkeypatch):
    """Tables of few bytes can have as many rows as there are documents: none of them may pass through the driver."""
    plans = []

    def watched(df, cut=common.cut):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(common, "cut", watched)
    monkeypatch.setattr(simhash, "cut", watched)
    found = simhash.groups(docs)
    found.collect()
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and sum("SortMergeJoin" in p for p in plans) > 1
    assert not any("Broadcast" in p for p in plans)


def test_decontaminate(spark, docs, empty):
    rows = corpus()
    items = [(1, " ".join(PLAIN.findall(rows[3][1])[2:15])), (2, "one"), (3, ""), (4, None), (None, "river moon"), (5, " ".join(PLAIN.findall(rows[5][1])[:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for name, text in items:
        w = PLAIN.findall(low(text or "")) if name is not None else []
        for a in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[a : a + 8]), set()).add(str(name))
    want = Counter()
    for r in rows:
        w = PLAIN.findall(low(r[1] or ""))
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    names |= windows[tuple(w[a : a + n])]
                    hit |= set(range(a, a + n))
        want[r[0], len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(names) >= 2] += 1
    columns = ["kept.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for size in (1_000_000, 5):  # one block, and several
        assert Counter(map(tuple, decontaminate.report(decontaminate.matches(docs, bench, block_words=size)).select(*columns).collect())) == want
    kept = decontaminate.matches(docs, bench, keep=tuple(docs.columns)).select("kept.*")
    assert kept.columns == docs.columns and Counter(map(str, kept.collect())) == Counter(map(str, docs.collect()))
    keys = decontaminate.contaminated_texts(docs, bench).join(docs.select(*decontaminate.text_key(), "text"), ["a", "b"])
    texts = {r[1] for r in rows if any(w[2] and w[0] == r[0] for w in want)}
    assert {r["text"] for r in keys.collect()} == texts
    assert decontaminate.report(decontaminate.matches(empty, bench.limit(0))).count() == 0


def test_decontaminate_many_terms_in_a_large_segment(spark):
    """Number of a term times places of its segment exceeds 32 bits."""
    words = [f"w{k}" for k in range(4_000)]
    docs = spark.createDataFrame([(1, "x " * 800_000), (2, " ".join(words)), (3, "y " + " ".join(words[-9:]))], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[-8:]))], "item_id long, text string").coalesce(1)
    for slop in (0, 1):
        found = decontaminate.report(decontaminate.matches(docs, items, slop=slop)).select("kept.doc_id", "n_words", "n_hit", "n_items", "contaminated", "n_near_items")
        assert sorted(map(tuple, found.collect())) == [(1, 800_000, 0, 0, False, 0), (2, 4_000, 4_000, 2, True, 2), (3, 10, 9, 2, True, 2)]


def test_decontaminate_near(spark):
    rnd = random.Random(7)
    rows = [(k, " ".join(rnd.choice("abcd") + rnd.choice("xy") for _ in range(rnd.randint(0, 30)))) for k in range(60)]
    items = [(k, " ".join(rnd.choice("abcd") + rnd.choice("xy") for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 9, 12])]
    frames = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for slop in (0, 1, 2):
        for window, block in ((4, 100), (4, 3), (8, 100)):
            got = {r["kept"]["doc_id"]: (r["found"]["items"], r["found"]["near"]) for r in decontaminate.matches(*frames, window=window, slop=slop, block_words=block).collect()}
            for d, text in rows:
                w = text.split()
                exact, near = set(), set()
                for name, item in items:
                    x = item.split()
                    for a in range(max(1, len(x) - window + 1)):
                        p = x[a : a + window]
                        for start in range(-40, len(w) + 5):
                            far = [min((abs(j - start - k) for j, t in enumerate(w) if t == q), default=99) for k, q in enumerate(p)]
                            if max(far) <= slop:
                                near.add(str(name))
                                if max(far) == 0:
                                    exact.add(str(name))
                assert got[d] == (sorted(exact), sorted(near)), (slop, window, d)


def test_lm_score(docs, empty):
    train = docs.withColumn("held_out", F.col("doc_id") % 5 == 1).select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    learnt = lm_score.learn(train.where("not held_out"), head=3, bits_each=2000)  # so many bits that nothing is taken for another
    found = {}
    for name, most in (("broadcast", 1 << 27), ("parts", 0)):
        rows = lm_score.score(train, learnt, max_bytes=most).collect()
        found[name] = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in rows)
    tokens = [(r[0], [*SPACED.findall(low(r[1] or "")), " end"]) for r in corpus()]
    training = [t for d, t in tokens if d is None or d % 5 != 1]
    c = Counter(w for t in training for w in t)
    pairs = Counter(p for t in training for p in zip([" end", *t], t))
    n, v = sum(c.values()), len(c)

    def read(count):
        q = 1 + math.floor(math.log2(count)) if count else 0
        return (2 ** (q - 1) + max(2 ** (q - 1), 2**q - 1)) / 2 if q else 0

    base = lambda x: (x + 0.5) / (n + 0.5 * (v + 1))

    def model(before, word):
        c1, cb = read(c[word]), read(c[before])
        return math.log10((min(read(pairs[before, word]), c1, cb) + 50 * base(c1)) / (cb + 50))

    want = Counter((d, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10(base(c[w])) for w in t), 6), round(sum(model(*p) for p in zip([" end", *t], t)), 6)) for d, t in tokens)
    assert found["broadcast"] == want and found["parts"] == want
    learnt = lm_score.learn(empty)
    assert lm_score.score(train, learnt).where("n_known > 0").count() == 0
    assert lm_score.score(train.limit(0), learnt).count() == 0


def test_lm_score_asks_shelves_not_parts(docs, monkeypatch):
    """The rows that a batch sends must not grow with the filter's parts, of which there are 512 here."""
    train, made = docs.select("doc_id", "text", F.lit(False).alias("held_out")), []
    learnt = lm_score.learn(train)
    monkeypatch.setattr(lm_score, "cut", lambda df, cut=lm_score.cut: made.append(cut(df)) or made[-1])
    assert lm_score.score(train, learnt, max_bytes=0).count() == train.count()
    batches = made[0].select("batch").distinct().count()
    assert learnt[1] == 8 and made[0].count() == 3 * batches


def test_line_dedup(spark, docs, empty):
    rows = [(1, "alpha beta gamma 12 delta\nkeep me here now\nx"), (2, "alpha beta gamma 99 delta\nx\n\nnew line of text"), (3, None), (None, "keep me here now"), (4, ""),
            (5, "a b c d e f g h i j"), (6, "a b c d e f g h i Z"), (7, "1 2 3"), (8, "4 5 6"), (2, "alpha beta gamma 99 delta\nx\n\nnew line of text")]
    found = line_dedup.dedup_lines(spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_chars long")).collect()
    got = sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in found), key=str)
    want = [(1, rows[0][1], 0), (2, "\nnew line of text", 2), (2, "\nnew line of text", 2), (3, None, 0), (None, "", 1), (4, "", 0), (5, rows[5][1], 0), (6, "", 1), (7, "1 2 3", 0), (8, "4 5 6", 0)]
    assert got == sorted(want, key=str)
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in found)
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.dedup_lines(docs).count() == len(corpus())


def test_line_dedup_under_full_leaves(spark):
    rnd = random.Random(5)
    rows = []
    bases = [[rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(n)] for n in (2, 6, 7, 11, 24) for _ in range(5)]
    for d in range(40):
        said = [[w if rnd.random() < 0.9 else rnd.choice("uvw") for w in rnd.choice(bases)] for _ in range(4)]
        rows.append((d, "\n".join(" ".join(["on", "this", "day", *x]) for x in said)))
    born = {}
    for d, text in rows:
        for line in text.split("\n"):
            born.setdefault(tuple(line.split()), d)

    def one(a, b):
        n = len(a)
        apart = {(k - 3) // max(1, n // 10) for k in range(n) if len(b) == n and a[k] != b[k]}
        return len(b) == n and a[:3] == b[:3] and len(apart) <= (0 if n < 5 else 1 if n < 10 else 2)

    first = {t: min(d for x, d in born.items() if one(t, x)) for t in born}
    # in lines of up to 14 tokens that is the same as four fifths of all places
    assert all(one(a, b) == (sum(x == y for x, y in zip(a, b, strict=True)) >= 0.8 * len(a)) for a in born for b in born if len(a) == len(b) < 15)
    assert sum(first[t] < d for t, d in born.items()) > 20
    want = {d: "\n".join(x for x in text.split("\n") if first[tuple(x.split())] == d) for d, text in rows}
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["text"] for r in found.collect()} == want


def test_line_dedup_six_templates_of_one_leaf(spark):
    rows = [(10 * k + j, f"to be sure {w} {w}a {w}b name{c} {w}d") for k, w in enumerate("uvwxyz") for j, c in enumerate("ab")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in found.where("n_dropped = 1").collect()} == {10 * k + 1 for k in range(6)}


def test_mixing(docs, empty):
    out = mixing.mix(docs, {"s0": 3.0, "s1": 1.0}, epochs=400.0).groupBy("source").agg(F.sum(F.greatest(F.lit(1), F.length("text"))).alias("n")).collect()
    size = {r["source"]: r["n"] for r in out}
    assert set(size) == {"s0", "s1"} and 2.5 < size["s0"] / size["s1"] < 3.6
    a, b = (sorted(map(str, mixing.mix(d).select("doc_id", "copy", "shuffle_key").collect())) for d in (docs, docs.repartition(7)))
    assert a == b and mixing.mix(empty).count() == 0
    u = [k / 997 for k in range(997)]
    rows = docs.sparkSession.createDataFrame([(x,) for x in u], "u double").select(mixing.poisson_at(F.col("u"), F.lit(2.5)).alias("k")).collect()
    f = np.cumsum([math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(40)])
    assert [r["k"] for r in rows] == [int(np.argmax(f >= x)) for x in u]


def test_url_filter(spark):
    urls = ["http://a.example.com/en/1", "https://www.example.com/en/x?q", "http://EXAMPLE.com", "x.net/es/1", None, "", "http://b.net/fr/#t", "http://b.net/es/9", "http://c.example.com/de/2", "ftp://u.org/fr/9", "http://u.org/de/1", "a://b://c/d"]
    pages = spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for k, url in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        assert (got[k]["host"], got[k]["path"]) == ((low(m[1]), m[2]) if m else ("", ""))
    assert [got[k]["rule"] for k in range(12)] == ["example.com/en/", "www.example.com/en/", None, None, None, None, "net/fr/", "net/es/", "com/", None, None, None]
    assert [got[k]["verdict"] for k in (0, 1, 6, 7, 8)] == ["block", "allow", "block", "block", "allow"]
    assert {r["verdict"] for r in url_filter.judge(pages.where("page_id = 4")).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(600, 20)), np.repeat(rng.normal(size=(1, 20)), 60, axis=0)]).astype(np.float32)
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(9000, None), (9001, [0.0] * 20), (9002, [float("nan")] * 20), (9003, [None] * 20), (9004, [1.0, 2.0]), (None, [1.0] * 20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = frame.where("vec_id % 20 = 0 OR vec_id = 9004")
    got = {}
    for r in neighbours.search(frame, asked, tables=24, block=100).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hit = n = 0
    y = x.astype(np.float64)
    for q in range(0, 660, 20):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        hit += len(set(best) & {v for v, _ in got[q]})
        n += 10
        assert all(abs(d[v] - s) < 1e-12 for v, s in got[q]) and [s for _, s in got[q]] == sorted(s for _, s in got[q])
    assert hit / n >= 0.9 and 9004 not in got
    assert [v for v, _ in got[640]] == [k for k in range(600, 611) if k != 640][:10]
    assert neighbours.search(frame.limit(0), asked).count() == 0


def test_neighbours_of_few(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(v) for v in rng.normal(size=20)]) for k in range(8)] + [(20, [1.0] * 20)] * 12 + [(k, [1.0] * 20) for k in (21, 22)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (3, 10, 20):
        got = {}
        for r in neighbours.search(frame, frame, k=k, tables=1, probes=1, block=4).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert all(len(got[q]) == min(k, 10) for q in range(8)) or k == 3
        assert got[21][:2] == [20, 22] and got[20][:2] == [21, 22]
    assert len(got) == 11 and all(set(v) == {x for x, _ in rows} - {q} for q, v in got.items())


def test_token_counts(docs, empty):
    encoder = token_counts.Encoder(open(token_counts.RANKS, "rb").read())
    rnd = random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", "'", "s", "'ll", " 12", "é", "日", "!", "don't", "\t"]
    for n in [400] * 300 + [20_000] * 4:
        tree = token_counts.Tree("".join(rnd.choice(bits) for _ in range(rnd.randint(0, n))), encoder)
        for _ in range(4 if n == 400 else 100):
            a, text = rnd.randint(0, len(tree.text)), tree.text
            b, put = min(len(text), a + rnd.randint(0, 40)), "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 3, 8, 2000])))
            tree.edit(a, b, put)
            assert tree.text == text[:a] + put + text[b:]
            if n == 400 or rnd.random() < 0.1:
                assert tree.total == len(encoder.coder.encode_ordinary(tree.text))
        assert tree.total == len(encoder.coder.encode_ordinary(tree.text))
    with pytest.raises(ValueError, match="overlap"):
        token_counts.Tree("abcdef", encoder).edit_all([(0, 3, "x"), (2, 4, "y")])
    texts = {r[0]: r[1] or "" for r in corpus()}
    size = lambda t: len(encoder.coder.encode_ordinary(t))
    by_pattern = token_counts.counts(docs, replace=("stone", "a pebble"), hint="stone").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_tokens_edited"], r["n_edits"]) for r in by_pattern) == Counter((d, size(t or ""), size((t or "").replace("stone", "a pebble")), (t or "").count("stone")) for d, t, *_ in corpus())
    edited = docs.withColumn("edits", F.expr("CASE WHEN doc_id = 3 THEN array(named_struct('start', 0, 'end', 5, 'put', 'x'), named_struct('start', 9, 'end', 9, 'put', ' y')) END"))
    for r in token_counts.counts(edited).collect():
        t = texts[r["doc_id"]]
        assert r["n_tokens_edited"] == size("x" + t[5:9] + " y" + t[9:] if r["doc_id"] == 3 else t) and r["n_tokens"] == size(t)
    assert token_counts.counts(empty, replace=("x", "y")).count() == 0


def test_toxicity(spark, empty):
    rnd = random.Random(4)
    say = lambda n: [rnd.choice("th er on an re ti es or".split()) + rnd.choice("ing ed ly ou ha".split()) + rnd.choice("sh le ra".split()) for _ in range(n)]
    rows, marks = [], []
    for k in range(400):
        w = say(40)
        if k % 4 == 0:
            w[rnd.randrange(40)] = rnd.choice(["scumbag", "moronic", "worthless"])
        rows.append((k, " ".join(w) + "."))
        marks.append((k, 1 if k % 4 == 0 else 0))
    rows += [(900, None), (901, ""), (902, "thingsh " * 30_000), (903, "you scu-mbag"), (904, "s c u m b a g it is")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([*marks, (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    got = {r["kept"]["doc_id"]: r["score"] for r in toxicity.scores(frame, labels).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == (k % 4 == 0) for k in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[903] >= 0.5 and got[904] >= 0.5 and got[900] < 0.5 and got[901] < 0.5
    assert {r["score"] for r in toxicity.scores(frame, labels.limit(0)).collect()} == {0.0}
    assert toxicity.scores(empty, labels.limit(0)).count() == 0
