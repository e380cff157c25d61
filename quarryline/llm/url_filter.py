"""URL filter: host and path rules, and for the rest a ratio of two character models, in DataFrame functions only.

The URLs that rules allow train one Markov model of characters, those that rules block another. Characters are
folded to 32 symbols. Orders are mixed as Witten and Bell do: p_k(c | x) = (n(xc) + t(x) p_{k-1}(c | x')) / (n(x) + t(x)),
where t(x) counts the symbols seen after x, so a context lends as much to its shorter one as the data leave open, and one never
seen lends all: each character is judged by the longest context that was seen before it, up to ``order`` characters. What is scored is
the mean over characters of log p_allow - log p_block. The threshold is calibrated on the training URLs: it is
as many standard deviations from one class's mean as from the other's.

Every text is cut up once, however many URLs have it. Counts of grams (symbols with those before them) are pre-aggregated in each task, and log ratios are
a table of the grams there are, made order by order with joins of shorter grams. Up to ``MOST_GRAMS`` of them, which are counted,
are broadcast to the texts; more are joined by gram.

Edge cases: a null URL or one without ``://`` has an empty host and path, so no rule, and ratio 0; with no
URLs to learn one of the models from, the rest is allowed; rows given twice count twice and are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import cut, table

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The symbols that have a code of their own, from 1; digits fold to 0, all others to code 0.
SYMBOLS = LOWERED + "0./-_"
SIZE = len(SYMBOLS) + 1
#: Up to so many log ratios are broadcast (16 bytes each, some more as a hash table).
MOST_GRAMS = 1 << 20
#: How they are folded to the characters from @ to _, and what stands there already to @.
ALL = SYMBOLS + "123456789" + "@[]\\^"
FOLDED = "".join(chr(65 + k) for k in range(len(SYMBOLS))) + "[" * 9 + "@@@@@"
#: Fixed rules of the contract, as (rule, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWERED)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the URL's or one above it, and whose path begins the URL's; else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last that fits wins
        name, _, rest = rule.partition("/")
        out = F.when(((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest)), F.lit(rule)).otherwise(out)
    return out


def folded(host: Column, path: Column) -> Column:
    """Host and path as symbols: the characters from @ (code 0) to _ (code 31) stand for the 32 symbols."""
    text = F.translate(F.concat(host, F.translate(path, UPPER, LOWERED)), ALL, FOLDED)
    return F.regexp_replace(text, "[^@-_]", "@")


def grams(word: str, order: int) -> Column:
    """The number of each symbol of a folded text with the ``order`` before it, its digits in base SIZE; before the text stand zeros."""
    codes = F.concat(F.array_repeat(F.lit(0).cast("long"), order), F.transform(F.split(F.col(word), ""), lambda c: (F.ascii(c) - 64).cast("long")))

    def number(codes: Column, i: Column) -> Column:
        return sum((codes[i + j] * SIZE ** (order - j) for j in range(1, order + 1)), codes[i] * SIZE**order)

    # within a function of an array's elements the codes are made once, not once a symbol
    numbers = F.transform(F.array(codes), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - order - 1), lambda i: number(c, i)))
    return F.when(F.length(F.col(word)) > 0, F.element_at(numbers, 1))


def log_ratios(counts: DataFrame, order: int) -> DataFrame:
    """gram, a, b (how often in allowed and blocked URLs, 0 for those that are in others only) -> gram, ratio."""
    p = None
    for k in range(order + 1):
        n = counts.groupBy((F.col("gram") % SIZE ** (k + 1)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        n = n.select("gram", "a", "b", F.floor(F.col("gram") / SIZE).alias("context"), (F.col("gram") % SIZE**k).alias("shorter"))
        seen = n.groupBy("context").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb"))
        met = n.join(seen, "context")
        met = met.withColumns({"la": F.lit(1.0 / SIZE), "lb": F.lit(1.0 / SIZE)}) if p is None else met.join(p.select(F.col("gram").alias("shorter"), F.col("pa").alias("la"), F.col("pb").alias("lb")), "shorter")

        def mixed(x: str) -> Column:
            return F.when(F.col(f"n{x}") == 0, F.col(f"l{x}")).otherwise((F.col(x) + F.col(f"t{x}") * F.col(f"l{x}")) / (F.col(f"n{x}") + F.col(f"t{x}")))

        p = met.select("gram", mixed("a").alias("pa"), mixed("b").alias("pb"))
    return p.select("gram", (F.log("pa") - F.log("pb")).alias("ratio"))


def scored(words: DataFrame, order: int) -> DataFrame | None:
    """h, g, a, b, word (a, b: in how many allowed and blocked URLs) -> h, g, a, b and score; None if one of the models has nothing to learn from."""
    letters = words.select("h", "g", "a", "b", F.explode(grams("word", order)).alias("gram"))
    counts = cut(letters.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    size = counts.agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not size["a"] or not size["b"]:
        return None
    ratios = cut(log_ratios(counts, order))
    if size["n"] <= MOST_GRAMS:
        ratios = F.broadcast(ratios)
    return cut(letters.join(ratios, "gram").groupBy("h", "g", "a", "b").agg(F.avg("ratio").alias("score")))


def calibrated(scores: DataFrame) -> float:
    """The threshold that is as many standard deviations from the mean of allowed URLs as from that of blocked ones."""
    sums = [F.sum(F.col(x) * f).alias(f"{x}{k}") for x in ("a", "b") for k, f in enumerate((F.lit(1.0), F.col("score"), F.col("score") * F.col("score")))]
    s = scores.agg(*sums).first()
    (ma, sa), (mb, sb) = ((s[f"{x}1"] / s[f"{x}0"], max(0.0, s[f"{x}2"] / s[f"{x}0"] - (s[f"{x}1"] / s[f"{x}0"]) ** 2) ** 0.5) for x in ("a", "b"))
    return (ma * sb + mb * sa) / (sa + sb) if sa + sb > 0 else (ma + mb) / 2


def judge(pages: DataFrame, rules=RULES, order: int = 4) -> DataFrame:
    """page_id, url -> page_id, host, path, rule, verdict, ratio."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = split.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    word = folded(F.col("host"), F.col("path"))
    coded = ruled.withColumn("by_rule", by_rule).withColumn("word", word).withColumns({"h": F.xxhash64("word"), "g": F.hash(F.reverse("word"))})
    words = cut(coded.groupBy("h", "g", "word").agg(F.count_if(F.col("by_rule") == "allow").alias("a"), F.count_if(F.col("by_rule") == "block").alias("b")))
    scores = scored(words, order)
    if scores is None:
        return coded.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("ratio"))
    ratio = F.coalesce("score", F.lit(0.0))
    verdict = F.coalesce("by_rule", F.when(ratio >= calibrated(scores), "allow").otherwise("block"))
    return coded.drop("word").join(scores.select("h", "g", "score"), ["h", "g"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), ratio.alias("ratio"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _level(k: int) -> str:
    lower = f"JOIN p{k - 1} l ON n.gram % {SIZE**k} = l.gram" if k else f"CROSS JOIN (SELECT {1 / SIZE!r}::DOUBLE AS pa, {1 / SIZE!r}::DOUBLE AS pb) l"
    return f"""
n{k} AS (SELECT gram % {SIZE ** (k + 1)} AS gram, sum(a) AS a, sum(b) AS b FROM counts GROUP BY 1),
s{k} AS (SELECT gram // {SIZE} AS context, sum(a) AS na, sum(b) AS nb, count(*) FILTER (WHERE a > 0) AS ta, count(*) FILTER (WHERE b > 0) AS tb FROM n{k} GROUP BY 1),
p{k} AS (
  SELECT n.gram, CASE WHEN na = 0 THEN l.pa ELSE (a + ta * l.pa) / (na + ta) END AS pa, CASE WHEN nb = 0 THEN l.pb ELSE (b + tb * l.pb) / (nb + tb) END AS pb
  FROM n{k} n JOIN s{k} s ON n.gram // {SIZE} = s.context {lower}),"""


_GRAM = " + ".join(f"CASE WHEN i > {j} THEN c[i - {j}] ELSE 0 END * {SIZE**j}" for j in range(5))
URL_SQL = f"""
WITH split AS (
  SELECT row_number() OVER () AS r, page_id, lower(coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')) AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
  translate(host || lower(path), '123456789', '000000000') AS word FROM split),
judged AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule,
  list_transform(range(1, length(word) + 1), lambda i: instr('{SYMBOLS}', substr(word, i, 1))) AS c FROM ruled),
spelt AS (SELECT *, list_transform(range(1, len(c) + 1), lambda i: {_GRAM}) AS gram FROM judged),
letters AS (SELECT r, by_rule, unnest(gram) AS gram FROM spelt),
counts AS (SELECT gram, count(*) FILTER (WHERE by_rule = 'allow') AS a, count(*) FILTER (WHERE by_rule = 'block') AS b FROM letters GROUP BY gram),{"".join(map(_level, range(5)))}
ratios AS (SELECT gram, ln(pa) - ln(pb) AS ratio FROM p4),
scored AS (SELECT r, avg(ratio) AS ratio FROM letters JOIN ratios USING (gram) GROUP BY r),
marks AS (SELECT by_rule, avg(ratio) AS m, stddev_pop(ratio) AS s FROM spelt JOIN scored USING (r) WHERE by_rule IS NOT NULL GROUP BY by_rule),
cutoff AS (SELECT (x.m * y.s + y.m * x.s) / (x.s + y.s) AS t FROM marks x, marks y WHERE x.by_rule = 'allow' AND y.by_rule = 'block')
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN coalesce(ratio, 0) >= t THEN 'allow' ELSE 'block' END) AS verdict
FROM spelt LEFT JOIN scored USING (r), cutoff
"""
