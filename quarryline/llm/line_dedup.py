"""Line dedup by a log-template tree, in DataFrame functions only.

A line's tokens are its words between white space; a token with a digit is a variable field. The tree has
a fixed depth: number of tokens, then the first ``lead`` tokens, fields generalised, then the stretches. What
follows the lead is cut into stretches of a tenth of the tokens each (one token at least). Two templates under a
leaf are one if they differ within at most two stretches, in lines of five to nine tokens within one: what
stands there is a variable field, and they agree in four fifths of their tokens or more. In lines of fewer than 15
tokens that is every pair that agrees in so many. A line goes if an earlier document (smaller doc_id) has a line whose template is one with its own;
within its first document a template stays as often as it comes.

No template is compared with another: it is filed under its hash without each two stretches, and the earliest
document under these nodes is what counts, so the work grows in proportion to the templates, however many
are under a leaf. Lines travel as hashes, 32 bits a stretch. Only under leaves with several templates nodes are made
(a bitmap of fixed size, sent along in the plan, passes by most others), and only for templates that share a third of their
stretches with another one, as all that are one do. The earliest document is pre-aggregated in each task, so a
line that a third of all documents have costs one row a task; in the joins that bring it back to templates and
lines both sides are plain shuffles, of which Spark splits skewed partitions.

Edge cases: null and empty texts have no lines that could go; lines without tokens stay; lines of fewer than five
tokens are one only if their templates are equal; a template with more fields than other tokens isn't generalised,
neither at its digits nor at stretches; all rows of one doc_id are one document, rows without one another, which comes last. Columns pass
through, whatever their names, but text, n_chars (set anew if there) and, unless ``counted`` is False, n_lines and n_dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import boxed, cut, dealt, table, unboxed

LAST = (1 << 63) - 1
#: Fixed patterns: white space between tokens, a token with a digit, what stands for a field.
SPACE = r"[\x20\x09\x0B-\x0D]+"
FIELD = r"(?<![^\x20\x09\x0B-\x0D])[^\x20\x09\x0B-\x0D0-9]*+[0-9][^\x20\x09\x0B-\x0D]*+"
MARK = "<*>"
#: A stretch is one of so many parts of a line; lines below ONE tokens have no variable stretch, below TWO only one.
TENTH, ONE, TWO = 10, 5, 10


def keyed(documents: DataFrame) -> DataFrame:
    """row (all columns), doc and t: a document's place in the order, and what tells apart texts of equal ids."""
    return boxed(documents, doc=F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), t=F.xxhash64(F.coalesce("text", F.lit(""))))


def lines(documents: DataFrame, lead: int) -> DataFrame:
    """doc, t, line_no, leaf, key, fields, stretches of every line with tokens.

    ``key`` is a hash of the template, ``stretches`` one of each stretch, ``fields`` how many of them may differ.
    """
    spread = keyed(documents).select("doc", "t", F.posexplode(F.split("row.text", "\n", -1)).alias("line_no", "line"))

    def words(text: Column) -> Column:
        # most lines have no white space but spaces, and splitting at one character needs no pattern
        odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c"))
        return F.array_remove(F.when(odd, F.split(text, SPACE, -1)).otherwise(F.split(text, " ", -1)), "")

    cutup = spread.withColumn("plain", words(F.col("line"))).where(F.size("plain") > 0).withColumn("digits", F.col("line").rlike("[0-9]"))
    cutup = cutup.withColumn("marked", F.when(F.col("digits"), words(F.regexp_replace("line", FIELD, MARK))))
    many = F.size(F.filter("marked", lambda x: x == MARK)) * 2 > F.size("plain")
    found = cutup.withColumn("open", F.when(F.col("digits"), ~many).otherwise(F.lit(True)))
    found = found.select("doc", "t", "line_no", "open", F.size("plain").alias("n"), F.when(F.col("digits") & F.col("open"), F.col("marked")).otherwise(F.col("plain")).alias("tokens"))
    width = F.greatest(F.lit(1), F.floor(F.col("n") / TENTH).cast("int"))
    numbers = F.sequence(F.lit(0), F.ceil((F.col("n") - lead) / width).cast("int") - 1)
    stretches = F.transform(numbers, lambda k: F.hash(F.slice("tokens", k * width + (lead + 1), width)))
    fields = F.when(~F.col("open") | (F.col("n") < max(ONE, lead + 1)), 0).when(F.col("n") < TWO, 1).otherwise(2)
    return found.select(
        "doc", "t", "line_no", F.xxhash64("n", F.slice("tokens", 1, lead)).alias("leaf"), F.xxhash64("tokens").alias("key"),
        fields.cast("tinyint").alias("fields"), F.when(fields > 0, stretches).alias("stretches"),
    )


def maybe_in(leaves: DataFrame, bits: int = 20) -> Column:
    """A test on ``leaf`` that is true for all of ``leaves`` and, by a bitmap of 2 ** bits, for few others."""
    slot = F.pmod(F.col("leaf"), F.lit(1 << bits))
    words = leaves.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(leaf, {1 << bits}) % 64 as int))")).alias("x"))
    held = {r["w"]: r["x"] for r in words.collect()}  # at most 2 ** (bits - 6) rows
    bitmap = F.split(F.lit(",".join(str(held.get(w, 0)) for w in range(1 << (bits - 6)))), ",").cast("array<bigint>")
    return F.getbit(F.element_at(bitmap, (F.shiftright(slot, 6) + 1).cast("int")), (slot % 64).cast("int")) == 1


def nodes(marks: Column, fields: Column) -> Column:
    """Hashes of a template without each one or two of its stretches, from the marks (hashes with place) of all."""
    whole = F.aggregate(marks, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))
    one = F.transform(marks, lambda x, i: F.xxhash64(i, whole.bitwiseXOR(x)))

    def with_later(x: Column, i: Column) -> Column:
        return F.transform(F.slice(marks, i + 2, F.size(marks)), lambda y, j: F.xxhash64(i, j, whole.bitwiseXOR(x).bitwiseXOR(y)))

    return F.when(fields == 1, one).otherwise(F.flatten(F.transform(marks, with_later)))


def linked(found: DataFrame) -> DataFrame:
    """leaf, key, first: the earliest document with a template that is one with this, for templates that may have such."""
    crowded = found.where("fields > 0").groupBy("leaf").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b")
    templates = found.where("fields > 0").where(maybe_in(crowded)).groupBy("leaf", "key").agg(F.min("doc").alias("doc"), F.max("fields").alias("fields"), F.max("stretches").alias("stretches"))
    marked = templates.select("leaf", "key", "doc", "fields", F.transform("stretches", lambda x, k: F.xxhash64(k, x)).alias("marks"))
    marked = cut(marked)
    # two of three thirds may hold what differs, so the third one is shared
    edge = lambda k: F.floor(F.size("marks") * k / 3).cast("int")
    thirds = F.array(*[F.xxhash64(F.lit(k), F.slice("marks", edge(k) + 1, edge(k + 1) - edge(k))) for k in range(3)])
    filed = marked.select("leaf", "key", F.explode(thirds).alias("third"))
    shared = cut(filed.groupBy("leaf", "third").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    some = filed.join(shared, ["leaf", "third"]).select("leaf", "key").distinct()
    under = cut(dealt(marked.join(some, ["leaf", "key"]), "key").select("leaf", "key", "doc", F.explode(nodes(F.col("marks"), F.col("fields"))).alias("node")))
    firsts = cut(under.groupBy("leaf", "node").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return under.join(firsts, ["leaf", "node"]).groupBy("leaf", "key").agg(F.min("first").alias("first"))


def repeated_lines(documents: DataFrame, lead: int = 3) -> DataFrame:
    """doc, t, line_no of every line whose template an earlier document has."""
    found = cut(lines(documents, lead))
    templates = found.groupBy("leaf", "key").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"))
    met = templates.join(linked(found), ["leaf", "key"], "left")
    # only templates that some later document has
    owner = cut(met.select("leaf", "key", F.coalesce("first", "doc").alias("first"), "last").where("first < last").drop("last"))
    return found.join(owner, ["leaf", "key"]).where("doc > first").select("doc", "t", "line_no")


def dedup_lines(documents: DataFrame, counted: bool = True, **settings) -> DataFrame:
    """The documents without repeated lines; adds n_lines and n_dropped if ``counted``."""
    gone = repeated_lines(documents, **settings).groupBy("doc", "t").agg(F.collect_set("line_no").alias("gone"))
    met = keyed(documents).join(gone, ["doc", "t"], "left").select("row", "gone", F.split("row.text", "\n", -1).alias("lines"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(stays, lambda k: F.element_at("lines", k + 1)), "\n"))
    new = {"text": text}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.length(text).cast(documents.schema["n_chars"].dataType)
    if counted:
        new |= {"n_lines": F.coalesce(F.size("lines"), F.lit(0)), "n_dropped": F.coalesce(F.size("gone"), F.lit(0))}
    return unboxed(met, documents, **new)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


LINES_SQL = r"""
WITH spread AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
cutup AS (
  SELECT *, list_filter(regexp_split_to_array(line, '[\x20\x09\x0B-\x0D]+'), lambda x: x <> '') AS plain FROM spread),
marked AS (
  SELECT *, list_transform(plain, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m FROM cutup WHERE len(plain) > 0),
tokens AS (
  SELECT *, NOT regexp_matches(line, '[0-9]') OR len(list_filter(m, lambda x: x = '<*>')) * 2 <= len(plain) AS open FROM marked),
keyed AS (
  SELECT doc_id, line_no, open, CASE WHEN open THEN m ELSE plain END AS tokens FROM tokens),
t0 AS (
  SELECT tokens, open, len(tokens) AS n, tokens[1:3] AS lead, greatest(1, len(tokens) // 10) AS width,
    CASE WHEN NOT open OR len(tokens) < 5 THEN 0 WHEN len(tokens) < 10 THEN 1 ELSE 2 END AS fields, min(doc_id) AS born FROM keyed GROUP BY tokens, open),
pairs AS (
  SELECT a.tokens, a.open, b.born, a.fields,
    len(list_distinct(list_transform(list_filter(range(4, a.n + 1), lambda i: a.tokens[i] <> b.tokens[i]), lambda i: (i - 4) // a.width))) AS apart
  FROM t0 a JOIN t0 b ON a.n = b.n AND a.lead = b.lead WHERE b.fields = a.fields AND (a.fields > 0 OR a.tokens = b.tokens)),
firsts AS (SELECT tokens, open, min(born) AS first FROM pairs WHERE apart <= fields GROUP BY tokens, open),
gone AS (SELECT doc_id, line_no FROM keyed JOIN firsts USING (tokens, open) WHERE doc_id > first)
SELECT s.doc_id, count(*)::INT AS n_lines, count(gone.line_no)::INT AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY s.line_no) FILTER (WHERE gone.line_no IS NULL), '') AS text
FROM spread s LEFT JOIN gone ON s.doc_id = gone.doc_id AND s.line_no = gone.line_no GROUP BY s.doc_id
"""
