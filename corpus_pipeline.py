"""The training-data pipeline over ``documents``: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.

Edge cases, in every stage: null texts count as empty ones; empty tables pass through empty; columns beyond
those of documents pass through, whatever their names; rows with a null doc_id are kept unless they are toxic or
contaminated themselves; of rows that repeat a doc_id and its text the near-dedup keeps one (any, should other columns differ).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from quarryline.llm.common import CUTS, boxed, forget, removed, shared_folder, table, unboxed


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    return toxicity.scores(docs, table(spark, sf_dir, "labels"), keep=tuple(docs.columns)).where("score < 0.5").select("kept.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template an earlier document has; n_chars set anew. No document goes."""
    return line_dedup.dedup_lines(docs, counted=False)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One (doc_id, text), the smallest, of each group whose sets of five-word shingles link at a similarity of 0.8."""
    stays = simhash.near_copies(docs).where("component.doc_id = doc_id AND component.text_hash = text_hash").select("doc_id", "text_hash", F.lit(True).alias("stays"))
    hashed = boxed(docs, doc_id=F.col("doc_id").cast("long"), text_hash=F.xxhash64(F.coalesce("text", F.lit(""))))
    met = hashed.join(stays, ["doc_id", "text_hash"], "left").where("stays OR doc_id IS NULL")
    return unboxed(met.dropDuplicates(["doc_id", "text_hash"]), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of a benchmark item occurs."""
    found = decontaminate.contaminated_texts(docs, table(spark, sf_dir, "benchmark"))
    a, b = decontaminate.text_key()
    return unboxed(boxed(docs, a=a, b=b).join(found, ["a", "b"], "left_anti"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the sources' target shares and shuffled; adds copy and shuffle_key."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first stage learns a classifier, which SQL cannot express; tests hold run() against brute force, given that stage's scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what is between them is written to the shared folder, and only the last stage's rows stay there."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path, cuts = f"{folder}/{number}-{name}", len(CUTS)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        forget(spark, cuts)
        if before:
            removed(spark, before)
        before = path
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
