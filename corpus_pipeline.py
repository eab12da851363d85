"""Corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

Every stage but the last returns the columns of ``documents``; ``n_chars`` follows the text.  Other
columns of the input, whatever their names, are not read.  Null and empty texts, texts of any length,
rows that repeat an id or lack one, and empty tables pass through all stages as each states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, decontaminate, langid, pii, simhash
from brindle.llm.common import folders_made, new_folder, release, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose language is less sure than this are rejected, as are those without a letter.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with some certainty.

    Null and empty texts and those without a letter have no language and go; repeated rows are
    judged alike; a null id is no obstacle; texts are read to their end.
    """
    judged = langid.predict(docs, langid.fit(docs), COLUMNS)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: that of the smallest id.

    A group is linked by a cosine of the sets of five-word shingles of 0.8 or more, or by
    fingerprints within the radius.  Texts without words are alike.  Of rows that repeat an id, and
    of rows without one, each text stays once.  Groups and texts of any size are compared in pieces.
    """
    folder = new_folder(spark, "groups")
    simhash.similar_groups(docs).where("doc_id != group_id").select(F.col("doc_id").alias("copy_id")).distinct().write.parquet(f"{folder}/copies")
    docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("many_id")).write.parquet(f"{folder}/repeated")
    kept = docs.select(*COLUMNS).join(spark.read.parquet(f"{folder}/copies"), F.col("doc_id") == F.col("copy_id"), "left_anti")
    # Only rows of repeated ids are shuffled with their texts.
    repeated = spark.read.parquet(f"{folder}/repeated")
    same = F.col("doc_id").eqNullSafe(F.col("many_id"))
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none; rows that repeat an id go if one of them holds an item, those
    without an id likewise.
    """
    folder = new_folder(spark, "contaminated")
    decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("bad_id")).distinct().write.parquet(folder)
    bad = spark.read.parquet(folder)
    return docs.select(*COLUMNS).join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti")


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets.

    Null text becomes empty; repeated rows are redacted alike; no row goes.
    """
    clean = pii.redact(docs, [c for c in COLUMNS if c != "text"], pii.trained(spark))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the kept, redacted texts, row by row; empty texts have no token."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminated), ("PII", redacted), ("BPE", tokens)]

#: Learned models and iterated components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written and read again; then what it and its predecessor left in the shared folder goes."""
    mark = folders_made()
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        folder = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        release(spark, mark, folder)
    return docs
