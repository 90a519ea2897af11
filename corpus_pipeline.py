"""From raw documents to token ids, in five stages.

``STAGES`` lists (name, function) pairs; a function takes (spark, docs, sf_dir), docs being what the stage before it kept,
and returns a DataFrame: the columns of ``documents`` in all stages but the last. ``run`` applies them to the table
``documents``, each stage written as Parquet to the shared checkpoint folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, jaccard, mixing, pii, quality
from millrace.llm.common import broadcast_if_small, cut, delete_folder, ensure_checkpoint_dir, read_table, release
from millrace.llm.queries import vocabulary

#: No SQL: learned scores, keyed surrogates and BPE. The stages are held against brute force in tests/llm.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (fitted on the labelled ones among them) scores 0.7 or more. Null and empty texts
    are scored as others are; without labelled documents all score 0.5 and go; repeated rows stay or go together; an empty
    table stays empty; extra columns stay."""
    release(spark)
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")), 0.7)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id. Documents without an id stay, and so do
    those without words; rows that repeat id and text are one document, of which the least row by all columns stays; other
    rows of one id are documents of their own; an empty table stays empty; extra columns stay. What goes is found on
    numbers alone, and texts are read again and not shuffled where these are few."""
    release(spark)
    # an id may stand on different texts: rows are judged and dropped by a hash of both
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.col("text").isNull(), "text"))
    rows = docs.withColumn("__row", row)
    found = cut(jaccard.near_duplicates(rows, id_col="__row").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group")).where(F.col("__row").isNotNull()))
    groups = broadcast_if_small(cut(found.where(F.col("__row") != F.col("__group")).select("__group").distinct()))
    members = broadcast_if_small(cut(found.join(groups, "__group", "left_semi").distinct()))
    named = cut(rows.select("__row", "doc_id").join(members, "__row").distinct())
    first = named.groupBy("__group").agg(F.min(F.struct("doc_id", "__row")).alias("first")).select(F.col("first.__row").alias("__row"))
    doomed = broadcast_if_small(cut(named.select("__row").join(first, "__row", "left_anti")))
    repeated = broadcast_if_small(cut(found.groupBy("__row").count().where("count > 1").select("__row").join(doomed, "__row", "left_anti")))
    kept = rows.join(doomed, "__row", "left_anti")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    one = kept.join(repeated, "__row").groupBy("__row").agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("row"))
    return kept.join(repeated, "__row", "left_anti").select(docs.columns).unionByName(one.select("row.*"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for their entities, under the session's key; ``n_chars`` follows the new text. Null and
    empty texts, null ids, repeated rows and extra columns stay as they are; an empty table stays empty."""
    release(spark)
    found = pii.replace_pii(docs, pii.session_key(spark))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.size("entities") > 0, changed).otherwise(F.col("row.n_chars")))
    return found.select(row.alias("row")).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents once for each time that it takes them, the last of a source cut where its budget ends. Null and
    empty texts have no words and are not taken; null sources are one source; repeated rows are documents of their own; an
    empty table stays empty; extra columns stay, whatever their names."""
    release(spark)
    rows = docs.select("doc_id", "source", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return mixing.apply(mixing.mix(rows, quality=mixing.text_quality(), keep=("row",)), "row").select(docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of the text that they decode to. Null and empty texts have no
    tokens; repeated rows and null ids give rows of their own; an empty table stays empty; extra columns go."""
    release(spark)
    return bpe.encode_documents(docs, vocabulary(), keep_text=False)


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``. A stage's folder is deleted once the next one is written; the last one's
    is read by the result."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete_folder(spark, f"{folder}/{k - 1}")
    return docs
