"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann, bpe, embed_dedup, jaccard, langid, licenses, mixing, pii, quality, substring
from millrace.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def vocabulary() -> str:
    """Place of the public vocabulary file that ``op1_bpe`` and the pipeline use; never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_register
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text of every document."""
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), vocabulary(), keep_ids=False, keep_text=False)


@_register
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document, by a factorisation machine learned from ``labels``."""
    documents = read_table(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit(documents, read_table(spark, sf_dir, "labels")))


@_register
def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, by nearest centroid."""
    documents = read_table(spark, sf_dir, "documents")
    return langid.predict(documents, langid.fit(documents))


@_register
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all sizes takes of every document; sources weigh 3, 1, 2, repeating."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), quality=mixing.text_quality())
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "epochs", "partial")


@_register
def op7_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9 or more."""
    return embed_dedup.link_vectors(read_table(spark, sf_dir, "embeddings"), 0.9)


@_register
def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all other vectors for each vector whose id is divisible by 50."""
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@_register
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard 0.75 or more over five-word shingles."""
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"))


@_register
def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of 35 words repeated anywhere cover, and what is left."""
    return substring.remove_repeats(read_table(spark, sf_dir, "documents"), 35, keep_text=False)


@_register
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    return licenses.scan(read_table(spark, sf_dir, "documents"))


SQL["op3_licenses"] = licenses.scan_sql()


@_register
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates for its personal data and secrets."""
    found = pii.replace_pii(read_table(spark, sf_dir, "documents"), pii.session_key(spark))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.size("entities").cast("long").alias("n_entities"), F.transform("entities", lambda e: e["type"]).alias("types"), "n_clashes", "n_repaired", "text")


_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op4_ngram_jaccard"] = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.c FROM reach r JOIN both_ways b ON b.x = r.v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN sizes USING (doc_id)
    JOIN (SELECT v AS doc_id, min(c) AS component_id FROM reach GROUP BY v) c USING (doc_id)"""

SQL["op7_embed_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(v, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.c FROM reach r JOIN links l ON l.x = r.v)
SELECT v AS vec_id, (SELECT count(*) FROM links WHERE x = v) AS n_links, min(c) AS component_id, v = min(c) AS kept FROM reach GROUP BY v"""

SQL["op10_substring"] = f"""
WITH words AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS k, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h FROM words WHERE len(w) >= 35),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS p FROM windows JOIN repeated USING (h)),
each_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each_word ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)"""
