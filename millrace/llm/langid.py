"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed byte bigrams and trigrams of its lower-cased letters, of length 1. Each language
has up to ``clusters`` centroids (spherical k-means of its learned vectors); a text takes the language of the nearest
centroid by cosine. A text that lies farther from its centroid than nearly all that the centroid was made of is
marked ``rejected``.

Fitting uses a bounded sample: about ``per_language`` texts of each of the ``max_languages`` most frequent languages, and
about ``max_rows`` in all, by a hash of the id, outside the held-out quarter (documented parameters; a text's vector is
``DIM`` numbers, so the driver gets 160 MB at most). Prediction covers every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import held_out, small_batches, text_bytes, text_chunks, tidy

DIM = 2048
UNDETERMINED = "und"
_LETTER = np.arange(256, dtype=np.uint32)
_LETTER[:97] = 32
_LETTER[123:128] = 32


@dataclass
class Centroids:
    idf: np.ndarray
    vectors: np.ndarray
    lang: list[str]
    reject_below: np.ndarray


def counts(col: pa.Array) -> np.ndarray:
    """n x DIM counts of hashed n-grams of the lower-cased texts; runs of other bytes than letters are one space."""
    n = len(col)
    data, offs = text_bytes(pc.utf8_lower(col))
    out = np.zeros(n * DIM, dtype=np.float32)
    if len(data) < 2:
        return out.reshape(n, DIM)
    b = _LETTER[data]
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offs))
    keep = np.ones(len(b), dtype=bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (doc[1:] != doc[:-1])
    b, doc = b[keep], doc[keep]
    for size, salt in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        if len(b) < size:
            continue
        code = b[: len(b) - size + 1].copy()
        for k in range(1, size):
            code = code * np.uint32(256) + b[k : len(b) - size + 1 + k]
        same = doc[: len(code)] == doc[size - 1 :]
        slot = ((code * np.uint32(salt)) >> np.uint32(21)).astype(np.int64)
        out += np.bincount((doc[: len(code)] * DIM + slot)[same], minlength=n * DIM).astype(np.float32)
    return out.reshape(n, DIM)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(tf) * idf)


def has_letter(col: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; the same rows give the same centroids."""
    centre = _unit(x.mean(axis=0, keepdims=True))
    near = x @ centre[0]
    seeds = [int(near.argmax())]
    while len(seeds) < min(k, len(x)):
        near = (x @ x[seeds].T).max(axis=1)
        seeds.append(int(near.argmin()))
    c = x[seeds].copy()
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        c = np.stack([_unit(x[home == j].mean(axis=0, keepdims=True))[0] if (home == j).any() else c[j] for j in range(len(c))])
    return c


def fit(df: DataFrame, clusters: int = 4, per_language: int = 600, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_languages: int = 1000, max_rows: int = 20_000) -> Centroids:
    """Centroids of every non-null language that has a learnable text (one with a letter), of the ``max_languages`` most
    frequent (ties: by name). Null ids, texts and languages are not learned from; repeated rows of an id are drawn
    together, up to twice a language's share; an empty table gives a model that knows no language."""
    small_batches(df.sparkSession)
    rows = df.select(df[id_col].alias("doc_id"), df[lang_col].cast("string").alias("lang"), df[text_col].alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    top = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    each = min(float(per_language), max_rows / max(1, len(langs := top.collect())))
    share = df.sparkSession.createDataFrame([(r["lang"], each / r["n"]) for r in langs], "lang string, share double")
    draw = (F.xxhash64("doc_id", F.lit("language sample")).bitwiseAND((1 << 40) - 1)) / float(1 << 40)
    sample = rows.join(F.broadcast(share), "lang").withColumn("draw", draw).where(F.col("draw") < F.col("share"))  # at most max_languages rows are broadcast
    # an id may stand on many rows, all drawn with it
    first = Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text"))
    sample = sample.withColumn("k", F.row_number().over(first)).where(F.col("k") <= math.ceil(2 * each)).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_chunks(batch, max_rows=256):
                part = batch.slice(i, j - i)
                part = part.filter(pa.array(has_letter(part.column("text"))))
                if part.num_rows:
                    tf = counts(part.column("text"))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("lang"), pa.array([x.tobytes() for x in tf], pa.binary())], names=["doc_id", "lang", "tf"])

    table = sample.mapInArrow(tidy(run), "doc_id long, lang string, tf binary").toArrow()
    lang = np.array(table["lang"].to_pylist(), dtype=object)
    if not len(lang):
        return Centroids(np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), [], np.zeros(0))
    tf = np.stack([np.frombuffer(x, np.float32) for x in table["tf"].to_pylist()])
    order = np.lexsort((tf.sum(axis=1), table["doc_id"].to_numpy(zero_copy_only=False)))
    tf, lang = tf[order], lang[order]
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x = vectors(tf, idf)
    out, names, reject = [], [], []
    for name in sorted(set(lang)):
        own = x[lang == name]
        c = _clusters(own, clusters)
        cos = own @ c.T
        home = cos.argmax(axis=1)
        for k in range(len(c)):
            out.append(c[k])
            names.append(name)
            reject.append(float(np.quantile(cos[home == k, k], 0.002)) * 0.8 if (home == k).any() else 0.0)
    return Centroids(idf, np.stack(out), names, np.array(reject))


def predict(df: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (cosine to the nearest centroid) and
    ``rejected``.

    ``und`` with score 0 for null texts and texts without a letter, and for all if no language was learned. Ties take
    the language that sorts first, and of its centroids the first. A null id is not held out. Extra columns are not carried; an empty table gives an
    empty table."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # clusters x languages x DIM floats
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.lang, UNDETERMINED], dtype=object)
        for batch in batches:
            for i, j in text_chunks(batch, max_rows=256):
                part = batch.slice(i, j - i)
                known = has_letter(part.column("text")) & bool(m.lang)
                cos = vectors(counts(part.column("text")), m.idf) @ m.vectors.T
                best = cos.argmax(axis=1) if m.lang else np.zeros(len(known), dtype=np.int64)
                score = np.clip(cos[np.arange(len(best)), best], 0, 1).astype(np.float64) if m.lang else np.zeros(len(known))
                far = score < m.reject_below[best] if m.lang else np.ones(len(known), dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names[np.where(known, best, len(names) - 1)], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(far | ~known)],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    found = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(tidy(run), schema)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
