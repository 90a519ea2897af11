"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

The pairwise term is computed in time linear in a document's features by the sum-of-squares identity. Features of a
text are computed for whole Arrow batches with numpy: one hashed bucket per distinct word, one bin per structure
statistic (letter case, symbols, repetition of words, lines and trigrams, lengths), one bin for the metadata column
``n_chars``. Language, source and ids are never features.

Fitting: labelled documents outside the held-out quarter, at most ``max_rows`` of them and ``max_features`` features in
all, by order of a hash of the id (documented parameters; they bound what the driver gets, 8 bytes a feature), are
turned into sparse features on the executors and fitted on the driver by AdaGrad. Scoring covers every whole text; only
the text and one number of a row go to Python, and one number comes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import LOWER, U64, chunks, column_function, cut, gram_hashes, held_out, mix, small_batches, text_bytes, text_chunks, tidy, word_hashes, word_spans

BUCKETS = 1 << 15
BINS = 24
RATIOS = ("upper", "symbol", "bang", "bar", "digit", "distinct", "adjacent", "top_word", "gram_distinct", "line_distinct", "no_letter")
SIZES = ("words", "word_length", "line_length", "n_chars")
FEATURES = BUCKETS + BINS * (len(RATIOS) + len(SIZES))
FACTORS = 8

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SYMBOL = np.isin(_BYTES, [ord(c) for c in "#$%&*+/<=>@[]^_`{|}~!\\"])


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, rows: np.ndarray, idx: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
        """Scores of n documents from their features, sorted by document."""
        x = val.astype(np.float64)
        z = self.bias + np.bincount(rows, self.linear[idx] * x, minlength=n)
        for f in range(self.factors.shape[1]):
            vx = self.factors[idx, f] * x
            s = np.bincount(rows, vx, minlength=n)
            z += 0.5 * (s * s - np.bincount(rows, vx * vx, minlength=n))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _per_doc(flag: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, dtype=np.int64)
    np.cumsum(flag, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first place, count) of each distinct hash of a document, sorted by document."""
    key = mix(h + doc.astype(U64) * U64(0xD1342543DE82EF95))
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(doc[first], kind="stable")
    return doc[first][order], first[order], count[order]


def features(col: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) arrays, sorted by document. Empty texts have their bins alone."""
    data, offs = text_bytes(col)
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1)
    s, e, doc = word_spans(data, offs)
    n_words = np.bincount(doc, minlength=n)
    safe = np.maximum(n_words, 1)
    h = word_hashes(LOWER[data], s, e)
    wdoc, wfirst, wcount = _distinct(doc, h, n)
    n_distinct = np.bincount(wdoc, minlength=n)
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, wdoc, wcount)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    grams = gram_hashes(h, 3)
    inside = doc[2:] == doc[:-2]
    gdoc = doc[: len(grams)][inside]
    n_grams = np.bincount(gdoc, minlength=n)
    distinct_grams = np.bincount(_distinct(gdoc, grams[inside], n)[0], minlength=n)
    breaks = data == 10
    edges = np.unique(np.concatenate([offs, np.flatnonzero(breaks) + 1]))
    ls, le = edges[:-1], edges[1:]
    ldoc = np.searchsorted(offs, ls, side="right") - 1
    n_lines = np.bincount(ldoc, minlength=n)
    distinct_lines = np.bincount(_distinct(ldoc, word_hashes(data, ls, le), n)[0], minlength=n)
    letters = _per_doc(_LETTER[data], offs)
    no_letter = np.bincount(doc[_per_doc(_LETTER[data], np.append(s, len(data)))[: len(s)] == 0] if len(s) else doc, minlength=n)
    ratios = {
        "upper": _per_doc(_UPPER[data], offs) / np.maximum(letters, 1),
        "symbol": 4 * _per_doc(_SYMBOL[data], offs) / size,
        "bang": 4 * _per_doc(data == 33, offs) / size,
        "bar": 4 * _per_doc(data == 124, offs) / size,
        "digit": 2 * _per_doc(_DIGIT[data], offs) / size,
        "distinct": n_distinct / safe,
        "adjacent": 2 * np.bincount(doc[same], minlength=n) / safe,
        "top_word": 2 * top / safe,
        "gram_distinct": np.where(n_grams > 0, distinct_grams / np.maximum(n_grams, 1), 1),
        "line_distinct": np.where(n_lines > 0, distinct_lines / np.maximum(n_lines, 1), 1),
        "no_letter": no_letter / safe,
    }
    sizes = {"words": n_words, "word_length": (e - s).sum() and np.bincount(doc, e - s, minlength=n) ** 2 / safe**2, "line_length": size / np.maximum(n_lines, 1), "n_chars": n_chars}
    bins = [np.minimum(np.ceil(np.clip(ratios[k], 0, 1) * (BINS - 2)), BINS - 1) for k in RATIOS]
    bins += [np.clip(np.floor(np.log2(np.broadcast_to(sizes[k], n) + 1) + 1), 0, BINS - 1) for k in SIZES]
    stat = np.stack(bins, axis=1).astype(np.int64) + BUCKETS + BINS * np.arange(len(bins)) if n else np.zeros((0, len(bins)), dtype=np.int64)
    rows = np.concatenate([np.repeat(np.arange(n), len(bins)), wdoc])
    idx = np.concatenate([stat.ravel(), (h[wfirst] >> U64(49)).astype(np.int64)])
    val = np.concatenate([np.full(stat.size, 0.5), 1.0 / np.sqrt(np.maximum(n_distinct, 1))[wdoc]])
    order = np.argsort(rows, kind="stable")
    return rows[order], idx[order].astype(np.int32), val[order].astype(np.float32)


def _inputs(df: DataFrame, id_col: str, text_col: str) -> list:
    """The text and the metadata column; ``n_chars`` is taken as absent where it is no number."""
    meta = F.lit(None).cast("double")
    if "n_chars" in df.columns and isinstance(df.schema["n_chars"].dataType, T.NumericType):
        meta = df["n_chars"].cast("double")
    return [df[id_col].alias("doc_id"), df[text_col].alias("text"), F.coalesce(F.when(meta >= 0, meta), F.lit(0.0)).alias("n_chars")]


def fit(df: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 8000, epochs: int = 12, seed: int = 7, text_col: str = "text", max_features: int = 4_000_000) -> Model:
    """Fit on at most ``max_rows`` labelled documents outside the held-out quarter, as many as have ``max_features`` features
    together. Of an id's repeated labels the largest counts, of its repeated rows one, that with the least features; null
    ids, labels and texts are not learned from. Without any such row, as from empty tables, the model scores everything 0.5."""
    small_batches(df.sparkSession)
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(label_col).cast("double").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = df.select(*_inputs(df, "doc_id", text_col)).where(F.col("text").isNotNull() & ~held_out("doc_id")).join(F.broadcast(chosen), "doc_id")  # at most max_rows rows are broadcast
    schema = "doc_id long, label double, idx array<int>, val array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_chunks(batch, "text"):
                part = batch.slice(i, j - i)
                r, idx, val = features(part.column("text"), part.column("n_chars").to_numpy(zero_copy_only=False))
                ends = np.searchsorted(r, np.arange(j - i + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (idx, val)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("__label"), *lists], names=["doc_id", "label", "idx", "val"])

    found = rows.select("doc_id", "text", "n_chars", "__label").mapInArrow(tidy(run), schema)
    one = found.groupBy("doc_id").agg(F.min(F.struct("label", F.size("idx").alias("n"), "idx", "val")).alias("f"))
    one = cut(one.select(F.struct(F.xxhash64("doc_id").alias("hash"), "doc_id").alias("at"), "f.*"))
    sizes = sorted((tuple(r["at"]), r["n"]) for r in one.select("at", "n").collect())  # at most max_rows
    fits = int(np.searchsorted(np.cumsum([n for _, n in sizes]), max_features, side="right"))
    if fits < len(sizes):
        hash_, doc_id = sizes[fits][0]
        one = one.where(F.col("at") < F.struct(F.lit(hash_).alias("hash"), F.lit(doc_id).cast("long").alias("doc_id")))
    table = one.select("at.doc_id", "label", "idx", "val").toArrow()
    return _train(table.take(np.argsort(table["doc_id"].to_numpy())) if table.num_rows else table, epochs, seed)


def _train(table: pa.Table, epochs: int, seed: int, rate: float = 0.08, decay: float = 2e-5, batch: int = 64) -> Model:
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, FACTORS)), 0.0
    y = table["label"].to_numpy()
    n = len(y)
    if n == 0:
        return Model(0.0, w, v * 0)
    y = (y > 0).astype(np.float64)
    lists = table["idx"].combine_chunks()
    ends, idx_all, val_all = lists.offsets.to_numpy(), lists.values.to_numpy(), table["val"].combine_chunks().values.to_numpy().astype(np.float64)
    gw, gv, gb = np.full(FEATURES, 1e-2), np.full((FEATURES, FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            docs = order[at : at + batch]
            places = np.concatenate([np.arange(ends[d], ends[d + 1]) for d in docs])
            rows = np.repeat(np.arange(len(docs)), [ends[d + 1] - ends[d] for d in docs])
            idx, x = idx_all[places], val_all[places]
            vx = v[idx] * x[:, None]
            starts = np.searchsorted(rows, np.arange(len(docs)))
            s = np.add.reduceat(vx, starts)
            z = bias + np.bincount(rows, w[idx] * x, minlength=len(docs)) + 0.5 * (s * s - np.add.reduceat(vx * vx, starts)).sum(axis=1)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs]
            gb += (g.mean()) ** 2
            bias -= rate * g.mean() / np.sqrt(gb)
            gx = (g[rows] * x)[:, None]
            grad = np.concatenate([gx, gx * (s[rows] - vx)], axis=1)
            order_i = np.argsort(idx, kind="stable")
            u, first = np.unique(idx[order_i], return_index=True)
            grad = np.add.reduceat(grad[order_i], first) / len(docs)
            dw, dv = grad[:, 0] + decay * w[u], grad[:, 1:] + decay * v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            w[u] -= rate * dw / np.sqrt(gw[u])
            v[u] -= rate * dv / np.sqrt(gv[u])
    return Model(float(bias), w.astype(np.float32), v.astype(np.float32))


def _scorer(df: DataFrame, model: Model):
    """A column function of (text, n_chars): the model's score."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # FEATURES x (FACTORS + 1) floats, whatever the data

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = shared.value
        for text, size in columns:
            parts = []
            for i, j in chunks(text):
                r, idx, val = features(text.slice(i, j - i), size.slice(i, j - i).to_numpy(zero_copy_only=False))
                parts.append(m.score(r, idx, val, j - i))
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return column_function(run, T.DoubleType())


def score(df: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold).

    Null texts count as empty, which have a score too; a null id is not held out; repeated rows are scored alike; an empty
    table gives an empty table; other columns, whatever their names, are not carried."""
    doc_id, text, n_chars = _inputs(df, id_col, text_col)
    scored = df.select(doc_id, _scorer(df, model)(text, n_chars).alias("score"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(df: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns as they were, whose text scores ``threshold`` or more. Null and empty texts have
    a score as others have; null ids and columns of any name are carried; repeated rows stay or go together; an empty
    table gives an empty table."""
    _, text, n_chars = _inputs(df, text_col, text_col)
    return df.where(_scorer(df, model)(text, n_chars) >= threshold)
