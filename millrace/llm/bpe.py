"""BPE encoding and decoding of whole texts with a ready vocabulary whose words carry an end-of-word mark.

Method: contiguous rank array. A word's parts and the ranks of its adjacent pairs lie in two short rows; the smallest
rank is found by scanning, its boundary is deleted and the two neighbouring ranks are looked up anew. All unknown words of
some texts are rows of two matrices, and each step is taken for all of them at once with numpy. Words of more than
``SCAN_LIMIT`` parts take the same merges in the same order from a heap, because scanning is quadratic. The vocabulary file is read on the driver and broadcast as it is (its size is the vocabulary's, not the
data's); each task remembers the words it has met, up to ``CACHE_BYTES``, and of the older half those that come again. How texts are normalised and split is read from the
file too.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import chunks, column_function, small_batches, tidy

SCAN_LIMIT = 64
#: Words whose rows are worked on at once.
ROWS = 4096
#: Bytes that a task's remembered words may take, about.
CACHE_BYTES = 64 << 20
#: Words of more characters are not remembered.
CACHE_CHARS = 256
#: Bytes that a word takes in two tables beside its characters, about.
ENTRY_BYTES = 400
#: Ids are below 2^ID_BITS; a merge is one number, its rank before its id.
ID_BITS = 20
NO_RANK = 1 << 60

#: Texts of these characters only split and lower-case alike in every Unicode version.
_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-\\x9f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ſ‐-‧€]")
#: The classes of a splitting pattern and what they are in Python's regular expressions for such texts.
CLASSES = ((r"[^\s\p{L}\p{N}]", r"(?:[^\w\s]|_)"), (r"[\p{L}]", r"[^\W\d_]"), (r"[\p{N}]", r"\d"))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0x100
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class WordBpe:
    """Encoder and decoder for a vocabulary file of the ``tokenizers`` JSON format with an end-of-word suffix."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.pair = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pair[vocab[a], vocab[b]] = rank << ID_BITS | vocab[a + b]
        alphabet = byte_alphabet()
        self.first = np.array([vocab.get(c, -1) for c in alphabet])  # -1: no token, the byte is passed over
        self.last = np.array([vocab.get(c + self.suffix, -1) for c in alphabet])
        pairs = sorted((a << ID_BITS | b, found) for (a, b), found in self.pair.items())
        self.keys, self.found = np.array([k for k, _ in pairs] + [NO_RANK]), np.array([f for _, f in pairs] + [NO_RANK])
        self.name = {i: str(i) for i in self.token}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ids_of: dict[str, str] = {}
        self.text_of: dict[str, str] = {}
        self.old: tuple[dict[str, str], dict[str, str]] = {}, {}
        self.held = 0
        self._spec = {"normalizer": spec["normalizer"], "split": spec["pre_tokenizer"]["pretokenizers"][0]}
        pattern = self._spec["split"]["pattern"]["Regex"]
        for name, plain in CLASSES:
            pattern = pattern.replace(name, plain)
        self._split = re.compile(pattern).findall if r"\p" not in pattern else None
        self._library = None

    @classmethod
    def load(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def parts(self, word: bytes) -> list[int]:
        """The tokens of a word's bytes."""
        ids = self.first[np.frombuffer(word, np.uint8)]
        ids[-1] = self.last[word[-1]]
        return ids[ids >= 0].tolist()

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of each word."""
        out: list = [None] * len(words)
        sizes = np.array(list(map(len, words)))
        order = np.argsort(sizes, kind="stable")
        short = order[sizes[order] <= SCAN_LIMIT]
        for at in range(0, len(short), ROWS):
            some = short[at : at + ROWS]  # of like length
            for i, ids in zip(some.tolist(), self._rows([words[i] for i in some.tolist()])):
                out[i] = ids
        for i in order[len(short) :].tolist():
            out[i] = self._heap(self.parts(words[i]))
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What pairs of tokens merge to, rank before id; NO_RANK where they don't. No token is -1."""
        key = a << ID_BITS | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == key, self.found[np.minimum(at, len(self.found) - 1)], NO_RANK)

    def _rows(self, words: list[bytes]) -> list[list[int]]:
        n, width = len(words), max(map(len, words))
        size = np.array(list(map(len, words)))
        row = np.repeat(np.arange(n), size)
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(size) - 1
        ids = self.first[data]
        ids[end] = self.last[data[end]]
        column = np.arange(len(data)) - (end - size + 1)[row]
        if (ids < 0).any():  # bytes without a token
            row, column, ids = row[ids >= 0], (column - (np.cumsum(ids < 0) - np.append(0, np.cumsum(ids < 0))[(end - size + 1)[row]]))[ids >= 0], ids[ids >= 0]
        part = np.full((n, width + 1), -1)
        part[row, column] = ids
        rank = np.full((n, width + 1), NO_RANK)
        together = (part[:, :-1] >= 0) & (part[:, 1:] >= 0)
        rank[:, :-1][together] = self._ranks(part[:, :-1][together], part[:, 1:][together])
        out: list = [None] * n
        own = np.arange(n)
        while True:
            at = rank.argmin(axis=1)
            line = np.arange(len(own))
            best = rank[line, at]
            done = best == NO_RANK
            if done.any():
                for i, ids in zip(own[done].tolist(), part[done].tolist()):
                    out[i] = ids[: ids.index(-1)]
                live = ~done
                if not live.any():
                    return out
                own, part, rank, at, best = own[live], part[live], rank[live], at[live], best[live]
                line = np.arange(len(own))
            part[line, at] = best & ((1 << ID_BITS) - 1)
            here = np.arange(part.shape[1] - 1)
            part = np.take_along_axis(part, here + (here > at[:, None]), axis=1)
            rank = np.take_along_axis(rank, here + (here >= at[:, None]), axis=1)
            for left in (at - 1, at):
                known = (left >= 0) & (part[line, np.minimum(left + 1, part.shape[1] - 1)] >= 0) & (left + 1 < part.shape[1])
                i, j = line[known], left[known]
                rank[i, j] = self._ranks(part[i, j], part[i, j + 1])

    def _heap(self, parts: list[int]) -> list[int]:
        pair, n = self.pair, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pair[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in pair]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := pair.get((parts[i], parts[j]))) is not None:
                heapq.heappush(heap, (found, i, parts[i], parts[j]))

        while heap:
            found, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = found & ((1 << ID_BITS) - 1), None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def words(self, text: str) -> list[str]:
        """The words of a text after its normalisation. Texts with characters whose class or lower case depends on the
        Unicode version are normalised and split by the library's own tables."""
        if self._split is not None and not _PLAIN.search(text):
            return self._split(text.lower())
        if self._library is None:
            self._library = _library_splitter(self._spec)
        normalizer, split = self._library
        return [w for w, _ in split.pre_tokenize_str(normalizer.normalize_str(text))]

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or "<" not in text:
            return self.words(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                out.append(part + "\0")  # no word holds a NUL beside other characters of a special token
            elif part:
                out.extend(self.words(part))
        return out

    def _learn(self, words: set[str]) -> None:
        ids_of, text_of, token, name = self.ids_of, self.text_of, self.token, self.name
        old_ids, old_text = self.old
        new = []
        for w in words.difference(ids_of):
            if w in old_ids:
                ids_of[w], text_of[w] = old_ids[w], old_text[w]
            else:
                new.append(w)
            self.held += ENTRY_BYTES + 12 * len(w)
        plain = [w for w in new if w[-1] != "\0" or w[:-1] not in self.special]
        for w, ids in zip(plain, self.merge([w.encode() for w in plain])):
            ids_of[w] = " ".join([name[i] for i in ids])
            text_of[w] = " ".join([token[i] for i in ids])
        for w in set(new).difference(plain):
            ids_of[w], text_of[w] = name[self.special[w[:-1]]], w[:-1]

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in next(self.encode_texts([text]))[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder: tokens are joined by one space, ends of words keep their mark."""
        return " ".join([self.token[i] for i in ids])

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids joined by one space, decoded text) of each text."""
        pieces = list(map(self.pieces, texts))
        unknown = set().union(*pieces)
        self._learn(unknown)
        ids_of, text_of = self.ids_of.__getitem__, self.text_of.__getitem__
        for words in pieces:
            yield " ".join(map(ids_of, words)), " ".join(map(text_of, words))
        for w in unknown:
            if len(w) > CACHE_CHARS:
                del self.ids_of[w], self.text_of[w]
                self.held -= ENTRY_BYTES + 12 * len(w)
        if self.held > CACHE_BYTES // 2:
            self.old = self.ids_of, self.text_of
            self.ids_of, self.text_of, self.held = {}, {}, 0


def _library_splitter(spec: dict):
    """The library's own normaliser and splitter of a vocabulary file, without its merges."""
    from tokenizers import Tokenizer

    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "vocab": {}, "merges": []}
    bare = Tokenizer.from_str(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": spec["normalizer"], "pre_tokenizer": spec["split"], "post_processor": None, "decoder": None, "model": model}))
    return bare.normalizer, bare.pre_tokenizer


def encode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """One row per input row: the id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if wanted, ``token_ids``
    (array<int>) and ``decoded``.

    Nulls and empty texts have no tokens (the hashes are those of the empty string); repeated rows give repeated
    results; an empty table gives an empty table; other columns, whatever their names, are not carried. ``vocabulary``
    is read on the driver.
    """
    spark = df.sparkSession
    small_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    fields = [T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))
    if keep_text:
        fields.append(T.StructField("decoded", T.StringType()))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(json.loads(spec.value))
        for batch in batches:
            texts = batch.column(1)
            for at, to in chunks(texts, max_rows=256):
                n, a, b, ids, decoded = [], [], [], [], []
                for i, d in bpe.encode_texts([t or "" for t in texts.slice(at, to - at).to_pylist()]):
                    n.append(i.count(" ") + 1 if i else 0)
                    a.append(hashlib.sha256(i.encode()).hexdigest())
                    b.append(hashlib.sha256(d.encode()).hexdigest())
                    if keep_ids:
                        ids.append([int(x) for x in i.split()])
                    if keep_text:
                        decoded.append(d)
                cols = [batch.column(0).slice(at, to - at), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                if keep_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                if keep_text:
                    cols.append(pa.array(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(tidy(run), T.StructType(fields))


def decode_ids(df: DataFrame, vocabulary: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Add the decoded text of an array<int> column. A null array gives null, an empty one the empty string; an id
    outside the vocabulary is passed over; repeated rows are decoded alike; an empty table stays empty; a column that is
    called like ``out_col`` is an error."""
    if out_col in df.columns:
        raise ValueError(f"there is a column {out_col} already")
    with open(vocabulary, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = WordBpe(json.loads(spec.value))
        for ids in columns:
            yield pa.array([None if x is None else bpe.decode([i for i in x if i in bpe.token]) for x in ids.to_pylist()], pa.string())

    return df.withColumn(out_col, column_function(decode, "string")(F.col(ids_col)))
