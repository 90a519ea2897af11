"""Exact substring dedup: words covered by a window of ``length`` words that also starts elsewhere are removed.

Matching statistics come from suffix automata of reference shards. The reference is the corpus itself, so shards are cut
so that a window and its repeats always fall into the same one:

1. A window's anchor is the least-hashed of the k-grams in it (k about half the window), which equal windows share.
   Runs of windows with the same anchor are one piece of text. Anchors are counted over all documents; pieces whose
   anchor occurs once hold no repeated window and end there.
2. The remaining pieces go to their anchor's shard. A shard builds the suffix automaton of an anchor's distinct pieces, with
   the number of occurrences in each state, and streams every piece through it: a window repeats when the state that
   holds its last ``length`` words occurs twice or more.
3. Windows found go back to their texts, where the union of the windows is removed.

A shard holds one anchor's pieces at a time. The shard of an anchor of more than ``HOT`` occurrences (a passage in a third of
all documents) is split: each of its windows goes to a shard of its own, as a 128-bit BLAKE2b digest of its text. What a task
has met twice by itself is settled there and sent on once. Texts are known by 64-bit hashes that are checked by a second one.

``windows_by_broadcast`` is the plain form of the method: automata of reference shards of bounded size, broadcast one after
another, all documents streamed through each. It gives the same windows, but reads the corpus once for every shard, and the
shards grow with the corpus; the README has its figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import U64, as_long, cut, gram_hashes, mix, shuffle_partitions, small_batches, text_bytes, text_chunks, tidy, word_hashes, word_spans

LENGTH = 35
#: Texts that share their hash by chance at most: 10^10 have about three.
MAX_CLASHES = 100_000
#: Occurrences over which an anchor's shard is split by windows; a quarter of it within one task's gathered documents.
HOT = 256
#: Anchor occurrences that a task gathers before it settles what repeats among them.
GATHER = 200_000


#: Bytes of a window's digest, and what stands before it: no text of words joined by blanks starts so.
DIGEST, MARK = 16, b" "
MASK = (1 << 60) - 1


class Automaton:
    """Suffix automaton of several sequences, with the number of occurrences of each state's substrings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.count = [0]

    def add(self, sequence, weight: int) -> None:
        nxt, link, length, count = self.next, self.link, self.len, self.count
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                count[last] += weight
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                count.append(weight)
                link.append(0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
                last = cur
            else:
                last = self._clone(last, q, c)
                count[last] += weight

    def _clone(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        self.count.append(0)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def close(self) -> None:
        """Add the occurrences of longer substrings to their suffixes."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]

    def repeats(self, sequence, length: int, times: int = 2) -> int:
        """Bit i is set if the window of ``length`` from i occurs ``times`` times or more."""
        nxt, link, lens = self.next, self.link, self.len
        mask, v, at = 0, 0, 0
        for i, c in enumerate(sequence):
            while v and c not in nxt[v]:
                v = link[v]
                at = lens[v]
            if c in nxt[v]:
                v = nxt[v][c]
                at += 1
            if at >= length:
                while lens[link[v]] >= length:
                    v = link[v]
                    at = lens[v]
                if self.count[v] >= times:
                    mask |= 1 << (i + 1 - length)
        return mask


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value of every run of ``width`` values."""
    at, have = np.arange(len(v)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(v[b] < v[a], b, a)
        have += step
    return at


class Pieces:
    """The words of concatenated texts and the runs of their windows by anchor."""

    def __init__(self, col: pa.Array, length: int):
        self.data, self.offs = text_bytes(col)
        self.s, self.e, self.doc = word_spans(self.data, self.offs)
        k = length // 2 + 1
        self.words = word_hashes(self.data, self.s, self.e)
        n = len(self.words) - length + 1
        empty = np.zeros(0, dtype=np.int64)
        self.first, self.last, self.anchor, self.owner = empty, empty, np.zeros(0, U64), empty
        if n <= 0:
            return
        valid = np.flatnonzero(self.doc[:n] == self.doc[length - 1 :])
        if not len(valid):
            return
        grams = gram_hashes(self.words, k)
        at = _least(mix(grams + U64(0x77)), length - k + 1)[valid]
        new = np.ones(len(valid), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)
        self.first = valid[new]
        self.last = valid[np.append(np.flatnonzero(new)[1:], len(valid)) - 1]
        self.anchor = grams[at[new]]
        self.owner = self.doc[self.first]


def _member(h: np.ndarray, of: np.ndarray, lists: list, n: int) -> np.ndarray:
    """Whether the hash h of document ``of`` is in that document's list."""
    sizes = [len(x) if x is not None else 0 for x in lists]
    if not sum(sizes):
        return np.zeros(len(h), dtype=bool)
    known = np.concatenate([np.array(x, dtype=np.int64).view(U64) for x in lists if x])
    salt = mix(np.arange(n, dtype=U64))
    return np.isin(mix(h + salt[of]), mix(known + salt[np.repeat(np.arange(n), sizes)]))


def repeated_anchors(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(tid, anchors, hot_anchors): the anchors of each text that occur twice or more; hot ones apart."""
    parts = shuffle_partitions(texts.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, tids, held = [], [], 0

        def flush():
            h, tid = np.concatenate(hs), np.concatenate(tids)
            order = np.argsort(h, kind="stable")
            h, tid = h[order], tid[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[1:] != h[:-1]
            group = np.cumsum(new) - 1
            hot = np.bincount(group)[group] > HOT // 4
            settled = np.unique(np.stack([tid, h.view(np.int64)], axis=1)[hot], axis=0)
            stay = ~hot | new
            key = np.concatenate([h[stay], mix(settled[:, 0].view(U64) + settled[:, 1].view(U64))])
            n = int(stay.sum())
            return pa.RecordBatch.from_arrays(
                [as_long(key), pa.array(np.concatenate([tid[stay], settled[:, 0]])), pa.array(np.concatenate([np.where(hot[stay], 2, 1), np.full(len(settled), 3)]).astype(np.int8)), pa.array(np.concatenate([np.zeros(n, np.int64), settled[:, 1]]))],
                names=["h", "tid", "kind", "settled"],
            )

        for batch in batches:
            for i, j in text_chunks(batch):
                part = batch.slice(i, j - i)
                p = Pieces(part.column("text"), length)
                hs.append(p.anchor)
                tids.append(part.column("tid").to_numpy()[p.owner])
                held += len(p.anchor)
                if held > GATHER:
                    yield flush()
                    hs, tids, held = [], [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by h. An anchor's first rows wait until it is known whether it is hot: at most HOT of them."""
        wait_h, wait, over, hot = None, [], 0, False

        for batch in batches:
            h, tid, kind = batch.column("h").to_numpy(), batch.column("tid").to_numpy(), batch.column("kind").to_numpy()
            given = kind == 3
            out = [(tid[given], batch.column("settled").to_numpy()[given], np.ones(int(given.sum()), bool))]
            h, tid, kind = h[~given], tid[~given], kind[~given]
            if len(h):
                edges = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                size = np.diff(np.append(edges, len(h)))
                flagged = np.maximum.reduceat(kind, edges) == 2
                plain = np.ones(len(edges), dtype=bool)
                plain[-1] = False  # may go on in the next batch
                if h[0] == wait_h:
                    plain[0] = False
                many = plain & (size > 1)
                sel = np.repeat(many, size)
                out.append((tid[sel], h[sel], np.repeat(((size > HOT) | flagged)[many], size[many])))
                # flagged anchors that stand alone are hot all the same; their own rows are settled already
                for g in np.flatnonzero(~plain):
                    a, b = edges[g], edges[g] + size[g]
                    if h[a] != wait_h:
                        if wait_h is not None and over > 1:
                            out.append((np.concatenate(wait), np.full(sum(map(len, wait)), wait_h), np.full(sum(map(len, wait)), hot)))
                        wait_h, wait, over, hot = h[a], [], 0, False
                    over += b - a
                    hot |= bool(flagged[g])
                    wait.append(tid[a:b])
                    if over > HOT or hot:
                        hot = True
                        if over > 1:
                            out.append((np.concatenate(wait), np.full(sum(map(len, wait)), wait_h), np.ones(sum(map(len, wait)), bool)))
                            wait = [np.zeros(0, np.int64)]
            t, a, b = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(a), pa.array(b)], names=["tid", "h", "hot"])
        if wait_h is not None and over > 1:
            n = sum(map(len, wait))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(wait)), pa.array(np.full(n, wait_h)), pa.array(np.full(n, hot))], names=["tid", "h", "hot"])

    rows = texts.select("tid", "text").mapInArrow(tidy(gather), "h long, tid long, kind byte, settled long")
    met = rows.repartition(parts, "h").sortWithinPartitions("h", F.desc("kind")).mapInArrow(tidy(meet), "tid long, h long, hot boolean")
    return met.groupBy("tid").agg(F.collect_set(F.when(~F.col("hot"), F.col("h"))).alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot_anchors"))


def repeated_windows(texts: DataFrame, anchors: DataFrame, length: int = LENGTH) -> DataFrame:
    """(tid, start, mask): bit i of mask says that the window from word start + i of the text also starts elsewhere."""
    parts = shuffle_partitions(texts.sparkSession)
    schema = "h long, content binary, tid long, start long, mask long, multi boolean"
    names = ["h", "content", "tid", "start", "mask", "multi"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        held = 0

        def flush():
            cols = [[], [], [], [], [], []]
            for (h, content), members in seen.items():
                multi = len(members) > 1
                tid, start, n = members[0]
                for c, x in zip(cols, (h, content, None if multi else tid, None if multi else start, None, multi)):
                    c.append(x)
                if multi:
                    for tid, start, n in {m[:2]: m for m in members}.values():
                        for c, x in zip(cols, ((tid * 31 + start) % (1 << 62), None, tid, start, (1 << n) - 1, False)):
                            c.append(x)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

        for batch in batches:
            for i, j in text_chunks(batch):
                part = batch.slice(i, j - i)
                p = Pieces(part.column("text"), length)
                if not len(p.anchor):
                    continue
                tids = part.column("tid").to_numpy()
                base = np.searchsorted(p.doc, np.arange(j - i))
                cold = _member(p.anchor, p.owner, part.column("anchors").to_pylist(), j - i)
                hot = _member(p.anchor, p.owner, part.column("hot_anchors").to_pylist(), j - i) & ~cold
                raw = p.data.tobytes()
                h = p.anchor.view(np.int64)
                for a, b, o, x in zip(p.first[cold].tolist(), p.last[cold].tolist(), p.owner[cold].tolist(), h[cold].tolist()):
                    content = b" ".join(raw[p.s[a] : p.e[b + length - 1]].split())
                    seen.setdefault((x, content), []).append((int(tids[o]), a - int(base[o]), b - a + 1))
                held += int(cold.sum())
                if hot.any():
                    n = (p.last - p.first + 1)[hot]
                    starts = np.repeat(p.first[hot] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    owner = np.repeat(p.owner[hot], n)
                    for st, o in zip(starts.tolist(), owner.tolist()):
                        digest = hashlib.blake2b(b" ".join(raw[p.s[st] : p.e[st + length - 1]].split()), digest_size=DIGEST).digest()
                        seen.setdefault((int.from_bytes(digest[:8], "little", signed=True), MARK + digest), []).append((int(tids[o]), st - int(base[o]), 1))
                    held += len(starts)
                if held > GATHER:
                    yield flush()
                    seen.clear()
                    held = 0
        if seen:
            yield flush()

    def shard(group: dict) -> Iterator[tuple[int, int, int]]:
        """One anchor's pieces: content -> [occurrences at least, members]."""
        texts = {c: c.split(b" ") for c in group if not c.startswith(MARK)}
        for content, (n, members) in group.items():
            if n > 1:
                windows = len(texts[content]) - length + 1 if content in texts else 1
                for tid, start in members:
                    yield tid, start, (1 << windows) - 1
        alone = [c for c in texts if group[c][0] == 1 and group[c][1]]
        if alone and len(texts) > 1:
            automaton = Automaton()
            for c, words in texts.items():
                automaton.add(words, min(group[c][0], 2))
            automaton.close()
            for c in alone:
                if mask := automaton.repeats(texts[c], length):
                    for tid, start in group[c][1]:
                        yield tid, start, mask

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, found = None, {}, []

        def out():
            cols = list(zip(*found)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["tid", "start", "mask"])

        for batch in batches:
            for h, content, tid, start, mask, multi in zip(*(batch.column(c).to_pylist() for c in names)):
                if mask is not None:
                    found.append((tid, start, mask))
                    continue
                if h != at:
                    found.extend(shard(group))
                    at, group = h, {}
                entry = group.setdefault(content, [0, []])
                entry[0] += 2 if multi else 1
                if not multi:
                    entry[1].append((tid, start))
            if len(found) > 10_000:
                yield out()
                found = []
        found.extend(shard(group))
        yield out()

    joined = texts.join(anchors, "tid")
    rows = joined.select("doc_id", "tid", "text", "anchors", "hot_anchors").mapInArrow(tidy(pieces), schema)
    return rows.repartition(parts, "h").sortWithinPartitions("h", "content").mapInArrow(tidy(match), "tid long, start long, mask long")


def windows_by_broadcast(texts: DataFrame, length: int = LENGTH, shard_words: int = 200_000) -> DataFrame:
    """The same as ``repeated_windows`` for (tid, text) rows, by the plain method: distinct texts are dealt to reference shards of
    about ``shard_words`` words; a shard's automaton is built on the driver and broadcast, and all distinct texts are streamed
    through it. A window repeats when it occurs once in a shard that its text is not in, or twice in its own."""
    spark = texts.sparkSession
    distinct = cut(texts.groupBy("tid").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("rows")).withColumn("n", F.size(F.split("text", r"[\x20\x09-\x0D]+"))).where(F.col("n") >= length))
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_words))
    found = None
    for k in range(shards):
        own = distinct.where(F.pmod("tid", F.lit(shards)) == k).select("tid", "text", "rows").collect()  # about shard_words words
        automaton = Automaton()
        for r in own:
            automaton.add(r["text"].encode().split(), r["rows"])
        automaton.close()
        shared = spark.sparkContext.broadcast((automaton, shards, k))

        def stream(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton, shards, k = shared.value
            for batch in batches:
                rows = []
                for tid, text in zip(batch.column("tid").to_pylist(), batch.column("text")):
                    mask = automaton.repeats(text.as_buffer().to_pybytes().split(), length, 2 if tid % shards == k else 1)
                    at = 0
                    while mask:
                        if mask & MASK:
                            rows.append((tid, at, mask & MASK))
                        mask >>= 60
                        at += 60
                cols = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["tid", "start", "mask"])

        windows = cut(distinct.select("tid", "text").mapInArrow(tidy(stream), "tid long, start long, mask long"))
        shared.destroy()
        found = windows if found is None else found.union(windows)
    return found


def text_id(text: str) -> Column:
    return F.xxhash64(text)


def known_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, tid): equal texts have one tid, unequal ones different tids. Texts that share a hash are found by a second
    one, which they go by instead."""
    texts = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    check = F.xxhash64(F.lit("check"), F.col("text"))
    pairs = texts.select(text_id("text").alias("tid"), check.alias("check")).groupBy("tid").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    clashes = [r["tid"] for r in pairs.where("low <> high").select("tid").limit(MAX_CLASHES + 1).collect()]
    if len(clashes) > MAX_CLASHES:
        raise RuntimeError("text hashes clash far more often than by chance")
    return texts.withColumn("tid", F.when(text_id("text").isin(clashes), check).otherwise(text_id("text")) if clashes else text_id("text"))


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, by_broadcast: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by one space) and, if
    wanted, ``kept``.

    Windows are judged on the input: all copies of a repeated passage go. Null and empty texts and texts shorter than
    a window lose nothing; repeated rows repeat each other's windows; null ids are documents like others; an empty
    table gives an empty table; extra columns are not carried.
    """
    if not 2 <= length <= 60:
        raise ValueError("windows hold 2 to 60 words")
    small_batches(df.sparkSession)
    texts = known_texts(df, id_col, text_col)
    windows = windows_by_broadcast(texts, length) if by_broadcast else repeated_windows(texts, cut(repeated_anchors(texts, length)), length)
    windows = windows.groupBy("tid").agg(F.collect_set(F.struct("start", "mask")).alias("windows"))
    fields = [T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if keep_text:
        fields.append(T.StructField("kept", T.StringType()))
    names = [f.name for f in fields]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_chunks(batch):
                part = batch.slice(i, j - i)
                n_words, n_removed, sha, kept = [], [], [], []
                for text, windows in zip(part.column("text"), part.column("windows").to_pylist()):
                    words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                    n = len(words)
                    if windows:
                        cover = np.zeros(n + 1, dtype=np.int64)
                        for w in windows:
                            bits, at = w["mask"], w["start"]
                            while bits:
                                if bits & 1:
                                    cover[at] += 1
                                    cover[at + length] -= 1
                                bits >>= 1
                                at += 1
                        words = list(compress(words, (np.cumsum(cover)[:n] == 0).tolist()))
                    rest = b" ".join(words)
                    n_words.append(n)
                    n_removed.append(n - len(words))
                    sha.append(hashlib.sha256(rest).hexdigest())
                    if keep_text:
                        kept.append(rest.decode("utf-8", "replace"))
                cols = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
                if keep_text:
                    cols.append(pa.array(kept, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return texts.join(windows, "tid", "left").select("doc_id", "text", "windows").mapInArrow(tidy(finish), T.StructType(fields))
