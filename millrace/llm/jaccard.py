"""N-gram Jaccard join in metric space.

Jaccard distance d = 1 - |A n B| / |A u B| is a metric; two documents link when d <= 1 - threshold, called eps.

First level: the pivots are the single shingles, rare before frequent, and a document's nearest pivots are its own
shingles. A document lies in the region of its first pivot and, since a linked partner may lack some of its first shingles but
never more than ``n - ceil(threshold n)`` of them, on the boundary of the next ones, into which it is replicated. Regions with one
document in them end there. (Pivot documents can't serve at this level: unrelated documents all lie at distance 1 from
them, so every window would hold the whole corpus; the README has the figures.) Regions that share documents are one region from
here on: a connected component of that replication.

Then regions are joined recursively with documents as pivots. All that lies within eps of a pivot is linked through it;
a document x of that ball meets only those y outside of it with d(y, p) <= d(x, p) + eps. A region that fits in a
task is finished there. A larger one is cut on the cluster: every document is measured against the region's pivots,
documents whose window holds nothing outside their ball are finished, the others go to the Voronoi cell of the
nearest pivot p and are replicated into every cell q with d(x, q) <= d(x, p) + 2 eps; what pivots can't cut is joined
as pairs of blocks.

Equal sets are one class from the start. Shingles are 64-bit hashes of five words. Classes are 64-bit sums of those, checked
by a second sum: sets that are unequal but have one id get others (see ``JaccardJoin.classes``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, U64, as_long, broadcast_if_small, cut, gram_hashes, mix, release, shuffle_partitions, small_batches, text_bytes, text_chunks, tidy, word_hashes, word_spans
from millrace.llm.components import components, roots

WORDS = 5
#: Shingles of a region that one task joins.
REGION_SHINGLES = 1_000_000
#: Regions of a shingle with more sets than these give no pairs.
PAIR_LIMIT = 64
#: Percent of a set's shingles by which its boundary reaches further than it must.
EXTRA = 15
#: Shingles of a packed bucket, about. Each bucket is a partition.
BUCKET_SHINGLES = 1_000_000
#: Pivots of a large region in a round.
PIVOTS = 8
#: Cells per document, and share of a region in one of its cells, over which pivots don't cut the region.
MAX_SPREAD, MAX_CELL = 3, 0.75
#: Bits of a class id (fewer in tests), and sets that share one by chance at most: 10^10 sets have about three.
ID_BITS, MAX_CLASHES = 64, 100_000
#: Entries of the table of frequent shingles (8 bytes each). The table only orders shingles; any table gives the same links.
FREQUENT = 1 << 20
#: Documents from which a shingle is frequent.
FREQUENT_FROM = 16
#: Shingles gathered before a task merges equal ones.
GATHER = 1_000_000
SLACK = 1e-9


def shingle_sets(col: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle) of all distinct shingles, sorted by document then shingle, and each document's set size."""
    data, offs = text_bytes(col)
    n = len(offs) - 1
    s, e, doc = word_spans(data, offs)
    h = word_hashes(LOWER[data], s, e)
    grams = gram_hashes(h, words)
    inside = doc[words - 1 :] == doc[: len(grams)]
    owner, shingle = doc[: len(grams)][inside], grams[inside]
    n_words = np.bincount(doc, minlength=n)
    first = np.cumsum(n_words) - n_words
    for d in np.flatnonzero((n_words > 0) & (n_words < words)):
        one = h[first[d] : first[d] + n_words[d]]
        owner, shingle = np.append(owner, d), np.append(shingle, gram_hashes(one, len(one)) ^ U64(len(one)))
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    owner, shingle = owner[new], shingle[new]
    return owner, shingle, np.bincount(owner, minlength=n)


def set_sums(owner: np.ndarray, shingle: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A 64-bit sum of each document's set; equal sets have equal sums."""
    total = np.zeros(len(shingle) + 1, dtype=U64)
    np.cumsum(mix(shingle + U64(salt)), out=total[1:])
    at = np.searchsorted(owner, np.arange(n + 1))
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(U64))


class SetIds:
    """Ids of sets. ``clashing``, sorted, are those that unequal sets share: such sets go by their second sum."""

    def __init__(self, clashing: np.ndarray | None = None):
        self.clashing = np.zeros(0, np.int64) if clashing is None else clashing
        self.shift = U64(64 - ID_BITS)

    def __call__(self, owner: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
        ids = (set_sums(owner, shingle, n, 0xA5A5) >> self.shift).view(np.int64)
        if len(self.clashing):
            at = np.minimum(np.searchsorted(self.clashing, ids), len(self.clashing) - 1)
            ids = np.where(self.clashing[at] == ids, self.checks(owner, shingle, n), ids)
        return ids

    def checks(self, owner: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
        return set_sums(owner, shingle, n, 0x3C3C3C).view(np.int64)


def order_keys(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of each shingle, by the range of its hash, over the hash's low 32 bits."""
    bucket = (h >> U64(32)) * U64(n_buckets) >> U64(32)
    return (bucket << U64(32)) | (h & U64(0xFFFFFFFF))


def reach(n: np.ndarray, percent: int) -> np.ndarray:
    """Into how many of its shingles' regions a set of n shingles is replicated."""
    return np.minimum(n, n - -(-percent * n // 100) + -(-EXTRA * n // 100))


def _forest(edges: np.ndarray) -> np.ndarray:
    """Edges from each node to the least node of its component: as few as connect the same nodes."""
    ids, at = np.unique(edges, return_inverse=True)
    at = at.reshape(-1, 2)
    root = roots(len(ids), at[:, 0], at[:, 1])
    moved = root != np.arange(len(ids))
    return np.stack([ids[moved], ids[root[moved]]], axis=1)


def linked(overlap, n_a, n_b, percent: int):
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def region_links(sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Links (positions) that connect what all links of a region connect, by pivots and windows."""
    m = len(sets)
    left: list[int] = []
    right: list[int] = []
    if m < 2:
        return left, right
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if m == 2:
        if linked(len(np.intersect1d(sets[0], sets[1], assume_unique=True)), size[0], size[1], percent):
            return [0], [1]
        return left, right
    eps = 1 - percent / 100 + SLACK
    owner = np.repeat(np.arange(m), size)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    key = every[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(key)))
    posting = owner[order]
    ident = np.empty(len(key), dtype=np.int64)
    ident[order] = np.cumsum(new) - 1
    at = np.append(0, np.cumsum(size))

    def overlaps(i: int) -> np.ndarray:
        ids = ident[at[i] : at[i + 1]]
        ids = ids[count[ids] > 1]
        n = count[ids]
        base = np.repeat(start[ids] - np.append(0, np.cumsum(n))[:-1], n)
        out = np.bincount(posting[base + np.arange(len(base))], minlength=m)
        out[i] = size[i]
        return out

    remaining = np.ones(m, dtype=bool)
    for p in range(m):
        if not remaining[p]:
            continue
        remaining[p] = False
        o = overlaps(p)
        d = 1 - o / np.maximum(size[p] + size - o, 1)
        near = linked(o, size[p], size, percent) & remaining
        ball, out = np.flatnonzero(near), np.flatnonzero(remaining & ~near)
        left += [p] * len(ball)
        right += ball.tolist()
        if len(ball) and len(out):
            out = out[d[out] <= d[ball].max() + eps]
            if len(out):
                for x in ball[d[ball] + eps >= d[out].min()]:
                    hit = out[linked(overlaps(x)[out], size[x], size[out], percent)]
                    left += [int(x)] * len(hit)
                    right += hit.tolist()
            if len(left) > 8 * m:
                left, right = _spanning(m, left, right)
        remaining[ball] = False
    return _spanning(m, left, right)


def _spanning(m: int, left: list[int], right: list[int]) -> tuple[list[int], list[int]]:
    """At most m - 1 links that connect what the given ones connect."""
    root = roots(m, np.array(left, dtype=np.int64), np.array(right, dtype=np.int64))
    moved = np.flatnonzero(root != np.arange(m))
    return moved.tolist(), root[moved].tolist()


def _join_sorted(percent: int, key: str):
    """Joins region after region of batches sorted by the region's key; holds one region at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sids, sets = None, [], []
        out_a, out_b = [], []

        def close():
            sid = np.array(sids, dtype=np.int64)
            _, first = np.unique(sid, return_index=True)
            a, b = region_links([sets[i] for i in first], percent)
            out_a.extend(sid[first][a].tolist())
            out_b.extend(sid[first][b].tolist())

        for batch in batches:
            for region, sid, shingles in zip(batch.column(key).to_pylist(), batch.column("sid").to_pylist(), batch.column("shingles")):
                if region != at:
                    close()
                    at, sids, sets = region, [], []
                sids.append(sid)
                sets.append(np.frombuffer(shingles.as_buffer(), dtype=U64))
            if len(out_a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
                out_a, out_b = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


class JaccardJoin:
    """The join's steps over one table of documents (``doc_id``, ``text``)."""

    def __init__(self, docs: DataFrame, percent: int = 75, words: int = WORDS):
        self.docs, self.percent, self.words = docs, percent, words
        self.spark = docs.sparkSession
        self.parts = shuffle_partitions(self.spark)
        self.ids = SetIds()
        small_batches(self.spark)

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """(signatures of all documents, classes of equal sets: sid, rep, n). Ids that unequal sets share are found by the second
        sum, and what bears them is read again under others."""
        for _ in range(3):
            signatures = cut(self.signatures())
            keyed = signatures.where(F.col("doc_id").isNotNull() & F.col("sid").isNotNull())
            classes = cut(keyed.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high")))
            clashes = classes.where("low <> high").select("sid").limit(MAX_CLASHES + 1).collect()
            if not clashes:
                return signatures.drop("check"), classes.select("sid", "rep", "n")
            if len(clashes) > MAX_CLASHES:
                break
            self.ids = SetIds(np.unique(np.append(self.ids.clashing, [r["sid"] for r in clashes])).astype(np.int64))
        raise RuntimeError("set ids clash far more often than by chance")

    def signatures(self) -> DataFrame:
        """doc_id, n (set size), sid and its check (null for empty sets)."""
        words, ids = self.words, self.ids

        def run(batches):
            for batch in batches:
                for i, j in text_chunks(batch):
                    part = batch.slice(i, j - i)
                    owner, shingle, n = shingle_sets(part.column("text"), words)
                    sid, check = (pa.array(x(owner, shingle, len(n)), mask=n == 0) for x in (ids, ids.checks))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), sid, check], names=["doc_id", "n", "sid", "check"])

        return self.docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, sid long, check long")

    def frequent(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Frequent shingles: their keys (see ``order_keys``), sorted, and the place of each by rising frequency. They are ordered
        by frequency behind all others. All shingles of all documents are counted, under 32 bits of their hash within their
        bucket; two that share a key are merely ordered together."""
        words = self.words

        def gather(batches):
            held, n = [], 0

            def flush():
                h, c = np.unique(np.concatenate(held), return_counts=True)
                key = order_keys(h, n_buckets)
                bucket, low = (key >> U64(32)).astype(np.int64), key.astype(np.uint32)
                ends = np.searchsorted(bucket, np.arange(n_buckets + 1))
                rows = [(b, low[x:y][c[x:y] == 1].tobytes(), low[x:y][c[x:y] > 1].tobytes(), c[x:y][c[x:y] > 1].astype(np.uint32).tobytes()) for b, (x, y) in enumerate(zip(ends[:-1], ends[1:])) if y > x]
                cols = list(zip(*rows))
                return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(x, pa.binary()) for x in cols[1:])], names=["bucket", "once", "more", "times"])

            for batch in batches:
                for i, j in text_chunks(batch):
                    _, shingle, _ = shingle_sets(batch.column("text").slice(i, j - i), words)
                    held.append(shingle)
                    n += len(shingle)
                    if n > 2 * GATHER:
                        yield flush()
                        held, n = [], 0
            if n:
                yield flush()

        def count(batches):
            at, once, more, times = None, [], [], []

            def close():
                low = np.concatenate([np.frombuffer(x, np.uint32) for x in once + more])
                c = np.concatenate([np.ones(sum(map(len, once)) // 4, np.int64), *(np.frombuffer(x, np.uint32) for x in times)])
                order = np.argsort(low, kind="stable")
                low, c = low[order], c[order].astype(np.int64)
                new = np.ones(len(low), dtype=bool)
                new[1:] = low[1:] != low[:-1]
                start = np.flatnonzero(new)
                total = np.add.reduceat(c, start)
                many = total >= FREQUENT_FROM
                key = (U64(at) << U64(32)) + low[start[many]].astype(U64)
                return pa.RecordBatch.from_arrays([as_long(key), pa.array(total[many])], names=["key", "c"])

            for batch in batches:
                cols = [batch.column(x).to_pylist() for x in ("bucket", "once", "more", "times")]
                for bucket, a, b, c in zip(*cols):
                    if bucket != at:
                        if at is not None:
                            yield close()
                        at, once, more, times = bucket, [], [], []
                    once.append(a)
                    more.append(b)
                    times.append(c)
            if at is not None:
                yield close()

        packed = self.docs.select("text").mapInArrow(tidy(gather), "bucket long, once binary, more binary, times binary")
        counted = packed.repartitionById(n_buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(tidy(count), "key long, c long")
        counted = counted.orderBy(F.desc("c"), "key").limit(FREQUENT).toArrow()
        key, c = counted["key"].to_numpy().view(U64), counted["c"].to_numpy()
        order = np.argsort(key)
        rank = np.empty(len(key), dtype=np.int32)
        rank[np.lexsort((key, c))] = np.arange(1, len(key) + 1)
        return key[order], rank[order]

    def replication(self, frequent: tuple[np.ndarray, np.ndarray], n_buckets: int) -> DataFrame:
        """Edges (a, b) between sets that meet in regions of shingles, often enough.

        Boundaries reach ``EXTRA`` percent of a set's shingles further than they must, so linked sets meet in that many
        regions more. Regions of up to ``PAIR_LIMIT`` sets give the pairs that meet there; pairs that meet too seldom
        are dropped. Larger regions give each set's meeting with the region's first, and such pairs all stay; two sets
        that meet in a larger region are so connected whatever the count of the rest. Rows travel as packed arrays, by
        ranges of the shingles' hashes."""
        shared = self.spark.sparkContext.broadcast(frequent)  # at most FREQUENT numbers
        words, percent, ids = self.words, self.percent, self.ids
        names = ["bucket", "h", "doc", "sid", "n", "star"]

        def spread(batches):
            hot, rank = shared.value
            held, n_held = [], 0

            def flush():
                """A row for each bucket: shingles, the number of the set of each, the sets' ids and sizes, and shingles
                that more than PAIR_LIMIT sets of this task hold (one set stands for the others, as edges elsewhere)."""
                h, sid, n = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((sid, h))
                h, sid, n = h[order], sid[order], n[order]
                keep = np.ones(len(h), dtype=bool)
                keep[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
                h, sid, n = h[keep], sid[keep], n[keep]
                new = np.ones(len(h), dtype=bool)
                new[1:] = h[1:] != h[:-1]
                group = np.cumsum(new) - 1
                star = np.bincount(group)[group] > PAIR_LIMIT
                hub = np.flatnonzero(new)[group]
                edge = _forest(np.stack([sid, sid[hub]], axis=1)[star & ~new])
                sid_of, doc = np.unique(sid, return_inverse=True)
                n_of = np.zeros(len(sid_of), dtype=np.int32)
                n_of[doc] = n
                stay = ~star | new
                h, doc, star = h[stay], doc[stay], star[stay]
                bucket = (order_keys(h, n_buckets) >> U64(32)).astype(np.int64)
                order = np.lexsort((doc, bucket))
                h, doc, star, bucket = h[order], doc[order], star[order], bucket[order]
                cols = [[], [], [], [], [], []]
                ends = np.searchsorted(bucket, np.arange(n_buckets + 1))
                for b in np.flatnonzero(np.diff(ends)):
                    at = slice(ends[b], ends[b + 1])
                    own, local = np.unique(doc[at], return_inverse=True)
                    for c, x in zip(cols, (int(b), h[at].tobytes(), local.astype(np.int32).tobytes(), sid_of[own].tobytes(), n_of[own].tobytes(), h[at][star[at]].tobytes())):
                        c.append(x)
                if len(edge):  # given edges go to any bucket, as empty shingles
                    for c, x in zip(cols, (int(edge[0, 0]) % n_buckets, b"", b"", edge.tobytes(), b"", b"")):
                        c.append(x)
                return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=names)

            for batch in batches:
                for i, j in text_chunks(batch):
                    owner, shingle, n = shingle_sets(batch.column("text").slice(i, j - i), words)
                    if not len(owner):
                        continue
                    sid = ids(owner, shingle, len(n))
                    late = np.zeros(len(shingle), dtype=np.int32)
                    if len(hot):
                        key = order_keys(shingle, n_buckets)
                        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                        late = np.where(hot[at] == key, rank[at], 0)
                    order = np.lexsort((shingle, late, owner))
                    place = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
                    take = place < reach(n, percent)[owner]
                    held.append((shingle[order][take], sid[owner[take]], n[owner[take]].astype(np.int32)))
                    n_held += int(take.sum())
                    if n_held > GATHER:
                        yield flush()
                        held, n_held = [], 0
            if held:
                yield flush()

        def meet(rows):
            """All rows of one bucket -> pairs (a, b, n_a, n_b, times), times null where they stay whatever the count."""
            blobs = [[np.frombuffer(x, t) for x in rows[c]] for c, t in (("h", U64), ("doc", np.int32), ("sid", np.int64), ("n", np.int32), ("star", U64))]
            given = [s.reshape(-1, 2) for h, s in zip(blobs[0], blobs[2]) if not len(h)]
            edges = given or [np.zeros((0, 2), np.int64)]
            h = np.concatenate(blobs[0])
            sid = np.concatenate([s[d] for d, s in zip(blobs[1], blobs[2]) if len(d)] or [np.zeros(0, np.int64)])
            n = np.concatenate([s[d] for d, s in zip(blobs[1], blobs[3]) if len(d)] or [np.zeros(0, np.int32)])
            stars = np.unique(np.concatenate(blobs[4]))
            order = np.lexsort((sid, h))
            h, sid, n = h[order], sid[order], n[order]
            keep = np.ones(len(h), dtype=bool)
            keep[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
            h, sid, n = h[keep], sid[keep], n[keep]
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[1:] != h[:-1]
            start = np.flatnonzero(new)
            count = np.diff(np.append(start, len(h)))
            star = count > PAIR_LIMIT
            if len(stars) and len(start):
                star |= stars[np.minimum(np.searchsorted(stars, h[start]), len(stars) - 1)] == h[start]
            group = np.cumsum(new) - 1
            of_star = star[group] & ~new if len(h) else new
            if of_star.any():
                edges.append(np.stack([sid[of_star], sid[start[group[of_star]]]], axis=1))
            e = _forest(np.concatenate(edges))
            out = [(e[:, 0], e[:, 1], np.zeros(len(e), np.int32), np.zeros(len(e), np.int32), np.zeros(len(e), np.int64))] if len(e) else []
            pairs, n_pairs = [], 0

            def total():
                a, b = (np.concatenate(x) for x in zip(*pairs))
                key = mix(sid[a].view(U64) * U64(3) + mix(sid[b].view(U64)))
                _, first, times = np.unique(key, return_index=True, return_counts=True)
                return sid[a[first]], sid[b[first]], n[a[first]], n[b[first]], times

            for size in np.unique(count[~star & (count > 1)]):
                at = start[~star & (count == size)]
                x, y = np.triu_indices(int(size), 1)
                step = max(1, GATHER // len(x))
                for k in range(0, len(at), step):
                    a, b = (at[k : k + step, None] + x).ravel(), (at[k : k + step, None] + y).ravel()
                    low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                    fits = 100 * low.astype(np.int64) >= percent * high.astype(np.int64)
                    pairs.append((a[fits], b[fits]))
                    n_pairs += int(fits.sum())
                    if n_pairs > 2 * GATHER:
                        out.append(total())
                        pairs, n_pairs = [], 0
            if n_pairs:
                out.append(total())
            return [pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(na.astype(np.int64)), pa.array(nb.astype(np.int64)), pa.array(t.astype(np.int64), mask=t == 0)], names=["a", "b", "n_a", "n_b", "times"]) for a, b, na, nb, t in out]

        def meet_sorted(batches):
            at, rows = None, {c: [] for c in names[1:]}
            for batch in batches:
                cols = {c: batch.column(c).to_pylist() for c in names[1:]}
                for k, bucket in enumerate(batch.column("bucket").to_pylist()):
                    if bucket != at:
                        if at is not None:
                            yield from meet(rows)
                        at, rows = bucket, {c: [] for c in names[1:]}
                    for c in names[1:]:
                        rows[c].append(cols[c][k])
            if at is not None:
                yield from meet(rows)

        packed = self.docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(tidy(spread), "bucket long, h binary, doc binary, sid binary, n binary, star binary")
        met = packed.repartitionById(n_buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(tidy(meet_sorted), "a long, b long, n_a long, n_b long, times long")
        met = met.groupBy("a", "b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum("times").alias("times"), F.max(F.col("times").isNull()).alias("stays"))
        least = -F.floor(-(F.col("n_a") + F.col("n_b")) * percent / (100 + percent) + SLACK)  # shingles that linked sets share at least
        spare = lambda n: F.least(n, n - F.ceil(n * percent / 100) + F.ceil(n * EXTRA / 100)) - n
        needed = F.greatest(F.lit(1), F.least(spare(F.col("n_a")), spare(F.col("n_b"))) + least)
        return met.where(F.col("stays") | (F.col("times") >= needed)).select("a", "b")

    def members(self, classes: DataFrame, regions: DataFrame) -> DataFrame:
        """(region, sid, n, shingles, w) of every class in a region; the sets are read from the least document's
        text. Weights w (a region's shingles) are known before any set is read, so sets are shuffled once, to their region's task."""
        words, ids = self.words, self.ids
        placed = classes.join(regions, F.col("sid") == F.col("node")).select("sid", "rep", "n", F.col("component").alias("region"))
        wanted = cut(self._weighed(placed).select(F.col("rep").alias("doc_id"), F.col("sid").alias("want"), "region", "w"))

        def run(batches):
            for batch in batches:
                for i, j in text_chunks(batch):
                    part = batch.slice(i, j - i)
                    owner, shingle, n = shingle_sets(part.column("text"), words)
                    ok = ids(owner, shingle, len(n)) == part.column("want").to_numpy()
                    at = np.append(0, np.cumsum(n))
                    sets = [shingle[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                    out = pa.RecordBatch.from_arrays([part.column("region"), part.column("want"), pa.array(n.astype(np.int64)), pa.array(sets, pa.binary()), part.column("w")], names=["region", "sid", "n", "shingles", "w"])
                    yield out.filter(pa.array(ok & (n > 0)))

        read = self.docs.select("doc_id", "text").join(broadcast_if_small(wanted), "doc_id").mapInArrow(tidy(run), "region long, sid long, n long, shingles binary, w long")
        return self._placed(read)

    def _weighed(self, members: DataFrame) -> DataFrame:
        """With w, the number of shingles of the region."""
        weight = members.groupBy(F.col("region").alias("of")).agg(F.sum("n").alias("w"))
        return members.join(weight, F.col("region") == F.col("of")).drop("of")

    def _placed(self, members: DataFrame) -> DataFrame:
        """Written with each region in one partition, sorted; large regions are dealt out over all."""
        salt = F.when(F.col("w") > REGION_SHINGLES, F.xxhash64("sid")).otherwise(0)
        return cut(members.repartition(self.parts, "region", salt).sortWithinPartitions("region", "n", "sid"))

    def join_regions(self, members: DataFrame) -> DataFrame:
        """Links (a, b) among the members of each region, enough of them to connect what all links connect. Regions that one
        task can hold are joined; all others are cut by pivots, all at once, until every cell fits in a task. A round leaves a cell
        at most MAX_CELL of its region, so the rounds are few."""
        out, depth = None, 0
        while True:
            links = cut(members.where(F.col("w") <= REGION_SHINGLES).mapInArrow(tidy(_join_sorted(self.percent, "region")), "a long, b long"))
            out = links if out is None else out.union(links)
            large = members.where(F.col("w") > REGION_SHINGLES)
            if large.isEmpty():
                return out
            links, members = self._pivot_round(large, depth)
            out = out.union(links)
            depth += 1

    def _pivot_round(self, members: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
        """Cut all large regions by pivots: (links, members of the cells). Regions that pivots don't cut are joined in blocks.

        A region's pivots are its documents of least hash. They travel to every part of about REGION_SHINGLES of the region's
        shingles, so no task holds more than a part and the pivots, and nothing of it passes the driver."""
        percent = self.percent
        eps = 1 - percent / 100 + SLACK
        draw = F.xxhash64("sid", F.lit(depth))
        first = Window.partitionBy("region").orderBy("draw", "sid")  # cut to PIVOTS before the shuffle
        chosen = members.select("region", "sid", draw.alias("draw")).withColumn("k", F.row_number().over(first)).where(F.col("k") <= PIVOTS)
        chosen = broadcast_if_small(cut(chosen.select(F.col("region").alias("of"), F.col("sid").alias("pid"), "k")))
        parts = F.ceil(F.col("w") / REGION_SHINGLES)
        pivots = members.join(chosen, (F.col("region") == F.col("of")) & (F.col("sid") == F.col("pid"))).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        pivots = pivots.select("region", "part", "sid", "n", "shingles", F.col("k").cast("int").alias("k"))
        own = members.select("region", F.pmod(F.xxhash64("sid", F.lit("part")), parts).alias("part"), "sid", "n", "shingles", F.lit(0).alias("k"))

        def measure(batches):
            """Sorted by region and part, pivots first: distance to each pivot, and whether it is a link's."""
            at, known = None, []
            for batch in batches:
                rows = {c: [] for c in ("region", "sid", "pid", "d", "ball")}
                for region, part, k, sid, n, shingles in zip(*(batch.column(c).to_pylist() for c in ("region", "part", "k", "sid", "n")), batch.column("shingles")):
                    own = np.frombuffer(shingles.as_buffer(), dtype=U64)
                    if (region, part) != at:
                        at, known = (region, part), []
                    if k:
                        known.append((sid, own.copy()))
                        continue
                    o = np.array([int((p[np.minimum(np.searchsorted(p, own), len(p) - 1)] == own).sum()) for _, p in known], dtype=np.int64)
                    size = np.array([len(p) for _, p in known], dtype=np.int64)
                    for c, x in zip(rows, (region, sid, [p for p, _ in known], (1 - o / (n + size - o)).tolist(), linked(o, n, size, percent).tolist())):
                        rows[c].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows["region"], pa.int64()), pa.array(rows["sid"], pa.int64()), pa.array(rows["pid"], pa.list_(pa.int64())), pa.array(rows["d"], pa.list_(pa.float64())), pa.array(rows["ball"], pa.list_(pa.bool_()))], names=list(rows))

        dealt = own.union(pivots.select(own.columns)).repartition(self.parts, "region", "part").sortWithinPartitions("region", "part", F.desc("k"), "sid")
        dist = cut(dealt.mapInArrow(tidy(measure), "region long, sid long, pid array<long>, d array<double>, ball array<boolean>"))
        each = dist.select("region", "sid", F.explode(F.arrays_zip("pid", "d", "ball")).alias("p")).select("region", "sid", "p.*")
        links = each.where(F.col("ball") & (F.col("sid") != F.col("pid"))).select(F.col("sid").alias("a"), F.col("pid").alias("b"))
        # a ball whose window holds nothing outside of it is finished
        beyond = each.where(~F.col("ball")).groupBy(F.col("region").alias("of"), F.col("pid").alias("p")).agg(F.min("d").alias("beyond"))
        beyond = broadcast_if_small(cut(beyond))
        inside = each.where("ball").join(beyond, (F.col("region") == F.col("of")) & (F.col("pid") == F.col("p")), "left")
        done = inside.where(F.col("beyond").isNull() | (F.col("d") + F.lit(eps) < F.col("beyond"))).select("region", "sid").distinct()
        rest = dist.join(done, ["region", "sid"], "left_anti").withColumn("home", F.array_min("d"))
        cell = cut(rest.select("region", "sid", F.explode(F.arrays_zip("pid", "d")).alias("p"), "home").where(F.col("p.d") <= F.col("home") + 2 * eps).select("region", "sid", F.col("p.pid").alias("pid")))
        sizes = cell.groupBy("region", "pid").agg(F.count(F.lit(1)).alias("c")).groupBy("region").agg(F.sum("c").alias("copies"), F.max("c").alias("largest"))
        whole = rest.groupBy("region").agg(F.count(F.lit(1)).alias("m"))
        stuck = sizes.join(whole, "region").where((F.col("copies") > MAX_SPREAD * F.col("m")) | (F.col("largest") > MAX_CELL * F.col("m"))).select("region")
        stuck = broadcast_if_small(cut(stuck))
        split = members.join(cell.join(stuck, "region", "left_anti"), ["region", "sid"]).select(F.xxhash64("region", "pid", F.lit(depth)).alias("region"), "sid", "n", "shingles")
        blocks = members.join(cell.join(stuck, "region", "left_semi").select("region", "sid").distinct(), ["region", "sid"]).select("region", "sid", "n", "shingles")
        return links.union(self._block_pairs(blocks)), self._placed(self._weighed(cut(split)))

    def _block_pairs(self, members: DataFrame) -> DataFrame:
        """Join what pivots can't cut as pairs of blocks, each of about half a task's share (or one document)."""
        blocks = F.ceil(F.col("w") / (REGION_SHINGLES // 2)).cast("int")
        rows = self._weighed(cut(members)).withColumn("g", blocks).withColumn("i", F.pmod(F.xxhash64("sid"), F.col("g")).cast("int"))
        rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        task = F.xxhash64("region", F.least("i", "j"), F.greatest("i", "j"))
        rows = rows.select(task.alias("task"), "sid", "n", "shingles")
        return cut(rows.repartition(self.parts, "task").sortWithinPartitions("task", "n", "sid").mapInArrow(tidy(_join_sorted(self.percent, "task")), "a long, b long"))


def near_duplicates(df: DataFrame, percent: int = 75, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles`` and ``component_id`` (least id reachable by links, itself included).

    Null and empty texts have no shingles and link with nothing; texts of fewer words than a shingle have one, the
    whole sequence. Repeated rows and equal sets share a component. A null id takes no part: its component is null.
    An empty table gives an empty table; extra columns are not carried.

    Components are exact, but links are not all evaluated: a region gives a spanning forest, so neither the links nor
    their number per document can be reported.
    """
    join = JaccardJoin(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")), percent, words)
    signatures, classes = join.classes()
    n_shingles = signatures.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(join.parts, math.ceil(n_shingles * (100 - percent + EXTRA) / 100 / BUCKET_SHINGLES))
    frequent = join.frequent(buckets)
    release(join.spark)
    regions = components(join.replication(frequent, buckets), "a", "b")
    release(join.spark)
    members = join.members(classes, regions)
    release(join.spark)
    links = join.join_regions(members)
    parts = components(links, "a", "b")
    named = classes.join(parts, F.col("sid") == F.col("node"), "left").select("sid", "rep", F.coalesce("component", "sid").alias("part"))
    least = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    of_class = named.join(least, "part").select(F.col("sid").alias("__sid"), "component_id")
    # ids that stand on several rows join the components of all their texts only by their own rows' sets
    out = signatures.join(of_class, F.col("sid") == F.col("__sid"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
