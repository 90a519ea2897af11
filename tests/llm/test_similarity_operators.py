"""Joins, search and substring dedup against brute force, with small limits so that every path runs."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, components, embed_dedup, jaccard, substring
from millrace.llm.common import word_hashes
from tests.llm.fixtures import documents, empty_documents, odd_documents, words

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(pairs):
    sets = {i: shingles(t) for i, t in pairs if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, least_reachable(ids, links)


def check_jaccard(spark, pairs):
    sets, want = brute_components(pairs)
    got = jaccard.near_duplicates(documents(spark, pairs)).collect()
    assert len(got) == len(pairs)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r.doc_id


def near_copies(seed, groups, size, length=80):
    rng, out, i = random.Random(seed), [], 1000
    for _ in range(groups):
        base = words(rng, length, 5000)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
            out.append((i, " ".join(w)))
            i += 1
    return out


def test_jaccard_odd_documents(spark):
    check_jaccard(spark, odd_documents())
    assert jaccard.near_duplicates(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("limits", [{"PAIR_LIMIT": 3}, {"REGION_SHINGLES": 300, "MAX_SPREAD": 0}, {"REGION_SHINGLES": 300, "MAX_SPREAD": 9, "MAX_CELL": 1}, {"GATHER": 50, "PAIR_LIMIT": 2, "REGION_SHINGLES": 500}, {"ID_BITS": 5}])
def test_jaccard_large_regions(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(jaccard, k, v)
    check_jaccard(spark, near_copies(5, 3, 14) + odd_documents(n=20))


def test_jaccard_recursion_cuts_clusters(spark, monkeypatch):
    """One region of several clusters, chained by documents between them: pivots must cut it more than once."""
    monkeypatch.setattr(jaccard, "REGION_SHINGLES", 1500)
    monkeypatch.setattr(jaccard, "PAIR_LIMIT", 2)  # a meeting is enough to be of one region
    rng = random.Random(12)
    shared = words(rng, 9, 10**6)
    pairs = []
    for _ in range(12):
        base = words(rng, 60, 10**6)
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(50)] = f"e{rng.randrange(9)}"
            pairs.append((len(pairs) + 1, " ".join(shared + w)))
    check_jaccard(spark, pairs)


def test_sets_of_words_with_equal_polynomial_hashes_stay_apart(spark):
    """Thue-Morse words and their complements collide under any polynomial hash modulo a power of two."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    pairs = [(1, a), (2, b), (3, " ".join(a)), (4, " ".join(b)), (5, f"w x y z {a}"), (6, f"w x y z {b}")]
    check_jaccard(spark, pairs)
    data = np.frombuffer((a + b).encode(), np.uint8)
    for n in (7, 8, 9, 16, 33, 64, 65, 1024):
        h = word_hashes(data, np.array([0, 1024]), np.array([n, 1024 + n]))
        assert h[0] != h[1]


def test_word_hashes_of_all_lengths():
    rng = random.Random(1)
    found = [bytes(rng.choice(b"ab\xc3") for _ in range(rng.choice([1, 2, 7, 8, 9, 20, 63, 64, 65, 200]))) for _ in range(4000)]
    data = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    h = word_hashes(np.frombuffer(data, np.uint8), ends - [len(w) for w in found], ends)
    assert len(set(h.tolist())) == len(set(found)) == len(set(zip(found, h.tolist())))


def test_region_links_connect_what_all_links_do():
    rng = np.random.default_rng(2)
    for _ in range(60):
        base = rng.integers(0, 60, 40)
        sets = [np.unique(np.where(rng.random(40) < rng.choice([0.05, 0.12, 0.3]), rng.integers(0, 400, 40), base)).astype(np.uint64) for _ in range(12)]
        links = [(a, b) for a in range(12) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
        assert least_reachable(range(12), list(zip(*jaccard.region_links(sets, 75)))) == least_reachable(range(12), links)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5)]
    want = least_reachable({v for e in edges for v in e if e[0] != e[1]}, edges)
    got = components.components(spark.createDataFrame([*edges, (None, 3)], "x long, y long"), "x", "y")
    assert {r.node: r.component for r in got.collect()} == want
    assert got.count() == len(want)


VEC = "vec_id long, embedding array<double>, label int, class string, __key int, n long, block int"


def odd_vectors(seed=1, n=150, dim=8):
    rng = np.random.default_rng(seed)
    out = [(1, None), (2, []), (3, [0.0] * dim), (4, [float("nan")] * dim), (5, [1.0] * (dim - 1) + [None]), (6, [1.0, 2.0]), (7, [float("inf")] * dim)]
    centres = rng.normal(size=(6, dim))
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=dim) * rng.choice([0.05, 0.3, 2.0])
        out.append((100 + i, [float(x) for x in v * rng.choice([1e-3, 1.0, 1e5])]))
    return out + [out[-1], (50, out[-1][1]), (51, [2 * x for x in out[-1][1]])]


def vectors(spark, pairs):
    return spark.createDataFrame([(i, v, 0, "c", 1, 2, 3) for i, v in pairs], VEC)


def usable(pairs, dim=8):
    return [(i, np.array(v) / np.linalg.norm(v)) for i, v in pairs if v is not None and len(v) == dim and None not in v and np.isfinite(v).all() and any(v)]


@pytest.mark.parametrize("block", [2048, 16])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    pairs = odd_vectors()
    good = usable(pairs)
    x = np.stack([v for _, v in good])
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    want = least_reachable({i for i, _ in pairs}, [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(link))])
    n = Counter((i, int(row.sum())) for (i, _), row in zip(good, link))
    got = embed_dedup.link_vectors(vectors(spark, pairs)).collect()
    assert len(got) == len(pairs)
    known = {i for i, _ in good}
    assert Counter((r.vec_id, r.n_links) for r in got if r.vec_id in known) == n
    for r in got:
        assert r.component_id == want[r.vec_id] and r.kept == (r.vec_id == r.component_id)
        assert r.vec_id in known or r.n_links == 0
    assert embed_dedup.link_vectors(vectors(spark, [])).count() == 0


def test_ann_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 400)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    pairs = odd_vectors(n=1500)
    rows = {i: v for i, v in usable(pairs)}
    got = ann.search(vectors(spark, pairs), F.col("vec_id") % 50 == 0).collect()
    asked = [i for i in rows if i % 50 == 0]
    assert {r.query_id for r in got} == set(asked)
    hit = 0
    for q in asked:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - rows[q] @ rows[r.vec_id]) < 1e-12 and r.vec_id != q for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        best = sorted(rows, key=lambda i: (i == q, -(rows[q] @ rows[i]), i))[:5]
        hit += len({r.vec_id for r in mine} & set(best))
    assert hit >= 0.9 * 5 * len(asked)
    assert ann.search(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    few = ann.search(vectors(spark, pairs[7:10] + [(50, pairs[11][1])]), F.col("vec_id") == 50).collect()
    assert len(few) == 3


def test_ann_is_exact_among_copies_and_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 600)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 30)
    rng = np.random.default_rng(7)
    one, other = rng.normal(size=8), rng.normal(size=8)
    near = [other + 1e-4 * rng.normal(size=8) for _ in range(500)]
    made = [one] * 600 + near + [rng.normal(size=8) for _ in range(400)]
    pairs = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(made)), made)]
    pairs += [pairs[3], (pairs[700][0], pairs[5][1]), (pairs[1][0], pairs[800][1])]
    by_id = {}
    for i, v in usable(pairs):
        by_id.setdefault(i, []).append(v)
    x = {i: np.stack(v) for i, v in by_id.items()}
    got = ann.search(vectors(spark, pairs), F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in got} == {i for i in x if i % 20 == 0}
    for q in {r.query_id for r in got}:
        exact = {i: round(float((v @ x[q].T).max()), 12) for i, v in x.items() if i != q}
        want = sorted(exact, key=lambda i: (-exact[i], i))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [exact[r.vec_id] for r in mine] == [exact[i] for i in want]
        if exact[want[0]] == exact[want[-1]]:
            assert [r.vec_id for r in mine] == want


def test_beam_search_encodes_better_with_more_beams():
    x = np.random.default_rng(4).normal(size=(600, 16))
    book = ann.fit(x, books=4, size=16)
    err = [np.square(x - book.decode(book.encode(x, beam))).sum() for beam in (1, 8)]
    assert err[1] <= err[0] < np.square(x).sum()


def brute_repeats(pairs, length):
    docs = [(i, (t or "").encode().split()) for i, t in pairs]
    seen = Counter(tuple(w[k : k + length]) for _, w in docs for k in range(len(w) - length + 1))
    out = Counter()
    for i, w in docs:
        gone = set()
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone.update(range(k, k + length))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("length", "limits"), [(35, {}), (6, {}), (6, {"HOT": 8}), (7, {"HOT": 4, "GATHER": 40}), (35, {"HOT": 4, "GATHER": 100})])
def test_substring_removal(spark, monkeypatch, length, limits):
    for k, v in limits.items():
        monkeypatch.setattr(substring, k, v)
    pairs = odd_documents(n=70) + [(600, "a " * 90), (601, "b c " * 60)]
    got = substring.remove_repeats(documents(spark, pairs), length).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(pairs, length)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substring.remove_repeats(empty_documents(spark), length).count() == 0


def test_substring_removal_by_broadcast(spark, monkeypatch):
    pairs = odd_documents(n=40) + [(600, "a " * 90), (601, "b c " * 60)]
    monkeypatch.setattr(substring.windows_by_broadcast, "__defaults__", (35, 2000))
    got = substring.remove_repeats(documents(spark, pairs), 6, by_broadcast=True).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(pairs, 6)


def test_substring_removal_when_text_hashes_clash(spark, monkeypatch):
    monkeypatch.setattr(substring, "text_id", lambda text: F.pmod(F.xxhash64(text), F.lit(7)))
    pairs = odd_documents(n=40)
    got = substring.remove_repeats(documents(spark, pairs), 6).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(pairs, 6)


def test_automaton_counts_occurrences():
    rng = random.Random(5)
    for _ in range(80):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(3, 14))) for _ in range(4)]
        a = substring.Automaton()
        for t in texts:
            a.add(t, 1)
        a.close()
        for t in texts:
            for n in (2, 3, 4):
                seen = Counter(u[k : k + n] for u in texts for k in range(len(u) - n + 1))
                mask = a.repeats(t, n)
                assert [bool(mask >> k & 1) for k in range(len(t) - n + 1)] == [seen[t[k : k + n]] > 1 for k in range(len(t) - n + 1)]
