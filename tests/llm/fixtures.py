"""Small tables with everything that may go wrong in them."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid long, row string, size string, part string, __key int, bucket int, h string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_documents(seed=1, n=60):
    """(doc_id, text) pairs: nulls, empty and blank texts, very short and very long ones, exact copies, repeated rows,
    near copies, shared passages, odd characters."""
    rng = random.Random(seed)
    passage = words(rng, 50)
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, "a b c d e"), (7, "A b C d E"), (None, "null id text here now"), (8, "é ß Ünïcode 漢字 \x00 \x85 x y")]
    long = words(rng, 6000)
    out += [(9, " ".join(long)), (10, " ".join(long)), (11, "x" * 30000), (12, "!!! " * 500)]
    for i in range(100, 100 + n):
        own = words(rng, rng.randrange(3, 120))
        if i % 4 == 0:
            own = own[:40] + passage + own[40:]
        if i % 5 == 0:
            base = out[-1][1].split()
            for _ in range(max(1, len(base) // 60)):
                base[rng.randrange(len(base))] = "edited"
            own = base
        if i % 7 == 0:
            own = own + own
        out.append((i, " ".join(own)))
    out += [out[-1], out[-1], (50, out[-1][1])]
    return out


def documents(spark, pairs, seed=2):
    rng = random.Random(seed)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), None if t is None else len(t), 1, "r", "s", "p", 2, 3, "h") for i, t in pairs]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def key(x):
    return (x is not None, x if x is not None else 0)
