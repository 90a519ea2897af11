"""Near-duplicate vectors by an exact metric range join.

The metric is the angle between vectors; two link when it is at most ``arccos(threshold)``, called eps. Pivots drawn
from the data partition the vectors: a vector's home is its nearest pivot. Two linked vectors x, y with homes p < q
meet in p's cell, and the triangle inequality bounds which vectors of other homes must be replicated there:

    angle(y, p) <= angle(y, q) + 2 eps    and    angle(y, p) <= eps + radius of p's cell

Cells join independently, and a cell of any size is dealt out as pairs of blocks of at most about ``BLOCK`` vectors, so no
task holds more than two blocks. Equal vectors are joined once and counted by their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, shuffle_partitions
from millrace.llm.components import components
from millrace.llm.vectors import matrix, usable

BLOCK = 2048
MAX_PIVOTS = 64
#: Angles come from rounded products; replication is decided with this much to spare.
SLACK = 1e-6


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _linked_parts(link: np.ndarray) -> np.ndarray:
    """Component number of each row and column of a boolean link matrix (rows first, then columns)."""
    rows, cols = link.shape
    part = np.full(rows + cols, -1, dtype=np.int64)
    for start in np.flatnonzero(link.any(axis=1)):
        if part[start] >= 0:
            continue
        front, part[start] = np.array([start]), start
        while len(front):
            hit = np.zeros(cols, dtype=bool)
            for at in range(0, len(front), 512):
                hit |= link[front[at : at + 512]].any(axis=0)
            hit &= part[rows:] < 0
            part[rows:][hit] = start
            new = link[:, hit].any(axis=1) & (part[:rows] < 0)
            part[:rows][new] = start
            front = np.flatnonzero(new)
    return part


def link_vectors(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links`` (other rows at cosine >= threshold), ``component_id`` (least id
    reachable by links) and ``kept`` (the id is its component's).

    Vectors that cannot be compared (see ``vectors.usable``) link with nothing, not even with an equal one. Repeated
    rows are vectors of their own that link with each other; null ids are counted as vectors, their component is null
    and they are not kept; an empty table gives an empty table; extra columns are not carried.
    """
    spark = df.sparkSession
    eps = math.acos(threshold)
    every = df.select(df[id_col].cast("long").alias("vec_id"), df[vec_col].alias("embedding"))
    good, dim = usable(every)
    # one row per distinct vector; -0.0 and 0.0 are one value for grouping and joining alike
    classes = cut(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("class", F.xxhash64("embedding", F.lit("class"))))
    n = classes.count()
    n_pivots = max(1, min(MAX_PIVOTS, math.ceil(n / BLOCK)))
    found = classes.orderBy(F.xxhash64("class"), "class").select("embedding").limit(n_pivots).toArrow()  # at most MAX_PIVOTS vectors
    pivots = matrix(found["embedding"], dim) if n else np.zeros((1, 1))
    parts = shuffle_partitions(spark)

    def placed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        angle = _angles(matrix(batch.column("embedding"), dim), pivots)
        home = angle.argmin(axis=1)
        return angle, home, angle[np.arange(len(home)), home]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle, home, near = placed(batch)
            for p in np.unique(home):
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([int((home == p).sum())]), pa.array([float(near[home == p].max())])], names=["cell", "n", "radius"])

    cells = {r["cell"]: (r["n"], r["radius"]) for r in classes.mapInArrow(measure, "cell long, n long, radius double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()}  # one row per pivot
    size = np.array([cells.get(p, (0, 0.0))[0] for p in range(len(pivots))])
    radius = np.array([cells.get(p, (0, 0.0))[1] for p in range(len(pivots))])
    home_blocks = np.maximum(1, -(-size // BLOCK))
    # a window may hold as many as all vectors of later homes
    window_blocks = np.maximum(1, -(-(size.sum() - size.cumsum()) // BLOCK))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies of each vector for the block pairs it takes part in: (task, side) with side 0 for rows, 1 for columns,
        2 for both (a block joined with itself)."""
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                angle, home, near = placed(batch)
                code = batch.column("class").to_numpy().astype(np.int64).view(np.uint64)
                row, task, side = [], [], []

                def add(rows, cell, i, j, s, is_window):
                    row.append(rows)
                    task.append(((cell * 2 + is_window) << 48) + (np.asarray(i, dtype=np.int64) << 24) + j)
                    side.append(np.full(len(rows), s))

                for p in np.unique(home):
                    own = np.flatnonzero(home == p)
                    hb, wb = int(home_blocks[p]), int(window_blocks[p]) if p < len(pivots) - 1 else 0
                    mine = (code[own] % np.uint64(hb)).astype(np.int64)
                    for k in range(hb):
                        lo, hi = np.minimum(mine, k), np.maximum(mine, k)
                        for s, sel in ((2, mine == k), (0, mine < k), (1, mine > k)):
                            if sel.any():
                                add(own[sel], p, lo[sel], hi[sel], s, 0)
                    for k in range(wb):
                        add(own, p, mine, np.full(len(own), k), 0, 1)
                for p in range(len(pivots)):
                    guest = np.flatnonzero((home > p) & (angle[:, p] <= near + 2 * eps + SLACK) & (angle[:, p] <= eps + radius[p] + SLACK))
                    if size[p] and len(guest):
                        theirs = ((code[guest] >> np.uint64(20)) % np.uint64(window_blocks[p])).astype(np.int64)
                        for k in range(int(home_blocks[p])):
                            add(guest, p, np.full(len(guest), k), theirs, 1, 1)
                if row:
                    take = pa.array(np.concatenate(row))
                    out = batch.select(["class", "copies", "embedding"]).take(take)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(task)), pa.array(np.concatenate(side).astype(np.int8)), *out.columns], names=["task", "side", "class", "copies", "embedding"])

    def join(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        code, copies = table["class"].to_numpy(), table["copies"].to_numpy()
        a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        own = bool((side == 2).any())
        x = matrix(table["embedding"], dim)
        link = np.zeros((len(a), len(b)), dtype=bool)
        for at in range(0, len(a), 512):
            link[at : at + 512] = x[a[at : at + 512]] @ x[b].T >= threshold
        if own:
            link[np.arange(len(a)), np.arange(len(a))] = False
        if not link.any():
            return pa.table({"class": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        part = _linked_parts(link)
        head = code[a[part[part >= 0]]]
        of = np.concatenate([code[a], code[b]])
        n = np.concatenate([link @ copies[b], np.zeros(len(b), np.int64) if own else copies[a] @ link])
        seen = part >= 0
        return pa.table({"class": of[seen], "n": n[seen].astype(np.int64), "to": head})

    tasks = classes.select("class", "copies", "embedding").mapInArrow(deal, "task long, side byte, class long, copies long, embedding array<" + dict(good.dtypes)["embedding"][6:-1] + ">")
    links = cut(tasks.repartition(max(parts, 1), "task").groupBy("task").applyInArrow(join, "class long, n long, to long"))
    counts = links.groupBy("class").agg(F.sum("n").alias("n"))
    parts_of = components(links, "class", "to")
    # the component's name is its least id
    named = classes.select("class", "rep", "embedding", "copies").join(counts, "class", "left").join(parts_of, F.col("class") == F.col("node"), "left").withColumn("part", F.coalesce("component", "class"))
    named = cut(named.select("embedding", "copies", "n", "rep", "part"))
    least = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    result = named.join(least, "part").select(F.col("embedding").alias("__key"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    usable_row = every.join(result, F.col("embedding") == F.col("__key"), "left")
    component = F.coalesce("component_id", "vec_id")
    return usable_row.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
