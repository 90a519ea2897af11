"""Iterations: a driver loop over distributed state, whose lineage is cut by writing it to the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder is the session's ``spark.checkpoint.dir``; one is made only where none is set and all runs in one
    process. On a cluster a folder of the driver's machine is no shared one: an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="millrace-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint reliably, in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new place beside the checkpoints, deleted when the driver's process ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{prefix}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have ended
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def bulk(initial: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, done: Callable[[DataFrame, DataFrame], bool] | None = None, every: int = 2) -> DataFrame:
    """Apply ``step`` to the whole state ``rounds`` times, or until ``done(old, new)``. Lineage is cut every few rounds."""
    state = initial
    for n in range(1, rounds + 1):
        new = step(state)
        if done is not None or n % every == 0:
            new = cut_lineage(new)
        if done is not None and done(state, new):
            return new
        state = new
    return state


def delta(solution: DataFrame, workset: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], key: str, value: str, better: Callable[[Column, Column], Column] = lambda new, old: new < old, rounds: int | None = None) -> DataFrame:
    """Delta iteration over a solution (key, value) and a workset of changed (key, value) rows.

    Each round ``step(workset, solution)`` proposes (key, value) rows, the best of which by key are kept where ``better``
    than the solution's; those are merged into it and are the next workset. Ends when nothing improves, however many rounds
    that takes, or with an error after ``rounds`` if they are given."""
    least = lambda df: df.groupBy(key).agg(F.min(value).alias("__new"))
    solution, workset = cut_lineage(solution), cut_lineage(workset)
    for _ in count() if rounds is None else range(rounds):
        proposed = least(step(workset, solution))
        changed = proposed.join(solution, key).where(better(F.col("__new"), F.col(value))).select(key, F.col("__new").alias(value))
        workset = cut_lineage(changed)
        if workset.isEmpty():
            return solution
        update = workset.withColumnRenamed(value, "__new")
        solution = cut_lineage(solution.join(update, key, "left").select(key, F.coalesce("__new", value).alias(value)))
    raise RuntimeError(f"no fixed point within {rounds} rounds")
