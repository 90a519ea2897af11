"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the key ``-ln(u) / w``, u uniform from a hash of its id, w its quality weight; a source's documents
in ascending order of the key are a weighted sample without replacement of any length. A source's target is met by
complete epochs over all its documents, then by the documents that come first in that order, prefix-summed up to the
rest of the budget; the one document at which the budget ends is taken in part.

Texts are read once: ids, sources, sizes and keys are cut off and all further steps work on them. No source is ever sorted in one
task: sizes are summed by source and slice of the key's range, a running sum over the slices finds the one in which the
budget ends, and that slice is sliced again until it holds few documents, whatever the weights; only those are sorted.
What is found is one place in the order for each source, and every document is held against its source's place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD_PATTERN, broadcast_if_small, cut
from millrace.operators.ordering import placed

#: Slices into which a key range is cut at a time.
SLICES = 4096
#: Documents of a slice that are sorted.
FEW = 10_000


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Sizes (source, n and more, one row per source) with the source's ``target`` words. Sources are taken by code point, null
    last; weights repeat. The budget is ``share`` of all sizes; a target stops at ``cap`` times its source's size and
    the excess is shared again by weight among the others, until no target is above its cap. Sources are never
    gathered: what a unit of weight gets rises from pass to pass over them, and a pass gives two sums."""
    places = placed(sizes.orderBy(F.col("source").asc_nulls_last()), "__rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__rank") - 1) % len(weights) + 1).cast("int"))
    rows = cut(places.withColumn("__weight", weight).withColumn("__full", F.col("n") * float(cap)).drop("__rank"))
    budget = share * (rows.agg(F.sum("n")).first()[0] or 0)
    unit = 0.0
    while True:
        is_full = F.lit(unit) * F.col("__weight") > F.col("__full")
        full, free = rows.agg(F.sum(F.when(is_full, F.col("__full"))), F.sum(F.when(~is_full, F.col("__weight")))).first()
        new = (budget - (full or 0)) / free if free else float("inf")
        if new <= unit:
            break
        unit = new
    target = F.least(F.col("__full"), F.lit(unit) * F.col("__weight"))
    return rows.withColumn("target", target).drop("__weight", "__full")


def n_words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def uniform(doc_id: str, seed: str) -> Column:
    """In (0, 1): 48 bits of the MD5 of the seed and the id's decimal text. Null ids draw like the empty text."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def text_quality(text: str | Column = "text") -> Column:
    """A document's quality weight, from 0.05 to 1: how much of its text is letters and blanks. Three times the share of
    other characters is taken off; null and empty texts weigh least."""
    text = F.col(text) if isinstance(text, str) else text
    other = F.length(F.regexp_replace(text, r"[\p{L}\s]+", "")) / F.length(text)
    return F.coalesce(F.when(F.length(text) > 0, F.greatest(F.lit(0.05), 1 - 3 * other)), F.lit(0.05))


def _place(*columns: str) -> Column:
    return F.struct(*(F.col(c) for c in columns))


def _ends(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source of the plan (source, rest: words of its incomplete epoch, high: its largest key) the place in its order at
    which the budget ends: (__of, __end_key, __end_id, __end_size, __equal, __whole, __words); there stand so many equal
    documents, of which the first are taken whole and so many words of one more."""

    def within(ranges: DataFrame) -> DataFrame:
        """Documents in their source's range of keys."""
        return drawn.join(broadcast_if_small(ranges), F.col("source").eqNullSafe(F.col("__of")) & F.col("__key").between(F.col("__lo"), F.col("__hi")))

    by_source = Window.partitionBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    last = (F.col("__before") <= F.col("__rest")) & (F.col("__before") + F.col("n") > F.col("__rest"))
    ranges = plan.select(F.col("source").alias("__of"), F.col("rest").alias("__rest"), F.lit(0.0).alias("__lo"), F.col("high").alias("__hi"), F.lit(0).cast("long").alias("__base"))
    found = None
    while True:
        width = F.col("__hi") - F.col("__lo")
        part = F.when(width > 0, F.least(F.floor((F.col("__key") - F.col("__lo")) / width * SLICES), F.lit(SLICES - 1))).otherwise(0).cast("int")
        slices = within(ranges).groupBy("__of", "__rest", "__base", part.alias("__slice"))
        slices = slices.agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("__key").alias("low"), F.max("__key").alias("high"))
        before = F.coalesce(F.sum("n").over(by_source.orderBy("__slice")), F.lit(0)) + F.col("__base")
        ends = cut(slices.withColumn("__before", before).where(last))
        few = (F.col("rows") <= FEW) | (F.col("low") == F.col("high"))
        ranges, done = (ends.where(c).select("__of", "__rest", F.col("low").alias("__lo"), F.col("high").alias("__hi"), F.col("__before").alias("__base")) for c in (~few, few))
        found = done if found is None else found.union(done)
        if ranges.isEmpty():
            break
    equal = within(found).groupBy("__of", "__rest", "__base", "__key", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows")).withColumn("n", F.col("size") * F.col("rows"))
    before = F.coalesce(F.sum("n").over(by_source.orderBy("__key", "doc_id", "size")), F.lit(0)) + F.col("__base")
    ends = equal.withColumn("__before", before).where(last).withColumn("left", F.floor(F.col("__rest") - F.col("__before")).cast("long"))
    return ends.select("__of", F.col("__key").alias("__end_key"), F.col("doc_id").alias("__end_id"), F.col("size").alias("__end_size"), F.col("rows").alias("__equal"), F.expr("left div size").alias("__whole"), F.expr("left % size").alias("__words"))


def mix(df: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, quality: Column | None = None, seed: str = "mix", keep: Sequence[str] = (), size: Column | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``source``, ``size`` (words), ``source_size``, ``target``, ``taken`` (words
    taken, repeats counted), ``epochs`` (complete copies) and ``partial`` (words of one more copy, at most one document
    of a source), then the columns of ``keep``, for which the input is read a second time.

    ``size`` are the words (default: counted in ``text``), ``quality`` is a positive weight (null or less than 0.01: 0.01).
    Null and empty texts have size 0 and are taken 0 times; null sources are a source of their own, last in order; repeated
    rows are documents of their own (those at the end of a budget that are equal in id and size are told apart in one task);
    ids that tie by key stand in order, null first; sources without words have target 0; an empty table gives an empty
    table; other columns, whatever their names, play no part. Reruns agree: draws are hashes of ids.
    """
    weight = F.greatest(F.coalesce(quality if quality is not None else F.lit(1.0), F.lit(0.01)).cast("double"), F.lit(0.01))
    size = size if size is not None else n_words("text")
    rows = df.select("doc_id", "source", *keep, size.cast("long").alias("size"), (-F.log(uniform("doc_id", seed)) / weight).alias("__key"))
    drawn = cut(rows.select("doc_id", "source", "size", "__key"))
    plan = targets(drawn.groupBy("source").agg(F.sum("size").alias("n"), F.max("__key").alias("high")), weights, share, cap)
    times = F.floor(F.col("target") / F.col("n"))
    times = F.when(F.col("n") > 0, F.least(times - (times * F.col("n") > F.col("target")).cast("long"), F.lit(int(cap)))).otherwise(0).cast("long")
    plan = cut(plan.withColumn("__epochs", times).withColumn("rest", F.col("target") - F.col("__epochs") * F.col("n")))
    ends = cut(_ends(drawn, plan.where("n > 0")))
    plan = plan.select(F.col("source").alias("__source"), F.col("n").alias("source_size"), "target", "__epochs")
    plan = plan.join(ends, F.col("__source").eqNullSafe(F.col("__of")), "left").drop("__of")
    out = (rows if keep else drawn).join(broadcast_if_small(cut(plan)), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    here, end = _place("__key", "doc_id", "size"), _place("__end_key", "__end_id", "__end_size")
    at_end = F.col("__end_key").isNotNull() & (here == end)
    out = out.withColumn("partial", F.when(F.col("__end_key").isNotNull() & (here < end), F.col("size")).when(at_end, F.when(F.col("__whole") > 0, F.col("size")).otherwise(F.col("__words"))).otherwise(0))
    if not ends.where("__equal > 1").isEmpty():  # equal documents at an end: the first are taken whole, one in part
        tied = F.coalesce(at_end & (F.col("__equal") > 1), F.lit(False))
        place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
        own = F.when(place <= F.col("__whole"), F.col("size")).when(place == F.col("__whole") + 1, F.col("__words")).otherwise(0)
        out = out.where(~tied).unionByName(out.where(tied).withColumn("partial", own))
    whole = (F.col("partial") >= F.col("size")) & (F.col("size") > 0)
    return out.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("__epochs") * F.col("size") + F.col("partial")).alias("taken"),
        (F.col("__epochs") + whole.cast("long")).alias("epochs"),
        F.when(whole, 0).otherwise(F.col("partial")).cast("long").alias("partial"),
        *keep,
    )


def apply(mixed: DataFrame, row: str) -> DataFrame:
    """The mix as documents: the struct column ``row`` (with a field ``text``) of each taken document once per epoch, then once
    more with its first words as ``text`` if it is taken in part. Documents that are not taken, among them null and empty
    ones, go; repeated rows stay as often as they are taken; an empty table gives an empty table."""
    first = F.array_join(F.slice(F.filter(F.split(F.col(row)["text"], r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.col("partial").cast("int")), " ")
    copies = F.concat(F.array_repeat(F.lit(True), F.col("epochs").cast("int")), F.array_repeat(F.lit(False), (F.col("partial") > 0).cast("int")))
    out = mixed.where(F.col("taken") > 0).withColumn("__whole", F.explode(copies))
    return out.select(F.when(F.col("__whole"), F.col(row)).otherwise(F.col(row).withField("text", first)).alias("row")).select("row.*")
