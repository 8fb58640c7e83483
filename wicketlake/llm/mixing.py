"""Mixing sources to target weights: exponential keys, sorted within their source, up to a budget of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wicketlake.llm.common import checkpointed, named
from wicketlake.session import written

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """A document's quality weight, 0.1 to 1: the share of its characters that are letters of any script or spaces."""
    other = F.length(F.regexp_replace(text, r"[\p{L}\p{M} ]+", ""))
    share = 1 - other / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.lit(0.1) + F.lit(0.9) * share, F.lit(0.1))


def targets(sources: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) with target.

    Sources in order of code points (null last) take ``weights`` in turn and share ``share`` of all sizes;
    a target stops at ``most`` times its source's size, and the excess goes to the others by weight until
    none is above. That is the level L with sum(min(cap, L * weight)) = the shared amount: in order of cap
    by weight a first run of sources is capped, and L follows from the rest. One row per source takes part
    in the windows, whatever the documents' number.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("_n", F.row_number().over(order))
    s = s.withColumn("_w", F.element_at(turn, ((F.col("_n") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    everything = W.partitionBy(F.lit(1))
    by_cap = W.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("_weights", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_level", F.col("_left") / F.col("_weights"))
    # the first source whose cap is above its part at this level sets the level of all that follow
    s = s.withColumn("_free", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level")))
    s = s.withColumn("_free", F.first("_free", ignorenulls=True).over(by_cap.rowsBetween(W.unboundedPreceding, 0)))
    target = F.when(F.col("_free").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_free") * F.col("_w")))
    return s.select("source", "source_size", target.alias("target"))


def keyed(docs: DataFrame, size: str, quality: str, tie: Sequence[str], source: str, bins: int) -> DataFrame:
    """doc (all columns of ``docs``), _source, _size, _bin and _place; _place orders a source's documents, taken first first.

    The order is that of the exponential -ln(u) / quality. Bins are steps of its logarithm, ``bins`` for each
    doubling: a quality moves that distribution and does not change its shape, so that documents of one
    quality, whatever it is, put less than 1 / ``bins`` of their number into a bin.
    """
    digest = F.md5(F.concat_ws("|", *[F.coalesce(named(c).cast("string"), F.lit("")) for c in tie]))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1) / F.lit(float(2**48 + 2))
    weight = F.when(named(quality) > 0, named(quality).cast("double")).otherwise(F.lit(0.001))
    ties = [named(c).alias(f"t{i}") for i, c in enumerate(tie)]
    d = docs.select(
        F.struct(*[named(c) for c in docs.columns]).alias("doc"),
        named(source).alias("_source"),
        F.coalesce(named(size), F.lit(0)).cast("long").alias("_size"),
        F.struct((-F.log(u) / weight).alias("e"), *ties).alias("_place"),
    )
    return d.withColumn("_bin", F.floor(F.log2("_place.e") * bins).cast("int"))


def decisions(rows: DataFrame, weights: Sequence[int], share: float) -> DataFrame:
    """For each source: _epochs of all its documents, then the documents before bin _cut_bin and, in it, up to _cut."""
    sums = rows.groupBy("_source", "_bin").agg(F.sum("_size").alias("_in_bin"))
    sizes = sums.groupBy(F.col("_source").alias("source")).agg(F.sum("_in_bin").alias("source_size"))
    goal = targets(sizes, weights, share)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = goal.withColumn("_epochs", epochs.cast("long"))
    goal = goal.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    below = W.partitionBy("_source").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    steps = sums.withColumn("_before", F.coalesce(F.sum("_in_bin").over(below), F.lit(0)))
    steps = steps.join(goal.select("source", "_rest"), F.col("_source").eqNullSafe(F.col("source")))
    over = F.col("_before") + F.col("_in_bin") > F.col("_rest")
    edge = steps.where(over).groupBy(F.col("_source").alias("_of")).agg(F.min(F.struct("_bin", "_before", "_rest")).alias("e"))
    edge = edge.select("_of", F.col("e._bin").alias("_cut_bin"), F.col("e._before").alias("_before"), F.col("e._rest").alias("_rest"))
    edge_rows = rows.join(edge, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_bin") == F.col("_cut_bin")))
    same = edge_rows.groupBy("_of", "_place", "_before", "_rest").agg(F.sum("_size").alias("_size"))
    order = W.partitionBy("_of").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    same = same.withColumn("_sum", F.col("_before") + F.sum("_size").over(order))
    cut = same.where(F.col("_sum") - F.col("_size") / F.lit(2.0) <= F.col("_rest"))
    cut = cut.groupBy(F.col("_of").alias("_of_cut")).agg(F.max("_place").alias("_cut"))
    edge = edge.select("_of", "_cut_bin").join(cut, F.col("_of").eqNullSafe(F.col("_of_cut")), "left")
    goal = goal.join(edge, F.col("source").eqNullSafe(F.col("_of")), "left")
    return goal.select(F.col("source").alias("_of"), "source_size", "target", "_epochs", "_cut_bin", "_cut")


def mix(
    docs: DataFrame,
    size: str,
    quality: str,
    tie: Sequence[str],
    source: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    bins: int = 1024,
) -> DataFrame:
    """``docs`` with source_size, target, taken and times: what the mix takes of each document.

    A source's target is met by complete epochs of all its documents, then by a selection for the rest: a
    document's key is u ** (1 / quality) with u from its columns ``tie`` (so reruns agree), and documents
    are taken in descending order of keys until the rest is filled; the one at the boundary is taken if that
    brings the sum nearer. Documents are taken whole; none more than twice.

    The order within a source is never one group: sizes are summed by (source, bin of keys) first, and only
    the documents of each source's bin at the boundary are sorted. What is decided is one row per source.
    Sizes are whole numbers >= 0 (null: 0); a document of size 0 has taken 0. A quality that is null or not
    above 0 counts as 0.001. Rows equal in all of ``tie`` are taken or left together, so give columns that
    tell documents apart. A null source is a source. Input columns with the names of new ones are replaced;
    an empty table gives no rows.
    """
    new = ("source_size", "target", "taken", "times")
    kept = [c for c in docs.columns if c not in new]
    d = keyed(docs, size, quality, tie, source, bins)
    rows = checkpointed(d.select("_source", "_size", "_bin", "_place"))
    plan = written(decisions(rows, weights, share), "mix")
    out = d.join(plan, F.col("_source").eqNullSafe(F.col("_of")))
    in_edge = (F.col("_bin") == F.col("_cut_bin")) & F.col("_cut").isNotNull() & (F.col("_place") <= F.col("_cut"))
    extra = F.col("_cut_bin").isNull() | (F.col("_bin") < F.col("_cut_bin")) | in_edge
    times = F.col("_epochs") + F.when(extra & (F.col("_epochs") < 2), 1).otherwise(0)
    return out.select(
        *[F.col("doc").getField(c).alias(c) for c in kept],
        "source_size",
        "target",
        (times * F.col("_size")).alias("taken"),
        times.cast("int").alias("times"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each document as many times as it is taken."""
    taken = mix(docs, **options).where("times > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("times")))
    rows = taken.select(F.struct(*[named(c) for c in taken.columns]).alias("doc"), copies.alias("copy"))
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in taken.columns])
