"""Mixing sources to target weights by capped water-filling.

Every source gets its weight's share of the mix, but at most ``max_epochs`` times its size; what a capped source can't
take goes to the others by weight until all fit. A source's documents are then repeated: whole repetitions of all, and
of what remains one more repetition of documents in a seeded order, the last of which is taken in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import WORD, fresh, staged, text_of

_BUCKETS = 4096  # of the seeded order; only the bucket in which a source's last repetition ends is sorted


def targets(sizes: DataFrame, weights: Sequence[float], total_share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to a table (source, source_size), a row per source.

    With sources in order of cap over weight, a source is capped if the share that it would get, once all before it are
    capped, exceeds its cap; the first that is not gives the level of all that follow.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    known = sizes.select("source", "source_size", weight.alias("_w")).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    past, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(every) * F.lit(float(total_share)) - F.coalesce(F.sum("_cap").over(past), F.lit(0.0))
    level = rest / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(past), F.lit(0.0)))
    leveled = known.withColumn("_level", level).withColumn("_n", F.row_number().over(order)).withColumn("_free", F.col("_level") < F.col("_ratio"))
    settled = leveled.withColumn("_first", F.min(F.when(F.col("_free"), F.col("_n"))).over(every)).withColumn("_all", F.min(F.when(F.col("_n") == F.col("_first"), F.col("_level"))).over(every))
    capped = F.col("_first").isNull() | (F.col("_n") < F.col("_first"))
    return settled.select("source", "source_size", F.when(capped, F.col("_cap")).otherwise(F.col("_all") * F.col("_w")).alias("target"))


def _drawn(df: DataFrame, sized: list, weights: Sequence[float], total_share: float, max_epochs: float, seed: int) -> DataFrame:
    """Rows of ``sized`` (columns of ``df``: _id, source, size, and any others) with source_size, target, taken, epochs and part."""
    spin = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")
    rows = staged(df.select(*sized).withColumn("_spin", spin), "mixing").withColumn("_bucket", F.shiftright("_spin", 48).cast("int"))
    others = [c for c in rows.columns if c not in ("_id", "source", "size", "_spin", "_bucket")]
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_size"))
    aims = targets(buckets.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, total_share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    aims = aims.withColumn("_whole", whole).withColumn("_extra", F.greatest(F.lit(0), F.rint("target").cast("bigint") - F.col("_whole") * F.col("source_size")))
    so_far = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = buckets.withColumn("_before", F.coalesce(F.sum("_size").over(so_far), F.lit(0)))
    # null sources meet by a key that no name has
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias("_key")
    ends = filled.select(key("source"), "_bucket", "_before", "_size").join(aims.select("*", key("source")).drop("source"), "_key")
    cut = ends.groupBy("_key", "source_size", "target", "_whole").agg(
        F.min(F.when(F.col("_before") + F.col("_size") > F.col("_extra"), F.struct("_bucket", (F.col("_extra") - F.col("_before")).alias("left")))).alias("_cut")
    )
    # a row per source, written so that its size is known when it is joined: rows stay where they are unless sources are very many
    cut = staged(cut, "mixing-cuts")
    drawn = rows.select("*", key("source")).join(cut, "_key").select("_id", "_key", "size", "_spin", "source_size", "target", "_whole", *others, F.coalesce(F.col("_bucket") - F.col("_cut._bucket"), F.lit(-1)).alias("_side"), F.coalesce("_cut.left", F.lit(0)).alias("_left"))
    within = Window.partitionBy("_key").orderBy("_spin", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    in_cut = drawn.where("_side = 0").withColumn("_more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.coalesce(F.sum("size").over(within), F.lit(0)))))
    rest = drawn.where("_side <> 0").withColumn("_more", F.when(F.col("_side") < 0, F.col("size")).otherwise(F.lit(0)))
    both = in_cut.unionByName(rest)
    full = (F.col("_more") == F.col("size")) & (F.col("size") > 0)
    return both.select(
        "_id",
        *others,
        "size",
        "source_size",
        "target",
        (F.col("_whole") * F.col("size") + F.col("_more")).alias("taken"),
        (F.when(F.col("size") > 0, F.col("_whole")).otherwise(F.lit(0)) + full.cast("int")).cast("int").alias("epochs"),
        F.when(full, F.lit(0)).otherwise(F.col("_more")).alias("part"),
    )


def mix(df: DataFrame, weights: Sequence[float] = (3, 1, 2), total_share: float = 1.5, max_epochs: float = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: the id, size (words), source_size, target, taken (words, repeats counted), epochs (whole repetitions), part (words of one more, partial repetition).

    Sources stand in order of code points, null last as a source of its own; ``weights`` repeat over them. A source's
    taken words are its target, rounded. A null or empty text has size 0 and is never taken; with no words at all, all
    targets are 0. The order is a digest of seed and id, so reruns agree; rows that repeat an id are interchangeable.
    Sizes are staged. Everything that brings sources together has a row per source.
    """
    sized = [df[id_col].alias("_id"), df[source_col].cast("string").alias("source"), F.regexp_count(text_of(df, text_col), F.lit(WORD)).cast("bigint").alias("size")]
    return _drawn(df, sized, weights, total_share, max_epochs, seed).withColumnRenamed("_id", id_col)


def draw(df: DataFrame, weights: Sequence[float] = (3, 1, 2), total_share: float = 1.5, max_epochs: float = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``df`` as often as ``mix`` says, and partial repetitions cut to their first words (joined by spaces).

    What is decided stays with the row, so rows without an id, or with one that others have too, are drawn like any others.
    """
    all_, copy = "_row", "_copy"
    sized = [df[id_col].alias("_id"), df[source_col].cast("string").alias("source"), F.regexp_count(text_of(df, text_col), F.lit(WORD)).cast("bigint").alias("size"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(all_)]
    copies = _drawn(df, sized, weights, total_share, max_epochs, seed).where("taken > 0").withColumn(copy, F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    partial = F.col(copy) == F.col("epochs")
    kept = copies.where(~partial | (F.col("part") > 0))
    text = F.coalesce(F.col(all_)[text_col].cast("string"), F.lit(""))
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")
    return kept.select(*[(F.when(partial, cut).otherwise(F.col(all_)[c]) if c == text_col else F.col(all_)[c]).alias(c) for c in df.columns])
