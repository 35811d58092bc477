"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts, an external sort places equal texts side by side, and the window
over full texts compares neighbours. The splitters are cut from a bounded key (a prefix and a hash of the text), so
that sampling brings no whole texts to the driver; rows with the same text have the same key and so the same range.

A text that many rows share would still be one range. Hashes that hold more than a quarter of a range's fair share of
all rows therefore get a salt from the row's id in the key: copies are first brought together within each salt, in
separate ranges, then the salts' results (one row each) are merged. There can't be more such hashes than four for each
range (or 200), which bounds what is broadcast.

``drop_copies`` sends whole rows through the sort, so a verdict never has to find its row again: every row is shuffled
once, whatever the number of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import staged, text_of

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_HOT = 200
_PREFIX = 24


def normalised(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    # lower() changes only A-Z where every character is one byte, and is much faster there
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _hot(hashes: DataFrame, total: int, n: int) -> DataFrame:
    """_hash and _hot (true) of hashes that hold more than a quarter of a range's fair share of ``total`` rows."""
    return hashes.groupBy("_hash").count().where(F.col("count") * max(LEAST_HOT, 4 * n) > F.lit(total)).where("count > 1").select("_hash", F.lit(True).alias("_hot"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", partitions: int | None = None) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``min`` or ``max``: which id of a group of equal texts stays. A null text is an empty one, and empty
    texts are equal to each other. Rows that repeat both id and text count in group_size, and one of them is kept.
    A null id never stays while its group has another. An empty table gives an empty result. Columns besides the two
    are not read. The result is staged in the shared folder.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(df[id_col].cast("bigint").alias("_id"), normalised(text_of(df, text_col)).alias("_norm")).withColumn("_hash", F.xxhash64("_norm"))
    total = df.count()
    hot = _hot(rows, total, n)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(4 * n))).otherwise(F.lit(0))
    keyed = rows.join(F.broadcast(hot), "_hash", "left").select("_id", "_norm", "_hash", F.col("_hot").isNotNull().alias("_hot"), salt.cast("int").alias("_salt"), F.substring("_norm", 1, _PREFIX).alias("_prefix"))
    ranged = keyed.repartitionByRange(n, "_prefix", "_hash", "_salt")
    best = F.col("_id").desc_nulls_last() if keep == "max" else F.col("_id").asc_nulls_last()
    equal = Window.partitionBy("_prefix", "_hash", "_salt", "_norm").orderBy(best)
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = ranged.select(
        "_id", "_hash", "_hot", F.row_number().over(equal).alias("_rank"), F.first("_id").over(whole).alias("_keep"), F.count(F.lit(1)).over(whole).alias("_size"), F.sha2("_norm", 256).alias("text_sha256")
    )
    found = staged(found, "exact-dedup")
    pick = F.max if keep == "max" else F.min
    merged = found.where("_hot and _rank = 1").groupBy("_hash", "text_sha256").agg(pick("_keep").alias("_all_keep"), F.sum("_size").alias("_all_size"))
    out = found.join(F.broadcast(merged), ["_hash", "text_sha256"], "left")
    keep_id = F.when(F.col("_hot"), F.col("_all_keep")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_all_size", "_size").alias("group_size"),
        ((F.col("_rank") == 1) & F.col("_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", partitions: int | None = None) -> DataFrame:
    """The rows of ``df`` whose text stays, with all columns, one for each group of equal texts; see ``exact_dedup``.

    Rows are judged whole where the sort brings them, so rows that share an id but not the text are judged apart; of rows
    that share both, one stays. A row with a null id stays only if its group has no other. Rows with a hot hash aren't
    sorted: each task keeps its best one of a text, and these few are merged.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm = normalised(F.coalesce(F.col("_row")[text_col].cast("string"), F.lit("")))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")).withColumn("_hash", F.xxhash64(norm))
    # written, so that the texts are hashed once for it
    hot = staged(_hot(rows.select("_hash"), df.count(), n), "hot-hashes")
    back = [F.col("_row")[c].alias(c) for c in df.columns]
    ident = F.col("_row")[id_col].cast("bigint")
    cold = rows.join(F.broadcast(hot), "_hash", "left_anti").withColumn("_prefix", F.substring(norm, 1, _PREFIX))
    best = ident.desc_nulls_last() if keep == "max" else ident.asc_nulls_last()
    equal = Window.partitionBy("_prefix", "_hash", "_norm").orderBy(best, F.col("_row")[text_col])
    # the text goes through the shuffle as it is and is lower-cased again behind it
    ranged = cold.repartitionByRange(n, "_prefix", "_hash").withColumn("_norm", norm)
    out = ranged.withColumn("_rank", F.row_number().over(equal)).where("_rank = 1").select(*back)
    if hot.isEmpty():
        return out
    pick = F.max_by if keep == "max" else F.min_by
    none_last = ident.isNotNull() if keep == "max" else ident.isNull()
    copies = rows.join(F.broadcast(hot), "_hash", "left_semi").groupBy("_hash", F.sha2(norm, 256).alias("_digest"))
    return out.unionByName(copies.agg(pick("_row", F.struct(none_last, ident, F.col("_row")[text_col])).alias("_row")).select(*back))
