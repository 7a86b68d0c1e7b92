"""Exact dedup by a content sort, in DataFrame operations only.

Rows are range-partitioned by sampled splitters on (first characters, SHA-256) of the normalised text, so a
splitter has a bounded size, sorted externally within partitions, and neighbours are compared by their
whole texts: the window's partition ends where the text differs from the one before.

A text that a bounded sample shows to hold more than a quarter of a partition's share of rows is *hot*.
Its rows are salted by id into several ranges, and its totals come from one aggregation that is combined
before the shuffle; there are at most ``4 * partitions`` hot texts, so their totals are broadcast.  The
sample only decides where rows go, never the result.

Defined results: a null text equals an empty one; a null id loses to any other id; of rows that repeat
both id and text one is kept; an empty table gives an empty result; with ``carry`` all columns of the
input stay, whatever their names, and the operator's own values are in the struct column ``out``, which
replaces an input column of that name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import shuffle_partitions

PREFIX_CHARS = 16
SAMPLE_PER_PARTITION = 200
_HOT = SAMPLE_PER_PARTITION // 4


def normalised(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _hot_texts(keyed: DataFrame, partitions: int) -> DataFrame | None:
    """``digest, chunks`` of the hot texts: at most ``4 * partitions`` rows."""
    spark, rows = keyed.sparkSession, keyed.count()
    if not rows:
        return None
    fraction = min(1.0, SAMPLE_PER_PARTITION * partitions / rows)
    seen = keyed.sample(fraction, seed=17).groupBy("_fs_digest").count().where(F.col("count") >= _HOT).collect()
    if not seen:
        return None
    chunks = lambda n: max(2, -(-4 * n // SAMPLE_PER_PARTITION))
    return spark.createDataFrame([(r[0], chunks(r[1] if fraction < 1 else r[1] * SAMPLE_PER_PARTITION * partitions // rows)) for r in seen], "_fs_digest string, _fs_chunks int")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", carry: bool = False, out: str = "exact_dedup") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``, or with ``carry`` the
    input's columns and a struct ``out`` of these.  ``keep`` is ``smallest`` or ``largest``.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    partitions = shuffle_partitions(docs.sparkSession)
    columns = [c for c in docs.columns if carry and c.lower() != out.lower()]
    text = F.col(text_col)
    norm = normalised(text)
    # the input's columns travel in a struct, where their names cannot meet those used here
    moved = F.struct(*columns).alias("_fs_row") if carry else F.struct(text.alias(text_col)).alias("_fs_row")
    keyed = docs.select(moved, F.col(id_col).alias("_fs_id"), F.substring(norm, 1, PREFIX_CHARS).alias("_fs_prefix"), F.sha2(norm, 256).alias("_fs_digest"))
    best = F.min if keep == "smallest" else F.max
    hot = _hot_texts(keyed.select("_fs_digest"), partitions)
    if hot is not None:
        totals = keyed.select("_fs_id", "_fs_digest").join(F.broadcast(hot), "_fs_digest").groupBy("_fs_digest", "_fs_chunks").agg(best("_fs_id").alias("_fs_best"), F.count("*").alias("_fs_count"))
        keyed = keyed.join(F.broadcast(totals), "_fs_digest", "left")  # 4 * partitions rows at most
        salt = F.when(F.col("_fs_chunks").isNotNull(), F.pmod(F.xxhash64("_fs_id"), F.col("_fs_chunks"))).otherwise(0)
    else:
        keyed = keyed.withColumns({"_fs_best": F.lit(None).cast("long"), "_fs_count": F.lit(None).cast("long")})
        salt = None
    place = ["_fs_prefix", "_fs_digest"]
    if salt is not None:  # a constant would be folded out of the window's keys and not out of the ranges
        keyed, place = keyed.withColumn("_fs_salt", salt.cast("int")), [*place, "_fs_salt"]
    dealt = keyed.repartitionByRange(partitions, *place)
    dealt = dealt.withColumn("_fs_norm", normalised(F.col("_fs_row")[text_col]))
    same = W.partitionBy(*place, "_fs_norm").orderBy(F.col("_fs_id").asc_nulls_last() if keep == "smallest" else F.col("_fs_id").desc_nulls_last())
    whole = same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    dealt = dealt.withColumns({"_fs_rank": F.row_number().over(same), "_fs_first": F.first("_fs_id").over(whole), "_fs_size": F.count(F.lit(1)).over(whole)})
    keep_id = F.coalesce("_fs_best", "_fs_first")
    values = [keep_id.alias("keep_id"), F.coalesce("_fs_count", "_fs_size").alias("group_size"), ((F.col("_fs_rank") == 1) & F.col("_fs_id").eqNullSafe(keep_id)).alias("kept"), F.col("_fs_digest").alias("text_sha256")]
    if carry:
        return dealt.select(*(F.col("_fs_row")[c].alias(c) for c in columns), F.struct(*values).alias(out))
    return dealt.select(F.col("_fs_id").alias("doc_id"), *values)
