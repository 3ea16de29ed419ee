"""Sharding by sampled splitters.

Records are keyed by the hash of their text, so equal texts lie side by side.  A size-weighted key
sample of bounded size gives quantile splitters for many fine ranges; exact byte counts of the
ranges follow, and ranges that came out overfull are subdivided: a hot group of equal texts by the
hash of the id, all other groups whole, by another hash of the text.  Byte offsets run through the ranges in key order: totals of
the ranges on top (a bounded table), a window inside each small range.  The offset decides the
shard, so sizes are near equal whatever the sample held.  The law is `bytes`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes in a fine range, the least and the most ranges there are, and sampled keys for each range.
RANGE_BYTES, RANGES, MOST_RANGES, SAMPLED = 1 << 28, 512, 16_384, 32
#: A group of equal texts of up to this share of a shard stays in one shard; a larger one may be split.
WHOLE_GROUP = 0.01


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, shard, slot.

    Size is the UTF-8 bytes of the text plus 1 (a null text: 1, with CRC 0).  A null id is a key like
    any other; repeated rows count each.  Columns beside id and text are ignored.  An empty table
    gives no rows.  Slots run from 0 in each shard, in key order.  Reruns give the same shards.  The number
    of ranges follows the bytes there are, within fixed bounds.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rec = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("h"),
        F.xxhash64(F.lit(3), F.col(id_col)).alias("g"),
    )
    rec = written(rec, "records")
    total = rec.agg(F.sum("size")).first()[0] or 1
    ranges = ranges or min(MOST_RANGES, max(RANGES, total // RANGE_BYTES))
    sample = SAMPLED * ranges
    # A record is drawn with a chance in proportion to its size, by a hash of its own: reruns agree.
    lot = F.shiftrightunsigned(F.xxhash64("g", "h"), 11).cast("double") / float(1 << 53)
    drawn = rec.filter(lot < F.col("size") * (sample / total)).select("h")
    keys = np.sort(np.array([r.h for r in drawn.collect()], dtype=np.int64))  # about `sample` keys at any input size
    cuts = np.unique(keys[np.arange(1, ranges) * len(keys) // ranges]) if len(keys) else keys

    @F.pandas_udf("int")
    def range_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, h.to_numpy(), side="left").astype(np.int32))

    rec = rec.withColumn("r", range_of("h"))
    most = 4 * max(1, total // ranges)
    fill = rec.groupBy("r").agg(F.sum("size").alias("b"))
    fill = written(fill.select("r", F.ceil(F.col("b") / most).cast("long").alias("parts")), "fill")
    # Groups of over half a part, of which there can be no more than ranges / 2; all rows of other groups go to one part.
    over = F.broadcast(fill.filter("parts > 1"))
    hot = rec.join(over, "r").groupBy("h").agg(F.sum("size").alias("b"))
    hot = written(hot.filter(F.col("b") > most // 2).select("h", F.ceil(F.col("b") * 2 / most).cast("long").alias("pieces")), "hot")
    rec = rec.join(F.broadcast(fill), "r").join(F.broadcast(hot), "h", "left")
    by_text = F.when(F.col("parts") > 1, F.pmod(F.xxhash64(F.lit(9), F.col("h")), F.col("parts"))).otherwise(F.lit(0))
    # Parts of a hot group follow those of its range; groups that meet in one are told apart by the order inside.
    part = F.when(F.col("pieces").isNotNull(), F.col("parts") + F.pmod(F.shiftright("g", 20), F.col("pieces"))).otherwise(by_text)
    rec = rec.withColumn("one", F.col("pieces").isNull()).withColumn("part", part)

    # Bytes before each part: their number is bounded by the number of ranges, as parts and pieces of hot groups are.
    sums = rec.groupBy("r", "part").agg(F.sum("size").alias("b"))
    run = Window.orderBy("r", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("r", "part", F.coalesce(F.sum("b").over(run), F.lit(0)).alias("before"))
    inside = Window.partitionBy("r", "part").orderBy("h", "g", "doc_id")
    own = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    group = Window.partitionBy("r", "part", "h")
    rec = rec.join(F.broadcast(sums), ["r", "part"]).withColumn("at", F.col("before") + own)
    rec = rec.withColumn("gb", F.sum("size").over(group)).withColumn("g0", F.min("at").over(group))
    whole = F.col("one") & (F.col("gb") <= WHOLE_GROUP * total / shards)
    middle = F.when(whole, F.col("g0") + F.col("gb") / 2).otherwise(F.col("at") + F.col("size") / 2)
    rec = rec.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / total)).cast("int"))
    rec = rec.withColumn("k", F.row_number().over(Window.partitionBy("r", "part", "shard").orderBy("h", "g", "doc_id")) - 1)
    rec = written(rec.select("doc_id", "size", "text_crc32", "shard", "r", "part", "k"), "placed")
    many = rec.groupBy("shard", "r", "part").agg(F.count("*").alias("n"))
    many = many.select("shard", "r", "part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("r", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    rec = rec.join(F.broadcast(many), ["shard", "r", "part"])
    return rec.select("doc_id", "size", "text_crc32", "shard", (F.col("ahead") + F.col("k")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the whole records below path/shard=N and returns the assignment. Ids are taken as unique here."""
    placed = written(assign_shards(docs, shards, id_col, text_col), "shards")
    key = placed.select(F.col("doc_id").alias(id_col), "shard", "slot")
    docs.join(key, id_col).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
