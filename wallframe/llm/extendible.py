"""Sharding by extendible hashing, in column expressions.

A directory is indexed by the leading bits of a key's hash.  A bucket above the byte limit is
split on its next bit, others stay as they are, so depths differ.  Sizes are counted once at a
depth that fits the total, summed up along all shorter prefixes, and each cell takes its shortest
prefix that fits; only rows of cells that are still too large are counted again, some bits deeper.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize, union_all

BITS = 60
LIMIT = 1 << 20
STEP = 4
DEEPEST_START = 24


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; a null key counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def extendible_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", *, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes, shard_rows, over_limit: one row per row of ``docs``.

    ``shard`` is the bit string of the bucket's prefix (empty if all rows fit one).  Bytes are those
    of the text; null is none.  Rows of one key share all bits: a bucket that holds a single key
    is not split, and ``over_limit`` says so where it is too large.
    """
    sized, _ = materialize(
        docs.select(
            F.col(key).alias("doc_id"),
            F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
            key_hash(F.col(key)).alias("h"),
        )
    )
    total = sized.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    low, high = 0, min(DEEPEST_START, max(0, math.ceil(math.log2(max(1, total / limit)))) + 2)
    rows, done = sized, []
    while True:
        placed = rows.withColumn("cell", F.shiftright("h", BITS - high))
        cells = placed.groupBy("cell").agg(
            F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        lines = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
        lines = lines.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        sums = lines.groupBy("depth", "prefix").agg(
            F.sum("n_bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"), (F.min("low") == F.max("high")).alias("single")
        )
        fits = (F.col("shard_bytes") <= limit) | F.col("single")
        leaf = F.min_by(F.struct("prefix", "shard_bytes", "shard_rows"), F.col("depth"))
        met = lines.select("cell", "depth", "prefix").join(sums.filter(fits), ["depth", "prefix"])
        leaves = met.groupBy("cell").agg(F.min("depth").alias("depth"), leaf.alias("leaf"))
        found, _ = materialize(placed.join(leaves, "cell", "left").select("doc_id", "n_bytes", "h", "depth", "leaf.*"))
        done.append(found.filter(F.col("depth").isNotNull()))
        rows = found.filter(F.col("depth").isNull()).select("doc_id", "n_bytes", "h")
        if high == BITS or rows.isEmpty():
            break
        low, high = high + 1, min(BITS, high + STEP)
    bits = F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))
    return union_all(done).select(
        "doc_id",
        "n_bytes",
        F.when(F.col("depth") == 0, F.lit("")).otherwise(bits).alias("shard"),
        F.col("depth").cast("int").alias("depth"),
        "shard_bytes",
        "shard_rows",
        (F.col("shard_bytes") > limit).alias("over_limit"),
    )


def directory(shards: DataFrame) -> DataFrame:
    """slot, shard: every entry of the directory at its global depth, the largest depth of a shard."""
    leaves = shards.select("shard", "depth").distinct()
    deepest = leaves.agg(F.max("depth").alias("global"))
    spread = leaves.join(F.broadcast(deepest)).withColumn("free", F.col("global") - F.col("depth"))
    tail = F.explode(F.expr("sequence(0L, shiftleft(1L, free) - 1)"))
    head = F.coalesce(F.conv("shard", 2, 10).cast("bigint"), F.lit(0))
    return spread.select("shard", "free", head.alias("head"), tail.alias("tail")).select(F.expr("shiftleft(head, free) + tail").alias("slot"), "shard")
