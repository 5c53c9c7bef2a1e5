"""Exact duplicates by most-significant-digit radix partitioning; no digest decides equality.

The first digit of a text is its byte length with its first bytes, every later digit the next,
wider run of bytes.  Each round groups the rows of a group by their next digit and keeps only
groups of two or more; a group whose text has ended is a class of equal texts.  Widths grow by a
factor, so a text of n bytes takes O(log n) rounds until the widest digit, and only rows that
still have a partner are carried on, without the bytes already compared.

Groups are counted by partial aggregation before the shuffle and joined back by an adaptive join
that splits hot groups, so a class that holds a third of all rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import discard, materialize, union_all
from .common import text_bytes, unused

FIRST, GROWTH, WIDEST = 64, 16, 1 << 20


def _numbered(groups: DataFrame) -> tuple[DataFrame, int]:
    """Stored groups with a number each; stored, so that the numbers stay as they are."""
    return materialize(groups.withColumn("gid", F.monotonically_increasing_id()))


def duplicate_members(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, first: int = FIRST, growth: int = GROWTH, widest: int = WIDEST
) -> DataFrame:
    """doc_id, text_sha256, keep_id, group_size of every row whose text occurs twice or more.

    ``text_sha256`` is carried for the result only.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("rest"))
    heads = rows.select("doc_id", F.length("rest").alias("n"), F.substring("rest", 1, first).alias("digit"))
    tally = [F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("keep_id")]
    groups, alive = _numbered(heads.groupBy("n", "digit").agg(*tally).filter("size > 1"))
    done: list[DataFrame] = []
    digit = F.substring("rest", 1, first)
    current = rows.select("doc_id", F.sha2("rest", 256).alias("text_sha256"), "rest", F.length("rest").alias("n"), digit.alias("digit"))
    keys, width, end = ["n", "digit"], first, first
    while alive:
        # A merge join at every size: the first one moves each text once, later ones only what is left.
        met = current.join(groups.hint("merge"), keys)
        stage, _ = materialize(
            met.select("doc_id", "text_sha256", "gid", "n", "keep_id", "size", F.expr(f"substring(rest, {width} + 1)").alias("rest"))
        )
        done.append(stage.filter(F.col("n") <= end).select("doc_id", "text_sha256", "keep_id", F.col("size").alias("group_size")))
        width = min(width * growth, widest)
        open_rows = stage.filter(F.col("n") > end).select("doc_id", "text_sha256", "gid", "n", "rest")
        end += width
        current = open_rows.withColumn("digit", F.substring("rest", 1, width))
        narrower, alive = _numbered(
            current.groupBy(F.col("gid").alias("old"), "digit").agg(F.first("n").alias("n"), *tally).filter("size > 1")
        )
        discard(groups)
        groups = narrower.drop("n")
        current = current.withColumnRenamed("gid", "old")
        keys = ["old", "digit"]
    if not done:
        return rows.select("doc_id", F.lit("").alias("text_sha256"), F.col("doc_id").alias("keep_id"), F.lit(0).cast("bigint").alias("group_size")).limit(0)
    return union_all(done)


def exact_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **widths: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Texts are equal if their UTF-8 bytes are; null counts as the empty text.  The row with the
    largest id of a class stays (ids that are null count as smallest).  Of rows that repeat both
    id and text, one is kept.  Columns other than id and text are ignored.
    """
    members = duplicate_members(docs, doc_id, text, **widths).distinct()
    every = (
        docs.select(F.col(doc_id).alias("doc_id"), F.sha2(text_bytes(text), 256).alias("text_sha256"))
        .groupBy("doc_id", "text_sha256")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    found = members.withColumnsRenamed({"doc_id": "m_id", "text_sha256": "m_sha"})
    joined = every.join(found, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_sha256") == F.col("m_sha")), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        "text_sha256",
    ).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **widths: int) -> DataFrame:
    """Rows of ``docs``, all columns, without those that ``exact_classes`` does not keep.

    Only the duplicates' ids are joined.  Rows that repeat both id and text leave one.
    """
    members = duplicate_members(docs, doc_id, text, **widths)
    counted = members.groupBy("doc_id", "text_sha256", "keep_id").agg(F.count(F.lit(1)).alias("n"))
    keeper = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = counted.filter(~keeper).select(F.col("doc_id").alias("other_id"), F.col("text_sha256").alias("other_sha")).distinct()
    twice, repeated = materialize(
        counted.filter(keeper & (F.col("n") > 1)).select(F.col("doc_id").alias("other_id"), F.col("text_sha256").alias("other_sha")).distinct()
    )
    sha, turn = unused(docs, "sha", "turn")
    marked = docs.withColumn(sha, F.sha2(text_bytes(text), 256))
    same = lambda other: F.col(doc_id).eqNullSafe(other["other_id"]) & (F.col(sha) == other["other_sha"])
    left = marked.join(gone.hint("merge"), same(gone), "left_anti")
    if not repeated:
        return left.drop(sha)
    alone = left.join(twice, same(twice), "left_anti").drop(sha)
    # Keepers that stand there more than once; rows of one id and text are equal in both.
    place = Window.partitionBy(doc_id, sha).orderBy(F.lit(0))
    first = left.join(twice, same(twice), "left_semi").withColumn(turn, F.row_number().over(place)).filter(F.col(turn) == 1)
    return alone.unionByName(first.drop(sha, turn))
