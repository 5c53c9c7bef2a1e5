"""Leader grouping: holds in order join the first group that is close enough, or start one.

A hold joins a group if the median of its squared distances to the members is at most
``median_threshold`` and the largest at most ``max_threshold``.  The result depends on the order, so
an image is walked in blocks of bounded size.  Spark compares a block with all earlier members, and
groups that no hold of the block could join stay out of the walk.  Of the others, small groups send
their vectors; larger ones send five numbers, which is all the two tests need and which can be merged,
for each hold that could join after a few more members.  A hold that would have to know more ends the
block early and opens the next one, where the first hold is always decidable.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..skew import ranked
from ..store import discard, materialize
from .grouping import KEY, first_appearance_ids
from .pairs import matrix

FIRST_BLOCK = 2048
NEXT_BLOCK = 4096
MEMBER_BLOCK = 4096
# Near members a group may gain within a block before a pair that was not listed counts as unknown; large groups gain more.
LOOK = 6
SHARE = 2
# Groups of at most this size send their vectors.
SMALL = 16
STRIP = 256
STATS = ("n", "le", "top", "low", "high")


def _square_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.maximum((left * left).sum(1)[:, None] + (right * right).sum(1)[None, :] - 2.0 * left @ right.T, 0.0)


def _gains(n: np.ndarray, look: int) -> np.ndarray:
    return np.maximum(look, n // SHARE)


def _segments(d: np.ndarray, starts: np.ndarray, median_t: float) -> tuple[np.ndarray, ...]:
    """Per group of rows: count within the median threshold, maximum, largest within and smallest beyond."""
    inside = d <= median_t
    return (
        np.add.reduceat(inside, starts, axis=0, dtype=np.float64),
        np.maximum.reduceat(d, starts, axis=0),
        np.maximum.reduceat(np.where(inside, d, -np.inf), starts, axis=0),
        np.minimum.reduceat(np.where(inside, np.inf, d), starts, axis=0),
    )


def _stats_schema(kind: str) -> str:
    return f"{KEY} {kind}, hold_index bigint, leader bigint, {', '.join(f'{name} double' for name in STATS)}, embedding array<double>"


def _summaries(block: DataFrame, members: DataFrame, sizes: DataFrame, median_t: float, max_t: float, look: int, small: int, part: int) -> DataFrame:
    """What the walk has to know of the groups that some block hold may join.

    Rows with an embedding are members of small groups, others are distance summaries of a block hold and
    a group.  A group is in one part; one above ``part`` members is spread, and its summaries are partial.
    """
    kind = members.schema[KEY].dataType.simpleString()
    totals = sizes.join(block.select(KEY).distinct(), KEY, "left_semi").groupBy(KEY).agg(F.ceil(F.sum("n") / part).cast("int").alias("_parts"))
    piece = F.pmod(F.xxhash64("hold_index"), F.ceil(F.col("n") / part))
    held = members.join(sizes.join(totals, KEY).select(KEY, "leader", "n", "_parts"), [KEY, "leader"]).select(
        KEY, "hold_index", "embedding", "leader", "n", F.pmod(F.xxhash64("leader", piece), F.col("_parts")).cast("int").alias("_part")
    )
    none = F.lit(None).cast("bigint")
    asked = block.join(totals, KEY).select(
        KEY, "hold_index", "embedding", none.alias("leader"), none.alias("n"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")
    )

    def kernel(table: pa.Table) -> pa.Table:
        mine = table.filter(pc.is_valid(table["leader"])).sort_by("leader")
        holds = table.filter(pc.is_null(table["leader"]))
        image = table[KEY][0].as_py()
        q, a, b = holds["hold_index"].to_numpy(), matrix(mine["embedding"]), matrix(holds["embedding"])
        groups, starts, count = np.unique(mine["leader"].to_numpy(), return_index=True, return_counts=True)
        total = mine["n"].to_numpy()[starts] if len(groups) else count
        whole, vector = total <= part, total <= small
        open_, found = np.zeros(len(groups), bool), []
        for start in range(0, len(q) if len(groups) else 0, STRIP):
            le, top, low, high = _segments(_square_distances(a, b[start : start + STRIP]), starts, median_t)
            missing, near = count[:, None] - 2 * le, top <= max_t
            open_ |= (near & (missing <= 0)).any(axis=1)
            r, c = np.nonzero(~whole[:, None] | (near & (missing <= _gains(total, look)[:, None]) & ~vector[:, None]))
            found.append((r, start + c, count[r].astype(float), le[r, c], top[r, c], low[r, c], high[r, c]))
        columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64 if k < 2 else float) for k in range(7)]
        keep = open_[columns[0]] | ~whole[columns[0]]
        r, c, *stats = (column[keep] for column in columns)
        wide = pa.list_(pa.float64())
        names = [KEY, "hold_index", "leader", *STATS, "embedding"]
        key_type = table.schema.field(KEY).type
        listed = pa.table([pa.array([image] * len(r), key_type), pa.array(q[c]), pa.array(groups[r]), *map(pa.array, stats), pa.nulls(len(r), wide)], names=names)
        sent = mine.filter(pa.array(np.repeat(open_ & vector & whole, count)))
        empty = [pa.nulls(len(sent), pa.float64())] * len(STATS)
        return pa.concat_tables([listed, pa.table([sent[KEY], sent["hold_index"], sent["leader"], *empty, sent["embedding"].cast(wide)], names=names)])

    return held.unionByName(asked).groupBy(KEY, "_part").applyInArrow(kernel, _stats_schema(kind))


def _walk(median_t: float, max_t: float, look: int):
    """Kernel: decide the holds of one block in order; reports hold_index, leader, place and embedding."""

    def kernel(key, block: pa.Table, stats: pa.Table) -> pa.Table:
        block = block.sort_by("hold_index")
        ids, v = block["hold_index"].to_numpy(), matrix(block["embedding"])
        known = np.unique(stats["leader"].to_numpy())
        e, column = len(known), lambda table: np.searchsorted(known, table["leader"].to_numpy())
        sent = stats.filter(pc.is_valid(stats["embedding"])).sort_by("leader")
        sent_rows = matrix(sent["embedding"])
        sent_groups, sent_starts, sent_count = np.unique(column(sent), return_index=True, return_counts=True)
        listed = stats.filter(pc.is_null(stats["embedding"])).sort_by("hold_index")
        row, col = np.searchsorted(ids, listed["hold_index"].to_numpy()), column(listed)
        values = [listed[name].to_numpy() for name in STATS]
        gains = np.zeros(e)
        np.maximum.at(gains, col, _gains(values[0], look))
        leaders, slot, added = list(known), np.zeros(len(ids), np.int64), np.zeros(e + len(ids))
        step = int(np.clip((1 << 20) // max(1, e), 1, STRIP))
        for start in range(0, len(ids), step):
            stop = min(start + step, len(ids))
            # One row per hold of the strip, one column per known group.
            n, le, top, low, high = (np.full((stop - start, e), x) for x in (0.0, 0.0, 0.0, -np.inf, np.inf))
            if len(sent_groups):
                n[:, sent_groups] = sent_count
                for into, found in zip((le, top, low, high), _segments(_square_distances(sent_rows, v[start:stop]), sent_starts, median_t), strict=True):
                    into[:, sent_groups] = found.T
            some = slice(*np.searchsorted(row, [start, stop]))
            at = (row[some] - start, col[some])
            for into, add, value in zip((n, le, top, low, high), (np.add, np.add, np.maximum, np.maximum, np.minimum), values, strict=True):
                add.at(into, at, value[some])
            seen = n > 0
            between = _square_distances(v[start:stop], v[:stop])
            for p in range(start, stop):
                k, many = p - start, len(leaders)
                chosen = _first_fit(between[k, :p], slot[:p], added[:many], [x[k] for x in (n, le, top, low, high)], seen[k], gains, median_t, max_t)
                if chosen < 0:
                    return decided(block, p, leaders, slot)
                if chosen == many:
                    leaders.append(ids[p])
                slot[p] = chosen
                added[chosen] += 1
        return decided(block, len(ids), leaders, slot)

    def decided(block: pa.Table, count: int, leaders: list, slot: np.ndarray) -> pa.Table:
        done = block.slice(0, count)
        chosen = pa.array(np.array(leaders, np.int64)[slot[:count]])
        return pa.table([done[KEY], done["hold_index"], chosen, done["place"], done["embedding"]], names=[KEY, "hold_index", "leader", "place", "embedding"])

    return kernel


def _first_fit(d: np.ndarray, at: np.ndarray, added: np.ndarray, old: list[np.ndarray], seen: np.ndarray, gains: np.ndarray, median_t: float, max_t: float) -> int:
    """First group a hold may join, else their number; -1 if that depends on a pair that was not listed.

    d, at: distances to the earlier holds of the block and their groups; old: the numbers of the earlier members.
    Leaders ascend: known ones are sorted and new ones are later holds.  A pair that was not listed lacks more
    than ``gains`` members within the median threshold, and stays closed until the block has brought as many.
    """
    many, e = len(added), len(seen)
    inside = d <= median_t
    le = np.bincount(at[inside], minlength=many).astype(float)
    unknown = np.flatnonzero(~seen & (2 * le[:e] - added[:e] > gains))
    n = added.copy()
    n[:e] += old[0]
    le[:e] += old[1]
    fine = np.bincount(at[d > max_t], minlength=many) == 0
    fine[:e] &= seen & (old[2] <= max_t)
    missing = n - 2 * le
    fits = fine & (missing < 0)
    even = fine & (missing == 0)
    if even.any():
        low, high = np.full(many, -np.inf), np.full(many, np.inf)
        low[:e], high[:e] = old[3], old[4]
        asked = even[at]
        np.maximum.at(low, at[asked & inside], d[asked & inside])
        np.minimum.at(high, at[asked & ~inside], d[asked & ~inside])
        even[even] = (low[even] + high[even]) / 2.0 <= median_t
        fits |= even
    chosen = int(fits.argmax()) if fits.any() else many
    return -1 if len(unknown) and unknown[0] < chosen else chosen


def leader(
    features: DataFrame,
    median_threshold: float = 0.7,
    max_threshold: float = 2.65,
    *,
    first_block: int = FIRST_BLOCK,
    next_block: int = NEXT_BLOCK,
    look: int = LOOK,
    small: int = SMALL,
    part: int = MEMBER_BLOCK,
) -> DataFrame:
    """image_id, hold_index, route_id, numbered by first appearance."""
    spark, kind = features.sparkSession, features.schema[KEY].dataType.simpleString()
    rows = features.select(KEY, F.col("hold_index").cast("bigint").alias("hold_index"), vectors.doubles(F.col("embedding")).alias("embedding"))
    placed, left = materialize(ranked(rows, [KEY], [F.col("hold_index")], "place"))
    walk = _walk(median_threshold, max_threshold, look)
    done, size, members, sizes = [], first_block, None, None
    while left > 0:
        begin, waiting = F.lit(0), placed
        if sizes is not None:
            begin = F.coalesce("reached", F.lit(0))
            waiting = placed.join(sizes.groupBy(KEY).agg(F.max("reached").alias("reached")), KEY, "left")
        block, found = materialize(waiting.filter((F.col("place") > begin) & (F.col("place") <= begin + size)).select(KEY, "hold_index", "embedding", "place"))
        if not found:
            break
        if members is None:
            stats = spark.createDataFrame([], _stats_schema(kind))
        else:
            stats = _summaries(block, members, sizes, median_threshold, max_threshold, look, small, part)
        walked = block.groupBy(KEY).cogroup(stats.groupBy(KEY)).applyInArrow(walk, f"{KEY} {kind}, hold_index bigint, leader bigint, place bigint, embedding array<double>")
        decided, count = materialize(walked)
        discard(block)
        done.append(decided.stored_at)
        members = spark.read.schema(decided.schema).parquet(*done)
        grown = decided.groupBy(KEY, "leader").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("reached"))
        if sizes is not None:
            grown = sizes.unionByName(grown).groupBy(KEY, "leader").agg(F.sum("n").alias("n"), F.max("reached").alias("reached"))
        before = sizes
        sizes, _ = materialize(grown)
        if before is not None:
            discard(before)
        left, size = left - count, next_block
    if members is None:
        return features.select(KEY, "hold_index").withColumn("route_id", F.lit(0).cast("bigint"))
    return first_appearance_ids(members.select(KEY, "hold_index", F.col("leader").alias("label")))
