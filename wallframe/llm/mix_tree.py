"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: every source gets a share of all words by weight, but at most ``cap`` times its own
words; what is above is shared again among the others.  A source's documents, in a hashed order,
form its blocks: whole passes first, then documents of a further pass that meet the target best:
the first ones that fit, round by round over those not larger than what is still missing, and a
choice among the smallest few at the end.  The blocks are shared out to shards by a binary tree over the shards: each node draws how
many blocks of every source go left, without replacement, so the quotas of all shards add up
exactly.  A node's draw depends on its number alone, so any task repeats the path of its rows and
no quota table is joined.  Blocks of a shard are disjoint runs of the permuted sources; they are
shuffled inside the shard by a hash.

Only totals per source reach the driver; more than ``MAX_SOURCES`` sources are an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..skew import chunked, row_numbers, running_sum
from ..store import materialize, union_all
from .common import unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 20
SHARD_WORDS = 1 << 22
MAX_SOURCES = 100_000
CLOSERS = 12
# NumPy draws hypergeometric numbers from at most so many blocks.
EXACT_DRAW = 1_000_000_000


def targets(sizes: Sequence[int], cap: int = CAP, weights: Sequence[int] = WEIGHTS) -> list[Fraction]:
    """Target words of sources in their order; weights repeat along the list."""
    total = Fraction(sum(sizes))
    weight = [Fraction(weights[k % len(weights)]) for k in range(len(sizes))]
    fixed: dict[int, Fraction] = {}
    while True:
        open_ = [k for k in range(len(sizes)) if k not in fixed]
        left, whole = total - sum(fixed.values()), sum(weight[k] for k in open_)
        above = [k for k in open_ if left * weight[k] > cap * sizes[k] * whole]
        if not above:
            return [fixed[k] if k in fixed else left * weight[k] / whole for k in range(len(sizes))]
        fixed.update({k: Fraction(cap * sizes[k]) for k in above})


def _draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Blocks of one source in a sample; above NumPy's range the normal law, kept within its bounds."""
    if not sample or not good:
        return 0
    if good + bad < EXACT_DRAW:
        return int(rng.hypergeometric(good, bad, sample))
    share, total = good / (good + bad), good + bad
    spread = (sample * share * (1 - share) * (total - sample) / max(1, total - 1)) ** 0.5
    return int(min(max(round(rng.normal(sample * share, spread)), sample - bad, 0), good, sample))


class SplitTree:
    """Quotas per shard and source; every node can be computed from the root's alone."""

    def __init__(self, blocks: Sequence[int], shards: int, seed: int = SEED):
        self.blocks, self.shards, self.seed = np.asarray(blocks, dtype=np.int64), shards, seed
        self.nodes: dict[tuple[int, int], np.ndarray] = {}

    def _room(self, low: int, high: int) -> int:
        whole, rest = divmod(int(self.blocks.sum()), self.shards)
        return whole * (high - low) + min(high, rest) - min(low, rest)

    def left(self, low: int, high: int, quota: np.ndarray) -> np.ndarray:
        """How many blocks of each source the left half of shards [low, high) gets."""
        if (low, high) not in self.nodes:
            rng = np.random.default_rng([self.seed, low, high])
            sample, rest, out = self._room(low, (low + high) // 2), int(quota.sum()), []
            for good in quota.tolist():
                rest -= good
                out.append(_draw(rng, good, rest, sample))
                sample -= out[-1]
            self.nodes[low, high] = np.array(out, dtype=np.int64)
        return self.nodes[low, high]

    def shard_of(self, source: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Shard of blocks given by source number and position in the permuted source."""
        out = np.zeros(len(source), dtype=np.int64)
        stack = [(0, self.shards, self.blocks, np.arange(len(source)), index)]
        while stack:
            low, high, quota, rows, place = stack.pop()
            if high - low == 1 or not len(rows):
                out[rows] = low
                continue
            left, middle = self.left(low, high, quota), (low + high) // 2
            edge = left[source[rows]]
            goes = place < edge
            stack.append((low, middle, left, rows[goes], place[goes]))
            stack.append((middle, high, quota - left, rows[~goes], (place - edge)[~goes]))
        return out


def _closing(group: pd.DataFrame) -> pd.DataFrame:
    """Of a source's smallest documents, taken and not, those that together come nearest to the words missing without them."""
    group = group.sort_values("place")
    sizes, gap = group["size"].tolist(), int(group["gap"].iloc[0]) + int(group["size"][group["taken"]].sum())
    best, chosen = abs(gap), ()
    for count in range(1, len(sizes) + 1):
        for some in combinations(range(len(sizes)), count):
            off = abs(gap - sum(sizes[k] for k in some))
            if off < best:
                best, chosen = off, some
    return pd.DataFrame({"src": group["src"], "place": group["place"], "chosen": [k in chosen for k in range(len(sizes))]})


def _filled(ranked: DataFrame, missing: dict[int, int], least: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """src, place of the documents that fill a further pass up to ``missing`` words, and the words still missing per source.

    ranked: src, _chunk, place, size, along a ``chunked`` table; least: smallest size above zero per source.
    A round takes the first documents of at most half the gap while they fit, which halves the gap or
    leaves larger ones only; of these one at most fits.  Rounds end when no document fits.
    """
    spark, gaps, parts = ranked.sparkSession, dict(missing), []
    open_ = {k: least[k] for k, gap in gaps.items() if k in least and least[k] <= gap}
    rows = ranked.filter("size > 0").select("src", "_chunk", "place", "size")
    while open_:
        bounds = [(k, gaps[k], gaps[k] // 2 if size <= gaps[k] // 2 else gaps[k]) for k, size in open_.items()]
        live = rows.join(F.broadcast(spark.createDataFrame(bounds, "src bigint, gap bigint, bound bigint")), "src").filter("size <= gap")
        small = F.col("size") <= F.col("bound")
        summed = running_sum(live, ["src"], [F.col("place")], F.when(small, F.col("size")).otherwise(0), "upto")
        marked, _ = materialize(summed.select("src", "_chunk", "place", "size", (small & (F.col("upto") <= F.col("gap"))).alias("taken")))
        parts.append(marked.filter("taken").select("src", "place"))
        rows = marked.filter("NOT taken").drop("taken")
        got = marked.groupBy("src").agg(F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("words"), F.min(F.when(~F.col("taken"), F.col("size"))).alias("least")).collect()
        for r in got:
            gaps[r["src"]] -= int(r["words"])
        open_ = {r["src"]: r["least"] for r in got if r["least"] is not None and r["least"] <= gaps[r["src"]]}
    empty = ranked.select("src", "place").limit(0)
    return union_all(parts) if parts else empty, gaps


def mix_plan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    *,
    cap: int = CAP,
    weights: Sequence[int] = WEIGHTS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, text_key, size, source_size, target, copies, taken, copy, shard, src, place: one row per copy, and per row of ``docs`` without one.

    ``size`` counts words, null text none; a null source is a source of its own, last in order.
    Documents are taken whole, ``copies`` times, at most ``cap`` times.  ``shard`` is
    the output shard of the copy; (src, place) names the row of ``docs``.  Ties in the hashed order are broken by id, size and text hash, so
    reruns agree; rows that repeat all of them are interchangeable.  No rows give no rows.
    """
    spark = docs.sparkSession
    sized, rows = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64(text).alias("text_key"),
        )
    )
    found = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them before mixing")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    words = [int(r["words"]) for r in found]
    goal = targets(words, cap, weights)
    passes = [min(cap, int(t // w)) if w else 0 for t, w in zip(goal, words, strict=True)]
    missing = [round(t - p * w) for t, p, w in zip(goal, passes, words, strict=True)]
    facts = spark.createDataFrame(
        [(k, r["source"], w, float(t), p, m) for k, (r, w, t, p, m) in enumerate(zip(found, words, goal, passes, missing, strict=True))],
        "src bigint, name string, source_size bigint, target double, passes bigint, missing bigint",
    )
    keyed = sized.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    keyed = keyed.withColumn("dice", F.xxhash64(F.lit(seed), "doc_id"))
    order = [F.col("dice"), F.col("doc_id"), F.col("size"), F.col("text_key")]
    chunks = chunked(keyed, ["src"], order)
    ranked, _ = materialize(row_numbers(chunks, ["src"], order, "place").drop("dice"))
    wanted = {k: m for k, m in enumerate(missing) if m > 0}
    filled, gaps = _filled(ranked, wanted, {k: r["least"] for k, r in enumerate(found) if r["least"]})
    flagged, _ = materialize(ranked.join(filled.withColumn("taken", F.lit(True)), ["src", "place"], "left").withColumn("taken", F.col("taken").isNotNull()))
    left = spark.createDataFrame([(k, gap) for k, gap in gaps.items() if gap], "src bigint, gap bigint")
    # The smallest of each chunk first, so no task sorts a source.
    near = flagged.filter("size > 0").join(F.broadcast(left), "src").select("src", "_chunk", "place", "size", "taken", "gap")
    for group in (["src", "taken", "_chunk"], ["src", "taken"]):
        at = Window.partitionBy(*group).orderBy("size", "place")
        near = near.withColumn("at", F.row_number().over(at)).filter(F.col("at") <= CLOSERS // 2).drop("at")
    near = near.select("src", "place", "size", "taken", "gap")
    closing, _ = materialize(near.groupBy("src").applyInPandas(_closing, "src bigint, place bigint, chosen boolean"))
    taken = flagged.join(F.broadcast(closing), ["src", "place"], "left").withColumn("taken", F.coalesce("chosen", "taken")).drop("chosen")
    taken, _ = materialize(running_sum(taken, ["src"], [F.col("place")], F.col("taken").cast("bigint"), "nth"))
    plan = taken.withColumn("last", F.when(F.col("taken"), F.col("nth"))).withColumn("copies", F.col("passes") + F.col("taken").cast("bigint"))
    picked = {r["src"]: r["n"] for r in taken.groupBy("src").agg(F.count_if(F.col("taken")).alias("n")).collect()}
    docs_of = [int(r["docs"]) for r in found]
    blocks = [p * n + picked.get(k, 0) for k, (p, n) in enumerate(zip(passes, docs_of, strict=True))]
    shards = max(1, -(-sum(words) // shard_words))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, size = SplitTree(blocks, shards, seed), np.asarray(docs_of, dtype=np.int64)
        for batch in batches:
            src = batch["src"].to_numpy()
            yield pd.DataFrame({"shard": tree.shard_of(src, batch["copy"].to_numpy() * size[src] + batch["position"].to_numpy())})

    @F.pandas_udf("bigint")
    def shard_of(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        frames = (pd.DataFrame({"src": s, "copy": c, "position": p}) for s, c, p in columns)
        for out in place(frames):
            yield out["shard"]

    copies = plan.select("*", F.explode_outer(F.sequence(F.lit(0), F.when(F.col("copies") > 0, F.col("copies") - 1))).alias("copy"))
    position = F.when(F.col("copy") < F.col("passes"), F.col("place") - 1).otherwise(F.col("last") - 1)
    return copies.select(
        "doc_id",
        "text_key",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copy",
        F.when(
            F.col("copy").isNotNull(),
            shard_of(F.col("src"), F.coalesce("copy", F.lit(0)), F.coalesce(position, F.lit(0))),
        ).alias("shard"),
        "src",
        "place",
    )


def _placed(plan: DataFrame, seed: int) -> DataFrame:
    """The blocks of a plan, all columns, with their place in the shard."""
    blocks = plan.filter(F.col("shard").isNotNull())
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "doc_id", "copy"), "doc_id", "copy", "text_key", "src", "place")
    return blocks.withColumn("position", F.row_number().over(order).cast("bigint"))


def mixed_rows(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """The blocks of a plan with their place in the shard: doc_id, text_key, copy, shard, position."""
    return _placed(plan, seed).select("doc_id", "text_key", "copy", "shard", "position")


def placed_documents(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """The plan with one row per row of the documents: ``shards`` and ``positions`` list those of all copies."""
    kept = ["doc_id", "text_key", "size", "source_size", "target", "copies", "taken"]
    plan, _ = materialize(plan)
    places = _placed(plan, seed).groupBy("src", "place").agg(
        *[F.first(name).alias(name) for name in kept], F.array_sort(F.collect_list(F.struct("copy", "shard", "position"))).alias("at")
    )
    none = F.array().cast("array<bigint>")
    out = places.select(*kept, F.col("at.shard").alias("shards"), F.col("at.position").alias("positions"))
    return out.unionByName(plan.filter(F.col("shard").isNull()).select(*kept, none.alias("shards"), none.alias("positions")))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, seed: int = SEED, **options) -> DataFrame:
    """Rows of ``docs``, with its columns, each repeated as often as the mix takes it (0 to ``cap`` times).

    Rows come by shard, and inside a shard in their shuffled position.
    """
    key, many, turn, at = unused(docs, "mix_key", "mix_rows", "mix_turn", "mix_at")
    plan = placed_documents(mix_plan(docs, doc_id, text, source, seed=seed, **options), seed)
    # Rows that repeat id and text are alike: their copies are dealt among them.
    places = plan.groupBy("doc_id", "text_key").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("shards", "positions")))).alias(at), F.count(F.lit(1)).alias(many))
    places = places.filter(F.size(at) > 0).withColumnsRenamed({"doc_id": f"{key}_id", "text_key": f"{key}_text"})
    met = docs.withColumn(key, F.xxhash64(text)).join(
        places.hint("merge"), F.col(doc_id).eqNullSafe(F.col(f"{key}_id")) & (F.col(key) == F.col(f"{key}_text"))
    )
    met = met.withColumn(turn, F.row_number().over(Window.partitionBy(doc_id, key).orderBy(F.lit(0))))
    dealt = F.when(F.col(many) == 1, F.col(at)).otherwise(F.filter(at, lambda _, k: k % F.col(many) == F.col(turn) - 1))
    blocks = met.select(*docs.columns, F.explode(dealt).alias(at))
    order = [F.col(f"{at}.shards"), F.col(f"{at}.positions")]
    return blocks.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
