"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting.  A bounded sample of labelled rows (``Limits.examples``, the first by hash) is the set of
examples.  Features are words and word beginnings of three to eight letters; those that go with
label 1 beyond chance (a G-test over the examples) are kept, at most ``Limits.features``.
Document frequencies for the weights are counted over all documents.  Examples with equal vectors
are one entry with counts, which keeps ties whole.

Search.  Entries are numbered in blocks; for each feature the index knows its largest weight in a
block.  A query sums these bounds per block, visits blocks by falling bound and stops when no bound
reaches the worst neighbour kept, so the nearest entries are exact.  Enough entries are taken to
hold ``neighbours`` examples, with all ties of the last one.

Score.  Votes fall with distance; a prior of the label rate counts as one vote at full weight.
Isotonic regression on leave-one-out votes of the examples turns a vote into a probability.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import discard, materialize
from .common import per_text, text_bytes

PREFIXES = range(3, 9)
LETTERS = re.compile(r"[^\W\d_]+")
# Longer pieces of text are not remembered.
LONGEST = 64


@dataclass(frozen=True)
class Limits:
    """Bounds of the fit; everything else covers all rows."""

    examples: int = 10_000
    features: int = 4_096
    postings: int = 2_000_000
    neighbours: int = 25
    least_toxic: int = 3
    least_g: float = 24.0
    least_lift: float = 2.0
    block: int = 512
    evidence: int = 3


def word_features(word: str) -> list[str]:
    """The word itself (marked) and its beginnings."""
    return [f"{word}$", *(word[:k] for k in PREFIXES if k <= len(word))]


def chunk_features(chunk: bytes) -> list[str]:
    """Features of the runs of letters in a piece of text without white space."""
    return [feature for word in LETTERS.findall(chunk.decode("utf-8", "replace").lower()) for feature in word_features(word)]


def text_features(raw: bytes) -> set[str]:
    return {feature for chunk in set(raw.split()) for feature in chunk_features(chunk)}


def g_score(with_toxic: int, with_all: int, toxic: int, total: int) -> float:
    """Likelihood-ratio statistic of a feature against the label."""
    cells = (
        (with_toxic, with_all * toxic / total),
        (with_all - with_toxic, with_all * (total - toxic) / total),
        (toxic - with_toxic, (total - with_all) * toxic / total),
        (total - with_all - toxic + with_toxic, (total - with_all) * (total - toxic) / total),
    )
    return 2 * sum(seen * math.log(seen / expected) for seen, expected in cells if seen and expected)


@dataclass
class Index:
    """Distinct example vectors in blocks: postings per feature, where each block's begin, and block maxima."""

    entries: list[np.ndarray]
    weights: list[np.ndarray]
    begins: list[np.ndarray]
    maxima: np.ndarray
    counts: np.ndarray
    toxic: np.ndarray
    ids: list[list]
    block: int

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], counts, toxic, ids, features: int, block: int) -> Index:
        terms = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, dtype=np.int64)
        entry = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((entry, terms))
        terms, entry, weight = terms[order], entry[order], weight[order]
        starts = np.searchsorted(terms, np.arange(features + 1))
        blocks = -(-len(vectors) // block)
        entries = [entry[starts[t] : starts[t + 1]] for t in range(features)]
        weights = [weight[starts[t] : starts[t + 1]] for t in range(features)]
        begins = [np.searchsorted(e, np.arange(blocks + 1) * block) for e in entries]
        maxima = np.zeros((features, blocks))
        np.maximum.at(maxima, (terms, entry // block), weight)
        return cls(entries, weights, begins, maxima, np.asarray(counts, dtype=np.int64), np.asarray(toxic, dtype=np.int64), ids, block)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, wanted: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and numbers of the nearest entries that together hold ``wanted`` examples, ties included.

        ``skip`` leaves one example of that entry out.
        """
        bound = weights @ self.maxima[terms]
        values, found, worst = np.zeros(0), np.zeros(0, dtype=np.int64), 0.0
        for number in np.argsort(-bound, kind="stable").tolist():
            if bound[number] <= 0 or bound[number] < worst - 1e-9:
                break
            score = np.zeros(self.block)
            low = number * self.block
            for term, weight in zip(terms.tolist(), weights.tolist(), strict=True):
                begin, end = self.begins[term][number], self.begins[term][number + 1]
                if begin < end:
                    score[self.entries[term][begin:end] - low] += weight * self.weights[term][begin:end]
            hit = np.nonzero(score > max(0.0, worst - 1e-8))[0]
            values = np.concatenate([values, np.round(score[hit], 9)])
            found = np.concatenate([found, hit + low])
            order = np.lexsort((found, -values))
            values, found = values[order], found[order]
            held = np.cumsum(self.counts[found] - (found == skip))
            if len(held) and held[-1] >= wanted:
                worst = float(values[int(np.searchsorted(held, wanted))])
                end = int(np.searchsorted(-values, -worst, side="right"))
                values, found = values[:end], found[:end]
        return values, found


@dataclass
class Model:
    """Everything a task needs to score texts; its size is bounded by ``Limits``."""

    features: dict[str, int]
    idf: np.ndarray
    index: Index
    rate: float
    zero_rate: float
    limits: Limits
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0), np.zeros(0)))

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted feature numbers and normalised TF-IDF weights."""
        terms = np.array(sorted(counts), dtype=np.int64)
        weights = np.array([1 + math.log(counts[t]) for t in terms.tolist()]) * self.idf[terms]
        length = math.sqrt(float(weights @ weights))
        return terms, weights / length if length else weights

    def votes(self, terms: np.ndarray, weights: np.ndarray, own: tuple[int, int] | None = None) -> tuple[float, tuple[np.ndarray, np.ndarray] | None]:
        """Distance-weighted share of toxic votes and the neighbours; ``own`` = (entry, label) is left out."""
        if not len(terms):
            return self.zero_rate, None
        near = self.index.nearest(terms, weights, self.limits.neighbours, own[0] if own else -1)
        cosine, entry = near
        weight = 0.1 / (1.1 - np.minimum(cosine, 1.0))
        toxic, count = self.index.toxic[entry], self.index.counts[entry]
        if own:
            mine = entry == own[0]
            toxic, count = toxic - own[1] * mine, count - mine
        votes, whole = self.rate + float(weight @ toxic), 1.0 + float(weight @ count)
        return votes / whole, near

    def score(self, vote: float) -> float:
        """Calibrated probability of a vote."""
        edges, values = self.steps
        return float(np.interp(vote, edges, values)) if len(edges) else vote


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit of y on x by pooling adjacent violators: means of x and values of the pools.

    A pool's value is its share of ones with a tenth of an even vote added; pools are joined as long as
    these values fall, so small pools never overtake large ones.  One example makes no step of its own: its pool
    joins the next one, the last the one before.
    """
    value_of = lambda pool: (pool[1] + 0.5 * 0.1) / (pool[2] + 0.1)

    def pooled(parts: list[list[float]]) -> list[list[float]]:
        pools: list[list[float]] = []
        for part in parts:
            pools.append(part)
            while len(pools) > 1 and value_of(pools[-2]) >= value_of(pools[-1]):
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        return pools

    parts = [(value, y[x == value]) for value in np.unique(x)]
    pools = pooled([[float(value) * len(part), float(part.sum()), float(len(part))] for value, part in parts])
    while len(pools) > 1 and (single := next((k for k, pool in enumerate(pools) if pool[2] == 1), None)) is not None:
        at = min(single, len(pools) - 2)
        pools = pooled([*pools[:at], [a + b for a, b in zip(pools[at], pools[at + 1], strict=True)], *pools[at + 2 :]])
    return np.array([p[0] / p[2] for p in pools]), np.array([value_of(p) for p in pools])


def reader(features: dict[str, int]):
    """``bytes -> {feature number: count}``; what a piece between white space contributes is remembered.

    Every feature of a word starts like the word, so most words are passed over by their first letters.
    """
    known: dict[bytes, tuple[int, ...]] = {}
    heads = {feature[:3] for feature in features}
    plain_heads = {head.encode() for head in heads}

    def hits_of(chunk: bytes) -> tuple[int, ...]:
        stem = chunk.rstrip(b".,;:!?")
        if stem.isalpha() and (stem + b"$")[:3].lower() not in plain_heads:
            return ()
        words = LETTERS.findall(chunk.decode("utf-8", "replace").lower())
        return tuple(features[f] for w in words if (w + "$")[:3] in heads for f in word_features(w) if f in features)

    def read(raw: bytes) -> dict[int, int]:
        out: dict[int, int] = {}
        for chunk, count in Counter(raw.split()).items():
            hits = known.get(chunk)
            if hits is None:
                if len(known) > 150_000:
                    known.clear()
                hits = hits_of(chunk)
                if len(chunk) <= LONGEST:
                    known[chunk] = hits
            for hit in hits:
                out[hit] = out.get(hit, 0) + count
        return out

    return read


def _tally(chosen: set[str] | None):
    """Feature counts of one partition of examples: of all features, or of ``chosen`` ones; bounded by the sample."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every: Counter[str] = Counter()
        for batch in batches:
            for raw in batch["raw"]:
                found = text_features(raw)
                every.update(found if chosen is None else found & chosen)
        names = list(every)
        for at in range(0, len(names), 50_000):
            some = names[at : at + 50_000]
            yield pd.DataFrame({"feature": some, "n": [every[f] for f in some]})

    return tally


def _count_features(examples: DataFrame, chosen: set[str] | None = None) -> DataFrame:
    """feature, n: in how many examples a feature occurs."""
    partial = examples.select("raw").mapInPandas(_tally(chosen), "feature string, n bigint")
    return partial.groupBy("feature").agg(F.sum("n").alias("n"))


def choose_features(examples: DataFrame, total: int, toxic: int, limits: Limits) -> list[str]:
    """Features that go with label 1, by falling statistic: first counted in toxic examples, then the frequent ones in all."""
    hits = _count_features(examples.filter("toxic = 1")).filter(F.col("n") >= limits.least_toxic)
    hits = hits.orderBy(F.desc("n"), "feature").limit(16 * limits.features)
    toxic_counts = {r["feature"]: r["n"] for r in hits.collect()}
    counts = {r["feature"]: r["n"] for r in _count_features(examples, set(toxic_counts)).collect()}
    scored = sorted(
        (-g_score(k, counts[name], toxic, total), name) for name, k in toxic_counts.items() if k * total >= limits.least_lift * toxic * counts[name]
    )
    return [name for g, name in scored if -g >= limits.least_g][: limits.features]


def sample_examples(docs: DataFrame, labels: DataFrame, limits: Limits, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, raw, toxic of the examples: the first ``limits.examples`` labelled ids by hash.

    Labels that are null are no labels; an id with several labels counts as toxic if one says so.
    """
    one = labels.filter(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id"))
    one = one.agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = one.orderBy(F.xxhash64("_id"), "_id").limit(limits.examples)
    # The sample's row limit bounds this broadcast.
    return docs.select(F.col(doc_id).alias("_id"), text_bytes(text).alias("raw")).join(F.broadcast(picked), "_id")


def fit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn features, weights, index and calibration; without labelled rows every score is 0.

    ``labels`` holds only the rows that may be learnt from.
    """
    examples = sample_examples(docs, labels, limits, doc_id, text)
    examples, _ = materialize(examples)
    total, toxic = examples.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not total:
        return Model({}, np.zeros(0), Index.build([], [], [], [], 0, limits.block), 0.0, 0.0, limits)
    rate = toxic / total
    features = {name: number for number, name in enumerate(sorted(choose_features(examples, total, toxic, limits)))}

    counted = per_text(lambda: (lambda read: lambda raw: sorted(read(raw)))(reader(features)), "array<int>")
    every = docs.select(counted(text_bytes(text)).alias("f"))
    frequency = every.select(F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["f"]: r["n"] for r in frequency.collect()}
    documents = docs.count()
    idf = np.array([math.log((1 + documents) / (1 + totals.get(k, 0))) + 1 for k in range(len(features))])

    pairs = per_text(lambda: (lambda read: lambda raw: [x for p in sorted(read(raw).items()) for x in p])(reader(features)), "array<int>")
    kept: dict[tuple[int, ...], list] = {}
    vectors = examples.select("_id", "toxic", pairs(F.col("raw")).alias("v"))
    # At most ``limits.examples`` rows, so one window; those beyond the postings' bound are left out.
    upto = F.sum(F.size("v")).over(Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = vectors.withColumn("upto", upto).filter(F.col("upto") <= 2 * limits.postings).orderBy(F.xxhash64("_id"), "_id").drop("upto")
    for row in rows.collect():
        entry = kept.setdefault(tuple(row["v"]), [0, 0, [], []])
        entry[0] += 1
        entry[1] += row["toxic"]
        if len(entry[2 + row["toxic"]]) < limits.evidence:
            entry[2 + row["toxic"]].append(row["_id"])
    discard(examples)
    zero = kept.pop((), [0, 0, [], []])
    zero_rate = (zero[1] + rate) / (zero[0] + 1)
    model = Model(features, idf, Index.build([], [], [], [], 0, limits.block), rate, zero_rate, limits)
    keys = sorted(kept)
    vectors = [model.vector(dict(zip(key[::2], key[1::2], strict=True))) for key in keys]
    counts, hits = [kept[k][0] for k in keys], [kept[k][1] for k in keys]
    ids = [(kept[k][3] + kept[k][2])[: limits.evidence] for k in keys]
    model.index = Index.build(vectors, counts, hits, ids, len(features), limits.block)
    x, y = [zero_rate] * zero[0], [1] * zero[1] + [0] * (zero[0] - zero[1])
    for entry, vector in enumerate(vectors):
        for label, many in ((1, hits[entry]), (0, counts[entry] - hits[entry])):
            if many:
                x += [model.votes(*vector, own=(entry, label))[0]] * many
                y += [label] * many
    model.steps = isotonic(np.array(x), np.array(y))
    return model


def scored_struct(model: Model, text: str = "text") -> Column:
    """score, evidence of a text column; evidence lists the nearest examples as id:cosine."""
    shared = model

    def start():
        read, remembered = reader(shared.features), {}

        def score(raw: bytes) -> tuple[float, str]:
            counts = read(raw)
            # Packed, as many texts are remembered.
            key = array("i", [x for pair in sorted(counts.items()) for x in pair]).tobytes()
            if key not in remembered:
                if len(remembered) > 10_000:
                    remembered.clear()
                vote, near = shared.votes(*shared.vector(counts)) if counts else (shared.zero_rate, None)
                first = zip(*(side[: shared.limits.evidence].tolist() for side in near), strict=True) if near else ()
                shown = [f"{i}:{cosine:.4f}" for cosine, entry in first for i in shared.index.ids[entry]]
                remembered[key] = (shared.score(vote), ",".join(shown[: shared.limits.evidence]))
            return remembered[key]

        return score

    return per_text(start, "score double, evidence string")(text_bytes(text))


def toxicity(docs: DataFrame, model: Model, text: str = "text", *, threshold: float = 0.7) -> list[Column]:
    """Columns score, predicted, evidence for rows of ``docs``; null and empty texts have no features.

    A text without a known feature gets the label rate of such examples.
    """
    scored = scored_struct(model, text)
    return [scored.getField("score").alias("score"), (scored.getField("score") >= threshold).cast("int").alias("predicted"), scored.getField("evidence").alias("evidence")]


def learnable(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Label rows that may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return labels.filter(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
