"""Radix and SimHash duplicates against plain versions."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wallframe.llm import golay
from wallframe.llm.common import ready
from wallframe.llm.golay_simhash import (
    _prefix, _sketches_allow, bucket_pairs, drop_near_duplicates, fingerprint, fingerprint_column, forest, golay_keys, hex_print, links, narrower_keys, near_components, similar_components,
)
from wallframe.llm.radix_dedup import drop_duplicates, exact_classes

WORDS = [f"w{k}" for k in range(400)]


def classes(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    return groups


@pytest.mark.parametrize("widths", [{}, {"first": 2, "growth": 4, "widest": 2048}])
def test_exact_classes(spark, docs_of, widths):
    ready(spark)
    rng = random.Random(3)
    base = ["", None, "a", "ab", "abc" * 40, "é" * 50, "x" * 5000, "x" * 4999 + "y", " ".join(WORDS)]
    rows = [(k, rng.choice(base)) for k in range(150)]
    got = {r["doc_id"]: r for r in exact_classes(docs_of(rows), **widths).collect()}
    assert len(got) == len(rows)
    groups = classes(rows)
    for doc_id, text in rows:
        mates, row = groups[text or ""], got[doc_id]
        assert (row["keep_id"], row["group_size"], row["kept"]) == (max(mates), len(mates), doc_id == max(mates))
        assert row["text_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    kept = drop_duplicates(docs_of(rows), **widths)
    assert kept.columns == ["doc_id", "text", "source", "score", "size"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(m) for m in groups.values())


def test_exact_edges(spark, docs_of):
    ready(spark)
    assert exact_classes(docs_of([])).count() == 0
    assert drop_duplicates(docs_of([])).count() == 0
    rows = [(None, "a"), (None, "a"), (5, "b"), (5, "b"), (5, "c"), (6, "c"), (7, "lone")]
    got = exact_classes(docs_of(rows)).collect()
    assert len(got) == 7
    assert sum(r["kept"] for r in got) == 4
    assert {(r["doc_id"], r["keep_id"]) for r in got} == {(None, None), (5, 5), (5, 6), (6, 6), (7, 7)}
    assert sorted((r["doc_id"] or -1, r["text"]) for r in drop_duplicates(docs_of(rows)).collect()) == [(-1, "a"), (5, "b"), (6, "c"), (7, "lone")]


def test_golay_code_is_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << golay.LENGTH, 3000)
    codewords = (np.arange(1 << 12) << golay.CHECKS).astype(np.int64)
    codewords = codewords ^ np.array([golay._remainder(int(c)) for c in codewords])
    assert min(np.bitwise_count(codewords[1:])) == 7
    distance = np.bitwise_count(words[:200, None] ^ codewords[None, :])
    assert (distance.min(axis=1) <= 3).all()
    assert (distance.argmin(axis=1) == golay.decode(words[:200])).all()
    rows, numbers = golay.near_indices(words)
    counts = np.bincount(rows)
    assert set(counts.tolist()) <= {1, 6}
    keys = {k: set(numbers[rows == k].tolist()) for k in range(200)}
    for k in range(200):
        other = int(words[k]) ^ (1 << int(rng.integers(23))) ^ (1 << int(rng.integers(23)))
        _, near = golay.near_indices(np.array([other]))
        assert keys[k] & set(near.tolist())


def plain_fingerprint(text):
    import re

    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def near_texts(count, seed, edits):
    rng, out = random.Random(seed), []
    for _ in range(count // 4):
        words = [rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 30, 200]))]
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randrange(edits)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(rng.choice([" ", "\n"]).join(copy))
    return out


def components(count, linked):
    parent = list(range(count))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(count):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(count)]


def test_fingerprints_and_components(spark, docs_of):
    ready(spark)
    texts = [None, "", " \t\n", "One", "one", "Ünï CÖDE x\x0by", "a\x85b c d e f", "word " * 70000, *near_texts(160, 5, 3)]
    prints = [plain_fingerprint(t) for t in texts[:7]] + [plain_fingerprint(t) for t in texts[7:]]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in near_components(docs_of(rows)).withColumn("fingerprint", hex_print("print")).collect()}
    assert [got[k]["fingerprint"] for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    roots = components(len(texts), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert [got[k]["component_id"] for k in range(len(texts))] == roots
    assert near_components(docs_of([])).count() == 0
    twice = near_components(docs_of([(3, "a b c"), (3, "a b c"), (None, "a b c")])).collect()
    assert [r["component_id"] for r in twice] == [3, 3, 3]


def test_native_hash_agrees(spark):
    text = "Some words OF a text"
    row = spark.createDataFrame([(text,)], "text string").select(fingerprint_column("text").alias("p"), F.xxhash64(F.lit("a b")).alias("h")).first()
    import xxhash

    assert row["p"] == fingerprint(text.encode()) and row["h"] % 2**64 == xxhash.xxh64_intdigest(b"a b", seed=42)


def test_keys_and_forest_lose_no_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64)
    prints = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4)))) for _ in range(30)]))
    keys, rows, masks = golay_keys(prints)
    narrow = narrower_keys(keys, prints[rows], masks)
    for level in ((keys, prints[rows], masks), narrow):
        buckets = {}
        for key, value in zip(level[0].tolist(), level[1].tolist(), strict=True):
            buckets.setdefault(key, set()).add(value)
        met = {(a, b) for bucket in buckets.values() for a in bucket for b in bucket if a < b}
        for a in prints.tolist():
            for b in prints.tolist():
                if a < b and bin(a ^ b).count("1") <= 2:
                    assert (a, b) in met


@pytest.mark.parametrize("bucket", [2048, 4])
def test_forest(monkeypatch, bucket):
    from wallframe.llm import golay_simhash

    monkeypatch.setattr(golay_simhash, "BUCKET", bucket)
    rng = np.random.default_rng(4)
    prints = np.unique(rng.integers(0, 1 << 14, 600).astype(np.uint64))
    left, right = forest(prints, (1 << 14) - 1)
    values = np.sort(prints).tolist()
    number = {v: k for k, v in enumerate(values)}
    wanted = components(len(values), lambda a, b: bin(values[a] ^ values[b]).count("1") <= 2)
    edges = {(number[int(a)], number[int(b)]) for a, b in zip(left, right, strict=True)}
    assert all(bin(values[a] ^ values[b]).count("1") <= 2 for a, b in edges)
    assert components(len(values), lambda a, b: (a, b) in edges or (b, a) in edges) == wanted
    assert len(edges) == len(values) - len(set(wanted))


def test_hot_buckets_are_split(spark, monkeypatch):
    from wallframe.llm import golay_simhash

    monkeypatch.setattr(golay_simhash, "BUCKET", 3)
    ready(spark)
    rng = np.random.default_rng(6)
    prints = np.unique(np.concatenate([rng.integers(0, 1 << 10, 150).astype(np.int64), rng.integers(-(2**62), 2**62, 100)]))
    table = spark.createDataFrame([(int(p),) for p in prints], "print bigint")
    edges = {(r["i"], r["j"]) for r in links(table).collect()}
    values = prints.tolist()
    pairs = lambda a, b: bin((values[a] ^ values[b]) & (2**64 - 1)).count("1") <= 2
    found = components(len(values), lambda a, b: (values[b], values[a]) in edges or (values[a], values[b]) in edges)
    assert found == components(len(values), pairs)


def test_similar_texts(spark, docs_of):
    ready(spark)
    rng, texts = random.Random(8), []
    for _ in range(25):
        words = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(rng.choice([60, 150, 300]))]
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randrange(1 + len(words) // 50)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    texts += ["", None, "short text", "short text", "other"]

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for t in texts]
    alike = lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    roots = components(len(texts), alike)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in similar_components(docs_of(rows)).collect()}
    near = [(a, b) for a in range(len(texts)) for b in range(a) if alike(a, b)]
    assert all(got.get(a, a) == got.get(b, b) for a, b in near)
    assert all(roots[k] == roots[root] for k, root in got.items())
    left = drop_near_duplicates(docs_of(rows))
    assert left.columns == ["doc_id", "text", "source", "score", "size"]
    assert left.count() == len(texts) - sum(k != root for k, root in got.items())
    assert drop_near_duplicates(docs_of([])).count() == 0
    assert drop_near_duplicates(docs_of([(None, "a b"), (1, "a b"), (2, "a b"), (3, None)])).count() == 3


def shingle_sets(texts):
    split = [(t or "").lower().split() for t in texts]
    return [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in split]


def all_links(texts):
    sets = shingle_sets(texts)
    return lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])


def test_similar_texts_at_the_threshold(spark, docs_of):
    """Appended, cut, short and repetitive texts of a similarity near 0.8: each pair is found."""
    ready(spark)
    rng, texts = random.Random(5), []
    for size in (10, 14, 30, 80, 200):
        for _ in range(12):
            words = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(size)]
            texts.append(" ".join(words))
            texts.append(" ".join(words + [rng.choice(WORDS) for _ in range(max(1, (size - 4) // 5))]))
    for _ in range(12):
        words = [rng.choice("abcdefghij") for _ in range(300)]
        texts += [" ".join(words), " ".join(words[: len(words) - 40]), " ".join(words + [rng.choice("abcdefghij") for _ in range(50)])]
    roots = components(len(texts), all_links(texts))
    got = {r["doc_id"]: r["component_id"] for r in similar_components(docs_of(list(enumerate(texts)))).collect()}
    assert len(set(roots)) < len(texts) - 60
    assert [got.get(k, k) for k in range(len(texts))] == roots


def test_buckets_are_searched_whole(spark, docs_of):
    """Copies between unrelated texts that share a long passage, so their buckets' end members are others."""
    ready(spark)
    rng = random.Random(6)
    draw = lambda n: [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n)]
    passage, texts = draw(60), []
    texts += [" ".join(passage + draw(60)) for _ in range(40)]
    for _ in range(10):
        words = passage + draw(60)
        texts += [" ".join(words), " ".join(words[:-11] + draw(3))]
    texts += [" ".join(passage + draw(60)) for _ in range(40)]
    roots = components(len(texts), all_links(texts))
    got = {r["doc_id"]: r["component_id"] for r in similar_components(docs_of(list(enumerate(texts)))).collect()}
    assert len(set(roots)) == len(texts) - 10
    assert [got.get(k, k) for k in range(len(texts))] == roots


def test_long_texts_by_their_sketches(spark, docs_of):
    """Long texts near the threshold, on both sides of a power of two, are told apart and never lost."""
    ready(spark)
    rng, texts = random.Random(9), []
    draw = lambda n: [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n)]
    passage = draw(30)
    for size in (900, 1000, 2040, 4000):
        words = passage + draw(size)
        texts += [" ".join(words), " ".join(words + draw(size // 5)), " ".join(words[: size * 4 // 5 + 40]), " ".join(passage + draw(size)), " ".join(words[: size // 2] + draw(size // 2))]
    sets = shingle_sets(texts)
    alike = all_links(texts)
    told = [_prefix(t.encode(), 5, 0.8, np.zeros(0, dtype=np.uint64)) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    frame = pd.DataFrame([(a, b, told[a][0] + told[b][0], told[a][2], told[b][2]) for a, b in pairs], columns=["i", "j", "sizes", "sketch_i", "sketch_j"])
    allowed = _sketches_allow(frame, 0.8)
    assert all(ok for (a, b), ok in zip(pairs, allowed, strict=True) if alike(a, b))
    assert not any(ok for (a, b), ok in zip(pairs, allowed, strict=True) if len(sets[a] & sets[b]) < 0.6 * len(sets[a] | sets[b]))
    roots = components(len(texts), alike)
    got = {r["doc_id"]: r["component_id"] for r in similar_components(docs_of(list(enumerate(texts)))).collect()}
    assert [got.get(k, k) for k in range(len(texts))] == roots


def test_alike_members_look_for_one_partner():
    """A bucket of alike texts that no earlier key has grouped makes one pair a text, not all pairs."""
    count = 3000
    nodes, sizes, bits = np.arange(count), np.full(count, 100), np.zeros((count, 8), dtype=np.uint64)
    groups = np.where(nodes < 1000, 0, nodes)
    i, j = bucket_pairs(nodes, groups, sizes, bits, 0.8, every=False)
    assert len(i) == count - 1000 and set(j) | set(i) >= set(nodes[1000:])
    assert len({g for pair in zip(groups[i], groups[j], strict=True) for g in pair}) == count - 999
    few = slice(900, 1100)
    i, j = bucket_pairs(nodes[few], groups[few], sizes[few], bits[few], 0.8, every=True)
    assert len(i) == 100 * 100 + 100 * 99 // 2


def test_near_duplicates_come_from_fingerprints(spark, docs_of, monkeypatch):
    """The stage links texts by their Golay keys first; a link of fingerprints counts only where the texts are alike."""
    from wallframe.llm import golay_simhash

    long = [f"word{k}" for k in range(400)]
    rows = [(1, " ".join(long)), (2, " ".join(long) + " end"), (3, "other words of its own kind"), (4, " ".join(long)), (None, "a b")]
    prints = {k: fingerprint(t.encode()) for k, t in rows if k}
    assert bin(prints[1] ^ prints[2]).count("1") <= 2
    found = {frozenset((r["i"], r["j"])) for r in golay_simhash._fingerprint_pairs(docs_of(rows), "doc_id", "text").collect()}
    assert prints[1] != prints[2] and {p for p in found if len(p) == 2} == {frozenset((1, 4)), frozenset((1, 2))}
    called, real = [], golay_simhash.links
    monkeypatch.setattr(golay_simhash, "links", lambda heads: called.append(1) or real(heads))
    left = drop_near_duplicates(docs_of(rows))
    assert called and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 3]
