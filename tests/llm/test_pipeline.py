"""The pipeline's stages, one after the other, against plain versions on a small table."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline

WORDS = [f"w{k}" for k in range(300)]
COLUMNS = ["doc_id", "text", "source", "score", "size"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels with toxic rows, exact and near copies, nulls, empty and repeated rows, clashing names."""
    rng, rows, labels, doc_id = random.Random(11), [], [], 0
    for _ in range(60):
        words = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(rng.choice([5, 40, 120]))]
        toxic = rng.random() < 0.3
        if toxic:
            words[2:2] = ["scum", "trash"]
        for copy in range(rng.choice([1, 1, 2, 3])):
            text = list(words)
            if copy == 2 and len(text) > 100:
                text[50] = "changed"
            rows.append((doc_id, " ".join(text), rng.choice(["a", "b", None]), "x", 1.0))
            labels.append((doc_id, 1, int(toxic)))
            doc_id += 1
    rows += [(doc_id, None, "a", "x", 1.0), (doc_id + 1, "", None, "x", 1.0), (None, "no id here", "b", None, None), (doc_id + 2, "twice", "a", "x", 1.0), (doc_id + 2, "twice", "a", "x", 1.0)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, score string, size double").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = [tuple(r) for r in docs.collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        after = [tuple(r) for r in docs.collect()]
        if name == "toxicity":
            assert Counter(after) == Counter(r for r in before if "scum" not in (r[1] or ""))
        if name == "exact_dedup":
            best = {}
            for r in before:
                best[r[1] or ""] = max(best.get(r[1] or "", -1), -1 if r[0] is None else r[0])
            assert Counter(after).total() == len(best)
            assert {(r[1] or "", -1 if r[0] is None else r[0]) for r in after} == set(best.items())
        if name == "near_dedup":
            sets = [shingles(r[1]) for r in before]
            root = list(range(len(before)))

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a in range(len(before)):
                for b in range(a):
                    if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                        root[find(a)] = find(b)
            groups = {}
            for k, r in enumerate(before):
                groups.setdefault(find(k), []).append(r)
            assert len(groups) < len(before)
            assert sorted(map(str, after)) == sorted(str(min(g, key=lambda r: -1 if r[0] is None else r[0])) for g in groups.values())
        if name == "mixing":
            counts = Counter(after)
            assert set(counts) <= set(before) and max(counts.values()) <= 3
        if name != "packing":
            assert docs.columns == COLUMNS
        before = after
    assert sum(r["length"] for r in docs.collect()) > 0


def test_run_and_empty(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    empty = f"{folder}/empty"
    for table in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{empty}/{table}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
