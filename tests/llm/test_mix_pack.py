"""Mixing and packing against plain versions and invariants."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest

from wallframe.llm.common import ready
from wallframe.llm.mix_tree import SplitTree, mix_documents, mix_plan, mixed_rows, placed_documents, targets
from wallframe.llm.swap_packing import best_fit, improve, pack_documents, pack_lengths

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENS = public_tokenizers.path("word_bpe_49k.json")


def test_targets():
    sizes = [10, 1000, 50, 0, 400]
    got = targets(sizes)
    assert sum(got) == sum(sizes)
    assert all(t <= 3 * s for t, s in zip(got, sizes, strict=True))
    free = [(t / w) for t, s, w in zip(got, sizes, (1, 2, 3, 1, 2), strict=True) if t < 3 * s]
    assert len(set(free)) == 1
    assert targets([0, 0]) == [Fraction(0), Fraction(0)] and targets([]) == []


def test_split_tree_draws_exact_disjoint_quotas():
    blocks, shards = [500, 0, 37, 1200], 7
    tree = SplitTree(blocks, shards, seed=5)
    source = np.repeat(np.arange(4), blocks)
    index = np.concatenate([np.arange(n) for n in blocks])
    shard = tree.shard_of(source, index)
    again = SplitTree(blocks, shards, seed=5).shard_of(source[::3], index[::3])
    assert (again == shard[::3]).all()
    sizes = np.bincount(shard, minlength=shards)
    assert sizes.max() - sizes.min() <= 1
    share = np.array([np.bincount(source[shard == k], minlength=4) for k in range(shards)])
    assert (share.sum(axis=0) == blocks).all()
    assert abs(share[:, 3] - 1200 / shards).max() < 40


def test_mix(spark, docs_of):
    ready(spark)
    rng = random.Random(4)
    rows = []
    for k in range(600):
        source = rng.choice(["a", "a", "a", "b", "ß", None])
        rows.append((k, rng.choice([None, "", " "]) if k % 50 == 0 else " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 60))), source))
    plan = mix_plan(docs_of(rows), shard_words=2000)
    out = plan.collect()
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) for k, text, _ in rows}
    first = {r["doc_id"]: r for r in out if not r["copy"]}
    assert len(first) == 600 and all(r["size"] == size[k] and r["taken"] <= 3 * size[k] for k, r in first.items())
    names = ["a", "b", "ß", None]
    sums = [sum(size[k] for k, _, s in rows if s == name) for name in names]
    for name, goal in zip(names, targets(sums), strict=True):
        mine = [first[k] for k, _, s in rows if s == name]
        assert all(abs(r["target"] - float(goal)) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - goal) <= max(3, 0.005 * goal)
    draws = mixed_rows(plan).collect()
    assert len(draws) == sum(r["copies"] for r in first.values())
    by_shard = defaultdict(list)
    for r in draws:
        by_shard[r["shard"]].append(r["position"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in by_shard.values())
    key = lambda r: (r["doc_id"], r["copy"], r["shard"], r["taken"])
    assert sorted(map(key, mix_plan(docs_of(rows).repartition(5), shard_words=2000).collect()), key=str) == sorted(map(key, out), key=str)
    mixed = mix_documents(docs_of(rows))
    assert mixed.columns == ["doc_id", "text", "source", "score", "size"]
    counts = Counter(r["doc_id"] for r in mixed.collect())
    assert counts == Counter({k: r["copies"] for k, r in first.items() if r["copies"]})


def test_mix_edges(spark, docs_of):
    ready(spark)
    assert mix_plan(docs_of([])).count() == 0 and mix_documents(docs_of([])).count() == 0
    rows = [(1, "a b c", "x")] * 4 + [(None, None, None), (None, "a", None)]
    plan = [r for r in mix_plan(docs_of(rows)).collect() if not r["copy"]]
    assert len(plan) == 6
    assert mix_documents(docs_of(rows)).count() == sum(r["copies"] for r in plan)


def test_long_documents_are_passed_over(spark, docs_of):
    """Documents longer than what a source misses do not end its further pass."""
    ready(spark)
    rows = [(k, "w " * 20_000, "a") for k in range(30)] + [(100 + k, "w " * 20, "a") for k in range(300)]
    rows += [(1000 + k, "w " * 1100, "b") for k in range(300)]
    first = [r for r in mix_plan(docs_of(rows), weights=(5, 931)).collect() if not r["copy"]]
    mine, other = ([r for r in first if (r["doc_id"] < 1000) == side] for side in (True, False))
    assert round(mine[0]["target"]) == 5000 and sum(r["taken"] for r in mine) == 5000
    assert abs(sum(r["taken"] for r in other) - other[0]["target"]) <= 550


def test_mix_is_dealt_to_shards(spark, docs_of):
    """All copies carry a shard and position, and mixed rows come in that order."""
    ready(spark)
    rows = [(k, f"t{k} " * (1 + k % 40), "abc"[k % 3]) for k in range(500)]
    out = placed_documents(mix_plan(docs_of(rows), shard_words=1000)).collect()
    assert len(out) == 500 and all(len(r["shards"]) == len(r["positions"]) == r["copies"] for r in out)
    places = sorted((shard, position, r["doc_id"]) for r in out for shard, position in zip(r["shards"], r["positions"], strict=True))
    assert len({shard for shard, *_ in places}) > 5
    assert [r["doc_id"] for r in mix_documents(docs_of(rows), shard_words=1000).collect()] == [doc_id for *_, doc_id in places]


def test_packing_reaches_the_bound():
    rng = random.Random(1)
    for width, sizes in ((20, [rng.randint(1, 19) for _ in range(300)]), (2048, [rng.randint(200, 1500) for _ in range(400)]), (10, [6] * 9), (10, [])):
        bins = pack_lengths(sizes, width)
        assert sorted(k for b in bins for k in b) == list(range(len(sizes)))
        assert all(sum(sizes[k] for k in b) <= width for b in bins)
        assert len(bins) <= len(best_fit(sizes, width))


def test_words_that_end_in_marks_and_punctuation():
    """Ids of any text are the tokenizer's, also where lower-casing a letter adds a mark before the punctuation."""
    from tokenizers import Tokenizer

    from wallframe.llm.swap_packing import WordTokens

    tokenizer, words = Tokenizer.from_file(TOKENS), WordTokens(TOKENS)
    rng = random.Random(3)
    letters = ["\u0130", "I", "i", "ß", "É", "é", "e\u0301", "Ǆ", "ﬁ", "Σ", "\u0345", "ab", "x", "7", "'", "-"]
    for _ in range(4000):
        text = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) + rng.choice(["", ".", ",", "!", ".)"]) for _ in range(4))
        assert words.ids(text.encode()) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_every_bin_may_give():
    """Going on past the emptiest bins never needs more of them."""
    rng = random.Random(9)
    for _ in range(20):
        sizes = [rng.randint(100, 700) for _ in range(300)]
        start = best_fit(sizes, 1000)
        few = improve([list(b) for b in start], sizes, 1000, donors=2)
        assert sorted(k for b in few for k in b) == list(range(300)) and all(sum(sizes[k] for k in b) <= 1000 for b in few)
        assert len(few) <= len(start)


def test_exchange_empties_a_bin():
    # 6+3 and 5+4 fill 9 of 10 each; exchanges let the last piece in.
    sizes = [6, 3, 5, 4, 1, 1]
    assert len(improve([[0, 1], [2, 3], [4, 5]], sizes, 10)) == 2
    # One for one: 7|6 and 4|3 pair up as 7+3 and 6+4.
    sizes = [7, 6, 4, 3]
    assert len(improve([[0], [1, 3], [2]], sizes, 10)) == 2
    # Two for one.
    sizes = [5, 4, 5, 2, 2, 2]
    assert sum(sizes) == 20 and len(improve([[0, 1], [2, 3], [4, 5]], sizes, 10)) == 2


def test_pack_documents(spark, docs_of):
    from tokenizers import Tokenizer

    ready(spark)
    tokenizer = Tokenizer.from_file(TOKENS)
    rng = random.Random(7)
    texts = [None, "", "  \n", "It's <|endoftext|> é é x\x85y z \U0001f600", "12 34\t5", "A" * 3000]
    texts += [" ".join(rng.choice(["Alpha", "beta,", "g4mma", "ΔΣ", "don't", "…"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    texts.append("long words " * 9000)
    rows = list(enumerate(texts)) + [(4, "12 34\t5")]
    got = pack_documents(docs_of(rows), TOKENS).collect()
    wanted = Counter()
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], dtype="<u4")
            wanted[doc_id, piece, at, len(part), crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    # The bound by volume is 38; pieces here are few and large, and two bins above it is what exchanges reach.
    assert len(sequences) <= 2 - (-sum(r["length"] for r in got) // 2048)
    assert pack_documents(docs_of([]), TOKENS).count() == 0
    assert [r["doc_id"] for r in pack_documents(docs_of([(None, "a")]), TOKENS).collect()] == [None]
