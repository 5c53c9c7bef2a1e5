"""Line labels, toxicity and secrets against plain versions."""

from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from wallframe.llm import crf_lines, secret_owners
from wallframe.llm import toxic_neighbours as toxic
from wallframe.llm.common import ready


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, copies = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in seen
            seen.add(line)
    places = defaultdict(list)
    for k in range(len(words) - 7):
        places[tuple(words[k : k + 8])].append(k)
    covered = {k + d for found in places.values() if len(found) > 1 for k in found for d in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), copies, len(covered)


def texts_for_rules(seed=2):
    rng, out = random.Random(seed), [None, "", "\n\n", "one", "a\x85b \xa0c\x0bd", "x " * 40, "a b c d e f g h " * 3, "ä#$|<> " * 30]
    for _ in range(60):
        words = [rng.choice("aa bb cc dd éé ff gg hh ii jj".split()) for _ in range(rng.randint(5, 120))]
        out.append("".join(w + rng.choice([" ", " ", "\n", "  ", "\t"]) for w in words))
    return out


def test_base_rules(spark, docs_of):
    ready(spark)
    rows = list(enumerate(texts_for_rules()))
    model = crf_lines.Model(np.zeros(len(crf_lines.FEATURES)), np.zeros((2, 2)))
    model.weights[0] = 1.0
    for r in docs_of(rows).select("doc_id", crf_lines.judged(model).alias("j")).select("doc_id", "j.*").collect():
        want = plain_base(rows[r["doc_id"]][1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r["kept"] == (not r["base_failed"]) and set(r["labels"]) <= {"c"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for size in range(1, 9):
        scores, moves = rng.normal(size=size), rng.normal(size=(2, 2))
        value = lambda path: sum(s for s, y in zip(scores, path, strict=True) if y) + sum(moves[a, b] for a, b in itertools.pairwise(path))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=size), key=value)
        assert tuple(crf_lines.viterbi(scores, moves)) == best


def test_crf_gradient_fits_labels():
    good = [(1, [sum(1 << k for k in (0, 4, 14))] * n) for n in (3, 5, 9)] * 5
    bad = [(0, [sum(1 << k for k in (0, 1, 5, 6))] * n) for n in (2, 6, 12)] * 5
    model = crf_lines.fit(good + bad)
    assert crf_lines.viterbi(model.scores([[0, 4, 14]] * 4), model.moves) == [1] * 4
    assert crf_lines.viterbi(model.scores([[0, 1, 5, 6]] * 4), model.moves) == [0] * 4
    empty = crf_lines.fit([])
    assert crf_lines.viterbi(empty.scores([[0]]), empty.moves) == [0]


def test_held_out_quality(spark):
    """Fitted on two thirds of the labels, the verdict agrees with the rest."""
    from wallframe.llm.common import table

    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    limits = crf_lines.Limits(rounds=120)
    model = crf_lines.fit(crf_lines.training_segments(docs, labels.filter("doc_id % 3 > 0"), limits), limits)
    rest = labels.filter("doc_id % 3 = 0").join(docs, "doc_id").select("quality", crf_lines.judged(model).alias("j")).select("quality", "j.*").collect()
    fair = [r for r in rest if not r["base_failed"]]
    clean = [r for r in fair if r["quality"] == 1]
    junk = [r for r in fair if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.97 * len(clean)
    assert sum(not r["kept"] for r in junk) >= 0.8 * len(junk)


@pytest.mark.parametrize("block", [2, 64])
def test_block_max_search_is_exact(block):
    rng = np.random.default_rng(3)
    features, vectors = 30, []
    for _ in range(200):
        terms = np.sort(rng.choice(features, rng.integers(1, 6), replace=False))
        weights = rng.random(len(terms)) + 0.1
        vectors.append((terms, weights / np.linalg.norm(weights)))
    counts = rng.integers(1, 4, 200).tolist()
    index = toxic.Index.build(vectors, counts, [0] * 200, [[k] for k in range(200)], features, block)
    dense = np.zeros((200, features))
    for k, (terms, weights) in enumerate(vectors):
        dense[k, terms] = weights
    for k in range(0, 200, 7):
        scores = np.round(dense @ dense[k], 9)
        order = sorted((-s, e) for e, s in enumerate(scores) if s > 0)
        held, last, want = 0, None, []
        for value, entry in order:
            if last is not None and -value < last:
                break
            want.append((-value, entry))
            held += counts[entry]
            if last is None and held >= 15:
                last = -value
        values, entries = index.nearest(*vectors[k], 15)
        assert sorted(entries.tolist()) == sorted(e for _, e in want)
        assert np.allclose(values, [s for s, _ in want], atol=1e-8)


def test_isotonic_rises():
    x = np.array([0.1, 0.2, 0.2, 0.4, 0.5, 0.9])
    edges, values = toxic.isotonic(x, np.array([0, 1, 0, 0, 1, 1]))
    assert (np.diff(values) > 0).all() and (np.diff(edges) > 0).all()


def test_toxicity_on_held_out_rows(spark):
    from wallframe.llm.common import table

    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxic.fit(docs, toxic.learnable(labels))
    scored = docs.select("doc_id", toxic.held_out().alias("held_out"), *toxic.toxicity(docs, model)).join(labels, "doc_id").filter("held_out").collect()
    hits = [r for r in scored if r["toxic"] == 1]
    clean = [r for r in scored if r["toxic"] == 0]
    assert sum(r["predicted"] for r in hits) >= 0.75 * len(hits)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    assert np.mean([(r["score"] - r["toxic"]) ** 2 for r in scored]) < 0.04


def test_toxicity_edges(spark, docs_of):
    ready(spark)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = docs_of([(1, "a b"), (2, None), (None, "")])
    assert [r["score"] for r in docs.select(*toxic.toxicity(docs, toxic.fit(docs, labels))).collect()] == [0.0] * 3
    rows = [(k, ("scum trash " if k % 4 == 0 else "") + "plain words here") for k in range(400)] + [(None, None), (7, "scum")]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxic.fit(docs, toxic.learnable(labels))
    for r in docs.select("text", *toxic.toxicity(docs, model)).collect():
        assert r["predicted"] == int("scum" in (r["text"] or ""))
        assert 0 <= r["score"] <= 1
    assert docs_of([]).select(*toxic.toxicity(docs_of([]), model)).count() == 0


def plain_secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


def test_secrets(spark, docs_of):
    ready(spark)
    hexes, key = "0123456789abcdef" * 2, "AKIA" + "Q7" * 8
    own, shared = "zX81kQp03LmT5vRw92Ya", "Ab3dEf6hIj9kLmN0pQr5"
    texts = [
        None, "", 'é token = "' + hexes + '" ü', f"secret=token:abcdefghijkl {key} ß {key[:15]}", "PASSWD : short api_key='longer.value' ſecret=abcdefghij",
        f"xx{hexes}ff {own} {own}", f"token: {hexes}", *[f"see {shared} é" for _ in range(12)], "password=secret=abcdefgh", "no = nothing",
    ]
    rows = [(k, text, f"owner{k}") for k, text in enumerate(texts)]
    rows += [(6, texts[6], None), (None, texts[5], "owner5")]
    got = secret_owners.find_secrets(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    for doc_id, text, _ in rows:
        base = plain_secrets(text)
        for r in by_id[doc_id]:
            assert r["base_sha256"] == sha256(",".join(base).encode()).hexdigest()
            kept = [s for s in r["spans"].split(",") if s and not s.startswith("owned")]
            assert kept == base
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
    assert by_id[5][0]["spans"].count("owned") == 2
    assert "owned" not in by_id[8][0]["spans"]
    assert secret_owners.find_secrets(docs_of([])).count() == 0


def test_ownership_counts(spark):
    ready(spark)
    rows = [("h", f"o{k % 3}", f"r{k}") for k in range(9)] * 2 + [("g", "o", None), ("g", "o", "r")] + [("n", None, None)]
    got = {r["hash"]: r for r in secret_owners.ownership(spark.createDataFrame(rows, "hash string, owner string, repository string")).collect()}
    assert (got["h"]["owners"], got["h"]["repositories"], got["h"]["live"]) == (3, 9, False)
    assert (got["g"]["owners"], got["g"]["repositories"], got["g"]["live"]) == (1, 2, True)
    assert got["n"]["live"]


def test_scores_rise_with_votes():
    """Pools of any sizes: values never fall, and stay the shares of their pools up to a tenth of a vote."""
    x = np.repeat([0.1, 0.2], [1, 1000])
    values = toxic.isotonic(x, np.repeat([0, 1, 0], [1, 10, 990]))[1]
    assert (np.diff(values) >= 0).all() and len(values) == 1
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = np.repeat(rng.random(12), rng.integers(1, 60, 12))
        edges, values = toxic.isotonic(x, (rng.random(len(x)) < rng.random(12).repeat(np.bincount(np.unique(x, return_inverse=True)[1], minlength=12))[: len(x)]).astype(int))
        assert (np.diff(values) > 0).all() and (np.diff(edges) > 0).all() and (values >= 0).all() and (values <= 1).all()
