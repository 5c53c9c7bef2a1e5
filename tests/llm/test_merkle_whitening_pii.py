"""Merkle manifests, whitening and personal data against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from wallframe.llm import cholesky_whitening, merkle_rank, queries, weak_pii
from wallframe.llm.common import ready


def digest(text):
    return sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """(root, path of each leaf) of a binary tree in which a single last node is hashed alone."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
    paths = []
    for place in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            other = place ^ 1
            path.append(("left" if other < place else "right", level[other]) if other < len(level) else ("alone", ""))
            place >>= 1
        paths.append(path)
    return levels[-1][0], paths


def plain_leaf(doc_id, source, lang, n_chars, text):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return digest("".join(parts))


def plain_manifest(rows):
    """The result of op11, from (doc_id, text, lang, source, n_chars) rows."""
    groups = {}
    for doc_id, text, lang, source, n in rows:
        hit = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        own = plain_leaf(doc_id, source, lang, n, text)
        groups.setdefault(lang, []).append((doc_id, own, plain_leaf(doc_id, source, lang, n + 1, text) if hit else own))
    order = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    for found in groups.values():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {lang: plain_tree([r[1] for r in groups[lang]]) for lang in order}
    root, tops = plain_tree([trees[lang][0] for lang in order])
    out = []
    for lang, top in zip(order, tops, strict=True):
        for (doc_id, own, used), path in zip(groups[lang], trees[lang][1], strict=True):
            fold = used
            for side, other in path + top:
                fold = digest(other + fold) if side == "left" else digest(fold + other)
            out.append((doc_id, own, trees[lang][0], root, digest("".join(other for _, other in path + top)), fold, fold == root))
    return out


def documents(spark, rows):
    full = [(*r, "x", 1.5) for r in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, slot string, row double")


def merkle(docs, **more):
    text = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    leaf = merkle_rank.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), text, F.col("text"))
    found = merkle_rank.manifest(docs, changed=merkle_rank.altered(F.col("doc_id"), F.col("n_chars"), leaf), **more)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def key(row):
    return tuple("" if v is None else str(v) for v in row)


@pytest.mark.parametrize("levels", [1, 3, 12])
def test_manifest(spark, levels):
    rng = random.Random(levels)
    ids = rng.sample(range(-300, 5000), 90)
    rows = [(i, f"text {i} ä", rng.choice(["en", "en", "en", "de", "", None, "é"]), rng.choice(["s", None]), rng.choice([3, None, i])) for i in ids]
    # Null ids, equal ids with other texts, equal rows, the ends of the range, a group of one.
    rows += [(None, None, "en", None, None), (None, "b", "en", "s", 2), (None, "b", "en", "s", 2)]
    rows += [(77, f"again {k}", "en", "s", k) for k in range(9)] + [(78, "same", "en", "s", 1)] * 5 + [(64, "w", "en", "s", 1)]
    rows += [(-(1 << 63), "low", "en", "s", 1), ((1 << 63) - 1, "high", "en", "s", (1 << 63) - 1), (5, "long " * 40000, "xx", "s", 9)]
    rng.shuffle(rows)
    found = merkle(documents(ready(spark), rows), levels=levels).collect()
    assert sorted(map(key, found)) == sorted(map(key, plain_manifest(rows)))


def test_manifest_of_one_and_none(spark):
    one = [(3, None, None, None, None)]
    assert [tuple(r) for r in merkle(documents(ready(spark), one)).collect()] == plain_manifest(one)
    assert merkle(documents(spark, [])).collect() == []


def test_manifest_of_one_group_holding_most_rows(spark):
    rows = [(k * 3, f"t{k}", "en" if k % 5 else f"l{k}", "s", k) for k in range(400)]
    found = merkle(documents(ready(spark), rows), levels=2).collect()
    assert sorted(map(key, found)) == sorted(map(key, plain_manifest(rows)))


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumn("component", F.lit("x")).withColumn("v", F.lit(1))


def plain_whitening(rows, components=8):
    fit = [(i, [int(np.floor(1024 * float(c))) + 100000 for c in v]) for i, v in rows]
    n, sums = len(fit), [sum(col) for col in zip(*[v for _, v in fit], strict=True)]
    deviation = [sum((n * x - s) ** 2 for x, s in zip(v, sums, strict=True)) for _, v in fit]
    away = np.array([[(n * x - s) / n for x, s in zip(v, sums, strict=True)] for _, v in fit])
    values, parts = np.linalg.eigh(away.T @ away / n)
    values, parts = values[::-1], parts[:, ::-1]
    return [i for i, _ in fit], n, deviation, away @ parts[:, :components] / np.sqrt(values[:components]), values / values.sum()


@pytest.mark.parametrize("spread", [1.0, 1e4])
def test_whitening(spark, spread):
    rng = np.random.default_rng(4)
    scale = np.geomspace(1, spread, 12)
    good = [(k, [float(np.float32(x)) for x in rng.normal(size=12) * scale]) for k in range(150)]
    good.append(good[0])
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] + [0.0] * 11), (904, []), (905, [1.0] * 5), (906, [1e30] * 12)]
    rows = vectors(ready(spark), good + bad)
    model = cholesky_whitening.fit(rows)
    assert model.identity_error < 1e-9
    found = {}
    for r in cholesky_whitening.whiten(rows, model).collect():
        found.setdefault(r["vec_id"], []).append(r)
    ids, n, deviation, white, explained = plain_whitening(good)
    assert set(found) == set(ids)
    sign = np.sign([next(r for r in found[5] if r["component"] == c + 1)["whitened"] / white[5][c] for c in range(8)])
    for k, i in enumerate(ids):
        for r in found[i]:
            c = r["component"] - 1
            assert (r["n"], r["deviation"]) == (n, deviation[k] if deviation[k] < 1 << 63 else None)
            assert abs(r["whitened"] - sign[c] * white[k][c]) < 1e-7
            assert abs(r["explained"] / explained[c] - 1) < 1e-9
    assert len(found[0]) == 16 and len(found[1]) == 8


def test_whitening_without_full_rank(spark):
    rng = np.random.default_rng(5)
    low = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 10))
    exact = [(k, [float(np.floor(1024 * x)) / 1024 for x in row] + [2.0]) for k, row in enumerate(low.round(2))]
    repeated = [(k, v[:3] + v[:3] + [1.0]) for k, v in exact]
    model = cholesky_whitening.fit(vectors(ready(spark), repeated, "double"))
    assert model.components.shape == (7, 3) and model.identity_error < 1e-9
    whole = cholesky_whitening.fit(vectors(spark, exact, "double"))
    assert whole.identity_error < 1e-9
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4, [(1, [])]):
        frame = vectors(spark, rows, "double")
        assert cholesky_whitening.whiten(frame, cholesky_whitening.fit(frame)).collect() == []


def test_shifted_factor_of_a_singular_matrix():
    g = np.ones((3, 3))
    upper = cholesky_whitening.shifted_factor(g, 3, shift=False)
    assert np.allclose(upper.T @ upper, g) and np.allclose(upper, np.triu(upper))
    rows = np.random.default_rng(1).normal(size=(5, 3))
    wide = np.triu(np.random.default_rng(2).normal(size=(3, 3))) + 3 * np.eye(3)
    assert np.allclose(cholesky_whitening.solved(rows, wide) @ wide, rows)


def test_large_deviations_are_exact():
    centre = cholesky_whitening.Centre(3, (3 << 40, 5))
    x = np.array([[1 << 39, 1], [(1 << 40) + 1, 2], [0, 2]])
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, centre.sums, strict=True)) for row in x]
    assert cholesky_whitening.deviations(x, centre) == [w if w < 1 << 63 else None for w in want]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_personal(text):
    """(kind number, start, end) of the base kinds, in order."""
    text, found = text or "", []
    found += [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 16, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                found.append((kind, m.start(), m.end()))
    return sorted(found)


def written(found):
    return ",".join(f"{weak_pii.KINDS[k]}:{s}:{e}" for k, s, e in found)


CARDS = ["4111111111111111", "5500 0000 0000 0004", "4012-8888-8888-1881", "6011000990139424"]


def personal_texts(seed=7):
    rng, out = random.Random(seed), [None, "", " ", "a@b.c_d@e.f", "a@b.c@d.e.", "x@y..z @a.b a@-.-", "1.2.3.4.5.6.7.8", "1.2.3.256 0001.2.3.4", "1 2-3 4--5 6", "+1+1 +12 (((", "ü😀 a@b.de 😀"]
    parts = [*CARDS, "a@b.c", "x.y%z+q@m-n.o.p", ".@a.b", "10.0.0.1", "300.1.1.1", "1.2.3", "+1 (743) 555-3824", "+49-30-1234567", "+1 2", "+123456789012345678", "7", "12", "\n", " ", "-", "_", "@", ".", "ä", "😀", "word", "(", ")", "+"]
    for _ in range(150):
        out.append("".join(rng.choice(parts) + rng.choice(["", " ", "", ".", "-"]) for _ in range(rng.randint(1, 14))))
    out.append("12 " * 3000 + "a@b.c " * 700 + "ä" * 50)
    out.append("9" * 30000 + " " + "a.b" * 20000 + "@" + "c.d" * 9000 + " +" + "1 " * 20000)
    return out


def test_base_spans_of_personal_data(spark, docs_of):
    texts = personal_texts()
    found = weak_pii.find_personal(docs_of(list(enumerate(texts)) + [(3, texts[3])])).collect() if ready(spark) else []
    assert len(found) == len(texts) + 1
    for r in found:
        want = plain_personal(texts[r["doc_id"]])
        assert r["base_sha256"] == digest(written(want)), (r["doc_id"], written(want), r["spans"])
        assert [r[f"n_{k}"] for k in weak_pii.KINDS[:4]] == [sum(k == at for k, *_ in want) for at in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert spans[: len(want)] == written(want).split(",") or not want
        assert len(spans) - len(want) <= r["n_added"]


def test_added_spans(spark, docs_of):
    """Parts of merged runs, spelled addresses and cued names are added; numbers that fail and glued ones are not."""
    plain = "some words and other words "
    texts = [plain + f"mail a{k}@b.com or call +1 (743) 555-{1000 + k} card {CARDS[0]} from 8.8.{k}.1 today" for k in range(40)]
    texts += [f'token = "{random.Random(k).getrandbits(56):d}ab" {plain}' for k in range(30)]
    texts += [f"{plain} 9807915762804490 {plain}" for _ in range(20)]
    good = [f"call +1 (743) 555-3824 {CARDS[0]} now", f"card {CARDS[0]} 27.65.93.188 now", "write to jane (at) shop (dot) com please", "contact: Maria Lopez, thanks"]
    rows = list(enumerate(texts + good))
    found = {r["doc_id"]: r for r in weak_pii.find_personal(docs_of(rows)).collect()}
    added = [{rows[i][1][int(s):int(e)] for kind, s, e in (p.split(":") for p in found[i]["spans"].split(",") if p) if kind in weak_pii.KINDS[4:]} for i in range(len(texts), len(rows))]
    assert {"+1 (743) 555-3824", CARDS[0]} <= added[0]
    assert CARDS[0] in added[1]
    assert "jane (at) shop (dot) com" in added[2]
    assert "Maria Lopez" in added[3]
    assert [rows[i][1] for i in range(90) if found[i]["n_added"]] == []
    assert all(found[i]["spans"] == "" for i in range(70, 90))


def test_reliabilities_are_recovered():
    """Expectation-maximisation finds the accuracies that votes were drawn with."""
    rng, counts = random.Random(3), {}
    rates = [(0.9, 0.95), (0.7, 0.8), (0.5, 0.9), (0.3, 0.85), (0.8, 0.7)]
    for _ in range(40000):
        truth = rng.random() < 0.4
        votes = tuple(0 if rng.random() > spoke else (1 if (rng.random() < right) == truth else -1) for spoke, right in rates)
        counts[votes] = counts.get(votes, 0) + 1
    model = weak_pii.reliabilities(counts)
    assert abs(model.prior - 0.4) < 0.08
    for (clean, personal), (_, right) in zip(model.given, rates, strict=True):
        assert abs(personal[2] / (personal[0] + personal[2]) - right) < 0.12
        assert abs(clean[0] / (clean[0] + clean[2]) - right) < 0.12


def test_personal_data_is_native(spark, docs_of):
    """No Python node in the plans, nothing fitted without candidates, and empty tables work."""
    found = weak_pii.find_personal(docs_of([(1, "plain words"), (None, None)])) if ready(spark) else None
    assert [(r["spans"], r["n_added"]) for r in found.collect()] == [("", 0)] * 2
    assert weak_pii.find_personal(docs_of([])).collect() == []
    plan = weak_pii.scan(docs_of([(1, "a@b.c")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_queries_are_registered():
    assert {"op11_merkle_rank", "op12_cholesky_whitening", "op13_weak_pii"} <= set(queries.Q)
