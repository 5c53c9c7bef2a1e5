"""WARC archive, tool calls and extendible hashing against plain versions."""

from __future__ import annotations

import hashlib
import json
import random
from collections import defaultdict

import pytest

from wallframe.llm import extendible, tool_calls, warc_store
from wallframe.llm.common import ready


def page_rows():
    long = "é" * 600
    return [(1, "http://a", long), (2, "http://b", long), (3, None, long), (4, "u\r\nX: y", "x" * 999), (5, "http://c", "x" * 999),
            (6, "http://d", None), (7, "http://e", ""), (8, "http://f", "one\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40)]


def test_warc_round_trip(spark):
    ready(spark)
    pages = spark.createDataFrame(page_rows(), "page_id bigint, url string, html string")
    archive = warc_store.archive_pages(pages)
    got = {r["page_id"]: r for r in warc_store.parsed(archive.read()).collect()}
    for page_id, _, html in page_rows():
        raw = (html or "").encode()
        r = got[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        again = page_id in (1, 2)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if again else ("response", None))
    stored = spark.read.parquet(f"{archive.path}/payloads")
    assert stored.count() == len({(h or "") for _, _, h in page_rows()})
    made = {r["page_id"]: (bytes(r["header"]), bytes(r["payload"])) for r in warc_store.records(pages).collect()}
    read = {r["page_id"]: (bytes(r["header"]), bytes(r["payload"])) for r in archive.read().collect()}
    assert made == read
    files = f"{archive.path}/warc"
    warc_store.export_warc(archive.read(), files)
    back = {bytes(r["header"]): bytes(r["payload"]) for r in warc_store.import_warc(spark, files).collect()}
    assert back == {h: b"" if b"WARC-Type: revisit" in h else p for h, p in made.values()}
    assert warc_store.parsed(warc_store.archive_pages(pages.limit(0)).read()).count() == 0


def test_altered_payload_is_an_error(spark):
    from pyspark.sql import functions as F

    ready(spark)
    archive = warc_store.archive_pages(spark.createDataFrame(page_rows(), "page_id bigint, url string, html string"))
    broken = warc_store.Archive(spark, f"{archive.path}-broken")
    spark.read.parquet(f"{archive.path}/headers").write.parquet(f"{broken.path}/headers")
    spark.read.parquet(f"{archive.path}/payloads").withColumn("payload", F.lit("no").cast("binary")).write.parquet(f"{broken.path}/payloads")
    with pytest.raises(Exception, match="payload lost or altered"):
        broken.read().collect()


def plain_shards(rows, limit):
    hashed = [(int(hashlib.md5(str("" if k is None else k).encode()).hexdigest()[:15], 16), len((t or "").encode())) for k, t in rows]
    out = [None] * len(rows)

    def split(members, depth):
        size = sum(hashed[k][1] for k in members)
        if size <= limit or len({hashed[k][0] for k in members}) == 1:
            for k in members:
                prefix = hashed[k][0] >> (60 - depth)
                out[k] = (format(prefix, f"0{depth}b") if depth else "", size, len(members), size > limit)
            return
        for bit in (0, 1):
            half = [k for k in members if hashed[k][0] >> (59 - depth) & 1 == bit]
            if half:
                split(half, depth + 1)

    split(range(len(rows)), 0)
    return out


@pytest.mark.parametrize("limit", [50, 700, 10**6])
def test_extendible_shards(spark, docs_of, limit):
    ready(spark)
    rng = random.Random(2)
    rows = [(k, "é" * rng.randint(0, 30)) for k in range(300)] + [(None, None), (None, "x" * 40), (7, "y" * 60), (999, "z" * 900)]
    want = plain_shards(rows, limit)
    got = extendible.extendible_shards(docs_of(rows), limit=limit)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["shard"], r["shard_bytes"], r["shard_rows"], r["over_limit"]) for r in got.collect()) == sorted(
        (str(k), len((t or "").encode()), *w) for (k, t), w in zip(rows, want, strict=True)
    )
    slots = {r["slot"]: r["shard"] for r in extendible.directory(got).collect()}
    depth = max(len(w[0]) for w in want)
    leaves = {w[0] for w in want}
    assert all(format(slot, f"0{depth}b").startswith(shard) for slot, shard in slots.items()) and set(slots.values()) == leaves


def test_extendible_empty(spark, docs_of):
    ready(spark)
    assert extendible.extendible_shards(docs_of([])).count() == 0


CALL = "conv_id bigint, call_id string, seq bigint, name string, arguments string"
RESULT = "conv_id bigint, call_id string, content string"


def link(spark, calls, results):
    rules = [("f", "q", "string", True, None, None), ("f", "n", "integer", False, 1.0, 9.0), ("f", "o", "object", False, None, None)]
    frame = tool_calls.link_calls(
        spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), spark.createDataFrame(rules, tool_calls.FIELD_RULES)
    )
    return frame.collect()


def test_links_order_and_validation(spark):
    ready(spark)
    calls = [
        (1, "a", 5, "f", '{"q": "x", "n": 3, "after": "$ref:b"}'), (1, "b", 6, "f", '{ "q":"y\\n\\"é","o":{"z":1,"a":[1, 2.50]} }'),
        (1, "c", 1, "f", '{"q": "$ref:a", "r": "$ref:b", "n": 99}'), (1, "d", 2, "f", '{"q": 4, "z": "$ref:gone"}'), (1, "e", 3, "g", "[1]"),
        (1, "x", 7, "f", '{"q":"$ref:y"}'), (1, "y", 8, "f", '{"q":"$ref:x"}'), (1, "b", 9, "f", "broken"), (2, "a", 1, None, None), (None, None, 1, "f", "{}"),
    ]
    results = [(1, "a", "two"), (1, "a", "one"), (1, "b", None), (2, "zz", "lost"), (None, None, "r")]
    got = link(spark, calls, results)
    rows = {(r["conv_id"], r["call_id"], r["seq"]): r for r in got}
    assert len(got) == len(calls) + 1
    lost = rows[2, "zz", None]
    assert (lost["status"], lost["n_results"], lost["level"], lost["position"]) == ("orphan", 1, None, None) and json.loads(lost["message"])["result"] == "lost"
    assert rows[1, "a", 5]["status"] == "linked" and rows[1, "a", 5]["n_results"] == 2
    assert rows[1, "b", 9]["status"] == "duplicate" and rows[1, "b", 9]["violations"] == "json"
    assert rows[2, "a", 1]["status"] == "unanswered" and rows[None, None, 1]["status"] == "linked"
    assert [rows[1, i, s]["level"] for i, s in (("b", 6), ("a", 5), ("c", 1), ("d", 2), ("x", 7), ("y", 8))] == [0, 1, 2, 0, None, None]
    assert rows[1, "d", 2]["n_missing"] == 1
    order = [r["call_id"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])]
    assert order.index("b") < order.index("a") < order.index("c")
    assert rows[1, "c", 1]["violations"] == "n:range,r:unknown" and rows[1, "d", 2]["violations"] == "q:type,z:unknown"
    assert rows[None, None, 1]["violations"] == "q:missing"
    message = json.loads(rows[1, "b", 6]["message"])
    assert message["arguments"] == {"o": {"a": [1, 2.5], "z": 1}, "q": 'y\n"é'} and list(message) == sorted(message)
    assert rows[1, "b", 6]["message"].startswith('{"arguments":{"o":{"a":[1,2.5],"z":1},"q":')
    assert json.loads(rows[1, "a", 5]["message"])["result"] == "one"
    assert link(spark, [], []) == []


def test_repeated_keys_and_long_arguments(spark):
    ready(spark)
    long = "x" * 300_000
    calls = [(1, "a", 1, "f", '{"q":"x","q":"y"}'), (1, "b", 2, "f", '{"q":"' + long + '"}')]
    rows = {r["call_id"]: r for r in link(spark, calls, [(3, None, None), (None, "c", "r"), (None, "c", "q")])}
    assert rows["a"]["violations"] == "json" and json.loads(rows["a"]["message"])["arguments"] is None
    assert json.loads(rows["b"]["message"])["arguments"] == {"q": long}
    assert rows[None]["status"] == "orphan" and json.loads(rows[None]["message"])["result"] is None
    assert rows["c"]["n_results"] == 2 and json.loads(rows["c"]["message"])["result"] == "q"


@pytest.mark.parametrize("several", [False, True])
def test_levels(spark, several):
    ready(spark)
    rng, edges = random.Random(5), defaultdict(set)
    for k in range(1, 40):
        for _ in range(2 if several else 1):
            edges[k].add(k - 1 if not several else rng.randrange(k))
    if not several:
        edges[50], edges[51], edges[52] = {51}, {50}, {51}
    rows = [(1, str(k), str(d)) for k, deps in edges.items() for d in deps]
    got = {int(r["id"]): r["level"] for r in tool_calls.levels(spark.createDataFrame(rows, "g bigint, id string, dep string")).collect()}

    def level(k):
        return 1 + max(level(d) for d in edges[k]) if edges.get(k) else 0

    assert got == {k: None if k >= 50 else level(k) for k in edges}
