"""Secret scan with corpus-wide ownership frequency.

One pass over the texts finds candidates: the base kinds (assignments, access keys, long hex runs)
and generic tokens with the look of a credential.  Their values leave the pass only as SHA-256.
A value seen in many repositories or owned by several owners is a copied example; one that a
single owner has in few repositories looks live.  Generic tokens count as spans only if they look
live; base spans always stay and carry their verdict.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import materialize
from .common import per_text, text_bytes

# The base kinds of the contract, in its order.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
GENERIC = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")

MAX_OWNERS = 2
MAX_REPOSITORIES = 8
LEAST_ENTROPY = 3.2


def entropy(value: bytes) -> float:
    """Bits per character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def looks_random(value: bytes) -> bool:
    """Digits among letters, and no plain pattern."""
    digits = sum(48 <= byte <= 57 for byte in value)
    letters = sum(65 <= byte <= 90 or 97 <= byte <= 122 for byte in value)
    return digits >= 4 and letters >= 4 and entropy(value) >= LEAST_ENTROPY


def candidates(raw: bytes) -> list[tuple[int, int, int, bytes]]:
    """(kind number, start, end, value) in bytes; generic tokens only where no base span lies."""
    found: list[tuple[int, int, int, bytes]] = []
    if b"=" in raw or b":" in raw:
        found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(raw) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(raw) if len(m[0]) >= 16]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(raw)]
    taken = sorted((start, end) for _, start, end, _ in found)
    place, reach = 0, 0
    for m in GENERIC.finditer(raw):
        while place < len(taken) and taken[place][0] < m.end():
            reach = max(reach, taken[place][1])
            place += 1
        if reach <= m.start() and looks_random(m[0]):
            found.append((3, m.start(), m.end(), m[0]))
    return sorted(found, key=lambda c: (c[1], c[0]))


def scan(raw: bytes) -> tuple[int, int, int, str, list[tuple[int, int, int, str]]]:
    """Counts of the base kinds, their digest, and all candidates with offsets in code points."""
    if not raw:
        found = []
    else:
        found = candidates(raw)
    if found and not raw.isascii():
        # Offsets in code points, from one pass along the sorted ends.
        wanted = sorted({at for _, start, end, _ in found for at in (start, end)})
        points, before, done = {}, 0, 0
        for at in wanted:
            done += len(raw[before:at].decode("utf-8", "replace"))
            points[at], before = done, at
        found = [(kind, points[start], points[end], value) for kind, start, end, value in found]
    many = Counter(kind for kind, *_ in found)
    base = ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end, _ in found if kind < 3)
    hashed = [(kind, start, end, sha256(value).hexdigest()) for kind, start, end, value in found]
    return many[0], many[1], many[2], sha256(base.encode()).hexdigest(), hashed


SCAN = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found array<struct<kind:int,start:bigint,stop:bigint,hash:string>>"


def ownership(found: DataFrame, *, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """hash, owners, repositories, live from rows (hash, owner, repository).

    A null owner or repository counts as one of its own.  Counting starts with one row per
    distinct (hash, owner, repository), so a value copied everywhere is summed before it moves.
    """
    named = found.select("hash", F.coalesce(F.concat(F.lit("="), "owner"), F.lit("")).alias("owner"), F.coalesce(F.concat(F.lit("="), "repository"), F.lit("")).alias("repository"))
    once = named.distinct()
    per_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    owners = per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    shared = once.select("hash", "repository").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.join(shared, "hash").withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))


def find_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", **limits: int
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example: one row per row of ``docs``.

    ``spans`` lists kind:start:end of all spans by start and kind; ``n_live`` and ``n_example``
    count their verdicts.  Null and empty texts have none.
    """
    scanned = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"),
        per_text(lambda: scan, SCAN)(text_bytes(text)).alias("s"),
    ).withColumn("row", F.monotonically_increasing_id())
    # Stored, so that row numbers stay and texts are scanned once.
    stored, _ = materialize(scanned.select("row", "doc_id", "owner", "repository", "s.*"))
    each = stored.select("row", "owner", "repository", F.inline("found"))
    verdicts, _ = materialize(ownership(each, **limits))
    judged = each.join(verdicts.select("hash", "live"), "hash").filter((F.col("kind") < 3) | F.col("live"))
    names = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    per_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", F.concat_ws(":", names, "start", "stop").alias("span")))).alias("all"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )
    listed = per_row.select("row", F.array_join(F.col("all.span"), ",").alias("spans"), "n_live", "n_example")
    return stored.join(listed, "row", "left").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )
