"""SimHash near-duplicates with Golay-code keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  Two bits of difference leave
one segment untouched (pigeonhole) and at most two bits in each other one, so the untouched
segment together with a Golay number of the next segment is a key that two linked fingerprints
share: a join on some 35 bits, where plain segments would give 21.  Candidates are verified.

Equal fingerprints are one row.  A key with many fingerprints is keyed again, by the pigeonhole
over its bits that are not yet fixed, until its bucket is small or few bits are left, so every
bucket has a size bound.  A bucket reports a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.grouping import connected_components
from ..store import discard, materialize, union_all
from .common import per_text, released, text_bytes
from .golay import LENGTH, near_indices

SEGMENTS = ((0, 23), (23, 23), (46, 18))
RADIUS = 2
BUCKET = 2048
LEAST_BITS = 18
CHUNK = 1 << 16


def fingerprint(raw: bytes, width: int = 3) -> int:
    """Signed 64-bit SimHash of the ``width``-word shingles of a UTF-8 text, repeats included."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    count = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, count, CHUNK):
        part = words[start : start + CHUNK + width - 1]
        shingles = zip(*(part[k:] for k in range(width)), strict=False) if len(part) >= width else [part]
        hashes = np.fromiter(map(digest, map(b" ".join, shingles)), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprint_column(text: str = "text", width: int = 3) -> Column:
    """Fingerprint of a text column; null and texts without a word give zero."""
    return per_text(lambda: partial(fingerprint, width=width), "bigint")(text_bytes(text))


def _mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step; keys that meet by accident only cost a verification."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, mask of bits the key does not fix) of unsigned fingerprints."""
    keys, rows, masks = [], [], []
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    for fixed in range(len(SEGMENTS)):
        other = (fixed + 1) % len(SEGMENTS)
        row, number = near_indices(parts[other], min(SEGMENTS[other][1], LENGTH))
        at, size = SEGMENTS[fixed]
        keys.append(_mix((np.int64(fixed) << 40 | parts[fixed][row] << 12 | number).astype(np.uint64)))
        rows.append(row)
        masks.append(np.full(len(row), (2**64 - 1) ^ (((1 << size) - 1) << at), dtype=np.uint64))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(masks)


def narrower_keys(keys: np.ndarray, prints: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Three keys per row: each also fixes a third of the bits that ``masks`` leaves open."""
    out = []
    for mask in np.unique(masks):
        at = np.nonzero(masks == mask)[0]
        open_bits = [bit for bit in range(64) if int(mask) >> bit & 1]
        for part in range(RADIUS + 1):
            fixed = sum(1 << bit for bit in open_bits[part :: RADIUS + 1])
            value = prints[at] & np.uint64(fixed)
            key = _mix(keys[at] ^ _mix(value + np.uint64((part + 1) * 0x9E3779B97F4A7C15 % 2**64)))
            out.append((key, prints[at], np.full(len(at), int(mask) & ~fixed, dtype=np.uint64)))
    return tuple(np.concatenate(column) for column in zip(*out, strict=True))


def forest(prints: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints that differ only within ``mask``."""
    prints = np.sort(prints)
    size = len(prints)
    if size <= BUCKET:
        near = lambda front, free: (np.bitwise_count(prints[front][:, None] ^ prints[free][None, :]) <= RADIUS)
    else:
        single = np.array([1 << bit for bit in range(64) if mask >> bit & 1], dtype=np.uint64)
        pairs = (single[:, None] | single[None, :])[np.triu_indices(len(single), 1)]
        steps = np.concatenate([single, pairs])
    left, right, free = [], [], np.ones(size, dtype=bool)
    for seed in range(size):
        if not free[seed]:
            continue
        free[seed], front = False, np.array([seed])
        while len(front):
            reached = []
            for start in range(0, len(front), 256):
                some = front[start : start + 256]
                if size <= BUCKET:
                    open_ = np.nonzero(free)[0]
                    hit = near(some, open_)
                    found = np.nonzero(hit.any(axis=0))[0]
                    child, parent = open_[found], some[hit[:, found].argmax(axis=0)]
                else:
                    wanted = prints[some][:, None] ^ steps[None, :]
                    place = np.minimum(np.searchsorted(prints, wanted), size - 1)
                    row, column = np.nonzero((prints[place] == wanted) & free[place])
                    child, first = np.unique(place[row, column], return_index=True)
                    parent = some[row[first]]
                free[child] = False
                left.append(prints[parent])
                right.append(prints[child])
                reached.append(child)
            front = np.concatenate(reached)
            if not free.any():
                front = front[:0]
    return (np.concatenate(left), np.concatenate(right)) if left else (prints[:0], prints[:0])


def _unsigned(column: pd.Series) -> np.ndarray:
    return column.to_numpy(dtype=np.int64).view(np.uint64)


def _key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        prints = _unsigned(batch["print"])
        keys, rows, masks = golay_keys(prints)
        yield pd.DataFrame({"key": keys.view(np.int64), "print": prints[rows].view(np.int64), "mask": masks.view(np.int64)})


def _narrower_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            keys, prints, masks = narrower_keys(_unsigned(batch["key"]), _unsigned(batch["print"]), _unsigned(batch["mask"]))
            yield pd.DataFrame({"key": keys.view(np.int64), "print": prints.view(np.int64), "mask": masks.view(np.int64)})


def _bucket_edges(keys: np.ndarray, prints: np.ndarray, masks: np.ndarray) -> pd.DataFrame:
    """Forest edges of complete buckets, rows sorted by key."""
    starts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
    sizes = np.diff(starts)
    two = starts[:-1][sizes == 2]
    a, b = prints[two], prints[two + 1]
    linked = np.bitwise_count(a ^ b) <= RADIUS
    left, right = [a[linked]], [b[linked]]
    for k in np.nonzero(sizes > 2)[0]:
        bucket = slice(starts[k], starts[k + 1])
        mask = int(np.bitwise_or.reduce(masks[bucket]))
        x, y = forest(np.unique(prints[bucket]), mask)
        left.append(x)
        right.append(y)
    x, y = np.concatenate(left), np.concatenate(right)
    return pd.DataFrame({"i": np.minimum(x.view(np.int64), y.view(np.int64)), "j": np.maximum(x.view(np.int64), y.view(np.int64))})


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Buckets of a partition that is sorted by key; memory is one batch and one bucket."""
    held = [np.zeros(0, dtype=np.uint64)] * 3
    for batch in batches:
        columns = [np.concatenate([old, _unsigned(batch[name])]) for old, name in zip(held, ("key", "print", "mask"), strict=True)]
        if not len(columns[0]):
            continue
        cut = int(np.nonzero(columns[0] != columns[0][-1])[0][-1] + 1) if (columns[0] != columns[0][-1]).any() else 0
        if cut:
            yield _bucket_edges(*(column[:cut] for column in columns))
        held = [column[cut:] for column in columns]
    if len(held[0]):
        yield _bucket_edges(*held)


def links(prints: DataFrame) -> DataFrame:
    """i, j: a spanning set of the links (``RADIUS`` bits or fewer) among the distinct values of ``print``."""
    schema = "key bigint, print bigint, mask bigint"
    keyed, _ = materialize(prints.select("print").distinct().mapInPandas(released(_key_rows), schema))
    parts, tables, open_bits = [], [keyed], 64 - min(size for _, size in SEGMENTS)
    while True:
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        small = sizes.filter(F.col("n") <= BUCKET) if open_bits > LEAST_BITS else sizes
        buckets = keyed.join(small.select("key"), "key").repartition("key").sortWithinPartitions("key")
        parts.append(buckets.mapInPandas(released(_edges), "i bigint, j bigint"))
        if open_bits <= LEAST_BITS:
            break
        hot = keyed.join(sizes.filter(F.col("n") > BUCKET).select("key"), "key")
        keyed, left = materialize(hot.mapInPandas(released(_narrower_rows), schema).distinct())
        tables.append(keyed)
        if not left:
            break
        open_bits -= open_bits // (RADIUS + 1)
    found, _ = materialize(union_all(parts).distinct())
    for stored in tables:
        discard(stored)
    return found


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, width: int = 3) -> DataFrame:
    """doc_id, print, component_id: one row per row of ``docs``.

    Fingerprints link at two or fewer differing bits; ``component_id`` is the smallest id
    reachable.  Null and empty texts have fingerprint zero and link like others.  Repeated rows
    stay; a null id is never a component's id unless the component has no other.
    """
    prints, _ = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(text, width).alias("print")))
    heads, _ = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("head")))
    image = F.lit(0).alias("image_id")
    nodes = heads.select(image, F.col("print").alias("hold_index"))
    labels = connected_components(nodes, links(heads).select(image, "i", "j"))
    labels = labels.select(F.col("hold_index").alias("print"), F.col("component").alias("root"))
    named = heads.join(labels, "print")
    smallest = named.groupBy("root").agg(F.min("head").alias("component_id"))
    names, _ = materialize(named.join(smallest, "root").select("print", "component_id"))
    return prints.join(names, "print").select("doc_id", "print", "component_id")


def hex_print(column: str) -> Column:
    """16 lowercase hex digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


# Similar texts rather than near fingerprints: texts that share a shingle of their prefixes, by a bound that loses none.
BITS = 512
LOWEST = 3
SAMPLE = 5000
COMMON = 8
SLICE = 8192
# Pairs of a bucket judged at a time: bounds a worker's memory to some 10 MB beside the bucket.
CELLS = 1 << 18
# Fixed odd multipliers for the places of a shingle.
PLACES = _mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_shingles(raw: bytes, width: int) -> np.ndarray:
    """Distinct hashes of the ``width``-word shingles in order; fewer words are one shingle, none no shingle."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes, used = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)), min(width, len(words))
    sums = np.full(len(words) - used + 1, used, dtype=np.uint64)
    for k in range(used):
        sums = _mix(sums + hashes[k : len(hashes) - used + 1 + k] * PLACES[k % len(PLACES)])
    return np.unique(sums)


def _prefix(raw: bytes, width: int, similarity: float, common: np.ndarray) -> tuple:
    """Number of shingles, their parities, a longer sketch, the lowest ones, and the prefix: the first ones, common ones last.

    The sketch holds parities in two to four bits a shingle, so that it tells long texts apart as
    well as short ones; texts for which ``BITS`` are that many have none.

    Sets of a similarity of t share at least t of the larger one, so each leaves out fewer than
    that many in its prefix and the first shared shingle is in both prefixes.
    """
    shingles = word_shingles(raw, width)
    lanes = max(BITS, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else BITS
    count = np.bincount((shingles % np.uint64(lanes)).astype(np.int64), minlength=lanes)
    sketch = np.packbits((count & 1).astype(bool), bitorder="little")
    parity = np.bitwise_xor.reduce(sketch.reshape(-1, BITS // 8), axis=0).tobytes()
    sketch = sketch.tobytes() if lanes > BITS else None
    ordered = shingles
    if len(common) and len(shingles):
        late = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
        ordered = np.concatenate([shingles[~late], shingles[late]])
    length = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1 if len(shingles) else 0
    return len(shingles), parity, sketch, shingles[:LOWEST].view(np.int64), ordered[:length].view(np.int64)


def _sketches_allow(pairs: pd.DataFrame, similarity: float) -> np.ndarray:
    """False only where the sketches show that the sets' difference is too large; a longer sketch folds onto a shorter one."""
    allowed = np.ones(len(pairs), dtype=bool)
    both = np.nonzero(pairs["sketch_i"].notna().to_numpy() & pairs["sketch_j"].notna().to_numpy())[0]
    if not len(both):
        return allowed
    sides = [pairs[name].to_numpy()[both] for name in ("sketch_i", "sketch_j")]
    widths = [np.fromiter(map(len, side), dtype=np.int64, count=len(both)) for side in sides]
    most = pairs["sizes"].to_numpy()[both] * ((1 - similarity) / (1 + similarity)) + 1e-6
    for wide in {*zip(*(width.tolist() for width in widths), strict=True)}:
        at = np.nonzero((widths[0] == wide[0]) & (widths[1] == wide[1]))[0]
        bits = [np.frombuffer(b"".join(side[at]), dtype=np.uint64).reshape(len(at), -1, min(wide) // 8) for side in sides]
        differing = np.bitwise_count(np.bitwise_xor.reduce(bits[0], axis=1) ^ np.bitwise_xor.reduce(bits[1], axis=1))
        allowed[both[at]] = differing.sum(axis=1, dtype=np.int64) <= most[at]
    return allowed


def _sketched_rows(similarity: float):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[_sketches_allow(batch, similarity), ["i", "j"]]

    return rows


def _may_link(left: slice | np.ndarray, right: slice | np.ndarray, bits: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """False only where the sets' difference is too large: parities that differ and the sizes' gap are lower bounds of it."""
    a, b = sizes[left][:, None], sizes[right][None, :]
    most = (a + b) * ((1 - similarity) / (1 + similarity)) + 1e-6
    off = np.abs(a - b)
    for lane in range(bits.shape[1]):
        if lane == 0:
            differing = np.bitwise_count(bits[left, lane][:, None] ^ bits[right, lane][None, :]).astype(np.int16)
        else:
            differing += np.bitwise_count(bits[left, lane][:, None] ^ bits[right, lane][None, :])
    return np.maximum(off, differing) <= most


def bucket_pairs(nodes: np.ndarray, groups: np.ndarray, sizes: np.ndarray, bits: np.ndarray, similarity: float, every: bool, apart: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket's members that may link across groups: all of them, or of each member the first.

    ``apart``: the members of the largest group look for no partner, so a bucket costs its size
    times the number of members outside of that group.
    """
    left, right = [nodes[:0]], [nodes[:0]]
    names, group = np.unique(groups, return_inverse=True)
    inside = group == np.bincount(group, minlength=len(names)).argmax() if apart else np.zeros(len(nodes), dtype=bool)
    outside, everyone = np.nonzero(~inside)[0], np.arange(len(nodes))
    step = max(1, CELLS // max(1, len(nodes)))
    for start in range(0, len(outside), step):
        some = outside[start : start + step]
        hit = _may_link(some, everyone, bits, sizes, similarity) & (group[some][:, None] != group[None, :])
        if every:
            hit &= inside[None, :] | (some[:, None] < everyone[None, :])
            row, column = np.nonzero(hit)
        else:
            row = np.nonzero(hit.any(axis=1))[0]
            column = hit[row].argmax(axis=1)
        left.append(nodes[some[row]])
        right.append(nodes[column])
    i, j = np.concatenate(left), np.concatenate(right)
    return np.minimum(i, j), np.maximum(i, j)


def _bucket_rows(similarity: float, every: bool, apart: bool):
    """Buckets of a partition that is sorted by key; memory is one batch and one bucket."""

    def searched(rows: pd.DataFrame) -> pd.DataFrame:
        keys, nodes, groups = (rows[name].to_numpy(dtype=np.int64) for name in ("key", "node", "grp"))
        sizes = rows["size"].to_numpy(dtype=np.int64)
        bits = np.frombuffer(b"".join(rows["bits"]), dtype=np.uint64).reshape(len(rows), -1)
        starts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1).tolist(), len(keys)]
        found = []
        for low, high in zip(starts, starts[1:], strict=False):
            # Searching slices is for grouping copies early; where every pair counts, a bucket is whole.
            for start in range(low, high, high - low if every else SLICE):
                part = slice(start, high if every else min(high, start + SLICE))
                if part.stop - part.start > 1:
                    found.append(bucket_pairs(nodes[part], groups[part], sizes[part], bits[part], similarity, every, apart))
        i, j = (np.concatenate([pair[k] for pair in found]) if found else nodes[:0] for k in range(2))
        return pd.DataFrame({"i": i, "j": j}).drop_duplicates()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            if held and batch["key"].iloc[-1] == held[0]["key"].iloc[-1]:
                held.append(batch)
                continue
            whole = pd.concat([*held, batch], ignore_index=True)
            last = (whole["key"] != whole["key"].iloc[-1]).to_numpy()
            if last.any():
                yield searched(whole[last])
            held = [whole[~last]]
        if held:
            yield searched(pd.concat(held, ignore_index=True))

    return rows


def _mixed(keyed: DataFrame) -> DataFrame:
    """key, node, grp: the members of buckets that hold more than one group."""
    inside = Window.partitionBy("key")
    mixed = keyed.withColumns({"least": F.min("grp").over(inside), "most": F.max("grp").over(inside)}).filter("least < most")
    return materialize(mixed.select("key", "node", "grp"))[0]


def _similar_pairs(met: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, similarity: float, *, every: bool, apart: bool = True) -> DataFrame:
    """i, j: verified links between members of the buckets ``met`` that are in different groups.

    nodes: node, size, bits, sketch.  ``every``: buckets are searched whole for all pairs; else each
    member looks for one partner.  ``apart``: members of a bucket's largest group look for none.
    """
    members = met.join(nodes.select("node", "size", "bits"), "node").select("key", "node", "grp", "size", "bits")
    pairs = members.repartition("key").sortWithinPartitions("key", "grp", "node").mapInPandas(released(_bucket_rows(similarity, every, apart)), "i bigint, j bigint")
    return _verified(pairs, nodes, rows, width, similarity)


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs i, j that are alike: by a lower bound from their sketches, then by whole texts."""
    close, _ = materialize(pairs.filter("i != j").distinct())
    # The parities of a bucket are too few for long texts, whose sets would be copied once per pair.
    told = lambda name: nodes.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"), F.col("sketch").alias(f"sketch_{name}"))
    told = close.join(told("i"), "i").join(told("j"), "j").withColumn("sizes", F.col("size_i") + F.col("size_j"))
    near, _ = materialize(told.select("i", "j", "sizes", "sketch_i", "sketch_j").mapInPandas(released(_sketched_rows(similarity)), "i bigint, j bigint"))
    discard(close)
    wanted = near.select(F.col("i").alias("doc_id")).union(near.select("j")).distinct()
    shingled = per_text(lambda: lambda raw: word_shingles(raw, width).view(np.int64), "array<bigint>")(F.col("raw"))
    # Texts move only where the ids are too many for Spark's own broadcast threshold.
    sets, _ = materialize(rows.join(wanted, "doc_id").select("doc_id", shingled.alias("set")))
    side = lambda name: sets.select(F.col("doc_id").alias(name), F.col("set").alias(f"set_{name}"))
    both = F.size(F.array_intersect("set_i", "set_j"))
    alike = both >= similarity * (F.size("set_i") + F.size("set_j") - both)
    edges, _ = materialize(near.join(side("i"), "i").join(side("j"), "j").filter(alike).select("i", "j").distinct())
    discard(sets)
    discard(near)
    return edges


def _grouped(edges: DataFrame) -> DataFrame:
    """node, root of the linked nodes."""
    image = F.lit(0).alias("image_id")
    linked = edges.select(F.explode(F.array("i", "j")).alias("hold_index")).distinct()
    found = connected_components(linked.select(image, "hold_index"), edges.select(image, "i", "j"))
    return found.select(F.col("hold_index").alias("node"), F.col("component").alias("root"))


def _by_group(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """key, node and grp: the node's component by ``links``."""
    roots, _ = materialize(_grouped(links))
    return keyed.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("grp"))


def _fingerprint_pairs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """i, j: one pair for each link of ``near_components``, from a text to the first of its fingerprint and between those."""
    named = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), fingerprint_column(text).alias("print"))
    prints, _ = materialize(named)
    heads, _ = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("head")))
    same = prints.join(heads, "print").select(F.col("head").alias("i"), F.col("doc_id").alias("j"))
    head = lambda side: heads.select(F.col("print").alias(side), F.col("head").alias(f"head_{side}"))
    near = links(heads).join(head("i"), "i").join(head("j"), "j").select(F.col("head_i").alias("i"), F.col("head_j").alias("j"))
    return same.unionByName(near)


def _common_shingles(rows: DataFrame, width: int) -> np.ndarray:
    """Shingles of at least ``COMMON`` of some ``SAMPLE`` texts; they only set the order, which decides on cost and not on results."""
    every = max(1, -(-rows.count() // SAMPLE))
    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    shingled = per_text(lambda: lambda raw: word_shingles(raw, width).view(np.int64), "array<bigint>")(F.col("raw"))
    found = some.select(F.explode(shingled).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    return np.sort(np.array([r["key"] for r in found.select("key").collect()], dtype=np.int64).view(np.uint64))


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id of the rows of ``docs`` that are linked to another row.

    A pair links if the Jaccard similarity of its ``width``-word shingles is ``similarity`` or more,
    computed on whole texts.  Texts whose fingerprints link by their Golay keys come first.  What those
    miss shares a shingle of its prefixes, and every bucket of a prefix shingle is searched whole,
    so no pair is lost.  The lowest shingles group most copies that are left.  In the prefixes' buckets each text outside of the largest group then looks for one
    partner, so that a copy joins its group by one link; all pairs are formed only between the
    groups that are left after that, so a large group is not paired again.
    Texts without a word link to none.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("raw"))
    common = _common_shingles(rows, width)
    told = per_text(lambda: partial(_prefix, width=width, similarity=similarity, common=common), "size bigint, bits binary, sketch binary, low array<bigint>, prefix array<bigint>")
    told = rows.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("node"), told(F.col("raw")).alias("p")).select("node", "p.*")
    nodes, _ = materialize(told.filter("size > 0"))
    alike = _verified(_fingerprint_pairs(docs, doc_id, text), nodes, rows, width, similarity)
    met = _mixed(_by_group(nodes.select(F.explode("low").alias("key"), "node"), alike))
    alike = alike.unionByName(_similar_pairs(met, nodes, rows, width, similarity, every=False, apart=False))
    discard(met)
    met = _mixed(_by_group(nodes.select(F.explode("prefix").alias("key"), "node"), alike))
    alike = alike.unionByName(_similar_pairs(met, nodes, rows, width, similarity, every=False))
    left = _mixed(_by_group(met.select("key", "node"), alike))
    discard(met)
    alike = alike.unionByName(_similar_pairs(left, nodes, rows, width, similarity, every=True))
    discard(left)
    discard(nodes)
    return _grouped(alike).select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs``, all columns, of which one stays per group of similar texts: the one with the smallest id.

    Ids are expected to differ; rows with a null id and texts without a word stay.
    """
    found = similar_components(docs, doc_id, text, width=width, similarity=similarity)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, F.col(doc_id) == gone["gone_id"], "left_anti")
