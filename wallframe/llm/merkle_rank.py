"""Merkle manifest of a dataset, with leaf coordinates from ranked bitmaps.

A leaf's place among the leaves of its group is its rank in the group's bitmap of ids.  Bitmaps are
words of 64 ids: every task builds the words of its rows, words are merged by or, and words without
an id are not kept.  A popcount directory holds the rows before each word, so a rank is one join
on (group, word) and one popcount; leaves are never sorted.  Ids that occur more than once add
their further rows to the directory, and only those rows are numbered among themselves.

With coordinates, every 4096 leaves (2 to the power ``levels``) are the slots of one array.  A task fills the array by slot,
reduces twelve levels and emits one node, so the next round has 1/4096 of the rows; roots of the
groups form a last tree in the order of the groups.  Going down again, each array gets the path of
its node and completes the path of every slot.

Defined results: a null field is ``-``.  Null ids come first in their group; rows of one id ascend by leaf.
Equal rows have equal leaves and slots of their own.  A null group is first and apart from the
empty text.  An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import chunked, ranked, running_sum
from ..store import discard, materialize

LEVELS = 12


def digest(*nodes: str) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def reduced(level: list[str], levels: int | None) -> tuple[list[list[str]], str]:
    """All levels below the last one, and the first node of that.

    ``levels`` fixes the number of reductions; None goes on until one node remains.
    """
    below = []
    while len(level) > 1 if levels is None else len(below) < levels:
        below.append(level)
        level = [digest(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return below, level[0]


def path_of(below: list[list[str]], place: int) -> list[str]:
    """Side and sibling of each level: ``L`` or ``R`` and its digest, ``-`` where a run has one node."""
    path = []
    for level in below:
        other = place ^ 1
        path.append(("R" if place < other else "L") + level[other] if other < len(level) else "-")
        place >>= 1
    return path


def folded(leaf: str, path: Sequence[str]) -> str:
    """The root that a leaf and the siblings of a path give."""
    for step in path:
        leaf = digest(leaf, step[1:]) if step[0] == "R" else digest(step[1:], leaf) if step[0] == "L" else digest(leaf)
    return leaf


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*fields: Column) -> Column:
    """SHA-256 of the fields, each with its byte count before it."""
    return F.unhex(F.sha2(F.concat(*map(_field, fields)).cast("binary"), 256))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet; columns of ``right`` but its keys are added."""
    renamed = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    return left.join(renamed, [F.col(key).eqNullSafe(F.col(f"_r_{key}")) for key in keys], how).drop(*[f"_r_{key}" for key in keys])


def with_slots(rows: DataFrame) -> DataFrame:
    """``rows`` (grp, id, leaf, row, ...) with ``slot``: the 0-based rank within grp by id, then leaf."""
    word, bit = F.shiftright("id", 6), F.coalesce(F.col("id").bitwiseAND(63), F.lit(0)).cast("int")
    ids, _ = materialize(rows.groupBy("grp", "id").agg(F.count(F.lit(1)).alias("n")))
    words = ids.groupBy("grp", word.alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits"), F.sum("n").alias("n")
    )
    repeated, some = materialize(ids.filter("n > 1"))
    directory = chunked(words, ["grp"], [F.col("word")])
    counted = running_sum(directory, ["grp"], [F.col("word")], F.col("n"), "upto").withColumn("before", F.col("upto") - F.col("n"))
    counted = counted.select("grp", "word", "bits", "before")
    lower = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.col("_bit")))
    placed = rows.withColumns({"word": word, "_bit": bit})
    rank = F.col("before") + F.bit_count(F.col("bits").bitwiseAND(lower))
    if some:
        # Further rows of smaller ids in the same word, and the number among the rows of the same id.
        more = repeated.groupBy("grp", word.alias("word")).agg(F.collect_list(F.struct(bit.alias("bit"), (F.col("n") - 1).alias("more"))).alias("repeats"))
        counted = _same(counted, more, ["grp", "word"], "left")
        again = _same(rows.select("grp", "id", "leaf", "row"), repeated.select("grp", "id"), ["grp", "id"])
        numbers = ranked(again, ["grp", "id"], [F.col("leaf"), F.col("row")], "number").select("row", "number")
        placed = placed.join(numbers, "row", "left")
        smaller = F.filter(F.coalesce("repeats", F.array()), lambda r: r["bit"] < F.col("_bit"))
        rank = rank + F.aggregate(smaller, F.lit(0).cast("bigint"), lambda a, r: a + r["more"]) + F.coalesce(F.col("number") - 1, F.lit(0))
    kept = [*rows.columns, rank.alias("slot")]
    return _same(placed, counted, ["grp", "word"]).select(*kept)


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """grp, block, whole, early: the node of each array after all its levels, and as soon as one is left."""

    def reduce(key: tuple, rows: pa.Table) -> pa.Table:
        level = [""] * len(rows)
        for slot, value in zip(rows.column("slot").to_pylist(), rows.column("leaf").to_pylist(), strict=True):
            level[slot % (1 << levels)] = value.hex()
        early = reduced(level, None)[1]
        whole = reduced(level, levels)[1]
        return pa.table({"grp": [key[0].as_py()], "block": [key[1].as_py()], "whole": [whole], "early": [early]})

    parts = nodes.select("grp", F.shiftright("slot", levels).alias("block"), "slot", "leaf")
    return parts.groupBy("grp", "block").applyInArrow(reduce, "grp string, block bigint, whole string, early string")


def _up(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """([stored (grp, block, node, single) of each round], (grp, root))."""
    rounds, roots = [], None
    left = 1
    while left:
        blocks, _ = materialize(_blocks(nodes, levels))
        single = blocks.groupBy("grp").agg((F.count(F.lit(1)) == 1).alias("single"))
        stored, _ = materialize(
            blocks.join(single, "grp").select("grp", "block", F.when(F.col("single"), F.col("early")).otherwise(F.col("whole")).alias("node"), "single")
        )
        discard(blocks)
        rounds.append(stored)
        done = stored.filter("single").select("grp", F.col("node").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        rest = stored.filter("not single")
        left = 0 if rest.isEmpty() else 1
        nodes = rest.select("grp", F.col("block").alias("slot"), F.unhex("node").alias("leaf"))
    return rounds, roots


# What every slot below a node needs to know of it.
ABOVE = "path array<string>, subroot string, root string"


def _paths(nodes: DataFrame, above: DataFrame, build, schema: str, levels: int) -> DataFrame:
    """``build(slots, path, subroot, root, rows, path_of_slot)`` of each array with what is above its node."""

    def complete(key: tuple, rows: pa.Table, info: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.Table.from_pylist([], schema=build.arrow)
        top = info.to_pylist()[0]
        level = [""] * len(rows)
        places = [slot % (1 << levels) for slot in rows.column("slot").to_pylist()]
        for place, value in zip(places, rows.column("leaf").to_pylist(), strict=True):
            level[place] = value.hex()
        below, _ = reduced(level, None if top["single"] else levels)
        return build(rows, places, level, below, top)

    left = nodes.withColumn("block", F.shiftright("slot", levels)).groupBy("grp", "block")
    return left.cogroup(above.groupBy("grp", "block")).applyInArrow(complete, schema)


class _Inner:
    """Paths of inner nodes: grp, slot and what is above."""

    arrow = pa.schema([("grp", pa.string()), ("slot", pa.int64()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])

    def __call__(self, rows: pa.Table, places: list[int], level: list[str], below: list[list[str]], top: dict) -> pa.Table:
        paths = [path_of(below, place) + top["path"] for place in places]
        size = len(places)
        columns = [rows.column("grp"), rows.column("slot"), paths, [top["subroot"]] * size, [top["root"]] * size]
        return pa.table(dict(zip(self.arrow.names, columns, strict=True)), schema=self.arrow)


class _Leaves:
    """Proofs of the leaves and the roots that they, or their changed forms, fold to."""

    arrow = pa.schema(
        [("id", pa.int64()), *[(name, pa.string()) for name in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_()), ("depth", pa.int32())]
    )

    def __call__(self, rows: pa.Table, places: list[int], level: list[str], below: list[list[str]], top: dict) -> pa.Table:
        changed = [value and value.hex() for value in rows.column("changed").to_pylist()]
        found = {name: [] for name in self.arrow.names}
        found["id"] = rows.column("id")
        for place, other in zip(places, changed, strict=True):
            path = path_of(below, place) + top["path"]
            folds_to = folded(other or level[place], path)
            found["leaf"].append(level[place])
            found["proof_sha256"].append(digest(*[step[1:] for step in path]))
            found["folded_root"].append(folds_to)
            found["verified"].append(folds_to == top["root"])
            found["depth"].append(sum(step != "-" for step in path))
        found["subroot"], found["root"] = [top["subroot"]] * len(places), [top["root"]] * len(places)
        return pa.table(found, schema=self.arrow)


INNER = f"grp string, slot bigint, {ABOVE}"
LEAVES = "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, depth int"


def _above(stored: DataFrame, heads: DataFrame, upper: DataFrame | None) -> DataFrame:
    """grp, block, single, path, subroot, root of a round's nodes: heads for groups that end here, else ``upper``."""
    ends = stored.filter("single").join(heads, "grp").select("grp", "block", "single", "path", "subroot", "root")
    if upper is None:
        return ends
    inner = stored.filter("not single").join(upper.withColumnRenamed("slot", "block"), ["grp", "block"])
    return ends.unionByName(inner.select("grp", "block", "single", "path", "subroot", "root"))


def _down(nodes: DataFrame, rounds: list[DataFrame], heads: DataFrame, build, schema: str, levels: int) -> DataFrame:
    """``build`` for all ``nodes``; ``heads``: grp, path, subroot, root of each group's root."""
    upper = None
    for k in range(len(rounds) - 1, 0, -1):
        inner = rounds[k - 1].filter("not single").select("grp", F.col("block").alias("slot"), F.unhex("node").alias("leaf"))
        upper, _ = materialize(_paths(inner, _above(rounds[k], heads, upper), _Inner(), INNER, levels))
    return _paths(nodes, _above(rounds[0], heads, upper), build, schema, levels)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(
    docs: DataFrame,
    group: str = "lang",
    doc_id: str = "doc_id",
    fields: Sequence[str] = FIELDS,
    changed: Column | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """leaf, subroot, root, proof_sha256, folded_root, verified, depth and ``doc_id`` of every row of ``docs``.

    ``changed`` is the leaf that is folded in place of a row's own (binary; null: its own).
    """
    other = F.lit(None).cast("binary") if changed is None else changed
    read = docs.select(
        F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("grp"),
        F.col(doc_id).cast("bigint").alias("id"),
        leaf_of(*[F.col(name) for name in fields]).alias("leaf"),
        other.alias("changed"),
    )
    rows, some = materialize(read.withColumn("row", F.monotonically_increasing_id()))
    kind = docs.schema[doc_id].dataType
    if not some:
        return rows.select(F.col("id").cast(kind).alias("doc_id"), *[F.lit(None).cast(k).alias(n) for n, k in _kinds()])
    slots, _ = materialize(with_slots(rows))
    rounds, roots = _up(slots, levels)
    subroots, _ = materialize(roots)
    order = ranked(subroots.select("grp", F.unhex("root").alias("leaf"), F.lit("").alias("all")), ["all"], [F.col("grp")], "number")
    tops, _ = materialize(order.select(F.col("all").alias("grp"), (F.col("number") - 1).alias("slot"), "leaf", F.col("grp").alias("name")))
    upper_rounds, whole = _up(tops, levels)
    head = whole.select("grp", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), "root")
    paths = _down(tops, upper_rounds, head, _Inner(), INNER, levels).join(tops.select("slot", "name"), "slot")
    heads, _ = materialize(paths.select(F.col("name").alias("grp"), "path", "root").join(subroots.withColumnRenamed("root", "subroot"), "grp"))
    proofs = _down(slots, rounds, heads, _Leaves(), LEAVES, levels)
    return proofs.select(F.col("id").cast(kind).alias("doc_id"), *[name for name, _ in _kinds()])


def _kinds() -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in LEAVES.split(", ")][1:]


def altered(doc_id: Column, n_chars: Column, leaf: Column) -> Column:
    """``leaf`` (made with one more character) where 7 divides the CRC-32 of the id; null counts are left alone."""
    return F.when((F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0) & n_chars.isNotNull(), leaf)
