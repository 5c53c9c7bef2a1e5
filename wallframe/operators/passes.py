"""Sequential passes over ordered edges, one task per bounded unit.

Greedy decisions depend on order only within a unit (image, threshold, ...), and never cross a
connected component of the unit's edges.  Units of at most ``UNIT_EDGES`` edges are decided by one
pass over their sorted edges; larger units are cut into components first, and a component that is
still larger is left to the caller's rounds.  All paths follow the same strict order, so the
result does not depend on a unit's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize

UNIT_EDGES = 100_000


def take_free(taken: tuple[set, set], a: int, b: int) -> bool:
    """Greedy matching: an edge is taken if both ends are free."""
    if a in taken[0] or b in taken[1]:
        return False
    taken[0].add(a)
    taken[1].add(b)
    return True


def drop_weaker(dropped: tuple[set, set], strong: int, weak: int) -> bool:
    """Suppression: a mask that was not dropped drops its weaker neighbour."""
    if strong in dropped[0]:
        return False
    dropped[0].add(weak)
    return True


def _walk(unit: Sequence[str], a: str, b: str, decide: Callable[[tuple[set, set], int, int], bool]):
    def kernel(batches):
        current, state = None, (set(), set())
        for batch in batches:
            keys = zip(*(batch.column(name).to_pylist() for name in unit), strict=True)
            mask = []
            for key, x, y in zip(keys, batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True):
                if key != current:
                    current, state = key, (set(), set())
                mask.append(decide(state, x, y))
            yield batch.filter(pa.array(mask, pa.bool_()))

    return kernel


def _pass(edges: DataFrame, unit: Sequence[str], a: str, b: str, order: Sequence[Column], decide) -> DataFrame:
    placed = edges.repartition(*unit).sortWithinPartitions(*unit, *order)
    return placed.mapInArrow(_walk(unit, a, b, decide), edges.schema)


def split_units(edges: DataFrame, unit: Sequence[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of units up to ``most`` edges, and the others or None; null keys meet null keys.

    ``edges`` is a stored table.  Where no unit is larger it comes back as it is, without a join.
    """
    sizes = edges.groupBy(*unit).agg(F.count(F.lit(1)).alias("_n"))
    large, many = materialize(sizes.filter(F.col("_n") > most).drop("_n"))
    if not many:
        return edges, None
    renamed = large.withColumnsRenamed({name: f"_large_{name}" for name in unit})
    same = [F.col(name).eqNullSafe(F.col(f"_large_{name}")) for name in unit]
    return edges.join(renamed, same, "left_anti"), edges.join(renamed, same, "left_semi")


def whole_units(batches: Iterator[pa.RecordBatch], unit: str, rows: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole units of batches sorted by ``unit``, and where each unit ends.

    A table holds at most ``rows`` rows, or one larger unit.
    """
    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        if len(held) > rows:
            ends = _unit_ends(held, unit)
            yield from _cut(held, ends[:-1], rows)
            held = held.slice(ends[-2]) if len(ends) > 1 else held
    if held is not None and len(held):
        yield from _cut(held, _unit_ends(held, unit), rows)


def _unit_ends(table: pa.Table, unit: str) -> list[int]:
    return pc.run_end_encode(table[unit].combine_chunks()).run_ends.to_pylist()


def _cut(table: pa.Table, ends: Sequence[int], rows: int) -> Iterator[tuple[pa.Table, list[int]]]:
    start, mine = 0, []
    for end in ends:
        if mine and end - start > rows:
            yield table.slice(start, mine[-1]), mine
            start, mine = start + mine[-1], []
        mine.append(end - start)
    if mine:
        yield table.slice(start, mine[-1]), mine


def ordered_pass(
    edges: DataFrame,
    unit: Sequence[str],
    a: str,
    b: str,
    order: Sequence[Column],
    decide: Callable[[tuple[set, set], int, int], bool],
    *,
    two_sided: bool,
    most: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(accepted edges, edges left to rounds or None).

    ``order`` is strict within a unit.  ``two_sided``: the ends ``a`` and ``b`` are numbered apart.
    """
    from .grouping import connected_components

    most, unit = UNIT_EDGES if most is None else most, list(unit)
    edges, _ = materialize(edges)
    small, large = split_units(edges, unit, most)
    accepted = _pass(small, unit, a, b, order, decide)
    if large is None:
        return accepted, None
    key = F.to_json(F.struct(*unit), {"ignoreNullFields": "false"})
    i, j = (F.col(a) * 2, F.col(b) * 2 + 1) if two_sided else (F.col(a), F.col(b))
    named, _ = materialize(large.withColumn("_unit", key).withColumn("_end", i.cast("bigint")))
    ends = named.select(F.col("_unit").alias("image_id"), F.col("_end").alias("i"), j.cast("bigint").alias("j"))
    nodes = ends.select("image_id", F.explode(F.array("i", "j")).alias("hold_index")).distinct()
    parts = connected_components(nodes, ends.distinct()).withColumnsRenamed({"image_id": "_unit", "hold_index": "_end", "component": "_part"})
    cut, _ = materialize(named.join(parts, ["_unit", "_end"]).drop("_unit", "_end"))
    fitting, rest = split_units(cut, [*unit, "_part"], most)
    accepted = accepted.unionByName(_pass(fitting, [*unit, "_part"], a, b, order, decide).drop("_part"))
    return accepted, None if rest is None else rest.drop("_part")
