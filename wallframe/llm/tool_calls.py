"""Tool calls and their results, linked, ordered, validated and serialised, in column expressions.

Calls and results meet in a hash join on conversation and identifier.  Arguments that name another
call as ``"$ref:<id>"`` are dependencies; a call's level is the length of its longest chain of
dependencies, so (level, sequence) is a topological order.  Arguments are checked against a table
of field rules and written as canonical JSON: sorted keys, no white space.

Where every call has at most one dependency, levels take pointer jumping (rounds grow with the
logarithm of the longest chain); otherwise calls are peeled level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import ranked
from ..store import discard, materialize, union_all

REFERENCE = r'"\$ref:([^"]*)"'
# JSON type names of field rules and the variant types they stand for.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}
FIELD_RULES = "tool string, field string, type string, required boolean, low double, high double"


def _forest_levels(edges: DataFrame) -> DataFrame:
    """Levels where every node has one dependency: jump to the dependency's dependency until none is left."""
    state, left = materialize(edges.select("g", "id", F.col("dep").alias("up"), F.lit(1).cast("bigint").alias("level")))
    limit, rounds, open_ = left.bit_length() + 1, 0, left
    while open_ and rounds < limit:
        far = state.select("g", F.col("id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        step = state.join(far, ["g", "up"], "left")
        # A dependency without a row of its own is a root.
        jumped = step.select("g", "id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        moved, _ = materialize(jumped)
        discard(state)
        state, rounds = moved, rounds + 1
        open_ = 0 if state.filter(F.col("up").isNotNull()).isEmpty() else 1
    return state.select("g", "id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def _peeled_levels(edges: DataFrame) -> DataFrame:
    """Levels by rounds: calls whose dependencies all have a level get the next one."""
    waiting, left = materialize(edges)
    ids = lambda table: table.select("g", "id").distinct()
    free, _ = materialize(edges.select("g", F.col("dep").alias("id")).distinct().join(ids(edges), ["g", "id"], "left_anti"))
    found, level = [], 0
    while left:
        level += 1
        rest, left = materialize(waiting.join(free.withColumnRenamed("id", "dep"), ["g", "dep"], "left_anti").select("g", "id", "dep"))
        free, some = materialize(ids(waiting).join(ids(rest), ["g", "id"], "left_anti"))
        found.append(free.withColumn("level", F.lit(level).cast("bigint")))
        waiting = rest
        if not some:
            break
    cyclic = ids(waiting).withColumn("level", F.lit(None).cast("bigint"))
    return union_all([*found, cyclic])


def levels(edges: DataFrame) -> DataFrame:
    """g, id, level of the nodes that depend on others; null on a cycle or behind one."""
    several = edges.groupBy("g", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _forest_levels(edges) if several.isEmpty() else _peeled_levels(edges)


def quoted(text: Column) -> Column:
    """A text as a JSON string, null as null."""
    inner = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(inner, F.lit(2), F.length(inner) - 2))


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no white space; null if it does not parse."""
    return F.to_json(F.try_parse_json(json))


def violations(arguments: str, rules: str) -> Column:
    """Sorted ``field:problem`` of JSON arguments against an array of rules.

    Problems: missing, type, range, unknown field; ``json`` alone if the arguments are no object.
    """
    fields = F.from_json(arguments, "map<string,variant>")
    known = F.col(rules)

    def problem(rule: Column) -> Column:
        value = fields[rule["field"]]
        kind = F.schema_of_variant(value)
        wanted = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[rule["type"]]
        number = F.try_variant_get(value, "$", "double")
        absent = value.isNull()
        return (
            F.when(absent & rule["required"], F.concat(rule["field"], F.lit(":missing")))
            .when(absent, F.lit(None).cast("string"))
            .when(~F.regexp_like(kind, F.concat(F.lit("^("), wanted, F.lit(")"))), F.concat(rule["field"], F.lit(":type")))
            .when((number < rule["low"]) | (number > rule["high"]), F.concat(rule["field"], F.lit(":range")))
        )

    found = F.transform(known, problem)
    names = F.transform(known, lambda rule: rule["field"])
    extra = F.transform(F.array_except(F.map_keys(fields), names), lambda name: F.concat(name, F.lit(":unknown")))
    every = F.array_sort(F.filter(F.concat(found, extra), lambda x: x.isNotNull()))
    return F.when(fields.isNull(), F.array(F.lit("json"))).when(known.isNull(), F.array(F.lit("tool:unknown"))).otherwise(every)


def link_calls(calls: DataFrame, results: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per call and per result without one: conv_id, call_id, seq, name, status, n_results, n_missing, level, position, violations, message.

    calls: conv_id, call_id, seq, name, arguments (JSON text); results: conv_id, call_id, content;
    rules as in ``FIELD_RULES``.  Of several results the smallest text is linked and the number kept;
    ``status`` is linked, unanswered, duplicate for a call whose id came before in its conversation, or
    orphan for results without a call, which have no place in the order.  A null conversation or id matches its like.
    ``level`` and ``position`` follow the dependencies; calls on a cycle have a null level and
    come last.  ``message`` is canonical JSON; arguments that do not parse, or repeat a key, are written as null
    and violate ``json``.
    """
    held = calls.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("g"), "conv_id", F.coalesce("call_id", F.lit("")).alias("id"), "call_id", "seq", "name", "arguments",
        F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE))).alias("refs"),
    )
    held, _ = materialize(held.withColumn("row", F.monotonically_increasing_id()))
    heads = held.groupBy("g", "id").agg(F.min_by("row", F.struct("seq", "row")).alias("head"))
    answers = results.groupBy(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("g"), F.coalesce("call_id", F.lit("")).alias("id"))
    answers = answers.agg(
        F.min("content").alias("result"), F.count(F.lit(1)).alias("n_results"), F.max("conv_id").alias("_conv"), F.max("call_id").alias("_call")
    )
    lost = answers.join(heads, ["g", "id"], "left_anti")
    answers = answers.drop("_conv", "_call")
    wanted = held.select("g", "id", F.explode("refs").alias("dep")).distinct()
    ids = held.select("g", F.col("id").alias("dep"), F.lit(True).alias("known")).distinct()
    referred, _ = materialize(wanted.join(ids, ["g", "dep"], "left"))
    missing = referred.filter(F.col("known").isNull()).groupBy("g", "id").agg(F.count(F.lit(1)).alias("n_missing"))
    depth = levels(referred.filter("known").select("g", "id", "dep")).withColumn("dependent", F.lit(True))
    by_tool = rules.groupBy(F.col("tool").alias("name")).agg(F.collect_list(F.struct("field", "type", "required", "low", "high")).alias("rules"))
    joined = held.join(heads, ["g", "id"]).join(answers, ["g", "id"], "left").join(missing, ["g", "id"], "left").join(depth, ["g", "id"], "left").join(by_tool, "name", "left")
    again = F.col("row") != F.col("head")
    linked = joined.select(
        "g", "row", "conv_id", "call_id", "seq", "name", "result",
        F.when(again, F.lit("duplicate")).when(F.col("n_results") > 0, F.lit("linked")).otherwise(F.lit("unanswered")).alias("status"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
        F.when(F.col("dependent"), F.col("level")).otherwise(F.lit(0)).alias("level"),
        F.when(canonical(F.col("arguments")).isNull(), F.lit("json")).otherwise(F.array_join(violations("arguments", "rules"), ",")).alias("violations"),
        canonical(F.col("arguments")).alias("body"),
    )
    placed = ranked(linked, ["g"], [F.col("level").asc_nulls_last(), F.col("seq"), F.col("row")], "position")
    alone = lost.select(
        "_conv", "_call", F.lit(None).cast(held.schema["seq"].dataType).alias("seq"), F.lit(None).cast("string").alias("name"), F.lit("orphan").alias("status"),
        "n_results", F.lit(0).cast("bigint").alias("n_missing"), F.lit(None).cast("bigint").alias("level"), F.lit(None).cast("bigint").alias("position"),
        F.lit("").alias("violations"), F.lit(None).cast("string").alias("body"), "result",
    ).withColumnsRenamed({"_conv": "conv_id", "_call": "call_id"})
    listed = placed.select(alone.columns).unionByName(alone)
    parts = [
        ("arguments", F.coalesce("body", F.lit("null"))), ("id", quoted(F.col("call_id"))), ("name", quoted(F.col("name"))),
        ("position", F.coalesce(F.col("position").cast("string"), F.lit("null"))),
        ("result", quoted(F.when(F.col("status").isin("linked", "orphan"), F.col("result")))),
    ]
    message = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), value) for name, value in parts]), F.lit("}"))
    return listed.select(
        "conv_id", "call_id", "seq", "name", "status", "n_results", "n_missing", "level", "position", "violations", message.alias("message")
    )
