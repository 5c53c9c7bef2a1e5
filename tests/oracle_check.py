"""Run queries next to their SQL: ``python tests/oracle_check.py <sf dir> [name prefix ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _cell(value) -> str:
    if value is None or value != value:
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or type(value).__module__ == "numpy":
        return repr(round(float(value), 6) + 0.0)
    return str(value)


def _rows(columns, rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(_cell(row[k]) for k in order) for row in rows)


def compare(df, con, sql: str) -> str:
    """Empty text if both sides agree, else what differs."""
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    right = _rows([d[0] for d in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} / {len(right[1])}"
    wrong = [(a, b) for a, b in zip(left[1], right[1], strict=True) if a != b]
    return f"{len(wrong)} of {len(left[1])} rows differ, e.g. {wrong[0]}" if wrong else ""


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def types(df, con, sql: str) -> str:
    """Columns whose Spark and SQL types are not the same kind."""
    right = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    pairs = [(f.name, f.dataType.simpleString(), right.get(f.name)) for f in df.schema.fields]
    return "; ".join(f"{n} {a}/{b}" for n, a, b in pairs if _KINDS.get(a) != b)


def main() -> None:
    import __spark_entry__ as entry

    from wallframe.session import build_session

    sf, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = connect(sf), entry.oracle_sql()
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            df = fn(spark, sf)
            if name in oracle:
                outcome = compare(df, con, oracle[name]) or f"ok {types(df, con, oracle[name])}"
            else:
                outcome = f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            text = str(error)
            outcome = f"FAILED {type(error).__name__}: {text[:1500]}"
        print(f"{name:28s} {time.time() - started:6.2f}s {outcome}", flush=True)


if __name__ == "__main__":
    main()
