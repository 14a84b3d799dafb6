"""Run registered queries against their oracle SQL; usable as a script and from the tests."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from fathom.sources.derived_tables import TABLES  # noqa: E402


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return None if value is None else str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(_plain(r[i])) for i in order) for r in rows)


_FAMILIES = {"bigint": "int", "integer": "int", "int": "int", "hugeint": "int128", "varchar": "string"}


def _types(pairs) -> dict[str, str]:
    return {n: _FAMILIES.get(str(t).lower(), str(t).lower()) for n, t in pairs}


def compare(spark, sf_dir: str, query, sql: str) -> str | None:
    """A text that says what differs, or None."""
    frame = query(spark, sf_dir)
    ours = frame.collect()
    result = oracle_connection(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} / {sorted(names)}"
    left = _types(frame.dtypes)
    right = _types((d[0], d[1]) for d in result.description)
    if left != right:
        return f"types { {n: (left[n], right[n]) for n in left if left[n] != right[n]} }"
    a, b = rows_of(frame.columns, ours), rows_of(names, theirs)
    if len(a) != len(b):
        return f"{len(a)} rows / {len(b)} rows"
    different = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(different)} rows differ, first {different[0]}" if different else None


def main() -> None:
    from fathom.plans.oracles import ORACLES
    from fathom.plans.queries import QUERIES
    from fathom.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    for name in chosen:
        start = time.time()
        if name in ORACLES:
            verdict = compare(spark, sf_dir, QUERIES[name], ORACLES[name]) or "same"
        else:
            verdict = f"{QUERIES[name](spark, sf_dir).count()} rows, no oracle"
        print(f"CHECK {name}: {verdict} ({time.time() - start:.1f}s)", flush=True)


if __name__ == "__main__":
    main()
