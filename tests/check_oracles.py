"""Runs every registered query beside its SQL and compares the rows.

Usage: python tests/check_oracles.py [sf_dir] [query ...]
"""

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else f"{value + 0.0:.6f}"
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, connection, name, sf_dir):
    """Differences between a query and its SQL: (only in Spark, only in SQL), and row count."""
    df = entry.queries()[name](spark, sf_dir)
    found = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    expected = _rows(columns, result.fetchall())
    assert sorted(columns) == sorted(df.columns), (sorted(columns), sorted(df.columns))
    return found - expected, expected - found, sum(found.values())


def main():
    from tests.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, connection, bad = local_session(), duck(sf_dir), []
    for name in names:
        start = time.time()
        try:
            extra, missing, rows = compare(spark, connection, name, sf_dir)
        except Exception as error:
            print(f"{name}: FAILED {str(error)[:1500]}")
            bad.append(name)
            continue
        if extra or missing:
            bad.append(name)
            print(f"{name}: {sum(extra.values())} extra {list(extra)[:3]}")
            print(f"{name}: {sum(missing.values())} missing {list(missing)[:3]}")
        else:
            print(f"{name}: {rows} rows equal, {time.time() - start:.1f} s")
    print("bad:", bad)
    spark.stop()
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
