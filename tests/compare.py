"""Run registered queries beside their SQL and compare: columns, row count, every value.

Usage: python tests/compare.py <sf_dir> [query ...]
"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from seriesforge.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir, name):
    """None when both sides agree, else a text that says how they differ."""
    df = entry.queries()[name](spark, sf_dir)
    left = _canonical(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(entry.oracle_sql()[name])
    right = _canonical([d[0] for d in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if left[1] != right[1]:
        only_left = sorted(set(left[1]) - set(right[1]))[:2]
        only_right = sorted(set(right[1]) - set(left[1]))[:2]
        return f"{len(left[1])} vs {len(right[1])} rows\n   spark {only_left}\n   sql   {only_right}"
    return None if left[1] else "no rows"


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    spark, connection = local_session(), duck(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} of {len(names)} differ")


if __name__ == "__main__":
    main()
