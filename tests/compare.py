"""Run registered queries and their SQL side by side: ``python tests/compare.py sf0.01 [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DATA = "/root/testdata"


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    return round(value, 6) if isinstance(value, float) else value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """What differs, or None."""
    df = fn(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = _rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if mine != theirs:
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        return f"{len(mine)}/{len(theirs)} rows; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    return None


def main() -> None:
    from wardlake.plans.oracle import ORACLE
    from wardlake.plans.queries import QUERIES
    from wardlake.session import build_session

    sf_dir = f"{DATA}/{sys.argv[1]}"
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if name not in ORACLE or (len(sys.argv) > 2 and name not in sys.argv[2:]):
            continue
        start = time.time()
        try:
            diff = difference(spark, con, fn, ORACLE[name], sf_dir)
        except Exception as error:  # noqa: BLE001
            diff = f"{type(error).__name__}: {str(error)[:300]}"
        bad += diff is not None
        print("DIFF" if diff else "ok", name, round(time.time() - start, 2), diff or "", flush=True)
    print("without SQL:", sorted(set(QUERIES) - set(ORACLE)), "differences:", bad)


if __name__ == "__main__":
    main()
