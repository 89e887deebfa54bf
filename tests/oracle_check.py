"""Runs registered queries next to their comparison SQL.  ``python tests/oracle_check.py sf_dir [name ...]``"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return str(v)
        return round(v, 6) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    return v


def canonical(names: list[str], rows: list[tuple]) -> list[tuple]:
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def compare(df, con, sql: str) -> tuple[bool, str]:
    mine = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = dict(zip(names, [str(d[1]) for d in cur.description]))
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} / {sorted(names)}"
    a, b = canonical(df.columns, mine), canonical(names, theirs)
    if len(a) != len(b):
        return False, f"rows {len(a)} / {len(b)}; e.g. {set(a[:2000]) ^ set(b[:2000])}"[:900]
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a)} differ on {sorted(names)}: {bad[:2]}"[:1200]
    odd = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    off = [(n, t, kinds[n]) for n, t in df.dtypes if odd.get(t) != kinds[n] and not (t.startswith(("array", "map", "struct", "timestamp")))]
    return True, f"{len(a)} rows" + (f" TYPES {off}" if off else "")


def main() -> None:
    import __spark_entry__ as entry
    from emberlog.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                ok, note = compare(df, con, oracle[name])
            else:
                ok, note = True, f"{len(df.collect())} rows, no SQL"
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:1200]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t0:6.2f}s {note}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
