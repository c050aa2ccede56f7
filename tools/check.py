"""Compare queries with their SQL checks: ``python tools/check.py [sf] [name-part ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from proseloom.plans import registry  # noqa: E402
from proseloom.plans.tables import GIVEN  # noqa: E402
from proseloom.session import local_session  # noqa: E402


def plain(v):
    import datetime
    import decimal

    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and v == int(v):
        return int(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr), [columns[i] for i in order]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    root = f"/root/testdata/sf{sf}"
    registry.load()
    spark = local_session(8)
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    bad = 0
    for name, fn in registry.QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, root)
            got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark {type(e).__name__}: {str(e)[:1500]}", flush=True)
            bad += 1
            continue
        t1 = time.time()
        if name not in registry.CHECKS:
            print(f"rows {name}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(registry.CHECKS[name])
            want, wcols = rows_of([d[0] for d in cur.description], cur.fetchall())
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: sql {str(e)[:600]}", flush=True)
            bad += 1
            continue
        ok = got == want and cols == wcols
        print(f"{'ok  ' if ok else 'DIFF'} {name}: {len(got)}/{len(want)} rows spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s",
              flush=True)
        if not ok:
            bad += 1
            print("   ", cols, wcols)
            g, w = set(map(repr, got)), set(map(repr, want))
            print("    only spark:", [x[:400] for x in sorted(g - w)[:3]], len(g - w))
            print("    only sql:  ", [x[:400] for x in sorted(w - g)[:3]], len(w - g))
    print("problems:", bad)


main()
