"""Run registered queries beside their SQL twins: python -m tests.oracle_check [sf] [name ...]"""

from __future__ import annotations

import hashlib
import sys
import time
import traceback

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf[sorted(pdf.columns)].copy()
    for c in out.columns:
        col = out[c]
        if pd.api.types.is_bool_dtype(col):
            out[c] = col.map(str)
        elif pd.api.types.is_numeric_dtype(col):
            out[c] = col.astype(float).map(lambda v: "null" if pd.isna(v) else f"{v:.9g}")
        else:
            out[c] = col.map(lambda v: "null" if v is None or v is pd.NaT or v is pd.NA or v != v else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def digest(pdf: pd.DataFrame) -> str:
    return hashlib.md5(canonical(pdf).to_csv(index=False).encode()).hexdigest()


def duck(sf_dir: str):
    con = duckdb.connect(config={"memory_limit": "8GB"})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry
    from ionloom.session import build_session

    spark = build_session("8")
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = argv[1:]
    names = [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]
    con = duck(sf_dir)
    bad = 0
    for name in names:
        try:
            t0 = time.time()
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - t0
            if name not in oracles:
                print(f"rows  {name} n={len(got)} {took:.1f}s", flush=True)
                continue
            t0 = time.time()
            want = con.execute(oracles[name]).df()
            duck_s = time.time() - t0
            ok = sorted(got.columns) == sorted(want.columns) and len(got) == len(want) and digest(got) == digest(want)
            print(f"{'ok   ' if ok else 'DIFF '} {name} n={len(got)}/{len(want)} {took:.1f}s duck {duck_s:.1f}s", flush=True)
            if not ok:
                bad += 1
                print("  cols", sorted(got.columns), sorted(want.columns))
                if sorted(got.columns) == sorted(want.columns):
                    a, b = canonical(got), canonical(want)
                    m = a.merge(b, how="outer", indicator=True)
                    print(m[m["_merge"] != "both"].head(8).to_string())
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            if len(names) <= 3:
                traceback.print_exc()
    print("bad", bad, "of", len(names))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
