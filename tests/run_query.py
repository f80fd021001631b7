"""python tests/run_query.py SF QUERY...: time each query and hold it against its SQL."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from reportlake.session import local_session  # noqa: E402


def oracle(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    plain = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted(repr(tuple(map(plain, r))) for r in df.astype(object).where(df.notna(), None).itertuples(index=False, name=None))


def main(sf: str, names: list[str]) -> None:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/{sf}"
    sql, qs = entry.oracle_sql(), entry.queries()
    con = oracle(sf_dir)
    for name in names or qs:
        t = time.time()
        try:
            df = qs[name](spark, sf_dir)
            pdf = df.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name}: ERROR {str(e)[:1500]}", flush=True)
            continue
        took = time.time() - t
        verdict = ""
        if name in sql:
            try:
                o = con.sql(sql[name]).df()
                a, b = canonical(pdf), canonical(o)
                verdict = "same" if a == b and sorted(pdf.columns) == sorted(o.columns) else f"DIFFERENT {len(a)} {len(b)} {[x for x in a if x not in set(b)][:3]} {[x for x in b if x not in set(a)][:3]}"
            except Exception as e:  # noqa: BLE001
                verdict = f"SQL ERROR {str(e)[:800]}"
        print(f"{name}: {len(pdf)} rows {took:.1f} s {verdict}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
