"""Run queries next to their SQL on the same tables and report differences.

    python -m catalog.check /root/testdata/sf0.001 [name ...]
"""

from __future__ import annotations

import math
import shutil
import sys
import tempfile
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        v = round(v, 8) + 0.0
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.8g}" if abs(v) < 1e-3 else f"{v:.8f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf: str, name: str) -> tuple[str, str]:
    from catalog import ORACLES, QUERIES

    df = QUERIES[name](spark, sf)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return ("rows-only", f"{len(got[1])} rows")
    cur = con.execute(ORACLES[name])
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    kinds = {d[0]: str(d[1]) for d in cur.description}
    if got[0] != want[0]:
        return ("FAIL", f"columns {got[0]} vs {want[0]}")
    if got[1] != want[1]:
        only_a = [r for r in got[1] if r not in set(want[1])][:3]
        only_b = [r for r in want[1] if r not in set(got[1])][:3]
        return ("FAIL", f"rows {len(got[1])} vs {len(want[1])}\n   {got[0]}\n   spark {only_a}\n   sql   {only_b}")
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if same.get(t) != kinds[c]}
    return ("ok", f"{len(got[1])} rows" + (f"  types {odd}" if odd else ""))


def main() -> int:
    from pyspark.sql import SparkSession

    from catalog import QUERIES

    sf, names = sys.argv[1], sys.argv[2:]
    picked = [n for n in QUERIES if not names or any(n.startswith(x) for x in names)]
    stages = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.checkpoint.dir", stages).appName("check").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in picked:
        start = time.time()
        try:
            state, note = compare(spark, con, sf, name)
        except Exception as exc:  # noqa: BLE001
            state, note = "ERROR", f"{type(exc).__name__}: {str(exc)[:1200]}"
        bad += state in ("FAIL", "ERROR")
        print(f"{state:9} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} bad of {len(picked)}")
    spark.stop()
    shutil.rmtree(stages, ignore_errors=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
