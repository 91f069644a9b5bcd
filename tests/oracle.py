"""Run a registered query and its SQL twin on the same tables and compare the rows."""

from __future__ import annotations

import datetime
import math
import re
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = [(r"INT$|^(BIG|TINY|SMALL|HUGE)?INT", "int"), (r"DOUBLE|FLOAT|DECIMAL", "double"), (r"VARCHAR", "string"), (r"BOOL", "boolean"), (r"TIMESTAMP", "timestamp"), (r"DATE", "date")]


def kind(duck: str) -> str:
    return "bigint" if duck in ("BIGINT", "HUGEINT", "UBIGINT") else "int" if duck in ("INTEGER", "UINTEGER") else next((k for p, k in KINDS if re.search(p, duck)), duck.lower())


def duck_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    types = {c[0]: kind(str(c[1])) for c in cur.description}
    return names, types, cur.fetchall()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return str(v)
    return v


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if the query's rows, columns and types are those of the SQL."""
    names, types, rows = duck_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    spark_types = dict(df.dtypes)
    odd = {c: (spark_types[c], types[c]) for c in order if spark_types[c] != types[c]}
    at = [names.index(c) for c in order]
    want = sorted(([plain(r[i]) for i in at] for r in rows), key=repr)
    have = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    if len(want) != len(have):
        return f"{len(have)} rows and {len(want)}; only here {[h for h in have if h not in want][:3]}; only there {[w for w in want if w not in have][:3]}"
    wrong = [(h, w) for h, w in zip(have, want, strict=True) if h != w]
    if wrong:
        return f"{order}: {len(wrong)} of {len(want)} rows differ: {wrong[:3]}"
    return f"types (here, SQL): {odd}" if odd else "" if want else "no rows"
