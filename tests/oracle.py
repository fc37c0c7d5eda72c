"""Runs a query and its SQL over the same tables and compares them as sorted rows."""

import datetime
import glob

import duckdb

SF = "/root/testdata/sf0.01"


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return bytes(v) if isinstance(v, bytearray) else v


def _sorted(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(df, sql: str, d: str = SF) -> int:
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {p.split('/')[-1][:-8]} as select * from '{p}'")
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    got = df.select(*names).collect()
    assert len(got) == len(want), (len(got), len(want))
    g, w = _sorted(got), _sorted(want)
    bad = [(a, b) for a, b in zip(g, w, strict=True) if a != b]
    assert not bad, bad[:3]
    return len(got)
