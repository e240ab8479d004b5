"""Every registered query against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import pathlib
import re
import sys

import duckdb
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
from vocalis.plans import registry

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.datetime)):
        return v
    return float(v) if isinstance(v, int) else str(v)


def table(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(([plain(r[i]) for i in at] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert df.columns
        return
    con = duckdb.connect()
    for p in pathlib.Path(DIR).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cur = con.execute(ORACLE[name])
    want = table([c[0] for c in cur.description], cur.fetchall())
    assert table(df.columns, rows) == want


def test_alignments_are_of_whole_texts(spark):
    from vocalis.operators.alignment import align

    rows = duckdb.sql(f"select item_id, text from '{DIR}/benchmark.parquet'").fetchall()
    blocks, lines = ({}, {})
    for r in QUERIES["matching_blocks"](spark, DIR).collect():
        blocks[r.item_id] = max(blocks.get(r.item_id, (0, 0)), (r.a, r.b))
    for r in QUERIES["aligned_lines"](spark, DIR).collect():
        lines.setdefault(r.item_id, []).append((r.line, r.ref))
    edits = {r.item_id: (r.score, r.edits) for r in QUERIES["sw_align"](spark, DIR).collect()}
    turns: dict = {}
    for i, text in duckdb.sql(f"select conv_id, text from '{DIR}/conversations.parquet' order by conv_id, turn, text").fetchall():
        turns[i] = f"{turns.get(i, '')} {text}"
    assert {r.conv_id: r.text for r in QUERIES["overwrite_fold"](spark, DIR).collect()} == {i: re.sub(" +", " ", t).strip(" ") for i, t in turns.items()}
    frames = [r.item_id for r in QUERIES["charwise_idx"](spark, DIR).collect()]
    assert all(frames.count(i) == len(text) for i, text in rows)
    swap = str.maketrans("aeio", "eiou", "u")
    for i, text in rows:
        score, pairs = align(list(text), list(text[10:].translate(swap)))
        assert edits[i][0] == score and len(edits[i][1]) == len(pairs) and sum(c != "+" for c in edits[i][1]) == len(text)
        assert blocks[i] == (len(text), max(0, len(text) - 20))
        assert "".join(x for _, x in sorted(lines[i])) == "".join(p[0] for p in align(list(text), list(text.translate(swap)))[1])
