"""Every query against its SQL on the smallest tables; the library without the llm folders."""

import ast
import os
import pathlib

import duckdb
import pytest

from gatehouse import queries as core

ROOT = pathlib.Path(__file__).parent.parent


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf, name):
    got = core.QUERIES[name](spark, sf)
    rows = got.collect()
    assert rows
    if name in core.SQL:
        con = duckdb.connect()
        for f in os.listdir(sf):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
        cur = con.execute(core.SQL[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(map(plain, r)) for r in cur.fetchall())


def test_only_the_entry_knows_the_llm_folder():
    for path in (ROOT / "gatehouse").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] + [getattr(node, "module", None) or ""] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), path
