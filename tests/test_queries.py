"""Every named query against its SQL twin on the smallest test tables."""

from __future__ import annotations

import glob
import importlib
import math
import os

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BOOKS = [importlib.import_module(f"quillgraph.queries.{n}").BOOK for n in ("graph", "linking", "evaluation", "preparation", "composition")]
NAMES = [(b, n) for b in BOOKS for n in b.queries]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return v if v is None or isinstance(v, int | str | bool) else str(v)


@pytest.mark.parametrize(("book", "name"), NAMES, ids=[n for _, n in NAMES])
def test_query(spark, db, book, name):
    df = book.queries[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in book.sql:
        assert columns
        return
    rel = db.execute(book.sql[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(cell(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_every_event_is_a_beam(spark):
    """The queries over all beams read the whole table; their SQL has no rank filter."""
    book = BOOKS[1]
    whole = [n for n in book.queries if n.endswith("_all")]
    assert len(whole) == 13 and not any("rank <= 5" in book.sql[n] for n in whole)
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert book.queries["q_signatures_all"](spark, SF).count() == events.count()
    bought = {r[0] for r in events.where("event_type = 'purchase'").select("user_id").distinct().collect()}
    assert {r["question_id"] for r in book.queries["q_coverage_all"](spark, SF).where("covered").collect()} == bought
