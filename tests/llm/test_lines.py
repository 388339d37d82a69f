"""Line dedup against a plain loop and SQL, with small filters that suspect every line."""

import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import line_dedup
from shardloom.llm.line_dedup import Lines, drop_repeated_lines
from shardloom.llm.queries import ORACLE, QUERIES
from shardloom.llm.words import slices

DIR = "/root/testdata/sf0.01"
SPACE = " \t\n\v\f\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_chars=20, min_docs=3):
    holders = defaultdict(list)
    for doc_id, text in rows:
        for key in {x.strip(SPACE).translate(FOLD) for x in (text or "").split("\n")}:
            if len(key) >= min_chars:
                holders[key].append(doc_id)
    keeper = {
        k: max((x for x in ids if x is not None), default=None) for k, ids in holders.items() if len(ids) >= min_docs
    }
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(x.strip(SPACE).translate(FOLD), doc_id) == doc_id]
        yield doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)


A, B = "a line that many documents share", "été à la même ligne ÉTÉ"
ROWS = [
    (1, f"{A}\nown words of the first\n  {A.upper()}\t"), (2, f"x\n\n{A}\v\n"), (3, A), (3, A), (None, A),
    (None, f"{B}\r\n{B}"), (5, B), (6, f"{B}\n{B.lower()}"), (7, None), (8, ""), (9, "\n\n"), (10, "short\n" * 9),
    (11, "only rows without an id hold it"), (None, "the largest id is null here"),
    (None, "the largest id is null here"), (None, "THE largest id is null here"),
    (12, "a very long text with lines\n" * 40_000 + A), (13, "a very long text with lines"),
]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("most_bits", [1 << 16, 1 << 29])
def test_edges(spark, most_bits, monkeypatch):
    """Repeated and missing ids, clashing columns; also with slices of a few lines."""
    monkeypatch.setattr(line_dedup, "FLUSH_KEYS", 2)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns(
        {c: F.lit(7) for c in ("row", "key", "lines", "n", "keeper", "gone", "suspects", "n_lines")}
    )
    for parts in (1, 5):
        got = drop_repeated_lines(docs.repartition(parts), most_bits=most_bits).collect()
        assert sorted(map(tuple, got), key=key) == sorted(plain(ROWS), key=key)


def test_empty_table(spark):
    assert drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("min_chars, min_docs", [(1, 2), (30, 4)])
def test_other_parameters(spark, min_chars, min_docs):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = drop_repeated_lines(docs, min_chars, min_docs).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(ROWS, min_chars, min_docs), key=key)


def test_hot_line(spark):
    """A line in every document, a third of all rows without an id, a third with one id."""
    rows = [(None if i % 3 == 0 else 4 if i % 3 == 1 else i, f"{A}\nline number {i} of this table") for i in range(600)]
    got = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_full_filter(spark, monkeypatch):
    """A filter in which every bit is set suspects every line and changes no result."""
    monkeypatch.setattr(line_dedup, "twice_seen", lambda *a: (np.full(1 << 13, 255, np.uint8), 16))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert sorted(map(tuple, drop_repeated_lines(docs).collect()), key=key) == sorted(plain(ROWS), key=key)


def test_filter_spares_lines(spark):
    """Nothing repeats, so next to nothing is suspected; whatever repeats always is."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('line with the number ', id % 15000) AS text")
    table, bits = line_dedup.twice_seen(docs, 20)
    part = next(slices(docs.select("text").toArrow()["text"], 1 << 30))
    hit = np.ones(20_000, bool)
    for where in line_dedup._positions(Lines(part).hashes(), bits):
        hit &= (table[where >> 3] >> (7 - (where & 7))) & 1 == 1
    again = np.bincount(np.arange(20_000) % 15_000)[np.arange(20_000) % 15_000] > 1
    assert hit[again].all() and hit[~again].mean() < 0.05


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.sql(ORACLE["op11_line_dedup"])
    got = QUERIES["op11_line_dedup"](spark, DIR).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and sum(r["n_dropped"] for r in got) > 0
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["kept_sha256"] == empty for r in got if r["n_lines"] == r["n_dropped"])
