"""Ranked search against plain scoring of all pairs and SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import ranked_search as rs
from shardloom.llm.queries import ORACLE, QUERIES
from shardloom.llm.ranked_search import Search, item_trees, ranked_search, tree_order

DIR = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    counts = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        asked = set(TERM.findall((text or "").translate(FOLD)))
        found = []
        for doc, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in asked & c.keys()
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(found)[:k])]
    return out


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def words(draw, n):
    return " ".join(f"w{int(draw.paretovariate(0.7)) % 900}" for _ in range(n))


@pytest.fixture(scope="module")
def tables():
    draw = random.Random(3)
    docs = [(i, words(draw, draw.randrange(60))) for i in range(700)]
    docs += [(5, docs[5][1]), (5, docs[9][1]), (None, docs[7][1]), (None, docs[7][1].upper()), (None, None), (None, "")]
    docs += [(1000 + i, docs[20][1]) for i in range(40)] + [(2000, "w3 w5 ÉTÉ-été_été 7 " * 20_000), (2001, "?!")]
    items = [(i, words(draw, draw.randrange(1, 30))) for i in range(120)]
    items += [(3, items[3][1]), (None, docs[20][1]), (200, None), (201, ""), (202, "été nowhere"), (203, "nowhere")]
    return docs, items


@pytest.mark.parametrize("slice_items, block", [(4096, 512), (50, 512), (7, 8)])
def test_plain_scores(spark, tables, monkeypatch, slice_items, block):
    """Ties, copies, nulls, repeated rows, long texts, clashing columns; also in small slices and blocks."""
    monkeypatch.setattr(rs, "SLICE_ITEMS", slice_items)
    monkeypatch.setattr(rs, "BLOCK_DOCS", block)
    docs, items = tables
    extra = {c: F.lit(1) for c in ("n", "vector", "term", "terms", "item", "rank", "score", "df")}
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns(extra)
    right = spark.createDataFrame(items, "item_id long, text string").withColumns(extra)
    got = ranked_search(left, right)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, items), key=key)


def test_other_k_and_empty_tables(spark, tables):
    docs, items = tables
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items[:20], "item_id string, text string")
    want = sorted((str(a), *b) for a, *b in plain(docs, items[:20], 3))
    assert sorted(map(tuple, ranked_search(left, right, k=3).collect()), key=key) == sorted(want, key=key)
    assert ranked_search(left.limit(0), right).collect() == ranked_search(left, right.limit(0)).collect() == []


def test_pairs_are_pruned():
    """Items and documents of eight languages: most pairs are never scored, and the best are those of a full scan."""
    draw = np.random.default_rng(5)
    n_docs, n_items, v = 4000, 128, 1600
    lang = draw.integers(0, 8, n_docs)
    terms = [np.unique(draw.choice(200, 12) + 200 * (i % 8)) for i in range(n_items)]
    weights = draw.integers(2000, 8000, v)
    vectors = [np.unique(draw.choice(200, draw.integers(5, 60)) + 200 * x, return_counts=True) for x in lang]
    for j in draw.choice(n_docs, 600, replace=False):
        vectors[j] = (terms[j % n_items], np.full(len(terms[j % n_items]), 4))
    n = np.array([c.sum() for _, c in vectors])
    order = tree_order(terms, weights.astype(float))
    search = Search(item_trees([terms[i] for i in order]), n_items, weights, n_docs, int(n.sum()), 3)
    pairs = np.empty(sum(len(t) for t, _ in vectors), rs.PAIR)
    pairs["term"], pairs["tf"] = np.concatenate([t for t, _ in vectors]), np.concatenate([c for _, c in vectors])
    search.add(np.arange(n_docs), np.zeros(n_docs, bool), n, pairs, rs.sums(np.array([len(t) for t, _ in vectors])))
    assert sorted(order) == list(range(n_items)) and search.scored < 0.2 * n_docs * n_items
    m = 10 + (90 * n * n_docs) // n.sum()
    x = np.zeros((n_docs, v), np.int64)
    for j, (t, c) in enumerate(vectors):
        x[j, t] = weights[t] * ((10**9 * c) // (1000 * c + 8 * m[j]))
    for place, i in enumerate(order):
        full = x[:, terms[i]].sum(1)
        best = np.lexsort((np.arange(n_docs), -full))[:3]
        assert (search.score[place] == full[best]).all() and (search.doc[place] == best).all()


def test_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    want = con.sql(ORACLE["op13_ranked_search"])
    got = QUERIES["op13_ranked_search"](spark, DIR).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) == 400
