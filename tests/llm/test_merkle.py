"""The Merkle manifest against a plain tree in one process, and against SQL."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from shardloom.llm.merkle import Block, Way, merkle_manifest, proof_root
from shardloom.llm.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.01"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[f] for f in FIELDS)))


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def up(tree, i, value, arity):
    """Folded value and siblings of node i."""
    siblings = []
    for level in tree[:-1]:
        first = i - i % arity
        run = level[first : first + arity]
        siblings += [x for j, x in enumerate(run) if first + j != i]
        value, i = sha("".join([*run[: i - first], value, *run[i - first + 1 :]])), i // arity
    return value, siblings


def plain(rows, arity, change):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in order:
        trees[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        made[lang] = levels([leaf(r) for r in trees[lang]], arity)
    top = levels([made[x][-1][0] for x in order], arity)
    for k, lang in enumerate(order):
        for i, r in enumerate(trees[lang]):
            value, low = up(made[lang], i, leaf(change(r)), arity)
            value, high = up(top, k, value, arity)
            root = top[-1][0]
            yield (r["doc_id"], leaf(r), made[lang][-1][0], root, sha("".join(low + high)), value, value == root)


def rows_of(n):
    langs = ["en", None, "été", "zz", "en", "en"]
    out = [(i, f"text {i}", langs[i % 6], "s", i) for i in range(n)]
    out += [(5, None, "en", None, None), (5, "other", "en", "", 1), (None, "x", "en", "s", 2), (None, "x", "en", "s", 2)]
    out += [(7, "", "alone", "s", 3), (8, "long " * 40_000, "", "s", 4)] + [(9, "same", "en", "s", 4)] * 9
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in out]


def change(r):
    touched = r["doc_id"] is not None and r["doc_id"] % 3 == 0 and r["n_chars"] is not None
    return r | ({"n_chars": r["n_chars"] + 1} if touched else {})


def changed():
    return {"n_chars": F.expr("if(doc_id % 3 = 0, n_chars + 1, n_chars)")}



def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("arity, block, n", [(2, 4, 60), (2, 4096, 60), (3, 9, 40), (5, 2, 30), (2, 2, 1)])
def test_plain_tree(spark, arity, block, n):
    """Several rounds of small blocks, ties, nulls, repeated rows, clashing columns."""
    rows = rows_of(n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns(
        {c: F.lit("x") for c in ("key", "tree", "digest", "other", "deal", "part", "at", "pos", "n", "block", "group")}
    )
    got = merkle_manifest(docs, replaced=changed(), arity=arity, block_nodes=block, with_proof=True).collect()
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(plain(rows, arity, change), key=key)
    assert all(proof_root(r["leaf"], r["proof"]) == r["root"] for r in got)
    assert {r["verified"] for r in got if r["doc_id"] and r["doc_id"] % 3 == 0 and r["doc_id"] != 9} <= {False}


def test_one_row_and_none(spark):
    one = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), (1, None, None, None, None), strict=True))]
    got = merkle_manifest(spark.createDataFrame(one, SCHEMA)).collect()
    assert [tuple(r) for r in got] == list(plain(one, 2, lambda r: r))
    assert got[0]["root"] == got[0]["leaf"] and got[0]["proof_sha256"] == sha("") and got[0]["verified"]
    none = merkle_manifest(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and none.columns == list(got[0].asDict())


def test_hot_keys(spark):
    """A third of the rows identical, a third without an id, all in one group."""
    rows = [
        dict(doc_id=1 if i % 3 == 0 else None if i % 3 == 1 else i, text="t" if i % 3 == 0 else f"t{i}",
             lang="en", source=None, n_chars=1) for i in range(300)
    ]
    got = merkle_manifest(spark.createDataFrame(rows, SCHEMA).repartition(4), block_nodes=16).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, 2, lambda r: r), key=key)


def test_states_stand_before_their_slot():
    nodes = [sha(str(i)).encode() for i in range(7)]
    block = Block(nodes, 3, None)
    for i in range(7):
        left = b"".join(nodes[i - i % 3 : i])
        assert block.states[0][i].digest() == hashlib.sha256(left).digest()
        assert block.fold(i, nodes[i]) == block.root != block.fold(i, b"x")
    assert Way([{"left": "a", "right": "b"}]).fold(b"c").decode() == sha("acb")


def test_order_and_parts_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = sorted(map(tuple, merkle_manifest(docs).collect()))
    assert sorted(map(tuple, merkle_manifest(docs.orderBy("text").repartition(7)).collect())) == one


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.sql(ORACLE["op12_merkle_manifest"])
    got = QUERIES["op12_merkle_manifest"](spark, DIR).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert 0 < sum(not r["verified"] for r in got) < len(got) / 4
