"""Operators against plain loops, exact round trips and held-out labels on the small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from shardloom.llm import components as cc
from shardloom.llm.elias_fano import EliasFano, build
from shardloom.llm.jaccard import jaccard_components
from shardloom.llm.mixture import splitting_tree, targets, MixPlan
from shardloom.llm.queries import ORACLE, QUERIES, tokenizer_path
from shardloom.llm.tokens import read_sequences, store_of, write_sequences

DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{DIR}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), (x or "" for x in t["text"].to_pylist()), strict=True))


def marks(column):
    t = pq.read_table(f"{DIR}/labels.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t[column].to_pylist(), strict=True))


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_jaccard_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.execute(ORACLE["op1_ngram_jaccard_join"]).fetchall()
    got = QUERIES["op1_ngram_jaccard_join"](spark, DIR).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_jaccard_small_blocks(spark):
    """Many blocks and buckets give the components of one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = sorted(map(tuple, jaccard_components(docs).collect()))
    assert sorted(map(tuple, jaccard_components(docs, block=300, bucket=200).collect())) == one


@pytest.mark.parametrize("per_part", [1 << 18, 300])
def test_components(spark, monkeypatch, per_part):
    monkeypatch.setattr(cc, "PART_EDGES", per_part)
    draw = random.Random(1)
    edges = [(draw.randrange(900), draw.randrange(900)) for _ in range(600)]
    edges += [(2000 + i, 2001 + i) for i in range(200)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


def test_mixture(spark, texts):
    rows = QUERIES["op2_source_mixture"](spark, DIR).collect()
    again = QUERIES["op2_source_mixture"](spark, DIR).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    groups = {}
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]])) and r["taken"] <= 2 * r["size"]
        assert r["taken"] == sum(c["words"] for c in r["copies"])
        groups.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(v) - k[1]) <= 0.5 for k, v in groups.items())


def test_targets_and_tree():
    assert targets([100, 100, 0], MixPlan()) == pytest.approx([200, 100, 0])
    counts = np.array([7, 0, 30, 3])
    tree = splitting_tree(counts, 4, 1)
    assert (tree.sum(1) == counts).all() and set(tree.sum(0)) == {10}


def test_language(spark):
    t = pq.read_table(f"{DIR}/documents.parquet")
    lang = dict(zip(t["doc_id"].to_pylist(), t["lang"].to_pylist(), strict=True))
    held = [r for r in QUERIES["op3_language_id"](spark, DIR).collect() if r["held_out"]]
    assert all(crc(r["doc_id"], 5) == 0 for r in held)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_quality_classifier(spark):
    known = marks("quality")
    rows = QUERIES["op9_quality_classifier"](spark, DIR).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in held]) > 0.97


def test_toxicity(spark):
    """On the table with some hundred toxic labels; the smaller ones have a few dozen, too few to learn
    words of four languages from."""
    t = pq.read_table("/root/testdata/sf0.1/labels.parquet")
    known = dict(zip(t["doc_id"].to_pylist(), t["toxic"].to_pylist(), strict=True))
    rows = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").collect()
    held = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert np.mean([p for p, y in held if y == 1]) > 0.6
    assert np.mean([p for p, y in held if y == 0]) < 0.02


def test_quality_rules(spark, texts):
    rows = QUERIES["op5_quality_rules"](spark, DIR).collect()
    for r in rows:
        text = texts[r["doc_id"]]
        words = WORD.findall(text)
        seen, again = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        count, cover = Counter(grams), set()
        for i, g in enumerate(grams):
            if count[g] > 1:
                cover.update(range(i, i + 8))
        failed = len(words) < 20 or 100 * len(cover) > 30 * len(words)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(cover), failed)
        assert not (failed and r["kept"])
    known = marks("quality")
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known and not r["base_failed"]]
    assert np.mean([r["kept"] == bool(known[r["doc_id"]]) for r in held]) > 0.95


def test_tokens(spark, texts):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    start, want = 0, []
    for i in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op6_token_id_output"](spark, DIR).collect())) == want


def test_token_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    files = write_sequences(docs, tokenizer_path(), length=64, file_tokens=20_000).orderBy("part").collect()
    assert len(files) > 2 and [f["first"] for f in files] == list(np.cumsum([0] + [f["n_tokens"] for f in files[:-1]]))
    for f in files:
        table, index = read_sequences(f["folder"], f["name"])
        assert table.num_rows == -(-f["n_tokens"] // 64) and index.num_rows == f["n_docs"]
        assert sum(table["mask"].combine_chunks().flatten().to_pylist()) == f["n_tokens"]
    assert store_of("file:///x/y")[1] == "/x/y"


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def test_personal_data(spark, texts):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, g: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, g: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, g: 12 <= len(g) <= 19 and _luhn(g)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, g: 9 <= len(g) <= 15),
    ]
    for r in QUERIES["op7_pii"](spark, DIR).collect():
        found = []
        for k, (name, form, test) in enumerate(kinds):
            for m in re.finditer(form, texts[r["doc_id"]]):
                if test(m[0], re.sub("[^0-9]", "", m[0])):
                    found.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
        spans = [x[2] for x in sorted(found)]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(filter(None, r["spans"].split(",")))
        assert r["n_email"] == sum(x[1] == 0 for x in found)


def test_bootstrap_finds_unseen(spark):
    from shardloom.llm.pii import personal_data

    rows = [(i, f"w{i} please reach me at 10.0.0.{i} today or v{i}") for i in range(20)]
    rows += [(100, "they can reach me at KX99-1234 today"), (101, "the year 2024 was good 123456")]
    got = {r["doc_id"]: r["spans"] for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "other:21:30" and got[101] == ""


def test_lm(spark, texts):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*WORD.findall(x.translate(fold)), None] for i, x in texts.items()}
    count = Counter(w for i, x in tokens.items() if crc(i, 7) != 2 for w in x)
    n, v = sum(count.values()), len(count)
    base = model = tokens_held = 0
    plain = plain_model([x for i, x in tokens.items() if crc(i, 7) != 2], n, v)
    for r in QUERIES["op8_lm_scoring"](spark, DIR).collect():
        x = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(count[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x))
        assert r["score"] == pytest.approx(plain(x), rel=1e-6)
        if r["held_out"]:
            base, model, tokens_held = base + r["base_score"], model + r["score"], tokens_held + len(x)
    assert base < model < 0 and model / tokens_held > -3.29


def plain_model(texts, n, v, order=3, discount=0.75):
    """The same smoothing over dictionaries, with shares and weights rounded as the trie keeps them."""
    from shardloom.llm.lm import DECODE, _code

    count = Counter(w for x in texts for w in x)
    after = {}
    for x in texts:
        padded = ["<s>"] * (order - 1) + x
        for i in range(len(x)):
            for m in range(1, order):
                after.setdefault(tuple(padded[i + order - 1 - m : i + order - 1]), Counter())[x[i]] += 1
    kept = {}
    for context, words in after.items():
        total = words.total()
        share = dict(zip(words, DECODE[_code(np.array([(c - discount) / total for c in words.values()]))], strict=True))
        rest = max(1 - sum(share.values()), 2.0**-15)
        kept[context] = share, DECODE[_code(np.array([rest]))][0]

    def score(x):
        padded, out = ["<s>"] * (order - 1) + x, 0.0
        for i, w in enumerate(x):
            p, last = (count[w] + 1) / (n + v + 1), True
            for m in range(1, order):
                share, weight = kept.get(tuple(padded[i + order - 1 - m : i + order - 1]), ({}, 1.0))
                if last:
                    p = share.get(w, 0.0) + weight * p
                last = m == 1 or share.get(w, 0.0) > 0
            out += math.log10(p)
        return out

    return score


@pytest.mark.parametrize("n, top", [(0, 1), (1, 5), (1000, 1 << 62), (5000, 6000), (3000, 2**64 - 1)])
def test_elias_fano(n, top):
    draw = np.random.default_rng(n)
    v = np.unique(draw.integers(0, top, n, dtype=np.uint64, endpoint=True))
    seq = EliasFano(build(v))
    assert (seq.get(np.arange(len(v))) == v).all()
    ask = np.concatenate([v, draw.integers(0, top, 500, dtype=np.uint64, endpoint=True)])
    where = {int(x): i for i, x in enumerate(v)}
    assert seq.find(ask).tolist() == [where.get(int(x), -1) for x in ask]


def test_decontamination(spark, texts):
    t = pq.read_table(f"{DIR}/benchmark.parquet")
    items = dict(zip(t["item_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    flat = {i: " ".join(x.split()) for i, x in texts.items()}
    want = {(i, j) for j, x in items.items() for i, y in flat.items() if " ".join(x.split()) in y}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op10_benchmark_decontamination"](spark, DIR).collect()}
    assert want <= got
    # Whatever else is reported shares most of an item's words.
    assert all(len(set(items[j].split()) & set(texts[i].split())) >= 0.5 * len(set(items[j].split())) for i, j in got)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = p.one_of_each_group(spark, docs, DIR)
    groups = jaccard_components(docs).filter("doc_id = component_id")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in groups.select("doc_id").collect())
    mixed = p.mixed(spark, docs, DIR)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r["text"])) for r in mixed.select("text").collect())
    assert words == sum(r["taken"] for r in QUERIES["op2_source_mixture"](spark, DIR).collect())
