"""Inputs on which an operator once did less than the whole job."""

import random

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline

from shardloom.llm import jaccard, lm
from shardloom.llm.boosting import quality_scores
from shardloom.llm.decontaminate import BLOCK, PARAPHRASE, TERMS, Postings, _blocks, contaminated
from shardloom.llm.mixture import mix
from shardloom.llm.rules import quality_rules
from shardloom.llm.words import sums


def prose(seed, n, vocabulary=50_000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def found(docs, bench):
    return {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}


def test_contaminated_neighbours_in_one_partition(spark):
    short, long = prose(1, 20), prose(2, 45)
    rows = [(i, " ".join(short)) for i in range(4)] + [(i, " ".join(long)) for i in range(4, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long))], "item_id long, text string")
    assert found(docs, bench) == {(i, 1 + i // 4) for i in range(8)}


def test_contaminated_punctuation_and_case(spark):
    words = [f"été{w}" for w in prose(3, 30)]
    rows = [(1, " ".join(f"«{w.upper()}»," for w in words)), (2, " - ".join(words)), (3, " ".join(prose(4, 30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert found(docs, bench) == {(1, 1), (2, 1)}


def test_candidates_are_all_regions_with_enough_words():
    draw = np.random.default_rng(6)
    bounds = sums(draw.integers(0, 120, 40))
    terms = draw.zipf(1.3, bounds[-1]) % 60
    words = [draw.zipf(1.3, int(n)) % 60 for n in draw.integers(1, 49, 50)]
    first, count = _blocks(bounds, BLOCK)
    for blocks in (3, 7):
        got = set(zip(*(x.tolist() for x in Postings(words, np.bincount(terms, minlength=TERMS)).candidates(
            terms, bounds, first, count, blocks)), strict=True))
        text, whole = np.repeat(np.arange(len(count)), count), set()
        for i, t in enumerate(text):
            region = terms[max(bounds[t], first[i] - BLOCK) : min(bounds[t + 1], first[i] + (blocks + 1) * BLOCK)]
            whole |= {(i, q) for q, w in enumerate(words) if np.isin(w, region).sum() >= PARAPHRASE * len(w)}
        assert whole and whole <= got


def test_contaminated_large_benchmark(spark):
    """2,000 items: verbatim between foreign words, and every third word replaced."""
    items = {i: prose(1000 + i, 40) for i in range(2000)}
    changed = {i: [f"x{k}" if k % 3 == 2 else w for k, w in enumerate(items[i])] for i in items}
    rows = [(i, " ".join(prose(5000 + i, 13) + items[i] + prose(9000 + i, 21))) for i in range(0, 2000, 10)]
    rows += [(i, " ".join(changed[i])) for i in range(1, 2000, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(
        [(i, " ".join(w), " ".join(w[:2])) for i, w in items.items()], "item_id long, text string, answer string"
    )
    assert found(docs, bench) == {(i, i) for i in range(2000) if i % 10 < 2}


def test_mix_cuts_a_long_text(spark):
    text = " \n".join(f"w{i}\t" for i in range(50_000))
    docs = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    got = sorted((r["text"] for r in corpus_pipeline.mixed(spark, docs, "").collect()), key=len)
    assert got == [text[: text.index("w24999") + len("w24999")], text]


def test_pipeline_stages_on_null_and_repeated_ids(spark):
    a, b, c = (" ".join(prose(i, 60)) for i in (11, 12, 13))
    near = a + " more"
    rows = [(1, a, "s"), (1, a, "s"), (1, near, "s"), (1, b, "s"), (2, near, "s"), (3, b, "s"), (3, c, "s"), (None, a, "s"), (None, a, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()))
    assert [x for x in got if x[1] not in (a, near)] == sorted([(1, b), (3, c)])
    assert [x[0] for x in got if x[1] in (a, near)] == [0, 0, 1]
    rows = [(None, " ".join(prose(100 + i, 5 + i)), f"s{i % 3}") for i in range(40)] + [(7, c, "s0")] * 9 + [(7, b, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = dict(corpus_pipeline.mixed(spark, docs, "").groupBy("source").agg(F.sum(F.size(F.split("text", " ")))).collect())
    assert words == {r["source"]: round(r["target"]) for r in mix(docs).select("source", "target").distinct().collect()}


def test_quality_does_not_depend_on_the_cap(spark):
    """86 % of the labels are good; of the texts with marks, bad ones are a little more than half."""
    bad, marked = set(range(0, 1200, 7)), set(range(0, 1200, 7)) | set(range(3, 1200, 11))
    rows = [(i, " ".join(prose(i, 40)) + (" !" * 15 if i in marked else "")) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in range(1200)], "doc_id long, quality int")
    for cap in (10_000, 90):
        assert quality_rules(docs, labels, cap).filter("rule IS NOT NULL").count() == 0
    same = docs.withColumn("text", F.lit("one text for all"))
    for cap in (10_000, 60):
        score = quality_scores(same, labels, per_class=cap, trees=5).agg(F.avg("score")).first()[0]
        assert abs(score - 0.857) < 0.03


def test_chance_shingles_do_not_join_unlike_documents(spark, monkeypatch):
    """Each document shares a few rare shingles with its neighbours: none may enter the tiles for that. Near copies link."""
    words = prose(7, 400 * 40)
    texts = [words[i * 40 : i * 40 + 48] for i in range(399)]  # eight words of each are the next one's first
    near = [x[:24] + ["other"] + x[25:] if i % 2 else [*x, "more"] for i, x in enumerate(texts[:60])]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts + near)]
    tiled, whole = [], jaccard._tiled

    def count(sets, block):
        tiled.append(sets.select("k1").distinct().count())
        return whole(sets, block)

    monkeypatch.setattr(jaccard, "_tiled", count)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(jaccard.jaccard_components(docs).select("doc_id", "component_id").collect())
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in texts + near]
    want = {i: i for i in range(len(sets))}
    for i in range(60):
        if 100 * len(sets[i] & sets[399 + i]) >= 75 * len(sets[i] | sets[399 + i]):
            want[399 + i] = i
    assert got == want and sum(k != v for k, v in want.items()) >= 30
    assert tiled[0] <= 140


def test_counts_of_all_tasks_find_frequent_shingles(spark):
    """A passage once in each of 60 tasks is frequent, although no task sees it more than once."""
    passage = " ".join(prose(8, 12))
    rows = [(i, " ".join([*prose(100 + i, 30), passage])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(60, "doc_id")
    counts = jaccard._profiles(docs, 5).filter("cell IS NOT NULL")
    found = {r["cell"]: r["n"] for r in jaccard._frequent(counts).collect()}
    sets = jaccard._sets(next(jaccard.slices(jaccard.pa.array([passage]))), 5)[0]
    assert len(sets) == 8 and all(found[c] >= 60 for c in jaccard._cells(sets).tolist())


def test_ngram_counts_travel_thin(spark):
    """Contexts are sent as differences: fewer bytes than the 4 of each n-gram, and the same contexts on arrival."""
    draw = np.random.default_rng(2)
    for x in (np.zeros(0, np.uint32), np.array([2**32 - 1], np.uint32), np.sort(draw.integers(0, 2**32, 9000).astype(np.uint32))):
        assert (lm._wide(lm._thin(x), len(x)) == x).all()
    docs = spark.createDataFrame([(" ".join(prose(1, 20_000)),)], "text string")
    rows = [r for r in lm.ngram_counts(docs, 3, 4).collect() if r["bucket"] & 15 > 1]
    sent, words = (sum(len(r[c]) for r in rows) for c in ("context", "word"))
    assert words == 4 * sum(len(r["n"]) for r in rows) and sent < 0.85 * words


def test_shingles_that_occur_once_are_not_counted_together(spark):
    """Of two million shingles the eight of a passage in 30 tasks are frequent, and no cell that others share by chance."""
    passage = " ".join(prose(8, 12))
    draw = np.random.default_rng(3)
    texts = [" ".join(map(str, draw.integers(0, 1 << 40, 70_000).tolist())) + f" {passage}" for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(30, "doc_id")
    rows = jaccard._profiles(docs, 5)
    counts = rows.filter("cell IS NOT NULL")
    found = {r["cell"]: r["n"] for r in jaccard._frequent(counts).collect()}
    sets = jaccard._sets(next(jaccard.slices(jaccard.pa.array([passage]))), 5)[0]
    own = set(jaccard._cells(sets).tolist())
    assert all(found[c] in (30, 31) for c in own) and len(found) <= len(own) + 3
    assert counts.agg(F.sum("n")).first()[0] == rows.filter("cell IS NULL").agg(F.sum("n")).first()[0] > 2_000_000
    levels = jaccard._Levels(np.array(sorted(found), np.int32), np.array([found[c] for c in sorted(found)], np.int32))
    assert (levels.of(sets) >= 30).all() and not levels.of(jaccard.mix(sets)).any()
