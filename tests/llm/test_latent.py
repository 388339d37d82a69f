"""Recall of decontamination on planted copies and paraphrases, way by way; filters row by row."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shardloom.llm import decontaminate as dc
from shardloom.llm.decontaminate import contaminated, lcs, uncontaminated
from shardloom.llm.toxicity import toxicity_scores, without_toxic


def vocabulary(draw, n=6000):
    return ["".join(draw.choices("abcdefghijklmnoprstuvz", k=draw.randrange(3, 9))) for _ in range(n)]


def planted(n_items, seed=1):
    """Items of common and of rarer words, with answers; documents that hold them whole, changed, rewritten."""
    draw = random.Random(seed)
    words = vocabulary(draw)
    pick = lambda n: [draw.choice(words[:80]) if draw.random() < 0.4 else draw.choice(words) for _ in range(n)]
    items = [pick(36) for _ in range(n_items)]
    answers = [draw.sample(range(36), 3) for _ in items]
    docs, want = [(i, " ".join(pick(80))) for i in range(2000)], {"whole": set(), "changed": set(), "rewritten": set()}
    for j in draw.sample(range(n_items), min(n_items, 120)):
        body = items[j]
        third = {*answers[j], *draw.sample(sorted(set(range(36)) - set(answers[j])), 9)}
        forms = {
            "whole": body,
            "changed": [w if i % 3 else draw.choice(words) for i, w in enumerate(body)],
            "rewritten": [w if i in third else draw.choice(words) for i, w in enumerate(body)],
        }
        for name, form in forms.items():
            want[name].add((len(docs), j))
            docs.append((len(docs), " ".join([*pick(30), *form, *pick(30)])))
    answers = [" ".join(items[j][i] for i in sorted(x)) for j, x in enumerate(answers)]
    return [(j, " ".join(x), answers[j]) for j, x in enumerate(items)], docs, want


@pytest.mark.parametrize("n_items", [40, 200, 1000])
def test_recall_of_each_way(spark, n_items):
    """Copies and copies with a third of the words replaced: all. Rewritten ones, of which a third of the
    words and the answer stay: nine of ten, by the latent space, which alone can lead to them."""
    items, docs, want = planted(n_items)
    bench = spark.createDataFrame(items, "item_id long, text string, answer string")
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    got = {(r["doc_id"], r["item_id"]): r for r in rows}
    assert want["whole"] | want["changed"] <= set(got)
    assert all(got[x]["way"] in ("words", "both") for x in want["whole"] | want["changed"])
    latent = {x for x, r in got.items() if r["way"] in ("latent", "both")}
    assert len(want["whole"] & latent) >= 0.98 * len(want["whole"])
    found = want["rewritten"] & set(got)
    print(f"{n_items} items: {len(want['whole'] & latent)} whole and {len(found)} rewritten of {len(want['whole'])} by the latent space")
    assert len(found) >= 0.9 * len(want["rewritten"]) and found <= latent
    assert all(got[x]["paraphrase"] for x in found)
    false = set(got) - set().union(*want.values())
    assert len(false) <= 0.01 * len(got)


def test_fit_keeps_lengths(spark):
    items, docs, _ = planted(200)
    items = [x[:2] for x in items]
    idf = dc.np.ones(dc.TERMS)
    queries = sorted(dc._queries([(i, x, None) for i, x in items], idf), key=lambda q: q.blocks)
    for i, q in enumerate(queries):
        q.space = i // dc.SPACE_PARTS
    rows = [(x, -1) for _, x in docs[:50]] + [(" ".join(q.words[slice(*q.part)]), q.space) for q in queries]
    kept = dc.fit_latent(spark.createDataFrame(rows, "text string, space int"), idf, queries)
    assert kept.min() >= dc.SHARE and kept.max() < 1 + 1e-6


def test_axes_are_fitted_on_all_documents(spark):
    """Products of 3,000 documents, with copies, in small and large tasks, against those of all their passages."""
    _, docs, _ = planted(40)
    texts = [x for _, x in docs] + [" ".join(["copy", str(i % 50), *["again"] * (i % 3)]) for i in range(1000)]
    idf = dc.np.random.default_rng(3).random(dc.TERMS) + 0.1
    random_, whole, n = dc._drawn(1), dc.np.zeros((dc.TERMS, dc.RANK)), 0
    for part in dc._folded(dc.pa.array(texts)):
        words = dc._terms(part)
        first, count = dc._blocks(part.bounds, dc.LONGEST)
        of, words, x = dc._bags(words, dc.np.repeat(range(len(first)), dc.np.diff(dc.np.append(first, len(words)))), idf)
        dense, some = dc.np.zeros((len(first), dc.TERMS)), dc.distinct(words)
        dense[of, words] = x
        whole[some] += dense[:, some].T @ (dense[:, some] @ random_[some])
        n += len(first)
    assert len(texts) > 3000
    for tasks, near in ((120, 1e-4), (4, 0.5)):  # with up to MIXED passages a task its product is exact
        rows = spark.createDataFrame([(x,) for x in texts], "text string").repartition(tasks)
        bags, _, passages = dc._passages(rows)
        assert passages == n
        got = dc.np.zeros((dc.TERMS, dc.RANK))
        for at, body in dc.corpus_products(bags.repartition(tasks), idf, passages).collect():
            got[at : at + dc.RANGE] = dc.np.frombuffer(bytes(body), dc.np.float32).reshape(-1, dc.RANK)
        assert dc.np.linalg.norm(got - whole) < near * dc.np.linalg.norm(whole)
        assert ((got != 0).any(1) == (whole != 0).any(1)).all()


def test_bound_is_above_the_subsequence():
    draw = random.Random(4)
    words = vocabulary(draw, 60)
    items = [" ".join(draw.choices(words, k=draw.randrange(1, 48))) for _ in range(30)]
    queries = dc._queries([(i, x, None) for i, x in enumerate(items)], dc.np.ones(dc.TERMS))
    matcher = dc.Matcher(queries, dc.np.ones(dc.TERMS), dc.np.ones(dc.TERMS, int))
    text = draw.choices(words, k=500)
    [part] = dc._folded(dc.pa.array([" ".join(text)]), 1 << 30)
    terms = dc._terms(part)
    lo = dc.np.array([draw.randrange(430) for _ in range(200)])
    hi = lo + dc.np.array([draw.randrange(1, 70) for _ in range(200)])
    query = dc.np.array([draw.randrange(30) for _ in range(200)])
    for a, b, q, bound in zip(lo, hi, query, matcher.bounds(terms, lo, hi, query), strict=True):
        exact = lcs(queries[q].words, text[a:b])
        assert exact <= bound <= exact + 2


ROWS = [(None, "PASSAGE"), (7, "PASSAGE"), (7, "clean words of another text"), (7, None), (None, ""), (None, "clean")] * 5


def test_rows_are_judged_by_their_text(spark):
    """Nulls, a hot id and clashing columns: only the texts with the passage go."""
    passage = " ".join(vocabulary(random.Random(9), 20))
    rows = [(i, t and t.replace("PASSAGE", f"before {passage} after")) for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(i) for i, c in enumerate(("draw", "space", "ways", "block", "_h1"))}
    )
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = uncontaminated(docs, bench)
    assert got.columns == docs.columns and got.count() == 20 and got.filter(F.contains("text", F.lit(passage))).count() == 0
    assert uncontaminated(docs.limit(0), bench).collect() == []
    assert uncontaminated(docs, bench.limit(0)).count() == 30


def test_toxic_rows_go_by_their_text(spark):
    """A hot id teaches with one text only; rows without an id are judged like all others."""
    draw = random.Random(2)
    words = vocabulary(draw, 300)
    rows = [(i, " ".join(draw.choices(words, k=20)) + (" grumblefoo vexbar" if i % 2 else "")) for i in range(400)]
    marks = [(i, i % 2) for i in range(400)]
    rows += [(1, "a different text of a known id")] * 400 + [(None, "grumblefoo vexbar"), (None, "plain"), (None, None)] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(3) for c in ("score", "label")})
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns
    left = [r["text"] for r in kept.collect()]
    toxic = sum(r["predicted"] for r in toxicity_scores(docs, labels).collect())
    assert len(left) == len(rows) - toxic and toxic >= 280
    assert sum("grumblefoo" in (x or "") for x in left) <= 10
    assert without_toxic(docs.limit(0), labels).collect() == []


def test_pipeline_stage_fits_on_all_documents(spark, tmp_path, monkeypatch):
    """2,000 documents of 80 words and some with passages: the axes come from every passage, not from some."""
    items, docs, want = planted(40)
    spark.createDataFrame(items, "item_id long, text string, answer string").write.parquet(f"{tmp_path}/benchmark.parquet")
    fitted = []
    whole = dc.corpus_products

    def products(bags, idf, passages, seed=1):
        sizes = [len(r["sizes"]) for r in bags.select("sizes").collect()]
        fitted.append((sum(sizes), passages))
        return whole(bags, idf, passages, seed)

    monkeypatch.setattr(dc, "corpus_products", products)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.without_benchmark(spark, rows, str(tmp_path)).select("doc_id").collect()}
    passages = sum(-(-len(x.split()) // dc.LONGEST) for _, x in docs)
    assert fitted == [(passages, passages)] and passages > 4000
    assert not left & {i for form in ("whole", "changed") for i, _ in want[form]}
    assert len(left & set(range(2000))) >= 1980
