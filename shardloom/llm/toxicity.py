"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is a run of letters and digits with A-Z lower-cased; its bag holds the hashes of the whole word,
of its byte n-grams of three to five bytes, and of those it begins with once more. The embeddings of a bag are averaged to a word, the words
of a passage to a passage, and a linear softmax over the passage gives the two classes. Embeddings and
softmax are trained together in numpy. A misspelling that was never seen shares n-grams with what was,
so it lands near it.

A text is judged by its most toxic passage: overlapping passages of a few words, of which a long text has
many. Training follows the same rule (multiple instances): a toxic text teaches by its most toxic passage,
a clean one by its most toxic and by random passages. A last one-dimensional logistic fit turns a text's
largest margin into a probability.

Softmax and averages are linear, so for scoring each bucket's embedding is folded into one number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import fold, sampled_labels
from .words import LOWER, U, give_back, mix, prefix_hash, ragged, slices, span_hash, sums

LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
LETTERS[128:] = True

BUCKETS = 1 << 17
DIM = 12
GRAMS = (3, 4, 5)
PASSAGE, STEP = 16, 8
RARE = 4  # texts of the sample that must have a bucket, at least
SAMPLE = 1_200  # labelled texts of each class that a model is trained on


@dataclass
class Model:
    """``weight``: margin that each bucket adds; ``bias``: of the softmax; ``slope`` and ``shift``:
    of the final logistic."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def grams(part) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text of a slice, and (word number, bucket) of all features of all words.

    A word counts once per text, where it first occurs: what is said twice is not twice as toxic, and
    a text that repeats one word is not a passage of it.
    """
    part.find_words(LETTERS)
    prefix = prefix_hash(LOWER[part.data])
    whole = span_hash(prefix, part.starts, part.ends)
    of = np.repeat(np.arange(len(part)), np.diff(part.bounds))
    key = mix(whole ^ mix(of.astype(U) + U(1)))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    keep = np.sort(order[new])
    starts, ends, whole, of = part.starts[keep], part.ends[keep], whole[keep], of[keep]
    size = ends - starts
    found = [(np.arange(len(size)), whole)]
    for n in GRAMS:
        count = np.maximum(size - n + 1, 0)
        at = ragged(starts, count)
        found.append((np.repeat(np.arange(len(size)), count), span_hash(prefix, at, at + n) ^ U(n)))
        long = np.flatnonzero(count)  # the beginning of the word is a feature of its own
        found.append((long, span_hash(prefix, starts[long], starts[long] + n) ^ U(n + 64)))
    found = [(word, (h & U(BUCKETS - 1)).astype(np.int32)) for word, h in found]
    return np.bincount(of, minlength=len(part)), found


def passages(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words: first word and length of every passage, and passages per text."""
    count = np.where(words > 0, np.maximum(0, -(-(words - PASSAGE) // STEP)) + 1, 0)
    first = sums(words)[:-1]
    start = np.repeat(first, count) + STEP * ragged(np.zeros_like(count), count)
    end = np.minimum(start + PASSAGE, np.repeat(first + words, count))
    return start, end - start, count


def margins(model: Model, part) -> np.ndarray:
    """Largest margin over the passages of each text; the bias alone for a text without words."""
    words, found = grams(part)
    value, counts = np.zeros(words.sum()), np.zeros(words.sum())
    for word, bucket in found:
        value += np.bincount(word, model.weight[bucket], len(value))
        counts += np.bincount(word, minlength=len(value))
    word = value / counts
    start, length, count = passages(words)
    total = sums(word)
    mean = (total[start + length] - total[start]) / length if len(start) else np.zeros(0)
    out = np.zeros(len(part))
    has = count > 0
    if has.any():
        out[has] = np.maximum.reduceat(mean, sums(count)[:-1][has])
    return out + model.bias


class _Bags:
    """The training texts as passages of buckets."""

    def __init__(self, texts: list[str]):
        bags, counts, words = [], [], []
        for part in slices(pa.array(texts, pa.string()), 1 << 18):
            in_text, found = grams(part)
            word, bag = (np.concatenate(x) for x in zip(*found, strict=True))
            bags.append(bag[np.argsort(word, kind="stable")])
            counts.append(np.bincount(word, minlength=in_text.sum()).astype(np.int32))
            words.append(in_text)
        none = [np.zeros(0, np.int64)]
        self.bag = np.concatenate(bags or none)
        self.counts = np.concatenate(counts or none)
        self.cut = sums(self.counts)
        self.words = np.concatenate(words or none)
        self.start, self.length, self.count = passages(self.words)
        self.of = np.repeat(np.arange(len(self.words)), self.count)
        # A bucket that few texts have could only be learned by heart.
        seen = np.zeros(BUCKETS, np.int64)
        of_text = self.cut[sums(self.words)]
        for a, b in zip(of_text[:-1], of_text[1:], strict=True):
            seen[np.unique(self.bag[a:b])] += 1
        self.known = seen >= max(RARE, len(texts) // 500)

    def means(self, weight: np.ndarray) -> np.ndarray:
        word = np.add.reduceat(weight.astype(np.float32)[self.bag], self.cut[:-1])
        total = sums(word.astype(float) / self.counts)
        return (total[self.start + self.length] - total[self.start]) / self.length

    def entries(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage number, bucket and share of every entry of the chosen passages."""
        words = ragged(self.start[chosen], self.length[chosen])
        passage = np.repeat(np.arange(len(chosen)), self.length[chosen])
        at = ragged(self.cut[:-1][words], self.counts[words])
        share = np.repeat(1 / (self.counts[words] * self.length[chosen][passage]), self.counts[words])
        passage, bag = np.repeat(passage, self.counts[words]), self.bag[at]
        known = self.known[bag]
        return passage[known], bag[known], share[known]


def train(texts: list[str], toxic: np.ndarray, rounds: int = 16, warm: int = 6, rate: float = 0.2, seed: int = 3) -> Model:
    """With one class only, or none, the score is constant: the smoothed share of toxic texts."""
    y = np.asarray(toxic, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    constant = Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return constant
    bags = _Bags(texts)
    if not len(bags.start):
        return constant
    draw = np.random.default_rng(seed)
    table = draw.normal(0, 0.1, (BUCKETS, DIM))
    soft = draw.normal(0, 0.1, (DIM, 2))
    bias = np.zeros(2)
    seen_table, seen_soft, seen_bias = np.full(BUCKETS, 1e-3), np.full((DIM, 2), 1e-3), np.full(2, 1e-3)
    first = sums(bags.count)[:-1]
    has = np.flatnonzero(bags.count > 0)
    for turn in range(rounds):
        some = [first[has] + (draw.random(len(has)) * bags.count[has]).astype(np.int64) for _ in range(4)]
        if turn < warm:  # any passage of a toxic text may be the toxic one
            chosen, target = np.concatenate(some), np.tile(y[has], 4)
        else:
            mean = bags.means((table @ (soft[:, 1] - soft[:, 0])) * bags.known)
            order = np.lexsort((-mean, bags.of))
            top, clean = order[first[has]], y[has] == 0
            chosen = np.concatenate([top, *[x[clean] for x in some]])
            target = np.concatenate([y[has], np.zeros(4 * clean.sum())])
        weight = np.where(target == 1, 0.5 / target.sum(), 0.5 / (target == 0).sum())
        shuffled = draw.permutation(len(chosen))
        for batch in np.array_split(shuffled, max(1, len(shuffled) // 256)):
            passage, bucket, part = bags.entries(chosen[batch])
            here, local = np.unique(bucket, return_inverse=True)
            mean = np.zeros((len(batch), DIM))
            rows = table[bucket] * part[:, None]
            for d in range(DIM):
                mean[:, d] = np.bincount(passage, rows[:, d], len(batch))
            logit = mean @ soft + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            goal = np.stack([1 - target[batch], target[batch]], 1)
            error = (p - goal) * (weight[batch] * len(chosen))[:, None]
            back = error @ soft.T
            grad = np.stack(
                [np.bincount(local, part * back[passage, d], len(here)) for d in range(DIM)], 1
            )
            for value, g, seen, rows_ in (
                (table, grad, seen_table, here), (soft, mean.T @ error / len(batch), seen_soft, ...),
                (bias, error.mean(0), seen_bias, ...),
            ):
                square = (g**2).mean(1) if value is table else g**2
                seen[rows_] += square
                scale = np.sqrt(seen[rows_])
                value[rows_] -= rate * g / (scale[:, None] if value is table else scale)
    weight = (table @ (soft[:, 1] - soft[:, 0])) * bags.known
    model = Model(weight.astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0)
    best = np.zeros(len(y))
    best[has] = np.maximum.reduceat(bags.means(model.weight), first[has])
    model.slope, model.shift = _logistic(best + model.bias, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps; classes weigh the same, and a small ridge keeps the slope
    finite where the classes are separate."""
    w = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    mean, spread = x.mean(), x.std() + 1e-9
    z = np.stack([(x - mean) / spread, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        ridge = np.array([1e-3, 0.0])
        g = z.T @ (w * (p - y)) + ridge * beta
        h = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9)
        beta -= np.linalg.solve(h, g)
    return float(beta[0] / spread), float(beta[1] - beta[0] * mean / spread)


def toxicity_model(docs: DataFrame, labels: DataFrame, modulus: int = 3, value: int = 1, per_class: int = SAMPLE) -> Model:
    """Trained on at most ``per_class`` whole texts of each class outside the held-out fold.

    One text of each sampled id, chosen by its contents. The sample, of bounded size, is learned from in one task;
    the driver gets the folded weights, half a megabyte.
    """
    sample = sampled_labels(labels, "toxic", modulus, value, per_class)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64("text"), "text")).getField("text").alias("text"), F.first("label").alias("label")
    )

    def learn(batches):
        table = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("label", pa.int32())]))
        table = table.sort_by("doc_id")
        model = train(table["text"].to_pylist(), table["label"].to_numpy())
        give_back()
        body = [[model.weight.tobytes()], [model.bias], [model.slope], [model.shift]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in body], ["weight", "bias", "slope", "shift"])

    one = rows.select("doc_id", "text", F.col("label").cast("int")).repartition(1)
    found = one.mapInArrow(learn, "weight binary, bias double, slope double, shift double").first()
    if found is None:  # an empty plan has no task
        return train([], np.zeros(0))
    return Model(np.frombuffer(bytes(found["weight"]), np.float32), *found[1:])


def _scores(model, text: int):
    """For batches with the text at a place: the batch and the scores of its rows."""

    def run(batches):
        for batch in batches:
            found = [model.value.probability(margins(model.value, part)) for part in slices(batch.column(text), 1 << 20)]
            yield batch, np.concatenate(found) if found else np.zeros(0)
        give_back()

    return run


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 3, value: int = 1,
    per_class: int = SAMPLE,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs(doc_id, text, ...)``.

    A text that is null, empty or without letters has no passage and gets the score of an empty passage.
    A row with a null id is scored, never learned from, and not held out; repeated rows are all scored, and
    of the texts that share an id one is learned from; a
    null text teaches nothing. Without labels of both classes the score is constant. Other columns of
    either table are ignored. An empty table gives no rows. Texts of any length are scored whole.
    """
    scores = _scores(docs.sparkSession.sparkContext.broadcast(toxicity_model(docs, labels, modulus, value, per_class)), 1)

    def run(batches):
        for batch, score in scores(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", fold(modulus, value), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score less than ``threshold``, with all their columns.

    Each row is judged by its own text where it lies, whatever its id: nothing is shuffled or joined.
    """
    model = docs.sparkSession.sparkContext.broadcast(toxicity_model(docs, labels, per_class=per_class))
    scores = _scores(model, docs.columns.index("text"))

    def run(batches):
        for batch, score in scores(batches):
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
