"""The two models a shard can train: a linear softmax and a one-layer MLP.

Small NumPy helpers that run inside tasks. A model travels as one flat vector;
``layers`` names its parts in order.
"""

from __future__ import annotations

import math
import sys
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Tasks receive this module's functions with the job itself, so executors need
# NumPy but no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class ModelSpec:
    n_features: int
    n_classes: int
    kind: str = "softmax"
    hidden: int = 200
    dropout: float = 0.5

    def __post_init__(self):
        if self.kind not in ("softmax", "mlp"):
            raise ValueError(f"unknown model {self.kind!r}")

    @property
    def layers(self) -> list[tuple[str, tuple[int, ...]]]:
        d, h, k = self.n_features, self.hidden, self.n_classes
        if self.kind == "softmax":
            return [("output.weight", (k, d)), ("output.bias", (k,))]
        return [
            ("input.weight", (h, d)),
            ("input.bias", (h,)),
            ("output.weight", (k, h)),
            ("output.bias", (k,)),
        ]

    @property
    def size(self) -> int:
        return sum(int(np.prod(shape)) for _, shape in self.layers)

    def initial(self, seed: int = 42, zeros: bool = False) -> np.ndarray:
        """Uniform in +-1/sqrt(fan in), seeded; or all zeros."""
        if zeros:
            return np.zeros(self.size)
        rng = np.random.default_rng(seed)
        parts, fan_in = [], 1
        for _, shape in self.layers:
            if len(shape) == 2:
                fan_in = shape[1]
            bound = 1.0 / np.sqrt(fan_in)
            parts.append(rng.uniform(-bound, bound, size=int(np.prod(shape))))
        return np.concatenate(parts)


def unpack(spec: ModelSpec, vector: np.ndarray) -> list[np.ndarray]:
    parts, at = [], 0
    for _, shape in spec.layers:
        n = math.prod(shape)
        parts.append(vector[at : at + n].reshape(shape))
        at += n
    return parts


def matrix(column, n_features: int, kind=np.float64) -> np.ndarray:
    """Rows of an Arrow list column as one matrix, without an object per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty((0, n_features), kind)
    widths = pc.list_value_length(column)
    if widths.null_count or pc.min(widths).as_py() != n_features or pc.max(widths).as_py() != n_features:
        raise ValueError(f"every row needs {n_features} features")
    values = column.flatten()
    if values.null_count:
        raise ValueError("missing feature values")
    return np.asarray(values.to_numpy(zero_copy_only=False), dtype=kind).reshape(n, n_features)


def forward(spec: ModelSpec, params: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Class scores of a batch (no dropout)."""
    if spec.kind == "softmax":
        w, b = params
        return x @ w.T + b
    w1, b1, w2, b2 = params
    return np.maximum(x @ w1.T + b1, 0.0) @ w2.T + b2


def hits_and_losses(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: is the first maximum the label, and the cross-entropy."""
    top = scores.max(axis=1, keepdims=True, initial=-np.inf)
    log_z = top[:, 0] + np.log(np.exp(scores - top).sum(axis=1))
    return (scores.argmax(axis=1) == y).astype(np.int32), log_z - scores[np.arange(len(y)), y]


def loss_and_gradient(
    spec: ModelSpec, vector: np.ndarray, x: np.ndarray, y: np.ndarray, rng=None
) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of a batch and its gradient; dropout only with ``rng``."""
    params = unpack(spec, vector)
    n = len(y)
    if spec.kind == "mlp":
        w1, b1, w2, _ = params
        pre = x @ w1.T + b1
        if rng is not None and spec.dropout > 0:
            mask = (rng.random(pre.shape) >= spec.dropout) / (1.0 - spec.dropout)
        else:
            mask = 1.0
        act = np.maximum(pre * mask, 0.0)
        scores = act @ w2.T + params[3]
    else:
        act = x
        scores = x @ params[0].T + params[1]
    scores -= scores.max(axis=1, keepdims=True)
    own = np.arange(n), y
    own_score = scores[own]
    delta = np.exp(scores, out=scores)
    total = delta.sum(axis=1, keepdims=True)
    loss = float((np.log(total[:, 0]) - own_score).sum()) / n
    delta /= total
    delta[own] -= 1.0
    delta /= n
    gradient = np.empty(vector.size)
    parts = unpack(spec, gradient)
    np.matmul(delta.T, act, out=parts[-2])
    delta.sum(axis=0, out=parts[-1])
    if spec.kind == "mlp":
        back = (delta @ w2) * (act > 0) * mask
        np.matmul(back.T, x, out=parts[0])
        back.sum(axis=0, out=parts[1])
    return loss, gradient


@dataclass(frozen=True)
class TrainConfig:
    opt: str = "sgd"
    lr: float = 0.01
    momentum: float = 0.5
    weight_decay: float = 0.0
    epochs: int = 5
    batch: int = 64
    seed: int = 42
    lr_gamma: float = 1.0
    lr_step: int = 5
    # Order of an epoch's rows: a permutation of the whole shard, or a hash key of each row, by which
    # rows can be sorted outside a task's memory.
    order: str = "permuted"

    def __post_init__(self):
        if self.order not in ("permuted", "keyed"):
            raise ValueError(f"unknown order {self.order!r}")
        if self.opt not in ("sgd", "adam"):
            raise ValueError(f"unknown optimiser {self.opt!r}")


class Descent:
    """A model on its way: weights, the optimiser's moments, and the dropout draws."""

    def __init__(self, spec: ModelSpec, cfg: TrainConfig, lr: float, start: np.ndarray, rng):
        self.spec, self.cfg, self.lr, self.rng = spec, cfg, lr, rng
        self.w = np.array(start, dtype=np.float64)
        self.m, self.v, self.steps = np.zeros_like(self.w), np.zeros_like(self.w), 0

    def step(self, x: np.ndarray, y: np.ndarray) -> float:
        """One mini-batch; its mean loss."""
        cfg, w = self.cfg, self.w
        loss, g = loss_and_gradient(self.spec, w, x, y, self.rng)
        if cfg.weight_decay:
            g += cfg.weight_decay * w
        if cfg.opt == "sgd":
            self.m *= cfg.momentum
            self.m += g
            w -= self.lr * self.m
        else:
            self.steps += 1
            self.m = 0.9 * self.m + 0.1 * g
            self.v = 0.999 * self.v + 0.001 * g * g
            w -= self.lr * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v / (1 - 0.999**self.steps)) + 1e-8)
        return loss


def check_labels(spec: ModelSpec, y: np.ndarray) -> None:
    if len(y) == 0:
        raise ValueError("no samples")
    if y.min() < 0 or y.max() >= spec.n_classes:
        raise ValueError(f"label outside 0..{spec.n_classes - 1}")


# Bytes of a unit's samples, or of their order, beyond which they lie in a file.
IN_MEMORY = 64 << 20
# Rows that are taken in an epoch's order at once, whole mini-batches.
GATHERED = 1 << 16


class Rows:
    """A unit's samples as they come: in memory while they are few, else in files without a name in the
    worker's temporary folder, which end with it. Files are mapped, so the system holds of them what fits."""

    def __init__(self, n_features: int):
        self.n_features, self.held, self.bytes, self.n = n_features, [], 0, 0
        self.files = None

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.held.append((x, y))
        self.bytes += x.nbytes + y.nbytes
        self.n += len(y)
        if self.bytes > IN_MEMORY:
            self.files = self.files or (tempfile.TemporaryFile(), tempfile.TemporaryFile())
            self.kind = y.dtype
            for arrays in self.held:
                for file, array in zip(self.files, arrays, strict=True):
                    file.write(np.ascontiguousarray(array).data)
            self.held, self.bytes = [], 0

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if self.files is None:
            if not self.held:
                return np.empty((0, self.n_features)), np.empty(0, np.int64)
            return tuple(np.concatenate(a) for a in zip(*self.held, strict=True))
        for x, y in self.held:
            self.files[0].write(np.ascontiguousarray(x).data)
            self.files[1].write(np.ascontiguousarray(y).data)
        self.held = []
        shapes = ((np.float64, (self.n, self.n_features)), (self.kind, (self.n,)))
        for file in self.files:
            file.flush()
        return tuple(np.asarray(np.memmap(f, t, "r", shape=s)) for f, (t, s) in zip(self.files, shapes, strict=True))


def permutation(rng, n: int) -> np.ndarray:
    """``rng.permutation(n)``; of many rows in a mapped file."""
    if 8 * n <= IN_MEMORY:
        return rng.permutation(n)
    with tempfile.TemporaryFile() as file:
        order = np.asarray(np.memmap(file, np.uint32 if n < 1 << 32 else np.int64, "w+", shape=(n,)))
    for a in range(0, n, GATHERED):
        order[a : a + GATHERED] = np.arange(a, min(n, a + GATHERED))
    rng.shuffle(order)
    return order


def train(
    spec: ModelSpec, cfg: TrainConfig, lr: float, start: np.ndarray, x: np.ndarray, y: np.ndarray, seed,
    orders: list[np.ndarray] | None = None,
) -> tuple[np.ndarray, list[float]]:
    """Epochs of shuffled mini-batches; weights and mean batch loss per epoch.

    ``orders`` has the order of the rows for each epoch; without it they are permuted by ``seed``. Rows are
    taken in that order some mini-batches at a time, so ``x`` and ``y`` may be mapped files.
    """
    check_labels(spec, y)
    rng = np.random.default_rng(seed)
    model = Descent(spec, cfg, lr, start, rng)
    epoch_losses = []
    for epoch in range(cfg.epochs):
        order, losses = permutation(rng, len(y)) if orders is None else orders[epoch], []
        taken = cfg.batch * max(1, GATHERED // cfg.batch)
        for first in range(0, len(y), taken):
            some = order[first : first + taken]
            xs, ys = x[some], y[some]
            for at in range(0, len(ys), cfg.batch):
                losses.append(model.step(xs[at : at + cfg.batch], ys[at : at + cfg.batch]))
        epoch_losses.append(float(np.mean(losses)))
    return model.w, epoch_losses
