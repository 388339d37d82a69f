"""Training on shards: one grouped Arrow UDF, failures as data, and the
per-participant logistic step as a plain aggregate."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.random import order_key
from ..functions.rates import lr_at
from ..functions.vectors import vector_norm
from ..schemas import UNITS, UPDATES
from .models import Descent, ModelSpec, Rows, TrainConfig, check_labels, matrix, train
from .positions import hashed_cell, with_position
from .sharding import with_equal_units, with_unit

# A model is broadcast and averaged as (pos, value) rows, its size is fixed.
MAX_MODEL_VALUES = 20_000_000


def train_units(
    samples: DataFrame,
    spec: ModelSpec,
    cfg: TrainConfig,
    start,
    round_no: int = 1,
    on_failure: str = "capture",
    by: tuple[str, ...] = ("shard_id", "unit"),
) -> DataFrame:
    """Train every (shard, unit) group of ``samples`` from the same model. ``by`` may name, after
    these two, a column that a unit determines and by which the samples are laid out.

    ``samples`` may be ``packed``, with the blocks of a unit one after another in a partition: then a unit
    of any size passes through its task, and its samples lie in files while it is trained.

    ``on_failure="capture"`` turns an exception into a row with status
    ``failed``; ``"raise"`` lets Spark retry the task.
    """
    if on_failure not in ("capture", "raise"):
        raise ValueError(f"unknown failure mode {on_failure!r}")
    if spec.size > MAX_MODEL_VALUES:
        raise ValueError(f"a model of {spec.size} values is too large to broadcast")
    shared = start if hasattr(start, "value") else samples.sparkSession.sparkContext.broadcast(
        np.asarray(start, dtype=np.float64)
    )
    lr = lr_at(round_no, cfg.lr, cfg.lr_gamma, cfg.lr_step)
    schema = to_arrow_schema(UNITS)

    def update(shard, unit, load) -> pa.Table:
        row = {
            "round": round_no, "shard_id": shard, "unit": unit, "n_samples": 0,
            "status": "failed", "error": None, "avg_loss": None, "lr": lr,
            "epoch_losses": None, "weights": None,
        }
        try:
            x, y, orders = load()
            w, losses = train(spec, cfg, lr, shared.value, x, y, _seed(cfg, round_no, shard, unit), orders)
            if not np.isfinite(w).all():
                raise FloatingPointError("training diverged")
            row |= {
                "n_samples": len(y), "status": "success", "weights": w,
                "avg_loss": float(np.mean(losses)), "epoch_losses": losses,
            }
        except Exception as e:  # noqa: BLE001 - a failed shard is a result
            if on_failure == "raise":
                raise
            row["error"] = f"{type(e).__name__}: {e}"
        return pa.Table.from_pylist([row], schema=schema)

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        def load():
            ids = group["sample_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            x = matrix(group["features"], spec.n_features)[order]
            y = group["label"].to_numpy()[order]
            orders = None
            if cfg.order == "keyed":
                keys = matrix(group["keys"], cfg.epochs, np.int64)[order]
                orders = [np.argsort(k, kind="stable") for k in keys.T]
            return x, y, orders

        return update(key[0].as_py(), key[1].as_py(), load)

    def stream(batches):
        now, rows, error = None, None, None

        def load():
            if error is not None:
                raise ValueError(error)
            return *rows.arrays(), None

        for batch in batches:
            shards, units, counts, errors, kinds = (
                batch.column(c).to_pylist() for c in ("shard_id", "unit", "n", "error", "kind")
            )
            for i, own in enumerate(zip(shards, units, strict=True)):
                if own != now:
                    if now is not None:
                        yield from update(*now, load).to_batches()
                    now, rows, error = own, Rows(spec.n_features), None
                error = error or errors[i]
                if error is None:
                    n, width = counts[i], 8 * spec.n_features
                    body = pa.decompress(batch.column("body")[i].as_buffer(), n * (width + np.dtype(kinds[i]).itemsize), "zstd")
                    x = np.frombuffer(body, np.float64, n * spec.n_features).reshape(n, spec.n_features)
                    rows.add(x, np.frombuffer(body, kinds[i], n, n * width))
        if now is not None:
            yield from update(*now, load).to_batches()

    if "body" in samples.columns:
        if cfg.order == "keyed":
            raise ValueError("packed samples have no keys")
        return samples.select(*BLOCKS).mapInArrow(stream, UNITS)
    columns = samples.select(*by, "sample_id", "features", "label")
    if cfg.order == "keyed":
        columns = columns.withColumn("keys", F.array(*[_epoch_key(cfg, round_no, e) for e in range(cfg.epochs)]))
    return columns.groupBy(*by).applyInArrow(run, UNITS)


# Columns of packed samples, besides what they are laid out by.
BLOCKS = ["shard_id", "unit", "n", "error", "kind", "body"]


def packed(samples: DataFrame, spec: ModelSpec, by: str) -> DataFrame:
    """Samples that lie unit by unit, as compressed blocks of a unit: ``n`` rows of features, then their labels of
    type ``kind``. ``by`` is a column that names the unit. A block that cannot be trained on has an ``error``."""

    def run(batches):
        for batch in batches:
            keys = batch.column(by).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part, error, kind, body = batch.slice(a, b - a), None, None, None
                try:
                    x = matrix(part.column("features"), spec.n_features)
                    y = part.column("label").to_numpy(zero_copy_only=False)
                    if y.dtype.kind not in "iu":
                        raise ValueError("a label is missing or no whole number")
                    body, kind = pa.compress(x.tobytes() + y.tobytes(), "zstd", asbytes=True), y.dtype.str
                except ValueError as e:
                    error = str(e)
                one = [part.column(c).slice(0, 1) for c in names[:3]]
                yield pa.RecordBatch.from_arrays(
                    [*one, pa.array([b - a]), pa.array([error], pa.string()), pa.array([kind], pa.string()),
                     pa.array([body], pa.binary())],
                    [*names[:3], *BLOCKS[2:]],
                )

    names = ["shard_id", "unit", by, "features", "label"]
    fields = [f"{c} {samples.schema[c].dataType.simpleString()}" for c in names[:3]]
    schema = ", ".join([*fields, "n long, error string, kind string, body binary"])
    return samples.select(*names).mapInArrow(run, schema)


def _seed(cfg: TrainConfig, round_no: int, shard, unit: int) -> list[int]:
    return [cfg.seed, round_no, zlib.crc32(f"{shard}|{unit}".encode())]


def _epoch_key(cfg: TrainConfig, round_no: int, epoch):
    """Where a sample stands in an epoch: a hash of its id, the round and the epoch."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return order_key(F.col("sample_id"), F.lit(round_no), epoch, seed=cfg.seed).cast("bigint")


def train_stream(
    samples: DataFrame,
    spec: ModelSpec,
    cfg: TrainConfig,
    start=None,
    round_no: int = 1,
    on_failure: str = "capture",
    partitions: int | None = None,
) -> DataFrame:
    """One update per shard, each shard a single sequence of mini-batches that need not fit a task.

    The rows of all epochs are sorted by shard, epoch and the epoch's key, outside memory where they must,
    and pass through the task batch by batch; weights, moments and draws are carried along. A task holds a
    mini-batch, an Arrow batch and the model, whatever the shard's size. The features are shuffled
    once for each epoch. Needs ``cfg.order == "keyed"`` and gives the weights of ``train_local`` with one
    unit per shard and the same configuration.
    """
    if cfg.order != "keyed":
        raise ValueError("rows can be streamed in the order of a key only")
    if on_failure not in ("capture", "raise"):
        raise ValueError(f"unknown failure mode {on_failure!r}")
    start = spec.initial(cfg.seed) if start is None else start
    shared = samples.sparkSession.sparkContext.broadcast(np.asarray(start, dtype=np.float64))
    lr = lr_at(round_no, cfg.lr, cfg.lr_gamma, cfg.lr_step)
    schema = to_arrow_schema(UPDATES)

    def run(batches):
        now: _Sequence | None = None
        for batch in batches:
            shards = pa.array(batch.column("shard_id")).fill_null(0).to_numpy()
            none = batch.column("shard_id").is_null().to_numpy(zero_copy_only=False)
            epochs = batch.column("epoch").to_numpy()
            new = np.ones(len(epochs), bool)
            new[1:] = (shards[1:] != shards[:-1]) | (none[1:] != none[:-1]) | (epochs[1:] != epochs[:-1])
            cuts = [*np.flatnonzero(new).tolist(), len(epochs)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                shard = None if none[a] else int(shards[a])
                if now is None or now.shard != shard:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([now.update(round_no)], schema=schema)
                    now = _Sequence(shard, spec, cfg, lr, shared.value, _seed(cfg, round_no, shard, 0), on_failure)
                now.add(int(epochs[a]), batch.column("features").slice(a, b - a), batch.column("label").slice(a, b - a))
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.update(round_no)], schema=schema)

    rows = samples.select("shard_id", "sample_id", "features", "label").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.lit(cfg.epochs - 1)))
    ).withColumn("key", _epoch_key(cfg, round_no, F.col("epoch")))
    dealt = rows.repartition(partitions, "shard_id") if partitions else rows.repartition("shard_id")
    laid = dealt.sortWithinPartitions("shard_id", "epoch", "key", "sample_id")
    return laid.select("shard_id", "epoch", "features", "label").mapInArrow(run, UPDATES)


class _Sequence:
    """A shard in training: its model so far, and the rows that wait for a full mini-batch."""

    def __init__(self, shard, spec, cfg, lr, start, seed, on_failure):
        self.shard, self.spec, self.cfg, self.on_failure = shard, spec, cfg, on_failure
        self.model = Descent(spec, cfg, lr, start, np.random.default_rng(seed))
        self.epoch, self.rows, self.error = 0, 0, None
        self.losses: list[list[float]] = [[] for _ in range(cfg.epochs)]
        self.x, self.y = np.empty((0, spec.n_features)), np.empty(0, np.int64)

    def add(self, epoch: int, features: pa.Array, label: pa.Array) -> None:
        if self.error is not None:
            return
        try:
            if epoch != self.epoch:
                self._steps(True)
                self.epoch = epoch
            y = label.to_numpy(zero_copy_only=False)
            check_labels(self.spec, y)
            self.x = np.concatenate([self.x, matrix(features, self.spec.n_features)])
            self.y = np.concatenate([self.y, y])
            self.rows += len(y) if epoch == 0 else 0
            self._steps(False)
        except Exception as e:  # noqa: BLE001 - a failed shard is a result
            self._failed(e)

    def _failed(self, e: Exception) -> None:
        if self.on_failure == "raise":
            raise e
        self.error = f"{type(e).__name__}: {e}"

    def _steps(self, last: bool) -> None:
        size, at = self.cfg.batch, 0
        while len(self.y) - at >= (1 if last else size):
            self.losses[self.epoch].append(self.model.step(self.x[at : at + size], self.y[at : at + size]))
            at += size
        self.x, self.y = self.x[at:], self.y[at:]

    def update(self, round_no: int) -> dict:
        row = {
            "round": round_no, "shard_id": self.shard, "n_samples": 0, "status": "failed", "error": self.error,
            "avg_loss": None, "lr": self.model.lr, "epoch_losses": None, "weights": None,
        }
        if self.error is None:
            try:
                self._steps(True)
                if not np.isfinite(self.model.w).all():
                    raise FloatingPointError("training diverged")
            except Exception as e:  # noqa: BLE001
                self._failed(e)
                return row | {"error": self.error}
            losses = [float(np.mean(x)) for x in self.losses]
            row |= {
                "n_samples": self.rows, "status": "success", "weights": self.model.w,
                "avg_loss": float(np.mean(losses)), "epoch_losses": losses,
            }
        return row


def train_local(
    samples: DataFrame,
    spec: ModelSpec,
    cfg: TrainConfig = TrainConfig(),
    start=None,
    round_no: int = 1,
    on_failure: str = "capture",
    unit_rows: int | None = None,
    units_per_shard: int = 1,
) -> DataFrame:
    """One update per shard, from the same starting model.

    The unit plan is the caller's and looks at no size. With one unit per shard
    a shard of any size is one sequence of mini-batches in one task, which must
    hold its samples. With n ``units_per_shard`` (or units of about
    ``unit_rows`` rows) each unit starts from the same model and holds its part
    only, and the update is their sample-weighted mean. A shard with a failed
    unit is failed as a whole.
    """
    start = spec.initial(cfg.seed) if start is None else start
    split = with_unit(samples, unit_rows) if unit_rows else with_equal_units(samples, units_per_shard)
    return merge_units(train_units(split, spec, cfg, start, round_no, on_failure))


# What an entry of a unit's result describes.
_WEIGHT, _EPOCH, _MEAN = 0, 1, 2


def merge_units(units: DataFrame) -> DataFrame:
    """Units to shard updates in one pass, so that nothing is trained twice.

    Weights and losses become (kind, pos, value) entries, are averaged by hash
    aggregation, and only the averages are packed into arrays again.
    """
    n = F.col("n_samples")

    def entries(kind: int, column: str):
        return F.transform(
            F.col(column),
            lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), v.alias("v")),
        )

    loss = F.array(
        F.struct(F.lit(_MEAN).alias("kind"), F.lit(0).alias("pos"), F.col("avg_loss").alias("v"))
    )
    rows = units.select(
        "round", "shard_id", "n_samples", "lr", "error",
        (F.col("status") == "success").alias("_ok"),
        F.explode_outer(
            F.concat(entries(_WEIGHT, "weights"), entries(_EPOCH, "epoch_losses"), loss)
        ).alias("e"),
    )
    cells = rows.groupBy("round", "shard_id", "e.kind", "e.pos").agg(
        F.try_divide(F.sum(n * F.col("e.v")), F.sum(n)).alias("value"),
        F.sum(n).alias("_n"),
        F.bool_and("_ok").alias("_ok"),
        F.max("error").alias("error"),
        F.max("lr").alias("lr"),
    )

    def packed(kind: int):
        found = F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "value")))
        return F.transform(F.array_sort(found), lambda p: p.getField("value"))

    ok = F.col("_ok")
    shards = cells.groupBy("round", "shard_id").agg(
        F.bool_and("_ok").alias("_ok"),
        F.max(F.when(F.col("kind") == _MEAN, F.col("_n"))).alias("_n"),
        F.max(F.when(F.col("kind") == _MEAN, F.col("value"))).alias("_loss"),
        F.max("error").alias("error"),
        F.max("lr").alias("lr"),
        packed(_EPOCH).alias("_epochs"),
        packed(_WEIGHT).alias("_weights"),
    )
    return shards.select(
        "round",
        "shard_id",
        F.when(ok, F.col("_n")).otherwise(F.lit(0)).cast("bigint").alias("n_samples"),
        F.when(ok, F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        "error",
        F.when(ok, F.col("_loss")).alias("avg_loss"),
        "lr",
        F.when(ok, F.col("_epochs")).alias("epoch_losses"),
        F.when(ok, F.col("_weights")).alias("weights"),
    ).to(UPDATES)


def train_logistic(
    samples: DataFrame, n_classes: int, by: str = "participant_id"
) -> DataFrame:
    """One logistic-regression iteration per participant, flat coefficients.

    Started from zero the class probabilities are equal, so the gradient needs
    only the feature sums per class: an aggregate, with partial sums formed
    before the shuffle, and no participant is ever gathered in one task. The
    step is the first trial step of L-BFGS, of unit length against the
    gradient over coefficients and intercepts.

    Coefficients are laid out for ``n_classes`` global classes (one row for
    two classes), zero for a class the participant does not have. With fewer
    than two classes there is nothing to separate, and a label that is null or
    outside the global classes has no row: status ``failed``. So is a participant
    whose vectors differ in length, are null or hold nulls.
    """
    # position 0 is the intercept: a feature of constant one
    entries = F.concat(F.array(F.lit(1.0)), F.coalesce("features", F.array().cast("array<double>")))
    sums = (
        samples.select(by, F.coalesce("label", F.lit(-1)).alias("label"), F.posexplode(entries).alias("pos", "_x"))
        .groupBy(by, "label", "pos")
        .agg(F.sum("_x").alias("_s"), F.count("_x").alias("_c"))
    )
    # From here on the size is that of the models: classes x features.
    cells = sums.groupBy(by, "pos").agg(
        F.sum("_s").alias("t"),
        F.sum("_c").alias("c"),
        F.map_from_entries(F.collect_list(F.struct("label", "_s"))).alias("of"),
    )
    packed = cells.groupBy(by).agg(
        F.array_sort(
            F.collect_list(F.struct("pos", "t", "c", "of")),
            lambda a, b: a.getField("pos") - b.getField("pos"),
        ).alias("_cells")
    )
    intercept = F.get("_cells", F.lit(0))
    shaped = packed.select(
        by,
        "_cells",
        intercept.getField("t").cast("bigint").alias("_n"),
        F.size(intercept.getField("of")).alias("_k"),
        F.forall(
            F.map_keys(intercept.getField("of")), lambda c: (c >= 0) & (c < F.lit(n_classes))
        ).alias("_known"),
        (
            (F.size("_cells") > 1)
            & F.forall("_cells", lambda cell: cell.getField("c") == intercept.getField("c"))
        ).alias("_even"),
    )
    classes = [1] if n_classes == 2 else list(range(n_classes))
    share = F.lit(0.5) if n_classes == 2 else F.lit(1.0) / F.col("_k")

    def gradient_row(c):
        return F.transform(
            "_cells",
            lambda cell: F.coalesce(
                share * cell.getField("t") - F.try_element_at(cell.getField("of"), c), F.lit(0.0)
            )
            / F.col("_n"),
        )

    graded = shaped.withColumn(
        "_g", F.transform(F.array(*[F.lit(c) for c in classes]), gradient_row)
    ).withColumn("_norm", vector_norm(F.flatten("_g")))
    step = F.flatten(
        F.transform(
            "_g",
            lambda row: F.transform(
                F.slice(row, 2, F.size(row) - 1), lambda g: F.try_divide(-g, F.col("_norm"))
            ),
        )
    )
    error = (
        F.when(~F.col("_known"), f"label outside 0..{n_classes - 1}")
        .when(~F.col("_even"), "vectors of different length or with nulls")
        .when(F.col("_k") < 2, "one class only")
    )
    ok = error.isNull()
    return graded.select(
        by,
        F.when(ok, F.col("_n")).otherwise(F.lit(0)).cast("bigint").alias("n_samples"),
        F.when(ok, "success").otherwise("failed").alias("status"),
        error.alias("error"),
        F.when(ok, step).alias("weights"),
    )


def minibatches(samples: DataFrame, batch: int, seed=42, epochs: int = 1) -> DataFrame:
    """Shuffled batch number of every sample, per shard and epoch.

    Only ids move; join the features back by ``sample_id`` where needed.
    """
    ids = samples.select("sample_id", "shard_id").withColumn(
        "epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))
    )
    keyed = ids.withColumn("_key", order_key(F.col("sample_id"), F.col("epoch"), seed=seed))
    placed = with_position(
        keyed, ["_key", "sample_id"], within=["shard_id", "epoch"], name="_pos",
        cell=hashed_cell(keyed, "_key"),
    )
    return placed.select(
        "shard_id", "epoch", "sample_id",
        F.floor(F.col("_pos") / F.lit(batch)).cast("bigint").alias("batch"),
    )
