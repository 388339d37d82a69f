"""Explicit schemas of the tables the engine reads or writes."""

from pyspark.sql import types as T

_INT, _LONG, _DOUBLE, _STRING = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()
_VECTOR = T.ArrayType(_DOUBLE)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SAMPLES = _struct(sample_id=_LONG, features=_VECTOR, label=_INT)
SHARDED_SAMPLES = _struct(sample_id=_LONG, features=_VECTOR, label=_INT, shard_id=_INT)
MODEL = _struct(layer=_STRING, pos=_INT, value=_DOUBLE)
UPDATES = _struct(
    round=_INT, shard_id=_INT, n_samples=_LONG, status=_STRING, error=_STRING,
    avg_loss=_DOUBLE, lr=_DOUBLE, epoch_losses=_VECTOR, weights=_VECTOR,
)
# A shard is trained in one or more units.
UNITS = T.StructType([*UPDATES.fields[:2], T.StructField("unit", _INT), *UPDATES.fields[2:]])
MESSAGE = _struct(
    participant_id=_INT, features=T.ArrayType(_VECTOR), label=T.ArrayType(_INT)
)
PARTICIPANT_METRICS = _struct(
    participant_id=_INT, cpu_percent=_DOUBLE, memory_percent=_DOUBLE,
    disk_usage=_DOUBLE, data_quality_score=_DOUBLE,
)
STREAM_UPDATE = _struct(participant_id=_INT, weights=_VECTOR)
LEDGER = _struct(
    round=_INT, timestamp=_DOUBLE, accuracy=_DOUBLE, loss=_DOUBLE,
    active=_INT, failed=_INT, mode=_STRING, method=_STRING,
)
HISTORY = _struct(Round=_INT, Accuracy=_DOUBLE)
FAILURE_LOG = _struct(
    round=_INT, ts=_DOUBLE, event=_STRING, participant_id=_INT, value=_STRING
)
OUTAGES = _struct(round=_INT, shard_id=_INT)
