"""Registered queries: one per operator, with the SQL that checks it."""

from . import (
    averaging,
    control,
    evaluation,
    features,
    ledgers,
    privacy,
    quality,
    sharding,
    sources,
    streams,
    training,
)
from .quality import flagship

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (
    sources, sharding, features, quality, training, averaging, privacy, evaluation, ledgers,
    control, streams,
):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
