from .random import digest, normals, order_key, shuffled, uniform
from .rates import gaussian_sigma, gaussian_sigma_value, lr_at, lr_schedule
from .vectors import (
    add,
    clip,
    clip_l2,
    flatten_features,
    log_softmax,
    predict,
    scale,
    standardize,
    standardize_channels,
    vector_norm,
)

__all__ = [
    "add", "clip", "clip_l2", "digest", "flatten_features", "gaussian_sigma",
    "gaussian_sigma_value", "log_softmax", "lr_at", "lr_schedule", "normals",
    "order_key", "predict", "scale", "shuffled", "standardize",
    "standardize_channels", "uniform", "vector_norm",
]
