"""Load and category columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scaling modes and accelerator kinds with their resource names.
SCALING_MODES = ("GPU_UTIL", "QUEUE_DEPTH", "COMPOSITE")
YARN_RESOURCES = {
    "NVIDIA_GPU": "yarn.io/gpu",
    "AMD_GPU": "amd.com/gpu",
    "INTEL_GAUDI": "habana.ai/gaudi",
    "AWS_NEURON": "aws.amazon.com/neuron",
    "CPU_ONLY": None,
}
KUBERNETES_RESOURCES = {**YARN_RESOURCES, "NVIDIA_GPU": "nvidia.com/gpu"}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalise_category(col: Column | str, domain, default: str) -> Column:
    name = F.replace(F.upper(_c(col)), F.lit("-"), F.lit("_"))
    return F.when(name.isin(*domain), name).otherwise(F.lit(default))


def scaling_mode(col: Column | str) -> Column:
    return normalise_category(col, SCALING_MODES, "COMPOSITE")


def accelerator_type(col: Column | str) -> Column:
    return normalise_category(col, YARN_RESOURCES, "NVIDIA_GPU")


def yarn_resource(col: Column | str) -> Column:
    """Resource name for a lenient accelerator spelling; null for cpu only."""
    return _lookup(accelerator_type(col), YARN_RESOURCES)


def kubernetes_resource(col: Column | str) -> Column:
    """Resource name for the exact lower-case spelling; anything else is NVIDIA."""
    known = {k.lower(): v for k, v in KUBERNETES_RESOURCES.items()}
    raw = _c(col)
    return F.when(
        raw.isin(*known), _lookup(raw, known)
    ).otherwise(F.lit(KUBERNETES_RESOURCES["NVIDIA_GPU"]))


def _lookup(col: Column, table: dict) -> Column:
    out = None
    for key, value in table.items():
        cond = col == key
        literal = F.lit(value).cast("string")
        out = F.when(cond, literal) if out is None else out.when(cond, literal)
    return out


def clamp_unit(col: Column | str) -> Column:
    value = _c(col).cast("double")
    return F.when(F.isnan(value), 0.0).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))
    )


def queue_load(depth: Column | str, containers: Column | str, capacity: Column | str) -> Column:
    """Pending requests per container against a soft capacity, in [0, 1]."""
    d = F.greatest(F.lit(0), _c(depth))
    n = F.greatest(F.lit(0), _c(containers))
    cap = F.greatest(F.lit(1), _c(capacity))
    per_container = d.cast("double") / F.nullif(n, F.lit(0)).cast("double")
    return F.when(n == 0, F.when(d == 0, 0.0).otherwise(1.0)).otherwise(
        clamp_unit(per_container / cap.cast("double"))
    )


def normalised_load(
    gpu: Column | str,
    depth: Column | str,
    containers: Column | str,
    capacity: Column | str,
    mode: Column | str,
) -> Column:
    """``mode`` is a column of GPU_UTIL / QUEUE_DEPTH / COMPOSITE; anything else is COMPOSITE."""
    gpu_part = clamp_unit(gpu)
    queue_part = queue_load(depth, containers, capacity)
    chosen = _c(mode)
    return (
        F.when(chosen == "GPU_UTIL", gpu_part)
        .when(chosen == "QUEUE_DEPTH", queue_part)
        .otherwise(F.greatest(gpu_part, queue_part))
    )


def progress(running: Column | str, target: Column | str) -> Column:
    """Running share of the target; 0 when nothing is wanted."""
    goal = _c(target)
    return F.when(goal <= 0, 0.0).otherwise(_c(running).cast("double") / goal)
