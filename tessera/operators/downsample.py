"""Downsampling of voxel tables with built-in functions only.

Bins and windows are sums by group, with partial sums before the one shuffle.
A neighbourhood is read the other way round: a voxel is exploded to the few
outputs that use it (its taps), which are known from the factor and the size
alone, so no join is needed and only outputs that exist are made. Separable
filters run one axis after another, already on the reduced grid of the axes
before.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Method
from ..plans import levels
from ..sources.tables import Image


def _step(image: Image, k: int | Mapping[str, int]) -> dict[str, int]:
    step = {d: k if isinstance(k, int) else k.get(d, 1) for d in image.meta.spatial}
    if any(f < 1 for f in step.values()):
        raise ValueError(f"factors must be positive: {step}")
    return step


def _inside(image: Image, step: Mapping[str, int]) -> DataFrame:
    """Voxels of whole bins; what is left over at the far end belongs to no output."""
    df = image.voxels
    for d, k in step.items():
        if image.meta.shape[d] % k:
            df = df.where(F.col(d) < image.meta.shape[d] // k * k)
    return df


def _bins(image: Image, step: Mapping[str, int]) -> list[Column]:
    return [F.floor(F.col(d) / F.lit(step[d])).cast("long").alias(d) if step.get(d, 1) > 1 else F.col(d) for d in image.meta.dims]


def bin_shrink(image: Image, k: int | Mapping[str, int], digits: int | None = None) -> Image:
    """Mean of each bin."""
    step = _step(image, k)
    rows = _inside(image, step).select(*_bins(image, step), "value").groupBy(*image.meta.dims)
    mean = F.avg("value")
    return Image(rows.agg((F.round(mean, digits) if digits is not None else mean).alias("value")), levels.next_meta(image.meta, step))


def nearest(image: Image, k: int | Mapping[str, int]) -> Image:
    """First voxel of each bin; a filter and a projection, no shuffle."""
    step = _step(image, k)
    df = _inside(image, step)
    for d, f in step.items():
        if f > 1:
            df = df.where(F.col(d) % f == 0)
    return Image(df.select(*_bins(image, step), "value"), levels.next_meta(image.meta, step))


def _reach(dim: str, n: int, k: int, lo: int, hi: int) -> Column:
    """Outputs whose window [k*i+lo, k*i+hi], clamped to the axis, holds this voxel.

    A clamped place stands for all places beyond the edge, so the first and the
    last voxel reach the outputs whose windows leave the axis there.
    """
    p, last = F.col(dim), n // k - 1
    first = F.when(p == 0, F.lit(0)).otherwise(F.greatest(F.ceil((p - hi) / F.lit(k)), F.lit(0)))
    end = F.when(p == n - 1, F.lit(last)).otherwise(F.least(F.floor((p - lo) / F.lit(k)), F.lit(last)))
    # an edge voxel stands for the places beyond it only in windows that get there
    start = F.when(p == n - 1, F.greatest(F.ceil((p - hi) / F.lit(k)), F.lit(0))).otherwise(first).cast("long")
    stop = F.when(p == 0, F.least(F.floor((p - lo) / F.lit(k)), F.lit(last))).otherwise(end).cast("long")
    return F.when(stop >= start, F.sequence(start, stop))


def _taps(dim: str, n: int, k: int, out: Column, weight: Mapping[int, float] | None, lo: int, hi: int, cast: str) -> Column:
    """Weight of this voxel in output ``out``: the sum over the window's places that clamp to it."""
    p, base = F.col(dim), out * k
    table = [float(weight[o]) if cast == "double" else int(weight[o]) for o in range(lo, hi + 1)] if weight else [1] * (hi - lo + 1)
    low = [sum(table[: i + 1]) for i in range(len(table))]
    lit = lambda v: F.array(*[F.lit(x).cast(cast) for x in v])
    own = p - base - lo  # place in the table of this voxel itself
    at = lambda t, i: F.coalesce(F.get(t, i.cast("int")), F.lit(0).cast(cast))
    high = [sum(table[i:]) for i in range(len(table))]
    whole = F.lit(sum(table)).cast(cast)
    first = F.when(own >= len(table) - 1, whole).otherwise(at(lit(low), own))
    last = F.when(own <= 0, whole).otherwise(at(lit(high), own))
    if n == 1:
        return whole
    return F.when(p == 0, first).when(p == n - 1, last).otherwise(at(lit(table), own))


def gaussian(image: Image, k: int | Mapping[str, int], digits: int | None = None, kernel=None) -> Image:
    """Separable Gaussian, sampled at the first voxel of each bin, edges repeated.

    ``kernel`` gives (offset, weight) pairs of a factor; by default the sampled Gaussian, cut off where it fits the image.
    """
    step = _step(image, k)
    if kernel is None:
        cut = levels.truncate({d: levels.sigma(f) for d, f in step.items()}, image.meta.shape)
        kernel = lambda f: levels.kernel(f, cut)
    df, meta = image.voxels.withColumn("value", F.col("value").cast("double")), image.meta
    # the axis of largest factor first: later passes then have the fewest rows
    for d, f in sorted(step.items(), key=lambda s: -s[1]):
        if f == 1:
            continue
        weight = dict(kernel(f))
        lo, hi, n = min(weight), max(weight), image.meta.shape[d]
        rest = [c for c in meta.dims if c != d]
        rows = df.select(*rest, d, "value", F.explode(_reach(d, n, f, lo, hi)).alias("__out"))
        rows = rows.select(*rest, F.col("__out").alias(d), (F.col("value") * _taps(d, n, f, F.col("__out"), weight, lo, hi, "double")).alias("value"))
        df = rows.groupBy(*meta.dims).agg(F.sum("value").alias("value"))
    if digits is not None:
        df = df.withColumn("value", F.round("value", digits))
    return Image(df.select(*meta.dims, "value"), levels.next_meta(meta, step))


def discrete_gaussian(image: Image, k: int | Mapping[str, int], digits: int | None = None) -> Image:
    """The same with the discrete Gaussian (modified Bessel functions)."""
    return gaussian(image, k, digits, levels.discrete_kernel)


def _vote(image: Image, step: Mapping[str, int], weights) -> Image:
    """Value of largest weight in each window, ties to the smallest value."""
    df, meta = image.voxels.withColumn("__w", F.lit(1).cast("long")), image.meta
    for d, f in step.items():
        if f == 1:
            continue
        weight = dict(weights(f))
        lo, hi, n = min(weight), max(weight), meta.shape[d]
        rest = [c for c in meta.dims if c != d]
        rows = df.select(*rest, d, "value", "__w", F.explode(_reach(d, n, f, lo, hi)).alias("__out"))
        rows = rows.select(*rest, F.col("__out").alias(d), "value", (F.col("__w") * _taps(d, n, f, F.col("__out"), weight, lo, hi, "long")).alias("__w"))
        df = rows.groupBy(*meta.dims, "value").agg(F.sum("__w").alias("__w"))
    best = F.min(F.struct((-F.col("__w")).alias("w"), F.col("value").alias("v")))["v"]
    return Image(df.where("__w > 0").groupBy(*meta.dims).agg(best.alias("value")).select(*meta.dims, "value"), levels.next_meta(meta, step))


def mode(image: Image, k: int | Mapping[str, int]) -> Image:
    """Most frequent value of the window of size k around the bin's first voxel (k//2 places before it), edges repeated."""
    return _vote(image, _step(image, k), lambda f: [(o, 1) for o in range(-(f // 2), f - f // 2)])


def label_vote(image: Image, k: int | Mapping[str, int]) -> Image:
    """Label of largest linearly weighted vote around the bin's centre, edges repeated."""
    return _vote(image, _step(image, k), levels.vote_weights)


METHODS = {Method.BIN_SHRINK: bin_shrink, Method.GAUSSIAN: gaussian, Method.DISCRETE_GAUSSIAN: discrete_gaussian, Method.MODE: mode, Method.LABEL: label_vote, Method.NEAREST: nearest}


def downsample(image: Image, k: int | Mapping[str, int], method: Method | str | None = None) -> Image:
    return METHODS[Method.of(method)](image, k)


def value_range(image: Image, by: str | None = None) -> DataFrame:
    rows = image.voxels.groupBy(by) if by else image.voxels.groupBy()
    return rows.agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))


def first_in(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each group."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")
