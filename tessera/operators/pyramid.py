"""Pyramids: a level after another, each from the one before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Method, PyramidMeta
from ..plans import levels
from ..sources.tables import Image
from .downsample import METHODS


def plan(image: Image, factors: int | Sequence[int | Mapping[str, int]] = 128, chunk=None) -> list[dict[str, int]]:
    """Absolute factors of all levels; an int is the least length for automatic levels."""
    lengths = levels.chunk_lengths(image.meta.dims, chunk)
    if isinstance(factors, int):
        return levels.auto_factors(image.meta.shape, lengths, factors)
    return levels.level_factors(image.meta.dims, factors)


def build(image: Image, factors: int | Sequence[int | Mapping[str, int]] = 128, method: Method | str | None = None, chunk=None, keep: bool = True) -> tuple[list[Image], PyramidMeta]:
    """All levels, from the full resolution on.

    Factors are absolute: [2, 4] halves twice. With ``keep`` a level that
    another one is built from is held (memory, then disk) so that each is computed once.
    """
    kind = Method.of(method)
    planned = plan(image, factors, chunk)
    image.meta.chunk.update(levels.chunk_lengths(image.meta.dims, chunk))
    out = [image]
    for i, step in enumerate(levels.steps(planned)):
        source = out[-1]
        if keep and (i or len(planned) > 1):
            source = Image(source.voxels.persist(StorageLevel.MEMORY_AND_DISK), source.meta)
            out[-1] = source
        out.append(METHODS[kind](source, step))
    return out, PyramidMeta([im.meta for im in out], planned, kind)


def as_table(images: Sequence[Image]) -> DataFrame:
    """One table of all levels, with a column ``level`` (a partition column when written)."""
    parts = [im.voxels.withColumn("level", F.lit(i)).withColumn("value", F.col("value").cast("double")) for i, im in enumerate(images)]
    return reduce(DataFrame.unionByName, parts).select("level", *images[0].meta.dims, "value")


def datasets(images: Sequence[Image]) -> DataFrame:
    """level, dim, size, scale, translation of each level."""
    spark = images[0].voxels.sparkSession
    rows = [(i, d, int(im.meta.shape[d]), float(im.meta.scale.get(d, 1.0)), float(im.meta.translation.get(d, 0.0))) for i, im in enumerate(images) for d in im.meta.dims]
    return spark.createDataFrame(rows, "level int, dim string, size long, scale double, translation double")


def extent(images: Sequence[Image]) -> DataFrame:
    """level, dim, extent: covered length; equal on all levels where factors divide the size."""
    return datasets(images).select("level", "dim", (F.col("size") * F.col("scale")).alias("extent"))


def write_parquet(images: Sequence[Image], path: str) -> None:
    as_table(images).write.partitionBy("level").parquet(path)


def release(images: Sequence[Image]) -> None:
    for im in images:
        im.voxels.unpersist()
