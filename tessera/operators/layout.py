"""Slices, axis orders, concatenation, splits and chunk statistics of voxel tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ImageMeta
from ..plans import levels
from ..sources.tables import Image


def _without(meta: ImageMeta, dim: str) -> ImageMeta:
    drop = lambda m: {k: v for k, v in m.items() if k != dim}
    return ImageMeta(tuple(d for d in meta.dims if d != dim), drop(meta.shape), drop(meta.scale), drop(meta.translation), drop(meta.chunk), meta.dtype, meta.name, drop(meta.units), drop(meta.orientations), meta.fill)


def take(image: Image, dim: str, index: int) -> Image:
    """One place of an axis; the axis goes, with its scale, translation and unit."""
    if dim not in image.meta.dims or not 0 <= index < image.meta.shape[dim]:
        raise IndexError(f"{dim} has no place {index}")
    return Image(image.voxels.where(F.col(dim) == index).drop(dim), _without(image.meta, dim))


def hyperslab(image: Image, box: Mapping[str, tuple[int, int]], shift: bool = False) -> Image:
    """Half-open ranges of some axes; with ``shift`` indices start at 0 and translations follow."""
    df, meta = image.voxels, image.meta
    shape, translation = dict(meta.shape), dict(meta.translation)
    for d, (a, b) in box.items():
        a, b = max(a, 0), min(b, meta.shape[d])
        df = df.where((F.col(d) >= a) & (F.col(d) < b))
        if shift:
            df = df.withColumn(d, F.col(d) - a)
            shape[d] = max(b - a, 0)
            if d in translation:
                translation[d] += a * meta.scale.get(d, 1.0)
    return Image(df, replace(meta, shape=shape, translation=translation))


def transpose(image: Image, dims: Sequence[str] | str) -> Image:
    """Another axis order; a table keeps its rows, only columns and metadata change."""
    dims = levels.transposed(image.meta.dims, dims) if isinstance(dims, str) else tuple(dims)
    if sorted(dims) != sorted(image.meta.dims):
        raise ValueError(f"{dims} is no order of {image.meta.dims}")
    return Image(image.voxels.select(*dims, "value"), replace(image.meta, dims=dims))


def concat(images: Sequence[Image], dim: str) -> Image:
    """Images one after another along an axis that all have."""
    at, parts = 0, []
    for im in images:
        parts.append(im.voxels.withColumn(dim, F.col(dim) + at))
        at += im.meta.shape[dim]
    first = images[0].meta
    return Image(reduce(DataFrame.unionByName, parts), replace(first, shape=first.shape | {dim: at}))


def stack(images: Sequence[Image], dim: str) -> Image:
    """Images as places of a new leading axis."""
    parts = [im.voxels.withColumn(dim, F.lit(i).cast("long")) for i, im in enumerate(images)]
    first = images[0].meta
    dims = (dim, *first.dims)
    return Image(reduce(DataFrame.unionByName, parts).select(*dims, "value"), replace(first, dims=dims, shape={dim: len(images)} | first.shape))


def array_split(image: Image, sections: int | Sequence[int], dim: str) -> list[Image]:
    return [hyperslab(image, {dim: p}, shift=True) for p in levels.split_points(image.meta.shape[dim], sections)]


def cast(image: Image, dtype: str) -> Image:
    from ..model import DTYPES

    return Image(image.voxels.withColumn("value", F.col("value").cast(DTYPES[dtype])), replace(image.meta, dtype=dtype))


def chunk_index(dims: Sequence[str], chunk: Mapping[str, int]):
    return [F.floor(F.col(d) / F.lit(chunk[d])).cast("long").alias(f"i{d}") for d in dims]


def chunk_stats(image: Image, chunk: Mapping[str, int]) -> DataFrame:
    """Samples, least and largest value of each chunk: what a chunk index would hold."""
    cols = chunk_index(image.meta.dims, chunk)
    out = image.voxels.select(*cols, "value").groupBy(*[f"i{d}" for d in image.meta.dims])
    return out.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax"))


def rechunk_count(image: Image, old: Mapping[str, int], new: Mapping[str, int]) -> DataFrame:
    """For each new chunk the number of old chunks that it is built of."""
    dims = image.meta.dims
    a = [c.alias(f"o{d}") for c, d in zip(chunk_index(dims, old), dims, strict=True)]
    b = [c.alias(f"i{d}") for c, d in zip(chunk_index(dims, new), dims, strict=True)]
    rows = image.voxels.select(*a, *b).distinct()
    return rows.groupBy(*[f"i{d}" for d in dims]).agg(F.count(F.lit(1)).alias("pieces"))


def shard_assign(image: Image, chunk: Mapping[str, int], per_shard: Mapping[str, int]) -> DataFrame:
    """Chunks, with the shard and the row-major place in the shard of each."""
    dims = image.meta.dims
    rows = image.voxels.select(*chunk_index(dims, chunk)).distinct()
    inner = F.lit(0).cast("long")
    for d in dims:
        inner = inner * F.lit(per_shard.get(d, 1)) + F.pmod(F.col(f"i{d}"), F.lit(per_shard.get(d, 1)))
    return rows.select(*[f"i{d}" for d in dims], *[F.floor(F.col(f"i{d}") / per_shard.get(d, 1)).cast("long").alias(f"s{d}") for d in dims], inner.alias("inner"))


def difference(a: Image, b: Image) -> DataFrame:
    """Rows of one image that the other lacks, with the side."""
    cols = [*a.meta.dims, "value"]
    x, y = a.voxels.select(cols), b.voxels.select(cols)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))
