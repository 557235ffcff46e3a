"""Chunk layout: a row for each chunk, samples as bytes in row-major order.

    image_id string, level int, idx array<int>, origin array<long>, shape array<int>, dtype string, data binary

Per-chunk work runs in Arrow batches with numpy. Where bins do not cross
chunks, downsampling is a projection without a shuffle. A neighbourhood sends
each chunk only the border strips that its neighbours need (a halo), not whole
chunks. A chunk that is not in the table stands for the image's fill value, here
and in every operator; ``from_voxels`` and stores give all chunks unless told otherwise.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DTYPES, ImageMeta, Method
from ..plans import levels
from ..runtime import BATCH_BYTES, ship
from ..sources.tables import Image

SCHEMA = "image_id string, level int, idx array<int>, origin array<long>, shape array<int>, dtype string, data binary"
ARROW = pa.schema([("image_id", pa.string()), ("level", pa.int32()), ("idx", pa.list_(pa.int32())), ("origin", pa.list_(pa.int64())), ("shape", pa.list_(pa.int32())), ("dtype", pa.string()), ("data", pa.binary())])


class Chunked:
    """Chunks and the metadata of their image.

    Chunks of a store also know its path, and ``narrow``, which reads only the chunks that meet a box.
    """

    def __init__(self, chunks: DataFrame, meta: ImageMeta, source: str | None = None, narrow: Callable[[Mapping], DataFrame] | None = None):
        self.chunks, self.meta, self.source, self.narrow = chunks, meta, source, narrow


def _mapped(df: DataFrame, fn, schema: str = SCHEMA) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def _grouped(df: DataFrame, fn) -> DataFrame:
    ship(df.sparkSession)
    return df.groupBy("image_id", "level", "idx").applyInArrow(fn, SCHEMA)


def native(data: bytes, dtype: str, shape: Sequence[int]) -> np.ndarray:
    """Samples in native byte order; ``dtype`` may be a byte-order string."""
    x = np.frombuffer(data, np.dtype(dtype))
    return x.astype(x.dtype.newbyteorder("="), copy=False).reshape(shape)


def _row(image_id, level, idx, origin, x: np.ndarray, dtype: str) -> dict:
    return dict(image_id=image_id, level=level, idx=[int(i) for i in idx], origin=[int(o) for o in origin], shape=[int(n) for n in x.shape], dtype=dtype, data=np.ascontiguousarray(x, np.dtype(dtype)).tobytes())


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, ARROW)


def each(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of Arrow batches, one at a time: a whole batch as Python objects would be held a second time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
        batch = None  # goes before the next one comes


def _batched(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    """Chunks as Arrow batches of some megabytes, however many there are."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["data"])
        if size >= BATCH_BYTES // 4:
            yield from _table(held).to_batches()
            held, size = [], 0
    if held:
        yield from _table(held).to_batches()


def _all_indices(spark, grid: Sequence[int]) -> DataFrame:
    """One column ``idx``: every place of a grid of chunks."""
    place, left = [], math.prod(grid)
    for n in grid:
        left //= max(n, 1)
        place.append((F.floor(F.col("id") / max(left, 1)) % max(n, 1)).cast("int"))
    return spark.range(math.prod(grid)).select(F.array(*place).alias("idx"))


def _filled(meta: ImageMeta, idx: Sequence[int], image_id: str, level: int) -> dict:
    """A chunk of fill values."""
    origin = [i * meta.chunk[d] for i, d in zip(idx, meta.dims, strict=True)]
    shape = [min(meta.chunk[d], meta.shape[d] - o) for d, o in zip(meta.dims, origin, strict=True)]
    return _row(image_id, level, idx, origin, np.full(shape, meta.fill, np.dtype(meta.dtype)), meta.dtype)


def from_voxels(image: Image, chunk: Mapping[str, int], dtype: str | None = None, fill=None, image_id: str = "image", level: int = 0, dense: bool = True) -> Chunked:
    """Chunks of a voxel table; what no sample says is the fill value. Without ``dense``, chunks without a sample are left out."""
    fill = image.meta.fill if fill is None else fill
    ship(image.voxels.sparkSession)
    dims, dtype = image.meta.dims, dtype or image.meta.dtype
    chunk = {d: min(chunk[d], image.meta.shape[d]) or 1 for d in dims}
    shape = image.meta.shape
    idx = F.array(*[F.floor(F.col(d) / chunk[d]).cast("int") for d in dims])
    inner, size = F.lit(0).cast("long"), [chunk[d] for d in dims]
    for d in dims:
        inner = inner * chunk[d] + F.col(d) % chunk[d]
    rows = image.voxels.select(idx.alias("idx"), inner.alias("at"), "value")
    if dense:  # a row for each chunk joins its samples
        grid = [-(-shape[d] // chunk[d]) for d in dims]
        nothing = F.lit(None).cast(image.voxels.schema["value"].dataType)
        rows = rows.union(_all_indices(image.voxels.sparkSession, grid).select("idx", F.lit(None).cast("long"), nothing))
    rows = rows.groupBy("idx")

    def fill_chunk(key, table):
        own = key[0].as_py()
        origin = [i * n for i, n in zip(own, size, strict=True)]
        table = table.filter(pc.is_valid(table["at"]))
        x = np.full(math.prod(size), fill, np.dtype(dtype))
        x[table["at"].to_numpy()] = table["value"].to_numpy().astype(x.dtype)
        keep = tuple(slice(0, shape[d] - o) for d, o in zip(dims, origin, strict=True))
        return _table([_row(image_id, level, own, origin, x.reshape(size)[keep], dtype)])

    return Chunked(rows.applyInArrow(fill_chunk, SCHEMA), replace(image.meta, chunk=chunk, dtype=dtype, fill=fill))


def densify(image: Chunked, image_id: str = "image", level: int = 0) -> Chunked:
    """The image with a chunk of fill values in every place that has none."""
    m = image.meta
    grid = [-(-m.shape[d] // m.chunk[d]) for d in m.dims]
    absent = _all_indices(image.chunks.sparkSession, grid).join(image.chunks.select("idx"), "idx", "left_anti")

    def fill(batches):
        for batch in batches:
            for idx in batch.column(0).to_pylist():
                yield from _table([_filled(m, idx, image_id, level)]).to_batches()

    return Chunked(image.chunks.unionByName(_mapped(absent, fill)), m)


def generated(spark, meta: ImageMeta, sample) -> Chunked:
    """Chunks that tasks make: ``sample`` gets an open grid of the chunk's indices (an array for each axis) and gives its samples."""

    def make(batches):
        for batch in batches:
            for idx in batch.column(0).to_pylist():
                origin = [i * meta.chunk[d] for i, d in zip(idx, meta.dims, strict=True)]
                grid = np.ogrid[tuple(slice(o, min(o + meta.chunk[d], meta.shape[d])) for o, d in zip(origin, meta.dims, strict=True))]
                yield from _table([_row("image", 0, idx, origin, sample(*grid).astype(np.dtype(meta.dtype)), meta.dtype)]).to_batches()

    return Chunked(_mapped(_all_indices(spark, [-(-meta.shape[d] // meta.chunk[d]) for d in meta.dims]), make), meta)


def from_array(spark, x: np.ndarray, meta: ImageMeta, image_id: str = "image") -> Chunked:
    """Chunks of an array that the driver holds, such as the samples of another image structure."""
    chunk = {d: min(meta.chunk.get(d, n), n) or 1 for d, n in meta.shape.items()}
    meta = replace(meta, chunk=chunk, dtype=x.dtype.name)
    rows = []
    for idx in itertools.product(*(range(-(-meta.shape[d] // chunk[d])) for d in meta.dims)):
        origin = [i * chunk[d] for i, d in zip(idx, meta.dims, strict=True)]
        rows.append(_row(image_id, 0, idx, origin, x[tuple(slice(o, o + chunk[d]) for o, d in zip(origin, meta.dims, strict=True))], meta.dtype))
    return Chunked(spark.createDataFrame(_table(rows)), meta)


def to_array(image: Chunked, most: int = 1 << 30) -> np.ndarray:
    """All samples as one array on the driver; refused beyond ``most`` bytes."""
    m = image.meta
    if levels.memory_bytes(m.shape, m.chunk, m.dtype) > most:
        raise ValueError(f"the image has more than {most} bytes; take a hyperslab first")
    out = np.full([m.shape[d] for d in m.dims], m.fill, np.dtype(m.dtype))
    for r in image.chunks.select("origin", "shape", "dtype", "data").toLocalIterator():
        out[tuple(slice(o, o + n) for o, n in zip(r.origin, r.shape, strict=True))] = native(bytes(r.data), r.dtype, r.shape)
    return out


def to_voxels(image: Chunked) -> Image:
    """Every sample of every chunk as a row (of a table with absent chunks only what is there; see ``densify``)."""
    dims = image.meta.dims
    kind = DTYPES[image.meta.dtype]

    def run(batches):
        for r in each(batches):
            x = native(r["data"], r["dtype"], r["shape"])
            at = np.indices(x.shape).reshape(len(dims), -1) + np.array(r["origin"])[:, None]
            value = x.ravel()
            cols = [pa.array(a) for a in at]
            target = {"short": pa.int16(), "byte": pa.int8(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "decimal(20,0)": pa.decimal128(20, 0)}[kind]
            values = pa.array([int(v) for v in value], target) if kind.startswith("decimal") else pa.array(value.astype(target.to_pandas_dtype()), target)
            yield pa.RecordBatch.from_arrays([*cols, values], [*dims, "value"])

    return Image(_mapped(image.chunks, run, ", ".join([*(f"{d} long" for d in dims), f"value {kind}"])), image.meta)


def rechunk(image: Chunked, chunk: Mapping[str, int]) -> Chunked:
    """Other chunk lengths: every chunk is cut into the pieces of new chunks, pieces meet by new chunk."""
    dims, shape, dtype = image.meta.dims, image.meta.shape, image.meta.dtype
    size, fill = [chunk[d] for d in dims], image.meta.fill

    def pieces(r):
        x, lo = native(r["data"], r["dtype"], r["shape"]), r["origin"]
        spans = [range(o // n, (o + m - 1) // n + 1) for o, m, n in zip(lo, x.shape, size, strict=True)]
        for idx in itertools.product(*spans):
            a = [max(i * n, o) for i, n, o in zip(idx, size, lo, strict=True)]
            b = [min((i + 1) * n, o + m) for i, n, o, m in zip(idx, size, lo, x.shape, strict=True)]
            yield _row(r["image_id"], r["level"], idx, a, x[tuple(slice(p - o, q - o) for p, q, o in zip(a, b, lo, strict=True))], r["dtype"])

    def cut(batches):
        yield from _batched(piece for r in each(batches) for piece in pieces(r))

    def join(key, table):
        rows = table.to_pylist()
        origin = [i * n for i, n in zip(rows[0]["idx"], size, strict=True)]
        full = [min(n, shape[d] - o) for n, d, o in zip(size, dims, origin, strict=True)]
        x = np.full(full, fill, np.dtype(dtype))
        for r in rows:
            part = native(r["data"], r["dtype"], r["shape"])
            x[tuple(slice(p - o, p - o + m) for p, o, m in zip(r["origin"], origin, part.shape, strict=True))] = part
        return _table([_row(rows[0]["image_id"], rows[0]["level"], rows[0]["idx"], origin, x, dtype)])

    return Chunked(_grouped(_mapped(image.chunks, cut), join), replace(image.meta, chunk=dict(chunk)))


def transpose(image: Chunked, dims: Sequence[str]) -> Chunked:
    order = [image.meta.dims.index(d) for d in dims]

    def run(batches):
        yield from _batched(_row(r["image_id"], r["level"], [r["idx"][i] for i in order], [r["origin"][i] for i in order], native(r["data"], r["dtype"], r["shape"]).transpose(order), r["dtype"]) for r in each(batches))

    return Chunked(_mapped(image.chunks, run), replace(image.meta, dims=tuple(dims)))


def hyperslab(image: Chunked, box: Mapping[str, tuple[int, int]]) -> Chunked:
    """Only the chunks that meet the box, cut to it; of a store only those are read."""
    dims = image.meta.dims
    df = image.narrow(box) if image.narrow else image.chunks
    for i, d in enumerate(dims):
        if d in box:
            df = df.where((F.get("origin", F.lit(i)) < box[d][1]) & (F.get("origin", F.lit(i)) + F.get("shape", F.lit(i)) > box[d][0]))

    def cut(r):
        a = [max(box.get(d, (0, o))[0], o) for d, o in zip(dims, r["origin"], strict=True)]
        b = [min(box[d][1] if d in box else o + m, o + m) for d, o, m in zip(dims, r["origin"], r["shape"], strict=True)]
        x = native(r["data"], r["dtype"], r["shape"])[tuple(slice(p - o, q - o) for p, q, o in zip(a, b, r["origin"], strict=True))]
        return _row(r["image_id"], r["level"], r["idx"], a, x, r["dtype"])

    def run(batches):
        yield from _batched(map(cut, each(batches)))

    return Chunked(_mapped(df, run), image.meta)


def _shrink(x: np.ndarray, step: Sequence[int]) -> np.ndarray:
    """Mean of each whole bin."""
    keep = tuple(slice(0, n // k * k) for n, k in zip(x.shape, step, strict=True))
    x = x[keep].astype(np.float64)
    for axis, k in enumerate(step):
        if k > 1:
            x = x.reshape(*x.shape[:axis], x.shape[axis] // k, k, *x.shape[axis + 1 :]).sum(axis + 1)
    return x / math.prod(step)


def _sample(x: np.ndarray, step: Sequence[int]) -> np.ndarray:
    keep = tuple(slice(0, n // k * k, k) for n, k in zip(x.shape, step, strict=True))
    return x[keep]


def _step_list(image: Chunked, step: Mapping[str, int]) -> list[int]:
    out = [step.get(d, 1) if d in image.meta.spatial else 1 for d in image.meta.dims]
    for d, k in zip(image.meta.dims, out, strict=True):
        if k > 1 and image.meta.chunk[d] % k and image.meta.chunk[d] < image.meta.shape[d]:
            raise ValueError(f"chunks of {d} are not whole bins; rechunk to {levels.aligned_chunk(image.meta.chunk, [step])}")
    return out


def _shrunk(image: Chunked, step: Mapping[str, int], dtype: str) -> ImageMeta:
    meta = levels.next_meta(image.meta, step)
    return replace(meta, dtype=dtype, chunk={d: max(image.meta.chunk[d] // step.get(d, 1), 1) for d in meta.dims})


def bin_shrink(image: Chunked, step: Mapping[str, int], level: int = 1) -> Chunked:
    """Mean of each bin, chunk by chunk (no shuffle); chunk lengths must be whole bins."""
    return _chunkwise(image, step, _shrink, "float64", level)


def nearest(image: Chunked, step: Mapping[str, int], level: int = 1) -> Chunked:
    return _chunkwise(image, step, _sample, image.meta.dtype, level)


def _chunkwise(image: Chunked, step, work, dtype, level) -> Chunked:
    k = _step_list(image, step)

    def shrunk(rows):
        for r in rows:
            x = work(native(r["data"], r["dtype"], r["shape"]), k)
            if x.size:  # a leftover of less than a bin makes no chunk
                yield _row(r["image_id"], level, r["idx"], [o // f for o, f in zip(r["origin"], k, strict=True)], x, dtype)

    def run(batches):
        yield from _batched(shrunk(each(batches)))

    return Chunked(_mapped(image.chunks, run), _shrunk(image, step, dtype))


def gaussian(image: Chunked, step: Mapping[str, int], level: int = 1, kernel=None) -> Chunked:
    """Separable Gaussian sampled at each bin's first voxel; one halo exchange for each reduced axis."""
    _step_list(image, step)
    if kernel is None:
        cut = levels.truncate({d: levels.sigma(step.get(d, 1)) for d in image.meta.spatial}, image.meta.shape)
        kernel = lambda k: levels.kernel(k, cut)
    out = image
    for axis, d in enumerate(image.meta.dims):
        k = step.get(d, 1) if d in image.meta.spatial else 1
        if k > 1:
            taps = kernel(k)
            out = _halo_pass(out, axis, d, k, taps[0][0], taps[-1][0], _weighted(axis, k, taps), level)
    return out


def discrete_gaussian(image: Chunked, step: Mapping[str, int], level: int = 1) -> Chunked:
    return gaussian(image, step, level, levels.discrete_kernel)


def mode(image: Chunked, step: Mapping[str, int], level: int = 1) -> Chunked:
    """Most frequent value of each window; axes cannot be separated, so one pass gathers all axes' halos in turn."""
    k = _step_list(image, step)
    out = image
    for axis, d in enumerate(image.meta.dims):
        if k[axis] > 1:
            out = _halo(out, axis, d, -(k[axis] // 2), k[axis] - k[axis] // 2 - 1)
    dims, shape, chunk = image.meta.dims, image.meta.shape, image.meta.chunk

    def voted(rows):
        for r in rows:
            x = native(r["data"], r["dtype"], r["shape"])
            n = [min(chunk[d], shape[d] - o) // f for d, o, f in zip(dims, r["origin"], k, strict=True)]
            if not math.prod(n):
                continue
            w = np.lib.stride_tricks.sliding_window_view(x, k)[tuple(slice(0, m * f, f) for m, f in zip(n, k, strict=True))]
            w = np.sort(w.reshape(*n, -1), -1)
            best, count = w[..., 0].copy(), np.zeros(n, int)
            for i in range(w.shape[-1]):  # values ascend, so a later one has to be more frequent
                c = (w == w[..., i : i + 1]).sum(-1)
                better = c > count
                best[better], count[better] = w[..., i][better], c[better]
            yield _row(r["image_id"], level, r["idx"], [o // f for o, f in zip(r["origin"], k, strict=True)], best, r["dtype"])

    def run(batches):
        yield from _batched(voted(each(batches)))

    return Chunked(_mapped(out.chunks, run), _shrunk(image, step, image.meta.dtype))


def _weighted(axis: int, k: int, taps):
    lo = taps[0][0]

    def work(x: np.ndarray, n: int) -> np.ndarray:
        x = np.moveaxis(x.astype(np.float64), axis, 0)
        out = sum(w * x[o - lo : o - lo + (n - 1) * k + 1 : k] for o, w in taps)
        return np.moveaxis(out, 0, axis)

    return work


def _halo(image: Chunked, axis: int, dim: str, lo: int, hi: int) -> Chunked:
    """Chunks widened along one axis by lo (before) and hi (after) samples, the image's edges repeated.

    A chunk sends itself to its own place and to others only the strips that
    they need; a strip may come from several chunks off when chunks are short.
    """
    n, c, fill = image.meta.shape[dim], image.meta.chunk[dim], image.meta.fill
    last = -(-n // c) - 1

    def strips(rows):
        for r in rows:
            x, o = np.moveaxis(native(r["data"], r["dtype"], r["shape"]), axis, 0), r["origin"][axis]
            m, own = len(x), r["idx"][axis]
            for j in range(max(0, own - -(-hi // c) - 1), min(last, own + -(-(-lo) // c) + 1) + 1):
                a, b = max(j * c + lo, o), min(min((j + 1) * c, n) + hi, o + m)
                if a < b:
                    idx, origin = list(r["idx"]), list(r["origin"])
                    idx[axis], origin[axis] = j, a
                    yield _row(r["image_id"], r["level"], idx, origin, np.moveaxis(x[a - o : b - o], 0, axis), r["dtype"])

    def send(batches):
        yield from _batched(strips(each(batches)))

    def join(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["origin"][axis])
        j = rows[0]["idx"][axis]
        a, b = max(j * c + lo, 0), min(min((j + 1) * c, n) + hi, n)  # within the image; absent chunks stay fill values
        full = list(rows[0]["shape"])
        full[axis] = b - a
        x = np.full(full, fill, np.dtype(rows[0]["dtype"]))
        for r in rows:
            part, at = native(r["data"], r["dtype"], r["shape"]), r["origin"][axis] - a
            x[tuple(slice(at, at + part.shape[axis]) if i == axis else slice(None) for i in range(x.ndim))] = part
        before, after = a - (j * c + lo), min((j + 1) * c, n) + hi - b
        x = np.pad(x, [(before, after) if i == axis else (0, 0) for i in range(x.ndim)], "edge")
        origin = list(rows[0]["origin"])
        origin[axis] = j * c
        return _table([_row(rows[0]["image_id"], rows[0]["level"], rows[0]["idx"], origin, x, rows[0]["dtype"])])

    return Chunked(_grouped(_mapped(image.chunks, send), join), image.meta)


def _halo_pass(image: Chunked, axis, dim, k, lo, hi, work, level) -> Chunked:
    n, c = image.meta.shape[dim], image.meta.chunk[dim]
    wide = _halo(image, axis, dim, lo, hi)

    def weighed(rows):
        for r in rows:
            m = min(c, n - r["origin"][axis]) // k
            if m:
                origin = list(r["origin"])
                origin[axis] //= k
                yield _row(r["image_id"], level, r["idx"], origin, work(native(r["data"], r["dtype"], r["shape"]), m), "float64")

    def run(batches):
        yield from _batched(weighed(each(batches)))

    return Chunked(_mapped(wide.chunks, run), _shrunk(image, {dim: k}, "float64"))


CHUNK_METHODS = {Method.BIN_SHRINK: bin_shrink, Method.NEAREST: nearest, Method.GAUSSIAN: gaussian, Method.DISCRETE_GAUSSIAN: discrete_gaussian, Method.MODE: mode}
