"""Planning on the driver: chunk sizes, pyramid levels, kernels, regions, estimates.

Pure Python over a handful of numbers; nothing here depends on the data.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from ..model import DIMS, SPATIAL, ImageMeta, MetadataError

_BY_RANK = {1: ("x",), 2: ("y", "x"), 3: ("z", "y", "x"), 4: ("z", "y", "x", "c"), 5: ("t", "z", "y", "x", "c")}
ITEM_BYTES = {"bool": 1, "int8": 1, "uint8": 1, "int16": 2, "uint16": 2, "float16": 2, "int32": 4, "uint32": 4, "float32": 4, "int64": 8, "uint64": 8, "float64": 8, "complex64": 8, "complex128": 16}


def default_dims(rank: int) -> tuple[str, ...]:
    if rank not in _BY_RANK:
        raise MetadataError(f"no default dims for {rank} axes")
    return _BY_RANK[rank]


def chunk_lengths(dims: Sequence[str], spec: int | Sequence[int] | Mapping[str, int] | None = None) -> dict[str, int]:
    """Chunk length of each axis from an int, a tuple in axis order, a mapping, or the default."""
    default = {d: 1 if d == "t" else 128 if "z" in dims else 256 for d in dims}
    if spec is None:
        return default
    if isinstance(spec, int):
        return {d: spec for d in dims}
    if isinstance(spec, Mapping):
        return default | {d: spec[d] for d in dims if d in spec}
    return dict(zip(dims, spec, strict=True))


def auto_factors(shape: Mapping[str, int], chunk: Mapping[str, int], min_length: int = 128) -> list[dict[str, int]]:
    """Absolute factors of the levels: halve the longer spatial axes while one exceeds two chunks."""
    sizes = {d: n for d, n in shape.items() if d in SPATIAL}
    factor = {d: 1 for d in sizes}
    out: list[dict[str, int]] = []
    while any(sizes[d] > 2 * chunk[d] for d in sizes):
        longest = max(sizes.values())
        grow = [d for d in sizes if sizes[d] > longest / 2 and sizes[d] / 2 >= chunk[d]]
        for d in grow:
            factor[d] *= 2
            sizes[d] //= 2
        if not grow or math.prod(sizes.values()) / min_length < 2:
            break
        out.append(dict(factor))
    return out


def level_factors(dims: Sequence[str], spec: Sequence[int | Mapping[str, int]]) -> list[dict[str, int]]:
    """Absolute factors for each spatial axis; an axis that a mapping leaves out is not reduced."""
    spatial = [d for d in dims if d in SPATIAL]
    return [{d: int(s) if isinstance(s, int) else int(s.get(d, 1)) for d in spatial} for s in spec]


def steps(levels: Sequence[Mapping[str, int]]) -> list[dict[str, int]]:
    """Factors relative to the level before; a ratio that is no integer is refused."""
    out, prev = [], {}
    for level in levels:
        step = {}
        for d, f in level.items():
            if f % prev.get(d, 1):
                raise ValueError(f"factor {f} of {d} is no multiple of {prev[d]}")
            step[d] = f // prev.get(d, 1)
        out.append(step)
        prev = level
    return out


def sigma(k: int) -> float:
    """Standard deviation for a reduction by k: half the kernel's width at half height."""
    return math.sqrt((k * k - 1) / (2 * math.sqrt(2 * math.log(2))) ** 2)


def truncate(sigmas: Mapping[str, float], shape: Mapping[str, int], start: float = 4.0) -> float:
    """Largest cut-off, in steps of half a standard deviation, whose radius fits the image."""
    cut = start
    while cut > 0 and any(radius(s, cut) > shape[d] for d, s in sigmas.items()):
        cut -= 0.5
    return cut


def radius(s: float, cut: float = 4.0) -> int:
    return max(0, math.floor(cut * s + 0.5))


def kernel(k: int, cut: float = 4.0) -> list[tuple[int, float]]:
    """(offset, weight) of the sampled, normalised Gaussian for a reduction by k."""
    s = sigma(k)
    if s == 0:
        return [(0, 1.0)]
    r = radius(s, cut)
    w = [math.exp(-0.5 * (o / s) ** 2) for o in range(-r, r + 1)]
    return [(o, x / math.fsum(w)) for o, x in zip(range(-r, r + 1), w, strict=True)]


def discrete_kernel(k: int, error: float = 0.01, width: int = 32) -> list[tuple[int, float]]:
    """(offset, weight) of the discrete Gaussian for a reduction by k: exp(-v) I_n(v), v the variance, I_n a modified Bessel function.

    It reaches as far as all but ``error`` of the weight lies within, at most ``width`` places, and is normalised.
    """
    v = sigma(k) ** 2
    if v == 0:
        return [(0, 1.0)]
    steps = 256 + 16 * math.ceil(math.sqrt(v))  # the mean over a circle is exact far beyond a float's digits
    turn = [2 * math.pi * j / steps for j in range(steps)]
    high = [math.exp(v * (math.cos(t) - 1)) / steps for t in turn]
    bessel = lambda n: math.fsum(h * math.cos(n * t) for h, t in zip(high, turn, strict=True))
    w = [bessel(0), bessel(1)]
    while w[0] + 2 * math.fsum(w[1:]) < 1 - error and len(w) <= width:
        w.append(bessel(len(w)))
    total = w[0] + 2 * math.fsum(w[1:])
    return [(o, w[abs(o)] / total) for o in range(1 - len(w), len(w))]


def vote_weights(k: int) -> list[tuple[int, int]]:
    """(offset from the bin's first voxel, weight) of the linear label vote: a triangle over twice the bin."""
    # integer triangle around the bin centre (k - 1) / 2, reaching half a bin beyond both sides
    lo, hi = -(k // 2), k - 1 + k // 2
    return [(o, w) for o in range(lo, hi + 1) if (w := 2 * k - abs(2 * o - (k - 1))) > 0]


def next_geometry(scale: Mapping[str, float], translation: Mapping[str, float], step: Mapping[str, int]):
    """Scale and translation after a reduction: bins' centres."""
    s = {d: v * step.get(d, 1) for d, v in scale.items()}
    t = {d: v + 0.5 * (step.get(d, 1) - 1) * scale.get(d, 1.0) for d, v in translation.items()}
    return s, t


def next_shape(shape: Mapping[str, int], step: Mapping[str, int]) -> dict[str, int]:
    return {d: n // step.get(d, 1) for d, n in shape.items()}


def next_meta(meta: ImageMeta, step: Mapping[str, int]) -> ImageMeta:
    s, t = next_geometry(meta.scale, meta.translation, step)
    return ImageMeta(meta.dims, next_shape(meta.shape, step), s, t, dict(meta.chunk), meta.dtype, meta.name, dict(meta.units), dict(meta.orientations), meta.fill)


def split_points(n: int, sections: int | Sequence[int]) -> list[tuple[int, int]]:
    """(start, end) of each section; the first n % sections ones are longer by one."""
    if isinstance(sections, int):
        if sections <= 0:
            raise ValueError("there has to be a section at least")
        q, r = divmod(n, sections)
        edges = [i * q + min(i, r) for i in range(sections + 1)]
    else:
        edges = [0, *sections, n]
    return list(zip(edges, edges[1:], strict=False))


def memory_bytes(shape: Mapping[str, int], chunk: Mapping[str, int], dtype: str, constrained: Sequence[str] = ()) -> int:
    """Bytes of the array; a constrained axis counts with one chunk."""
    return math.prod(min(chunk[d], n) if d in constrained else n for d, n in shape.items()) * ITEM_BYTES[dtype]


def memory_bytes_by_axis(shape: Mapping[str, int], chunk: Mapping[str, int], dtype: str, constrained: Sequence[str] = ()) -> int:
    """The estimate that multiplies by the item size once for each axis; equal for one-byte samples."""
    return math.prod((min(chunk[d], n) if d in constrained else n) * ITEM_BYTES[dtype] for d, n in shape.items())


def chunk_count(shape: Mapping[str, int], chunk: Mapping[str, int]) -> int:
    return math.prod(-(-n // chunk[d]) for d, n in shape.items())


def regions(shape: Mapping[str, int], chunk: Mapping[str, int], dtype: str, target: int) -> list[dict[str, tuple[int, int]]]:
    """Boxes of whole chunks that tile the array, each within ``target`` bytes where one chunk allows it.

    Slabs along z, split into planes along y and strips along x as far as needed.
    """
    boxes = [{d: (0, n) for d, n in shape.items()}]
    size = lambda b: math.prod(e - s for s, e in b.values()) * ITEM_BYTES[dtype]
    for d in ("z", "y", "x"):
        if d not in shape:
            continue
        out = []
        for b in boxes:
            if size(b) <= target:
                out.append(b)
                continue
            line = size(b) // shape[d]
            step = max(target // max(line, 1) // chunk[d], 1) * chunk[d]
            out += [b | {d: (s, min(s + step, shape[d]))} for s in range(0, shape[d], step)]
        boxes = out
    return boxes


def shard_shape(dims: Sequence[str], chunk: Mapping[str, int], per_shard: int | Sequence[int] | Mapping[str, int]) -> dict[str, int]:
    if isinstance(per_shard, int):
        per_shard = {d: per_shard for d in dims}
    elif not isinstance(per_shard, Mapping):
        per_shard = dict(zip(dims, per_shard, strict=True))
    return {d: chunk[d] * per_shard.get(d, 1) for d in dims}


def aligned_chunk(chunk: Mapping[str, int], levels: Sequence[Mapping[str, int]]) -> dict[str, int]:
    """Chunk lengths that every level's factor divides, so that bins never cross chunks."""
    return {d: math.lcm(1, *(lv.get(d, 1) for lv in levels)) * max(1, n // math.lcm(1, *(lv.get(d, 1) for lv in levels))) for d, n in chunk.items()}


_SIZE = re.compile(r"\s*([0-9.]+)\s*([kKMGTP]?i?)[bB]?\s*$")


def parse_bytes(text: str | int) -> int:
    """'4GB', '512MiB', '1e9'-like sizes in bytes."""
    if isinstance(text, int):
        return text
    m = _SIZE.match(text)
    if not m:
        return int(float(text))
    unit = m[2]
    base = 1024 if unit.endswith("i") else 1000
    return int(float(m[1]) * base ** ("kmgtp".index(unit[0].lower()) + 1 if unit else 0))


def transposed(dims: Sequence[str], order: str) -> tuple[str, ...]:
    """Axis orders: 'spatial_last', 'zyx_last', 'channel_last', 'itk' (sorted names, t last)."""
    if order == "spatial_last":
        return (*(d for d in dims if d not in SPATIAL), *(d for d in dims if d in SPATIAL))
    if order == "zyx_last":
        return (*(d for d in dims if d not in SPATIAL), *(d for d in SPATIAL if d in dims))
    if order == "channel_last":
        return (*(d for d in dims if d != "c"), *(d for d in dims if d == "c"))
    if order == "itk":
        return (*(d for d in sorted(dims) if d != "t"), *(d for d in dims if d == "t"))
    raise ValueError(f"unknown order {order}")


def check_dims(dims: Sequence[str]) -> None:
    if set(dims) - set(DIMS):
        raise MetadataError("dims not valid")
