"""NIfTI-1 volumes (``.nii``, ``.nii.gz``) as chunks, a chunk for each place of the last axis.

The driver reads the header alone. Planes of a plain file are read by all tasks,
each its own bytes; a packed file can only be unpacked from its start, so one
task does that, plane by plane, and holds no more than one.
"""

from __future__ import annotations

import gzip
import zlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..model import Channel, ImageMeta, Window
from ..operators.chunks import ARROW, SCHEMA, Chunked
from ..operators.metadata import from_nifti
from ..runtime import ship
from .store import filesystem, read_range

# Data type codes of the header.
TYPES = {2: "uint8", 4: "int16", 8: "int32", 16: "float32", 64: "float64", 256: "int8", 512: "uint16", 768: "uint32", 1024: "int64", 1280: "uint64"}
SPACE_CODES = {1: "meter", 2: "millimeter", 3: "micrometer"}
TIME_CODES = {8: "second", 16: "millisecond", 24: "microsecond"}


def header(data: bytes) -> dict:
    """Shape, dtype, byte order, offset, scaling and affine of a header."""
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    if struct.unpack_from(order + "i", data)[0] != 348:
        raise ValueError("not a NIfTI-1 header")
    dim = struct.unpack_from(order + "8h", data, 40)
    code = struct.unpack_from(order + "h", data, 70)[0]
    if code not in TYPES:
        raise ValueError(f"data type {code} is not supported")
    pix = struct.unpack_from(order + "8f", data, 76)
    offset, slope, inter = struct.unpack_from(order + "3f", data, 108)
    units = data[123]
    cal_max, cal_min = struct.unpack_from(order + "2f", data, 124)
    qform, sform = struct.unpack_from(order + "2h", data, 252)
    b, c, d, x, y, z = struct.unpack_from(order + "6f", data, 256)
    if sform > 0:
        affine = [list(struct.unpack_from(order + "4f", data, 280 + 16 * i)) for i in range(3)]
    elif qform > 0:
        a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
        q = -1.0 if pix[0] == -1 else 1.0
        r = [[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - c * c - b * b]]
        affine = [[r[i][0] * pix[1], r[i][1] * pix[2], r[i][2] * pix[3] * q, t] for i, t in enumerate((x, y, z))]
    else:
        affine = [[pix[i + 1] if i == j else 0.0 for j in range(3)] + [0.0] for i in range(3)]
    unit = {k: SPACE_CODES[units & 7] for k in "xyz" if units & 7 in SPACE_CODES}
    if units & 56 in TIME_CODES:
        unit["t"] = TIME_CODES[units & 56]
    return dict(shape=list(dim[1 : dim[0] + 1]), dtype=TYPES[code], order=order, offset=int(offset), slope=slope, inter=inter, affine=affine, units=unit, cal=(cal_min, cal_max))


def _head(path: str) -> tuple[bytes, bool]:
    """The first 352 bytes of a volume, and whether it is packed; a few KB of the file are read."""
    try:
        raw = read_range(path, 0, 4096)
    except FileNotFoundError:
        raise FileNotFoundError(path) from None
    packed = raw[:2] == b"\x1f\x8b"
    return (zlib.decompressobj(31).decompress(raw, 352) if packed else raw[:352]), packed


def read(spark: SparkSession, path: str) -> Chunked:
    """One volume as chunks along its last axis; scaled samples are float32."""
    ship(spark)
    raw, packed = _head(path)
    h = header(raw)
    meta = from_nifti(h["affine"], h["shape"], h["dtype"], h["slope"], h["inter"], {k: v for k, v in h["units"].items() if k in "xyzt"[: len(h["shape"])]})
    meta.chunk = dict(meta.shape) | {meta.dims[-1]: 1}

    kind, planes = np.dtype(h["order"] + np.dtype(h["dtype"]).str[1:]), h["shape"][-1]
    size = int(np.prod(h["shape"][:-1])) * kind.itemsize

    def chunk(i: int, data: bytes):
        if len(data) != size:
            raise ValueError(f"{path} ends within plane {i}")
        part = np.frombuffer(data, kind).reshape([*h["shape"][:-1], 1], order="F")
        slope = h["slope"] if h["slope"] and not np.isnan(h["slope"]) else 1.0
        inter = 0.0 if np.isnan(h["inter"]) else h["inter"]
        if meta.dtype == "float32":
            part = part * np.float32(slope) + np.float32(inter)
        part = np.ascontiguousarray(part, np.dtype(meta.dtype))
        idx = [0] * (part.ndim - 1) + [i]
        return pa.Table.from_pylist([dict(image_id="image", level=0, idx=idx, origin=idx, shape=list(part.shape), dtype=meta.dtype, data=part.tobytes())], ARROW).to_batches()

    def plain(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from chunk(i, read_range(path, h["offset"] + i * size, size))

    def unpacked(batches):
        for batch in batches:
            if batch.num_rows:
                fs, p = filesystem(path)
                with fs.open_input_file(p) as raw, gzip.GzipFile(fileobj=raw) as f:
                    f.read(h["offset"])
                    for i in range(planes):
                        yield from chunk(i, f.read(size))

    if packed:
        return Chunked(spark.range(0, 1, 1, 1).mapInArrow(unpacked, SCHEMA), meta)
    return Chunked(spark.range(planes).mapInArrow(plain, SCHEMA), meta)


def window(spark: SparkSession, path: str, voxels: DataFrame) -> Channel:
    """Display window: the header's calibrated range where it is one, within the data's range."""
    from pyspark.sql import functions as F

    h = header(_head(path)[0])
    lo, hi = map(float, voxels.agg(F.min("value"), F.max("value")).first())
    a, b = h["cal"] if h["cal"][1] > h["cal"][0] else (lo, hi)
    return Channel("ffffff", Window(lo, hi, float(a), float(b)))


def write(path: str, x: np.ndarray, affine, slope: float = 1.0, inter: float = 0.0) -> None:
    """A small volume as a file (used by tests and for export of a single image)."""
    from .store import write_file

    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, x.ndim, *x.shape, *[1] * (7 - x.ndim))
    code = next(k for k, v in TYPES.items() if v == x.dtype.name)
    struct.pack_into("<2h", head, 70, code, x.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1, *[1] * 7)
    struct.pack_into("<3f", head, 108, 352, slope, inter)
    head[123] = 2
    struct.pack_into("<2h", head, 252, 0, 1)
    for i in range(3):
        struct.pack_into("<4f", head, 280 + 16 * i, *affine[i])
    head[344:348] = b"n+1\0"
    data = bytes(head) + x.astype(x.dtype.newbyteorder("<")).tobytes(order="F")
    write_file(path, gzip.compress(data) if path.endswith(".gz") else data)
