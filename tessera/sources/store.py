"""Directory-of-chunks stores (array format versions 2 and 3) as a Spark data source.

Files are reached through pyarrow's file systems, so local folders, ``s3://``,
``gs://`` and ``hdfs://`` URLs work from every executor. Reading lists no files:
chunk keys follow from the array's shape, and a partition is a run of chunk keys;
each level is a read of its own, so no byte of other levels is touched.
Writing puts a file for each chunk (or shard) and, once all tasks are done, the
JSON metadata; a rerun of a task writes the same files again.

Codecs: none, gzip, zstd. Chunks without a file (or without a place in their shard)
hold the fill value; a read gives them like all others, unless told to skip them.
A box of samples narrows a read to the chunks that meet it: no other file is opened.
"""

from __future__ import annotations

import gzip
import json
import math
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..model import ImageMeta
from ..operators.chunks import ARROW, SCHEMA, Chunked, each, native
from ..plans import levels
from ..runtime import ship

# Names of the format.
V2_ARRAY, V2_GROUP, V2_ATTRS, V2_ALL, V3_NODE = ".zarray", ".zgroup", ".zattrs", ".zmetadata", "zarr.json"


def filesystem(path: str):
    """(file system, path in it) of a URL or a local path; settings of an object store stand in the URL's query or the environment."""
    from pyarrow import fs

    if path.split("://")[0] in ("http", "https", "az", "azure"):
        raise ValueError(f"{path}: no client for this scheme is at hand; copy the store to a file system, s3, gs or hdfs")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_file(path: str) -> bytes | None:
    fs, p = filesystem(path)
    try:
        with fs.open_input_file(p) as f:
            return f.read()
    except (FileNotFoundError, NotADirectoryError):
        return None


def write_file(path: str, data: bytes) -> None:
    fs, p = filesystem(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(p, compression=None) as f:
        f.write(data)


def read_range(path: str, start: int, length: int) -> bytes:
    fs, p = filesystem(path)
    with fs.open_input_file(p) as f:
        f.seek(start)
        return f.read(length)


def read_json(path: str) -> dict | None:
    data = read_file(path)
    return None if data is None else json.loads(data)


def remove(path: str) -> None:
    """Delete a store or an array; a folder with anything else in it is refused."""
    from pyarrow import fs as pfs

    fs, p = filesystem(path)
    if fs.get_file_info(p).type != pfs.FileType.Directory:
        return
    inside = fs.get_file_info(pfs.FileSelector(p))
    if inside and not {i.base_name for i in inside} & {V2_ARRAY, V2_GROUP, V2_ATTRS, V2_ALL, V3_NODE}:
        raise ValueError(f"{path} holds files and is no store")
    fs.delete_dir(p)


def consolidated(path: str) -> dict[str, dict]:
    """Metadata of all nodes of a store that has it in one document: node file to JSON; else empty."""
    v3 = read_json(f"{path}/{V3_NODE}")
    if v3 is not None:
        nodes = (v3.get("consolidated_metadata") or {}).get("metadata") or {}
        return {f"{k}/{V3_NODE}": v for k, v in nodes.items()}
    return (read_json(f"{path}/{V2_ALL}") or {}).get("metadata") or {}


def compress(data: bytes, codec: str | None, level: int = 3) -> bytes:
    if not codec:
        return data
    if codec == "gzip":
        return gzip.compress(data, level, mtime=0)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(data)
    raise ValueError(f"codec {codec!r} is not supported here; use gzip, zstd or none")


def expand(data: bytes, codec: str | None) -> bytes:
    if not codec:
        return data
    if codec == "gzip":
        return gzip.decompress(data)
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"codec {codec!r} is not supported here; use gzip, zstd or none")


@dataclass
class ArrayInfo:
    """What an array's metadata says."""

    shape: list[int]
    chunk: list[int]
    dtype: str
    fill: float | int
    codec: str | None
    version: int
    separator: str = "/"
    #: chunks of a shard along each axis, or None
    shard: list[int] | None = None
    names: list[str] = field(default_factory=list)

    def key(self, idx: Sequence[int]) -> str:
        body = self.separator.join(map(str, idx))
        return f"c{self.separator}{body}" if self.version == 3 else body


def _fill(value, dtype: str):
    """A fill value as JSON has it: a number, null (undefined, so zero), a word for a float, or its bits in hex."""
    kind = np.dtype(dtype)
    if isinstance(value, str) and value.startswith("0x"):
        return np.frombuffer(int(value, 16).to_bytes(kind.itemsize, "little"), kind.newbyteorder("<"))[0].item()
    return np.asarray(float(value) if isinstance(value, str) else value or 0).astype(kind).item()


def _fill_json(value, dtype: str):
    v = np.asarray(value).astype(np.dtype(dtype)).item()
    if isinstance(v, float) and not math.isfinite(v):
        return "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
    return v


def array_info(path: str, nodes: Mapping[str, dict] | None = None, at: str = "") -> ArrayInfo | None:
    """Metadata of the array at ``path``/``at``, from ``nodes`` (see ``consolidated``) where they have it."""
    find = lambda name: (nodes or {}).get(f"{at}/{name}") or read_json("/".join(filter(None, (path, at, name))))
    v3 = find(V3_NODE)
    if v3 and v3.get("node_type") == "array":
        codecs, chunk, shard = v3["codecs"], v3["chunk_grid"]["configuration"]["chunk_shape"], None
        if codecs[0]["name"] == "sharding_indexed":
            conf = codecs[0]["configuration"]
            shard = [a // b for a, b in zip(chunk, conf["chunk_shape"], strict=True)]
            chunk, codecs = conf["chunk_shape"], conf["codecs"]
        endian = next((c.get("configuration", {}).get("endian", "little") for c in codecs if c["name"] == "bytes"), "little")
        dtype = np.dtype(v3["data_type"]).newbyteorder(">" if endian == "big" else "<").str
        codec = next((c["name"] for c in codecs if c["name"] != "bytes"), None)
        sep = v3.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
        return ArrayInfo(v3["shape"], chunk, dtype, _fill(v3.get("fill_value"), dtype), codec, 3, sep, shard, v3.get("dimension_names") or [])
    v2 = find(V2_ARRAY)
    if v2 is None:
        return None
    if v2.get("order", "C") != "C" or v2.get("filters"):
        raise ValueError("only row-major arrays without filters are supported")
    codec = (v2.get("compressor") or {}).get("id")
    return ArrayInfo(v2["shape"], v2["chunks"], v2["dtype"], _fill(v2.get("fill_value"), v2["dtype"]), codec, 2, v2.get("dimension_separator", "."))


def attributes(path: str) -> dict:
    """Attributes of a group or an array of either version; an error if there is none."""
    v3 = read_json(f"{path}/{V3_NODE}")
    if v3 is not None:
        return v3.get("attributes", {})
    v2 = read_json(f"{path}/{V2_ATTRS}")
    if v2 is None and read_file(f"{path}/{V2_GROUP}") is None and read_file(f"{path}/{V2_ARRAY}") is None:
        raise FileNotFoundError(f"no store at {path}")
    return v2 or {}


EMPTY = (1 << 64) - 1


def pack_shard(parts: Mapping[int, bytes], n: int) -> bytes:
    """Inner chunks one after another, then an index of (offset, length) pairs and its checksum."""
    index, body, at = np.full((n, 2), EMPTY, "<u8"), [], 0
    for i in sorted(parts):
        index[i] = at, len(parts[i])
        body.append(parts[i])
        at += len(parts[i])
    raw = index.tobytes()
    return b"".join(body) + raw + crc32c(raw).to_bytes(4, "little")


def read_shard(data: bytes, n: int) -> dict[int, bytes]:
    raw = data[-16 * n - 4 : -4]
    if crc32c(raw) != int.from_bytes(data[-4:], "little"):
        raise ValueError("the shard's index does not match its checksum")
    index = np.frombuffer(raw, "<u8").reshape(n, 2)
    return {i: data[int(a) : int(a) + int(m)] for i, (a, m) in enumerate(index) if a != EMPTY}


_CRC: list[int] = []


def crc32c(data: bytes) -> int:
    """Castagnoli checksum (reflected polynomial 0x82F63B78)."""
    if not _CRC:
        for i in range(256):
            for _ in range(8):
                i = i >> 1 ^ (0x82F63B78 if i & 1 else 0)
            _CRC.append(i)
    crc = 0xFFFFFFFF
    for b in data:
        crc = _CRC[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


class ChunkRange(InputPartition):
    """A run of an array's chunks, with the array's metadata, which the driver has read once."""

    def __init__(self, level: int, path: str, first: int, last: int, info: ArrayInfo | None = None):
        self.level, self.path, self.first, self.last, self.info = level, path, first, last, info


class StoreReader(DataSourceReader):
    """Options: path; levels (JSON list of [level, array path]); chunks_per_task; box (JSON list of [start, end] for each axis); absent (fill or skip)."""

    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.levels = json.loads(options.get("levels") or '[[0, ""]]')
        self.step = int(options.get("chunks_per_task", 64))
        self.image = options.get("image_id", "image")
        self.box = json.loads(options.get("box") or "null")
        self.skip = options.get("absent", "fill") == "skip"

    def _bounds(self, info: ArrayInfo) -> list[tuple[int, int]]:
        """First sample and end along each axis."""
        box = self.box or [[0, n] for n in info.shape]
        return [(max(a, 0), min(b, n)) for (a, b), n in zip(box, info.shape, strict=True)]

    def _outer(self, info: ArrayInfo) -> tuple[list[int], list[int]]:
        """First chunk (or shard) along each axis, and how many."""
        size = [c * s for c, s in zip(info.chunk, info.shard or [1] * len(info.chunk), strict=True)]
        first = [a // k for (a, _), k in zip(self._bounds(info), size, strict=True)]
        return first, [max(-(-b // k) - f, 0) if b > a else 0 for (a, b), k, f in zip(self._bounds(info), size, first, strict=True)]

    def _at(self, path: str) -> str:
        return f"{self.root}/{path}".rstrip("/") if self.root else path.rstrip("/")

    def partitions(self):
        out = []
        for level, path in self.levels:
            info = array_info(self._at(path)) or array_info(self.root, consolidated(self.root), path)
            if info is None:
                raise FileNotFoundError(f"no array at {self._at(path)}")
            n = math.prod(self._outer(info)[1])
            out += [ChunkRange(level, path, a, min(a + self.step, n), info) for a in range(0, n, self.step)]
        return out or [ChunkRange(-1, "", 0, 0)]

    def read(self, part: ChunkRange):
        if part.first == part.last:
            return
        path = self._at(part.path)
        info = part.info
        bounds, (first, grid), shard = self._bounds(info), self._outer(info), info.shard or [1] * len(info.chunk)
        for flat in range(part.first, part.last):
            outer = [f + int(i) for f, i in zip(first, np.unravel_index(flat, grid), strict=True)]
            data = read_file(f"{path}/{info.key(outer)}")
            inner = {} if data is None else read_shard(data, math.prod(shard)) if info.shard else {0: data}
            for i in range(math.prod(shard)):
                if self.skip and i not in inner:
                    continue
                at = np.unravel_index(i, shard)
                idx = [o * s + int(a) for o, s, a in zip(outer, shard, at, strict=True)]
                origin = [j * c for j, c in zip(idx, info.chunk, strict=True)]
                if any(o >= b or o + c <= a for o, c, (a, b) in zip(origin, info.chunk, bounds, strict=True)):
                    continue
                shape = [min(c, n - o) for c, n, o in zip(info.chunk, info.shape, origin, strict=True)]
                if i in inner:
                    x = native(expand(inner[i], info.codec), info.dtype, info.chunk)[tuple(map(slice, shape))]
                else:
                    x = native(np.full(shape, info.fill, np.dtype(info.dtype)).tobytes(), info.dtype, shape)
                row = dict(image_id=self.image, level=part.level, idx=idx, origin=origin, shape=list(x.shape), dtype=x.dtype.name, data=np.ascontiguousarray(x).tobytes())
                yield from pa.Table.from_pylist([row], ARROW).to_batches()


@dataclass
class Written(WriterCommitMessage):
    files: int


class StoreWriter(DataSourceArrowWriter):
    """Rows are chunks, or, with a shard shape, all chunks of a shard in one task (see ``write``).

    They come as Arrow batches and are taken one at a time; Spark's own rows would hold a whole batch as Python objects.
    """

    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.arrays = {int(k): v for k, v in json.loads(options["arrays"]).items()}
        self.nodes = json.loads(options["nodes"])
        self.codec = options.get("codec") or None

    def write(self, batches):
        files, open_shard, parts = 0, None, {}
        for r in each(batches):
            a = self.arrays[r["level"]]
            x = np.full(a["chunk"], _fill(a["fill"], a["dtype"]), np.dtype(a["dtype"]))
            own = native(r["data"], r["dtype"], r["shape"])
            x[tuple(slice(0, n) for n in own.shape)] = own
            raw = compress(x.tobytes(), self.codec)
            info = ArrayInfo(a["shape"], a["chunk"], a["dtype"], 0, self.codec, a["version"], "/", a["shard"])
            if not a["shard"]:
                write_file(f"{self.root}/{a['path']}/{info.key(r['idx'])}", raw)
                files += 1
                continue
            outer = tuple(i // s for i, s in zip(r["idx"], a["shard"], strict=True))
            if open_shard and open_shard[:2] != (r["level"], outer):
                files += self._close(open_shard, parts)
                parts = {}
            open_shard = (r["level"], outer, info, a)
            parts[int(np.ravel_multi_index([i % s for i, s in zip(r["idx"], a["shard"], strict=True)], a["shard"]))] = raw
        if open_shard:
            files += self._close(open_shard, parts)
        return Written(files)

    def _close(self, shard, parts) -> int:
        _, outer, info, a = shard
        write_file(f"{self.root}/{a['path']}/{info.key(outer)}", pack_shard(parts, math.prod(a["shard"])))
        return 1

    def commit(self, messages):
        for path, body in self.nodes.items():
            write_file(f"{self.root}/{path}", json.dumps(body, indent=2).encode())

    def abort(self, messages):
        """Chunk files without metadata are no store; a second write replaces them."""


class ChunkStore(DataSource):
    @classmethod
    def name(cls):
        return "chunk_store"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return StoreReader(self.options)

    def writer(self, schema, overwrite):
        return StoreWriter(self.options)


def _register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ChunkStore)


def read_arrays(spark: SparkSession, path: str, arrays: Sequence[tuple[int, str]], image_id: str = "image", chunks_per_task: int = 64, box: Sequence | None = None, absent: str = "fill") -> DataFrame:
    """Chunks of arrays of a store, with their level; with a box ((start, end) of each axis) only those that meet it."""
    _register(spark)
    return spark.read.format("chunk_store").options(path=path, levels=json.dumps([list(a) for a in arrays]), image_id=image_id, chunks_per_task=chunks_per_task, box=json.dumps(box), absent=absent).load()


def chunked(spark: SparkSession, path: str, at: str, meta: ImageMeta, level: int = 0, chunks_per_task: int = 64, absent: str = "fill") -> Chunked:
    """An array of a store, which can be narrowed to a box before it is read."""
    read = lambda box=None: read_arrays(spark, path, [(level, at)], meta.name, chunks_per_task, box, absent)
    return Chunked(read(), meta, path, lambda box: read([list(box.get(d, (0, meta.shape[d]))) for d in meta.dims]))


def read_array(spark: SparkSession, path: str, dims: Sequence[str] | None = None, absent: str = "fill") -> Chunked:
    """A single array, not in a group."""
    info = array_info(path)
    if info is None:
        raise FileNotFoundError(f"no array at {path}")
    dims = tuple(dims or info.names or levels.default_dims(len(info.shape)))
    meta = ImageMeta(dims, dict(zip(dims, info.shape, strict=True)), chunk=dict(zip(dims, info.chunk, strict=True)), dtype=np.dtype(info.dtype).name, fill=info.fill)
    return chunked(spark, path, "", meta, absent=absent)


def array_node(meta: ImageMeta, version: int, codec: str | None, shard: Mapping[str, int] | None) -> tuple[str, dict]:
    """Name and JSON of an array's metadata."""
    shape, chunk = [meta.shape[d] for d in meta.dims], [min(meta.chunk[d], meta.shape[d]) or 1 for d in meta.dims]
    dtype = np.dtype(meta.dtype)
    if version == 2:
        return V2_ARRAY, {"zarr_format": 2, "shape": shape, "chunks": chunk, "dtype": dtype.newbyteorder("<").str, "compressor": {"id": codec, "level": 3} if codec else None, "fill_value": _fill_json(meta.fill, meta.dtype), "order": "C", "filters": None, "dimension_separator": "/"}
    codecs: list[dict] = [{"name": "bytes", "configuration": {"endian": "little"}} if dtype.itemsize > 1 else {"name": "bytes"}]
    if codec:
        codecs.append({"name": codec, "configuration": {"level": 3} | ({"checksum": False} if codec == "zstd" else {})})
    outer = chunk
    if shard:
        outer = [c * shard[d] for c, d in zip(chunk, meta.dims, strict=True)]
        codecs = [{"name": "sharding_indexed", "configuration": {"chunk_shape": chunk, "codecs": codecs, "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": "end"}}]
    return V3_NODE, {
        "zarr_format": 3,
        "node_type": "array",
        "shape": shape,
        "data_type": dtype.name,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": outer}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "fill_value": _fill_json(meta.fill, meta.dtype),
        "codecs": codecs,
        "dimension_names": list(meta.dims),
        "attributes": {},
    }


def write_arrays(chunks: DataFrame, path: str, arrays: Mapping[int, tuple[str, ImageMeta]], nodes: Mapping[str, dict], version: int, codec: str | None = None, per_shard: Mapping[str, int] | None = None) -> None:
    """Write levels of chunks and, when all are there, the metadata nodes (path in the store to JSON); older arrays in their place go first."""
    from pyspark.sql import functions as F

    _register(chunks.sparkSession)
    if per_shard and version != 3:
        raise ValueError("sharding needs array format 3")
    spec, nodes = {}, dict(nodes)
    for level, (at, meta) in arrays.items():
        name, body = array_node(meta, version, codec, per_shard)
        nodes[f"{at}/{name}".lstrip("/")] = body
        remove(f"{path}/{at}".rstrip("/"))
        spec[level] = dict(path=at, shape=body["shape"], chunk=[min(meta.chunk[d], meta.shape[d]) or 1 for d in meta.dims], dtype=np.dtype(meta.dtype).newbyteorder("<").str, fill=body["fill_value"], version=version, shard=[per_shard.get(d, 1) for d in meta.dims] if per_shard else None)
    if per_shard:  # all chunks of a shard in one task, one shard after another
        dims = next(iter(arrays.values()))[1].dims
        shard = F.array(*[F.floor(F.get("idx", F.lit(i)) / per_shard.get(d, 1)) for i, d in enumerate(dims)])
        chunks = chunks.withColumn("__s", shard).repartition("level", "__s").sortWithinPartitions("level", "__s").drop("__s")
    chunks.write.format("chunk_store").mode("append").options(path=path, arrays=json.dumps(spec), nodes=json.dumps(nodes), codec=codec or "").save()
