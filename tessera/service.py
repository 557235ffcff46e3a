"""Whole conversions: read, build a pyramid, write a store, inspect, check and rewrite one; and a command line."""

from __future__ import annotations

import argparse
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import METHOD_ALIASES, DIMS, ImageMeta, Method, PyramidMeta, SPACE_UNITS, TIME_UNITS
from .operators import chunks as C
from .operators import metadata as M
from .operators import plate as P
from .operators import pyramid as Y
from .operators import validate as V
from .plans import levels
from .sources import backends, nifti, store
from .sources.tables import Image


@dataclass
class Options:
    """What a conversion may be told; None means: as the input has it."""

    dims: Sequence[str] | None = None
    scale: Mapping[str, float] = field(default_factory=dict)
    translation: Mapping[str, float] = field(default_factory=dict)
    units: Mapping[str, str] = field(default_factory=dict)
    name: str | None = None
    version: str = "0.4"
    rfcs: Sequence[int] = ()
    method: str | None = None
    #: least length of automatic levels, or absolute factors; None: 128, or the levels that a store has
    factors: int | Sequence | None = None
    chunk: int | Mapping[str, int] | None = None
    per_shard: int | Mapping[str, int] | None = None
    codec: str | None = "zstd"
    level: int = 0
    backend: str | None = None
    orientations: Mapping[str, str] = field(default_factory=dict)


@dataclass
class Result:
    success: bool
    path: str
    info: dict = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)


def check_options(o: Options) -> list[str]:
    """Problems of the options, in words."""
    out = [f"axis {d} is unknown" for d in o.dims or () if d not in DIMS]
    out += [f"unit {u} of {d} is unknown" for d, u in o.units.items() if u not in SPACE_UNITS and u not in TIME_UNITS]
    if o.method and o.method.upper() not in METHOD_ALIASES and o.method.lower() not in {m.value for m in Method}:
        out.append(f"method {o.method} is unknown")
    if o.version not in ("0.4", "0.5"):
        out.append(f"version {o.version} cannot be written")
    if o.per_shard and o.version != "0.5":
        out.append("sharding needs version 0.5")
    if o.codec not in (None, "gzip", "zstd"):
        out.append(f"codec {o.codec} cannot be written")
    return out


def with_metadata(meta: ImageMeta, o: Options) -> ImageMeta:
    """Overrides of a conversion in place of what the input says."""
    dims = tuple(o.dims or meta.dims)
    if len(dims) != len(meta.dims):
        raise ValueError(f"{len(dims)} dims for {len(meta.dims)} axes")
    to = dict(zip(meta.dims, dims, strict=True))
    moved = lambda m: {to[k]: v for k, v in m.items() if k in to}
    return ImageMeta(dims, moved(meta.shape), moved(meta.scale) | dict(o.scale), moved(meta.translation) | dict(o.translation), moved(meta.chunk), meta.dtype, o.name or meta.name, moved(meta.units) | dict(o.units), moved(meta.orientations) | dict(o.orientations), meta.fill)


def read_pyramid(spark: SparkSession, path: str, check: bool = False, chunks_per_task: int = 64) -> tuple[list[C.Chunked], PyramidMeta]:
    """Levels of a store (versions 0.1 to 0.5) and their metadata; samples stay unread."""
    doc = store.attributes(path)
    body, channels, version = M.read_document(doc)
    if check:
        bad = problems(spark, doc, version)
        if bad:
            raise ValueError(f"{path}: {bad}")
    nodes = store.consolidated(path)
    infos = [store.array_info(path, nodes, d["path"]) for d in body["datasets"]]
    if None in infos:
        raise FileNotFoundError(f"an array of {path} is missing")
    metas = M.image_metas(body, infos)
    images = [store.chunked(spark, path, d["path"], m, i, chunks_per_task) for i, (d, m) in enumerate(zip(body["datasets"], metas, strict=True))]
    first = metas[0]
    factors = [{d: max(1, round(first.shape[d] / max(m.shape[d], 1))) for d in first.spatial} for m in metas[1:]]
    method = next((m for m in Method if m.value == body.get("type")), Method.GAUSSIAN)
    return images, PyramidMeta(metas, factors, method, channels, first.name, version)


def problems(spark: SparkSession, doc: Mapping, version: str, strict: bool = False) -> list[str]:
    """Names of the rules that a document breaks."""
    df = spark.createDataFrame([("doc", json.dumps(doc))], "id string, doc string")
    out = [r.rule for r in V.validate(df, version=version, strict=strict).collect()]
    return out + [r.rule for r in V.validate(df, model="orientation").collect()]


@dataclass
class Layout:
    """Arrays, metadata nodes and format of a store that is to be written."""

    arrays: dict[int, tuple[str, ImageMeta]]
    nodes: dict[str, dict]
    fmt: int
    codec: str | None
    shard: dict[str, int] | None

    def write(self, chunks: DataFrame, path: str, levels: Sequence[int] | None = None, last: bool = True) -> None:
        """Chunks of some levels (None: all); with the last ones the nodes of the groups."""
        own = {i: a for i, a in self.arrays.items() if levels is None or i in levels}
        store.write_arrays(chunks, path, own, self.nodes if last else {}, self.fmt, self.codec, self.shard)


def layout(pyramid: PyramidMeta, version: str = "0.4", codec: str | None = "zstd", per_shard=None, rfcs: Sequence[int] = ()) -> Layout:
    if version not in ("0.4", "0.5"):
        raise ValueError(f"unsupported version {version}")
    fmt = 2 if version == "0.4" else 3
    if per_shard and fmt == 2:
        raise ValueError("sharding needs version 0.5")
    doc = M.write_document(pyramid, version, rfcs)
    first = pyramid.images[0]
    shard = None
    if per_shard:
        full = levels.shard_shape(first.dims, {d: 1 for d in first.dims}, per_shard)
        shard = {d: full[d] for d in first.dims}
    nodes: dict[str, dict] = {}
    if fmt == 2:
        nodes |= {store.V2_GROUP: {"zarr_format": 2}, store.V2_ATTRS: doc}
    else:
        nodes[store.V3_NODE] = {"zarr_format": 3, "node_type": "group", "attributes": doc}
    arrays = {}
    for i, m in enumerate(pyramid.images):
        arrays[i] = (f"scale{i}/{pyramid.name}", m)
        names = {"_ARRAY_DIMENSIONS": list(m.dims)}
        if fmt == 2:
            nodes |= {f"scale{i}/{store.V2_GROUP}": {"zarr_format": 2}, f"scale{i}/{pyramid.name}/{store.V2_ATTRS}": names}
        else:
            nodes[f"scale{i}/{store.V3_NODE}"] = {"zarr_format": 3, "node_type": "group", "attributes": {}}
    every = {f"{at}/{name}": body for at, m in arrays.values() for name, body in [store.array_node(m, fmt, codec, shard)]}
    if fmt == 2:
        nodes[store.V2_ALL] = {"zarr_consolidated_format": 1, "metadata": nodes | every}
    else:
        inside = {k.removesuffix(f"/{store.V3_NODE}"): v for k, v in (nodes | every).items() if k != store.V3_NODE}
        nodes[store.V3_NODE]["consolidated_metadata"] = {"kind": "inline", "must_understand": False, "metadata": inside}
    return Layout(arrays, nodes, fmt, codec, shard)


def _make_way(path: str, overwrite: bool, images: Sequence[C.Chunked]) -> None:
    """What is at the path goes, unless it may not, or is what the images are read from."""
    if path.rstrip("/") in [(im.source or "").rstrip("/") for im in images]:
        raise ValueError(f"{path} is read and cannot be overwritten")
    if not overwrite and any(store.read_file(f"{path}/{n}") is not None for n in (store.V2_GROUP, store.V2_ATTRS, store.V3_NODE)):
        raise FileExistsError(path)
    store.remove(path)


def write_pyramid(images: Sequence[C.Chunked], pyramid: PyramidMeta, path: str, version: str = "0.4", codec: str | None = "zstd", per_shard=None, rfcs: Sequence[int] = (), overwrite: bool = True) -> None:
    """Store with all levels, which are at hand: one write job for all chunks, then the metadata nodes."""
    plan = layout(pyramid, version, codec, per_shard, rfcs)
    _make_way(path, overwrite, images)
    all_chunks = None
    for i, im in enumerate(images):
        own = im.chunks.withColumn("level", F.lit(i))
        all_chunks = own if all_chunks is None else all_chunks.unionByName(own)
    plan.write(all_chunks, path)


def build_store(image: C.Chunked, path: str, factors=128, method: Method | str | None = None, version: str = "0.4", codec: str | None = "zstd", per_shard=None, rfcs: Sequence[int] = (), overwrite: bool = True, channels=()) -> PyramidMeta:
    """Build a pyramid in its store, level by level: each is written, read back, and the next is made of it.

    So every level is computed once, from one read of the level before, whatever the method needs of it.
    """
    images, pyramid = chunk_pyramid(image, factors, method)  # a plan; only its metadata is used below the first level
    pyramid.name, pyramid.channels = image.meta.name, list(channels)
    plan = layout(pyramid, version, codec, per_shard, rfcs)
    _make_way(path, overwrite, [image])
    now = images[0]
    for i, step in enumerate([None, *levels.steps(pyramid.factors)]):
        if step is not None:
            now = _next_level(store.chunked(image.chunks.sparkSession, path, plan.arrays[i - 1][0], pyramid.images[i - 1], i - 1), step, pyramid.method, i)
        plan.write(now.chunks.withColumn("level", F.lit(i)), path, [i], last=i == len(pyramid.factors))
    return pyramid


def _next_level(image: C.Chunked, step: Mapping[str, int], kind: Method, level: int) -> C.Chunked:
    if kind in C.CHUNK_METHODS:
        return C.CHUNK_METHODS[kind](image, step, level)
    # votes need all samples of a window with their labels; the voxel layout has them
    from .operators.downsample import label_vote

    small = label_vote(C.to_voxels(image), step)
    size = {d: max(image.meta.chunk[d] // step.get(d, 1), 1) for d in small.meta.dims}
    return C.from_voxels(small, size, image.meta.dtype, level=level)


def chunk_pyramid(image: C.Chunked, factors=128, method: Method | str | None = None) -> tuple[list[C.Chunked], PyramidMeta]:
    """Pyramid in chunk layout, as a plan in which each level is made of the one before; see ``build_store`` for large images.

    Chunks are made whole bins of every level first, so bins never cross them.
    """
    kind = Method.of(method)
    spec = levels.auto_factors(image.meta.shape, image.meta.chunk, factors) if isinstance(factors, int) else levels.level_factors(image.meta.dims, factors)
    whole = levels.aligned_chunk(image.meta.chunk, spec)
    first = image if whole == image.meta.chunk else C.rechunk(image, whole)
    out = [first]
    for i, step in enumerate(levels.steps(spec)):
        out.append(_next_level(out[-1], step, kind, i + 1))
    return out, PyramidMeta([c.meta for c in out], spec, kind, name=image.meta.name)


def backend(spark: SparkSession, path: str) -> str:
    """Reader of an input: an array or a pyramid by its metadata, anything else by its name."""
    if store.array_info(path) is not None:
        return "array_store"
    if _is_store(path):
        return "pyramid_store"
    return spark.range(1).select(backends.detect(F.lit(path.rstrip("/"))).alias("b")).first().b


def open_input(spark: SparkSession, path: str | Sequence[str], o: Options | None = None) -> C.Chunked:
    """An input of any readable kind as chunks; several files become planes along z."""
    o = o or Options()
    paths = [path] if isinstance(path, str) else list(path)
    if len(paths) > 1:
        parts = [open_input(spark, p, replace(o, dims=None)) for p in paths]
        m = parts[0].meta
        odd = [p for p, im in zip(paths, parts, strict=True) if (im.meta.dims, im.meta.shape, im.meta.dtype, im.meta.chunk) != (m.dims, m.shape, m.dtype, m.chunk)]
        if odd:
            raise ValueError(f"planes differ in axes, shape, chunks or type from {paths[0]}: {odd[:5]}")
        dims = ("z", *m.dims)
        meta = replace(m, dims=dims, shape={"z": len(parts)} | m.shape, chunk={"z": 1} | m.chunk, scale={"z": 1.0} | m.scale, translation={"z": 0.0} | m.translation)
        if all(store.array_info(p) is not None for p in paths):  # one read of all arrays; the number of a file is its level
            df = store.read_arrays(spark, "", list(enumerate(paths)), m.name)
        else:
            df = None
            for i, p in enumerate(parts):
                own = p.chunks.withColumn("level", F.lit(i))
                df = own if df is None else df.unionByName(own)
        z = F.col("level")
        df = df.withColumns({"idx": F.concat(F.array(z.cast("int")), "idx"), "origin": F.concat(F.array(z.cast("long")), "origin"), "shape": F.concat(F.array(F.lit(1)), "shape")})
        return C.Chunked(df.withColumn("level", F.lit(0)), with_metadata(meta, o))
    kind = o.backend or backend(spark, paths[0])
    if kind == "array_store":
        image = store.read_array(spark, paths[0])
    elif kind == "pyramid_store":
        images, _ = read_pyramid(spark, paths[0])
        image = images[o.level]
    elif kind == "nibabel":
        image = nifti.read(spark, paths[0])
    else:
        raise ValueError(f"{paths[0]} needs a decoder ({kind}) that is not at hand here")
    return C.Chunked(image.chunks, with_metadata(image.meta, o), image.source)


def convert(spark: SparkSession, path: str | Sequence[str], out: str, o: Options | None = None) -> Result:
    """Read, build a pyramid, write it, and report on the store written."""
    o = o or Options()
    bad = check_options(o)
    paths = [path] if isinstance(path, str) else list(path)
    if out.rstrip("/") in [p.rstrip("/") for p in paths]:
        bad.append("input and output are the same")
    if bad:
        return Result(False, out, errors=bad)
    channels = []
    if len(paths) == 1 and store.array_info(paths[0]) is None and _is_store(paths[0]):
        images, pyramid = read_pyramid(spark, paths[0])
        if o.method is None and o.factors is None and o.chunk is None and o.level == 0:  # its levels are passed through
            base = images[0].meta
            first = with_metadata(base, o)
            ratio = lambda a, b: {d: a[d] / b[d] for d in a if b.get(d)}
            grown = ratio(first.scale, base.scale)
            for im in images:
                own = with_metadata(im.meta, replace(o, scale={}, translation={}))
                moved = {d: first.translation[d] + (v - base.translation.get(d, 0.0)) * grown.get(d, 1.0) for d, v in own.translation.items()}
                im.meta = replace(own, scale={d: v * grown.get(d, 1.0) for d, v in own.scale.items()}, translation=moved)
            pyramid.images, pyramid.name = [im.meta for im in images], first.name
            write_pyramid(images, pyramid, out, o.version, o.codec, o.per_shard, o.rfcs)
            return Result(True, out, info=inspect(spark, out))
        channels = pyramid.channels
    image = open_input(spark, paths if len(paths) > 1 else paths[0], o)
    if o.chunk is not None:
        image = C.rechunk(image, levels.chunk_lengths(image.meta.dims, o.chunk))
    build_store(image, out, 128 if o.factors is None else o.factors, o.method, o.version, o.codec, o.per_shard, o.rfcs, channels=channels)
    return Result(True, out, info=inspect(spark, out))


def _is_store(path: str) -> bool:
    try:
        doc = store.attributes(path)
    except FileNotFoundError:
        return False
    return bool(doc.get("ome", doc).get("multiscales"))


def to_itk(image: C.Chunked, most: int = 1 << 30) -> dict:
    """The toolkit's image structure with its samples, which are gathered on the driver (at most ``most`` bytes)."""
    dims = levels.transposed(image.meta.dims, "zyx_last")
    dims = (*(d for d in dims if d != "c"), *(d for d in dims if d == "c"))
    turned = image if dims == image.meta.dims else C.transpose(image, dims)
    return M.to_itk(image.meta) | {"data": C.to_array(turned, most)}


def from_itk(spark: SparkSession, structure: Mapping, orient: bool = True) -> C.Chunked:
    """Chunks of the toolkit's image structure."""
    x = structure["data"]
    meta = M.from_itk(structure["spacing"], structure["origin"], structure["size"], structure.get("components", 1), x.dtype.name, orient)
    return C.from_array(spark, x, replace(meta, chunk=levels.chunk_lengths(meta.dims)))


def progress(spark: SparkSession) -> list[dict]:
    """Stages that run now: number, tasks, tasks done and running."""
    tracker = spark.sparkContext.statusTracker()
    infos = [tracker.getStageInfo(i) for i in tracker.getActiveStageIds()]
    return [{"stage": i.stageId, "name": i.name, "tasks": i.numTasks, "done": i.numCompletedTasks, "running": i.numActiveTasks, "failed": i.numFailedTasks} for i in infos if i]


def inspect(spark: SparkSession, path: str) -> dict:
    """Size, files, version, axes, shapes, chunks and method of a store."""
    images, pyramid = read_pyramid(spark, path)
    size = backends.store_size(spark, path).first()
    first = pyramid.images[0]
    return {
        "path": path,
        "files": size["files"],
        "bytes": size["bytes"],
        "version": pyramid.version,
        "method": pyramid.method.value,
        "dims": list(first.dims),
        "dtype": first.dtype,
        "levels": len(images),
        "shapes": [dict(m.shape) for m in pyramid.images],
        "chunks": [dict(m.chunk) for m in pyramid.images],
        "scale": dict(first.scale),
        "translation": dict(first.translation),
        "units": dict(first.units),
        "channels": len(pyramid.channels),
    }


def validate_store(spark: SparkSession, path: str, strict: bool = False) -> dict:
    """Errors (rules broken, arrays missing) and warnings of a store."""
    try:
        doc = store.attributes(path)
        body, _, version = M.read_document(doc)
    except (FileNotFoundError, ValueError) as e:
        return {"valid": False, "errors": [str(e)], "warnings": []}
    errors = problems(spark, doc, version, strict)
    errors += [f"no array at {d['path']}" for d in body.get("datasets", []) if store.array_info(f"{path}/{d['path']}") is None]
    warnings = [f"axis {a.name} has no unit" for a in M.read_axes(body) if a.type != "channel" and not a.unit]
    return {"valid": not errors, "errors": errors, "warnings": warnings}


def optimize(spark: SparkSession, path: str, out: str, chunk=None, codec: str | None = "zstd", per_shard=None, version: str | None = None) -> Result:
    """Rewrite a store with other chunks, codec or sharding; every level is rechunked."""
    images, pyramid = read_pyramid(spark, path)
    if chunk is not None:
        images = [C.rechunk(im, levels.chunk_lengths(im.meta.dims, chunk)) for im in images]
        pyramid.images = [im.meta for im in images]
    write_pyramid(images, pyramid, out, version or ("0.5" if per_shard else pyramid.version), codec, per_shard)
    return Result(True, out, info=inspect(spark, out))


def write_plate(meta, path: str) -> None:
    """Plate structure without fields: the plate's document and an empty group for each well."""
    doc = P.plate_document(meta)
    if meta.version == "0.5":
        store.write_file(f"{path}/{store.V3_NODE}", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": doc}).encode())
    else:
        store.write_file(f"{path}/{store.V2_GROUP}", b'{"zarr_format": 2}')
        store.write_file(f"{path}/{store.V2_ATTRS}", json.dumps(doc).encode())


def read_plate(path: str):
    return P.read_plate_document(store.attributes(path))


def write_field(images: Sequence[C.Chunked], pyramid: PyramidMeta, path: str, row: str, column: str, index: int = 0, acquisition: int = 0, codec: str | None = "zstd") -> None:
    """Write a field of a plate and add it to its well's list, once; a well has one writer at a time (streams: ``streaming.ingest``)."""
    plate = read_plate(path)
    if row not in plate.rows or column not in plate.columns or f"{row}/{column}" not in [w[0] for w in plate.wells]:
        raise ValueError(f"the plate has no well {row}/{column}")
    well = f"{path}/{row}/{column}"
    new = plate.version == "0.5"
    try:
        doc = store.attributes(well)
    except FileNotFoundError:
        doc = {}
    body = (doc.get("ome") or doc).get("well") or {"images": []}
    entry = {"path": str(index), "acquisition": acquisition}
    same = [i for i in body["images"] if i.get("path") == entry["path"]]
    if same and same[0].get("acquisition") not in (None, acquisition):
        raise ValueError(f"field {index} of {row}/{column} belongs to acquisition {same[0]['acquisition']}")
    if not same:
        body["images"].append(entry)
    write_pyramid(images, pyramid, f"{well}/{index}", plate.version, codec)
    if new:
        store.write_file(f"{well}/{store.V3_NODE}", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"version": "0.5", "well": body}}}).encode())
    else:
        store.write_file(f"{well}/{store.V2_GROUP}", b'{"zarr_format": 2}')
        store.write_file(f"{well}/{store.V2_ATTRS}", json.dumps({"well": body | {"version": plate.version}}).encode())


class LruCache:
    """A bounded mapping that forgets what was used least recently."""

    def __init__(self, most: int):
        from collections import OrderedDict

        self.most, self.held = most, OrderedDict()

    def get(self, key, make):
        if key in self.held:
            self.held.move_to_end(key)
        else:
            self.held[key] = make()
            while len(self.held) > self.most:
                self.held.popitem(last=False)
        return self.held[key]


class Plate:
    """Walks a plate's store; documents of wells and images are cached within bounds."""

    def __init__(self, spark: SparkSession, path: str, wells: int = 500, images: int = 100):
        self.spark, self.path, self.meta = spark, path, read_plate(path)
        self._wells, self._images = LruCache(wells), LruCache(images)

    def well(self, row: str, column: str) -> dict | None:
        """The well's document, or None where the plate has no such well."""
        at = f"{row}/{column}"
        if at not in [w[0] for w in self.meta.wells]:
            return None
        return self._wells.get(at, lambda: (lambda d: (d.get("ome") or d)["well"])(store.attributes(f"{self.path}/{at}")))

    def well_by_index(self, row: int, column: int) -> dict | None:
        if not (0 <= row < len(self.meta.rows) and 0 <= column < len(self.meta.columns)):
            return None
        return self.well(self.meta.rows[row], self.meta.columns[column])

    def image(self, row: str, column: str, index: int = 0, acquisition: int | None = None):
        """Levels and metadata of a well's ``index``-th field, of an acquisition where one is given."""
        well = self.well(row, column)
        fields = [i for i in (well or {}).get("images", []) if acquisition is None or i.get("acquisition") == acquisition]
        if not 0 <= index < len(fields):
            return None
        at = f"{self.path}/{row}/{column}/{fields[index]['path']}"
        return self._images.get(at, lambda: read_pyramid(self.spark, at))


def from_dataframe(voxels: DataFrame, dims: Sequence[str], chunk=None, dtype: str = "int64", **meta) -> C.Chunked:
    """Chunks of a table of samples."""
    from .sources.tables import from_table

    image = from_table(voxels, dims, dtype=dtype, **meta)
    return C.from_voxels(Image(image.voxels, image.meta), levels.chunk_lengths(dims, chunk), dtype)


def _pairs(values: Sequence[str] | None, kind=float) -> dict:
    """['x', '0.5', 'y', '1'] as a mapping."""
    values = list(values or ())
    if len(values) % 2:
        raise SystemExit("values come in pairs: axis value")
    return {k.lower(): kind(v) for k, v in zip(values[::2], values[1::2], strict=True)}


def main(argv: Sequence[str] | None = None) -> int:
    a = argparse.ArgumentParser(description="Convert images to chunked pyramids with Spark.")
    a.add_argument("input", nargs="+")
    a.add_argument("-o", "--output")
    a.add_argument("--dims", nargs="+")
    a.add_argument("--units", nargs="+")
    a.add_argument("--scale", nargs="+")
    a.add_argument("--translation", nargs="+")
    a.add_argument("--name")
    a.add_argument("--output-scale", type=int, default=0)
    a.add_argument("--version", default="0.4", dest="format_version")
    a.add_argument("--rfc", type=int, nargs="+", default=[])
    a.add_argument("--chunks", type=int)
    a.add_argument("--chunks-per-shard", type=int)
    a.add_argument("--method")
    a.add_argument("--codec", default="zstd")
    a.add_argument("--memory-target", default="1GB")
    a.add_argument("--input-backend", choices=("array_store", "pyramid_store", "nibabel"), help="how the input is read; by default by its name")
    a.add_argument("--cache-dir", help="shared folder for intermediate tables")
    a.add_argument("--local-cluster", action="store_true", help="run on this machine's cores")
    a.add_argument("--quiet", action="store_true")
    args = a.parse_args(argv)
    builder = SparkSession.builder.appName("tessera").config("spark.sql.files.maxPartitionBytes", levels.parse_bytes(args.memory_target) // 8)
    if args.local_cluster:
        builder = builder.master("local[*]")
    if args.cache_dir:
        builder = builder.config("spark.checkpoint.dir", args.cache_dir)
    spark = builder.getOrCreate()
    o = Options(args.dims, _pairs(args.scale), _pairs(args.translation), _pairs(args.units, str.lower), args.name, args.format_version, args.rfc, args.method, chunk=args.chunks, per_shard=args.chunks_per_shard, codec=args.codec or None, level=args.output_scale, backend=args.input_backend)
    if not args.output:
        image = open_input(spark, args.input if len(args.input) > 1 else args.input[0], o)
        print(image.meta)
        return 0
    got = convert(spark, args.input if len(args.input) > 1 else args.input[0], args.output, o)
    if not args.quiet:
        print(json.dumps(got.info, indent=2) if got.success else "\n".join(got.errors))
    return 0 if got.success else 1


if __name__ == "__main__":
    raise SystemExit(main())
