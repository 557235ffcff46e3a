"""Queries that go through stores, files and the conversion service, and come back as voxels or summaries."""

from __future__ import annotations

import json
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import service
from .model import ImageMeta, PlateMeta
from .operators import chunks as C
from .operators import downsample as D
from .operators import pyramid as Y
from .plans import levels
from .queries import E2, SQL, Z3, Z3S, _R4, _SIZE2, _SIZE3, _STORE_SQL, _chunked, _gauss, _mode_weights, _register, _vote_sql, query, scratch
from .sources import backends, nifti, store
from .sources import tables as T


def _voxels(image: C.Chunked) -> DataFrame:
    return C.to_voxels(image).voxels


def _put(image: C.Chunked, path: str, fmt: int = 2, codec: str | None = "zstd", per_shard=None, chunks: DataFrame | None = None) -> str:
    """A single array as a store."""
    store.write_arrays(image.chunks if chunks is None else chunks, path, {0: ("", image.meta)}, {}, fmt, codec, per_shard)
    return path


# Discrete Gaussian -------------------------------------------------------------------


def _discrete(source: str, dims: list[str], step: dict[str, int], size: dict[str, str], out: str) -> str:
    """As ``_gauss``, with the other kernel, from its power series: I_n(v) = sum (v/2)^(2m+n) / (m! (m+n)!)."""
    import math

    def taps(k: int):
        v = (k * k - 1) / (8 * math.log(2))
        bessel = lambda n: math.exp(-v) * math.fsum((v / 2) ** (2 * m + n) / math.factorial(m) / math.factorial(m + n) for m in range(60))
        w = [bessel(0), bessel(1)]
        while w[0] + 2 * sum(w[1:]) < 0.99:
            w.append(bessel(len(w)))
        total = w[0] + 2 * sum(w[1:])
        return [(o, w[abs(o)] / total) for o in range(1 - len(w), len(w))]

    sql = _gauss(source, dims, step, size, out)
    for d, k in step.items():
        old = ", ".join(f"({o}, CAST({w!r} AS DOUBLE))" for o, w in levels.kernel(k, 4.0))
        sql = sql.replace(f"{out}_{d}_w(o, w) AS (VALUES {old})", f"{out}_{d}_w(o, w) AS (VALUES " + ", ".join(f"({o}, CAST({w!r} AS DOUBLE))" for o, w in taps(k)) + ")")
    return sql


_D2 = f"WITH {E2}, {_discrete('e2', ['y', 'x'], {'y': 2, 'x': 2}, _SIZE2, 'g')} SELECT y, x, {_R4} FROM g"
_register("discrete_gaussian_2d", lambda s, d: D.discrete_gaussian(T.embeddings(s, d), 2, 4).voxels, _D2)
_register("discrete_gaussian_k4", lambda s, d: D.discrete_gaussian(T.embeddings(s, d), 4, 4).voxels, f"WITH {E2}, {_discrete('e2', ['y', 'x'], {'y': 4, 'x': 4}, _SIZE2, 'g')} SELECT y, x, {_R4} FROM g")
_register("discrete_gaussian_3d", lambda s, d: D.discrete_gaussian(T.lineitem(s, d), {"z": 2, "y": 3, "x": 2}, 4).voxels, f"WITH {Z3}, {_discrete('z3', ['z', 'y', 'x'], {'z': 2, 'y': 3, 'x': 2}, _SIZE3, 'g')} SELECT z, y, x, {_R4} FROM g")
_register("chunk_discrete_gaussian", lambda s, d: _voxels(C.discrete_gaussian(_chunked(s, d), {"y": 2, "x": 2})).withColumn("value", F.round("value", 4)), _D2)

# Absent chunks -----------------------------------------------------------------------

_SPARSE = "x // 16 <> 1 AND (y // 16 <> 2 OR z // 2 = 0)"
_Z3H = f"""{Z3S}, z3 AS (SELECT a AS z, b AS y, c AS x, coalesce(value, FILL) AS value
       FROM range(7) t1(a), range(64) t2(b), range(64) t3(c) LEFT JOIN (SELECT * FROM z3s WHERE {_SPARSE}) ON z = a AND y = b AND x = c)"""


def _sparse(s: SparkSession, d: str, fill: int = 0) -> C.Chunked:
    """Supplied quantities without the samples of whole chunks, which are not in the table."""
    im = T.lineitem(s, d, fill=False)
    rows = im.voxels.where((F.floor(F.col("x") / 16) != 1) & ((F.floor(F.col("y") / 16) != 2) | (F.floor(F.col("z") / 2) == 0)))
    return C.from_voxels(T.Image(rows, replace(im.meta, fill=fill)), {"z": 2, "y": 16, "x": 16}, "int64", dense=False)


def _sparse_store(s, d, fmt, per_shard) -> DataFrame:
    im = _sparse(s, d, 7)
    return _voxels(store.read_array(s, _put(im, scratch(s, "sparse"), fmt, "gzip", per_shard), im.meta.dims))


_SPARSE_SQL = f"WITH {_Z3H.replace('FILL', '7')} SELECT z, y, x, value FROM z3"
_register("store_sparse_v2", lambda s, d: _sparse_store(s, d, 2, None), _SPARSE_SQL)
_register("store_sparse_v3_sharded", lambda s, d: _sparse_store(s, d, 3, {"z": 2, "y": 2, "x": 2}), _SPARSE_SQL)
_register("chunk_densify", lambda s, d: _voxels(C.densify(_sparse(s, d, 7))), _SPARSE_SQL)
_register("rechunk_sparse", lambda s, d: _voxels(C.densify(C.rechunk(_sparse(s, d, 7), {"z": 3, "y": 10, "x": 24}))), _SPARSE_SQL)
_Z0 = _Z3H.replace("FILL", "0")
_K2 = {"z": 2, "y": 2, "x": 2}
_register("chunk_gaussian_sparse", lambda s, d: _voxels(C.densify(C.gaussian(_sparse(s, d), _K2))).withColumn("value", F.round("value", 4)), f"WITH {_Z0}, {_gauss('z3', ['z', 'y', 'x'], _K2, _SIZE3, 'g')} SELECT z, y, x, {_R4} FROM g")
_register("chunk_bin_shrink_sparse", lambda s, d: _voxels(C.densify(C.bin_shrink(_sparse(s, d, 7), _K2))).withColumn("value", F.round("value", 6)), f"WITH {_Z3H.replace('FILL', '7')} SELECT CAST(z // 2 AS BIGINT) AS z, CAST(y // 2 AS BIGINT) AS y, CAST(x // 2 AS BIGINT) AS x, round(avg(value), 6) AS value FROM z3 WHERE z < 6 GROUP BY 1, 2, 3")
_register("chunk_mode_sparse", lambda s, d: _voxels(C.densify(C.mode(_sparse(s, d), {"y": 2, "x": 2}))), _vote_sql(_Z0, "z3", "z", 2, _mode_weights(2), "64", "64"))

# Formats of stores -------------------------------------------------------------------


@query(f"WITH {E2}, c(codec) AS (VALUES ('none'), ('gzip'), ('zstd')) SELECT codec, count(*) AS n, CAST(sum(value * (y * 64 + x)) AS BIGINT) AS checksum FROM e2, c GROUP BY 1")
def store_codecs(s: SparkSession, d: str) -> DataFrame:
    out, im = None, _chunked(s, d)
    for codec in ("none", "gzip", "zstd"):
        back = _voxels(store.read_array(s, _put(im, scratch(s, codec), 3, None if codec == "none" else codec), im.meta.dims))
        one = back.agg(F.lit(codec).alias("codec"), F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * (F.col("y") * 64 + F.col("x"))).alias("checksum"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT y, x, CASE WHEN y < 8 THEN y * 20 + x ELSE 9 END AS value FROM range(12) t(y), range(20) u(x)")
def store_big_endian(s: SparkSession, d: str) -> DataFrame:
    """A foreign array: big-endian samples, dots in keys, a fill value, and the last row of chunks absent."""
    path = scratch(s, "foreign")
    x = np.arange(160, dtype=">i4").reshape(8, 20)
    store.write_file(f"{path}/.zarray", json.dumps({"zarr_format": 2, "shape": [12, 20], "chunks": [4, 16], "dtype": ">i4", "compressor": None, "fill_value": 9, "order": "C", "filters": None}).encode())
    for i in range(2):
        for j in range(2):
            part = np.zeros((4, 16), ">i4")
            own = x[4 * i : 4 * i + 4, 16 * j : 16 * j + 16]
            part[:, : own.shape[1]] = own
            store.write_file(f"{path}/{i}.{j}", part.tobytes())
    return _voxels(store.read_array(s, path)).withColumn("value", F.col("value").cast("long"))


def _pyramid(s: SparkSession, d: str, version: str = "0.4", per_shard=None, factors=(2,), method: str = "bin_shrink") -> str:
    path = scratch(s, "pyramid")
    service.build_store(_chunked(s, d), path, list(factors), method, version, "zstd", per_shard)
    return path


def _levels(s: SparkSession, path: str, digits: int = 6) -> DataFrame:
    return Y.as_table([C.to_voxels(c) for c in service.read_pyramid(s, path)[0]]).withColumn("value", F.round("value", digits))


_register("pyramid_by_level", lambda s, d: _levels(s, _pyramid(s, d, factors=(2, 4))), SQL["pyramid_bin_2_4"])
_register("pyramid_by_level_gauss", lambda s, d: _levels(s, _pyramid(s, d, "0.5", {"y": 2}, (2, 4), "gaussian"), 4), SQL["pyramid_gauss_2_4"])


def _consolidated(s: SparkSession, d: str, version: str) -> DataFrame:
    """A store whose arrays have no metadata of their own, only the root's."""
    path = _pyramid(s, d, version)
    for i in range(2):
        fs, p = store.filesystem(f"{path}/scale{i}/image/{store.V2_ARRAY if version == '0.4' else store.V3_NODE}")
        fs.delete_file(p)
    return _levels(s, path)


_register("store_consolidated_v2", lambda s, d: _consolidated(s, d, "0.4"), _STORE_SQL)
_register("store_consolidated_v3", lambda s, d: _consolidated(s, d, "0.5"), _STORE_SQL)


@query(f"WITH {E2} SELECT y, x, value FROM e2 WHERE y >= 100 AND y < 170 AND x >= 20 AND x < 40")
def store_hyperslab(s: SparkSession, d: str) -> DataFrame:
    """A box of a store: only the chunks that meet it are opened."""
    im = _chunked(s, d, {"y": 32, "x": 16})
    return _voxels(C.hyperslab(store.read_array(s, _put(im, scratch(s, "box"), 3, "zstd", {"y": 2, "x": 2}), im.meta.dims), {"y": (100, 170), "x": (20, 40)}))


@query(f"WITH {E2} SELECT y, x, -value AS value FROM e2 WHERE y < 100")
def store_overwrite(s: SparkSession, d: str) -> DataFrame:
    """A smaller image over a larger one; nothing of the older is left."""
    path = scratch(s, "over")
    big = _chunked(s, d)
    service.write_pyramid([big], service.PyramidMeta([big.meta], [], service.Method.NEAREST), path)
    small = T.embeddings(s, d)
    small = C.from_voxels(T.Image(small.voxels.where("y < 100").withColumn("value", -F.col("value")), replace(small.meta, shape={"y": 100, "x": 64})), {"y": 64, "x": 32}, "int64")
    service.write_pyramid([small], service.PyramidMeta([small.meta], [], service.Method.NEAREST), path)
    return _voxels(service.read_pyramid(s, path)[0][0])


@query(f"WITH {E2} SELECT 'files' AS what, CAST(ceil(ny / 64) * 2 + 1 AS BIGINT) AS n FROM n UNION ALL SELECT 'chunks', CAST(ceil(ny / 64) * 2 AS BIGINT) FROM n")
def store_size(s: SparkSession, d: str) -> DataFrame:
    """Files of an array's store: one for each chunk and one of metadata; and the chunks that are read from it."""
    im = _chunked(s, d)
    path = _put(im, scratch(s, "size"))
    files = backends.store_size(s, path).select(F.lit("files").alias("what"), F.col("files").alias("n"))
    return files.union(store.read_array(s, path, im.meta.dims).chunks.agg(F.lit("chunks"), F.count(F.lit(1))))


# Service -----------------------------------------------------------------------------

_register("store_optimize", lambda s, d: _levels(s, service.optimize(s, _pyramid(s, d), scratch(s, "opt"), chunk=24, per_shard=2).path), _STORE_SQL)


@query(_STORE_SQL)
def convert_passthrough(s: SparkSession, d: str) -> DataFrame:
    """A pyramid is converted to another version with its own levels."""
    return _levels(s, service.convert(s, _pyramid(s, d), scratch(s, "passed"), service.Options(version="0.5")).path)


@query(f"WITH {E2}, p AS (SELECT y, x, value FROM e2 WHERE y % 4 = 0 AND x % 4 = 0 AND y < ny4 AND x < 64), f AS (SELECT 1) SELECT CAST(y // 4 AS BIGINT) AS y, CAST(x // 4 AS BIGINT) AS x, value FROM p".replace("FROM e2 WHERE", "FROM e2, (SELECT ny // 2 // 2 * 4 AS ny4 FROM n) WHERE"))
def convert_level(s: SparkSession, d: str) -> DataFrame:
    """Conversion from a chosen level of a store, rebuilt by another method; the new second level."""
    path = _pyramid(s, d, factors=(2,), method="nearest")
    out = service.convert(s, path, scratch(s, "level"), service.Options(level=1, factors=[2], method="DASK_IMAGE_NEAREST"))
    return _voxels(service.read_pyramid(s, out.path)[0][1])


@query(f"""WITH {E2}, l(level, k) AS (VALUES (0, 1), (1, 2), (2, 4)) SELECT CAST(level AS INTEGER) AS level, CAST(CASE k WHEN 1 THEN ny WHEN 2 THEN ny // 2 ELSE ny // 2 // 2 END AS BIGINT) AS y, CAST(64 // k AS BIGINT) AS x, 0.5::DOUBLE * k AS scale_y, 1.0::DOUBLE * k AS scale_x, 3.0::DOUBLE + 0.25 * (k - 1) AS translation_y FROM n, l""")
def convert_metadata(s: SparkSession, d: str) -> DataFrame:
    """Sizes, scales and translations of a converted store, with a scale and a translation given by the caller."""
    path = scratch(s, "array")
    _put(_chunked(s, d), path)
    out = service.convert(s, path, scratch(s, "out"), service.Options(dims=["y", "x"], scale={"y": 0.5}, translation={"y": 3.0}, factors=[2, 4], method="ITK_BIN_SHRINK"))
    metas = service.read_pyramid(s, out.path)[1].images
    rows = [(i, m.shape["y"], m.shape["x"], m.scale["y"], m.scale["x"], m.translation["y"]) for i, m in enumerate(metas)]
    return s.createDataFrame(rows, "level int, y long, x long, scale_y double, scale_x double, translation_y double")


@query(f"WITH {E2} SELECT CAST(0 AS BIGINT) AS z, y, x, value FROM e2 UNION ALL SELECT 1, y, x, value FROM e2")
def stacked_files(s: SparkSession, d: str) -> DataFrame:
    """Two arrays as planes along z."""
    paths = [_put(_chunked(s, d), scratch(s, "plane"), 3) for _ in range(2)]
    return _voxels(service.open_input(s, paths))


@query(f"WITH {E2}, b AS (SELECT y, x, value FROM e2 WHERE y < 64) SELECT 'A/2' AS well, '0' AS field, y, x, value FROM b UNION ALL SELECT 'B/1', '1', y, x, -value FROM b")
def plate_store(s: SparkSession, d: str) -> DataFrame:
    """A plate's store: structure, two fields written into wells, each read back through the plate."""
    path = scratch(s, "plate")
    service.write_plate(PlateMeta("p", ["A", "B"], ["1", "2"], [("A/2", 0, 1), ("B/1", 1, 0)], version="0.5"), path)
    base = T.embeddings(s, d)
    out = None
    for sign, row, column, index in ((1, "A", "2", 0), (-1, "B", "1", 1)):
        im = C.from_voxels(T.Image(base.voxels.where("y < 64").withColumn("value", F.col("value") * sign), replace(base.meta, shape={"y": 64, "x": 64})), {"y": 32, "x": 32}, "int64")
        for _ in range(2):  # a field that comes again is written again and listed once
            service.write_field([im], service.PyramidMeta([im.meta], [], service.Method.NEAREST), path, row, column, index)
    p = service.Plate(s, path)
    for well in ((0, 1), (1, 0)):
        fields = p.well_by_index(*well)["images"]
        name = f"{p.meta.rows[well[0]]}/{p.meta.columns[well[1]]}"
        for i, f in enumerate(fields):
            one = _voxels(p.image(*name.split("/"), i)[0][0]).select(F.lit(name).alias("well"), F.lit(f["path"]).alias("field"), "y", "x", "value")
            out = one if out is None else out.unionByName(one)
    return out


# Other files -------------------------------------------------------------------------


def _volume(s: SparkSession, d: str, name: str) -> str:
    """Supplied quantities as a small NIfTI volume with scaled samples."""
    im = T.lineitem(s, d)
    x = C.to_array(C.from_voxels(im, {"z": 7, "y": 64, "x": 64}, "int32")).transpose(2, 1, 0)
    path = scratch(s, "volume", name)
    nifti.write(path, x, [[2, 0, 0, 1], [0, 3, 0, 2], [0, 0, 4, 3]], 0.5, 1.0)
    return path


for _name, _suffix in (("nifti_plain", ".nii"), ("nifti_packed", ".nii.gz")):
    _register(_name, lambda s, d, x=_suffix: _voxels(service.open_input(s, _volume(s, d, x))).withColumn("value", F.col("value").cast("double")), f"WITH {Z3} SELECT z, y, x, value * 0.5::DOUBLE + 1 AS value FROM z3")


@query(f"WITH {Z3} SELECT min(value) * 0.5::DOUBLE + 1 AS lo, max(value) * 0.5::DOUBLE + 1 AS hi FROM z3")
def nifti_window(s: SparkSession, d: str) -> DataFrame:
    path = _volume(s, d, ".nii")
    w = nifti.window(s, path, _voxels(nifti.read(s, path))).window
    return s.createDataFrame([(w.start, w.end)], "lo double, hi double")


@query(f"WITH {Z3} SELECT z, y, x, value FROM z3")
def itk_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Through the toolkit's image structure, with samples, and back."""
    structure = service.to_itk(C.from_voxels(T.lineitem(s, d), {"z": 7, "y": 32, "x": 64}, "int64"))
    return _voxels(service.from_itk(s, structure))


@query(f"WITH {E2} SELECT y, x, value FROM e2")
def command_line(s: SparkSession, d: str) -> DataFrame:
    """The command line converts an array; the first level of what it wrote."""
    path, out = _put(_chunked(s, d), scratch(s, "in")), scratch(s, "out")
    if service.main([path, "-o", out, "--dims", "y", "x", "--method", "itk_bin_shrink", "--version", "0.5", "--chunks", "64", "--chunks-per-shard", "2", "--quiet"]):
        raise RuntimeError("the conversion failed")
    return _voxels(service.read_pyramid(s, out)[0][0])


# Documents and types ---------------------------------------------------------------------


@query(f"""WITH n AS (SELECT max(vec_id) + 1 AS ny FROM embeddings), v(version, rfc4) AS (VALUES ('0.4', false), ('0.4', true), ('0.5', false), ('0.5', true)), l(level, k) AS (VALUES (0, 1), (1, 2), (2, 4))
    SELECT version, rfc4, CAST(level AS INTEGER) AS level, 'scale' || level || '/image' AS path, CAST(k AS DOUBLE) AS scale_y, (k - 1) / 2.0::DOUBLE AS translation_y, CASE WHEN rfc4 THEN 'anterior-to-posterior' END AS orientation_y, 'bin_shrink' AS method, CAST(ny // k AS BIGINT) AS size_y
    FROM v, l, n""")
def store_documents(s: SparkSession, d: str) -> DataFrame:
    """Metadata files of stores of both versions, with and without orientations, as text; and each level's size from its own node."""
    out = None
    im = _chunked(s, d)
    im.meta.orientations.update({"y": "anterior-to-posterior", "x": "right-to-left"})
    for version, rfc4 in (("0.4", False), ("0.4", True), ("0.5", False), ("0.5", True)):
        path = scratch(s, "doc")
        service.build_store(im, path, [2, 4], "bin_shrink", version, rfcs=(4,) if rfc4 else ())
        at, root = (store.V2_ATTRS, "$.multiscales[0]") if version == "0.4" else (store.V3_NODE, "$.attributes.ome.multiscales[0]")
        node = store.V2_ARRAY if version == "0.4" else store.V3_NODE
        text = store.read_file(f"{path}/{at}").decode()
        nodes = [(i, store.read_file(f"{path}/scale{i}/image/{node}").decode()) for i in range(3)]
        rows = s.createDataFrame([(version, rfc4, text)], "version string, rfc4 boolean, doc string").join(s.createDataFrame(nodes, "level int, node string"))
        get = lambda p, c="doc": F.get_json_object(c, p)
        sets = F.from_json(get(f"{root}.datasets"), "array<struct<path:string,coordinateTransformations:array<struct<scale:array<double>,translation:array<double>>>>>")
        own = F.get(sets, F.col("level"))
        size = F.from_json(get("$.shape", "node"), "array<long>")
        one = rows.select("version", "rfc4", "level", own["path"].alias("path"), F.get(own["coordinateTransformations"], F.lit(0))["scale"][0].alias("scale_y"), F.get(own["coordinateTransformations"], F.lit(1))["translation"][0].alias("translation_y"), get(f"{root}.axes[0].orientation.value").alias("orientation_y"), get(f"{root}.type").alias("method"), size[0].alias("size_y"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {E2}, t(dtype, m) AS (VALUES ('uint8', 200), ('int16', 30000), ('uint32', 4000000000), ('float32', 1000), ('float64', 1000))
    SELECT dtype, count(*) AS n, CAST(sum(((value % m) + m) % m * (y + 1)) AS DOUBLE) AS checksum FROM e2, t GROUP BY 1""")
def store_dtypes(s: SparkSession, d: str) -> DataFrame:
    """Samples of several types through stores."""
    base, out = T.embeddings(s, d), None
    for dtype, m in (("uint8", 200), ("int16", 30_000), ("uint32", 4_000_000_000), ("float32", 1000), ("float64", 1000)):
        im = C.from_voxels(T.Image(base.voxels.withColumn("value", F.pmod("value", F.lit(m))), base.meta), {"y": 64, "x": 32}, dtype)
        back = _voxels(store.read_array(s, _put(im, scratch(s, dtype), 3), im.meta.dims))
        one = back.agg(F.lit(dtype).alias("dtype"), F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(20,0)") * (F.col("y") + 1)).cast("double").alias("checksum"))
        out = one if out is None else out.unionByName(one)
    return out


_register("chunk_transpose", lambda s, d: _voxels(C.transpose(C.rechunk(C.transpose(_chunked(s, d), ("x", "y")), {"x": 40, "y": 50}), ("y", "x"))), f"WITH {E2} SELECT y, x, value FROM e2")
_register("chunk_bin_leftover", lambda s, d: _voxels(C.bin_shrink(_chunked(s, d), {"y": 64, "x": 32})).withColumn("value", F.round("value", 6)), f"WITH {E2} SELECT CAST(y // 64 AS BIGINT) AS y, CAST(x // 32 AS BIGINT) AS x, round(avg(value), 6) AS value FROM e2, n WHERE y < ny // 64 * 64 GROUP BY 1, 2")


@query(f"WITH {E2}, l(level, k) AS (VALUES (0, 1), (1, 2), (2, 4)) SELECT CAST(level AS INTEGER) AS level, CASE level WHEN 0 THEN ny WHEN 1 THEN ny // 2 ELSE ny // 2 // 2 END AS y, CAST(64 // k AS BIGINT) AS x, '0.5' AS version, CAST(3 AS INTEGER) AS levels FROM n, l")
def inspect_store(s: SparkSession, d: str) -> DataFrame:
    info = service.inspect(s, _pyramid(s, d, "0.5", factors=(2, 4)))
    return s.createDataFrame([(i, x["y"], x["x"], info["version"], info["levels"]) for i, x in enumerate(info["shapes"])], "level int, y long, x long, version string, levels int")


_OPTIONS = [(dim, unit, version, codec) for dim in ("x", "q") for unit in ("meter", "cubit") for version in ("0.4", "0.5", "0.1") for codec in ("gzip", "lz4")]


@query(f"""SELECT dim, unit, version, codec, CAST((dim = 'q')::INT + (unit = 'cubit')::INT + (version = '0.1')::INT + (codec = 'lz4')::INT + (version <> '0.5')::INT AS INTEGER) AS problems
    FROM (VALUES {', '.join(str(o) for o in _OPTIONS)}) t(dim, unit, version, codec)""")
def checked_options(s: SparkSession, d: str) -> DataFrame:
    rows = [(*o, len(service.check_options(service.Options(dims=[o[0]], units={"x": o[1]}, version=o[2], codec=o[3], per_shard=2)))) for o in _OPTIONS]
    return s.createDataFrame(rows, "dim string, unit string, version string, codec string, problems int")


_register("format_listing", lambda s, d: backends.formats(s).groupBy("backend").agg(F.count(F.lit(1)).alias("suffixes"), F.sum(F.col("readable").cast("long")).alias("readable")), "SELECT backend, count(*) AS suffixes, CAST(sum(CASE WHEN backend IN ('pyramid_store', 'array_store', 'nibabel') THEN 1 ELSE 0 END) AS BIGINT) AS readable FROM (VALUES " + ", ".join(f"('{b}', '{x}')" for b, xs in (("pyramid_store", backends.STORE), ("array_store", (".zarr",)), ("nibabel", backends.NIFTI), ("itkwasm_image_io", backends.MEDICAL), ("itk", backends.MEDICAL), ("tifffile", backends.TIFF)) for x in xs) + ") t(backend, suffix) GROUP BY 1")
