"""Queries over the driver's tables, each with SQL that gives the same rows.

A query is registered with its SQL; SQL texts build on shared fragments for the
images (see ``sources.tables``) and spell out what the operators do.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as X
from .operators import chunks as C
from .operators import downsample as D
from .operators import layout as L
from .operators import metadata as M
from .operators import plate as P
from .operators import pyramid as Y
from .operators import validate as V
from .plans import levels
from .runtime import shared_root
from .sources import backends, store
from .sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}

E2 = """n AS (SELECT max(vec_id) + 1 AS ny, 64 AS nx FROM embeddings),
e2 AS (SELECT vec_id AS y, CAST(i - 1 AS BIGINT) AS x, CAST(floor(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT) AS value
       FROM embeddings, unnest(range(1, 65)) t(i))"""
L2 = E2 + ", l2 AS (SELECT y, x, value // 100 AS value FROM e2)"
Z3S = """z3s AS (SELECT CAST(l_linenumber - 1 AS BIGINT) AS z, l_suppkey % 64 AS y, l_partkey % 64 AS x, CAST(sum(l_quantity) AS BIGINT) AS value
       FROM lineitem GROUP BY 1, 2, 3)"""
Z3 = Z3S + """, z3 AS (SELECT a AS z, b AS y, c AS x, coalesce(value, 0) AS value
       FROM range(7) t1(a), range(64) t2(b), range(64) t3(c) LEFT JOIN z3s ON z = a AND y = b AND x = c)"""
V4 = """k AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS c FROM (SELECT DISTINCT event_type FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL)),
vd AS (SELECT min(CAST(ts AS DATE)) AS d0, date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 AS nt FROM events WHERE event_type IS NOT NULL),
v4s AS (SELECT CAST(date_diff('day', d0, CAST(ts AS DATE)) AS BIGINT) AS t, c, hour(ts) AS y, user_id % 16 AS x, count(*) AS value
       FROM events JOIN k USING (event_type), vd WHERE ts IS NOT NULL GROUP BY 1, 2, 3, 4),
v4 AS (SELECT a AS t, b AS c, d AS y, e AS x, coalesce(value, 0) AS value
       FROM (SELECT unnest(range(nt)) AS a FROM vd), (SELECT c AS b FROM k), range(24) t3(d), range(16) t4(e)
       LEFT JOIN v4s ON t = a AND v4s.c = b AND y = d AND x = e)"""
PL = """pr AS (SELECT CAST(r_regionkey AS INTEGER) AS pos, regexp_replace(r_name, '[^A-Za-z0-9]', '', 'g') AS name FROM region),
pc AS (SELECT CAST(n_nationkey AS INTEGER) AS pos, regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g') AS name, n_regionkey AS region FROM nation),
pw AS (SELECT pr.name || '/' || pc.name AS path, pr.pos AS row_index, pc.pos AS column_index, pr.name AS row, pc.name AS col FROM pc JOIN pr ON pc.region = pr.pos),
pi AS (SELECT path AS well, CAST(row_number() OVER (PARTITION BY path ORDER BY s_suppkey) - 1 AS INTEGER) AS pos, CAST(s_suppkey AS VARCHAR) AS path, CAST(s_suppkey % 5 AS INTEGER) AS acquisition
       FROM supplier JOIN pw ON s_nationkey = column_index),
pv AS (SELECT CAST(l_suppkey AS VARCHAR) AS path, l_linenumber - 1 AS y, l_partkey % 64 AS x, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2, 3)"""


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql.strip()
        return f

    return add


def _register(name: str, f, sql: str) -> None:
    QUERIES[name], SQL[name] = f, sql.strip()


# Sources ---------------------------------------------------------------------

_register("vox_embed", lambda s, d: T.embeddings(s, d).voxels, f"WITH {E2} SELECT y, x, value FROM e2")
_register("vox_events_dense", lambda s, d: T.events(s, d).voxels, f"WITH {V4} SELECT t, c, y, x, value FROM v4")
_register("vox_lineitem", lambda s, d: T.lineitem(s, d).voxels, f"WITH {Z3} SELECT z, y, x, value FROM z3")

# Bins ------------------------------------------------------------------------


def _bins(table: str, keep: str, f: dict[str, int], limits: dict[str, str]) -> str:
    cols = [f"CAST({d} // {k} AS BIGINT) AS {d}" for d, k in f.items()]
    inside = " AND ".join(f"{d} < {n} // {f[d]} * {f[d]}" for d, n in limits.items()) or "true"
    group = ", ".join(str(i + 1) for i in range(len(cols) + (len(keep.split(",")) if keep else 0)))
    return f"SELECT {keep + ', ' if keep else ''}{', '.join(cols)}, round(avg(value), 6) AS value FROM {table} WHERE {inside} GROUP BY {group}"


_NY = {"y": "(SELECT ny FROM n)", "x": "64"}
_register("bin_shrink_2d", lambda s, d: D.bin_shrink(T.embeddings(s, d), 4, 6).voxels, f"WITH {E2} " + _bins("e2", "", {"y": 4, "x": 4}, _NY))
_register("bin_shrink_aniso", lambda s, d: D.bin_shrink(T.embeddings(s, d), {"y": 2, "x": 4}, 6).voxels, f"WITH {E2} " + _bins("e2", "", {"y": 2, "x": 4}, _NY))
_register("bin_shrink_ragged", lambda s, d: D.bin_shrink(T.lineitem(s, d), {"z": 2, "y": 3, "x": 5}, 6).voxels, f"WITH {Z3} " + _bins("z3", "", {"z": 2, "y": 3, "x": 5}, {"z": "7", "y": "64", "x": "64"}))
_register("bin_shrink_3d", lambda s, d: D.bin_shrink(T.lineitem(s, d), 2, 6).voxels, f"WITH {Z3} " + _bins("z3", "", {"z": 2, "y": 2, "x": 2}, {"z": "7", "y": "64", "x": "64"}))
_register("bin_shrink_tcyx", lambda s, d: D.bin_shrink(T.events(s, d), 4, 6).voxels, f"WITH {V4} " + _bins("v4", "t, c", {"y": 4, "x": 4}, {"y": "24", "x": "16"}))

# Picks and votes ---------------------------------------------------------------

_register("nearest_2d", lambda s, d: D.nearest(T.labels(s, d), 4).voxels, f"WITH {L2} SELECT y // 4 AS y, x // 4 AS x, value FROM l2, n WHERE y % 4 = 0 AND x % 4 = 0 AND y < ny // 4 * 4")
_register("nearest_3d", lambda s, d: D.nearest(T.lineitem(s, d), {"z": 2, "y": 4, "x": 4}).voxels, f"WITH {Z3} SELECT z // 2 AS z, y // 4 AS y, x // 4 AS x, value FROM z3 WHERE z % 2 = 0 AND y % 4 = 0 AND x % 4 = 0 AND z < 6")


def _vote_sql(with_: str, table: str, keep: str, k: int, weights, ny: str, nx: str) -> str:
    w = ", ".join(f"({o}, {x})" for o, x in weights)
    out = f"{keep + ', ' if keep else ''}oy, ox"
    return f"""WITH {with_}, w(o, w) AS (VALUES {w}),
    ty AS (SELECT i AS oy, least(greatest(i * {k} + o, 0), {ny} - 1) AS y, sum(w) AS wy FROM range(CAST({ny} AS BIGINT) // {k}) t(i), w GROUP BY 1, 2),
    tx AS (SELECT i AS ox, least(greatest(i * {k} + o, 0), {nx} - 1) AS x, sum(w) AS wx FROM range(CAST({nx} AS BIGINT) // {k}) t(i), w GROUP BY 1, 2),
    v AS (SELECT {out}, value, sum(wy * wx) AS votes FROM {table} JOIN ty USING (y) JOIN tx USING (x) GROUP BY ALL)
    SELECT {keep + ', ' if keep else ''}oy AS y, ox AS x, value FROM v QUALIFY row_number() OVER (PARTITION BY {out} ORDER BY votes DESC, value) = 1"""


def _mode_weights(k: int):
    return [(o, 1) for o in range(-(k // 2), k - k // 2)]


_register("mode_2d", lambda s, d: D.mode(T.labels(s, d), 2).voxels, _vote_sql(L2, "l2", "", 2, _mode_weights(2), "(SELECT max(vec_id) + 1 FROM embeddings)", "64"))
_register("mode_k3", lambda s, d: D.mode(T.labels(s, d), 3).voxels, _vote_sql(L2, "l2", "", 3, _mode_weights(3), "(SELECT max(vec_id) + 1 FROM embeddings)", "64"))
_register("mode_tcyx", lambda s, d: D.mode(T.events(s, d), 2).voxels, _vote_sql(V4, "v4", "t, c", 2, _mode_weights(2), "24", "16"))
_register("label_vote_2d", lambda s, d: D.label_vote(T.labels(s, d), 2).voxels, _vote_sql(L2, "l2", "", 2, levels.vote_weights(2), "(SELECT max(vec_id) + 1 FROM embeddings)", "64"))
_register("label_vote_k4", lambda s, d: D.label_vote(T.labels(s, d), 4).voxels, _vote_sql(L2, "l2", "", 4, levels.vote_weights(4), "(SELECT max(vec_id) + 1 FROM embeddings)", "64"))

# Gaussian ----------------------------------------------------------------------


def _gauss(source: str, dims: list[str], step: dict[str, int], size: dict[str, str], out: str, cut: float = 4.0) -> str:
    """CTEs that reduce ``source`` axis by axis into ``out``."""
    parts, now = [], source
    for d in sorted(step, key=lambda a: -step[a]):
        k = step[d]
        taps = ", ".join(f"({o}, CAST({w!r} AS DOUBLE))" for o, w in levels.kernel(k, cut))
        rest = ", ".join(f"s.{c}" for c in dims if c != d)
        name = f"{out}_{d}"
        parts.append(f"""{name}_w(o, w) AS (VALUES {taps}),
        {name} AS (SELECT {rest + ', ' if rest else ''}i AS {d}, sum(w * s.value) AS value
            FROM range(CAST({size[d]} AS BIGINT) // {k}) t(i), {name}_w JOIN {now} s ON s.{d} = least(greatest(i * {k} + o, 0), {size[d]} - 1) GROUP BY ALL)""")
        now = name
    return ", ".join(parts) + f", {out} AS (SELECT {', '.join(dims)}, value FROM {now})"


_SIZE2 = {"y": "(SELECT ny FROM n)", "x": "64"}
_SIZE3 = {"z": "7", "y": "64", "x": "64"}
_R4 = "round(value, 4) AS value"
_register("gaussian_1d", lambda s, d: D.gaussian(T.embeddings(s, d), {"x": 2}, 4).voxels, f"WITH {E2}, {_gauss('e2', ['y', 'x'], {'x': 2}, _SIZE2, 'g')} SELECT y, x, {_R4} FROM g")
_register("gaussian_2d", lambda s, d: D.gaussian(T.embeddings(s, d), 2, 4).voxels, f"WITH {E2}, {_gauss('e2', ['y', 'x'], {'y': 2, 'x': 2}, _SIZE2, 'g')} SELECT y, x, {_R4} FROM g")
_register("gaussian_k4", lambda s, d: D.gaussian(T.embeddings(s, d), 4, 4).voxels, f"WITH {E2}, {_gauss('e2', ['y', 'x'], {'y': 4, 'x': 4}, _SIZE2, 'g')} SELECT y, x, {_R4} FROM g")
_register("gaussian_3d", lambda s, d: D.gaussian(T.lineitem(s, d), 2, 4).voxels, f"WITH {Z3}, {_gauss('z3', ['z', 'y', 'x'], {'z': 2, 'y': 2, 'x': 2}, _SIZE3, 'g')} SELECT z, y, x, {_R4} FROM g")

# Pyramids ----------------------------------------------------------------------


def _levels(image: T.Image, factors, method: str, digits: int, chunk=None) -> DataFrame:
    images, _ = Y.build(image, factors, method, chunk)
    return Y.as_table(images).withColumn("value", F.round("value", digits))


def _mean_level(source: str, ky: int, kx: int, ny: str, nx: str) -> str:
    return f"(SELECT y // {ky} AS y, x // {kx} AS x, avg(value) AS value FROM {source} WHERE y < {ny} // {ky} * {ky} AND x < {nx} // {kx} * {kx} GROUP BY 1, 2)"


def _union(names: list[str], digits: int) -> str:
    return " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS level, y, x, round(CAST(value AS DOUBLE), {digits}) AS value FROM {n}" for i, n in enumerate(names))


_HALF = "((SELECT ny FROM n) // 2)"
_register("pyramid_bin_2_4", lambda s, d: _levels(T.embeddings(s, d), [2, 4], "bin_shrink", 6), f"WITH {E2}, p1 AS {_mean_level('e2', 2, 2, '(SELECT ny FROM n)', '64')}, p2 AS {_mean_level('p1', 2, 2, _HALF, '32')} " + _union(["e2", "p1", "p2"], 6))
_register(
    "pyramid_gauss_2_4",
    lambda s, d: _levels(T.embeddings(s, d), [2, 4], "gaussian", 4),
    f"WITH {E2}, {_gauss('e2', ['y', 'x'], {'y': 2, 'x': 2}, _SIZE2, 'g')}, {_gauss('g', ['y', 'x'], {'y': 2, 'x': 2}, {'y': _HALF, 'x': '32'}, 'h')} " + _union(["e2", "g", "h"], 4),
)
# the plan of levels from the sizes; a level's value is the mean of the whole box, as bins are nested and whole
_register(
    "pyramid_auto",
    lambda s, d: _levels(T.embeddings(s, d), 16, "bin_shrink", 6, chunk=16),
    f"""WITH RECURSIVE {E2}, p AS (SELECT 0 AS level, ny AS sy, CAST(nx AS BIGINT) AS sx, 1 AS fy, 1 AS fx, true AS go FROM n
    UNION ALL
    SELECT level + 1, CASE WHEN gy THEN sy // 2 ELSE sy END, CASE WHEN gx THEN sx // 2 ELSE sx END, CASE WHEN gy THEN fy * 2 ELSE fy END, CASE WHEN gx THEN fx * 2 ELSE fx END,
        (gy OR gx) AND (CASE WHEN gy THEN sy // 2 ELSE sy END) * (CASE WHEN gx THEN sx // 2 ELSE sx END) / 16.0 >= 2
    FROM (SELECT *, sy > greatest(sy, sx) / 2.0 AND sy / 2.0 >= 16 AS gy, sx > greatest(sy, sx) / 2.0 AND sx / 2.0 >= 16 AS gx FROM p WHERE go AND (sy > 32 OR sx > 32)))
    SELECT CAST(level AS INTEGER) AS level, y // fy AS y, x // fx AS x, round(avg(CAST(value AS DOUBLE)), 6) AS value FROM e2, p WHERE go AND y // fy < sy AND x // fx < sx GROUP BY 1, 2, 3""",
)


def _planned(s, d):
    images, _ = Y.build(T.embeddings(s, d), [2, 4], "nearest", keep=False)
    return images


_register("pyramid_extent_check", lambda s, d: Y.extent(_planned(s, d)), """WITH n AS (SELECT max(vec_id) + 1 AS ny FROM embeddings), f(level, k) AS (VALUES (0, 1), (1, 2), (2, 4))
    SELECT level, 'y' AS dim, CAST((ny // k) * k AS DOUBLE) AS extent FROM f, n UNION ALL SELECT level, 'x', CAST(64 // k * k AS DOUBLE) FROM f""")
_register("next_scale_translation", lambda s, d: Y.datasets(_planned(s, d)), """WITH n AS (SELECT max(vec_id) + 1 AS ny FROM embeddings), f(level, k, t) AS (VALUES (0, 1, 0.0), (1, 2, 0.5), (2, 4, 1.5))
    SELECT level, 'y' AS dim, CAST(ny // 2 // CASE WHEN k = 4 THEN 2 ELSE 1 END * CASE WHEN k = 1 THEN 2 ELSE 1 END AS BIGINT) AS size, CAST(k AS DOUBLE) AS scale, CAST(t AS DOUBLE) AS translation FROM f, n
    UNION ALL SELECT level, 'x', CAST(64 // k AS BIGINT), CAST(k AS DOUBLE), CAST(t AS DOUBLE) FROM f""")

_PLANS = [("a", 30, 30, 64), ("b", 520, 520, 64), ("c", 10, 530, 64), ("d", 4096, 300, 128), ("e", 1000, 64, 16)]


@query()
def level_plan(s: SparkSession, d: str) -> DataFrame:
    rows = [(n, i + 1, f["y"], f["x"]) for n, y, x, c in _PLANS for i, f in enumerate(levels.auto_factors({"y": y, "x": x}, {"y": c, "x": c}, 64))]
    return s.createDataFrame(rows, "name string, level int, fy int, fx int")


SQL["level_plan"] = f"""WITH RECURSIVE p(name, level, y, x, fy, fx, c, go) AS (
    SELECT name, 0, y, x, 1, 1, c, true FROM (VALUES {', '.join(str(p) for p in _PLANS)}) t(name, y, x, c)
    UNION ALL
    SELECT name, level + 1, CASE WHEN gy THEN y // 2 ELSE y END, CASE WHEN gx THEN x // 2 ELSE x END, CASE WHEN gy THEN fy * 2 ELSE fy END, CASE WHEN gx THEN fx * 2 ELSE fx END, c,
        (gy OR gx) AND (CASE WHEN gy THEN y // 2 ELSE y END) * (CASE WHEN gx THEN x // 2 ELSE x END) / 64.0 >= 2
    FROM (SELECT *, y > greatest(x, y) / 2.0 AND y / 2.0 >= c AS gy, x > greatest(x, y) / 2.0 AND x / 2.0 >= c AS gx FROM p WHERE go AND (y > 2 * c OR x > 2 * c)))
    SELECT name, level, fy, fx FROM p WHERE level > 0 AND go"""

_register("world_coords", lambda s, d: T.embeddings(s, d).voxels.select("y", "x", X.world("y", F.lit(0.25), F.lit(10.0)).alias("wy"), X.world("x", F.lit(2.0), F.lit(-1.0)).alias("wx")), f"WITH {E2} SELECT y, x, 0.25::DOUBLE * y + 10.0::DOUBLE AS wy, 2.0::DOUBLE * x - 1.0::DOUBLE AS wx FROM e2")
_register("sigma_by_factor", lambda s, d: s.range(1, 17).select(F.col("id").alias("k"), F.round(X.sigma("id"), 9).alias("sigma")), "SELECT k, round(sqrt((k * k - 1) / (8 * ln(2.0::DOUBLE))), 9) AS sigma FROM range(1, 17) t(k)")

# Layout ------------------------------------------------------------------------

_register("take_t", lambda s, d: L.take(T.events(s, d), "t", 3).voxels, f"WITH {V4} SELECT c, y, x, value FROM v4 WHERE t = 3")
_register("take_c", lambda s, d: L.take(T.events(s, d), "c", 1).voxels, f"WITH {V4} SELECT t, y, x, value FROM v4 WHERE c = 1")
_register("hyperslab", lambda s, d: L.hyperslab(T.lineitem(s, d), {"z": (1, 4), "y": (10, 20)}).voxels, f"WITH {Z3} SELECT z, y, x, value FROM z3 WHERE z >= 1 AND z < 4 AND y >= 10 AND y < 20")
_register("hyperslab_shift", lambda s, d: L.hyperslab(T.lineitem(s, d), {"z": (1, 4), "y": (10, 20)}, shift=True).voxels, f"WITH {Z3} SELECT z - 1 AS z, y - 10 AS y, x, value FROM z3 WHERE z >= 1 AND z < 4 AND y >= 10 AND y < 20")


def _linear(order: str):
    def run(s, d):
        im = L.transpose(T.events(s, d), order)
        return im.voxels.select(X.linear_index(im.meta.dims, im.meta.shape).alias("at"), "value")

    return run


_NC = "(SELECT count(*) FROM k)"
_register("transpose_zyx", _linear("zyx_last"), f"WITH {V4} SELECT ((t * {_NC} + c) * 24 + y) * 16 + x AS at, value FROM v4")
_register("channel_last", _linear("channel_last"), f"WITH {V4} SELECT ((t * 24 + y) * 16 + x) * {_NC} + c AS at, value FROM v4")
_register("array_split", lambda s, d: T.lineitem(s, d).voxels.select("z", "y", "x", X.split_section("y", 64, 5).alias("section"), "value"), f"WITH {Z3} SELECT z, y, x, CAST(CASE WHEN y < 52 THEN y // 13 ELSE 4 + (y - 52) // 12 END AS INTEGER) AS section, value FROM z3")


@query(f"WITH {Z3} SELECT z, y, x, value FROM z3")
def concat_axis(s: SparkSession, d: str) -> DataFrame:
    return L.concat(L.array_split(T.lineitem(s, d), 3, "x"), "x").voxels


@query(f"WITH {Z3} SELECT CAST(0 AS BIGINT) AS t, z, y, x, value FROM z3 UNION ALL SELECT 1, z, y, x, value * 2 FROM z3")
def stack_axis(s: SparkSession, d: str) -> DataFrame:
    one = T.lineitem(s, d)
    return L.stack([one, T.Image(one.voxels.withColumn("value", F.col("value") * 2), one.meta)], "t").voxels


_CH = {"z": 4, "y": 16, "x": 20}
_register("chunk_stats", lambda s, d: L.chunk_stats(T.lineitem(s, d), _CH), f"WITH {Z3} SELECT z // 4 AS iz, y // 16 AS iy, x // 20 AS ix, count(*) AS n, min(value) AS vmin, max(value) AS vmax FROM z3 GROUP BY 1, 2, 3")
_register("rechunk_count", lambda s, d: L.rechunk_count(T.lineitem(s, d), _CH, {"z": 3, "y": 24, "x": 32}), f"WITH {Z3} SELECT z // 3 AS iz, y // 24 AS iy, x // 32 AS ix, count(DISTINCT (z // 4, y // 16, x // 20)) AS pieces FROM z3 GROUP BY 1, 2, 3")
_register("shard_assign", lambda s, d: L.shard_assign(T.lineitem(s, d), _CH, {"y": 2, "x": 3}), f"WITH {Z3} SELECT DISTINCT z // 4 AS iz, y // 16 AS iy, x // 20 AS ix, z // 4 AS sz, y // 32 AS sy, x // 60 AS sx, (y // 16 % 2) * 3 + x // 20 % 3 AS inner FROM z3")
_register("store_diff", lambda s, d: L.difference(T.embeddings(s, d), T.Image(T.embeddings(s, d).voxels.where("y % 7 <> 0"), T.embeddings(s, d).meta)), f"WITH {E2} SELECT y, x, value, 'left' AS side FROM e2 WHERE y % 7 = 0")

# Plans and estimates -------------------------------------------------------------


# the last slab holds 76 planes, so it fits without a split
@query("""WITH zs AS (SELECT z0, CASE WHEN z0 = 1024 THEN 1100 ELSE 640 END AS step FROM unnest(range(0, 1100, 128)) t(z0))
    SELECT z0 AS z_start, least(z0 + 128, 1100) AS z_end, y0 AS y_start, least(y0 + step, 1100) AS y_end FROM zs, unnest(range(0, 1100, step)) t(y0)""")
def region_plan(s: SparkSession, d: str) -> DataFrame:
    """Boxes for 1100 cubed bytes in chunks of 128, 100 MB at most."""
    full = {"z": 1100, "y": 1100, "x": 1100}
    got = levels.regions(full, {k: 128 for k in full}, "uint8", 100_000_000)
    return s.createDataFrame([(*r["z"], *r["y"]) for r in got], "z_start long, z_end long, y_start long, y_end long")


_EST = [("a", [4, 4, 4], [2, 2, 2], 1), ("b", [1, 30, 1024, 1024], [1, 30, 128, 128], 4), ("c", [1100, 1100], [128, 128], 2)]
_EST_SQL = "(VALUES " + ", ".join(f"('{n}', {s}, {c}, {b})" for n, s, c, b in _EST) + ") t(name, shape, chunk, item)"


def _est(s):
    return s.createDataFrame(_EST, "name string, shape array<long>, chunk array<long>, item int")


_register("mem_estimate", lambda s, d: _est(s).select("name", X.bytes_estimate("shape", "item").alias("bytes")), f"SELECT name, CAST(list_product(shape) * item AS BIGINT) AS bytes FROM {_EST_SQL}")
_register("task_estimate", lambda s, d: _est(s).select("name", X.chunks_estimate("shape", "chunk").alias("chunks")), f"SELECT name, CAST(list_product(list_transform(list_zip(shape, chunk), lambda p: ceil(p[1] / p[2]))) AS BIGINT) AS chunks FROM {_EST_SQL}")

# Display windows, predicates, documents --------------------------------------------

_register("channel_windows", lambda s, d: D.value_range(T.events(s, d), "c").select("c", "vmin", "vmax", F.col("vmin").alias("wstart"), F.col("vmax").alias("wend")), f"WITH {V4} SELECT c, min(value) AS vmin, max(value) AS vmax, min(value) AS wstart, max(value) AS wend FROM v4 GROUP BY c")
_WIN = [(0, 0.0, 1000.0, None, None), (1, None, None, 10.0, 900.0), (2, 1.0, 2.0, 3.0, 4.0), (3, None, None, None, None), (4, 5.0, None, None, 6.0)]
_sql_rows = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
_register("window_backcompat", lambda s, d: M.complete_windows(s.createDataFrame(_WIN, "pos int, wmin double, wmax double, wstart double, wend double")), f"""SELECT CAST(pos AS INTEGER) AS pos, CAST(coalesce(wmin, wstart) AS DOUBLE) AS wmin, CAST(coalesce(wmax, wend) AS DOUBLE) AS wmax, CAST(coalesce(wstart, wmin) AS DOUBLE) AS wstart, CAST(coalesce(wend, wmax) AS DOUBLE) AS wend
    FROM (VALUES {_sql_rows(_WIN)}) t(pos, wmin, wmax, wstart, wend) WHERE (wmin IS NOT NULL AND wmax IS NOT NULL) OR (wstart IS NOT NULL AND wend IS NOT NULL)""")
_WORDS = [(c,) for c in ("00ff7F", "00FF7", "xyzxyz", "00ff7f0", "micrometer", "second", "parsec", "cubit", "x", "t", "w", "zz", None)]
_units = ", ".join(f"'{u}'" for u in (*X.SPACE_UNITS, *X.TIME_UNITS))


def _words(s):
    return s.createDataFrame(_WORDS, "w string")


_WSQL = f"(VALUES {_sql_rows(_WORDS)}) t(w)"
_register("color_valid", lambda s, d: _words(s).select("w", X.valid_color("w").alias("ok")), f"SELECT w, coalesce(regexp_full_match(w, '[0-9A-Fa-f]{{6}}'), false) AS ok FROM {_WSQL}")
_register("unit_valid", lambda s, d: _words(s).select("w", X.valid_unit("w").alias("ok")), f"SELECT w, coalesce(w IN ({_units}), false) AS ok FROM {_WSQL}")
_register("dim_valid", lambda s, d: _words(s).select("w", X.valid_dim("w").alias("ok")), f"SELECT w, coalesce(w IN ('t', 'c', 'z', 'y', 'x'), false) AS ok FROM {_WSQL}")

_DOCS = [
    ("a", '{"ome": {"version": "0.5", "multiscales": [{"axes": [{"name": "y", "type": "space", "unit": "meter"}, {"name": "x", "type": "space"}]}]}}'),
    ("b", '{"multiscales": [{"version": "0.3", "axes": ["c", "y", "x"]}]}'),
    ("c", '{"multiscales": [{"version": "0.1"}]}'),
    ("d", '{"multiscales": [{}]}'),
]
_DSQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _DOCS) + ") t(id, doc)"


def _docs(s):
    return s.createDataFrame(_DOCS, "id string, doc string")


_register("json_meta_version", lambda s, d: _docs(s).select("id", M.version("doc").alias("version")), f"SELECT id, coalesce(json_extract_string(doc, '$.ome.version'), json_extract_string(doc, '$.multiscales[0].version'), '0.4') AS version FROM {_DSQL}")
_register("json_axes", lambda s, d: M.axes_table(_docs(s), "id"), f"""WITH a AS (SELECT id, coalesce(json_extract(doc, '$.ome.multiscales[0].axes'), json_extract(doc, '$.multiscales[0].axes'), '["t","c","z","y","x"]'::JSON) AS j FROM {_DSQL}),
    e AS (SELECT id, CAST(i AS INTEGER) AS pos, json_extract(j, '$[' || i || ']') AS v FROM a, unnest(range(CAST(json_array_length(j) AS BIGINT))) u(i)),
    f AS (SELECT id, pos, CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') ELSE json_extract_string(v, '$.name') END AS name, json_extract_string(v, '$.type') AS ty, json_extract_string(v, '$.unit') AS unit FROM e)
    SELECT id, pos, name, coalesce(ty, CASE name WHEN 't' THEN 'time' WHEN 'c' THEN 'channel' ELSE 'space' END) AS type, unit FROM f""")
_register("event_props", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")


@query("""SELECT * FROM (VALUES ('0.4', '0.4', true, 1), ('0.5', '0.5', true, 1)) t(asked, found, omero, pyramids)""")
def version_convert(s: SparkSession, d: str) -> DataFrame:
    import json

    from .model import Channel, ImageMeta, Method, PyramidMeta, Window

    im = ImageMeta(("y", "x"), {"y": 4, "x": 4})
    doc = M.write_document(PyramidMeta([im], [], Method.GAUSSIAN, [Channel("00ff00", Window(0, 1, 0, 1))]), "0.4")
    rows = [(v, json.dumps(M.convert_version(M.convert_version(doc, "0.5"), v))) for v in ("0.4", "0.5")]
    out = M.parse_images(s.createDataFrame(rows, "asked string, doc string"))
    return out.select("asked", F.col("version").alias("found"), F.col("omero").isNotNull().alias("omero"), F.lit(1).alias("pyramids"))


# Inputs ----------------------------------------------------------------------------

_INPUTS = [("a/b.ome.zarr", 1, 10), ("c.zarr", 1, 10), ("brain.NII.gz", 1, 5), ("x.nrrd", 1, 5), ("x.nrrd", 3, 5), ("x.mha", 1, 3_000_000_000), ("t.ome.tiff", 1, 5), ("v.mp4", 1, 5), ("noext", 1, 1)]


@query(f"""WITH i AS (SELECT * FROM (VALUES {_sql_rows(_INPUTS)}) t(path, files, length) UNION ALL SELECT url, 1, 0 FROM pages),
    s AS (SELECT *, lower(regexp_extract(path, '[^/.]((\\.[^./]+)+)$', 1)) AS e FROM i)
    SELECT path, files, CASE WHEN e IN ('.zarr', '.ome.zarr') THEN 'pyramid_store' WHEN e IN ('.nii', '.nii.gz') THEN 'nibabel'
      WHEN e IN ({', '.join(f"'{x}'" for x in backends.MEDICAL)}) THEN CASE WHEN files = 1 AND length < 2000000000 THEN 'itkwasm_image_io' ELSE 'itk' END
      WHEN e IN ({', '.join(f"'{x}'" for x in backends.TIFF)}) THEN 'tifffile' ELSE 'imageio' END AS backend FROM s""")
def backend_detect(s: SparkSession, d: str) -> DataFrame:
    given = s.createDataFrame(_INPUTS, "path string, files int, length long")
    urls = s.read.parquet(f"{d}/pages.parquet").select(F.col("url").alias("path"), F.lit(1).alias("files"), F.lit(0).cast("long").alias("length"))
    return given.unionByName(urls).select("path", "files", backends.detect("path", "files", "length").alias("backend"))


_DT = [("<u2",), (">f8",), ("|b1",), ("uint8",), ("<i4",), ("float16",)]
_register("dtype_names", lambda s, d: s.createDataFrame(_DT, "d string").select("d", X.dtype_name("d").alias("name"), X.component_type(X.dtype_name("d")).alias("component")), f"""WITH n AS (SELECT d, CASE regexp_replace(d, '[<>|=]', '', 'g') WHEN 'u2' THEN 'uint16' WHEN 'f8' THEN 'float64' WHEN 'b1' THEN 'bool' WHEN 'i4' THEN 'int32' ELSE d END AS name FROM (VALUES {_sql_rows(_DT)}) t(d))
    SELECT d, name, CASE WHEN name NOT IN ('bool', 'float16') THEN name END AS component FROM n""")
_register("url_predicates", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", X.is_url("url").alias("url"), X.is_s3("url").alias("s3"), X.is_store("url").alias("store")), "SELECT page_id, regexp_matches(url, '^(https?|s3|gs|az|azure)://') AS url, starts_with(url, 's3://') AS s3, regexp_matches(lower(url), '\\.zarr/?$') AS store FROM pages")

# Plates ----------------------------------------------------------------------------

_register("plate_wells", lambda s, d: T.plate(s, d).wells.select("path", "row_index", "column_index"), f"WITH {PL} SELECT path, row_index, column_index FROM pw")
_register("plate_walk", lambda s, d: P.walk(T.plate(s, d)).drop("plate"), f"WITH {PL} SELECT pi.well, pw.row, pw.col, pi.pos, pi.path, pi.acquisition FROM pi JOIN pw ON pi.well = pw.path")


@query(f"WITH {PL} SELECT q.row, q.col, pw.path AS well FROM (SELECT a.name AS row, b.name AS col FROM pr a, pc b UNION ALL SELECT 'NONE', 'X') q LEFT JOIN pw ON pw.path = q.row || '/' || q.col")
def well_lookup(s: SparkSession, d: str) -> DataFrame:
    p = T.plate(s, d)
    asked = p.rows.select("plate", F.col("name").alias("row")).join(p.columns.select("plate", F.col("name").alias("col")), "plate")
    return P.well_lookup(p, asked.union(s.createDataFrame([("P", "NONE", "X")], "plate string, row string, col string"))).drop("plate")


@query(f"WITH {PL}, q(row_index, column_index) AS (VALUES (0, 0), (1, 1), (2, 3), (4, 24), (9, 0), (0, 99)) SELECT q.row_index, q.column_index, pw.path AS well FROM q LEFT JOIN pw ON pw.row_index = q.row_index AND pw.column_index = q.column_index")
def well_by_index(s: SparkSession, d: str) -> DataFrame:
    asked = s.createDataFrame([("P", r, c) for r, c in ((0, 0), (1, 1), (2, 3), (4, 24), (9, 0), (0, 99))], "plate string, row_index int, column_index int")
    return P.well_by_index(T.plate(s, d), asked).drop("plate")


_register("field_nth", lambda s, d: P.field_at(T.plate(s, d), 1).drop("plate"), f"WITH {PL} SELECT well, pos, path, acquisition FROM pi WHERE pos = 1")
_register("field_in_acquisition", lambda s, d: P.field_in_acquisition(T.plate(s, d), 0).drop("plate"), f"WITH {PL} SELECT well, pos, path, acquisition FROM pi QUALIFY row_number() OVER (PARTITION BY well, acquisition ORDER BY pos) = 1")
_register("acquisition_fields", lambda s, d: T.plate(s, d).images.where("acquisition = 2").drop("plate"), f"WITH {PL} SELECT well, pos, path, acquisition FROM pi WHERE acquisition = 2")
_register("well_missing", lambda s, d: P.missing(T.plate(s, d)).drop("plate"), f"WITH {PL} SELECT pr.name || '/' || pc.name AS path FROM pr, pc WHERE pc.region <> pr.pos")
_register("plate_summary", lambda s, d: P.summary(T.plate(s, d)), f"WITH {PL} SELECT 'P' AS plate, (SELECT count(*) FROM pr) AS n_rows, (SELECT count(*) FROM pc) AS n_columns, (SELECT count(*) FROM pw) AS n_wells, CAST(5 AS BIGINT) AS n_acquisitions, (SELECT count(*) FROM pi) AS n_images")
_register("well_intensity", lambda s, d: P.well_intensity(T.plate(s, d), T.plate_voxels(s, d)).select("well", F.round("intensity", 6).alias("intensity"), "fields"), f"WITH {PL}, f AS (SELECT path, avg(value) AS m FROM pv GROUP BY path) SELECT well, round(avg(m), 6) AS intensity, count(*) AS fields FROM pi JOIN f USING (path) GROUP BY well")
_register("acquisition_series", lambda s, d: P.acquisition_series(T.plate(s, d), T.plate_voxels(s, d)).select("well", "acquisition", F.round("mean", 6).alias("mean")), f"WITH {PL}, o AS (SELECT * FROM pi QUALIFY row_number() OVER (PARTITION BY well, acquisition ORDER BY pos) = 1) SELECT well, acquisition, round(avg(value), 6) AS mean FROM o JOIN pv USING (path) GROUP BY 1, 2")
_register("acquisition_span", lambda s, d: P.acquisition_span(T.plate(s, d)).drop("plate"), "SELECT CAST(o_orderkey % 5 AS INTEGER) AS id, min(o_orderdate) AS started, CAST(epoch(max(o_orderdate)) - epoch(min(o_orderdate)) AS BIGINT) AS seconds FROM orders GROUP BY 1")


def _arriving(s, d):
    """Repeats of all known fields, and every field once more under another name, which arrives twice."""
    p = T.plate(s, d)
    known = p.images.drop("pos")
    new = known.withColumn("path", F.concat(F.lit("n"), "path"))
    return p, known.unionByName(new).unionByName(new)


@query(f"""WITH {PL}, w AS (SELECT well, max(pos) AS last FROM pi GROUP BY well), a AS (SELECT well, 'n' || path AS path, acquisition FROM pi)
    SELECT well, pos, path, acquisition FROM pi UNION ALL
    SELECT well, CAST(last + row_number() OVER (PARTITION BY well ORDER BY a.path, acquisition) AS INTEGER), a.path, acquisition FROM a JOIN w USING (well)""")
def field_upsert(s: SparkSession, d: str) -> DataFrame:
    p, new = _arriving(s, d)
    return P.upsert_fields(p.images, new).drop("plate")


@query(f"WITH {PL} SELECT 'NOROW/NATION0' AS well, 'row' AS problem UNION ALL SELECT 'NOROW/NATION0', 'well' UNION ALL SELECT 'AFRICA/NONE', 'column' UNION ALL SELECT 'AFRICA/NONE', 'well'")
def field_references(s: SparkSession, d: str) -> DataFrame:
    p = T.plate(s, d)
    asked = s.createDataFrame([("P", "NOROW/NATION0"), ("P", "AFRICA/NONE")], "plate string, well string").unionByName(p.wells.select("plate", F.col("path").alias("well")))
    return P.check_references(p, asked).drop("plate")


# Rules -----------------------------------------------------------------------------

_GOOD = '{"axes": [{"name": "y", "type": "space"}, {"name": "x", "type": "space"}], "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1.0, 1.0]}]}]}'
_IMG = [
    ("good", '{"multiscales": [' + _GOOD + "]}"),
    ("one_axis", '{"multiscales": [' + _GOOD.replace('{"name": "y", "type": "space"}, ', "") + "]}"),
    ("no_data", '{"multiscales": [{"axes": [{"name": "y", "type": "space"}, {"name": "x", "type": "space"}], "datasets": []}]}'),
    ("two_scales", '{"multiscales": [' + _GOOD.replace('"coordinateTransformations": [', '"coordinateTransformations": [{"type": "scale", "scale": [1.0, 1.0]}, ') + "]}"),
    ("channels", '{"multiscales": [' + _GOOD + '], "omero": {"channels": [{"color": "red", "window": {"min": 0, "max": 1, "start": 0, "end": 1}}]}}'),
    ("nothing", "{}"),
]
_register("validate_axes", lambda s, d: V.validate(s.createDataFrame(_IMG, "id string, doc string")), """SELECT * FROM (VALUES ('one_axis', 'axes_2_to_5'), ('one_axis', 'space_axes_2_to_3'), ('no_data', 'datasets_at_least_one'), ('two_scales', 'transforms'), ('channels', 'omero_colors'),
    ('nothing', 'multiscales'), ('nothing', 'datasets_at_least_one'), ('nothing', 'axes_2_to_5'), ('nothing', 'space_axes_2_to_3')) t(id, rule)""")
_PLT = [
    ("good", '{"plate": {"rows": [{"name": "A"}], "columns": [{"name": "1"}], "wells": [{"path": "A/1", "rowIndex": 0, "columnIndex": 0}]}}'),
    ("names", '{"plate": {"rows": [{"name": "A-"}], "columns": [{"name": "1"}, {"name": "1"}], "wells": [{"path": "A1", "rowIndex": -1, "columnIndex": 0}], "field_count": 0}}'),
    ("empty", '{"plate": {"rows": [], "columns": [{"name": "1"}], "wells": []}}'),
]
_register("validate_plate", lambda s, d: V.validate(s.createDataFrame(_PLT, "id string, doc string"), model="plate"), "SELECT * FROM (VALUES ('names', 'rows'), ('names', 'columns'), ('names', 'well_paths'), ('names', 'well_indices'), ('names', 'field_count'), ('empty', 'rows'), ('empty', 'wells')) t(id, rule)")
_orient = lambda y, x: '{"multiscales": [{"axes": [{"name": "c", "type": "channel"}, {"name": "y", "type": "space"' + y + '}, {"name": "x", "type": "space"' + x + "}]}]}"
_o = lambda v, t="anatomical": f', "orientation": {{"type": "{t}", "value": "{v}"}}'
_ORI = [("good", _orient(_o("anterior-to-posterior"), _o("right-to-left"))), ("none", _orient("", "")), ("part", _orient(_o("anterior-to-posterior"), "")), ("value", _orient(_o("up-to-down"), _o("right-to-left"))), ("types", _orient(_o("anterior-to-posterior"), _o("right-to-left", "other")))]
_register("validate_orientation", lambda s, d: V.validate(s.createDataFrame(_ORI, "id string, doc string"), model="orientation"), "SELECT * FROM (VALUES ('part', 'orientation_all_or_none'), ('value', 'orientation_value'), ('types', 'orientation_one_type')) t(id, rule)")
_LBL = [("good", '{"ome": {"version": "0.5", "image-label": {"colors": [{"label-value": 1, "rgba": [0, 1, 2, 255]}]}}}'), ("range", '{"image-label": {"colors": [{"label-value": 1, "rgba": [0, 1, 2, 256]}]}}'), ("three", '{"image-label": {"colors": [{"label-value": 1, "rgba": [0, 1, 2]}, {"rgba": [0, 0, 0, 0]}]}}')]
_register("validate_label", lambda s, d: V.validate(s.createDataFrame(_LBL, "id string, doc string"), model="label"), "SELECT * FROM (VALUES ('range', 'rgba'), ('three', 'rgba'), ('three', 'label_values')) t(id, rule)")

# Affines and orientations ------------------------------------------------------------

_AFF = [("diag", 2.0, 0.0, 0.0, 10.0, 0.0, 2.0, 0.0, 20.0, 0.0, 0.0, 2.0, 30.0), ("turn", 0.0, -3.0, 0.0, 1.0, 2.0, 0.0, 0.0, 2.0, 0.0, 0.0, 4.0, 3.0), ("shear", 1.0, 0.5, 0.25, 0.0, 0.0, 1.0, 0.5, 0.0, 0.0, 0.0, 1.0, 0.0)]
_M = [f"m{i}{j}" for i in range(3) for j in range(4)]


def _affines(s):
    return s.createDataFrame(_AFF, "name string, " + ", ".join(f"{c} double" for c in _M))


@query(f"""WITH a AS (SELECT name, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _M)} FROM (VALUES {_sql_rows(_AFF)}) t(name, {', '.join(_M)})),
    s AS (SELECT *, sqrt(m00*m00 + m10*m10 + m20*m20) AS sx, sqrt(m01*m01 + m11*m11 + m21*m21) AS sy, sqrt(m02*m02 + m12*m12 + m22*m22) AS sz FROM a)
    SELECT name, round(sx, 6) AS scale_x, round(sy, 6) AS scale_y, round(sz, 6) AS scale_z, m03 AS translation_x, m13 AS translation_y, m23 AS translation_z,
      round((m00*m01 + m10*m11 + m20*m21) / sx / sy, 6) + 0 AS shear_xy, round((m00*m02 + m10*m12 + m20*m22) / sx / sz, 6) + 0 AS shear_xz, round((m01*m02 + m11*m12 + m21*m22) / sy / sz, 6) + 0 AS shear_yz FROM s""")
def affine_decompose(s: SparkSession, d: str) -> DataFrame:
    parts = X.affine_parts([F.col(c) for c in _M])
    keep = [*(f"scale_{a}" for a in "xyz"), *(f"translation_{a}" for a in "xyz"), "shear_xy", "shear_xz", "shear_yz"]
    return _affines(s).select("name", *[(F.round(parts[k], 6) + 0).alias(k) for k in keep])


_register("axis_codes", lambda s, d: _affines(s).select("name", F.concat(*X.axis_codes([F.col(c) for c in _M])).alias("codes")), "SELECT * FROM (VALUES ('diag', 'RAS'), ('turn', 'ALS'), ('shear', 'RAS')) t(name, codes)")
_register("orientation_lps_ras", lambda s, d: s.createDataFrame([(a,) for a in "tczyx"], "axis string").select("axis", X.lps("axis").alias("lps"), X.ras("axis").alias("ras")), "SELECT * FROM (VALUES ('t', NULL, NULL), ('c', NULL, NULL), ('z', 'inferior-to-superior', 'inferior-to-superior'), ('y', 'anterior-to-posterior', 'posterior-to-anterior'), ('x', 'right-to-left', 'left-to-right')) t(axis, lps, ras)")


@query(f"WITH {E2} SELECT y, x, CAST(2 * x + 1 AS DOUBLE) AS a, CAST(3 * y - 1 AS DOUBLE) AS b FROM e2")
def transform_sequence(s: SparkSession, d: str) -> DataFrame:
    """mapAxis (swap), then an affine, folded over each voxel."""
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    steps = F.array(F.struct(F.lit("mapAxis").alias("kind"), lit([1, 0]).alias("params")), F.struct(F.lit("affine").alias("kind"), lit([2, 0, 1, 0, 3, -1]).alias("params")))
    v = T.embeddings(s, d).voxels
    p = X.apply_sequence(steps, F.array(F.col("y").cast("double"), F.col("x").cast("double")))
    return v.select("y", "x", F.get(p, F.lit(0)).alias("a"), F.get(p, F.lit(1)).alias("b"))


# Chunk layout ------------------------------------------------------------------------


def scratch(s: SparkSession, name: str, suffix: str = "") -> str:
    """A new path in the folder that all machines share; what is there goes when the driver ends."""
    path = f"{shared_root(s)}/{name}-{uuid.uuid4().hex}{suffix}"
    atexit.register(_forget, path)
    return path


def _forget(path: str) -> None:
    fs, p = store.filesystem(path)
    with contextlib.suppress(OSError):
        if fs.get_file_info(p).is_file:
            fs.delete_file(p)
        else:
            fs.delete_dir(p)


def _chunked(s, d, chunk=None) -> C.Chunked:
    return C.from_voxels(T.embeddings(s, d), chunk or {"y": 64, "x": 32}, "int64")


_register("chunk_roundtrip", lambda s, d: C.to_voxels(C.rechunk(_chunked(s, d), {"y": 100, "x": 48})).voxels, f"WITH {E2} SELECT y, x, value FROM e2")
_register("chunk_bin_shrink", lambda s, d: C.to_voxels(C.bin_shrink(_chunked(s, d), {"y": 4, "x": 4})).voxels.withColumn("value", F.round("value", 6)), SQL["bin_shrink_2d"])
_register("chunk_gaussian", lambda s, d: C.to_voxels(C.gaussian(_chunked(s, d), {"y": 2, "x": 2})).voxels.withColumn("value", F.round("value", 4)), SQL["gaussian_2d"])
_register("chunk_mode", lambda s, d: C.to_voxels(C.mode(C.from_voxels(T.labels(s, d), {"y": 64, "x": 32}, "int64"), {"y": 2, "x": 2})).voxels, SQL["mode_2d"])
_register("chunk_hyperslab", lambda s, d: C.to_voxels(C.hyperslab(_chunked(s, d), {"y": (100, 170), "x": (20, 40)})).voxels, f"WITH {E2} SELECT y, x, value FROM e2 WHERE y >= 100 AND y < 170 AND x >= 20 AND x < 40")


def _store(s: SparkSession, d: str, version: str, per_shard, codec: str) -> DataFrame:
    """Write a pyramid as a store in a scratch folder and read its first two levels back."""
    from . import service

    path = scratch(s, "store")
    images, meta = service.chunk_pyramid(_chunked(s, d), [2], "bin_shrink")
    service.write_pyramid(images, meta, path, version, codec, per_shard)
    got, _ = service.read_pyramid(s, path, chunks_per_task=4)
    return Y.as_table([C.to_voxels(c) for c in got]).withColumn("value", F.round("value", 6))


_STORE_SQL = f"WITH {E2}, p1 AS {_mean_level('e2', 2, 2, '(SELECT ny FROM n)', '64')} " + _union(["e2", "p1"], 6)
_register("store_v2_roundtrip", lambda s, d: _store(s, d, "0.4", None, "gzip"), _STORE_SQL)
_register("store_v3_sharded_roundtrip", lambda s, d: _store(s, d, "0.5", {"y": 2, "x": 2}, "zstd"), _STORE_SQL)

# Streaming ---------------------------------------------------------------------------


@query(SQL["field_upsert"])
def stream_field_ingest(s: SparkSession, d: str) -> DataFrame:
    """The batch upsert's rows, through the stream: events from files, merged batch by batch."""
    from .streaming import ingest

    root = scratch(s, "stream")
    p, new = _arriving(s, d)
    ingest.create_table(p.images, f"{root}/table")
    new.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(f"{root}/events")
    events = s.readStream.schema(ingest.EVENTS).parquet(f"{root}/events")
    ingest.ingest(events, f"{root}/table", f"{root}/state").awaitTermination()
    return ingest.read_table(s, f"{root}/table").drop("plate")


from . import queries_rules, queries_stores  # noqa: E402, F401  (they register their queries here)


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Two-level bin-shrink pyramid of the embeddings image."""
    return QUERIES["pyramid_bin_2_4"](s, d)
