"""Queries of functions, documents and rules; documents are built from tables, and SQL states what they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as X
from .model import METHOD_ALIASES
from .operators import chunks as C
from .operators import layout as L
from .operators import metadata as M
from .operators import plate as P
from .operators import validate as V
from .plans import levels
from .queries import E2, PL, V4, _linear, _NC, _register, _sql_rows, query
from .sources import backends
from .sources import tables as T

K = lambda: F.col("n_nationkey")
_text = lambda c: c.cast("string")


def _nation(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/nation.parquet")


def _json(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Functions -----------------------------------------------------------------------

_register("path_building", lambda s, d: _nation(s, d).select("n_nationkey", X.level_path("n_nationkey", "n_name").alias("level"), X.well_path("n_name", _text(K())).alias("well")), "SELECT n_nationkey, 'scale' || n_nationkey || '/' || n_name AS level, n_name || '/' || n_nationkey AS well FROM nation")
_register("path_parent", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", X.path_parent("url").alias("parent")), "SELECT page_id, regexp_replace(url, '/?[^/]*$', '') AS parent FROM pages")
_UNITS = ("", "B", "kB", "KiB", "MB", "MiB", "GB", "GiB")
_register(
    "byte_sizes",
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", X.byte_size(F.concat(_text(F.col("p_size")), F.get(F.array(*map(F.lit, _UNITS)), (F.col("p_partkey") % 8).cast("int")))).alias("bytes")),
    "SELECT p_partkey, CAST(CAST(p_size AS BIGINT) * CASE p_partkey % 8 WHEN 2 THEN 1000 WHEN 3 THEN 1024 WHEN 4 THEN 1000000 WHEN 5 THEN 1048576 WHEN 6 THEN 1000000000 WHEN 7 THEN 1073741824 ELSE 1 END AS BIGINT) AS bytes FROM part",
)
_register(
    "unit_pairs",
    lambda s, d: _nation(s, d).select("n_nationkey", X.pairs(F.array(F.lit("X"), _text(K() / 2), F.lit("y"), _text(K() + 1))).alias("m")).select("n_nationkey", F.col("m")["x"].alias("x"), F.col("m")["y"].alias("y")),
    "SELECT n_nationkey, n_nationkey / 2.0::DOUBLE AS x, CAST(n_nationkey + 1 AS DOUBLE) AS y FROM nation",
)
_zyx = lambda: F.array(*map(F.lit, "zyx"))
_given = lambda: F.map_from_arrays(F.when(K() % 2 == 0, F.array(F.lit("y"))).otherwise(F.array(F.lit("y"), F.lit("x"))), F.when(K() % 2 == 0, F.array(K().cast("double"))).otherwise(F.array(K().cast("double"), K() / 4)))
_at = lambda m: [F.try_element_at(m, F.lit(a)).alias(a) for a in "zyx"]
_register("map_default_fill", lambda s, d: _nation(s, d).select("n_nationkey", *_at(X.filled_map(_zyx(), _given(), 1.0))), "SELECT n_nationkey, 1.0::DOUBLE AS z, CAST(n_nationkey AS DOUBLE) AS y, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey / 4.0::DOUBLE ELSE 1.0 END AS x FROM nation")
_register("map_override", lambda s, d: _nation(s, d).select("n_nationkey", *_at(X.overridden(F.create_map(F.lit("z"), F.lit(7.0), F.lit("y"), F.lit(8.0)), _given()))), "SELECT n_nationkey, 7.0::DOUBLE AS z, CAST(n_nationkey AS DOUBLE) AS y, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey / 4.0::DOUBLE END AS x FROM nation")
_register("default_dims", lambda s, d: s.range(1, 6).select("id", F.concat_ws(",", X.default_dims(F.col("id").cast("int"))).alias("dims")), "SELECT id, CASE WHEN id <= 3 THEN array_to_string(list_slice(['z', 'y', 'x'], 4 - id, 3), ',') WHEN id = 4 THEN 'z,y,x,c' ELSE 't,z,y,x,c' END AS dims FROM range(1, 6) t(id)")

_ORDERS = [(a, b) for a in ("t,c,z,y,x", "z,y,x,c", "y,x", "x,y,z", "c,t,x,y") for b in ("t,c,z,y,x", "x,y", "y,x", "c")]
_orders = lambda s: s.createDataFrame(_ORDERS, "a string, b string").select("a", "b", F.split("a", ",").alias("la"), F.split("b", ",").alias("lb"))
_OSQL = f"(SELECT a, b, string_split(a, ',') AS la, string_split(b, ',') AS lb FROM (VALUES {_sql_rows(_ORDERS)}) t(a, b))"
_register("axis_permutation", lambda s, d: _orders(s).select("a", "b", F.concat_ws(",", F.transform(X.permutation("la", "lb"), lambda i: F.coalesce(i, F.lit(-1)).cast("string"))).alias("places")), f"SELECT a, b, array_to_string(list_transform(lb, lambda x: CAST(coalesce(list_position(la, x), 0) - 1 AS VARCHAR)), ',') AS places FROM {_OSQL}")
_register("dims_subset", lambda s, d: _orders(s).select("a", "b", X.is_subset("lb", "la").alias("inside")), f"SELECT a, b, list_has_all(la, lb) AS inside FROM {_OSQL}")
_register("sorted_dims", lambda s, d: _orders(s).select("a", "b", F.concat_ws(",", X.itk_order("la")).alias("sorted")), f"SELECT a, b, array_to_string(list_concat(list_filter(list_sort(la), lambda x: x <> 't'), list_filter(la, lambda x: x = 't')), ',') AS sorted FROM {_OSQL}")
_register(
    "axis_types",
    lambda s, d: _orders(s).select("a", "b", F.explode("la").alias("axis")).select("a", "b", "axis", X.axis_type("axis").alias("type")),
    f"SELECT a, b, axis, CASE axis WHEN 't' THEN 'time' WHEN 'c' THEN 'channel' ELSE 'space' END AS type FROM (SELECT a, b, unnest(la) AS axis FROM {_OSQL})",
)
_register(
    "itk_geometry",
    lambda s, d: _nation(s, d)
    .select("n_nationkey", X.itk_dims((K() % 3 + 2).cast("int"), K() % 2 + 1).alias("dims"), F.slice(F.array(K() + 1, K() + 2, K() + 3, K() + 4), 1, (K() % 3 + 2).cast("int")).alias("spacing"))
    .select("n_nationkey", F.concat_ws(",", "dims").alias("dims"), X.by_axis("dims", "spacing").alias("m"))
    .select("n_nationkey", "dims", *[F.try_element_at("m", F.lit(a)).alias(a) for a in "xyzt"]),
    """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'y,x' WHEN 1 THEN 'z,y,x' ELSE 't,z,y,x' END || CASE WHEN n_nationkey % 2 = 1 THEN ',c' ELSE '' END AS dims,
    n_nationkey + 1 AS x, n_nationkey + 2 AS y, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey + 3 END AS z, CASE WHEN n_nationkey % 3 = 2 THEN n_nationkey + 4 END AS t FROM nation""",
)
_register(
    "pixel_types",
    lambda s, d: _nation(s, d).select("n_nationkey", X.pixel_type(F.when(K() % 2 == 0, "uint8").otherwise("float32"), K() % 5 + 1).alias("pixel")),
    "SELECT n_nationkey, CASE WHEN n_nationkey % 5 + 1 = 3 AND n_nationkey % 2 = 0 THEN 'RGB' WHEN n_nationkey % 5 + 1 > 1 THEN 'VariableLengthVector' ELSE 'Scalar' END AS pixel FROM nation",
)
_register(
    "truncate_by_size",
    lambda s, d: s.range(2, 33).select("id", F.explode(F.array(*map(F.lit, (1, 2, 5, 20, 100)))).alias("n")).select("id", "n", X.truncation(X.sigma("id"), "n").alias("cut")),
    "SELECT id, CAST(n AS INTEGER) AS n, max(c / 2.0::DOUBLE) AS cut FROM range(2, 33) t(id), (VALUES (1), (2), (5), (20), (100)) u(n), range(0, 9) v(c) WHERE c = 0 OR floor(c / 2.0 * sqrt((id * id - 1) / (8 * ln(2.0::DOUBLE))) + 0.5) <= n GROUP BY 1, 2",
)
_register(
    "relative_factors",
    lambda s, d: s.range(1, 9).select("id", F.pow(F.lit(2), "id").cast("int").alias("f"), F.pow(F.lit(2), F.floor(F.col("id") / 2)).cast("int").alias("p")).select("id", X.relative_factor("f", "p").alias("step"), X.next_scale(F.lit(0.5), "f").alias("scale"), X.next_translation(F.lit(1.0), F.lit(0.5), "f").alias("translation")),
    "SELECT id, CAST(2 ** id // 2 ** (id // 2) AS INTEGER) AS step, 0.5::DOUBLE * 2 ** id AS scale, 1.0::DOUBLE + 0.5 * (2 ** id - 1) * 0.5 AS translation FROM range(1, 9) t(id)",
)
_FACTORS = [(a, b, n) for a in (2, 3, 4) for b in (2, 6, 8) for n in (1, 7, 64, 100)]


@query(f"SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(n AS INTEGER) AS n, CAST(lcm(a, b) * greatest(1, n // lcm(a, b)) AS BIGINT) AS chunk FROM (VALUES {_sql_rows(_FACTORS)}) t(a, b, n)")
def align_chunks(s: SparkSession, d: str) -> DataFrame:
    rows = [(a, b, n, levels.aligned_chunk({"x": n}, [{"x": a}, {"x": b}])["x"]) for a, b, n in _FACTORS]
    return s.createDataFrame(rows, "a int, b int, n int, chunk long")


@query("SELECT CAST(a AS INTEGER) AS iz, CAST(b AS INTEGER) AS iy, CAST(c AS INTEGER) AS ix FROM range(3) t(a), range(5) u(b), range(4) v(c)")
def chunk_enumeration(s: SparkSession, d: str) -> DataFrame:
    return C._all_indices(s, [3, 5, 4]).select(*[F.get("idx", F.lit(i)).alias(f"i{a}") for i, a in enumerate("zyx")])


_register("method_names", lambda s, d: backends.methods(s).select("name", "method"), f"""SELECT name, CASE WHEN name LIKE '%BIN_SHRINK' THEN 'bin_shrink' WHEN name LIKE 'ITK%GAUSSIAN' THEN 'discrete_gaussian' WHEN name LIKE '%GAUSSIAN' THEN 'gaussian'
    WHEN name LIKE '%LABEL_IMAGE' THEN 'label_image' WHEN name LIKE '%MODE' THEN 'mode' ELSE 'nearest' END AS method FROM (VALUES {_sql_rows([(n,) for n in METHOD_ALIASES])}) t(name)""")
_register("spatial_last", _linear("spatial_last"), f"WITH {V4} SELECT ((t * {_NC} + c) * 24 + y) * 16 + x AS at, value FROM v4")
_register("cast_samples", lambda s, d: L.cast(T.embeddings(s, d), "float32").voxels.withColumn("value", (F.col("value") / 2).cast("double")), f"WITH {E2} SELECT y, x, CAST(CAST(value AS FLOAT) / 2 AS DOUBLE) AS value FROM e2")


@query(f"WITH {E2} SELECT y, x, 3.0::DOUBLE * x + 1 AS a, 2.0::DOUBLE * y AS b, CAST(y AS DOUBLE) AS back_a, CAST(x AS DOUBLE) AS back_b FROM e2")
def transform_kinds(s: SparkSession, d: str) -> DataFrame:
    """byDimension (two axes, each its own transforms) on swapped axes; and a bijection: there and back by the inverse."""
    lit = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    v = T.embeddings(s, d).voxels.withColumn("p", F.array(F.col("y").cast("double"), F.col("x").cast("double")))
    v = v.withColumn("p", X.compose(F.lit("mapAxis"), lit(1, 0), F.col("p")))
    v = v.withColumn("p", X.by_dimension([([0], F.lit("scale"), lit(3)), ([1], F.lit("scale"), lit(2))], F.col("p")))
    v = v.withColumn("p", X.by_dimension([([0], F.lit("translation"), lit(1))], F.col("p")))
    v = v.withColumn("q", X.by_dimension([([0], *X.inverse(F.lit("translation"), lit(1)))], F.col("p")))
    for kind, params in (("scale", (3, 2)), ("mapAxis", (1, 0))):
        v = v.withColumn("q", X.compose(*X.inverse(F.lit(kind), lit(*params)), F.col("q")))
    at = lambda c, i: F.get(c, F.lit(i))
    return v.select("y", "x", at("p", 0).alias("a"), at("p", 1).alias("b"), F.round(at("q", 0), 9).alias("back_a"), F.round(at("q", 1), 9).alias("back_b"))


# Documents -------------------------------------------------------------------------


@query("""SELECT n_nationkey, n_nationkey + 1.0::DOUBLE AS sy, 2.0::DOUBLE * n_nationkey + 1 AS sx, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE CAST(n_nationkey AS DOUBLE) END AS ty, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE -CAST(n_nationkey AS DOUBLE) END AS tx FROM nation""")
def transform_maps(s: SparkSession, d: str) -> DataFrame:
    """Scale and translation by axis, out of each document's transforms; a third have no translation."""
    shift = F.when(K() % 3 == 0, "").otherwise(_json(', {"type": "translation", "translation": [', K(), ", ", -K(), "]}"))
    doc = _json('{"multiscales": [{"axes": [{"name": "y", "type": "space"}, {"name": "x", "type": "space"}], "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [', K() + 1, ", ", 2 * K() + 1, "]}", shift, "]}]}]}")
    image = M.parse_images(_nation(s, d).select("n_nationkey", doc.alias("doc")))
    scale, translation = M.scale_maps(F.transform("image.axes", lambda a: a["name"]), F.get("image.datasets", F.lit(0))["coordinateTransformations"])
    out = image.select("n_nationkey", scale.alias("s"), translation.alias("t"))
    return out.select("n_nationkey", F.col("s")["y"].alias("sy"), F.col("s")["x"].alias("sx"), F.col("t")["y"].alias("ty"), F.col("t")["x"].alias("tx"))


_VERSIONS = ("0.1", "0.2", "0.3", "0.4", "0.5")
_version = lambda: F.get(F.array(*map(F.lit, _VERSIONS)), (K() % 5).cast("int"))


def _versioned(s: SparkSession, d: str) -> DataFrame:
    """A document of each version, with none to six axes: plain names in 0.3, objects in others, a namespace in 0.5."""
    names = F.slice(F.array(*map(F.lit, "xyzcta")), 1, (K() % 7).cast("int"))
    objects = F.to_json(F.transform(names, lambda n: F.struct(n.alias("name"), F.coalesce(X.axis_type(n), F.lit("other")).alias("type"))))
    axes = F.when(K() % 5 == 2, F.to_json(names)).otherwise(objects)
    body = _json('"multiscales": [{"axes": ', axes, ', "version": "', _version(), '", "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1, 1]}]}]}]')
    doc = F.when(K() % 5 == 4, _json('{"ome": {"version": "0.5", ', body, "}}")).otherwise(_json("{", body, "}"))
    return _nation(s, d).select(_text(K()).alias("id"), doc.alias("doc"))


@query("""WITH k AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_nationkey % 5 AS v, n_nationkey % 7 AS n FROM nation)
    SELECT id, 'axes_2_to_5' AS rule FROM k WHERE v >= 2 AND (n < 2 OR n > 5) UNION ALL
    SELECT id, 'space_axes_2_to_3' FROM k WHERE v >= 3 AND least(n, 3) < 2 UNION ALL
    SELECT id, 'axes_letters' FROM k WHERE v = 2 AND n = 6""")
def validate_versions(s: SparkSession, d: str) -> DataFrame:
    return V.validate(_versioned(s, d))


_register("document_versions", lambda s, d: M.parse_images(_versioned(s, d)).select("id", "version", F.coalesce(F.size("image.axes"), F.lit(0)).alias("axes")), f"SELECT CAST(n_nationkey AS VARCHAR) AS id, list_extract({list(_VERSIONS)}, CAST(n_nationkey % 5 + 1 AS BIGINT)) AS version, CAST(n_nationkey % 7 AS INTEGER) AS axes FROM nation")


@query("""WITH k AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_nationkey AS k FROM nation)
    SELECT id, 'strict_name' AS rule FROM k WHERE k % 2 = 1 UNION ALL SELECT id, 'strict_type' FROM k WHERE k % 3 = 1 UNION ALL SELECT id, 'strict_metadata' FROM k WHERE k % 4 <> 0 UNION ALL SELECT id, 'strict_version' FROM k WHERE k % 5 = 0""")
def validate_strict(s: SparkSession, d: str) -> DataFrame:
    when = lambda ok, text: F.when(ok, text).otherwise("")
    body = _json('{"multiscales": [{', when(K() % 2 == 0, '"name": "n", '), when(K() % 3 != 1, '"type": "t", '), when(K() % 4 == 0, '"metadata": {"method": "m"}, '), when(K() % 5 != 0, '"version": "0.4", '))
    doc = F.concat(body, F.lit('"axes": [{"name": "y", "type": "space"}, {"name": "x", "type": "space"}], "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1, 1]}]}]}]}'))
    return V.validate(_nation(s, d).select(_text(K()).alias("id"), doc.alias("doc")), strict=True)


@query(f"""WITH {PL}, w AS (SELECT well, bool_or(CAST(path AS BIGINT) % 7 = 0) AS bad FROM pi GROUP BY well) SELECT well AS id, 'paths' AS rule FROM w WHERE bad""")
def validate_well(s: SparkSession, d: str) -> DataFrame:
    """Well documents of the plate, some field names with a character that names may not have."""
    images = T.plate(s, d).images.withColumn("path", F.when(F.col("path").cast("long") % 7 == 0, F.concat(F.lit("-"), "path")).otherwise(F.col("path")))
    return V.validate(P.well_documents(images, "0.5").select(F.col("well").alias("id"), "doc"), model="well")


@query("""SELECT 'l' || n_nationkey AS id, 'layout_is_3' AS rule FROM nation WHERE n_nationkey % 4 <> 3 UNION ALL
    SELECT 's' || n_nationkey, 'series' FROM nation WHERE n_nationkey % 2 = 0""")
def validate_containers(s: SparkSession, d: str) -> DataFrame:
    """Containers of layouts 0 to 3, and lists of series, every second with a null in it."""
    rows = _nation(s, d)
    one = V.validate(rows.select(F.concat(F.lit("l"), _text(K())).alias("id"), _json('{"bioformats2raw.layout": ', K() % 4, "}").alias("doc")), model="layout")
    two = V.validate(rows.select(F.concat(F.lit("s"), _text(K())).alias("id"), _json('{"ome": {"series": ["0", ', F.when(K() % 2 == 0, "null").otherwise('"1"'), "]}}").alias("doc")), model="series")
    return one.unionByName(two)


@query(f"""WITH {PL}, w AS (SELECT row AS plate, col, row_number() OVER (PARTITION BY row ORDER BY column_index) - 1 AS i, column_index AS k FROM pw)
    SELECT plate, 'A/' || col AS path, CAST(0 AS INTEGER) AS row_index, CAST(i AS INTEGER) AS column_index FROM w WHERE k % 4 <> 1""")
def malformed_wells(s: SparkSession, d: str) -> DataFrame:
    """A plate for each region with a well for each nation; wells that lack an index are left out."""
    p = T.plate(s, d)
    named = p.wells.withColumns({"row": F.split_part("path", F.lit("/"), F.lit(1)), "col": F.split_part("path", F.lit("/"), F.lit(2))})
    groups = named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("column_index", "col"))).alias("c"))
    index = lambda x, i: F.when(x["column_index"] % 4 == 1, "").otherwise(_json(', "columnIndex": ', i))
    wells = F.concat_ws(", ", F.transform("c", lambda x, i: _json('{"path": "A/', x["col"], '", "rowIndex": 0', index(x, i), "}")))
    columns = F.concat_ws(", ", F.transform("c", lambda x: _json('{"name": "', x["col"], '"}')))
    doc = _json('{"plate": {"rows": [{"name": "A"}], "columns": [', columns, '], "wells": [', wells, "]}}")
    return P.from_documents(groups.select(F.col("row").alias("plate"), doc.alias("doc"))).wells


_register(
    "plate_columns",
    lambda s, d: _plates(s, d).columns,
    f"WITH {PL} SELECT row AS plate, CAST(row_number() OVER (PARTITION BY row ORDER BY column_index) - 1 AS INTEGER) AS pos, col AS name FROM pw",
)


def _plates(s: SparkSession, d: str):
    """The same plates as tables."""
    p = T.plate(s, d)
    named = p.wells.withColumns({"row": F.split_part("path", F.lit("/"), F.lit(1)), "col": F.split_part("path", F.lit("/"), F.lit(2))})
    groups = named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("column_index", "col"))).alias("c"))
    names = F.concat_ws(", ", F.transform("c", lambda x: _json('{"name": "', x["col"], '"}')))
    wells = F.concat_ws(", ", F.transform("c", lambda x, i: _json('{"path": "A/', x["col"], '", "rowIndex": 0, "columnIndex": ', i, "}")))
    doc = _json('{"ome": {"version": "0.5", "plate": {"rows": [{"name": "A"}], "columns": [', names, '], "wells": [', wells, "]}}}")
    return P.from_documents(groups.select(F.col("row").alias("plate"), doc.alias("doc")))


@query(f"WITH {PL}, w AS (SELECT row AS plate, col, row_number() OVER (PARTITION BY row ORDER BY column_index) - 1 AS i FROM pw) SELECT plate, CAST(0 AS INTEGER) AS row_index, CAST(i AS INTEGER) AS column_index, 'A/' || col AS well FROM w")
def wells_of_plates(s: SparkSession, d: str) -> DataFrame:
    """Look-up by indices in several plates at once; each asks its own lists."""
    p = _plates(s, d)
    return P.well_by_index(p, p.wells.select("plate", "row_index", "column_index"))


@query(f"WITH {PL} SELECT well, pos, path, acquisition FROM pi")
def well_documents(s: SparkSession, d: str) -> DataFrame:
    """The plate's field lists as documents of wells, and back."""
    return P.images_from_documents(P.well_documents(T.plate(s, d).images, "0.4")).drop("plate")


@query(f"""WITH {PL}, w AS (SELECT well, max(pos) AS last FROM pi GROUP BY well), o AS (SELECT DISTINCT well FROM pi)
    SELECT well, pos, path, CASE WHEN pos > 0 THEN acquisition END AS acquisition FROM pi UNION ALL
    SELECT well, last + 1, 'new', NULL FROM o JOIN w USING (well)""")
def field_upsert_null(s: SparkSession, d: str) -> DataFrame:
    """Upsert of fields without an acquisition: known ones are not added again."""
    images = T.plate(s, d).images.withColumn("acquisition", F.when(F.col("pos") > 0, F.col("acquisition")))
    new = images.select("plate", "well", F.lit("new").alias("path"), F.lit(None).cast("int").alias("acquisition"))
    return P.upsert_fields(images, images.drop("pos").unionByName(new)).drop("plate")
