from pyspark.sql import functions as F

from tessera.functions import columns as X


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_strings(spark):
    assert one(spark, X.suffixes(F.lit("/a/b.OME.Zarr")), X.suffixes(F.lit("a")), X.path_parent(F.lit("a/b/c")), X.level_path(F.lit(2), F.lit("im")), X.well_path(F.lit("A"), F.lit("1"))) == (".ome.zarr", "", "a/b", "scale2/im", "A/1")
    assert one(spark, X.dtype_name(F.lit("<u2")), X.dtype_name(F.lit("uint8")), X.pixel_type(F.lit("uint8"), F.lit(3)), X.pixel_type(F.lit("int16"), F.lit(2))) == ("uint16", "uint8", "RGB", "VariableLengthVector")
    assert one(spark, X.is_url(F.lit("https://a/b")), X.is_url(F.lit("/a/b")), X.is_s3(F.lit("s3://a")), X.is_store(F.lit("a.zarr/"))) == (True, False, True, True)
    assert one(spark, X.valid_well_path(F.lit("A/1")), X.valid_well_path(F.lit("A1")), X.valid_name(F.lit("A-")), X.valid_orientation(F.lit("left-to-right"))) == (True, False, False, True)


def test_maps_and_arrays(spark):
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    dims = F.array(F.lit("y"), F.lit("x"))
    got = one(spark, X.filled_map(dims, m(x=2.0), 1.0), X.overridden(m(x=1.0, y=2.0), m(x=5.0)), X.next_scale_map(m(x=0.5, c=1.0), m(x=4)), X.next_translation_map(m(x=10.0, c=0.0), m(x=0.5, c=1.0), m(x=4)))
    assert got == ({"y": 1.0, "x": 2.0}, {"y": 2.0, "x": 5.0}, {"x": 2.0, "c": 1.0}, {"x": 10.75, "c": 0.0})
    assert one(spark, X.permutation(F.array(F.lit("y"), F.lit("x")), F.array(F.lit("x"), F.lit("y"))), X.is_subset(dims, dims), X.default_dims(F.lit(2)), X.default_dims(F.lit(4))) == ([1, 0], True, ["y", "x"], ["z", "y", "x", "c"])
    assert one(spark, X.default_dims(F.lit(6)), X.component_type(F.lit("float16")), X.lps(F.lit("c"))) == (None, None, None)


def test_scaling_of_stored_samples(spark):
    v = F.lit(3)
    assert one(spark, X.unscaled(v, F.lit(2.0), F.lit(1.0)), X.unscaled(v, F.lit(0.0), F.lit(None).cast("double")), X.unscaled(v, F.lit(float("nan")), F.lit(float("nan")))) == (7.0, 3.0, 3.0)


def test_transforms(spark):
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    p = lit([1, 2])
    t = lambda kind, v: X.compose(F.lit(kind), lit(v), p)
    assert one(spark, t("translation", [1, 1]), t("scale", [2, 3]), t("mapAxis", [1, 0]), t("affine", [0, 1, 5, 1, 0, 0]), t("rotation", [0, -1, 1, 0]), t("identity", [0])) == ([2, 3], [2, 6], [2, 1], [7, 1], [-2, 1], [1, 2])
