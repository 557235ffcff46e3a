"""Voxel and chunk paths against plain numpy."""

import numpy as np
import pytest

from tessera.model import ImageMeta
from tessera.operators import chunks as C
from tessera.operators import downsample as D
from tessera.operators import layout as L
from tessera.operators import pyramid as Y
from tessera.plans import levels
from tessera.sources.tables import Image, dense, from_table


def image(spark, x, dims):
    at = np.indices(x.shape).reshape(len(dims), -1).tolist()
    rows = list(zip(*at, x.ravel().tolist(), strict=True))
    return Image(spark.createDataFrame(rows, ", ".join([*(f"{d} long" for d in dims), "value long"])), ImageMeta(tuple(dims), dict(zip(dims, x.shape, strict=True))))


def array(im):
    out = np.full([im.meta.shape[d] for d in im.meta.dims], np.nan)
    for r in im.voxels.collect():
        at = tuple(r[d] for d in im.meta.dims)
        assert np.isnan(out[at]), "a place twice"
        out[at] = r["value"]
    return out


def brute(x, dims, step, method):
    """Each output from its window, by definition."""
    k = [step.get(d, 1) for d in dims]
    n = [s // f for s, f in zip(x.shape, k, strict=True)]
    out = np.zeros(n)
    cut = levels.truncate({d: levels.sigma(f) for d, f in zip(dims, k, strict=True)}, dict(zip(dims, x.shape, strict=True)))
    for i in np.ndindex(*n):
        if method == "bin_shrink":
            out[i] = x[tuple(slice(a * f, a * f + f) for a, f in zip(i, k, strict=True))].mean()
        elif method == "nearest":
            out[i] = x[tuple(a * f for a, f in zip(i, k, strict=True))]
        else:
            taps = [{"gaussian": levels.kernel(f, cut), "discrete_gaussian": levels.discrete_kernel(f), "mode": [(o, 1) for o in range(-(f // 2), f - f // 2)], "label": levels.vote_weights(f)}[method] for f in k]
            votes = {}
            for offs in np.ndindex(*[len(t) for t in taps]):
                w = np.prod([t[o][1] for t, o in zip(taps, offs, strict=True)])
                p = tuple(min(max(a * f + t[o][0], 0), s - 1) for a, f, t, o, s in zip(i, k, taps, offs, x.shape, strict=True))
                votes[x[p]] = votes.get(x[p], 0) + w
            out[i] = sum(v * w for v, w in votes.items()) if "gaussian" in method else min(votes, key=lambda v: (-votes[v], v))
    return out


CASES = [
    (("y", "x"), (9, 7), {"y": 2, "x": 3}),
    (("y", "x"), (1, 6), {"y": 1, "x": 2}),
    (("y", "x"), (5, 5), {"y": 4, "x": 4}),
    (("z", "c", "y", "x"), (4, 2, 5, 6), {"z": 2, "y": 2, "x": 2}),
    (("t", "y", "x", "c"), (2, 4, 4, 3), {"y": 2, "x": 4}),
]
VOXEL = {"bin_shrink": D.bin_shrink, "nearest": D.nearest, "gaussian": D.gaussian, "discrete_gaussian": D.discrete_gaussian, "mode": D.mode, "label": D.label_vote}


@pytest.mark.parametrize("method", sorted(VOXEL))
@pytest.mark.parametrize(("dims", "shape", "step"), CASES)
def test_voxel_methods(spark, method, dims, shape, step):
    x = np.random.default_rng(len(dims)).integers(0, 5, shape)
    got = VOXEL[method](image(spark, x, dims), step)
    np.testing.assert_allclose(array(got), brute(x, dims, step, method), atol=1e-9)
    assert got.meta.dims == tuple(dims)


@pytest.mark.parametrize("method", ["bin_shrink", "nearest", "gaussian", "discrete_gaussian", "mode"])
@pytest.mark.parametrize("chunk", [{"y": 4, "x": 6}, {"y": 2, "x": 3}, {"y": 100, "x": 100}])
def test_chunk_methods_equal_brute_force(spark, method, chunk):
    x = np.random.default_rng(1).integers(0, 5, (11, 13))
    step = {"y": 2, "x": 3}
    im = C.from_voxels(image(spark, x, ("y", "x")), chunk, "int64")
    f = {"bin_shrink": C.bin_shrink, "nearest": C.nearest, "gaussian": C.gaussian, "discrete_gaussian": C.discrete_gaussian, "mode": C.mode}[method]
    np.testing.assert_allclose(array(C.to_voxels(f(im, step))), brute(x, ("y", "x"), step, method), atol=1e-9)


def test_chunks_must_be_whole_bins(spark):
    x = np.arange(30).reshape(5, 6)
    im = C.from_voxels(image(spark, x, ("y", "x")), {"y": 3, "x": 3}, "int64")
    with pytest.raises(ValueError, match="rechunk"):
        C.bin_shrink(im, {"y": 2, "x": 2})


@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint32", "uint64", "float32", "float64", "bool"])
def test_chunk_layout_keeps_samples(spark, dtype):
    x = np.random.default_rng(2).integers(0, 2, (5, 7, 3))
    im = C.from_voxels(image(spark, x, ("z", "y", "x")), {"z": 2, "y": 3, "x": 2}, dtype)
    np.testing.assert_array_equal(array(C.to_voxels(C.rechunk(im, {"z": 3, "y": 5, "x": 1}))), x)
    turned = C.to_voxels(C.transpose(im, ("x", "z", "y")))
    np.testing.assert_array_equal(array(turned), x.transpose(2, 0, 1))


def test_layout_operators(spark):
    x = np.arange(2 * 3 * 4 * 5).reshape(2, 3, 4, 5)
    im = image(spark, x, ("t", "c", "y", "x"))
    im.meta.units["t"] = "second"
    one = L.take(im, "t", 1)
    np.testing.assert_array_equal(array(one), x[1])
    assert "t" not in one.meta.units and one.meta.dims == ("c", "y", "x")
    np.testing.assert_array_equal(array(L.transpose(im, "channel_last")), x.transpose(0, 2, 3, 1))
    np.testing.assert_array_equal(array(L.concat(L.array_split(im, 3, "x"), "x")), x)
    np.testing.assert_array_equal(array(L.hyperslab(im, {"y": (1, 3)}, shift=True)), x[:, :, 1:3])
    assert L.hyperslab(im, {"y": (1, 3)}, shift=True).meta.translation["y"] == 1.0
    np.testing.assert_array_equal(array(L.stack([one, one], "t")), np.stack([x[1], x[1]]))
    with pytest.raises(IndexError):
        L.take(im, "c", 3)
    assert L.difference(im, im).count() == 0
    assert L.cast(im, "float32").voxels.schema["value"].dataType.simpleString() == "float"


def test_sparse_tables_become_dense(spark):
    df = spark.createDataFrame([(0, 2, 5), (3, 0, 7)], "y int, x int, value long")
    im = dense(from_table(df, ("y", "x")))
    want = np.zeros((4, 3))
    want[0, 2], want[3, 0] = 5, 7
    np.testing.assert_array_equal(array(im), want)
    empty = from_table(df.limit(0), ("y", "x"))
    assert dense(empty).voxels.count() == 0 and D.bin_shrink(empty, 2).voxels.count() == 0


@pytest.mark.parametrize("method", ["ITKWASM_GAUSSIAN", "ITK_BIN_SHRINK", "ITKWASM_LABEL_IMAGE", "DASK_IMAGE_MODE", "DASK_IMAGE_NEAREST"])
def test_pyramids_cover_one_extent(spark, method):
    x = np.zeros((32, 32), int)
    im = image(spark, x, ("y", "x"))
    im.meta.scale.update({"y": 0.25, "x": 0.25})
    images, meta = Y.build(im, [2, 4, 8], method)
    assert [m.meta.shape["y"] for m in images] == [32, 16, 8, 4]
    assert {r.extent for r in Y.extent(images).collect()} == {8.0}
    assert Y.as_table(images).count() == 32 * 32 + 16 * 16 + 8 * 8 + 4 * 4
    Y.release(images)
    assert len(meta.images) == 4


def test_plans_do_not_shuffle_where_they_need_not(spark):
    x = np.zeros((8, 8), int)
    plan = lambda im: im.voxels._jdf.queryExecution().executedPlan().toString()
    im = image(spark, x, ("y", "x"))
    assert "Exchange" not in plan(D.nearest(im, 2))
    assert plan(D.bin_shrink(im, 2)).count("Exchange hashpartitioning") == 1 and "Python" not in plan(D.gaussian(im, 2))
    c = C.Chunked(spark.createDataFrame([], C.SCHEMA), ImageMeta(("y", "x"), {"y": 8, "x": 8}, chunk={"y": 4, "x": 4}))
    assert "Exchange" not in c.chunks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in C.bin_shrink(c, {"y": 2, "x": 2}).chunks._jdf.queryExecution().executedPlan().toString()
