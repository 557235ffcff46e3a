import itertools
import math
import random

import pytest

from tessera.model import Axis, Channel, ImageMeta, MetadataError, Method, Window
from tessera.plans import levels as L


@pytest.mark.parametrize(
    ("shape", "chunk", "least", "want"),
    [
        ({"y": 30, "x": 30}, {"y": 64, "x": 64}, 64, []),
        ({"y": 520, "x": 520}, {"y": 64, "x": 64}, 64, [{"y": k, "x": k} for k in (2, 4, 8)]),
        ({"z": 10, "y": 530, "x": 530}, {"z": 64, "y": 64, "x": 64}, 64, [{"z": 1, "y": k, "x": k} for k in (2, 4, 8)]),
        ({"t": 1, "z": 125, "y": 1024, "x": 1024}, {"t": 1, "z": 50, "y": 51, "x": 50}, 51, [{"z": z, "y": k, "x": k} for z, k in ((1, 2), (1, 4), (1, 8), (2, 16))]),
    ],
)
def test_automatic_levels(shape, chunk, least, want):
    assert L.auto_factors(shape, chunk, least) == want


def test_kernels():
    assert [round(L.sigma(k), 6) for k in (1, 2, 4)] == [0.0, 0.735534, 1.644705]
    for k in (2, 3, 4, 8):
        taps = L.kernel(k)
        assert abs(sum(w for _, w in taps) - 1) < 1e-12 and taps == [(o, w) for o, w in taps if w == dict(taps)[-o]]
    assert L.kernel(1) == [(0, 1.0)]
    assert L.truncate({"x": L.sigma(8)}, {"x": 5}) < 4
    assert L.vote_weights(1) == [(0, 2)]
    assert L.vote_weights(2) == [(-1, 1), (0, 3), (1, 3), (2, 1)]


def test_geometry():
    s, t = L.next_geometry({"y": 0.35, "x": 0.35}, {"y": 20.0, "x": 30.0}, {"y": 2, "x": 2})
    assert s == {"y": 0.7, "x": 0.7} and t["y"] == pytest.approx(20.175)
    im = ImageMeta(("y", "x"), {"y": 256, "x": 256})
    shapes, moves = [], []
    for step in ({}, {"y": 2, "x": 2}, {"y": 2, "x": 2}):
        im = L.next_meta(im, step)
        shapes.append(im.shape["y"])
        moves.append(im.translation["y"])
    assert shapes == [256, 128, 64] and moves == [0.0, 0.5, 1.5]


def test_steps():
    assert L.steps([{"x": 2}, {"x": 4}, {"x": 12}]) == [{"x": 2}, {"x": 2}, {"x": 3}]
    with pytest.raises(ValueError, match="no multiple"):
        L.steps([{"x": 2}, {"x": 3}])
    assert L.level_factors(("c", "y", "x"), [2, {"y": 4}]) == [{"y": 2, "x": 2}, {"y": 4, "x": 1}]


def test_chunks_and_shards():
    assert L.chunk_lengths(("t", "z", "y", "x")) == {"t": 1, "z": 128, "y": 128, "x": 128}
    assert L.chunk_lengths(("y", "x")) == {"y": 256, "x": 256}
    assert L.chunk_lengths(("y", "x"), (3, 4)) == {"y": 3, "x": 4} and L.chunk_lengths(("y", "x"), {"x": 5}) == {"y": 256, "x": 5}
    c = {"y": 64, "x": 64}
    assert L.shard_shape("yx", c, 2) == {"y": 128, "x": 128} and L.shard_shape("yx", c, (2, 1)) == L.shard_shape("yx", c, {"y": 2, "x": 1}) == {"y": 128, "x": 64}
    assert L.aligned_chunk({"y": 50, "x": 3}, [{"y": 2, "x": 2}, {"y": 4, "x": 4}]) == {"y": 48, "x": 4}


def test_estimates():
    four, two = {"z": 4, "y": 4, "x": 4}, {"z": 2, "y": 2, "x": 2}
    assert L.memory_bytes(four, two, "uint8") == 64 and L.memory_bytes(four, two, "uint8", ["z"]) == 32
    assert L.memory_bytes(four, two, "uint16") == 128 and L.memory_bytes_by_axis(four, two, "uint16") == 64 * 8
    assert L.chunk_count(four, two) == 8


def test_regions_tile_the_array():
    r = random.Random(0)
    for _ in range(200):
        dims = r.choice([("y", "x"), ("z", "y", "x"), ("t", "c", "z", "y", "x")])
        shape = {d: r.randint(1, 40) for d in dims}
        chunk = {d: r.randint(1, 12) for d in dims}
        boxes = L.regions(shape, chunk, "uint16", r.choice([1, 50, 500, 5000, 10**9]))
        assert sum(math.prod(b - a for a, b in x.values()) for x in boxes) == math.prod(shape.values())
        for p, q in itertools.combinations(boxes[:40], 2):
            assert any(p[d][1] <= q[d][0] or q[d][1] <= p[d][0] for d in dims)
        assert all(a % chunk[d] == 0 for x in boxes for d, (a, b) in x.items() if d in ("z", "y", "x"))


def test_discrete_kernel_is_the_bessel_series():
    import math

    for k in (2, 3, 5, 8):
        v = (k * k - 1) / (8 * math.log(2))
        got = dict(L.discrete_kernel(k))
        series = lambda n, v=v: math.exp(-v) * sum((v / 2) ** (2 * m + n) / math.factorial(m) / math.factorial(m + n) for m in range(100))
        total = series(0) + 2 * sum(series(o) for o in got if o > 0)
        assert all(abs(got[o] - series(abs(o)) / total) < 1e-12 for o in got) and 0.99 <= total < 1
        assert abs(sum(got.values()) - 1) < 1e-12 and total - 2 * series(max(got)) < 0.99
    assert L.discrete_kernel(1) == [(0, 1.0)] and len(L.discrete_kernel(64)) == 2 * 32 + 1


def test_splits():
    assert [b - a for a, b in L.split_points(8, 3)] == [3, 3, 2] and [b - a for a, b in L.split_points(9, 4)] == [3, 2, 2, 2]
    assert L.split_points(10, [3, 7]) == [(0, 3), (3, 7), (7, 10)]
    with pytest.raises(ValueError, match="a section"):
        L.split_points(3, 0)


def test_orders_and_names():
    assert L.transposed(("z", "y", "c", "x"), "spatial_last") == ("c", "z", "y", "x")
    assert L.transposed(("t", "x", "y", "z", "c"), "zyx_last") == ("t", "c", "z", "y", "x")
    assert L.transposed(("t", "c", "y", "x"), "channel_last") == ("t", "y", "x", "c")
    assert L.transposed(("t", "z", "y", "x"), "itk") == ("x", "y", "z", "t")
    assert [L.default_dims(n) for n in (1, 3, 4, 5)] == [("x",), ("z", "y", "x"), ("z", "y", "x", "c"), ("t", "z", "y", "x", "c")]
    with pytest.raises(MetadataError):
        L.default_dims(6)
    assert L.parse_bytes("4GB") == 4 * 10**9 and L.parse_bytes("2MiB") == 2 << 20 and L.parse_bytes("123") == 123


def test_model_checks():
    with pytest.raises(MetadataError, match="dims not valid"):
        ImageMeta(("q", "x"), {"q": 1, "x": 1})
    with pytest.raises(MetadataError):
        Axis("w", "space")
    with pytest.raises(MetadataError):
        Channel("red", Window(0, 1, 0, 1))
    with pytest.raises(ValueError, match="not supported"):
        ImageMeta(("x",), {"x": 1}, dtype="datetime64")
    assert Method.of("itk_bin_shrink") is Method.BIN_SHRINK and Method.of(None) is Method.DISCRETE_GAUSSIAN
    with pytest.raises(ValueError, match="unknown method"):
        Method.of("lanczos")
