"""Memory of functions on chunks: it follows a chunk and a bounded batch, not how many chunks a task has."""

import json
import tracemalloc

import numpy as np
import pytest

from tessera.model import ImageMeta
from tessera.operators import chunks as C
from tessera.sources import store

N, SIDE = 1024, 44  # 16 MB of samples in one batch
META = ImageMeta(("y", "x"), {"y": N * SIDE, "x": SIDE}, chunk={"y": SIDE, "x": SIDE}, dtype="int64")


def _batch():
    row = lambda i: C._row("image", 0, (i, 0), (i * SIDE, 0), np.full((SIDE, SIDE), i), "int64")
    return C._table([row(i) for i in range(N)]).combine_chunks().to_batches()


def _peak(run) -> float:
    """MB of Python objects that ``run`` holds at most."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _of(monkeypatch, make):
    """The functions that an operator maps over batches."""
    out = []
    monkeypatch.setattr(C, "_mapped", lambda df, fn, schema=None: out.append(fn) or df)
    monkeypatch.setattr(C, "_grouped", lambda df, fn: df)
    make(C.Chunked(None, META))
    return out


MAKE = {
    "rechunk": lambda im: C.rechunk(im, {"y": 30, "x": 30}),
    "to_voxels": C.to_voxels,
    "bin_shrink": lambda im: C.bin_shrink(im, {"y": 1, "x": 1}),
    "nearest": lambda im: C.nearest(im, {"y": 1, "x": 1}),
    "transpose": lambda im: C.transpose(im, ("x", "y")),
    "hyperslab": lambda im: C.hyperslab(im, {}),
    "halo": lambda im: C._halo(im, 0, "y", -1, 1),
}


@pytest.mark.parametrize("make", MAKE.values(), ids=MAKE)
def test_functions_hold_few_chunks(monkeypatch, make):
    for fn in _of(monkeypatch, make):
        batches, rows = _batch(), 0

        def run():
            nonlocal rows
            for b in fn(iter(batches)):
                rows += b.num_rows

        assert _peak(run) < 8 and rows >= N


@pytest.mark.parametrize("make", [lambda im: C._halo_pass(im, 0, "y", 1, 0, 0, lambda x, n: x, 1), lambda im: C.mode(im, {"y": 2})], ids=["weighted", "mode"])
def test_passes_after_a_halo_hold_few_chunks(monkeypatch, make):
    fn, batches, rows = _of(monkeypatch, make)[-1], _batch(), 0

    def run():
        nonlocal rows
        for b in fn(iter(batches)):
            rows += b.num_rows

    assert _peak(run) < 8 and rows == N


def test_a_store_is_written_chunk_by_chunk(tmp_path):
    spec = dict(path="", shape=[N * SIDE, SIDE], chunk=[SIDE, SIDE], dtype="<i8", fill=0, version=2, shard=None)
    writer = store.StoreWriter({"path": str(tmp_path), "arrays": json.dumps({0: spec}), "nodes": "{}", "codec": "zstd"})
    batches = _batch()
    assert _peak(lambda: writer.write(iter(batches))) < 8
    assert sum(1 for p in tmp_path.glob("*/0")) == N


def test_batches_of_a_task_are_bounded(spark):
    """All chunks in one task: Spark hands them over in batches of 8 MB, not of 64."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        image = C.generated(spark, ImageMeta(("y", "x"), {"y": 4096, "x": 1024}, chunk={"y": 128, "x": 1024}, dtype="int64"), lambda y, x: y + x)

        def sizes(batches):
            for b in batches:
                yield C._table([C._row("image", 0, (0,), (b.nbytes,), np.zeros(b.num_rows), "float64")]).to_batches()[0]

        got = C._mapped(image.chunks.coalesce(1), sizes).collect()
        assert sum(r.shape[0] for r in got) == 32 and max(r.origin[0] for r in got) < 12e6
        spark.conf.set(key, "4m")  # what a user has set is left alone
        C.to_voxels(image)
        assert spark.conf.get(key) in ("4m", str(4 << 20))
    finally:
        spark.conf.set(key, held)
