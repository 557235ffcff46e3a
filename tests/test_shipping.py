"""Workers that lack the checkout: a driver in another folder, the package on its own path only."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from tessera import service
from tessera.operators import chunks as C
from tessera.model import ImageMeta, Method, PyramidMeta
from tessera.sources.tables import Image
rows = s.range(64).selectExpr("id div 8 as y", "id % 8 as x", "id as value")
im = C.from_voxels(Image(rows, ImageMeta(("y", "x"), {{"y": 8, "x": 8}})), {{"y": 4, "x": 4}})
service.build_store(im, {path!r}, [2], "gaussian")
images, _ = service.read_pyramid(s, {path!r})
assert C.to_voxels(C.rechunk(images[0], {{"y": 8, "x": 8}})).voxels.agg({{"value": "sum"}}).first()[0] == 63 * 32
print("round trip", images[1].chunks.count())
"""


def test_a_store_round_trip_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(root=str(ROOT), path=str(tmp_path / "s.zarr"))
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "round trip 4" in got.stdout, got.stderr[-3000:]
