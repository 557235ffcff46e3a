"""Which reader an input belongs to, and what formats there are."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import suffixes
from ..model import METHOD_ALIASES, METHOD_NOTES, Method
from ..runtime import ship

# File suffixes of the readers, in the order in which they are tried.
STORE = (".zarr", ".ome.zarr")
NIFTI = (".nii", ".nii.gz")
MEDICAL = (
    ".bmp", ".dcm", ".gipl", ".gipl.gz", ".hdf5", ".jpg", ".jpeg", ".iwi", ".iwi.cbor", ".iwi.cbor.zst", ".lsm",
    ".mnc", ".mnc.gz", ".mnc2", ".mgh", ".mhz", ".mha", ".mhd", ".mrc", ".nia", ".nii", ".nii.gz", ".hdr", ".nrrd",
    ".nhdr", ".png", ".pic", ".vtk", ".aim", ".isq", ".fdf",
)
TIFF = (
    ".tif", ".tiff", ".ome.tif", ".ome.tiff", ".stk", ".gel", ".seq", ".zif", ".qptiff", ".bif", ".avs", ".dp",
    ".svs", ".ndpi", ".scn", ".lsm",
)
#: Files of this size and more, and lists of files, go to the native reader.
WASM_LIMIT = 2_000_000_000


def detect(path="path", files=1, length=0, has_array=None) -> Column:
    """Reader of an input: by a single array's metadata file, by suffix, by number and size of files."""
    s, n = suffixes(path), F.lit(files) if isinstance(files, int) else F.col(files)
    size = F.lit(length) if isinstance(length, int) else F.col(length)
    array = F.lit(False) if has_array is None else F.col(has_array)
    return (
        F.when(array, "array_store")
        .when(s.isin(*STORE), "pyramid_store")
        .when(s.isin(*NIFTI), "nibabel")
        .when(s.isin(*MEDICAL) & (n == 1) & (size < WASM_LIMIT), "itkwasm_image_io")
        .when(s.isin(*MEDICAL), "itk")
        .when(s.isin(*TIFF), "tifffile")
        .otherwise("imageio")
    )


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of all files below, also those whose names begin with a dot; contents are not read.

    The driver lists two levels of folders, tasks what is below each.
    """
    from .store import filesystem

    ship(spark)

    def below(p: str, recursive: bool) -> list:
        from pyarrow import fs as pfs

        fs, inner = filesystem(p)
        prefix = p.removesuffix(inner)
        found = fs.get_file_info(pfs.FileSelector(inner, recursive=recursive))
        return [(prefix + i.path, i.size, i.type == pfs.FileType.Directory) for i in found]

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                found = [(a, n) for a, n, folder in below(p, True) if not folder]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["path", "length"])

    flat, folders = [], [path.rstrip("/")]
    for _ in range(2):
        found = [x for p in folders for x in below(p, False)]
        flat += [(a, n) for a, n, folder in found if not folder]
        folders = [a for a, _, folder in found if folder]
    out = spark.createDataFrame(flat, "path string, length long")
    return out if not folders else out.union(spark.createDataFrame([(p,) for p in folders], "path string").mapInArrow(run, "path string, length long"))


def store_size(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def formats(spark: SparkSession) -> DataFrame:
    """backend, suffix, readable: formats by reader, and whether this engine decodes them."""
    table = {"pyramid_store": STORE, "array_store": (".zarr",), "nibabel": NIFTI, "itkwasm_image_io": MEDICAL, "itk": MEDICAL, "tifffile": TIFF}
    rows = [(b, s, b in ("pyramid_store", "array_store", "nibabel") and s != ".hdr") for b, ss in table.items() for s in ss]
    return spark.createDataFrame(rows, "backend string, suffix string, readable boolean")


def methods(spark: SparkSession) -> DataFrame:
    rows = [(name, Method[kind].value, METHOD_NOTES[Method[kind]]) for name, kind in METHOD_ALIASES.items()]
    return spark.createDataFrame(rows, "name string, method string, description string")


def codecs(spark: SparkSession) -> DataFrame:
    # Codecs that the format names, and those at hand here.
    rows = [(c, c in ("none", "gzip", "zlib", "zstd"), c in ("none", "gzip", "zstd")) for c in ("none", "gzip", "zlib", "zstd", "blosc", "lz4")]
    return spark.createDataFrame(rows, "codec string, reads boolean, writes boolean")
