"""What the operators need from the session: batches of bounded bytes, and shared scratch space."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import runtime as core
from ..sources.store import filesystem

#: Rows that an Arrow function works on at a time; ``core.ship`` bounds the bytes of a batch on its way to it.
ROWS = 512


def ship(spark: SparkSession) -> None:
    """Give the executors this package, and bound batches and splits where the session has Spark's own numbers.

    These three settings stay in the session; what a user has set is left alone.
    """
    core.ship(spark)
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # files are else split by the number of cores at hand, which changes when an executor is
        # lost; operators that read their input twice need the same partitions both times
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    # Spark's own numbers are for narrow rows; ten thousand texts, or their token ids, would be
    # held by the JVM and by every Python worker of a stage at once
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{core.shared_root(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through Hadoop's file system, so that any store works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session has ended before
        with contextlib.suppress(Exception):
            fs, p = filesystem(path)
            fs.delete_dir(p)


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    Cuts the lineage: the rows survive lost executors, and both readers of a
    plan see the same rows. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    atexit.register(drop_quietly, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, inputs: list[str], carry: list[str], fn, schema: str) -> DataFrame:
    """Columns ``c`` (struct of ``carry``) and ``r`` (struct of ``schema``), one row for each row.

    ``fn`` gets the input columns of an Arrow batch as a dict and returns the
    result columns as a dict. Both sides are structs, so no name of a table's
    own column can clash with one of a result. No shuffle.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    from .blocks import trim

    result = _parse_datatype_string(schema)
    q = lambda name: F.col("`" + name.replace("`", "``") + "`").alias(name)
    sel = df.select(F.struct(*map(q, carry)).alias("c"), F.struct(*map(q, inputs)).alias("i"))
    out = StructType().add("c", sel.schema["c"].dataType).add("r", result)
    names, kinds = result.fieldNames(), [to_arrow_type(f.dataType) for f in result.fields]

    def run(rows):
        # a few hundred rows at a time: a batch of Spark's holds ten thousand, and their texts as
        # Python strings, with the results, would take several times its bytes
        for batch in (b.slice(i, ROWS) for b in rows for i in range(0, b.num_rows, ROWS)):
            held = batch.column(1)
            got = fn({n: held.field(k) for k, n in enumerate(inputs)})
            arrays = [x if isinstance(x := got[n], pa.Array) else pa.array(x, t) for n, t in zip(names, kinds, strict=True)]
            res = pa.StructArray.from_arrays(arrays, names=names)
            yield pa.RecordBatch.from_arrays([batch.column(0), res], ["c", "r"])
            held = got = arrays = res = None
            trim()

    return sel.mapInArrow(run, out)
