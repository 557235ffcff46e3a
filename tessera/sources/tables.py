"""Images and a plate made from ordinary tables (voxel layout: a row for each sample)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ImageMeta


@dataclass
class Image:
    """Samples and their metadata. ``voxels`` has a BIGINT column for each dim and ``value``."""

    voxels: DataFrame
    meta: ImageMeta


def from_table(df: DataFrame, dims, value: str = "value", **meta) -> Image:
    """Wrap a table that has a column for each dim; the shape is taken from the largest index where not given."""
    shape = meta.pop("shape", None)
    if shape is None:
        row = df.agg(*[F.max(d).alias(d) for d in dims]).first()
        shape = {d: (row[d] if row[d] is not None else -1) + 1 for d in dims}
    cols = [F.col(d).cast("long").alias(d) for d in dims]
    return Image(df.select(*cols, F.col(value).alias("value")), ImageMeta(tuple(dims), dict(shape), **meta))


def dense(image: Image, fill=0) -> Image:
    """Every place of the grid, missing samples filled.

    The grid is generated in parallel, one row for each place along the first
    two axes, and joined by its axes; nothing is crossed with the samples.
    """
    spark, m = image.voxels.sparkSession, image.meta
    if not all(m.shape[d] for d in m.dims):
        return Image(image.voxels.limit(0), m)
    head, rest = m.dims[:2], m.dims[2:]
    inner = m.shape[head[1]] if len(head) == 2 else 1
    at = [F.floor(F.col("id") / inner).alias(head[0]), *((F.col("id") % inner).alias(h) for h in head[1:])]
    grid = spark.range(m.shape[head[0]] * inner).select(*at)
    for d in rest:
        grid = grid.withColumn(d, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m.shape[d] - 1).cast("long"))))
    kind = image.voxels.schema["value"].dataType
    out = grid.join(image.voxels, list(m.dims), "left").withColumn("value", F.coalesce("value", F.lit(fill).cast(kind)))
    return Image(out.select(*m.dims, "value"), m)


def embeddings(spark: SparkSession, sf: str) -> Image:
    """y = vector, x = position, value = thousandths."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v"))
    rows = rows.select("y", F.col("x").cast("long").alias("x"), F.floor(F.col("v").cast("double") * 1000).cast("long").alias("value"))
    n = df.agg(F.max("vec_id")).first()[0]
    return Image(rows, ImageMeta(("y", "x"), {"y": (n if n is not None else -1) + 1, "x": 64}))


def labels(spark: SparkSession, sf: str) -> Image:
    """Few distinct values: tenths of ``embeddings``."""
    e = embeddings(spark, sf)
    return Image(e.voxels.withColumn("value", F.expr("value div 100")), e.meta)


def events(spark: SparkSession, sf: str) -> Image:
    """t = day since the first one, c = event type, y = hour, x = user modulo 16; counts, missing cells 0.

    Events without a time or a type belong to no cell.
    """
    df = spark.read.parquet(f"{sf}/events.parquet").where("ts is not null and event_type is not null")
    first, last = df.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    days = (last - first).days + 1 if first else 0
    kinds = ("click", "error", "purchase", "signup", "view")
    names = [r[0] for r in df.select("event_type").distinct().sort("event_type").collect()]
    order = F.array(*map(F.lit, names or kinds))
    rows = df.select(
        (F.datediff("ts", F.lit(first).cast("date"))).cast("long").alias("t"),
        (F.array_position(order, F.col("event_type")) - 1).cast("long").alias("c"),
        F.hour("ts").cast("long").alias("y"),
        F.pmod("user_id", F.lit(16)).cast("long").alias("x"),
    )
    rows = rows.groupBy("t", "c", "y", "x").agg(F.count(F.lit(1)).alias("value"))
    meta = ImageMeta(("t", "c", "y", "x"), {"t": days, "c": len(names or kinds), "y": 24, "x": 16}, units={"t": "day"})
    return dense(Image(rows, meta))


def lineitem(spark: SparkSession, sf: str, fill: bool = True) -> Image:
    """z = line number - 1, y = supplier modulo 64, x = part modulo 64; summed quantity."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = df.select((F.col("l_linenumber") - 1).cast("long").alias("z"), F.pmod("l_suppkey", F.lit(64)).alias("y"), F.pmod("l_partkey", F.lit(64)).alias("x"), "l_quantity")
    rows = rows.groupBy("z", "y", "x").agg(F.sum("l_quantity").cast("long").alias("value"))
    image = Image(rows, ImageMeta(("z", "y", "x"), {"z": 7, "y": 64, "x": 64}))
    return dense(image) if fill else image


@dataclass
class PlateTables:
    """Catalogue of a plate as tables; see ``operators.plate``."""

    rows: DataFrame
    columns: DataFrame
    wells: DataFrame
    acquisitions: DataFrame
    images: DataFrame


def plate(spark: SparkSession, sf: str) -> PlateTables:
    """Rows = regions, columns = nations, fields = suppliers, acquisition = supplier modulo 5."""
    from pyspark.sql import Window

    region, nation, supplier = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("region", "nation", "supplier"))
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "")
    rows = region.select(F.lit("P").alias("plate"), F.col("r_regionkey").cast("int").alias("pos"), clean("r_name").alias("name"))
    cols = nation.select(F.lit("P").alias("plate"), F.col("n_nationkey").cast("int").alias("pos"), clean("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    wells = cols.alias("c").join(rows.alias("r"), F.col("c.region") == F.col("r.pos")).select(
        F.lit("P").alias("plate"), F.concat_ws("/", "r.name", "c.name").alias("path"), F.col("r.pos").alias("row_index"), F.col("c.pos").alias("column_index")
    )
    acq = spark.range(5).select(F.lit("P").alias("plate"), F.col("id").cast("int").alias("id"), F.concat(F.lit("run "), F.col("id").cast("string")).alias("name"))
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    when = orders.select(F.pmod("o_orderkey", F.lit(5)).cast("int").alias("id"), F.unix_timestamp("o_orderdate").alias("s")).groupBy("id").agg(F.min("s").alias("starttime"), F.max("s").alias("endtime"))
    acq = acq.join(when, "id", "left").select("plate", "id", "name", "starttime", "endtime")
    at = wells.select(F.col("path").alias("well"), F.col("column_index"))
    f = supplier.join(at, supplier.s_nationkey == at.column_index)
    pos = (F.row_number().over(Window.partitionBy("well").orderBy("s_suppkey")) - 1).cast("int")
    images = f.select(F.lit("P").alias("plate"), "well", pos.alias("pos"), F.col("s_suppkey").cast("string").alias("path"), F.pmod("s_suppkey", F.lit(5)).cast("int").alias("acquisition"))
    return PlateTables(rows, cols.drop("region"), wells, acq, images)


def plate_voxels(spark: SparkSession, sf: str) -> DataFrame:
    """path (field), y, x, value: lineitem rows of the field's supplier."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = df.select(F.col("l_suppkey").cast("string").alias("path"), (F.col("l_linenumber") - 1).cast("long").alias("y"), F.pmod("l_partkey", F.lit(64)).alias("x"), "l_quantity")
    return rows.groupBy("path", "y", "x").agg(F.sum("l_quantity").cast("long").alias("value"))
