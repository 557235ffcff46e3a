"""Plates as catalogue tables: look-ups, walks, checks and field upserts as joins."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import MetadataError, PlateMeta
from ..sources.tables import PlateTables
from .validate import PLATE, WELL

KEY = ["plate", "well", "path", "acquisition"]


def from_documents(docs: DataFrame) -> PlateTables:
    """Catalogue tables from plate attribute documents (columns plate, doc); malformed entries are dropped."""
    doc = F.coalesce(F.get_json_object("doc", "$.ome.plate"), F.get_json_object("doc", "$.plate"))
    p = docs.select("plate", F.from_json(doc, PLATE).alias("p")).where("p is not null")
    named = lambda c: p.select("plate", F.posexplode(f"p.{c}").alias("pos", "v")).select("plate", "pos", "v.name").where("name is not null")
    wells = p.select("plate", F.explode("p.wells").alias("w")).select("plate", "w.path", F.col("w.rowIndex").alias("row_index"), F.col("w.columnIndex").alias("column_index"))
    acq = p.select("plate", F.explode("p.acquisitions").alias("a")).select("plate", "a.id", "a.name", "a.starttime", "a.endtime")
    empty = docs.sparkSession.createDataFrame([], "plate string, well string, pos int, path string, acquisition int")
    return PlateTables(named("rows"), named("columns"), wells.where("path is not null and row_index is not null and column_index is not null"), acq.where("id is not null"), empty)


def images_from_documents(docs: DataFrame) -> DataFrame:
    """plate, well, pos, path, acquisition from well attribute documents (columns plate, well, doc)."""
    doc = F.coalesce(F.get_json_object("doc", "$.ome.well"), F.get_json_object("doc", "$.well"))
    w = docs.select("plate", "well", F.from_json(doc, WELL).alias("p")).where("p is not null")
    return w.select("plate", "well", F.posexplode("p.images").alias("pos", "i")).select("plate", "well", "pos", "i.path", "i.acquisition").where("path is not null")


def walk(p: PlateTables) -> DataFrame:
    """Every field with its well's row and column names, by index."""
    r = p.rows.select("plate", F.col("pos").alias("row_index"), F.col("name").alias("row"))
    c = p.columns.select("plate", F.col("pos").alias("column_index"), F.col("name").alias("col"))
    w = p.wells.join(r, ["plate", "row_index"]).join(c, ["plate", "column_index"]).withColumnRenamed("path", "well")
    return w.join(p.images, ["plate", "well"]).select("plate", "well", "row", "col", "pos", "path", "acquisition")


def well_lookup(p: PlateTables, wanted: DataFrame) -> DataFrame:
    """wanted(plate, row, col) by name, with the well's path or null."""
    w = p.wells.select("plate", F.col("path").alias("well"), F.col("path").alias("__p"))
    return wanted.withColumn("__p", F.concat_ws("/", "row", "col")).join(w, ["plate", "__p"], "left").select("plate", "row", "col", "well")


def well_by_index(p: PlateTables, wanted: DataFrame) -> DataFrame:
    """wanted(plate, row_index, column_index) through the plate's lists of names; out of range gives null."""
    r = p.rows.select("plate", F.col("pos").alias("row_index"), F.col("name").alias("row"))
    c = p.columns.select("plate", F.col("pos").alias("column_index"), F.col("name").alias("col"))
    named = wanted.join(r, ["plate", "row_index"], "left").join(c, ["plate", "column_index"], "left")
    w = p.wells.select("plate", F.col("path").alias("well"), F.col("path").alias("__p"))
    path = F.when(F.col("row").isNotNull() & F.col("col").isNotNull(), F.concat_ws("/", "row", "col"))
    return named.withColumn("__p", path).join(w, ["plate", "__p"], "left").select("plate", "row_index", "column_index", "well")


def field_at(p: PlateTables, index: int) -> DataFrame:
    """Field of that place in every well that has it."""
    return p.images.where(F.col("pos") == index)


def field_in_acquisition(p: PlateTables, index: int) -> DataFrame:
    """The ``index``-th field of each acquisition of each well."""
    k = F.row_number().over(Window.partitionBy("plate", "well", "acquisition").orderBy("pos"))
    return p.images.withColumn("k", k - 1).where(F.col("k") == index).drop("k")


def missing(p: PlateTables) -> DataFrame:
    """Row and column pairs without a well, and wells with an index that no list has."""
    pairs = p.rows.alias("r").join(p.columns.alias("c"), "plate").select("plate", F.concat_ws("/", "r.name", "c.name").alias("path"))
    return pairs.join(p.wells.select("plate", "path"), ["plate", "path"], "left_anti")


def summary(p: PlateTables) -> DataFrame:
    """One row for each plate: numbers of rows, columns, wells, acquisitions, fields."""
    out = None
    for name in ("rows", "columns", "wells", "acquisitions", "images"):
        one = getattr(p, name).groupBy("plate").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = one if out is None else out.join(one, "plate", "full")
    return out.na.fill(0)


def check_references(p: PlateTables, fields: DataFrame) -> DataFrame:
    """Fields (plate, well, ...) whose well, or whose well's row or column, does not exist."""
    known = p.wells.select("plate", F.col("path").alias("well"))
    rows = p.rows.select("plate", F.col("name").alias("__r"))
    cols = p.columns.select("plate", F.col("name").alias("__c"))
    split = fields.withColumns({"__r": F.split_part("well", F.lit("/"), F.lit(1)), "__c": F.split_part("well", F.lit("/"), F.lit(2))})
    bad = lambda other, keys, why: split.join(other, keys, "left_anti").select(*fields.columns, F.lit(why).alias("problem"))
    return bad(rows, ["plate", "__r"], "row").unionByName(bad(cols, ["plate", "__c"], "column")).unionByName(bad(known, ["plate", "well"], "well"))


def upsert_fields(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Field list with the new fields that it lacks, after the ones of their well; (plate, well, path, acquisition) is the key.

    No acquisition is a value like others: a field without one is added once. The new fields are numbered behind each well's last; only wells that get
    new fields are counted.
    """
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"e.{k}")) for k in KEY]
    fresh = new.dropDuplicates(KEY).alias("n").join(existing.alias("e"), same, "left_anti")
    last = existing.join(fresh.select("plate", "well").distinct(), ["plate", "well"], "left_semi").groupBy("plate", "well").agg(F.max("pos").alias("__last"))
    k = F.row_number().over(Window.partitionBy("plate", "well").orderBy("path", "acquisition"))
    placed = fresh.withColumn("__k", k).join(last, ["plate", "well"], "left").withColumn("pos", (F.coalesce("__last", F.lit(-1)) + F.col("__k")).cast("int"))
    cols = ["plate", "well", "pos", "path", "acquisition"]
    return existing.select(cols).unionByName(placed.select(cols))


def well_intensity(p: PlateTables, voxels: DataFrame) -> DataFrame:
    """Mean over a well's fields of each field's mean: not the pooled mean."""
    field = voxels.groupBy("path").agg(F.avg("value").alias("m"))
    return p.images.join(field, "path").groupBy("plate", "well").agg(F.avg("m").alias("intensity"), F.count(F.lit(1)).alias("fields"))


def acquisition_series(p: PlateTables, voxels: DataFrame) -> DataFrame:
    """For each well and acquisition the mean of its first field; acquisitions without a field are left out."""
    first = field_in_acquisition(p, 0)
    return first.join(voxels, "path").groupBy("plate", "well", "acquisition").agg(F.avg("value").alias("mean"))


def acquisition_span(p: PlateTables) -> DataFrame:
    """Start as a timestamp and duration in seconds of each acquisition."""
    return p.acquisitions.select("plate", "id", F.timestamp_seconds("starttime").alias("started"), (F.col("endtime") - F.col("starttime")).alias("seconds"))


def plate_document(meta: PlateMeta) -> dict:
    """Attribute document of a plate, under the key that its version asks for."""
    if not meta.rows or not meta.columns:
        raise MetadataError("a plate needs rows and columns")
    wells = [{"path": p, "rowIndex": r, "columnIndex": c} for p, r, c in meta.wells]
    acq = [{k: v for k, v in a.__dict__.items() if v is not None} for a in meta.acquisitions]
    body: dict = {"name": meta.name, "rows": [{"name": n} for n in meta.rows], "columns": [{"name": n} for n in meta.columns], "wells": wells}
    if acq:
        body["acquisitions"] = acq
    if meta.field_count:
        body["field_count"] = meta.field_count
    if meta.version == "0.5":
        return {"ome": {"version": "0.5", "plate": body}}
    return {"plate": body | {"version": meta.version}}


def read_plate_document(doc: Mapping) -> PlateMeta:
    """Plate model of a document; one without a plate is an error."""
    from ..model import Acquisition

    body = (doc.get("ome") or doc).get("plate")
    if not body:
        raise MetadataError("the document has no plate")
    ok = lambda w: isinstance(w, Mapping) and isinstance(w.get("path"), str) and isinstance(w.get("rowIndex"), int) and isinstance(w.get("columnIndex"), int)
    wells = [(w["path"], w["rowIndex"], w["columnIndex"]) for w in body.get("wells", []) if ok(w)]
    names = lambda k: [r["name"] for r in body.get(k, []) if isinstance(r, Mapping) and isinstance(r.get("name"), str)]
    acq = [Acquisition(**{k: a[k] for k in Acquisition.__dataclass_fields__ if k in a}) for a in body.get("acquisitions", []) if isinstance(a, Mapping) and isinstance(a.get("id"), int)]
    return PlateMeta(body.get("name", ""), names("rows"), names("columns"), wells, acq, body.get("field_count"), (doc.get("ome") or {}).get("version") or body.get("version") or "0.4")


def well_documents(images: DataFrame, version: str = "0.4") -> DataFrame:
    """plate, well, doc: the attribute document of each well."""
    entry = F.struct("pos", "path", "acquisition")
    rows = images.groupBy("plate", "well").agg(F.array_sort(F.collect_list(entry)).alias("i"))
    body = F.to_json(F.struct(F.transform("i", lambda x: F.struct(x["path"].alias("path"), x["acquisition"].alias("acquisition"))).alias("images")))
    doc = F.concat(F.lit('{"ome":{"version":"0.5","well":'), body, F.lit("}}")) if version == "0.5" else F.concat(F.lit('{"well":'), body, F.lit("}"))
    return rows.select("plate", "well", doc.alias("doc"))


def parse(doc: str) -> dict:
    return json.loads(doc)
