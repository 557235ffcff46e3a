"""Metadata rules as boolean columns; a violation is a row.

Documents are parsed once; every rule is a column expression, and violated
rules are exploded, so a table of any number of documents is one scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import valid_color, valid_name, valid_orientation, valid_well_path
from .metadata import parse_images

PLATE = (
    "struct<columns:array<struct<name:string>>,rows:array<struct<name:string>>,"
    "wells:array<struct<path:string,rowIndex:int,columnIndex:int>>,"
    "acquisitions:array<struct<id:int,maximumfieldcount:int,name:string,starttime:long,endtime:long>>,"
    "field_count:int,name:string,version:string>"
)
WELL = "struct<images:array<struct<path:string,acquisition:int>>,version:string>"
LABEL = "struct<colors:array<struct<`label-value`:double,rgba:array<int>>>,properties:array<struct<`label-value`:long>>,source:struct<image:string>>"


def _n(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _unique(c: Column) -> Column:
    return _n(F.array_distinct(c)) == _n(c)


def _all(c: Column, rule) -> Column:
    return F.coalesce(F.forall(c, rule), F.lit(True))


def violations(docs: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """key, rule: one row for each rule that a document breaks (a rule that is null counts as broken)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return docs.select(key, F.explode(broken).alias("rule"))


def _transforms(t: Column) -> Column:
    kinds = _all(t, lambda x: F.coalesce(((x["type"] == "scale") & (_n(x["scale"]) >= 2)) | ((x["type"] == "translation") & (_n(x["translation"]) >= 2)), F.lit(False)))
    return (_n(t) >= 1) & kinds & (_n(F.filter(t, lambda x: x["type"] == "scale")) == 1)


def image_rules(strict: bool = False, version: str | None = None) -> dict[str, Column]:
    """Rules over the columns ``image``, ``omero`` and ``version`` of ``parse_images``; a version given holds for all rows."""
    v = F.col("version") if version is None else F.lit(version)
    only = lambda versions, rule: ~v.isin(*versions) | rule
    axes, data = F.col("image.axes"), F.col("image.datasets")
    space = F.filter(axes, lambda a: a["type"] == "space")
    rules = {
        "multiscales": F.col("image").isNotNull(),
        "datasets_at_least_one": _n(data) >= 1,
        "datasets_have_path": _all(data, lambda d: d["path"].isNotNull()),
        "transforms": _all(data, lambda d: F.coalesce(_transforms(d["coordinateTransformations"]), F.lit(False))),
        "omero_colors": _all(F.col("omero.channels"), lambda c: valid_color(c["color"])),
        "omero_windows": _all(F.col("omero.channels"), lambda c: c["window"]["min"].isNotNull() & c["window"]["max"].isNotNull() & c["window"]["start"].isNotNull() & c["window"]["end"].isNotNull()),
        "axes_2_to_5": only(["0.3", "0.4", "0.5"], _n(axes).between(2, 5)),
        "axes_unique": only(["0.3", "0.4", "0.5"], _unique(F.transform(axes, lambda a: a["name"]))),
        "axes_named": only(["0.3", "0.4", "0.5"], _all(axes, lambda a: a["name"].isNotNull())),
        "axes_letters": only(["0.3"], _all(axes, lambda a: a["name"].rlike("^[xyzct]$"))),
        "space_axes_2_to_3": only(["0.4", "0.5"], _n(space).between(2, 3)),
    }
    if strict:
        rules |= {"strict_name": F.col("image.name").isNotNull(), "strict_type": F.col("image.type").isNotNull(), "strict_metadata": F.col("image.metadata").isNotNull()}
        rules["strict_version"] = only(["0.4"], F.col("image.version").isNotNull())
    return rules


def plate_rules(p: str = "p", strict: bool = False) -> dict[str, Column]:
    c = lambda f: F.col(f"{p}.{f}")
    rules = {
        "plate": F.col(p).isNotNull(),
        "rows": (_n(c("rows")) >= 1) & _unique(c("rows")) & _all(c("rows"), lambda r: valid_name(r["name"])),
        "columns": (_n(c("columns")) >= 1) & _unique(c("columns")) & _all(c("columns"), lambda r: valid_name(r["name"])),
        "wells": (_n(c("wells")) >= 1) & _unique(c("wells")),
        "well_paths": _all(c("wells"), lambda w: valid_well_path(w["path"])),
        "well_indices": _all(c("wells"), lambda w: F.coalesce((w["rowIndex"] >= 0) & (w["columnIndex"] >= 0), F.lit(False))),
        "field_count": c("field_count").isNull() | (c("field_count") > 0),
        "acquisitions": _all(c("acquisitions"), lambda a: F.coalesce(a["id"] >= 0, F.lit(False)) & F.coalesce(a["maximumfieldcount"] > 0, F.lit(True)) & F.coalesce(a["starttime"] >= 0, F.lit(True)) & F.coalesce(a["endtime"] >= 0, F.lit(True))),
    }
    if strict:
        rules |= {"strict_name": c("name").isNotNull(), "strict_acquisitions": _all(c("acquisitions"), lambda a: a["name"].isNotNull() & a["maximumfieldcount"].isNotNull())}
    return rules


def well_rules(p: str = "p") -> dict[str, Column]:
    im = F.col(f"{p}.images")
    return {"well": F.col(p).isNotNull(), "images": (_n(im) >= 1) & _unique(im), "paths": _all(im, lambda i: valid_name(i["path"]))}


def label_rules(p: str = "p") -> dict[str, Column]:
    colors = F.col(f"{p}.colors")
    rgba = lambda v: v.isNull() | ((F.size(v) == 4) & F.forall(v, lambda x: F.coalesce(x.between(0, 255), F.lit(False))))
    return {
        "label": F.col(p).isNotNull(),
        "colors": colors.isNull() | ((F.size(colors) >= 1) & _unique(colors)),
        "rgba": _all(colors, lambda c: rgba(c["rgba"])),
        "label_values": _all(colors, lambda c: c["label-value"].isNotNull()),
    }


def orientation_rules() -> dict[str, Column]:
    """All spatial axes have an orientation or none, of one type, with a known value."""
    space = F.filter(F.col("image.axes"), lambda a: a["type"] == "space")
    with_one = F.filter(space, lambda a: a["orientation"].isNotNull())
    return {
        "orientation_all_or_none": (_n(with_one) == 0) | (_n(with_one) == _n(space)),
        "orientation_one_type": _n(F.array_distinct(F.transform(with_one, lambda a: F.coalesce(a["orientation"]["type"], F.lit(""))))) <= 1,
        "orientation_value": _all(with_one, lambda a: valid_orientation(a["orientation"]["value"])),
    }


def _space(docs: DataFrame, name: str, kind: str) -> DataFrame:
    """The object of that name, at the root or in the version namespace."""
    doc = F.coalesce(F.get_json_object("doc", f"$.ome.{name}"), F.get_json_object("doc", f"$.{name}"))
    return docs.withColumn("p", F.from_json(doc, kind))


def validate(docs: DataFrame, key: str = "id", model: str = "image", version: str | None = None, strict: bool = False) -> DataFrame:
    """Violations of attribute documents (column ``doc``) of a model: image, plate, well, label, orientation, layout, any.

    Rules follow each document's own version, or the one given for all.
    """
    if model == "image":
        rules = image_rules(strict, version)
        v = F.col("version") if version is None else F.lit(version)
        rules["namespace_version"] = (v != "0.5") | F.get_json_object("doc", "$.ome.version").isNotNull()
        return violations(parse_images(docs), key, rules)
    if model == "orientation":
        return violations(parse_images(docs), key, orientation_rules())
    if model == "plate":
        return violations(_space(docs, "plate", PLATE), key, plate_rules(strict=strict))
    if model == "well":
        return violations(_space(docs, "well", WELL), key, well_rules())
    if model == "label":
        return violations(_space(docs, "image-label", LABEL), key, label_rules())
    if model == "layout":
        layout = F.coalesce(F.get_json_object("doc", "$.ome['bioformats2raw.layout']"), F.get_json_object("doc", "$['bioformats2raw.layout']"))
        return violations(docs, key, {"layout_is_3": layout == "3"})
    if model == "series":
        series = F.coalesce(F.get_json_object("doc", "$.ome.series"), F.get_json_object("doc", "$.series"))
        names = F.from_json(series, "array<string>")
        return violations(docs, key, {"series": F.coalesce(F.forall(names, lambda s: s.isNotNull()), F.lit(False))})
    if model == "any":
        kinds = ("image", "plate", "well", "label", "layout", "series")
        bad = None
        for k in kinds:
            one = validate(docs, key, k, version, strict).select(key).distinct().withColumn("k", F.lit(1))
            bad = one if bad is None else bad.unionByName(one)
        none = bad.groupBy(key).agg(F.sum("k").alias("n")).where(F.col("n") == len(kinds))
        return none.select(key, F.lit("no_model").alias("rule"))
    raise ValueError(f"unknown model {model}")
