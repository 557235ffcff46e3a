"""Image and plate metadata: JSON documents to models and tables, and back.

Attribute documents of many images are parsed as columns (``from_json`` with a
schema, look-ups by ``coalesce``); the reader and writer of a single store use
the same rules on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import axis_type
from ..model import AXIS_TYPES, DIMS, LPS, Axis, Channel, ImageMeta, MetadataError, Method, PyramidMeta, Window

#: Attribute documents as Spark structs; unknown keys are left out.
AXIS = "struct<name:string,type:string,unit:string,orientation:struct<type:string,value:string>>"
TRANSFORM = "struct<type:string,scale:array<double>,translation:array<double>>"
WINDOW = "struct<min:double,max:double,start:double,end:double>"
MULTISCALE = (
    f"struct<version:string,name:string,type:string,axes:array<{AXIS}>,"
    f"datasets:array<struct<path:string,coordinateTransformations:array<{TRANSFORM}>>>,"
    f"coordinateTransformations:array<{TRANSFORM}>,metadata:struct<description:string,method:string,version:string>>"
)
OMERO = f"struct<channels:array<struct<color:string,label:string,window:{WINDOW}>>>"
IMAGE = f"struct<multiscales:array<{MULTISCALE}>,omero:{OMERO},ome:struct<version:string,multiscales:array<{MULTISCALE}>,omero:{OMERO}>>"


def version(doc) -> Column:
    """Version of an attribute document: the namespace's, the first pyramid's, or 0.4."""
    return F.coalesce(F.get_json_object(doc, "$.ome.version"), F.get_json_object(doc, "$.multiscales[0].version"), F.lit("0.4"))


def parse_images(docs: DataFrame, col: str = "doc") -> DataFrame:
    """The document's first pyramid as ``image``, display settings as ``omero``, and ``version``; malformed ones give null."""
    # version 0.3 has plain names for axes; they become objects like those of later versions
    names = F.from_json(F.get_json_object(col, "$.multiscales[0].axes"), "array<string>")
    listed = F.to_json(F.transform(names, lambda n: F.struct(n.alias("name"), axis_type(n).alias("type"))))
    plain = F.coalesce(F.size(names) > 0, F.lit(False)) & ~F.exists(names, lambda n: n.startswith("{"))
    objects = F.regexp_replace(F.col(col), F.lit(r'"axes"\s*:\s*\[[^\]{}]*\]'), F.concat(F.lit('"axes":'), listed))
    parsed = F.from_json(F.when(plain, objects).otherwise(F.col(col)), IMAGE)
    return docs.withColumns({"version": version(F.col(col)), "__p": parsed}).select(
        *docs.columns,
        "version",
        F.coalesce(F.try_element_at("__p.ome.multiscales", F.lit(1)), F.try_element_at("__p.multiscales", F.lit(1))).alias("image"),
        F.coalesce("__p.ome.omero", "__p.omero").alias("omero"),
    )


def axes_table(docs: DataFrame, key: str, col: str = "doc") -> DataFrame:
    """key, pos, name, type, unit: axes of each document.

    No axes: t, c, z, y, x. A list of names (version 0.3): types by name. A list
    of objects: as written.
    """
    named = F.from_json(F.coalesce(F.get_json_object(col, "$.ome.multiscales[0].axes"), F.get_json_object(col, "$.multiscales[0].axes")), "array<string>")
    objects = F.from_json(F.coalesce(F.get_json_object(col, "$.ome.multiscales[0].axes"), F.get_json_object(col, "$.multiscales[0].axes")), f"array<{AXIS}>")
    empty = F.lit(None).cast("string")
    plain = lambda names: F.transform(names, lambda n: F.struct(n.alias("name"), axis_type(n).alias("type"), empty.alias("unit")))
    default = plain(F.array(*map(F.lit, DIMS)))
    written = F.transform("__o", lambda a: F.struct(a["name"].alias("name"), F.coalesce(a["type"], axis_type(a["name"])).alias("type"), a["unit"].alias("unit")))
    axes = F.when(F.col("__n").isNull() | (F.size("__n") == 0), default).when(F.exists("__n", lambda n: n.startswith("{")), written).otherwise(plain(F.col("__n")))
    rows = docs.select(key, named.alias("__n"), objects.alias("__o")).select(key, F.posexplode(axes).alias("pos", "a"))
    return rows.select(key, "pos", "a.name", "a.type", "a.unit")


def scale_maps(dims: Column, transforms: Column) -> tuple[Column, Column]:
    """Scale and translation by axis from a list of transforms; defaults 1 and 0."""
    one = F.filter(transforms, lambda t: t["type"] == "scale")
    two = F.filter(transforms, lambda t: t["type"] == "translation")
    at = lambda v, i, d: F.coalesce(F.get(v, i), F.lit(d))
    scale = F.transform(dims, lambda d, i: at(F.try_element_at(one, F.lit(1))["scale"], i, 1.0))
    translation = F.transform(dims, lambda d, i: at(F.try_element_at(two, F.lit(1))["translation"], i, 0.0))
    return F.map_from_arrays(dims, scale), F.map_from_arrays(dims, translation)


def complete_windows(channels: DataFrame) -> DataFrame:
    """wmin, wmax, wstart, wend filled from each other; channels with neither pair are left out."""
    pair = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    out = channels.where(pair("wmin", "wmax") | pair("wstart", "wend"))
    return out.withColumns({"wmin": F.coalesce("wmin", "wstart"), "wmax": F.coalesce("wmax", "wend"), "wstart": F.coalesce("wstart", "wmin"), "wend": F.coalesce("wend", "wmax")})


# One document on the driver -------------------------------------------------


def _window(w: Mapping) -> Window | None:
    get = lambda *keys: next((float(w[k]) for k in keys if w.get(k) is not None), None)
    if all(w.get(k) is None for k in ("min", "max")) and all(w.get(k) is None for k in ("start", "end")):
        return None
    got = (get("min", "start"), get("max", "end"), get("start", "min"), get("end", "max"))
    return None if None in got else Window(*got)


def read_document(doc: Mapping) -> tuple[dict, list[Channel], str]:
    """The first pyramid's JSON, its channels, and the version of an attribute document."""
    space = doc.get("ome", doc)
    many = space.get("multiscales")
    if not many:
        raise MetadataError("the document has no multiscales")
    omero = space.get("omero") or doc.get("omero") or {}
    channels = []
    for c in omero.get("channels", []):
        w = _window(c.get("window") or {})
        if w is not None:
            channels.append(Channel(c["color"], w, c.get("label")))
    return many[0], channels, doc.get("ome", {}).get("version") or many[0].get("version") or "0.4"


def read_axes(multiscale: Mapping) -> list[Axis]:
    axes = multiscale.get("axes") or list(DIMS)
    if isinstance(axes[0], str):
        return [Axis(a, AXIS_TYPES[a]) for a in axes]
    return [Axis(a["name"], a.get("type") or AXIS_TYPES[a["name"]], a.get("unit"), (a.get("orientation") or {}).get("value")) for a in axes]


def image_metas(multiscale: Mapping, infos: Sequence) -> list[ImageMeta]:
    """Metadata of every level, from the document and each array's own metadata."""
    axes = read_axes(multiscale)
    dims, out = tuple(a.name for a in axes), []
    common = multiscale.get("coordinateTransformations") or []
    for d, info in zip(multiscale["datasets"], infos, strict=True):
        scale, translation = {n: 1.0 for n in dims}, {n: 0.0 for n in dims}
        for t in d.get("coordinateTransformations") or []:
            if t["type"] == "scale":
                scale = dict(zip(dims, map(float, t["scale"]), strict=True))
            elif t["type"] == "translation":
                translation = dict(zip(dims, map(float, t["translation"]), strict=True))
        for t in common:
            if t["type"] == "scale":
                scale = {n: scale[n] * float(v) for n, v in zip(dims, t["scale"], strict=True)}
                translation = {n: translation[n] * float(v) for n, v in zip(dims, t["scale"], strict=True)}
        import numpy as np

        units = {a.name: a.unit for a in axes if a.unit}
        turns = {a.name: a.orientation for a in axes if a.orientation}
        out.append(ImageMeta(dims, dict(zip(dims, info.shape, strict=True)), scale, translation, dict(zip(dims, info.chunk, strict=True)), np.dtype(info.dtype).name, multiscale.get("name") or "image", units, turns, info.fill))
    return out


METHOD_TEXT = {Method.GAUSSIAN: "tessera.gaussian", Method.DISCRETE_GAUSSIAN: "tessera.discrete_gaussian", Method.BIN_SHRINK: "tessera.bin_shrink", Method.LABEL: "tessera.label_vote", Method.MODE: "tessera.mode", Method.NEAREST: "tessera.nearest"}


def write_document(pyramid: PyramidMeta, version: str = "0.4", rfcs: Sequence[int] = ()) -> dict:
    """Attribute document of a pyramid; optional keys without a value are left out."""
    from .. import __version__
    from ..model import METHOD_NOTES

    if version not in ("0.4", "0.5"):
        raise ValueError(f"unsupported version {version}")
    first = pyramid.images[0]
    axes = []
    for a in first.axes(tuple(rfcs)):
        own = {"name": a.name, "type": a.type}
        if a.unit:
            own["unit"] = a.unit
        if a.orientation:
            own["orientation"] = {"type": "anatomical", "value": a.orientation}
        axes.append(own)
    data = []
    for i, m in enumerate(pyramid.images):
        vec = lambda v, d: [float(v.get(n, d)) for n in m.dims]  # noqa: B023, E731
        data.append({"path": f"scale{i}/{pyramid.name}", "coordinateTransformations": [{"type": "scale", "scale": vec(m.scale, 1.0)}, {"type": "translation", "translation": vec(m.translation, 0.0)}]})
    body = {"axes": axes, "datasets": data, "name": pyramid.name, "type": pyramid.method.value, "metadata": {"description": METHOD_NOTES[pyramid.method], "method": METHOD_TEXT[pyramid.method], "version": __version__}}
    shown = [{"color": c.color, **({"label": c.label} if c.label else {}), "window": {"min": c.window.min, "max": c.window.max, "start": c.window.start, "end": c.window.end}} for c in pyramid.channels]
    if version == "0.4":
        return {"multiscales": [body | {"version": "0.4"}]} | ({"omero": {"channels": shown}} if shown else {})
    return {"ome": {"version": "0.5", "multiscales": [body]} | ({"omero": {"channels": shown}} if shown else {})}


def convert_version(doc: Mapping, to: str) -> dict:
    """The same content under another version's layout; display settings stay."""
    space = dict(doc.get("ome", doc))
    many = [{k: v for k, v in m.items() if k != "version"} for m in space.get("multiscales", [])]
    omero = space.get("omero") or doc.get("omero")
    extra = {"omero": omero} if omero else {}
    if to == "0.5":
        return {"ome": {"version": "0.5", "multiscales": many} | extra}
    if to == "0.4":
        return {"multiscales": [m | {"version": "0.4"} for m in many]} | extra
    raise ValueError(f"unsupported version {to}")


# Other image structures -----------------------------------------------------


def from_itk(spacing: Sequence[float], origin: Sequence[float], size: Sequence[int], components: int = 1, dtype: str = "uint8", orient: bool = True) -> ImageMeta:
    """Metadata of a toolkit image; spacing, origin and size run x, y, z there and are turned round."""
    rank = len(size)
    if not 2 <= rank <= 4:
        raise MetadataError(f"{rank} spatial axes are not supported")
    dims = ("t", "z", "y", "x")[4 - rank :]
    scale = dict(zip(dims, reversed(list(map(float, spacing))), strict=True))
    translation = dict(zip(dims, reversed(list(map(float, origin))), strict=True))
    shape = dict(zip(dims, reversed(list(size)), strict=True))
    if components > 1:
        dims, shape = (*dims, "c"), shape | {"c": components}
    return ImageMeta(dims, shape, scale, translation, dtype=dtype, orientations=dict(LPS) if orient else {})


def to_itk(meta: ImageMeta) -> dict:
    """Spacing, origin, size, component and pixel type of the toolkit's image structure; t and c must be sliced off before."""
    from ..model import COMPONENT_TYPES

    if meta.dtype not in COMPONENT_TYPES:
        raise ValueError(f"{meta.dtype} has no component type")
    dims = [d for d in ("x", "y", "z") if d in meta.dims]
    components = meta.shape.get("c", 1)
    pixel = "RGB" if components == 3 and meta.dtype == "uint8" else "VariableLengthVector" if components > 1 else "Scalar"
    return {"dimension": len(dims), "spacing": [meta.scale[d] for d in dims], "origin": [meta.translation[d] for d in dims], "size": [meta.shape[d] for d in dims], "componentType": meta.dtype, "pixelType": pixel, "components": components}


def from_nifti(affine: Sequence[Sequence[float]], shape: Sequence[int], dtype: str, slope: float | None = None, inter: float | None = None, units: Mapping[str, str] | None = None) -> ImageMeta:
    """Metadata from a NIfTI affine: spacing from column norms, translation, axis directions; scaled samples become float32."""
    import math

    if not 3 <= len(shape) <= 5:
        raise MetadataError(f"an image needs 3 to 5 axes, got {len(shape)}")
    dims = ("x", "y", "z", "t", "c")[: len(shape)]
    col = [[affine[i][j] for i in range(3)] for j in range(3)]
    scale = {d: math.sqrt(sum(v * v for v in col[j])) for j, d in enumerate("xyz")}
    scale |= {d: 1.0 for d in dims[3:]}
    translation = {d: float(affine[i][3]) for i, d in enumerate("xyz")} | {d: 0.0 for d in dims[3:]}
    scaled = (slope is not None and not math.isnan(slope) and slope not in (0, 1)) or (inter is not None and not math.isnan(inter) and inter != 0)
    return ImageMeta(dims, dict(zip(dims, shape, strict=True)), scale, translation, dtype="float32" if scaled else dtype, units=dict(units or {}), orientations=nifti_orientations(affine))


def nifti_orientations(affine: Sequence[Sequence[float]]) -> dict[str, str]:
    """Direction of each voxel axis in words."""
    words = (("right-to-left", "left-to-right"), ("anterior-to-posterior", "posterior-to-anterior"), ("superior-to-inferior", "inferior-to-superior"))
    out = {}
    for j, d in enumerate("xyz"):
        v = [affine[i][j] for i in range(3)]
        i = max(range(3), key=lambda k: abs(v[k]))
        out[d] = words[i][v[i] >= 0]
    return out
