"""Scalar functions over columns; all run in the JVM."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import AXIS_TYPES, COMPONENT_TYPES, DIMS, DTYPE_ALIASES, LPS, ORIENTATIONS, RAS, SPACE_UNITS, TIME_UNITS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(key, table: Mapping[str, str]) -> Column:
    """Value of a small fixed table, null if it lacks the key."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), _c(key))


def valid_dim(x) -> Column:
    return F.coalesce(_c(x).isin(*DIMS), F.lit(False))


def valid_unit(x) -> Column:
    return F.coalesce(_c(x).isin(*SPACE_UNITS, *TIME_UNITS), F.lit(False))


def valid_color(x) -> Column:
    return F.coalesce(_c(x).rlike("^[0-9A-Fa-f]{6}$"), F.lit(False))


def valid_orientation(x) -> Column:
    return F.coalesce(_c(x).isin(*ORIENTATIONS), F.lit(False))


def valid_name(x) -> Column:
    return F.coalesce(_c(x).rlike("^[A-Za-z0-9]+$"), F.lit(False))


def valid_well_path(x) -> Column:
    return F.coalesce(_c(x).rlike("^[A-Za-z0-9]+/[A-Za-z0-9]+$"), F.lit(False))


def axis_type(x) -> Column:
    return lookup(x, AXIS_TYPES)


def world(index, scale, translation) -> Column:
    """World coordinate of a voxel's centre."""
    return _c(scale) * _c(index) + _c(translation)


def sigma(k) -> Column:
    return F.sqrt((_c(k) * _c(k) - 1) / F.lit((2 * math.sqrt(2 * math.log(2))) ** 2))


def relative_factor(factor, previous) -> Column:
    return F.expr("null") if factor is None else F.floor(_c(factor) / _c(previous)).cast("int")


def next_scale(scale, k) -> Column:
    return _c(scale) * _c(k)


def next_translation(translation, scale, k) -> Column:
    return _c(translation) + F.lit(0.5) * (_c(k) - 1) * _c(scale)


def next_scale_map(scale, factors) -> Column:
    return F.transform_values(_c(scale), lambda k, v: v * F.coalesce(F.element_at(_c(factors), k), F.lit(1)))


def next_translation_map(translation, scale, factors) -> Column:
    return F.transform_values(
        _c(translation),
        lambda k, v: v + F.lit(0.5) * (F.coalesce(F.element_at(_c(factors), k), F.lit(1)) - 1) * F.coalesce(F.element_at(_c(scale), k), F.lit(1.0)),
    )


def filled_map(dims, given, default: float) -> Column:
    """Map with a value for each of ``dims``: given or default."""
    return F.map_from_arrays(_c(dims), F.transform(_c(dims), lambda d: F.coalesce(F.try_element_at(_c(given), d), F.lit(default))))


def overridden(given, override) -> Column:
    """``given`` with the entries of ``override`` in their place."""
    return F.map_concat(F.map_filter(_c(given), lambda k, _: ~F.map_contains_key(_c(override), k)), _c(override))


def product(x) -> Column:
    return F.aggregate(_c(x), F.lit(1).cast("long"), lambda a, v: a * v)


def bytes_estimate(shape, item_bytes) -> Column:
    return product(shape) * _c(item_bytes)


def chunks_estimate(shape, chunk) -> Column:
    return product(F.zip_with(_c(shape), _c(chunk), lambda n, k: F.ceil(n / k).cast("long")))


def permutation(old, new) -> Column:
    """Place in ``old`` of each name of ``new``."""
    return F.transform(_c(new), lambda d: (F.array_position(_c(old), d) - 1).cast("int"))


def is_subset(a, b) -> Column:
    return F.size(F.array_except(_c(a), _c(b))) == 0


def default_dims(rank) -> Column:
    zyx = F.array(*map(F.lit, ("z", "y", "x")))
    return (
        F.when(_c(rank).between(1, 3), F.slice(zyx, 4 - _c(rank), _c(rank)))
        .when(_c(rank) == 4, F.array(*map(F.lit, ("z", "y", "x", "c"))))
        .when(_c(rank) == 5, F.array(*map(F.lit, ("t", "z", "y", "x", "c"))))
    )


def itk_dims(rank, components) -> Column:
    """Axes of a toolkit image of that many spatial axes: t, z, y, x from the last, and c behind them for vectors."""
    space = F.slice(F.array(*map(F.lit, ("t", "z", "y", "x"))), F.lit(5) - _c(rank), _c(rank))
    return F.when(_c(components) > 1, F.concat(space, F.array(F.lit("c")))).otherwise(space)


def by_axis(dims, values) -> Column:
    """Map of the toolkit's values (x first) by axis (x last)."""
    return F.map_from_arrays(F.slice(_c(dims), 1, F.size(_c(values))), F.reverse(_c(values)))


def itk_order(dims) -> Column:
    """Axes sorted by name, t last."""
    return F.concat(F.filter(F.array_sort(_c(dims)), lambda d: d != "t"), F.filter(_c(dims), lambda d: d == "t"))


def pairs(words) -> Column:
    """['x', '0.5', 'y', '1'] as a map of numbers."""
    n = F.floor(F.size(_c(words)) / 2).cast("int")
    at = F.sequence(F.lit(0), n - 1)
    return F.map_from_arrays(F.transform(at, lambda i: F.lower(F.get(_c(words), 2 * i))), F.transform(at, lambda i: F.get(_c(words), 2 * i + 1).cast("double")))


def byte_size(text) -> Column:
    """'4GB', '512MiB' or '20' in bytes; null for anything else."""
    number = F.regexp_extract(_c(text), r"^\s*([0-9.]+)\s*[kKMGTP]?i?[bB]?\s*$", 1)
    unit = F.lower(F.regexp_extract(_c(text), r"^\s*[0-9.]+\s*([kKMGTP]?)", 1))
    base = F.when(F.regexp_extract(_c(text), r"[kKMGTP](i?)", 1) == "i", F.lit(1024)).otherwise(F.lit(1000))
    power = F.coalesce(F.translate(unit, "kmgtp", "12345").try_cast("int"), F.lit(0))
    return F.when(number != "", (number.cast("double") * F.pow(base, power)).cast("long"))


def truncation(sigma, size) -> Column:
    """Largest cut-off of 4, 3.5, ... whose radius fits the size."""
    cuts = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: i.cast("double") / 2)
    return F.array_max(F.filter(cuts, lambda c: (F.floor(c * _c(sigma) + 0.5) <= _c(size)) | (c == 0)))


def suffixes(path) -> Column:
    """All suffixes of a path's last part, lower-cased."""
    return F.lower(F.regexp_extract(_c(path), r"[^/.]((\.[^./]+)+)$", 1))


def path_parent(path) -> Column:
    return F.regexp_replace(_c(path), "/?[^/]*$", "")


def level_path(level, name) -> Column:
    return F.concat_ws("/", F.concat(F.lit("scale"), _c(level).cast("string")), _c(name))


def well_path(row, column) -> Column:
    return F.concat_ws("/", _c(row), _c(column))


def dtype_name(x) -> Column:
    """Logical dtype from a name or a byte-order string."""
    bare = F.regexp_replace(_c(x), "[<>|=]", "")
    return F.coalesce(lookup(bare, DTYPE_ALIASES), bare)


def component_type(dtype, channels=None) -> Column:
    """Component type, or null where the toolkit's structure has none."""
    return F.when(_c(dtype).isin(*COMPONENT_TYPES), _c(dtype))


def pixel_type(dtype, channels) -> Column:
    return F.when((_c(channels) == 3) & (_c(dtype) == "uint8"), "RGB").when(_c(channels) > 1, "VariableLengthVector").otherwise("Scalar")


def is_url(x) -> Column:
    return F.coalesce(F.try_parse_url(_c(x), F.lit("PROTOCOL")).isin("http", "https", "s3", "gs", "az", "azure"), F.lit(False))


def is_s3(x) -> Column:
    return F.coalesce(_c(x).startswith("s3://"), F.lit(False))


def is_store(x) -> Column:
    return F.coalesce(F.lower(_c(x)).rlike(r"\.zarr/?$"), F.lit(False))


def linear_index(dims: Sequence[str], shape: Mapping[str, int]) -> Column:
    """Row-major place of a voxel in an array of this axis order."""
    out = F.lit(0).cast("long")
    for d in dims:
        out = out * F.lit(shape[d]) + F.col(d)
    return out


def lps(axis) -> Column:
    return lookup(axis, LPS)


def ras(axis) -> Column:
    return lookup(axis, RAS)


def unscaled(value, slope, intercept) -> Column:
    """Stored samples to values; a missing, zero or NaN slope means 1."""
    s = F.when(_c(slope).isNull() | F.isnan(_c(slope)) | (_c(slope) == 0), F.lit(1.0)).otherwise(_c(slope))
    i = F.when(_c(intercept).isNull() | F.isnan(_c(intercept)), F.lit(0.0)).otherwise(_c(intercept))
    return _c(value) * s + i


def split_section(index, n: int, sections: int) -> Column:
    """Section of an index when n places are split as evenly as can be, longer sections first."""
    q, r = divmod(n, sections)
    cut = r * (q + 1)
    late = F.lit(r) + F.floor((_c(index) - cut) / F.lit(max(q, 1)))
    return F.when(_c(index) < cut, F.floor(_c(index) / F.lit(q + 1))).otherwise(late).cast("int")


def affine_parts(m: Sequence[Column]) -> dict[str, Column]:
    """Scale, shear and first two orientation columns of a 3 x 4 affine, given by rows.

    Scale: column norms; shear: dot products of normed columns (xy, xz, yz).
    """
    col = lambda j: [m[4 * i + j] for i in range(3)]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    norm = [F.sqrt(dot(col(j), col(j))) for j in range(3)]
    unit = [[v / norm[j] for v in col(j)] for j in range(3)]
    out = {f"scale_{d}": norm[j] for j, d in enumerate("xyz")}
    out |= {f"translation_{d}": m[4 * i + 3] for i, d in enumerate("xyz")}
    xy, xz, yz = dot(unit[0], unit[1]), dot(unit[0], unit[2]), dot(unit[1], unit[2])
    out |= {"shear_xy": xy, "shear_xz": xz, "shear_yz": yz}
    y = [b - xy * a for a, b in zip(unit[0], unit[1], strict=True)]
    z = [c - xz * a - yz * b for a, b, c in zip(*unit, strict=True)]
    for name, v in (("x", unit[0]), ("y", y), ("z", z)):
        length = F.sqrt(dot(v, v)) if name != "x" else F.lit(1.0)
        out |= {f"orient_{name}{i}": v[i] / length for i in range(3)}
    return out


def axis_codes(m: Sequence[Column]) -> list[Column]:
    """Direction of each voxel axis: the world axis of largest share, with its sign (exact without strong shear)."""
    names = (("L", "R"), ("P", "A"), ("I", "S"))
    out = []
    for j in range(3):
        v = [m[4 * i + j] for i in range(3)]
        size = [F.abs(x) for x in v]
        best = F.greatest(*size)
        pick = None
        for i in range(3):
            code = F.when(v[i] < 0, names[i][0]).otherwise(names[i][1])
            pick = F.when(size[i] == best, code) if pick is None else pick.when(size[i] == best, code)
        out.append(pick)
    return out


def compose(kind: Column, params: Column, point: Column) -> Column:
    """Apply one coordinate transform to a point (an array); kinds: identity, translation, scale, mapAxis, affine."""
    n = F.size(point)
    affine = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.aggregate(F.sequence(F.lit(0), n - 1), F.get(params, i * (n + 1) + n), lambda a, j: a + F.get(params, i * (n + 1) + j) * F.get(point, j)),
    )
    return (
        F.when(kind == "translation", F.zip_with(point, params, lambda p, v: p + v))
        .when(kind == "scale", F.zip_with(point, params, lambda p, v: p * v))
        .when(kind == "mapAxis", F.transform(params, lambda i: F.get(point, i.cast("int"))))
        .when(kind == "affine", affine)
        .when(kind == "rotation", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, j: a + F.get(params, i * n + j) * F.get(point, j))))
        .otherwise(point)
    )


def inverse(kind: Column, params: Column) -> tuple[Column, Column]:
    """(kind, params) of the transform that undoes one of identity, translation, scale, mapAxis or rotation; others give null."""
    n = F.size(params)
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.array_position(params, i.cast("double")) - 1).cast("double"))
    side = F.sqrt(n.cast("double")).cast("int")
    transposed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(params, i % side * side + F.floor(i / side).cast("int")))
    back = (
        F.when(kind == "translation", F.transform(params, lambda v: -v))
        .when(kind == "scale", F.transform(params, lambda v: 1 / v))
        .when(kind == "mapAxis", turned)
        .when(kind == "rotation", transposed)
        .when(kind == "identity", params)
    )
    return F.when(back.isNotNull(), kind), back


def by_dimension(parts: Sequence[tuple[Sequence[int], Column, Column]], point: Column) -> Column:
    """Transforms (places of the axes, kind, params), each on its own axes of a point; axes that none names stay."""
    out = {}
    for axes, kind, params in parts:
        moved = compose(kind, params, F.array(*[F.get(point, F.lit(a)) for a in axes]))
        if set(axes) & set(out):
            raise ValueError(f"an axis has two transforms: {sorted(set(axes) & set(out))}")
        out |= {a: F.get(moved, F.lit(i)) for i, a in enumerate(axes)}
    return F.transform(point, lambda v, i: F.coalesce(*[F.when(i == a, m) for a, m in out.items()], v)) if out else point


def apply_sequence(transforms: Column, point: Column) -> Column:
    """Fold a list of struct(kind, params) over a point."""
    return F.aggregate(transforms, point, lambda p, t: compose(t["kind"], t["params"], p))
