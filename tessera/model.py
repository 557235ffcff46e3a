"""Metadata of images, pyramids and plates, and the fixed values of the formats."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

# Axis names and types.
DIMS = ("t", "c", "z", "y", "x")
SPATIAL = ("z", "y", "x")
AXIS_TYPES = {"t": "time", "c": "channel", "z": "space", "y": "space", "x": "space"}

# Units of the format.
SPACE_UNITS = (
    "angstrom", "attometer", "centimeter", "decimeter", "exameter", "femtometer", "foot", "gigameter", "hectometer",
    "inch", "kilometer", "megameter", "meter", "micrometer", "mile", "millimeter", "nanometer", "parsec", "petameter",
    "picometer", "terameter", "yard", "yoctometer", "yottameter", "zeptometer", "zettameter",
)
TIME_UNITS = (
    "attosecond", "centisecond", "day", "decisecond", "exasecond", "femtosecond", "gigasecond", "hectosecond", "hour",
    "kilosecond", "megasecond", "microsecond", "millisecond", "minute", "nanosecond", "petasecond", "picosecond",
    "second", "terasecond", "yoctosecond", "yottasecond", "zeptosecond", "zettasecond",
)

# Anatomical orientations, and the presets of two conventions.
ORIENTATIONS = (
    "left-to-right", "right-to-left", "anterior-to-posterior", "posterior-to-anterior", "inferior-to-superior",
    "superior-to-inferior", "dorsal-to-ventral", "ventral-to-dorsal", "dorsal-to-palmar", "palmar-to-dorsal",
    "dorsal-to-plantar", "plantar-to-dorsal", "rostral-to-caudal", "caudal-to-rostral", "cranial-to-caudal",
    "caudal-to-cranial", "proximal-to-distal", "distal-to-proximal",
)
LPS = {"x": "right-to-left", "y": "anterior-to-posterior", "z": "inferior-to-superior"}
RAS = {"x": "left-to-right", "y": "posterior-to-anterior", "z": "inferior-to-superior"}

# Logical sample types; the Spark type holds every value (see DTYPES_NOTE).
DTYPES = {
    "bool": "boolean",
    "int8": "byte",
    "int16": "short",
    "int32": "int",
    "int64": "long",
    "uint8": "short",
    "uint16": "int",
    "uint32": "long",
    "uint64": "decimal(20,0)",
    "float16": "float",
    "float32": "float",
    "float64": "double",
    "complex64": "struct<re:float,im:float>",
    "complex128": "struct<re:double,im:double>",
}
DTYPE_ALIASES = {"i1": "int8", "i2": "int16", "i4": "int32", "i8": "int64", "u1": "uint8", "u2": "uint16", "u4": "uint32", "u8": "uint64", "f2": "float16", "f4": "float32", "f8": "float64", "c8": "complex64", "c16": "complex128", "b1": "bool", "?": "bool"}
DTYPES_NOTE = "unsigned integers widen by one step; uint64 needs a decimal; half floats widen"

# Component types of the medical-image toolkit's image structure.
COMPONENT_TYPES = ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64")

VERSIONS = ("0.1", "0.2", "0.3", "0.4", "0.5")


class Method(Enum):
    """Downsampling methods; several public names stand for one computation."""

    GAUSSIAN = "gaussian"
    DISCRETE_GAUSSIAN = "discrete_gaussian"
    BIN_SHRINK = "bin_shrink"
    LABEL = "label_image"
    MODE = "mode"
    NEAREST = "nearest"

    @classmethod
    def of(cls, name: str | Method | None) -> Method:
        if name is None:
            return cls.DISCRETE_GAUSSIAN
        if isinstance(name, cls):
            return name
        key = METHOD_ALIASES.get(name.upper())
        if key is None:
            key = next((m.name for m in cls if name.lower() == m.value), None)
        if key is None:
            raise ValueError(f"unknown method {name!r}; known: {sorted(METHOD_ALIASES)}")
        return cls[key]


# Public method names and what each does.
METHOD_ALIASES = {
    "ITKWASM_GAUSSIAN": "DISCRETE_GAUSSIAN",
    "ITKWASM_BIN_SHRINK": "BIN_SHRINK",
    "ITKWASM_LABEL_IMAGE": "LABEL",
    "ITK_GAUSSIAN": "DISCRETE_GAUSSIAN",
    "ITK_BIN_SHRINK": "BIN_SHRINK",
    "DASK_IMAGE_GAUSSIAN": "GAUSSIAN",
    "DASK_IMAGE_MODE": "MODE",
    "DASK_IMAGE_NEAREST": "NEAREST",
}
METHOD_NOTES = {
    Method.DISCRETE_GAUSSIAN: "separable discrete Gaussian, sampled at the first voxel of each bin; for intensities",
    Method.GAUSSIAN: "separable Gaussian, sampled at the first voxel of each bin; for intensities",
    Method.BIN_SHRINK: "mean of each bin; for intensities",
    Method.LABEL: "label of largest linearly weighted vote around the bin's centre; for labels",
    Method.MODE: "most frequent value of the window around the bin's first voxel; for labels",
    Method.NEAREST: "first voxel of each bin; for labels",
}


class MetadataError(ValueError):
    """Metadata that breaks a rule of the format."""


@dataclass(frozen=True)
class Axis:
    name: str
    type: str
    unit: str | None = None
    orientation: str | None = None

    def __post_init__(self):
        if self.name not in DIMS:
            raise MetadataError(f"dims not valid: {self.name}")


@dataclass(frozen=True)
class Window:
    min: float
    max: float
    start: float
    end: float


@dataclass(frozen=True)
class Channel:
    color: str
    window: Window
    label: str | None = None

    def __post_init__(self):
        if len(self.color) != 6 or any(c not in "0123456789abcdefABCDEF" for c in self.color):
            raise MetadataError(f"color {self.color!r} is not six hex digits")


@dataclass
class ImageMeta:
    """One array at one resolution; samples live in a DataFrame beside it."""

    dims: tuple[str, ...]
    shape: dict[str, int]
    scale: dict[str, float] = field(default_factory=dict)
    translation: dict[str, float] = field(default_factory=dict)
    chunk: dict[str, int] = field(default_factory=dict)
    dtype: str = "int64"
    name: str = "image"
    units: dict[str, str] = field(default_factory=dict)
    orientations: dict[str, str] = field(default_factory=dict)
    #: what a sample is that no chunk holds
    fill: float = 0

    def __post_init__(self):
        unknown = set(self.dims) - set(DIMS)
        if unknown or len(set(self.dims)) != len(self.dims):
            raise MetadataError(f"dims not valid: {self.dims}")
        for d in self.dims:
            if d in SPATIAL:
                self.scale.setdefault(d, 1.0)
                self.translation.setdefault(d, 0.0)
        if self.dtype not in DTYPES:
            raise ValueError(f"dtype {self.dtype} is not supported")

    @property
    def spatial(self) -> tuple[str, ...]:
        return tuple(d for d in self.dims if d in SPATIAL)

    def axes(self, rfcs: tuple[int, ...] = ()) -> list[Axis]:
        """Axes in order; orientations only if RFC 4 is on."""
        return [Axis(d, AXIS_TYPES[d], self.units.get(d), self.orientations.get(d) if 4 in rfcs else None) for d in self.dims]


@dataclass
class PyramidMeta:
    images: list[ImageMeta]
    factors: list[dict[str, int]]
    method: Method
    channels: list[Channel] = field(default_factory=list)
    name: str = "image"
    version: str = "0.4"


@dataclass(frozen=True)
class Acquisition:
    id: int
    name: str | None = None
    maximumfieldcount: int | None = None
    description: str | None = None
    starttime: int | None = None
    endtime: int | None = None


@dataclass
class PlateMeta:
    name: str
    rows: list[str]
    columns: list[str]
    #: (path, row index, column index)
    wells: list[tuple[str, int, int]]
    acquisitions: list[Acquisition] = field(default_factory=list)
    field_count: int | None = None
    version: str = "0.4"


@dataclass
class Settings:
    """What a user may set; Spark's own settings cover the rest."""

    memory_target: int = 1_000_000_000
    task_target: int = 50_000
    well_cache: int = 500
    image_cache: int = 100
    scratch: str | None = None
