"""Definitions of cubes: grid, chunks, channels and time axis. The built-in ones are facts about public datasets."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from ..functions.grid import BBox, GridSpec

#: NumPy type names to Spark types. Unsigned bytes and shorts take the next wider signed type.
TYPES = {"float32": T.FloatType(), "float64": T.DoubleType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "int16": T.ShortType(), "int32": T.IntegerType(), "bool": T.BooleanType()}
#: The largest value of each unsigned type, for range checks on writing.
TOP = {"uint8": 255, "uint16": 65535}


@dataclass(frozen=True)
class Channel:
    name: str
    dtype: str = "float32"
    meta: dict[str, str] = field(default_factory=dict)

    @property
    def width(self) -> int:
        """Bytes of a dense cell."""
        return np.dtype(self.dtype).itemsize

    def field(self) -> T.StructField:
        return T.StructField(self.name, TYPES[self.dtype], True, dict(self.meta))


@dataclass(frozen=True)
class CubeDef:
    name: str
    title: str
    grid: GridSpec
    chunk: int
    channels: tuple[Channel, ...]
    times: tuple[str, ...] | None = None

    @property
    def axis(self) -> pd.DatetimeIndex | None:
        return None if self.times is None else pd.DatetimeIndex(self.times)

    @property
    def is_temporal(self) -> bool:
        return self.times is not None

    @property
    def channel_names(self) -> list[str]:
        return [c.name for c in self.channels]

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> CubeDef:
        return cls(d["name"], d["title"], GridSpec(**d["grid"]), d["chunk"], tuple(Channel(**c) for c in d["channels"]), tuple(d["times"]) if d["times"] is not None else None)

    def cell_schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.IntegerType()) for n in ("it", "iy", "ix")] + [c.field() for c in self.channels])


#: Extents, resolutions and channels of the public datasets.
_ARCTIC: dict[int, BBox] = {32: (-4000096.0, -3400096.0, 3400096.0, 4100096.0), 10: (-4000100.0, -3400100.0, 3400100.0, 4100100.0), 2: (-4000100.0, -3400100.0, 3400100.0, 4100100.0)}
_WORLD: BBox = (-180.0, -90.0, 180.0, 90.0)
CHUNK = 3600


def arctic_dem(res: int) -> CubeDef:
    channels = (
        Channel("dem", "float32", {"long_name": "Digital Elevation Model", "units": "m"}),
        Channel("datamask", "bool", {"long_name": "Data mask"}),
    )
    return CubeDef(f"ArcticDEM{res}m", f"ArcticDEM mosaic at {res} m", GridSpec.from_bbox(_ARCTIC[res], float(res), 3413), CHUNK, channels)


def tc_trend(year: int) -> CubeDef:
    channels = tuple(Channel(f"TC{b}_slope", "uint8", {"long_name": f"Trend of tasseled cap {n}"}) for b, n in (("B", "brightness"), ("G", "greenness"), ("W", "wetness")))
    return CubeDef(f"TCTrend{year}", f"Tasseled cap trends up to {year}", GridSpec.from_bbox(_WORLD, 0.00026949458523585647, 4326), CHUNK, channels)


def alpha_earth() -> CubeDef:
    times = tuple(f"{y}-01-01" for y in range(2017, 2025))
    channels = tuple(Channel(f"A{i:02d}") for i in range(64))
    return CubeDef("AlphaEarthEmbeddings", "Annual satellite embeddings", GridSpec.from_bbox(_WORLD, 8.98315284e-05, 4326), CHUNK, channels, times)


def builtin() -> dict[str, CubeDef]:
    found = [arctic_dem(r) for r in (32, 10, 2)] + [tc_trend(y) for y in (2019, 2020, 2022, 2024)] + [alpha_earth()]
    return {d.name: d for d in found} | {"TCTrend": found[6]}
