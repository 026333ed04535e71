"""Boundary layers from GeoJSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from sluice.errors import BoundaryError
from sluice.functions.plane import Polygon


def file_name(name: str, number: int) -> str:
    """A file name for a polygon: its name's letters and digits of ASCII, whatever lies between two groups of them as one `-`; `part-<number>` if it has none."""
    return "-".join(re.findall(r"[A-Za-z0-9]+", name)) or f"part-{number}"


def layer_of(text: str, key: str) -> list[Polygon]:
    """Polygons in file order. Every feature has a (multi)polygon and a name under `key` that stays distinct as a file name."""
    try:
        features = json.loads(text)["features"]
    except (ValueError, KeyError, TypeError) as e:
        raise BoundaryError(f"no GeoJSON feature collection: {e}") from None
    out: list[Polygon] = []
    for i, f in enumerate(features):
        name = (f.get("properties") or {}).get(key)
        if name in (None, ""):
            raise BoundaryError(f"feature {i} has no {key!r}")
        g = f.get("geometry") or {}
        parts = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}.get(g.get("type"))
        if parts is None:
            raise BoundaryError(f"feature {name!r} is no polygon")
        rings = [[[tuple(p[:2]) for p in ring] for ring in part] for part in parts(g.get("coordinates") or []) if part]
        if not rings or not rings[0] or len(rings[0][0]) < 3:
            raise BoundaryError(f"feature {name!r} is empty")
        out.append(Polygon(str(name), file_name(str(name), i), rings))
    if not out:
        raise BoundaryError("the boundary layer has no feature")
    for what in ("name", "file"):
        seen = [getattr(p, what) for p in out]
        if len(set(seen)) < len(seen):
            raise BoundaryError(f"two features have the same {what}")
    return out


def read_layer(spark: SparkSession, path: str, key: str) -> list[Polygon]:
    """The layer from any store that Spark reads; a boundary layer fits the driver."""
    rows = spark.read.format("binaryFile").load(path).select("content").limit(1).collect()
    if not rows:
        raise BoundaryError(f"no file at {path}")
    return layer_of(bytes(rows[0]["content"]).decode("utf-8-sig"), key)
