"""Metadata conventions of stored grids: detect, decode, merge, complete; and stamp on writing.

A snapshot is the metadata of a store (group attributes, arrays with shape, dims and attributes); a description is what
the conventions say about its cell axis. All of it is plain dictionaries on the driver.
"""

from __future__ import annotations

from copy import deepcopy
from dataclasses import dataclass, field, fields

from tessellon.sources.encodings import encoding
from tessellon.sources.errors import DGGSFormatError
from tessellon.systems.base import GridSystem, system

#: Fixed values of the published conventions.
ZARR_DGGS_UUID = "7b255807-140c-42ca-97f6-7a1cfecdbc38"
ZARR_DGGS_DECLARATION = {
    "description": "Discrete Global Grid Systems convention for zarr",
    "name": "dggs",
    "schema_url": "https://raw.githubusercontent.com/zarr-conventions/dggs/refs/tags/v1/schema.json",
    "spec_url": "https://github.com/zarr-conventions/dggs/blob/v1/README.md",
    "uuid": ZARR_DGGS_UUID,
}
LEVEL_ALIASES = ("level", "refinement_level", "nside", "order", "resolution", "depth")
SCHEME_ALIASES = ("indexing_scheme", "nest")
CELL_DIMS = ("cell", "cells", "value", "values")
COMPRESSIONS = ("none", "compacted", "ranges")


@dataclass
class GridReference:
    system: str
    scheme: str
    schemes: tuple[str, ...]


GRIDS = {"igeo7": GridReference("IGeo7", "z7int", ("z7int",)), "healpix": GridReference("HEALPix", "nested", ("nested", "ring", "nuniq", "zuniq"))}


def register_grid(name: str, reference: GridReference) -> None:
    """The canonical spelling of a grid in stores; it pins the id packing, too."""
    GRIDS[name] = reference


@dataclass
class ArrayEntry:
    name: str
    shape: tuple[int, ...]
    dims: tuple[str, ...]
    attrs: dict = field(default_factory=dict)
    chunks: tuple[int, ...] = ()
    dtype: str = "<f8"


@dataclass
class StoreSnapshot:
    identifier: str
    attrs: dict
    arrays: list[ArrayEntry]

    def array(self, name: str | None) -> ArrayEntry | None:
        return next((a for a in self.arrays if a.name == name), None)


@dataclass
class Detection:
    """A convention that a store follows: declared by name, or known by its fingerprint."""

    convention: Convention
    kind: str
    evidence: str
    payload: dict = field(default_factory=dict)


@dataclass
class StoreDescription:
    gridname: str | None = None
    scheme: str | None = None
    level: int | None = None
    encoding: str | None = None
    coordinate: str | None = None
    spatial_dimension: str | None = None
    variables: tuple[str, ...] | None = None
    ellipsoid: dict | None = None
    orientation: dict | None = None
    geodetic_conversion: bool | None = None
    provenance: dict = field(default_factory=dict)

    @property
    def system(self) -> GridSystem:
        return system(GRIDS[self.gridname].system)


def parse_ellipsoid(x) -> dict | None:
    """A name, or an object in either spelling of its axes; None where nothing is declared."""
    if isinstance(x, str):
        return {"name": x}
    if not isinstance(x, dict):
        return None

    def first(*names):
        return next((x[n] for n in names if x.get(n) is not None), None)

    out = {
        "name": first("name", "reference_ellipsoid_name"),
        "semi_major_axis": first("semi_major_axis", "semimajor_axis"),
        "semi_minor_axis": first("semi_minor_axis", "semiminor_axis"),
        "inverse_flattening": first("inverse_flattening"),
        "radius": first("radius", "earth_radius"),
    }
    out = {k: v for k, v in out.items() if v is not None}
    return out if set(out) - {"name"} or "name" in out and set(x) <= {"name"} or "reference_ellipsoid_name" in x else out or None


class Convention:
    name = ""

    def error(self, check: str, s: StoreSnapshot, **more) -> DGGSFormatError:
        return DGGSFormatError(check, store=s.identifier, conventions=[self.name], **more)

    def gridname(self, raw, attrs: dict) -> str:
        return str(raw).strip().lower()

    def grid(self, raw, attrs: dict, s: StoreSnapshot) -> tuple[str, GridReference]:
        canonical = self.gridname(raw, attrs)
        if canonical not in GRIDS:
            raise self.error("unknown_grid_name", s, declared=canonical, detail=f"registered: {', '.join(sorted(GRIDS))}")
        return canonical, GRIDS[canonical]

    def require(self, attrs: dict, key: str, s: StoreSnapshot):
        if attrs.get(key) is None:
            raise self.error("missing_required_key", s, declared=key)
        return attrs[key]

    def integer(self, x, key: str, s: StoreSnapshot) -> int:
        if isinstance(x, bool) or not isinstance(x, int | float) or int(x) != x:
            raise self.error("invalid_attribute_type", s, declared=key, observed=x)
        return int(x)

    def from_nside(self, x, s: StoreSnapshot) -> int:
        n = self.integer(x, "nside", s)
        if n <= 0 or n & (n - 1):
            raise self.error("invalid_nside", s, declared=n)
        return n.bit_length() - 1

    def scheme(self, raw, ref: GridReference, s: StoreSnapshot) -> str:
        name = ("nested" if raw else "ring") if isinstance(raw, bool) else str(raw).strip().lower()
        name = "nested" if name == "nest" else name
        if name not in ref.schemes:
            raise self.error("unknown_indexing_scheme", s, declared=name, observed=ref.system)
        return name

    @staticmethod
    def along(s: StoreSnapshot, dim: str | None, *exclude) -> tuple[str, ...] | None:
        return None if dim is None else tuple(a.name for a in s.arrays if dim in a.dims and a.name not in exclude)

    def detect(self, s: StoreSnapshot) -> Detection | None:
        raise NotImplementedError

    def decode(self, s: StoreSnapshot, d: Detection) -> StoreDescription:
        raise NotImplementedError

    def encode(self, s: StoreSnapshot, d: StoreDescription) -> None:
        raise DGGSFormatError("read_only", declared=self.name)


class ZarrDGGSConvention(Convention):
    """A declaration on the group, known by its uuid or URLs (never its name), and an object `dggs`."""

    name = "zarr-conventions/dggs"

    def detect(self, s):
        declared = s.attrs.get("zarr_conventions")
        for entry in declared if isinstance(declared, list) else []:
            if isinstance(entry, dict) and (entry.get("uuid") == ZARR_DGGS_UUID or any(self.name in str(entry.get(k, "")) for k in ("schema_url", "spec_url"))):
                if "dggs" not in s.attrs:
                    raise self.error("missing_required_key", s, declared="dggs")
                return Detection(self, "declared", f"uuid {ZARR_DGGS_UUID}")
        return None

    def decode(self, s, d):
        o = s.attrs["dggs"]
        if not isinstance(o, dict):
            raise self.error("invalid_attribute_type", s, declared="dggs", observed=o)
        canonical, ref = self.grid(self.require(o, "name", s), o, s)
        if "refinement_level" not in o:
            raise self.error("missing_required_key", s, declared="refinement_level")
        level = None if o["refinement_level"] is None else self.integer(o["refinement_level"], "refinement_level", s)
        dim, coordinate = self.require(o, "spatial_dimension", s), o.get("coordinate")
        for key, v in (("spatial_dimension", dim), ("coordinate", coordinate)):
            if v is not None and not isinstance(v, str):
                raise self.error("invalid_attribute_type", s, declared=key, observed=v)
        scheme = self.scheme(o["indexing_scheme"], ref, s) if "indexing_scheme" in o else None if canonical == "healpix" else ref.scheme
        turn = {k: o[n] for k, n in (("vert0_lon", "dggs_vert0_lon"), ("vert0_lat", "dggs_vert0_lat"), ("vert0_azimuth", "dggs_vert0_azimuth"), ("rotation_pattern", "rotation_pattern")) if o.get(n) is not None}
        return StoreDescription(canonical, scheme, level, encoding("implicit" if coordinate is None else o.get("compression", "none")).name, coordinate, dim, self.along(s, dim, coordinate), parse_ellipsoid(o.get("ellipsoid")), turn or None, None, {self.name: deepcopy(o)})

    def encode(self, s, d):
        o = {"name": d.gridname, "refinement_level": d.level, "spatial_dimension": d.spatial_dimension}
        if d.coordinate is not None:
            if d.encoding not in COMPRESSIONS:
                raise DGGSFormatError("encoding", declared=d.encoding, observed=COMPRESSIONS, conventions=[self.name])
            o |= {"coordinate": d.coordinate, "compression": d.encoding}
        if d.gridname == "healpix" and d.scheme:
            o["indexing_scheme"] = d.scheme
        if d.ellipsoid:
            o["ellipsoid"] = dict(d.ellipsoid)
        for k, v in (d.orientation or {}).items():
            o[k if k == "rotation_pattern" else f"dggs_{k}"] = v
        s.attrs["dggs"] = o
        declared = s.attrs.setdefault("zarr_conventions", [])
        if not any(isinstance(e, dict) and e.get("uuid") == ZARR_DGGS_UUID for e in declared):
            declared.append(deepcopy(ZARR_DGGS_DECLARATION))


class XdggsConvention(Convention):
    """Flat attributes on the cell-id coordinate."""

    name = "xdggs"

    def detect(self, s):
        found = [a.name for a in s.arrays if "grid_name" in a.attrs]
        if len(found) > 1:
            raise self.error("multiple_cell_coordinates", s, observed=found)
        return Detection(self, "fingerprint", f"grid_name on {found[0]}", {"coordinate": found[0]}) if found else None

    def decode(self, s, d):
        a = s.array(d.payload["coordinate"])
        canonical, ref = self.grid(self.require(a.attrs, "grid_name", s), a.attrs, s)
        levels = [k for k in LEVEL_ALIASES if a.attrs.get(k) is not None]
        if len(levels) > 1:
            raise self.error("duplicate_level_alias", s, observed=levels)
        level = None if not levels else self.from_nside(a.attrs["nside"], s) if levels[0] == "nside" else self.integer(a.attrs[levels[0]], levels[0], s)
        schemes = [k for k in SCHEME_ALIASES if a.attrs.get(k) is not None]
        if len(schemes) > 1:
            raise self.error("duplicate_indexing_scheme_alias", s, observed=schemes)
        scheme = self.scheme(a.attrs[schemes[0]], ref, s) if schemes else None
        flat = len(a.shape) == 1
        dim = a.dims[0] if flat and a.dims else None
        lon = a.attrs.get("igeo7_dggs_vert0_lon")
        return StoreDescription(canonical, scheme, level, "none" if flat else None, a.name, dim, self.along(s, dim, a.name), parse_ellipsoid(a.attrs.get("ellipsoid")), {"vert0_lon": float(lon)} if lon is not None else None, a.attrs.get("igeo7_wgs84_geodetic_conversion"), {self.name: deepcopy(a.attrs)})

    def encode(self, s, d):
        if d.coordinate is None:
            return
        a = s.array(d.coordinate)
        a.attrs["grid_name"] = d.gridname
        if d.level is not None:
            a.attrs["level"] = d.level
        if d.gridname == "healpix":
            if d.scheme:
                a.attrs["indexing_scheme"] = d.scheme
            if d.ellipsoid:
                a.attrs["ellipsoid"] = dict(d.ellipsoid)
        if d.gridname == "igeo7":
            if d.geodetic_conversion is not None:
                a.attrs["igeo7_wgs84_geodetic_conversion"] = d.geodetic_conversion
            if d.orientation and "vert0_lon" in d.orientation:
                a.attrs["igeo7_dggs_vert0_lon"] = d.orientation["vert0_lon"]


class LegacyHealpixConvention(XdggsConvention):
    """grid_name healpix with nside and nest; read only."""

    name = "legacy-healpix"

    def detect(self, s):
        found = [a.name for a in s.arrays if a.attrs.get("grid_name") == "healpix" and "nside" in a.attrs and "nest" in a.attrs]
        return Detection(self, "fingerprint", f"nside and nest on {found[0]}", {"coordinate": found[0]}) if len(found) == 1 else None

    encode = Convention.encode


class DKRZConvention(Convention):
    """A grid-mapping variable with healpix_nside; mostly no cell array: the axis is implicit. Read only."""

    name = "dkrz-healpix"

    def detect(self, s):
        for a in s.arrays:
            if a.attrs.get("grid_mapping_name") == "healpix" and "healpix_nside" in a.attrs:
                return Detection(self, "fingerprint", f"healpix_nside on {a.name}", {"crs": a.name})
        return None

    def decode(self, s, d):
        attrs = s.array(d.payload["crs"]).attrs
        canonical, ref = self.grid(attrs["grid_mapping_name"], attrs, s)
        scheme = self.scheme(attrs["healpix_order"], ref, s) if "healpix_order" in attrs else None
        dims = {x for a in s.arrays if a.name != d.payload["crs"] for x in a.dims}
        dim = next((x for x in CELL_DIMS if x in dims), None)
        coordinate = dim if dim is not None and s.array(dim) is not None else None
        return StoreDescription(canonical, scheme, self.from_nside(attrs["healpix_nside"], s), "implicit" if coordinate is None else "none", coordinate, dim, self.along(s, dim, d.payload["crs"], coordinate), parse_ellipsoid(attrs) if {"semi_major_axis", "semimajor_axis", "reference_ellipsoid_name", "earth_radius"} & set(attrs) else None, None, None, {self.name: deepcopy(attrs)})


CONVENTIONS: list[Convention] = [ZarrDGGSConvention(), XdggsConvention(), LegacyHealpixConvention(), DKRZConvention()]


def register_convention(c: Convention, first: bool = False) -> None:
    CONVENTIONS.insert(0, c) if first else CONVENTIONS.append(c)


def merge(parts: list[tuple[Detection, StoreDescription]], store: str) -> StoreDescription:
    """The first convention that says something decides; a later one that says otherwise is an error."""
    out, said = StoreDescription(), {}
    for d, p in parts:
        for f in fields(StoreDescription):
            v = getattr(p, f.name)
            if f.name == "provenance":
                out.provenance.update(v)
            elif v is not None:
                old = getattr(out, f.name)
                if old is None:
                    setattr(out, f.name, v)
                    said[f.name] = d.convention.name
                elif old != v and f.name not in ("variables", "encoding", "ellipsoid", "orientation"):
                    raise DGGSFormatError("conflicting_conventions", old, v, store, [said[f.name], d.convention.name], f.name)
    return out


def describe_store(s: StoreSnapshot) -> StoreDescription:
    """Detect, decode, merge, fill in defaults, and require what an axis needs."""
    found = [d for d in (c.detect(s) for c in CONVENTIONS) if d]
    if not found:
        raise DGGSFormatError("no_convention", observed=sorted(s.attrs), store=s.identifier)
    out = merge([(d, d.convention.decode(s, d)) for d in found], s.identifier)
    if out.scheme is None and out.gridname:
        out.scheme = GRIDS[out.gridname].scheme
    if out.encoding is None:
        out.encoding = "none" if out.coordinate else "implicit"
    for key in ("gridname", "level", "spatial_dimension"):
        if getattr(out, key) is None:
            raise DGGSFormatError("incomplete_description", declared=key, store=s.identifier, conventions=[d.convention.name for d in found])
    return out
