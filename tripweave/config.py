"""Parameters passed explicitly to every operator; nothing here is global state."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace

# Fixed values. Mode order decides ties in the ensemble vote.
MODES = ("stationary", "waiting", "walking", "driving", "train")
MOVING_MODES = ("walking", "driving", "train")
# Fixed values. Accepted average speed per mode, km/h, both ends inclusive.
MODE_SPEED_RANGES = {
    "stationary": (0, 1),
    "waiting": (0, 2),
    "walking": (1, 7),
    "driving": (7, 80),
    "train": (30, 300),
}

# One ping source: all sequence operators run per entity.
ENTITY = ("user", "device")


@dataclass(frozen=True)
class TripConfig:
    """Geofences, thresholds and the time-shard width."""

    home_lat: float = 0.0
    home_lon: float = 0.0
    home_radius_m: float = 50.0
    work_lat: float = 0.0
    work_lon: float = 0.0
    work_radius_m: float = 150.0
    default_tz: str = "America/New_York"
    # speed rule, km/h
    stationary_max_kmh: float = 1.0
    walk_max_kmh: float = 7.0
    train_min_kmh: float = 30.0
    # speed-variance rule
    variance_window: int = 15
    smooth_cv_threshold: float = 0.25
    variance_min_kmh: float = 15.0
    # segments shorter than this are absorbed by their predecessor
    min_segment_s: float = 30.0
    keep_forced_boundaries: bool = False
    # Sequence windows never see more of one entity than this many seconds, so an
    # entity that owns a third of the data still spreads over many tasks.
    shard_seconds: int = 3600

    def with_(self, **changes) -> "TripConfig":
        return replace(self, **changes)


@dataclass(frozen=True)
class Waypoint:
    name: str
    lat: float
    lon: float
    radius_m: float
    mode_hint: str | None = None


@dataclass(frozen=True)
class Corridor:
    name: str
    mode: str
    points: tuple[tuple[float, float], ...]
    buffer_m: float = 150.0

    def sample_points(self) -> list[tuple[float, float]]:
        """Vertices plus the points at 1/4, 1/2 and 3/4 of every edge."""
        samples = [tuple(p) for p in self.points]
        for (lat1, lon1), (lat2, lon2) in zip(self.points, self.points[1:]):
            samples += [(lat1 + (lat2 - lat1) * f, lon1 + (lon2 - lon1) * f) for f in (0.25, 0.5, 0.75)]
        return samples


@dataclass(frozen=True)
class Zones:
    """Hand-written zone configuration: a user's own stops and routes."""

    waypoints: tuple[Waypoint, ...] = ()
    corridors: tuple[Corridor, ...] = ()

    @classmethod
    def from_dict(cls, raw: dict | None) -> "Zones":
        raw = raw or {}
        return cls(
            waypoints=tuple(
                Waypoint(w["name"], float(w["lat"]), float(w["lon"]), float(w["radius_m"]), w.get("mode_hint"))
                for w in raw.get("waypoints", [])
            ),
            corridors=tuple(
                Corridor(
                    c["name"],
                    c["mode"],
                    tuple((float(lat), float(lon)) for lat, lon in c["points"]),
                    float(c.get("buffer_m", 150.0)),
                )
                for c in raw.get("corridors", [])
            ),
        )


@dataclass(frozen=True)
class TzRegion:
    """Bounding box of a time zone; where boxes overlap the smallest area wins."""

    tz: str
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float
    area: float = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "area", (self.lat_max - self.lat_min) * (self.lon_max - self.lon_min))


def load_zones(path: str | None = None) -> Zones:
    """Zones from ``path``, else ``$ZONES_CONFIG``, else ``./zones.json``, else none."""
    for candidate in (path, os.environ.get("ZONES_CONFIG"), "zones.json"):
        if candidate and os.path.exists(candidate):
            with open(candidate) as handle:
                return Zones.from_dict(json.load(handle))
    return Zones()
