"""Trip analytics over GPS pings, expressed as lazy Spark DataFrame transforms."""

from tripweave.config import Corridor, TripConfig, Waypoint, Zones, load_zones

__all__ = ["Corridor", "TripConfig", "Waypoint", "Zones", "load_zones"]
