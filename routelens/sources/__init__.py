from .tables import load_trips, load_trip_info, load_road_info, load_pois, TRIPS_SCHEMA
from .fixture import fixture_tables

__all__ = ["load_trips", "load_trip_info", "load_road_info", "load_pois",
           "TRIPS_SCHEMA", "fixture_tables"]
