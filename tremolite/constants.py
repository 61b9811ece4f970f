"""Fixed values of the domain: they have to be these for results to be right."""

DEFAULT_VS30 = 760.0
#: minx, miny, maxx, maxy, inclusive.
COVERAGE_BBOX = (44.0, 8.0, 105.0, 56.0)
MMI_BAND_LEVELS = (2, 3, 4, 5, 6, 7, 8, 9, 10)
#: Roman numeral and descriptor by class.
MMI_CLASSES = {
    1: ("I", "Not Felt"), 2: ("II", "Weak"), 3: ("III", "Weak"), 4: ("IV", "Light"), 5: ("V", "Moderate"),
    6: ("VI", "Strong"), 7: ("VII", "Very Strong"), 8: ("VIII", "Severe"), 9: ("IX", "Violent"), 10: ("X", "Extreme"),
}
EARTH_RADIUS_M = 6_371_008.8
DEDUP_SECONDS, DEDUP_METRES = 60, 50_000.0
SOURCE_PRIORITY = {"MET": 1, "USGS": 2}
MAX_FETCH_ROWS = 20_000
NODATA = -9999.0
ALERT_RANK = {"red": 4, "orange": 3, "yellow": 2, "green": 1}
WEEKDAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
#: Source field of each admin column by level.
LEVEL_FIELDS = {
    "national": {"name": "Admin01_Na"},
    "province": {"name": "Province"},
    "district": {"name": "Districts", "parent": "province", "division": "division", "population": "Population"},
    "tehsil": {"name": "name", "parent": "district", "division": "division"},
}
#: Columns of a catalogue, in order, and their types; instants are microseconds since 1970.
CATALOG_COLUMNS = {
    "id": "long", "source": "string", "source_event_id": "string", "occurred_us": "long", "magnitude": "double", "depth_km": "double", "lon": "double", "lat": "double",
    "cluster_id": "long", "is_canonical": "boolean", "created_us": "long", "place": "string", "mag_type": "string", "event_type": "string", "alert": "string",
    "tsunami": "int", "sig": "int", "review_status": "string", "felt": "int", "cdi": "double", "mmi_report": "double", "gap": "double", "nst": "int",
    "url": "string", "detail_url": "string", "updated_us": "long",
}
#: Columns of the CSV export, in order.
EXPORT_COLUMNS = (
    "id", "source", "source_event_id", "occurred_at", "magnitude", "depth_km", "lon", "lat", "place", "mag_type",
    "alert", "tsunami", "sig", "review_status", "felt", "cdi", "mmi_report", "gap", "nst", "url", "detail_url",
)
#: Band colour by lower bound; any other bound has the fallback.
MMI_COLORS = {
    2: "#bfccff", 3: "#a0e6ff", 4: "#80ffff", 5: "#7aff93", 6: "#ffff00", 7: "#ffc800", 8: "#ff9100", 9: "#ff0000", 10: "#c80000",
}
FALLBACK_COLOR = "#888888"
#: Closed ranges of peak acceleration in mg, by class I to X.
PGA_RANGES_MG = (
    (0.000001, 0.5), (0.500001, 3.0), (3.000001, 14.0), (14.000001, 39.0), (39.000001, 92.0),
    (92.000001, 180.0), (180.000001, 340.0), (340.000001, 650.0), (650.000001, 1240.0), (1240.000001, 4000.0),
)
