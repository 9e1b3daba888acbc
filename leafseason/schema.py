"""Table layouts. NULL is the only missing value inside the engine."""

from __future__ import annotations

SCENES = "scene_id string, scene_ts timestamp, collection string, assets map<string, struct<href: string>>"
BANDS_10M = "scene_id string, y double, x double, red float, green float, blue float, nir float"
BANDS_20M = "scene_id string, y double, x double, swir float, rededge float"
MASKS_10M = "scene_id string, y double, x double, terrain float, cloud float"
FOREST_MASK = "y double, x double, forest int"
TEMPLATE = "y double, x double, seed float"
STATE_META = "year int, version long, processed_dates array<string>, last_updated string, base long"

#: Vegetation indices in the order in which they are computed, and the model's features in its own order.
INDICES = ("NDVI", "EVI", "NDMI", "CIRE", "CCI")
FEATURES = {"CCI": "Season_Peak_pct_CCI", "EVI": "Season_Peak_pct_EVI", "CIRE": "Season_Peak_pct_CRE", "NDMI": "Season_Peak_pct_NDM", "NDVI": "Season_Peak_pct_NDV"}
NODATA = -9999
EMPTY_TEMPLATE = 255
