"""All registered queries, in the order of the operator inventory."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import (  # noqa: F401,E402
    catalog_sources, catalog_time, catalog_columns, catalog_merge, catalog_quality, catalog_events, catalog_bins, catalog_retrieve, catalog_profile,
    catalog_panels, catalog_pipe,
)
