"""All registered queries."""

from wideloom.plans import catalog_log, catalog_models, catalog_prepare, catalog_profile, catalog_series  # noqa: F401
from wideloom.plans.registry import ORACLES, QUERIES  # noqa: F401
