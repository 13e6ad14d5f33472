"""All registered queries."""

from tapeloom.plans import checks, flagship, joining, live, loading, outcomes, projections, resampling, statistics, windows  # noqa: F401
from tapeloom.plans.registry import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "flagship_trend_basket"
