"""All registered queries."""

from . import cadence, cards, jobs, labels, quality, reports, views  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
