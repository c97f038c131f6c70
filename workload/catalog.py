"""All registered queries."""

from workload import prepare, privacy, reporting  # noqa: F401 - register
from workload.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
