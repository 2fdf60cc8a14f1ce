"""All queries over the driver tables, with the SQL that states the same result."""

from __future__ import annotations

from . import audit, histories, records, scored, streams, telemetry  # noqa: F401  (each registers its queries)
from .audit import ORACLES, QUERIES  # noqa: F401
