"""Every registered query of the library outside the training-data operators."""

from __future__ import annotations

from palisade.jobs import detection, ingest, live, reporting, stored
from palisade.registry import ORACLES, QUERIES, Query

MODULES = (ingest, detection, reporting, live, stored)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
