"""Operators that accept a streaming DataFrame unchanged.

All analyses are batch jobs. These three steps look at one row at a time, so the same code
tags, adapts and routes claims of a stream; nothing here holds state. ``streaming/routing.py`` runs
the routing over arriving files.
"""

from claimgauge.operators.features import tag_service_category
from claimgauge.operators.validation import route_valid_rows
from claimgauge.sources.external_csv import adapt_external_claims

ROW_BY_ROW = (tag_service_category, adapt_external_claims, route_valid_rows)

__all__ = ["ROW_BY_ROW", "adapt_external_claims", "route_valid_rows", "tag_service_category"]
