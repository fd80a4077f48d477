"""All registered queries of the library."""

from __future__ import annotations

from tallyloom.plans import bundle_queries, configuration_queries, extra_queries, family_queries, lineage_queries, lines_queries, listing_queries, merge_queries, population_queries, rate_queries, source_queries, stream_queries, suite_queries  # noqa: F401
from tallyloom.plans.registry import oracle_sql, queries  # noqa: F401
