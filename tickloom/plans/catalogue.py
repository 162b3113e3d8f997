"""All registered queries."""

from tickloom.plans import (market, symbols, feature_queries, stat_queries, detector_queries, table_queries,  # noqa: F401
                            briefing_queries, stream_queries, stored_queries)
from tickloom.plans.registry import QUERIES, SQL  # noqa: F401
