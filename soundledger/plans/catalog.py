"""All query modules, imported for their registrations."""

from soundledger.plans import aggregate_queries, audio_queries, extra_queries, join_queries, model_queries, scalar_queries, source_queries, sql_queries, stream_queries, window_queries  # noqa: F401
from soundledger.plans.registry import QUERIES, SQL  # noqa: F401
