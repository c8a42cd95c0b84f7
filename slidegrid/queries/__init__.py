"""Registered queries over the driver's tables, each with the equivalent SQL where SQL can say it."""

from slidegrid.queries.registry import REGISTRY, Query  # noqa: F401
from slidegrid.queries import (  # noqa: F401
    bag_queries,
    cohort_queries,
    evaluation_queries,
    grid_queries,
    join_queries,
    raster_queries,
    scalar_queries,
    source_queries,
)
