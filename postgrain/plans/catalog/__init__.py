"""Registered queries, by area. Importing this package registers all of them."""

from postgrain.plans.catalog import (  # noqa: F401
    columns, feeds, filters, lifecycle, market, pages, ranking, reports, scoring, tracking,
)
