"""Raw feed items -> cleaned, classified postings. One narrow pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postgrain.functions import taxonomy as X
from postgrain.functions.text import blank_to_null, sha256, squash, trim
from postgrain.functions.urls import canonicalize_url, safe_url


def normalize(items: DataFrame) -> DataFrame:
    """Add the derived posting columns; every other column passes through."""
    cleaned = items.withColumns({
        "title": squash("title"),
        "company": squash("company"),
        "location": blank_to_null(squash("location")),
        "description": trim("description"),
        "url": safe_url("url", "source"),
    })
    classified = cleaned.withColumns({
        "remote": X.resolve_remote("remote", "location", "description"),
        "company_normalized": X.company_key("company"),
        "title_family": X.title_family("title"),
        "seniority": X.seniority("title", "description"),
        "variant_markers": X.variant_markers("title"),
        "description_hash": sha256("description"),
        "canonical_url": canonicalize_url("url"),
    })
    return classified.withColumn("location_key", X.location_key("location", "remote"))
