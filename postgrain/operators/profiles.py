"""Search profiles: the stated queries; a short list is inlined into plans as literals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from postgrain.rules.constants import TITLE_FAMILIES
from postgrain.rules.titles import FAMILY_QUERY_TERMS

# Up to so many profiles are literals of a plan; more are a table that postings meet by joins.
PROFILE_LIMIT = 200


@dataclass(frozen=True)
class Profile:
    version: str
    remote_only: bool = False
    accepted_locations: tuple[str, ...] = ()
    target_families: tuple[str, ...] = TITLE_FAMILIES
    seniority_min: str = "intern"
    seniority_max: str = "director"
    skills: tuple[str, ...] = ()
    rare_skills: tuple[str, ...] = ()
    target_companies: tuple[str, ...] = ()

    def title_phrases(self) -> list[str]:
        """Search phrases of every target family, in target order."""
        return [t for family in self.target_families for t in FAMILY_QUERY_TERMS[family]]


def load_profiles(table: DataFrame) -> list[Profile]:
    """Profiles from a table of stated queries, all of them."""
    return [
        Profile(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.asDict().items()})
        for r in table.collect()
    ]
