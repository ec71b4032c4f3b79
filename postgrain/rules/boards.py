r"""Applicant-tracking providers and the URL shapes that reveal a board token.

Each provider: id, a literal every match contains (a cheap prefilter), the patterns (first group
is the token), and whether letter case is ignored.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Board:
    provider: str
    literal: str
    patterns: tuple[str, ...]
    ignore_case: bool = True


# Fixed values.
BOARDS = (
    Board("greenhouse", "greenhouse.io", (
        r"(?:job-)?boards\.greenhouse\.io/(?:embed/job_board(?:/js)?\?for=)?([a-z0-9_-]{2,40})",
        r"boards-api\.greenhouse\.io/v1/boards/([a-z0-9_-]{2,40})",
    )),
    Board("lever", "lever.co", (
        r"jobs\.(?:eu\.)?lever\.co/([a-z0-9_-]{2,40})",
        r"api\.(?:eu\.)?lever\.co/v0/postings/([a-z0-9_-]{2,40})",
    )),
    Board("ashby", "ashbyhq.com", (
        r"jobs\.ashbyhq\.com/([a-z0-9._-]{2,40})",
        r"api\.ashbyhq\.com/posting-api/job-board/([a-z0-9._-]{2,40})",
    )),
    Board("smartrecruiters", "smartrecruiters.com", (
        r"jobs\.smartrecruiters\.com/([A-Za-z0-9_-]{2,60})",
        r"api\.smartrecruiters\.com/v1/companies/([A-Za-z0-9_-]{2,60})",
    ), ignore_case=False),
    Board("workable", "workable.com", (
        r"apply\.workable\.com/(?:api/v1/widget/accounts/)?([a-z0-9-]{2,40})",
        r"([a-z0-9-]{2,40})\.workable\.com",
    )),
    Board("recruitee", "recruitee.com", (r"([a-z0-9-]{2,40})\.recruitee\.com",)),
    Board("breezy", "breezy.hr", (r"([a-z0-9-]{2,40})\.breezy\.hr",)),
    Board("personio", "personio.", (r"([a-z0-9-]{2,40})\.jobs\.personio\.(?:de|com)",)),
    Board("teamtailor", "teamtailor.com",
          (r"([a-z0-9-]{2,40}(?:\.[a-z0-9-]{2,10})?)\.teamtailor\.com",)),
    Board("rippling", "rippling", (
        r"ats\.rippling\.com/([a-z0-9-]{2,40})",
        r"([a-z0-9-]{2,40})\.rippling-ats\.com",
    )),
    Board("workday", "myworkdayjobs.com",
          (r"([a-z0-9-]{2,40})\.[a-z0-9]{2,6}\.myworkdayjobs\.com",)),
    Board("jobvite", "jobvite.com", (r"jobs\.jobvite\.com/([a-z0-9-]{2,40})",)),
    Board("bamboohr", "bamboohr.com", (r"([a-z0-9-]{2,40})\.bamboohr\.com",)),
)

# Tokens found in every embed snippet, compared ignoring case.
BOARD_NOISE = (
    "api", "apply", "assets", "blog", "boards", "careers", "cdn", "docs", "embed", "help", "img",
    "images", "js", "jobs", "media", "secure", "static", "support", "www",
)

# Keys that mark a JSON list as postings.
POSTING_KEYS = (
    "absolute_url", "applyurl", "apply_url", "compensation", "department", "departments",
    "employmenttype", "employment_type", "hostedurl", "joburl", "job_url", "jobid", "job_id",
    "location", "locationname", "location_name", "offices", "position", "salary", "slug", "team",
    "title", "workplacetype",
)

# Names an inline script assigns page state to, in search order.
STATE_MARKERS = (
    "window.__APOLLO_STATE__", "__APOLLO_STATE__", "window.__NUXT__", "__NUXT__",
    "window.__DATA__", "window.__INITIAL_STATE__", "__INITIAL_STATE__", "window.__remixContext",
    "__remixContext", "__sveltekit_data",
)

# Keys tried for the postings array of a board response, in order.
ARRAY_KEYS = ("jobs", "results", "content", "offers", "data", "items")
