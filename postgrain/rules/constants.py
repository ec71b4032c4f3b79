"""Identifiers, thresholds and limits that decide results."""

# Feed identifiers.
SOURCE_IDS = (
    "remotive", "greenhouse", "lever", "ashby", "hn", "themuse", "arbeitnow", "himalayas",
    "jobicy", "linkedin", "usajobs", "adzuna", "workable", "teamtailor", "weworkremotely",
)

# Title families, in declaration order.
TITLE_FAMILIES = (
    "agentic-engineer", "ai-engineer", "llm-engineer", "forward-deployed-engineer",
    "ai-product-engineer", "ml-engineer", "data-engineer", "data-analyst", "software-engineer",
)

# The seniority ladder, lowest first; a level's rank is its index.
SENIORITY_LEVELS = ("intern", "junior", "mid", "senior", "staff", "principal", "director")

# Application statuses with the stage and next action each one means.
# The entry for None describes a posting nobody has touched yet.
APPLICATION_PROGRESS = {
    None: ("to-review", "review the posting"),
    "shortlisted": ("to-prepare", "tailor resume and cover letter"),
    "tailored": ("to-apply", "submit the application"),
    "applied": ("waiting", "awaiting employer response"),
    "response": ("action-needed", "reply and schedule"),
    "interview": ("action-needed", "prepare for interview"),
    "offer": ("action-needed", "decide on offer"),
    "rejected": ("closed", "rejected"),
    "dismissed": ("closed", "dismissed"),
}

# Home page used when a posting carries no usable link.
SOURCE_HOME = {
    "remotive": "https://remotive.com",
    "greenhouse": "https://www.greenhouse.io",
    "lever": "https://www.lever.co",
    "ashby": "https://www.ashbyhq.com",
    "hn": "https://news.ycombinator.com",
    "themuse": "https://www.themuse.com",
    "arbeitnow": "https://www.arbeitnow.com",
    "himalayas": "https://himalayas.app",
    "jobicy": "https://jobicy.com",
    "linkedin": "https://www.linkedin.com/jobs",
    "usajobs": "https://www.usajobs.gov",
    "adzuna": "https://www.adzuna.com",
    "workable": "https://apply.workable.com",
    "teamtailor": "https://www.teamtailor.com",
    "weworkremotely": "https://weworkremotely.com",
}

# Query parameters that only track where a click came from.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gh_src",
    "lever-source", "lever-origin", "ref", "referrer", "source", "src", "gclid", "fbclid",
    "mc_cid", "mc_eid",
)

# Six scored dimensions, field name and display label, in display order.
DIMENSIONS = (
    ("skillOverlap", "Skill overlap"),
    ("seniorityMatch", "Seniority"),
    ("agenticCentrality", "Agentic centrality"),
    ("locationFit", "Location / remote"),
    ("compSignal", "Comp signal"),
    ("companySignal", "Company signal"),
)

# Thresholds.
MAX_MISSED_RUNS = 3
STALE_RUN_HOURS = 6
TITLE_SIMILARITY = 0.6
WEIGHT_FAMILY, WEIGHT_SKILL, WEIGHT_RARE, WEIGHT_COMPANY, WEIGHT_TEXT = 0.40, 0.25, 0.20, 0.10, 0.05
TEXT_SCORE_SCALE = 20.0
SKILL_DENOMINATOR_CAP = 12
DEFAULT_BUDGET = 250
SCORER_CONCURRENCY = 5
SHORTLIST_DEFAULT, SHORTLIST_CAP = 50, 500
GAP_MIN_COMPANIES = 2
DISCOVERY_MIN_POSTINGS, DISCOVERY_MIN_COMPANIES, DISCOVERY_LIMIT = 3, 3, 40
EXAMPLE_COMPANIES = 3
RUN_WARN_HOURS, RUN_FAIL_HOURS, SOURCE_STALE_HOURS = 26, 48, 48
BACKLOG_WARN = 250
FEED_HORIZON_DAYS = 3
THREAD_BATCH = 5
STRONG_SCORE, FAIR_SCORE = 75, 50
BM25_K1, BM25_B, BM25_IDF_FLOOR = 1.2, 0.75, 1e-6
RUBRIC_VERSION = "rubric-v1"
