r"""Vocabularies used by the explained filters."""

# Description patterns that block a US-only candidate, matched ignoring case.
WORK_AUTH_PATTERNS = (
    ("non-us-work-authorization",
     r"\b(must|required to)\s+(be\s+)?(eligible|authoriz(?:ed|ation))\s+to\s+work\s+in\s+(the\s+)?"
     r"(uk|united kingdom|eu|european union|canada|australia|india|germany|france|netherlands"
     r"|singapore|japan|brazil)\b"),
    ("non-us-citizenship",
     r"\bmust\s+(be\s+)?(a\s+)?(uk|eu|canadian|australian|indian|german|french)\s+citizen\b"),
    ("active-clearance",
     r"\b(active|current)\s+(ts\/sci|top[\s-]secret|secret|security)\s+clearance\b"),
    ("local-residency-required",
     r"\bmust\s+(currently\s+)?reside\s+in\s+(the\s+)?(uk|eu|canada|india|australia)\b"),
)

# Words that do not narrow a remote role down to a place.
GENERIC_REMOTE = ("remote", "anywhere", "worldwide", "only")

# Regions that include the United States.
US_REGIONS = (
    "americas", "america", "north america", "northern america", "worldwide", "global", "anywhere",
    "international",
)

# States and territories by name.
US_STATES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut",
    "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas",
    "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota",
    "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey",
    "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon",
    "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah",
    "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming",
    "district of columbia", "puerto rico",
)

# Codes that count only as the last word of a location component ("de" is left out).
US_CODES = (
    "al", "ak", "az", "ar", "ca", "co", "ct", "fl", "ga", "hi", "ia", "id", "il", "in", "ks", "ky",
    "la", "ma", "md", "me", "mi", "mn", "mo", "ms", "mt", "nc", "nd", "ne", "nh", "nj", "nm", "nv",
    "ny", "oh", "ok", "or", "pa", "ri", "sc", "sd", "tn", "tx", "ut", "va", "vt", "wa", "wi", "wv",
    "wy", "dc", "pr", "nyc", "sf", "sfo", "chi", "sea", "bos", "atl",
)
