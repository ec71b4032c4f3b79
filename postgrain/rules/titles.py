r"""Title classification patterns.

Patterns are stated once in a neutral dialect (`\b` is an ASCII word boundary, `\s` any
Unicode space) and rendered for the JVM by :mod:`postgrain.functions.patterns`.
They are matched against the lower-cased title; the first family with a hit wins.
"""

# Fixed values.
FAMILY_PATTERNS = (
    ("agentic-engineer", (
        r"\bagentic\b",
        r"\bai\s+agents?\b",
        r"\bagents?\s+(engineer|platform|infrastructure)\b",
    )),
    ("forward-deployed-engineer", (
        r"\bforward[\s-]deployed\b",
        r"\bdeployment\s+engineer\b",
    )),
    ("llm-engineer", (
        r"\bllm\b",
        r"\blarge\s+language\s+model",
        r"\bfoundation\s+model",
        r"\binference\s+engineer\b",
    )),
    ("ai-product-engineer", (
        r"\bai\s+product\s+engineer\b",
        r"\bproduct\s+engineer,?\s+ai\b",
    )),
    ("ai-engineer", (
        r"\bai\s+engineer\b",
        r"\bapplied\s+ai\b",
        r"\bgenerative\s+ai\b",
        r"\bgenai\b",
        r"\bai[\s/-](?:[\w-]+\s+){0,2}(?:engineer|developer|architect)\b",
        r"\bai\s+architect\b",
        r"\bartificial\s+intelligence\b.*\b(?:engineer|developer|architect|scientist|specialist)\b",
        r"\b(?:engineer|developer|architect|scientist|specialist)\b.*\bartificial\s+intelligence\b",
    )),
    ("ml-engineer", (
        r"\bmachine\s+learning\b",
        r"\bml\s+engineer\b",
        r"\bmlops\b",
        r"\bresearch\s+engineer\b",
    )),
    ("data-engineer", (
        r"\bdata\s+engineer\b",
        r"\banalytics\s+engineer\b",
        r"\bdata\s+platform\b",
    )),
    ("data-analyst", (
        r"\bdata\s+analyst\b",
        r"\bbusiness\s+intelligence\b",
        r"\bbi\s+(analyst|developer)\b",
    )),
    ("software-engineer", (
        r"\bsoftware\s+engineer\b",
        r"\bfull[\s-]?stack\b",
        r"\b(back|front)[\s-]?end\s+engineer\b",
    )),
)

# Manager titles are unclassified unless they also say engineer(ing).
MANAGER_PATTERN = r"\b(?:product|program|project)\s+manager\b|\bproduct\s+owner\b"
ENGINEER_PATTERN = r"\bengineer(?:ing)?\b"

# Search phrases that recall each family.
FAMILY_QUERY_TERMS = {
    "agentic-engineer": ("agentic", "ai agents", "agent engineer"),
    "ai-engineer": ("ai engineer", "applied ai", "generative ai"),
    "llm-engineer": ("llm", "large language model", "foundation model"),
    "forward-deployed-engineer": ("forward deployed", "deployment engineer"),
    "ai-product-engineer": ("ai product engineer", "product engineer ai"),
    "ml-engineer": ("machine learning engineer", "ml engineer", "mlops"),
    "data-engineer": ("data engineer", "analytics engineer"),
    "data-analyst": ("data analyst", "business intelligence"),
    "software-engineer": ("software engineer", "full stack engineer"),
}

# Seniority words in the title, checked in this order.
SENIORITY_PATTERNS = (
    ("intern", r"\bintern(ship)?\b"),
    ("junior", r"\b(junior|jr\.?|entry[\s-]level|new\s+grad|graduate)\b"),
    ("director", r"\b(director|vp|vice\s+president|head\s+of|engineering\s+manager)\b"),
    ("principal", r"\b(principal|distinguished|fellow)\b"),
    ("staff", r"\b(staff|founding|tech(nical)?\s+lead)\b"),
    ("senior", r"\b(senior|sr\.?)\b"),
)
YEARS_PATTERN = r"(\d{1,2})\s*\+?\s*(?:(?:-|to)\s*\d{1,2}\s*)?years?"
YEARS_LIMIT = 30
# Lowest stated years of experience -> level.
YEARS_LEVELS = ((8, "staff"), (5, "senior"), (2, "mid"))

# Words that separate variants of one role.
VARIANT_MARKERS = (
    "senior", "staff", "principal", "lead", "founding", "platform", "junior", "intern",
    "director", "manager",
)

# Legal suffixes dropped from a company name.
COMPANY_SUFFIXES = (
    "inc", "llc", "ltd", "corp", "corporation", "co", "pbc", "gmbh", "sa", "ag", "bv", "plc",
    "limited",
)

# Text that reveals a remote role.
REMOTE_LOCATION_PATTERN = r"\b(remote|anywhere|worldwide|distributed|work\s+from\s+home)\b"
REMOTE_DESCRIPTION_PATTERN = (
    r"\b(fully|100%|entirely)\s+remote\b|\bremote[\s-]first\b|\bwork\s+from\s+anywhere\b"
)
