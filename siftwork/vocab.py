"""Fixed values. Word lists, labels, weights and limits that decide results; no logic here."""

# ---- sources -------------------------------------------------------------------------------

SOURCES = ["greenhouse", "lever", "hackernews", "ashby", "workable", "himalayas"]

# Sources whose location is a field of its own; the rest is free text.
STRUCTURED_SOURCES = ["greenhouse", "lever", "ashby", "workable", "himalayas"]

SOURCE_LABELS = {
    "greenhouse": "Greenhouse",
    "lever": "Lever",
    "hackernews": "HN Who's Hiring",
    "ashby": "Ashby",
    "workable": "Workable",
    "himalayas": "Himalayas",
}

STATUSES = ["new", "applied", "skipped"]

MAX_SCORE_ATTEMPTS = 3
MAX_ERROR_CHARS = 500
THREAD_AUTHOR = "whoishiring"
THREAD_MAX_AGE_DAYS = 45
MIN_COMMENT_CHARS = 50
RAW_TEXT_CHARS = 2000
EPOCH_MILLIS_ABOVE = 10_000_000_000

WORKABLE_EXTRA_FIELDS = [
    ("department", "Department"),
    ("employment_type", "Employment type"),
    ("experience", "Experience"),
    ("education", "Education"),
    ("function", "Function"),
    ("industry", "Industry"),
]

# Characters a strip removes from both ends.
WHITESPACE = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\u00a0\u2002\u2003\u2009\u2028\u2029\u3000"

# ---- profile defaults ----------------------------------------------------------------------

DEFAULT_MIN_YOE = 0
DEFAULT_MAX_YOE = 99
DEFAULT_MAX_JOB_AGE_DAYS = 30
DEFAULT_MIN_DISPLAY_SCORE = 60
SOURCE_ENABLED_BY_DEFAULT = {
    "greenhouse": True, "lever": True, "hn": False, "ashby": False, "workable": False, "himalayas": False,
}

DIMENSION_WEIGHTS = {
    "role_fit": 0.30,
    "stack_match": 0.25,
    "seniority": 0.20,
    "location": 0.10,
    "growth": 0.10,
    "compensation": 0.05,
}
DIMENSIONS = list(DIMENSION_WEIGHTS)

PRESCORE_GATE = 0.15
PAID_PROVIDERS = ["anthropic", "openai"]
COST_PER_POSTING = 0.005
DEFAULT_RATE_LIMITS = {"max_rpm": 10, "max_tpm": 50_000}

# ---- qualification -------------------------------------------------------------------------

TITLE_STOPWORDS = ["software", "development", "and", "of", "the", "in", "for", "with"]

US_STATE_CODES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY",
    "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND",
    "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
]

US_STATE_NAMES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware",
    "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky",
    "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri",
    "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york",
    "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island",
    "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington",
    "west virginia", "wisconsin", "wyoming", "district of columbia",
]

US_CITIES = [
    "nyc", "sf", "new york", "san francisco", "seattle", "chicago", "boston", "austin", "denver", "atlanta",
    "los angeles", "la", "portland", "miami", "dallas", "houston", "phoenix", "philadelphia", "san jose",
    "san diego", "pittsburgh", "minneapolis", "detroit", "nashville", "charlotte", "raleigh",
    "salt lake city",
]

LOCATION_PLACEHOLDERS = ["n/a", "na", "location", "tbd", "unknown", ""]

# Country and city words that mark a location field as outside the US.
NON_US_PLACES = [
    "denmark", "germany", "france", "uk", "united kingdom", "canada", "australia", "india", "netherlands",
    "sweden", "norway", "finland", "spain", "italy", "portugal", "brazil", "singapore", "japan", "aarhus",
    "copenhagen", "berlin", "london", "paris", "toronto", "sydney", "amsterdam", "stockholm", "dublin",
    "zurich",
]

# The same for free text.
NON_US_PLACES_IN_TEXT = [
    "canada", "uk", "united kingdom", "london", "germany", "berlin", "france", "paris", "australia",
    "sydney", "melbourne", "india", "bangalore", "bengaluru", "amsterdam", "netherlands", "singapore",
    "brazil", "toronto", "ontario", "british columbia", "europe", "latam", "apac", "emea", "dublin",
    "ireland", "israel", "japan", "tokyo", "korea", "seoul", "serbia", "sweden", "norway", "denmark",
    "finland", "new zealand", "auckland", "switzerland", "zurich", "aarhus", "copenhagen", "spain", "italy",
    "portugal", "stockholm",
]

HIRING_SIGNALS = [
    "hiring", "looking for", "seeking", "we need", "join us", "open role", "we're looking", "we are looking",
]
HIRING_WINDOW_WORDS = 50

DEGREE_PATTERNS = [
    r"master'?s degree required",
    r"ms or phd required",
    r"phd required",
    r"must have an? (ms|m\.s\.|master'?s|phd|ph\.d)",
    r"requires? an? (ms|m\.s\.|master'?s|phd|ph\.d)",
    r"minimum.{0,20}master'?s degree",
    r"(ms|phd|master'?s).{0,20}(required|mandatory|must)",
]

YOE_PATTERNS = [
    r"(\d+)\+\s*years?",
    r"(\d+)\s*-\s*(\d+)\s*years?",
    r"minimum\s+(\d+)\s*years?",
    r"at\s+least\s+(\d+)\s*years?",
    r"(\d+)\s*years?\s+of\s+experience",
]

# Paragraph classes, most relevant first.
PARAGRAPH_PATTERNS = [
    r"(requirements?|qualifications?|what you.ll need|what we.re looking for|you should have|must have"
    r"|minimum qualifications?|basic qualifications?)",
    r"(tech(nology)? stack|technologies|tools|languages|frameworks|what you.ll (use|work with)|our stack)",
    r"(about the role|the role|position|responsibilities|what you.ll do|what you will do|your role"
    r"|job description|overview)",
    r"(compensation|salary|pay|equity|benefits|total rewards|what we offer|perks|package)",
    r"(experience|background|years|yoe|seniority)",
    r"(location|remote|hybrid|on-?site|where you.ll work|timezone)",
    r"(about us|about the company|who we are|our mission|our story|what we do|company overview)",
]

# ---- sections ------------------------------------------------------------------------------

SECTIONS = ["summary", "responsibilities", "requirements", "compensation", "benefits"]

# Header phrases per label; the order of the labels decides which one a header gets.
HEADER_PHRASES = {
    "summary": [
        "about the role", "role overview", "role summary", "position overview", "overview", "summary",
        "about this role", "the role", "position summary", "job summary", "job overview",
    ],
    "company": [
        "about us", "about the company", "about the team", "who we are", "our company", "our mission",
        "the company", "company overview",
    ],
    "responsibilities": [
        "responsibilities", "what you'll do", "what you will do", "in this role", "day to day", "day-to-day",
        "what you'll own", "duties", "role expectations", "you will", "key responsibilities",
        "your responsibilities", "the job",
    ],
    "preferred_qualifications": [
        "preferred qualifications", "nice to have", "bonus points", "preferred skills", "ideal candidate",
        "plus if you have", "preferred experience", "bonus if you have",
    ],
    "requirements": [
        "requirements", "qualifications", "must have", "minimum qualifications", "basic qualifications",
        "what we're looking for", "you have", "experience with", "skills", "what you bring", "who you are",
        "experience needed", "required skills", "required qualifications", "what you'll need",
        "you should have", "minimum requirements",
    ],
    "tools_and_skills": [
        "technologies", "tools", "stack", "tech stack", "systems", "platforms", "skills and tools",
        "tools and technologies", "technical skills", "tools we use",
    ],
    "logistics": [
        "location", "schedule", "travel", "work authorization", "visa", "onsite", "hybrid", "remote work",
        "visa sponsorship", "where you'll work",
    ],
    "compensation": [
        "compensation", "salary", "pay range", "salary range", "base pay", "base salary", "hourly rate",
        "ote", "equity", "total compensation",
    ],
    "benefits": [
        "benefits", "perks", "what we offer", "why you'll love", "healthcare", "medical", "pto", "401k",
        "employee benefits",
    ],
}

LABEL_SECTION = {
    "summary": "summary",
    "company": "summary",
    "responsibilities": "responsibilities",
    "requirements": "requirements",
    "preferred_qualifications": "requirements",
    "tools_and_skills": "requirements",
    "logistics": "requirements",
    "compensation": "compensation",
    "benefits": "benefits",
}

SECTION_CHARS = 1400

# ---- lexical score -------------------------------------------------------------------------

ATS_STOPWORDS = [
    "and", "or", "the", "a", "an", "to", "of", "in", "for", "with", "is", "are", "we", "you", "your", "be",
    "as", "at", "by", "it", "its", "from", "this", "that", "have", "has", "will", "can", "our", "their",
]

# ---- retrieval -----------------------------------------------------------------------------

SIMILARITY_FLOOR = 0.05
RETRIEVAL_WEIGHTS = {
    "requirements": 1.10, "responsibilities": 1.05, "summary": 1.00, "compensation": 0.90, "benefits": 0.80,
}
PAY_QUERY_TERMS = [
    "salary", "compensation", "pay", "benefits", "equity", "bonus", "pto", "401k", "medical",
]
TOP_CHUNKS, TOP_CHUNKS_MAX = 50, 200
TOP_JOBS, TOP_JOBS_MAX = 30, 100

# ---- rerank --------------------------------------------------------------------------------

RERANK_TOP_CHUNKS, RERANK_TOP_JOBS, RERANK_FINAL = 80, 40, 15
RERANK_CHUNKS_PER_JOB, RERANK_CHUNKS_PER_JOB_MAX = 4, 8
# Rows a model gets at a time.
ENCODER_BATCH, RERANKER_BATCH, SCORER_BATCH = 8, 16, 8
RERANK_CHUNK_CHARS, RERANK_CHUNK_CHARS_MIN, RERANK_CHUNK_CHARS_MAX = 900, 200, 4000

SECTION_PRIORITY = {
    "requirements": 5, "responsibilities": 4, "summary": 3, "compensation": 2, "benefits": 1,
}
COMPENSATION_TERMS = [
    "salary", "compensation", "pay", "equity", "bonus", "stipend", "base", "ote", "hourly",
]
BENEFITS_TERMS = [
    "benefits", "perk", "perks", "pto", "401k", "medical", "healthcare", "dental", "vision",
]
QUERY_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "backend", "be", "by", "for", "from", "in", "is", "job", "of",
    "on", "or", "role", "seeking", "systems", "the", "to", "with",
]
SENIOR_TITLE_SIGNALS = [
    "senior", "sr.", "staff", "principal", "lead", "director", "vp ", "head of", "manager", "executive",
]
CLEARANCE_PHRASES = [
    "security clearance", "secret clearance", "top secret", "ts/sci", "clearance required",
]
NO_SPONSOR_PHRASES = ["no sponsorship", "no visa", "must be authorized", "us citizen only"]
ONSITE_PHRASES = ["must be located", "must reside", "in-office", "no remote"]

CREDENTIAL_PHRASES = {
    "CPA": ["cpa required", "cpa preferred", "must have cpa", "active cpa", "cpa license"],
    "CFA": ["cfa required", "cfa preferred", "cfa designation", "cfa level", "chartered financial analyst"],
    "PMP": ["pmp required", "pmp preferred", "pmp certification", "pmp certified"],
    "MBA": ["mba required", "mba preferred", "must have mba", "mba degree"],
    "Series 7": ["series 7 required", "series 7 preferred", "series 7 license"],
    "clearance": [
        "security clearance", "secret clearance", "top secret", "ts/sci", "clearance required",
        "active clearance",
    ],
    "degree": [
        "bachelor's degree required", "bs required", "b.s. required", "degree required",
        "must have a degree",
    ],
}

# ---- role families -------------------------------------------------------------------------

ROLE_FAMILIES = [
    "software_engineering", "data_analytics", "finance", "product_management", "operations", "sales",
    "marketing", "design", "internship", "general",
]

FAMILY_TITLES = {
    "software_engineering": [
        "software engineer", "backend engineer", "frontend engineer", "full stack", "fullstack", "swe",
        "platform engineer", "ml engineer", "ai engineer", "devops engineer", "site reliability",
        "infrastructure engineer", "data engineer", "mobile engineer", "ios engineer", "android engineer",
        "firmware engineer",
    ],
    "data_analytics": [
        "data analyst", "data scientist", "analytics engineer", "business analyst", "bi engineer",
        "business intelligence", "quantitative analyst", "research analyst",
    ],
    "finance": [
        "financial analyst", "fp&a", "investment banker", "equity research", "accounting", "auditor",
        "controller", "treasury analyst", "credit analyst", "risk analyst", "portfolio manager",
        "corporate finance", "finance associate", "finance manager",
    ],
    "product_management": [
        "product manager", "product owner", "associate pm", "growth pm", "technical pm", "product lead",
    ],
    "operations": [
        "operations manager", "operations analyst", "program manager", "project manager", "supply chain",
        "logistics", "procurement", "vendor management", "process improvement", "operations associate",
    ],
    "sales": [
        "sales", "account executive", "account manager", "business development", "bdr", "sdr",
        "customer success", "revenue", "enterprise sales", "sales associate",
    ],
    "marketing": [
        "marketing", "growth marketing", "demand generation", "content", "seo specialist", "paid search",
        "email marketing", "lifecycle", "brand", "communications", "public relations",
    ],
    "design": [
        "designer", "ux designer", "ui designer", "product design", "visual design", "brand design",
        "graphic design", "motion design",
    ],
}

FAMILY_SKILLS = {
    "software_engineering": [
        "python", "java", "javascript", "typescript", "golang", "rust", "react", "fastapi", "django", "aws",
        "gcp", "docker", "kubernetes", "postgresql", "redis", "kafka", "apis", "microservices",
    ],
    "data_analytics": [
        "tableau", "power bi", "looker", "dbt", "spark", "hadoop", "pandas", "numpy", "data modeling",
        "etl", "airflow",
    ],
    "finance": [
        "excel", "financial modeling", "fp&a", "gaap", "quickbooks", "bloomberg", "cfa", "cpa", "valuation",
        "variance analysis", "budgeting", "forecasting", "audit",
    ],
    "product_management": [
        "roadmap", "user research", "a/b testing", "experimentation", "stakeholder management", "jira",
        "product strategy", "metrics", "okrs",
    ],
    "operations": [
        "erp", "sap", "oracle", "procurement", "inventory", "six sigma", "lean", "vendor management",
        "process improvement",
    ],
    "sales": [
        "salesforce", "crm", "hubspot", "outbound", "pipeline", "quota", "discovery calls",
        "enterprise accounts",
    ],
    "marketing": [
        "google analytics", "marketo", "seo", "sem", "paid search", "google ads", "email campaigns",
        "content strategy",
    ],
    "design": [
        "figma", "sketch", "adobe", "illustrator", "photoshop", "wireframing", "prototyping",
        "design systems",
    ],
}

# Section weights per family.
FAMILY_SECTION_WEIGHTS = {
    "software_engineering": {"summary": 1.00, "responsibilities": 1.15, "requirements": 1.20, "compensation": 0.90, "benefits": 0.80},
    "data_analytics": {"summary": 1.00, "responsibilities": 1.12, "requirements": 1.18, "compensation": 0.90, "benefits": 0.80},
    "finance": {"summary": 1.00, "responsibilities": 1.15, "requirements": 1.20, "compensation": 0.95, "benefits": 0.80},
    "product_management": {"summary": 1.05, "responsibilities": 1.20, "requirements": 1.15, "compensation": 0.90, "benefits": 0.80},
    "operations": {"summary": 1.00, "responsibilities": 1.20, "requirements": 1.15, "compensation": 0.90, "benefits": 0.80},
    "sales": {"summary": 1.00, "responsibilities": 1.20, "requirements": 1.15, "compensation": 1.00, "benefits": 0.85},
    "marketing": {"summary": 1.05, "responsibilities": 1.15, "requirements": 1.15, "compensation": 0.90, "benefits": 0.80},
    "design": {"summary": 1.05, "responsibilities": 1.15, "requirements": 1.15, "compensation": 0.90, "benefits": 0.80},
    "internship": {"summary": 1.00, "responsibilities": 1.15, "requirements": 1.10, "compensation": 1.10, "benefits": 0.90},
    "general": {"summary": 1.00, "responsibilities": 1.10, "requirements": 1.15, "compensation": 0.90, "benefits": 0.80},
}

TOOL_TOKENS = [
    "excel", "sql", "python", "r", "tableau", "power bi", "salesforce", "hubspot", "jira", "figma", "aws",
    "gcp", "azure", "docker", "kubernetes", "react", "fastapi", "django", "looker", "dbt", "airflow",
    "spark", "bloomberg", "quickbooks", "sap", "oracle", "erp", "google analytics", "marketo", "mailchimp",
    "wordpress", "airtable", "notion", "asana", "linear", "slack", "github", "gitlab", "terraform",
    "ansible", "jenkins", "pandas", "numpy", "pytorch", "tensorflow",
]

FAMILY_CREDENTIALS = {
    "finance": ["cfa", "cpa", "frm", "series 7", "series 66", "mba"],
    "data_analytics": ["google analytics certified", "tableau certified"],
    "software_engineering": ["aws certified", "gcp certified", "azure certified"],
    "marketing": ["google ads certified", "hubspot certified", "facebook blueprint"],
    "product_management": ["cspo", "pmp", "csm"],
    "operations": ["pmp", "six sigma", "lean", "scrum master", "csm"],
}

INTERN_PAY_PREFERENCES = ["paid_only", "unpaid_ok", "no_preference"]

SLUG_SUFFIXES = [" inc", " llc", " ltd", " corp", " co", " company"]

REVIEW_OPTIONAL_COLUMNS = ["Location", "Source", "ATS", "Summary", "Posting", "Filter reason"]
