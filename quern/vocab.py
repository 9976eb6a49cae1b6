"""Word lists, patterns and constants that results depend on."""

from __future__ import annotations

# ---- Fixed values: these must stay as they are for equal results; their order decides ties. ----

PAGE_TYPES: dict[str, list[str]] = {
    "faculty": ["faculty", "professors?", "staff", "people", "directory", "bio", "profile", "cv", "resume", "research.*team"],
    "department": ["department", "school.*of", "college.*of", "division", "program", "academic.*unit"],
    "research": ["research", "lab", "laboratory", "center.*for", "institute", "project", "publication", "paper"],
    "admissions": ["admissions?", "apply", "application", "prospective", "undergraduate", "graduate", "degree"],
    "academics": ["academics?", "curriculum", "courses?", "degree", "majors?", "minors?", "concentrations?"],
    "student_life": ["student.*life", "campus.*life", "activities", "clubs", "organizations", "housing", "dining"],
    "news": ["news", "press", "announcement", "event", "calendar"],
    "about": ["about", "mission", "history", "overview", "welcome"],
    "contact": ["contact", "location", "address", "phone", "email", "directory"],
}

PAGE_SUBTYPES: dict[str, dict[str, list[str]]] = {
    "faculty": {
        "individual_profile": ["/people/[^/]+$", "/faculty/[^/]+$", "/staff/[^/]+$"],
        "faculty_listing": ["/faculty/?$", "/people/?$", "/staff/?$"],
        "department_faculty": ["/faculty/[^/]+/[^/]+$", "department.*faculty"],
    },
    "department": {
        "department_home": ["^/(?:dept|department|school)/?$"],
        "program_page": ["/programs?/[^/]+", "/majors?/[^/]+"],
        "curriculum": ["curriculum", "courses?", "requirements"],
    },
    "research": {
        "research_center": ["/centers?/", "/institutes?/", "/labs?/"],
        "research_project": ["/projects?/", "/research/[^/]+"],
        "publications": ["publications?", "papers?", "bibliography"],
    },
    "admissions": {
        "undergraduate": ["undergraduate", "bachelors?", "bs.*degree"],
        "graduate": ["graduate", "masters?", "phd", "doctoral"],
        "application_form": ["apply.*now", "application.*form"],
    },
    "academics": {
        "course_catalog": ["catalog", "courses?/?$", "schedule"],
        "degree_requirements": ["requirements", "checklist", "plan.*study"],
        "academic_calendar": ["calendar", "semester", "quarter"],
    },
    "student_life": {
        "housing": ["housing", "residence", "dormitor"],
        "activities": ["activities", "clubs", "organizations"],
        "services": ["services", "support", "counseling"],
    },
    "news": {
        "news_article": [r"/news/\d{4}/", r"/press/\d{4}/", "article"],
        "events": ["events?", "calendar", "upcoming"],
        "press_release": ["press.*release", "media.*kit"],
    },
    "about": {
        "mission": ["mission", "vision", "values"],
        "history": ["history", "timeline", "founded"],
        "leadership": ["leadership", "administration", "board"],
    },
    "contact": {
        "directory": ["directory", "phonebook", "contacts"],
        "location": ["location", "address", "map", "directions"],
        "contact_form": ["contact.*form", "get.*touch"],
    },
}

URL_PATTERNS: list[tuple[str, str]] = [
    ("faculty_profile", "/(?:faculty|people|staff)/([^/]+)/?$"),
    ("department_page", "/(?:dept|department|school)/([^/]+)/?$"),
    ("course_page", "/(?:courses?|classes?)/([^/]+)"),
    ("research_project", "/(?:research|projects?)/([^/]+)"),
    ("news_article", r"/(?:news|press)/(\d{4})/([^/]+)"),
    ("academic_year", r"/(\d{4}[-/]\d{4}|\d{4})/"),
    ("file_download", r"\.(?:pdf|doc|docx|ppt|pptx|xls|xlsx)$"),
    ("media_file", r"\.(?:jpg|jpeg|png|gif|svg|mp4|avi|mov)$"),
]
URL_FALLBACKS: list[tuple[str, list[str]]] = [
    ("faculty_profile", ["/people/", "/faculty/"]),
    ("department_page", ["/departments/", "/dept/"]),
    ("course_page", ["/courses/", "/classes/"]),
    ("research_project", ["/research/"]),
    ("news_article", ["/news/"]),
]

CONTENT_INDICATORS: dict[str, list[str]] = {
    "funding_references": ["grant", "funding", "nsf", "nih", "darpa", "dod", "doe", "foundation", "award", "sponsored"],
    "collaboration_indicators": ["partnership", "collaboration", "joint.*venture", "consortium", "alliance", "cooperat"],
    "technology_transfer": ["patent", "license", "commerciali[sz]", "startup", "spinoff", "technology.*transfer", "intellectual.*property"],
    "industry_connections": ["industry", "corporate", "business", "commercial", "enterprise"],
}

SEMANTIC_PATTERNS: dict[str, list[str]] = {
    "academic_focus": [
        "artificial.*intelligence",
        "machine.*learning",
        "computer.*science",
        "engineering",
        "mathematics",
        "physics",
        "chemistry",
        "biology",
        "psychology",
        "sociology",
        "economics",
        "business",
        "medicine",
    ],
    "research_methods": ["qualitative", "quantitative", "experimental", "survey", "case.*study", "ethnographic", "statistical.*analysis"],
    "academic_levels": ["undergraduate", "graduate", "doctoral", "postdoctoral", "bachelors?", "masters?", "phd", "certificate"],
    "institutional_roles": ["dean", "provost", "chancellor", "president", "chair", "director", "coordinator", "administrator"],
    "academic_activities": ["conference", "symposium", "workshop", "seminar", "colloquium", "lecture.*series", "guest.*speaker"],
}

ASSET_EXTENSIONS: dict[str, list[str]] = {
    "documents": [".pdf", ".doc", ".docx", ".txt", ".rtf"],
    "presentations": [".ppt", ".pptx", ".key"],
    "spreadsheets": [".xls", ".xlsx", ".csv"],
    "media": [".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp"],
    "videos": [".mp4", ".avi", ".mov", ".wmv", ".flv", ".webm"],
    "audio": [".mp3", ".wav", ".m4a", ".ogg"],
    "archives": [".zip", ".tar", ".gz", ".rar", ".7z"],
    "code": [".py", ".js", ".html", ".css", ".java", ".cpp", ".c"],
}
ASSET_PATTERNS: dict[str, list[str]] = {
    "documents": ["syllabus", "curriculum", "handbook", "manual", "guide"],
    "presentations": ["slides", "presentation", "lecture"],
    "spreadsheets": ["data", "spreadsheet", "budget", "roster"],
    "media": ["photo", "image", "gallery", "picture"],
    "videos": ["video", "lecture.*recording", "webinar"],
    "audio": ["audio", "podcast", "recording"],
    "archives": ["download", "archive", "backup"],
    "code": ["source.*code", "github", "repository"],
}

EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
SOCIAL_PATTERNS: dict[str, str] = {
    "twitter": r"(?:twitter\.com/|@)([A-Za-z0-9_]+)",
    "facebook": r"facebook\.com/([A-Za-z0-9._]+)",
    "linkedin": r"linkedin\.com/(?:in/|company/)([A-Za-z0-9-]+)",
    "instagram": r"instagram\.com/([A-Za-z0-9_.]+)",
    "youtube": r"youtube\.com/(?:user/|channel/|c/)([A-Za-z0-9_-]+)",
}

TRACKING_PARAMETERS = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid"]
EXCLUDED_EXTENSIONS = [
    "zip",
    "tar",
    "gz",
    "rar",
    "exe",
    "dmg",
    "iso",
    "mp3",
    "mp4",
    "avi",
    "mov",
    "wmv",
    "flv",
    "doc",
    "docx",
    "ppt",
    "pptx",
    "xls",
    "xlsx",
]
EXCLUDED_PATTERNS = [
    "/calendar/",
    "/events/",
    r"\?date=",
    r"\?year=",
    r"\?month=",
    r"/search\?",
    "/login",
    "/admin",
    "/wp-admin",
    "/wp-content/uploads/",
]
ALLOWED_SUBDOMAINS = [
    "www",
    "admissions",
    "academics",
    "research",
    "library",
    "student",
    "faculty",
    "staff",
    "alumni",
    "news",
    "events",
    "athletics",
    "grad",
    "undergraduate",
    "graduate",
]
CHALLENGE_HOSTS = [
    "validate.perfdrive.com",
    "challenges.cloudflare.com",
    "www.google.com/recaptcha",
    "hcaptcha.com",
    "geo.captcha-delivery.com",
]
CHALLENGE_PHRASES = [
    "bot detection",
    "bot manager",
    "automated access",
    "verify you are human",
    "cloudflare",
    "checking your browser",
    "enable javascript",
    "radware",
    "please verify",
    "security check",
    "access denied",
    "captcha",
]

#: Elements dropped before text extraction; markdown drops only the first ten.
DROPPED_ELEMENTS = [
    "script",
    "style",
    "nav",
    "header",
    "footer",
    "aside",
    "noscript",
    "iframe",
    "object",
    "embed",
    "button",
    "input",
    "select",
    "textarea",
    "form",
]

RATE_HEADERS = ["x-ratelimit-remaining", "x-rate-limit-remaining", "ratelimit-remaining", "x-ratelimit-limit"]
PROTECTION_HEADERS = ["cf-ray", "x-sucuri-id", "x-drupal-cache"]

STAGE_RANK = {"failed": -1, "discovered": 0, "fetched": 1, "extracted": 2, "analyzed": 3}
SITEMAP_LOCATIONS = [
    "https://{host}/sitemap.xml",
    "https://{host}/sitemap_index.xml",
    "https://{host}/sitemaps.xml",
    "https://www.{host}/sitemap.xml",
]
# ---- End of fixed values. ----
