"""Words, codes, patterns and formats that results depend on, so they can't be chosen freely. Each group says what
it fixes."""

from __future__ import annotations

# fixed: which addresses and numbers are found in texts
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
EMAIL_NOISE = r"(?i)(?:example\.(?:com|org)|sentry\.io|wixpress|godaddy|@2x|\.(?:png|jpe?g|gif|webp|svg|css|js)$)"
GENERIC_LOCAL_PARTS = ("info", "contact", "hello", "enquiries", "admin", "hr", "careers", "jobs")
#: A phone number in running text: grouped, or bare in international or national trunk form.
PHONE = r"(?<![\d+/])(?:(?:\+\d{1,3}[\s.\-]?)?(?:\(\d{1,5}\)|\d{1,5})(?:[\s.\-]\d{2,4}){2,4}|\+\d{8,14}|0\d{8,10})(?![\d])"
PHONE_CONTEXT = r"(?i)\b(?:phone|telephone|tel|mobile|mob|cell|fax|freecall|toll[\s\-]?free|call\s+us(?:\s+on)?|ph)\b[\s:.\-]{0,3}"
# fixed: the platforms, industries and link scores that page records carry
SOCIAL_HOSTS = {
    "linkedin": ("linkedin.com/company", "linkedin.com/in"),
    "twitter": ("twitter.com", "x.com"),
    "facebook": ("facebook.com",),
    "instagram": ("instagram.com",),
    "youtube": ("youtube.com", "youtu.be"),
    "github": ("github.com",),
}
INDUSTRIES = {
    "construction": ("construction", "builder", "civil works", "scaffolding"),
    "healthcare": ("healthcare", "clinic", "nursing", "aged care", "medical centre"),
    "technology": ("software", "saas", "it services", "cloud", "developer", "cyber"),
    "engineering": ("engineering", "mechanical", "electrical contractor", "fabrication"),
    "logistics": ("logistics", "freight", "warehouse", "supply chain", "transport"),
    "hospitality": ("hospitality", "restaurant", "hotel", "catering", "cafe"),
    "finance": ("accounting", "financial services", "bookkeeping", "insurance", "mortgage"),
    "education": ("school", "training", "rto", "education", "academy"),
    "manufacturing": ("manufacturing", "factory", "production line", "assembly"),
    "mining": ("mining", "drilling", "fifo", "resources sector"),
    "retail": ("retail", "store", "ecommerce", "shopfront"),
    "recruitment": ("recruitment", "staffing", "labour hire", "talent acquisition"),
}
PAGE_HINTS = {"contact": 100, "contact-us": 100, "about": 80, "about-us": 80, "careers": 70, "jobs": 70, "work-with-us": 65, "team": 50, "people": 45, "locations": 40, "our-company": 35}
DIRECTORY_HINTS = {"staff-directory": 100, "staff directory": 100, "staff.aspx": 95, "coaching-staff": 90, "coaches": 80, "directory": 70, "staff": 60}
DIRECTORY_PATHS = ("/staff-directory", "/staff.aspx", "/coaches", "/staff", "/sports/staff-directory", "/information/directory", "/athletics/staff-directory")
OPEN_ROLE_MARKERS = ("apply now", "current vacancies", "current openings", "open positions", "we're hiring", "we are hiring", "join our team", "view job")
# fixed: what counts as a next page, a telling title, an address, a host worth following
NEXT_LABELS = ("next", "next page", "next ›", "›", "»")
GENERIC_TITLE_PARTS = ("home", "homepage", "welcome", "index", "contact", "contact us", "about", "about us")
AU_STREET = r"\d{1,5}[\w\s./'\-]{3,60},?\s+[A-Za-z\s]{3,30},?\s+(?:NSW|VIC|QLD|WA|SA|TAS|ACT|NT)\s+\d{4}"
SKIP_HOSTS = (
    r"(?i)(?:^|\.)(?:google\.\w+|gstatic\.com|googleapis\.com|doubleclick\.net|facebook\.com|instagram\.com|twitter\.com|x\.com|"
    r"linkedin\.com|youtube\.com|youtu\.be|tiktok\.com|pinterest\.\w+|whatsapp\.com|t\.me|wordpress\.(?:com|org)|wix\.com|"
    r"squarespace\.com|shopify\.com|godaddy\.com|cloudflare\.com|jsdelivr\.net|unpkg\.com|bootstrapcdn\.com|fontawesome\.com|"
    r"gov\.au|gov\.uk|\.gov|w3\.org|schema\.org|creativecommons\.org|apple\.com|microsoft\.com|adobe\.com|amazon\.com|paypal\.com|"
    r"stripe\.com|mailchimp\.com|eventbrite\.\w+|trustpilot\.com|yelp\.\w+)$"
)
NOT_ATHLETICS_HOSTS = r"(?i)(?:^|\.)(?:facebook\.com|twitter\.com|x\.com|instagram\.com|youtube\.com|youtu\.be|tiktok\.com|linkedin\.com|ticketmaster\.\w+|seatgeek\.com|ncaa\.com|ncaa\.org|espn\.com)$"
ATHLETICS_LINK = r"(?i)\bathletics\b|\bvarsity sports\b|\bgo\s+\w+s\b"
BINARY_PATH = r"(?i)\.(?:pdf|jpe?g|png|gif|svg|zip|docx?|xlsx?|mp4)$"
CAREERS_PATH = r"career|jobs|vacanc|work-with-us"

# fixed: how the columns of staff tables are named
COLUMN_ALIASES = {
    "name": "name", "full name": "name", "staff member": "name", "title": "title", "position": "title", "job title": "title", "role": "title",
    "email": "email", "e-mail": "email", "email address": "email",
    "phone": "phone", "telephone": "phone", "phone number": "phone", "office phone": "phone", "contact": "phone",
}
# fixed: the sports and genders that labels are made of
SPORTS = (
    "baseball", "basketball", "beach volleyball", "bowling", "cheerleading", "cross country", "equestrian", "fencing", "field hockey", "flag football",
    "football", "golf", "gymnastics", "ice hockey", "lacrosse", "rifle", "rowing", "rugby", "sailing", "skiing", "soccer", "softball", "squash",
    "swimming", "diving", "tennis", "track & field", "track and field", "triathlon", "volleyball", "water polo", "wrestling", "crew",
)
GENDER_WORDS = {"men's": "Men", "women's": "Women", "mens": "Men", "womens": "Women", "men": "Men", "women": "Women", "boys": "Men", "girls": "Women"}
SPORT_MERGES = {"Swimming": "Swimming & Diving", "Diving": "Swimming & Diving", "Crew": "Rowing"}
# fixed: how titles and names are cleaned, and which of them are none
COACH_TITLE = r"(?i)\bcoach(?:es|ing)?\b"
NOT_COACH_TITLE = r"(?i)\bassistant to\b|\bsecretary\b|\bcoordinator of coaching\b"
TITLE_SECTION = r"(?i)^athletics(?:\s+department)?\b[\s:|/·—–-]*"
TITLE_LABEL = r"(?i)\b(?:e-?mail(?:\s*address)?|phone(?:\s*number)?|telephone|tel|office|cell|mobile|fax|contact)\s*[:.]\s*"
TITLE_TAIL = r"(?i)[\s\-–—·|,]*\b(?:full\s+bio(?:\s+for\b.*)?|bio|e-?mail(?:\s+\S+@\S+)?|phone|telephone|tel|profile|twitter|instagram|facebook)\s*$"
TITLE_EDGE = " \t-–—·|,;:/"
SKIP_NAME = r"(?i)^(?:name|staff|full name|\s*)$"
PLACEHOLDERS = (
    "tba", "tbd", "tbn", "t ba", "t bd", "t b a", "t b d", "to be announced", "to be determined", "to be named", "to be hired", "to be filled",
    "to be confirmed", "vacant", "vacancy", "open", "open position", "position open", "staff tbd", "staff tba", "none", "unknown", "no name", "n a", "na",
)
NAME_SUFFIX = r"(?i)^(?:[JS]r|I{1,3}|IV|V|VI{0,3}|Ph\.?D|Ed\.?D|M\.?[DSA]|D\.?M\.?D|CPA|Esq)\.?$"
NAME_JERSEY = r"^#\s*\d{1,3}\s+"
NAME_CLASS_YEARS = r"(?:\s*['‘’ʼ]\s*\d{2}\s*)+$"
NAME_LEADING_YEAR = r"^\s*['‘’ʼ]\s*\d{2}\s*[),.\]]?\s+"
GENERIC_HEADING = (
    r"(?i)^(?:(?:campus\s*|employee\s*|faculty(?:\s*(?:and|&)\s*staff)?\s*|staff\s*)?(?:directory|listing|search(?:\s*results)?|index)"
    r"|staff|coaches|contact\s*us|athletics|jump\s*to.*|skip\s*to.*|filter\s*by.*|sort\s*by.*|back\s*to\s*top|[A-Z0-9]\s*[-–—]\s*[A-Z0-9]|[A-Z])$"
)
# fixed: what marks a profile link, a sport page, a split address, a stock picture
PROFILE_PATH = r"(?i)/staff-directory/|/staff/|/coaches/|/roster/|/bios?/"
PROFILE_LINK = r"/staff-directory/[a-z0-9-]+/\d+"
SPORT_SLUG = r"/sports/([a-z][a-z0-9-]{2,40})/"
SPLIT_EMAIL = r"(?is)firstHalf\s*=\s*[\"']([^\"']+)[\"'].*?secondHalf\s*=\s*[\"']([^\"']+)[\"']"
STOCK_IMAGE = r"(?i)placeholder|no[-_]?(?:photo|image|headshot)|default|silhouette|blank|generic|spacer|logo|avatar"
# fixed: how a school's name is read from a page title
NOT_A_SCHOOL = (
    r"(?i)^(?:campus|staff|faculty|employee|college|university|athletics?)?[\s&/-]*(?:staff|faculty|employee|campus|phone|contact|people|personnel)?[\s&/-]*"
    r"(?:directory|listing|list|search|index|home ?page)\s*$"
)
SCHOOL_TITLE_PREFIX = r"(?i)^(?:the\s+)?official\s+(?:home|website|athletics?\s+(?:website|site))\s+of\s+"
SCHOOL_TITLE_SEGMENT = r"(?i)^(?:the\s+)?official\s+(?:athletics?|athletic)\s+(?:website|site|home)|^official\s+home$|^athletic\s+programs$"
SCHOOL_KIND = r"(?i)\b(?:college|university|universität|institute|academy|school|seminary|polytechnic|conservatory)\b"

# fixed: outcome codes with their labels, divisions and levels
OUTCOME_LABELS = {
    "ok": "scraped",
    "empty": "directory found but no people parsed",
    "blocked": "blocked the bot (HTTP 403/429)",
    "robots": "disallowed by robots.txt",
    "network": "network failure / timeout",
    "no_directory": "no staff directory found",
    "error": "unhandled error",
}
RETRYABLE = ("blocked", "network", "error")
SELF_NAMED_DIVISIONS = ("NAIA", "NJCAA", "CCCAA", "NWAC")
LEVELS = {
    "ncaa division i": ("NCAA", "DI"), "ncaa division ii": ("NCAA", "DII"), "ncaa division iii": ("NCAA", "DIII"),
    "naia": ("NAIA", "NAIA"), "junior college": ("NJCAA", "NJCAA"), "njcaa": ("NJCAA", "NJCAA"),
}
JUCO_BODIES = {"CCCAA": r"(?i)\bCCCAA\b|California Community College Athletic", "NWAC": r"(?i)\bNWAC\b|Northwest Athletic Conference"}
# fixed: how the columns of spreadsheets are named
SHEET_ALIASES = {
    "school": "school", "schoolname": "school", "name": "school", "institution": "school", "level": "level", "division": "level", "association": "level",
    "conference": "conference", "state": "state", "city": "city", "teampagelink": "link", "teampage": "link", "link": "link", "url": "link", "athleticsurl": "link", "website": "link",
}
# fixed: codes of states, provinces and regions
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware",
    "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
    "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island",
    "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "PR": "Puerto Rico", "VI": "U.S. Virgin Islands", "GU": "Guam",
    "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador", "NS": "Nova Scotia",
    "ON": "Ontario", "PE": "Prince Edward Island", "QC": "Quebec", "SK": "Saskatchewan",
}
REGIONS = {
    "Northeast (New England)": ("CT", "ME", "MA", "NH", "RI", "VT"),
    "Northeast (Middle Atlantic)": ("NJ", "NY", "PA"),
    "Midwest (East North Central)": ("IL", "IN", "MI", "OH", "WI"),
    "Midwest (West North Central)": ("IA", "KS", "MN", "MO", "NE", "ND", "SD"),
    "South (South Atlantic)": ("DE", "DC", "FL", "GA", "MD", "NC", "SC", "VA", "WV"),
    "South (East South Central)": ("AL", "KY", "MS", "TN"),
    "South (West South Central)": ("AR", "LA", "OK", "TX"),
    "West (Mountain)": ("AZ", "CO", "ID", "MT", "NV", "NM", "UT", "WY"),
    "West (Pacific)": ("AK", "CA", "HI", "OR", "WA"),
    "Territories": ("PR", "VI", "GU"),
    "Canada": ("AB", "BC", "MB", "NB", "NL", "NS", "ON", "PE", "QC", "SK"),
}
# fixed: status codes that are kept, refused or retried
CACHEABLE = (200, 201, 203, 204, 301, 308, 404, 410)
BLOCKED_STATUSES = (401, 403, 405, 406, 429, 451)
ROBOTS_STATUS, NETWORK_STATUS = 999, 0
PERMANENT_ERRORS = ("getaddrinfo failed", "name or service not known", "nodename nor servname", "temporary failure in name resolution", "no address associated with hostname")
# fixed: conference codes and the line formats of member lists
NAIA_CONFERENCES = {
    "AAC": "Appalachian Athletic Conference", "Am. Midwest": "American Midwest Conference", "CAC": "Continental Athletic Conference",
    "Cal Pac": "California Pacific Conference", "Cascade": "Cascade Collegiate Conference", "CCAC": "Chicagoland Collegiate Athletic Conference",
    "Chicagoland": "Chicagoland Collegiate Athletic Conference", "Crossroads": "Crossroads League", "Frontier": "Frontier Conference",
    "GPAC": "Great Plains Athletic Conference", "GSAC": "Golden State Athletic Conference", "HAAC": "Heart of America Athletic Conference",
    "HBCUAC": "HBCU Athletic Conference", "KCAC": "Kansas Collegiate Athletic Conference", "Mid-South": "Mid-South Conference",
    "Red River": "Red River Athletic Conference", "RSC": "River States Conference", "Sooner": "Sooner Athletic Conference",
    "SSAC": "Southern States Athletic Conference", "SUN": "The Sun Conference", "TSC": "The Sun Conference", "WHAC": "Wolverine-Hoosier Athletic Conference",
}
MEMBER_LINE = r"^(.+?)\s*[–-]\s*([A-Z]{2})\s+(\S.*?)\s*$"
MEMBER_TOTAL = r"Total Schools\s*\((\d+)\)"
WIKI_HEADING = r"^===\s*([^=]+?)\s*===$"
WIKI_ENTRY = r"^\*\s*\[\[([^\]]+)\]\]\s*(.*)$"
WIKI_CITY = r"\bin\s+(?:\[\[([^\]|]+)(?:\|([^\]]+))?\]\]|([^\[\]]+?))\s*$"
WIKI_REFERENCE = r"^\*\s*\[?http"
WIKI_PLAIN = r"^\*\s*([^\[\]]+?)\s+in\s+[^\[\]]+$"
DIVISION_CODES = {"1": "DI", "2": "DII", "3": "DIII", "I": "DI", "II": "DII", "III": "DIII", "NAIA": "NAIA", "NJCAA DI": "NJCAA", "NJCAA DII": "NJCAA", "NJCAA DIII": "NJCAA"}
OWNERSHIP = {1: "Public", 2: "Private (not-for-profit)", 3: "Private (for-profit)"}
# fixed: the notes that enrichment and salvage leave on records, and the details of outcomes
NO_MATCH_NOTE = "no College Scorecard match — academics and cost unfilled"
OPEN_ADMISSION_NOTE = "no admissions test scores — open-admission two-year college"
TEST_OPTIONAL_NOTE = "no test scores published (test-optional reporting)"
TITLE_NOTE = "sport read from the job title (campus directory, no sport column)"
EMPTY_DETAIL = "page fetched but no staff rows recognised"
ATHLETICS_KIND = "athletics directory"
GENERAL_KIND = "general directory, coaches only"
OK_DETAIL = " with an email address ("

#: How one maker of athletics sites marks a person's card, its name and its title.
CARD_MARKS = (("data-test-id", "s-person-card-list__root"), ("class", "s-person-card--list"), ("class", "s-person-card"))
CARD_NAME = "s-person-details__personal-single-line"
CARD_TITLE = "s-person-details__position"
