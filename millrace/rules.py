"""Rule data. Platforms, categories and word lists are data, so the operators run on any set of them."""

from __future__ import annotations

from dataclasses import dataclass

# Query parameters that never identify a posting.
TRACKING_PARAMS = ["trk", "trkinfo", "tracking_id", "trackingid", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "refid", "referrer", "lipi", "midtoken", "midsig"]


@dataclass(frozen=True)
class Platform:
    slug: str
    domain: str
    priority: int
    required: tuple[str, ...] = ()
    tracking: tuple[str, ...] = ()
    alias: str | None = None
    id_patterns: tuple[str, ...] = ()
    host: str | None = None
    enabled: bool = True


# Platforms in order of priority, with their URL rules.
PLATFORMS = [
    Platform("linkedin", "linkedin.com", 10, (), ("originalsubdomain", "position", "pagesize", "currentjobid"), "/comm/", (r"/jobs/view/(\d+)",), "www.linkedin.com"),
    Platform("indeed", "indeed.com", 20, ("jk", "vjk"), ("from", "tk", "attributionid", "adid", "cmp", "sid", "co"), None, (r"(?i)[?&]jk=([a-z0-9]+)", r"(?i)[?&]vjk=([a-z0-9]+)")),
    Platform("glassdoor", "glassdoor.com", 40, (), ("src", "s", "emailtype", "guid", "acid"), None, (r"_JO(\d+)",)),
    Platform("wellfound", "wellfound.com", 30, (), ("src", "utm_medium"), None, (r"(?i)/job-listings/([a-z0-9-]+)",)),
]

# URLs that are a posting.
JOB_URLS = [
    r"linkedin\.com/(?:comm/)?jobs/view/\d+", r"indeed\.com/(?:viewjob\?|rc/clk)", r"wellfound\.com/(?:jobs|role|job-listings)/", r"greenhouse\.io/jobs/\d+",
    r"(?i:lever\.co/[a-z0-9-]+/)", r"(?i:myworkdayjobs\.com/\S+/job/\S+)", r"ziprecruiter\.com/(?:jobs|c)/", r"(?i:dice\.com/(?:jobs/)?detail/)",
    r"(?i:glassdoor\.com/(?:job-listing/|partner/joblisting\.htm))",
]

# Parts of URLs that lead to no posting.
OTHER_URLS = [
    "linkedin.com/feed", "linkedin.com/comm/feed", "linkedin.com/home", "linkedin.com/jobs/search", "linkedin.com/comm/jobs/search", "linkedin.com/jobs/browse",
    "linkedin.com/jobs/saved", "linkedin.com/jobs/collections", "linkedin.com/jobs/alerts", "linkedin.com/in/", "linkedin.com/company/", "linkedin.com/mynetwork",
    "linkedin.com/groups", "linkedin.com/posts/", "linkedin.com/my-items", "linkedin.com/notifications", "linkedin.com/messaging", "linkedin.com/help",
    "linkedin.com/comm/help", "linkedin.com/psettings", "linkedin.com/uas", "linkedin.com/safety", "linkedin.com/learning", "linkedin.com/sales", "clk.indeed.com/hp",
    "gld.la", "glassdoor.com/reviews", "glassdoor.com/overview", "glassdoor.com/salary", "glassdoor.com/community", "glassdoor.com/blog", "glassdoor.com/awards",
    "glassdoor.com/index.htm", "glassdoor.com/profile", "glassdoor.com/employers", "glassdoor.com/research",
]

# Anchor texts of navigation, as phrases anywhere and as whole words.
NAV_PHRASES = [
    "unsubscribe", "manage preferences", "email preferences", "notification settings", "notifications settings", "manage your job alerts", "manage your alerts",
    "manage job alerts", "job alert settings", "privacy policy", "terms of use", "help center", "view all jobs", "see all jobs", "see more jobs", "view more jobs",
    "view all", "see all", "see more", "view more", "more jobs", "your other saved jobs", "saved jobs", "saved job", "jobs home", "job search", "search jobs",
    "recommended jobs", "sign in", "sign up", "log in", "create account", "join now", "linkedin home", "visit linkedin", "open to work", "career advice", "manage other jobs",
]
NAV_WORDS = ["manage", "settings", "privacy", "terms", "saved", "recommended", "notifications", "unsubscribe"]
# Anchor texts of a posting's own link, and the weights of link scoring.
APPLY_PHRASES = ["apply now", "apply", "view job", "view position", "job details", "see job"]
KNOWN_DOMAINS = ["linkedin.com", "indeed.com", "wellfound.com", "glassdoor.com"]
BASE_SCORE, ANCHOR_SCORE, DOMAIN_SCORE, JOB_URL_SCORE, MOST_SCORE = 0.5, 0.4, 0.3, 0.6, 0.99

# Categories with their keywords, in order.
CATEGORIES = {
    "PHP": ["php", "php developer", "php engineer"],
    "Laravel": ["laravel", "laravel developer", "laravel engineer"],
    "Backend": ["backend", "back-end", "server-side", "backend developer", "backend engineer"],
    "AI": ["ai", "artificial intelligence", "generative ai", "ai engineer", "ai developer"],
    "LLM": ["llm", "large language model", "llm engineer", "llm engineering"],
    "Python": ["python", "python developer"],
    "OpenCart": ["opencart", "open cart", "opencart developer"],
    "Machine Learning": ["machine learning", "machine learning engineer"],
    "Generative AI": ["generative ai", "generative ai engineer"],
}

# Lengths that fields are cut to.
FIELD_CUT, URL_CUT, SUBJECT_CUT = 255, 2048, 998
# Hours of the posted-age options.
AGE_HOURS = {"24h": 24, "7d": 168, "1m": 744}

# Words of a search keyword that name a role, roles that make a phrase with a technology, and words of mixed stacks.
ROLE_WORDS = {"developer", "engineer", "programmer", "backend", "frontend", "fullstack", "software", "architect", "analyst", "manager", "lead", "consultant", "devops", "specialist", "senior", "junior", "staff", "principal"}
ROLES = ["developer", "engineer", "programmer", "backend", "frontend", "fullstack", "architect", "analyst", "consultant", "devops", "specialist", "lead", "manager"]
STACK_WORDS = {"csharp", "c", "dotnet", "aspnet", "angular", "react", "node", "nodejs", "javascript", "typescript", "python", "java", "ruby", "go", "kotlin", "swift", "php", "laravel"}
