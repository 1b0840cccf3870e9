"""Rule pack: every word list, lookup and threshold the operators read.

The lists below are user data. ``RulePack`` carries the ones a user may want to
change; it is built on the driver and compiled into column expressions, so no
keyword table is ever joined.
"""

from __future__ import annotations

import dataclasses
import json

# ---------------------------------------------------------------------------
# Default preferences.
# ---------------------------------------------------------------------------
ROLE_TERMS = (
    "senior data scientist", "staff data scientist", "machine learning engineer",
    "machine learning scientist", "ml engineer", "ml scientist", "applied ai",
    "ai engineer", "ai platform engineer", "mlops", "ai systems",
)
PLACE_TERMS = ("toronto", "remote canada", "canada remote", "canada")
SKILL_TERMS = (
    "machine learning", "ml systems", "databricks", "mlflow", "kubernetes",
    "experimentation", "forecasting", "recommendation systems", "genai", "llm",
    "rag", "evaluation", "evaluation frameworks", "evaluation pipelines",
    "ai agents", "agentic", "mlops",
)
DOMAIN_TERMS = (
    "marketing", "loyalty", "personalization", "recommendation",
    "recommendations", "growth", "retention", "lifecycle", "crm", "customer",
    "shopping", "search", "pricing", "experimentation", "causal inference",
    "incrementality", "forecasting",
)
TIER_A = (
    "cohere", "waabi", "shopify", "wealthsimple", "stackadapt", "ada",
    "workday", "snowflake", "thomson reuters",
)
TIER_A_NEEDS_AI_FOCUS = ("workday", "thomson reuters")
TIER_B = ("dropbox", "clio", "mongodb", "dayforce", "kinaxis", "fullscript")
TIER_C = (
    "scotiabank", "td", "td bank", "rbc", "royal bank", "bmo", "cibc",
    "national bank", "manulife", "sun life", "sunlife", "empire life",
    "intact", "desjardins", "bell", "rogers", "telus", "loblaw",
    "canadian tire",
)
AI_NATIVE = ("doppel", "cohere", "waabi", "ada", "stackadapt", "snowflake")
STRATEGIC_TERMS = (
    "ai engineering", "ai platform", "applied ai", "ai systems",
    "machine learning", "ml systems", "production ml", "mlops", "llm", "rag",
    "embeddings", "guardrails", "evaluation", "ai agents", "agentic",
    "detection systems", "recommendation systems", "architecture", "architect",
)
LIMITED_TERMS = (
    "aml", "anti-money laundering", "compliance", "regulatory", "reporting",
    "dashboard", "business intelligence", "tableau", "excel", "contract",
)
APPLY_AT = 80
INVESTIGATE_AT = 60

# Skill names looked for in message text, in output order.
SKILL_NAMES = (
    "Python", "SQL", "Spark", "Databricks", "MLflow", "Kubernetes",
    "Feature Engineering", "Experimentation", "Recommendation Systems",
    "Recommendations", "LLM", "Agentic AI", "AI Agents",
    "Retrieval-Augmented Generation", "RAG", "Model Monitoring", "MLOps",
    "LangGraph", "MCP", "OpenAI", "Distributed systems", "Forecasting",
    "ML Platform", "Production ML", "Personalization", "Bayesian methods",
    "Airflow", "AI platform", "Feature stores", "Model deployment",
    "Evaluation Frameworks", "Evaluation pipelines", "Tool Calling",
    "Tool use", "Enterprise AI", "Distributed inference",
    "Prompt optimization", "AI safety", "Vector databases", "Excel",
    "PowerPoint", "Tableau", "Meta Ads", "Google Ads", "Attribution",
)

# Relevance markers (sender, text, noise).
SENDER_MARKERS = (
    "linkedin", "greenhouse.io", "lever.co", "ashbyhq.com", "indeed",
    "glassdoor", "wellfound", "workday", "smartrecruiters", "workable",
    "jobs-noreply", "careers", "recruiter",
)
TEXT_MARKERS = (
    "job alert", "jobs you may be interested", "is hiring", "we're hiring",
    "we are hiring", "hiring a", "hiring an", "recruiter", "role:", "company:",
    "apply:", "application", "contract opportunity", "job opportunity",
    "recruiting opportunity", "career", "senior data scientist",
    "staff data scientist", "data scientist", "machine learning engineer",
    "ml engineer", "applied ai", "ai engineer", "mlops",
)
NOISE_MARKERS = (
    "security alert", "verification code", "google account was recovered",
    "receipt", "payment", "balance for", "a table you requested",
    "room rental", "fifa fan festival", "hydrosols", "spotify", "meetup",
    "ai tinkerers", "happening today", "thanks for joining us",
    "open to connecting", "survey opportunity", "paid survey", "maiy thai",
    "work from office", "thank you for applying",
    "thank you for your application", "thanks for applying",
    "application received", "virtual interview", "just messaged you",
    "messaged you",
)

# Company spellings and title acronyms.
COMPANY_NAMES = {
    "ada": "Ada", "ada cx": "Ada CX", "bmo": "BMO", "cibc": "CIBC",
    "clio": "Clio", "cohere": "Cohere", "dayforce": "Dayforce",
    "doppel": "Doppel", "dropbox": "Dropbox", "empire life": "Empire Life",
    "fullscript": "Fullscript", "kinaxis": "Kinaxis", "mongodb": "MongoDB",
    "reddit": "Reddit", "reddit, inc": "Reddit, Inc.",
    "scotiabank": "Scotiabank", "shopify": "Shopify",
    "snowflake": "Snowflake", "stackadapt": "StackAdapt", "td": "TD",
    "thomson reuters": "Thomson Reuters", "waabi": "Waabi",
    "wealthsimple": "Wealthsimple", "workday": "Workday",
}
ACRONYMS = (
    ("Ai", "AI"), ("Ml", "ML"), ("Llm", "LLM"), ("Rag", "RAG"),
    ("Mlop", "MLOp"), ("Mlops", "MLOps"),
)
# Spellings used inside score explanations.
DISPLAY_NAMES = {
    "rbc": "RBC", "bmo": "BMO", "cibc": "CIBC", "td": "TD",
    "mongodb": "MongoDB", "stackadapt": "StackAdapt",
}
# Sender domains and signature lines that name a company.
SENDER_COMPANIES = (
    ("dayforce", "Dayforce"), ("cohere", "Cohere"), ("mongodb", "MongoDB"),
    ("wealthsimple", "Wealthsimple"), ("shopify", "Shopify"),
)
SIGNATURE_COMPANIES = ("Dayforce", "Cohere", "Shopify", "Clutch", "Wealthsimple", "MongoDB")

# Terms behind the scoring predicates.
CORE_ROLE_TERMS = (
    "data scientist", "machine learning engineer", "machine learning scientist",
    "ml engineer", "ml scientist",
)
TARGET_ROLE_TERMS = (
    "data scientist", "machine learning", "ml engineer", "ml scientist",
    "applied ai", "ai engineer",
)
AI_FOCUS_TERMS = (
    "ai", "applied ai", "machine learning", "ml ", "mlops", "llm", "rag",
    "genai", "platform", "architecture", "architect", "databricks",
    "evaluation", "agent",
)
HIGH_INTENT_TERMS = (
    "ai engineering", "ai platform", "applied ai", "ai systems", "llm", "rag",
    "embeddings", "guardrails", "evaluation", "ai agents", "agentic",
    "detection systems", "recommendation systems", "architecture", "architect",
)

# Card-line vocabulary of multi-posting messages.
CARD_NOISE_LINES = (
    "linkedin", "view job", "apply", "save", "promoted", "recommended",
    "see more jobs", "show all jobs", "job alert",
)
CARD_NOISE_PARTS = (
    "be one of the first", "applicants", "jobs similar to",
    "you may be interested", "unsubscribe", "manage alerts",
    "privacy policy", "user agreement",
)
CARD_ROLE_TERMS = (
    "data scientist", "machine learning", "ml engineer", "mlops", "ml ops",
    "ai engineer", "applied ai", "platform engineer", "scientist", "engineer",
    "architect",
)

# Wording of closed postings, month names.
EXPIRED_PHRASES = (
    "job expired", "job has expired", "job is expired",
    "no longer accepting applications", "no longer available",
    "position has closed", "posting has closed",
    "this job is no longer available", "this job posting has expired",
)
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
)

# Section headers (start, stop).
PREFERRED_HEADERS = ("preferred", "nice to have")
SECTION_STOPS = ("apply", "posted", "salary", "location", "requirements", "responsibilities")

# Categories, statuses, command words.
APPLY, INVESTIGATE, SKIP = "Apply now", "Investigate", "Skip"
STATUSES = ("New", "Reviewed", "Applied", "Skipped", "Follow-up needed")
STATUS_ALIASES = {
    "new": "New", "reviewed": "Reviewed", "applied": "Applied",
    "skipped": "Skipped", "skip": "Skipped",
    "follow-up needed": "Follow-up needed",
    "followup needed": "Follow-up needed",
    "follow-up": "Follow-up needed", "followup": "Follow-up needed",
}
COMMAND_STATUSES = {
    "new": "New", "reviewed": "Reviewed", "review": "Reviewed",
    "applied": "Applied", "apply": "Applied", "skipped": "Skipped",
    "skip": "Skipped", "followup": "Follow-up needed",
    "follow": "Follow-up needed",
}

# Hosts and path words of URL resolution. A rejected host also
# rejects all of its sub-domains.
BLOCKED_HOSTS = ("linkedin.com", "www.linkedin.com", "ca.linkedin.com")
REJECTED_HOSTS = (
    "linkedin.com", "indeed.com", "glassdoor.com", "ziprecruiter.com",
    "monster.com", "talent.com", "simplyhired.com", "jooble.org",
    "workopolis.com", "flexjobs.com", "career.io", "remoteok.com",
    "expertini.com", "builtin.com", "lensa.com", "careerbuilder.com",
    "metaintro.com", "himalayas.app", "remote-work.app", "tealhq.com",
)
ATS_MARKERS = ("greenhouse.io", "lever.co", "ashbyhq.com", "myworkdayjobs.com", "workdayjobs.com")
CAREER_PATH_WORDS = ("career", "careers", "job", "jobs", "opening", "openings", "position")
GENERIC_PATHS = ("career", "careers", "job", "jobs", "opening", "openings", "position", "positions")
TITLE_STOP_WORDS = ("and", "or", "the", "a", "an", "to", "for", "of", "in", "on", "with")
SEARCH_SITES = (
    "boards.greenhouse.io", "jobs.lever.co", "jobs.ashbyhq.com",
    "myworkdayjobs.com", "workdayjobs.com",
)
SEARCH_WORDS = ("careers", "greenhouse", "lever", "ashby", "workday")

# Page gates and markers.
DESCRIPTION_MIN_CHARS = 500
AUTHWALL_PHRASES = ("sign in", "join linkedin", "login", "authwall")
LOGIN_WALL_PHRASES = (
    "sign in", "we're signing you in", "discover people, jobs, and more",
    "if you remain on this page", "user agreement", "cookie policy",
    "guest controls",
)
DESCRIPTION_MARKERS = (
    "responsibilities", "requirements", "qualifications", "about the role",
    "what you'll do", "what you will do", "experience", "apply",
)
HIDDEN_TAGS = ("script", "style", "noscript", "svg", "canvas")


@dataclasses.dataclass(frozen=True)
class RulePack:
    """User preferences consumed by filtering, extraction and scoring."""

    #: Characters of a body that the relevance filter reads; all if None.
    scan_chars: int | None = None
    role_terms: tuple[str, ...] = ROLE_TERMS
    place_terms: tuple[str, ...] = PLACE_TERMS
    skill_terms: tuple[str, ...] = SKILL_TERMS
    domain_terms: tuple[str, ...] = DOMAIN_TERMS
    tier_a: tuple[str, ...] = TIER_A
    tier_b: tuple[str, ...] = TIER_B
    tier_c: tuple[str, ...] = TIER_C
    always: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    ai_native: tuple[str, ...] = AI_NATIVE
    strategic_terms: tuple[str, ...] = STRATEGIC_TERMS
    limited_terms: tuple[str, ...] = LIMITED_TERMS
    apply_at: int = APPLY_AT
    investigate_at: int = INVESTIGATE_AT
    allowed_senders: tuple[str, ...] = ()

    @classmethod
    def from_json(cls, text: str) -> RulePack:
        """Build a pack from a JSON object; absent fields keep their default."""
        given = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})

    def skill_labels(self) -> dict[str, str]:
        """Lower-cased skill keyword -> label, first spelling wins, in output order."""
        labels: dict[str, str] = {}
        for name in SKILL_NAMES + tuple(term.title() for term in self.skill_terms):
            labels.setdefault(name.lower(), name)
        return labels

    def sender_tokens(self) -> tuple[str, ...]:
        return tuple(s.strip().lower() for s in self.allowed_senders if s.strip())


def display_name(term: str) -> str:
    """Spelling of a configured company inside explanations."""
    return DISPLAY_NAMES.get(term, term.title())


DEFAULT_RULES = RulePack()
