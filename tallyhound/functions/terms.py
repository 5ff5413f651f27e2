"""Word lists, weights, labels and patterns whose content decides results."""

# Industries that fit, matched in all company text.
INDUSTRY_TERMS = (
    "b2b", "saas", "logistics", "operations", "marketplace", "supply chain", "fintech", "healthtech", "insurtech", "commerce",
    "productivity", "manufacturing", "distribution", "wholesale", "healthcare", "education", "university", "college", "housing",
    "construction", "engineering services", "professional services", "accounting", "legal services", "local government", "council",
    "public sector", "utilities", "energy", "water", "transport", "rail", "haulage", "freight", "warehousing", "facilities",
    "hospitality", "retail", "agriculture", "charity", "housing association", "nhs",
)
# Competitors and public bodies, matched in name, domain and industry.
COMPETITOR_TERMS = (
    "digital agency", "software agency", "web agency", "creative agency", "marketing agency", "dev agency", "development agency",
    "software consultancy", "it consultancy", "tech consultancy", "software development shop", "web development agency",
    "design studio", "development studio",
)
PUBLIC_BODY_TERMS = (
    "council", "university", "college", "school", "nhs", "ministry", "government", "authority", "constabulary", "police",
    "fire and rescue", "ambulance", "hospital", "trust", "library", "museum", "borough", "county", "district", "national", "royal",
    "department for", "department of", "office for", "office of", "agency",
)
CRYPTO_TERMS = ("crypto", "web3", "blockchain", "nft", "defi")
SCORING_FREE_MAIL = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com")

# Intent weights by signal type.
INTENT_WEIGHTS = {
    "PROCUREMENT_NOTICE": 90,
    "PROCUREMENT_HISTORY": 40,
    "STALE_ENGINEERING_ROLE": 85,
    "AGING_ENGINEERING_ROLE": 68,
    "HIRING_SPIKE": 78,
    "OPERATIONS_SOFTWARE_NEED": 72,
    "TECH_STACK_NEED": 62,
    "FUNDING_EVENT": 58,
    "PRODUCT_LAUNCH": 52,
    "HIRING_DISCOVERY": 46,
    "ATS_BOARD_DETECTED": 20,
}
TENDER_TYPES = ("PROCUREMENT_NOTICE", "PROCUREMENT_HISTORY")
TECH_TYPES = ("STALE_ENGINEERING_ROLE", "AGING_ENGINEERING_ROLE", "HIRING_SPIKE", "OPERATIONS_SOFTWARE_NEED", "TECH_STACK_NEED")
LIVE_FUNDED_TYPES = ("PROCUREMENT_NOTICE", *TECH_TYPES, "FUNDING_EVENT")
ORG_TYPES = ("GITHUB_ENGINEERING_ORG_DETECTED", "GITHUB_ORG_SMALL_FOOTPRINT", "NO_GITHUB_ORG_FOUND")
# Rank of a company's triggers, best first.
TRIGGER_RANK = (
    "PROCUREMENT_NOTICE", "STALE_ENGINEERING_ROLE", "AGING_ENGINEERING_ROLE", "HIRING_SPIKE", "OPERATIONS_SOFTWARE_NEED",
    "TECH_STACK_NEED", "FUNDING_EVENT", "PROCUREMENT_HISTORY",
)

# Job titles.
ROLE_KEYWORDS = (
    "engineer", "engineering", "developer", "software", "backend", "front end", "frontend", "full stack", "fullstack", "platform",
    "data", "product", "automation", "devops", "site reliability", "sre",
)
NON_TECHNICAL_TITLES = (
    "account executive", "account manager", "business development", "sales development", "sales representative", "underwriter",
    "controller", "recruiter", "talent partner", "social media", "office manager", "executive assistant", "paralegal", "bookkeeper",
)
TECH_STACK_TERMS = (
    "api", "apis", "aws", "azure", "django", "etl", "fastapi", "gcp", "integration", "integrations", "kubernetes", "migration",
    "next.js", "node", "postgres", "postgresql", "python", "react", "salesforce", "snowflake", "typescript", "workflow",
)
OPERATIONS_TERMS = (
    "automation", "back office", "business operations", "crm", "dashboard", "data pipeline", "internal tool", "internal tooling",
    "marketplace operations", "operations", "platform", "process", "reporting", "workflow",
)
OPERATIONS_TITLES = ("operations", "platform", "product", "data", "automation")

# Discovery event names, and the confidence of the signals they make.
DISCOVERY_TYPES = {
    "funding": "FUNDING_EVENT", "funding_news": "FUNDING_EVENT", "funding_announcement": "FUNDING_EVENT",
    "launch": "PRODUCT_LAUNCH", "product_launch": "PRODUCT_LAUNCH",
    "hiring": "HIRING_DISCOVERY", "hiring_post": "HIRING_DISCOVERY", "who_is_hiring": "HIRING_DISCOVERY",
    "discovery": "DISCOVERY", "company_discovery": "DISCOVERY",
    "procurement_notice": "PROCUREMENT_NOTICE", "tender": "PROCUREMENT_NOTICE", "procurement": "PROCUREMENT_NOTICE",
    "procurement_history": "PROCUREMENT_HISTORY", "past_tender": "PROCUREMENT_HISTORY",
}
DISCOVERY_CONFIDENCE = {"FUNDING_EVENT": 0.8, "PRODUCT_LAUNCH": 0.75, "HIRING_DISCOVERY": 0.85, "PROCUREMENT_NOTICE": 0.9, "PROCUREMENT_HISTORY": 0.65}

# E-mail addresses.
ROLE_LOCAL_PARTS = (
    "careers", "career", "jobs", "job", "hiring", "recruiting", "recruitment", "hr", "talent", "apply", "work", "workwithus",
    "joinus", "membership", "admin", "administrator", "abuse", "billing", "compliance", "contact", "enquiries", "enquiry",
    "feedback", "help", "hello", "hi", "info", "inquiries", "legal", "mail", "marketing", "media", "news", "newsletter", "no-reply",
    "noreply", "office", "postmaster", "press", "privacy", "sales", "security", "support", "team", "webmaster",
)
DISPOSABLE_DOMAINS = (
    "mailinator.com", "guerrillamail.com", "10minutemail.com", "tempmail.com", "throwaway.email", "yopmail.com", "trashmail.com",
    "sharklasers.com",
)
FREE_MAIL_DOMAINS = (
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com", "protonmail.com", "proton.me", "gmx.com",
    "mail.com",
)
JUNK_LOCAL_PARTS = ("email", "your", "name", "example", "user", "someone")
SENDABLE = ("deliverable_domain", "role_address")

# Kinds of web presence, first match wins.
PRESENCE_PATTERNS = (
    ("linkedin", r"(?i)linkedin\.com/(company|in)/"),
    ("x", r"(?i)(twitter\.com|x\.com)/[A-Za-z0-9_]+"),
    ("ats_board", r"(?i)(greenhouse\.io|lever\.co|ashbyhq\.com|workable\.com|myworkdayjobs\.com)"),
    ("careers", r"(?i)/(careers|jobs|vacancies|join-us)"),
    ("blog", r"(?i)/(blog|news|insights)"),
    ("docs", r"(?i)(docs\.|/docs|/documentation)"),
)

# Job boards.
RESERVED_BOARD_TOKENS = (
    "js", "css", "json", "api", "embed", "embeds", "widget", "widgets", "static", "assets", "cdn", "img", "images", "fonts",
    "script", "scripts", "style", "styles", "dist", "build", "public", "favicon", "robots",
)
ASSET_PATTERN = r"(?i)\.(js|mjs|css|json|map|png|jpe?g|svg|gif|ico|woff2?|txt|xml)$"
BOARD_PLATFORMS = (
    "applicantpro.com", "greenhouse.io", "lever.co", "ashbyhq.com", "workable.com", "entertimeonline.com", "bamboohr.com",
    "smartrecruiters.com", "teamtailor.com",
)
CAREERS_PREFIXES = ("careers.", "jobs.", "job.", "apply.", "boards.", "engineering.", "share.", "go.", "app.", "secure7.")
NON_COMPANY_HOSTS = (
    "whoishiringjobs.com", "weworkremotely.com", "remoteok.com", "otta.com", "wellfound.com", "angel.co", "builtin.com", "dice.com",
    "indeed.com", "glassdoor.com", "ziprecruiter.com", "simplyhired.com", "jobs.lever.co", "bit.ly", "lnkd.in", "youtu.be",
    "youtube.com", "grnh.se", "arxiv.org", "techcrunch.com", "crunchbase.com", "themuse.com", "github.com", "github.io",
    "gitlab.com", "medium.com", "twitter.com", "x.com", "linkedin.com", "news.ycombinator.com", "docs.google.com", "forms.gle",
    "notion.so", "notion.com",
)

# People.
ROLE_PATTERN = (
    r"(?i)\b(co[- ]?founder|founder|founder\s*&\s*ceo|ceo|coo|cmo|cro|cbo|cto|chief\s+[a-z ]+\s+officer|"
    r"head\s+of\s+(?:business|growth|partnerships|sales|revenue|product|marketing|operations)|"
    r"vp\s+(?:business|business development|growth|partnerships|sales|revenue|product|marketing|operations)|"
    r"vice\s+president\s+of\s+(?:business|business development|growth|partnerships|sales|revenue|product|marketing|operations)|"
    r"director\s+of\s+(?:business development|growth|partnerships|sales|revenue|product|marketing|operations))\b"
)
# Roles of contact candidates, tried in this order; names that are roles; inboxes that are nobody's, parts of such, and those worth a look.
CANDIDATE_ROLES = (
    r"(?i)\b(co[-\s]?founder|founder)\b", r"(?i)\b(chief executive officer|ceo)\b", r"(?i)\b(chief technology officer|cto)\b", r"(?i)\b(chief operating officer|coo)\b",
    r"(?i)\b(vp engineering|vice president engineering|vice president of engineering)\b", r"(?i)\b(head of engineering|engineering director|director of engineering)\b",
    r"(?i)\b(head of product|vp product|vice president product|chief product officer)\b", r"(?i)\b(head of operations|vp operations|vice president operations|operations director)\b",
    r"(?i)\b(head of talent|vp talent|talent director)\b",
)
CANDIDATE_ROLE_NAMES = {"ceo": "CEO", "cto": "CTO", "coo": "COO", "founder": "Founder", "co-founder": "Co-Founder", "co founder": "Co-Founder"}
ROLE_NAMES = ("Chief Technology", "Chief Executive", "Vice President", "Head Of")
GENERIC_INBOXES = (
    "admin", "billing", "careers", "contact", "employment", "hello", "help", "hi", "hiring", "hr", "info", "jobs", "legal", "media", "membership", "office", "press", "privacy",
    "recruiting", "sales", "security", "support", "team", "talent",
)
GENERIC_INBOX_PARTS = ("career", "employ", "hiring", "recruit", "sales", "support", "talent")
APPROVABLE_INBOXES = ("careers", "contact", "employment", "hello", "hi", "hiring", "hr", "jobs", "recruiting", "talent", "team")
PERSON_PATTERN = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b"

# Legal suffixes of company names, and country aliases.
COMPANY_SUFFIX = r"(?i)\b(inc|inc\.|llc|ltd|ltd\.|limited|corp|corp\.|corporation|co|co\.|company|plc|gmbh|ag|bv|s\.a\.|sa|sas|pte|pty)\b"
COUNTRY_ALIASES = {
    "usa": "United States", "us": "United States", "u.s.": "United States", "u.s.a.": "United States",
    "united states of america": "United States", "uk": "United Kingdom", "u.k.": "United Kingdom",
}

# Review queue.
QUALITY_RANK = {
    "strong_direct_person": 10, "role_backed_direct_email": 20, "mailto_direct_email": 30, "direct_email_needs_context": 40,
    "fallback_generic_inbox": 80, "reject_external_domain": 90, "reject_low_value_generic": 95,
}
SOURCE_ACTIONS = {
    "scale_commercially": "Scale collection and outreach; it has commercial proof.",
    "scale_source_fix_contacts": "Keep this source, but improve contact resolution before widening sends.",
    "drop_or_rework_source": "Pause or rework parser/source selection.",
    "needs_more_sample": "Collect a larger sample before deciding.",
    "ready_for_small_outreach": "Run a small suppression-checked outreach test.",
    "keep_testing": "Keep bounded experiments and compare against other sources.",
    "legacy_archived_source": "Archived legacy adapter; exclude from active MVP source decisions.",
}

# Areas of message drafts; an area is taken if one of its (field, word, whole word only) is found. Then words that no cut ends with.
PROJECT_AREAS = (
    ("decision and performance systems", (("positioning", "decision", False), ("positioning", "performance", False))),
    ("plant workflow and systems integration", (
        ("positioning", "manufacturing", False), ("service_fit_evidence", "erp", True), ("service_fit_evidence", "qms", True),
        ("service_fit_evidence", "plant floor", False), ("service_fit_evidence", "machines", False),
    )),
    ("agent workflow integrations", (("positioning", "agent", False), ("technology_mentions", "workflow", False), ("technology_mentions", "automation", False))),
    ("operations workflow automation", (("customer_terms", "operations", False), ("service_fit_evidence", "operations", False))),
)
OTHER_AREA = "the open engineering work"
NO_LAST_WORDS = ("and", "as", "for", "not", "of", "on", "or", "the", "to", "with")

# Hosts of job boards and the provider that each means; path segments and file endings that are no board.
BOARD_HOSTS = {"boards.greenhouse.io": "greenhouse", "job-boards.greenhouse.io": "greenhouse", "jobs.lever.co": "lever", "jobs.ashbyhq.com": "ashby", "apply.workable.com": "workable"}

# Words of sectors that buy software, and of companies that build it.
NON_TECHNICAL_SECTORS = (
    "logistics", "transport", "freight", "haulage", "warehousing", "shipping", "manufacturing", "distribution", "wholesale", "retail", "construction", "healthcare", "hospital", "clinic",
    "dental", "veterinary", "pharmacy", "education", "university", "college", "school", "training", "housing", "property", "real estate", "facilities", "hospitality", "hotel", "restaurant",
    "agriculture", "farming", "energy", "utilities", "water", "waste", "recycling", "insurance", "accounting", "legal", "law firm", "professional services", "consulting engineers",
    "government", "council", "public sector", "charity", "non-profit", "nonprofit",
)
TECHNICAL_COMPANIES = (
    "software development", "software company", "saas platform", "developer tools", "open source", "engineering team", "we build software", "technology company", "it consultancy",
    "software agency", "web agency", "app development", "digital agency",
)

# Confidence and verification status of contact evidence that says neither, by source type.
EVIDENCE_CONFIDENCE = {"company_website": 0.75, "founder_personal_website": 0.9, "public_profile": 0.8, "trusted_source_payload": 0.8, "verified_provider": 0.95, "manual_review": 0.9}
EVIDENCE_STATUS = {
    "company_website": "public_source", "founder_personal_website": "public_source", "public_profile": "public_source", "trusted_source_payload": "public_source",
    "verified_provider": "provider_verified", "manual_review": "manual_verified",
}

# Hosts that are never a vendor item's own domain.
VENDOR_HOSTS = (
    "linkedin.com", "lnkd.in", "twitter.com", "x.com", "t.co", "bit.ly", "facebook.com", "instagram.com", "youtube.com", "youtu.be", "medium.com", "github.com", "crunchbase.com",
    "google.com", "docs.google.com",
)
