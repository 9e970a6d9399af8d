"""Schemas of the tables and the small fixed dimensions."""
from __future__ import annotations

# Row schemas, as Spark DDL.
PAGE = """url string, status int, final_url string, title string, meta_description string, meta_robots string,
meta_googlebot string, x_robots_tag string, canonical string, h1 array<string>, jsonld_count int, jsonld_types array<string>,
text_chars int, og map<string,string>, naver_site_verification boolean, lang string, response_ms int, error string,
intended_indexable boolean"""

RESPONSE = """url string, status int, final_url string, content_type string, headers map<string,string>, body string,
ms int, redirects int, error string"""

LOG = """schema string, date string, query_id string, engine string, run_no int, mode string, surface string, locale string,
login_state string, search_enabled boolean, campaign_id string, query_fingerprint string, model string, signed_out boolean,
outcome string, error string, cited boolean, cited_urls array<string>, brand_mentioned boolean, competitor_domains array<string>,
note string, recorded_at string"""

QUERY = "id string, text string, type string, note string, fingerprint string"
FINDING = "lane string, severity string, code string, count bigint, urls array<string>, data map<string,string>"
CHECK = "id string, status string, evidence map<string,string>"
SNAPSHOT = "kind string, date string, file string, sha256 string, label string"

# What the audited data model names.
FORM_COLUMNS = (
    "date", "query_id", "query_text", "type", "engine", "run_no", "surface", "locale", "login_state", "search_enabled",
    "campaign_id", "cited", "cited_urls", "brand_mentioned", "competitor_domains", "note",
)
ENGINES = ("chatgpt", "google_aio", "gemini", "claude", "perplexity", "naver_ai", "daum", "copilot", "other")
DEFAULT_ENGINES, AUTOMATABLE = ENGINES[:2], ("chatgpt", "claude")
QUERY_TYPES = ("brand", "nonbrand")
OUTCOMES = ("observed", "error", "unmeasured")
LOGIN_STATES = ("signed_out", "signed_in", "unknown", "not_applicable")
LANES = ("SEO", "AEO", "GEO", "LLMO", "NEO", "reputation")
SEVERITY = {"critical": 0, "warn": 1, "info": 2}
SCORE = {"ok": 0, "warn": 1, "bad": 2, "na": -1}
CHECK_ORDER = {"fail": 0, "warn": 1, "pass": 2, "skip": 3}
SNAPSHOT_KINDS = ("audit", "measure", "verify")
CRAWLERS = {
    "training": ("GPTBot", "ClaudeBot", "Google-Extended"),
    "search": ("OAI-SearchBot", "Claude-SearchBot", "PerplexityBot", "Googlebot", "Bingbot"),
    "fetch": ("ChatGPT-User", "Claude-User", "Perplexity-User"),
    "korean": ("Yeti", "Daumoa"),
}
TITLE_BAND = {"ko": (25, 30), "en": (50, 60)}
DESCRIPTION_BAND = {"ko": (70, 80), "en": (150, 160)}
TITLE_SEPARATORS = ("|", "—", "–", "-", "·", ":")
YES = ("y", "yes", "true", "1", "o", "예", "네", "인용", "있음")
NO = ("n", "no", "false", "0", "x", "아니오", "아니요", "없음")
ASSET_SUFFIXES = (
    "jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "ico", "bmp", "css", "js", "mjs", "map", "json", "xml", "txt",
    "pdf", "zip", "mp4", "webm", "mp3", "wav", "woff", "woff2", "ttf", "otf", "eot", "rss", "atom", "csv", "doc",
    "docx", "xls", "xlsx", "ppt", "pptx",
)
METRIC_RULES = {"noindex": "up_bad", "jsonld_pages": "down_bad", "dup_titles": "up_bad", "sitemap_urls": "shrink20", "pages": "info"}
REMEASURE_DAYS, STALE_DAYS, MIN_RUNS, MIN_DELTA = 14, 30, 5, 0.10
SITEMAP_URLS, SITEMAP_BYTES = 45_000, 45 * 1024 * 1024
TODO = "<<TODO"

# Order in which findings are worked off; True: needs access to the server.
ROADMAP = (
    ("CRAWL_INCOMPLETE", 0, True), ("NOINDEX", 1, True), ("SNIPPET_RESTRICTED", 1, True), ("NAVER_CRAWLER_BLOCKED", 2, True),
    ("AI_CRAWLER_BLOCKED", 3, True), ("THIN_TEXT", 4, True), ("SITEMAP_MISSING", 5, True), ("SITEMAP_NOT_DECLARED", 6, True),
    ("ROBOTS_MISSING", 6, True), ("SITEMAP_CRAWL_MISMATCH", 7, True), ("HTTP_ERROR", 8, False), ("SOFT_404", 9, True),
    ("ALT_HOST_UNREACHABLE", 10, True), ("REDIRECT_HOPS", 11, True), ("TITLE_MISSING", 12, False), ("TITLE_DUPLICATE", 13, False),
    ("DESC_MISSING", 14, False), ("DESC_DUPLICATE", 15, False), ("TITLE_TOO_LONG", 16, False), ("TITLE_TOO_SHORT", 16, False),
    ("DESC_TOO_LONG", 17, False), ("DESC_TOO_SHORT", 17, False), ("H1_MISSING", 18, False), ("H1_MULTIPLE", 19, False),
    ("CANONICAL_MISSING", 20, True), ("CANONICAL_NOT_SELF", 21, True), ("JSONLD_MISSING", 22, False), ("FAQ_MISSING", 23, False),
    ("ORG_JSONLD_MISSING", 24, False), ("ORG_JSONLD_SCATTERED", 25, False), ("AI_CRAWLER_PARTIAL", 26, True),
    ("AI_CRAWLER_UNDECLARED", 27, True), ("NAVER_VERIFY_MISSING", 28, True), ("LLMS_TXT_MISSING", 29, True),
    ("AI_TRAINING_BLOCKED", 30, False),
)
