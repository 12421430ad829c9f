"""Settings of the engine: one frozen record, every scalar overridable by an environment variable of the same name."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

TRUE_WORDS = {"1", "true", "yes", "on"}


def env_value(name: str, default):
    """A typed override: unset or empty keeps the default; booleans are true for 1, true, yes and on; tuples are comma-separated."""
    raw = os.environ.get(name, "").strip()
    if not raw:
        return default
    if isinstance(default, bool):
        return raw.lower() in TRUE_WORDS
    if isinstance(default, tuple):
        return tuple(x.strip().lower() for x in raw.split(",") if x.strip())
    return type(default)(raw)


@dataclass(frozen=True)
class Settings:
    # crawl
    requests_per_second: float = 2.0
    request_timeout_seconds: float = 30.0
    max_retries: int = 3
    retry_backoff_base: float = 1.5
    respect_robots_txt: bool = True
    max_pages: int = 2000
    max_pdfs: int = 500
    max_pdf_size_mb: float = 10.0
    js_render_min_text_chars: int = 200
    js_render_min_html_bytes: int = 5000
    js_render_max_text_html_ratio: float = 0.012
    render_all_html: bool = False
    max_archive_page: int = 3
    allowlist_domains: tuple = ("example.org",)
    # text
    chunk_max_tokens: int = 480
    chunk_overlap_tokens: int = 100
    chunk_min_tokens: int = 25
    boilerplate_doc_fraction: float = 0.5
    boilerplate_min_pages: int = 5
    boilerplate_min_chars: int = 20
    # retrieval
    retrieval_top_k: int = 8
    retrieval_candidate_pool: int = 40
    keyword_boost_weight: float = 0.20
    lexical_matches_per_term: int = 5
    lexical_terms: int = 8
    fuzzy_min_score: float = 82.0
    fuzzy_max_matches_per_term: int = 3
    fuzzy_max_terms: int = 4
    fuzzy_min_term_len: int = 4
    vocab_min_count: int = 2
    similarity_threshold: float = 0.35
    site_words: tuple = ()
    # sessions
    conversation_memory_turns: int = 6
    max_question_chars: int = 1000
    rate_limit_per_minute: int = 20
    embedding_batch_size: int = 64
    not_available_message: str = field(default="The information you're asking about is not available on this website.")

    @classmethod
    def from_env(cls) -> Settings:
        base = cls()
        return cls(**{f.name: env_value(f.name.upper(), getattr(base, f.name)) for f in fields(cls)})


SETTINGS = Settings.from_env()

# Patterns and lists that results depend on.
SITEMAP_CANDIDATES = ("/sitemap_index.xml", "/sitemap.xml", "/wp-sitemap.xml")
ASSET_EXTENSIONS = (
    ".jpg .jpeg .png .gif .webp .svg .ico .bmp .tiff .mp4 .mov .avi .wmv .mkv .webm .mp3 .wav .ogg .zip .gz .tar .rar .7z "
    ".doc .docx .xls .xlsx .ppt .pptx .css .js .json .xml .rss .woff .woff2 .ttf .eot"
).split()
TRAP_SUBSTRINGS = (
    "replytocom=", "?share=", "/wp-json/", "/wp-login", "/wp-admin", "/xmlrpc.php", "/feed/", "?s=", "/search/", "action=", "ical=",
    "outlook-ical", "/events/?", "eventdisplay=", "tribe-bar-date=", "?filter",
)
TRAP_PATTERNS = (r"/\d{4}/\d{2}/\d{2}/", r"/\d{4}-\d{2}-\d{2}", r"[?&](?:tribe-bar-date|eventDate)=")
PRIORITY_HINTS = (
    "department", "service", "office", "contact", "how-to", "apply", "permit", "tax", "vehicle", "records", "court", "election", "voter",
    "health", "road", "bridge", "park", "commissioner", "county-judge", "faq", "hours", "fees", "about",
)
DEPRIORITY_HINTS = ("agenda", "minutes", "/20", "archive", "/tag/", "/category/", "/author/", "notice", "budget-archive")
STOPWORDS = (
    "the a an and or of to in on for at by is are was were be do does did how what when where who which why can could would should i you it "
    "its my me we they them this that with about there here have has will get much any some please tell need want"
).split()
CHROME_TAGS = ("nav", "footer", "script", "style", "noscript", "form")
CHROME_LINES = ("skip to main content", "skip to content", "primary menu", "main menu", "menu", "close", "toggle navigation", "search", "back to top")
NAV_PREFIX = r"(home|menu|search|skip to (main )?content|toggle|previous|next|read more|click here|back to top|share this)"
NAV_PHRASES = ("primary menu", "skip to main content", "skip to content", "main navigation", "toggle navigation")
SHORTCODE = r"(?i)\[/?(?:wpforms|caption|gallery|embed|vc_[\w]+|et_pb_[\w]+|contact-form-7|cq_vc_[\w]+|su_[\w]+)[^\]]*\]"
COURT = r"(\d{2,3}(?:st|nd|rd|th))\s*District Court"
JUDGE = r"(?:Honorable\s+)?Judge\s+([A-Z][A-Za-z.\-]+(?:[ \t]+[A-Z][A-Za-z.\-]+){0,3})"
HEX_COLOUR = r"#(?:[0-9a-fA-F]{6}|[0-9a-fA-F]{3})\b"
RGB_COLOUR = r"rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
CSS_VAR = r"(?i)(--[\w-]*(?:color|primary|secondary|accent|brand|main)[\w-]*)\s*:\s*([^;]+);"
FONT_FAMILY = r"(?i)font-family\s*:\s*([^;}{]+)[;}]"
ICON_FONT = r"icon|glyph|awesome|dashicon|fontello|material"
TRACKERS = (
    r"<!-- Google tag \(gtag\.js\) -->",
    r"<script[^>]*googletagmanager[^>]*>\s*</script>",
    r"<script>\s*window\.dataLayer[\s\S]*?gtag\('config'[\s\S]*?</script>",
    r"<script[^>]*siteanalyze[^>]*>\s*</script>",
    r'<script type="speculationrules">[\s\S]*?</script>',
    r'<script id="wp-emoji-settings"[\s\S]*?</script>',
    r'<script type="module">[\s\S]*?wp-emoji[\s\S]*?</script>',
    r"<script[^>]*wp-emoji-release[^>]*>\s*</script>",
)
ENTITIES = (
    ("&nbsp;", "\u00a0"), ("&#160;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&apos;", "'"), ("&ndash;", "–"), ("&#8211;", "–"),
    ("&mdash;", "—"), ("&#8212;", "—"), ("&lsquo;", "‘"), ("&#8216;", "‘"), ("&rsquo;", "’"), ("&#8217;", "’"), ("&ldquo;", "“"), ("&#8220;", "“"), ("&rdquo;", "”"), ("&#8221;", "”"), ("&hellip;", "…"),
    ("&#8230;", "…"), ("&bull;", "•"), ("&laquo;", "«"), ("&raquo;", "»"), ("&reg;", "®"), ("&trade;", "™"), ("&#038;", "&"), ("&amp;", "&"),
)
