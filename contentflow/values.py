"""Literals that must be exactly these for results to be right.

Word lists, patterns, prompts, constants and key orders, kept as plain text in one place.
"""

# The characters that count as white space, and the same set as Java patterns. `(?U)\s` knows all of
# them but the four separators, and is several times faster than a class that lists them.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WS = r"(?U:[\s\x1c-\x1f])"
NON_WS = r"(?U:[^\s\x1c-\x1f])"
# A run of white space that is not just one space: collapsing only these gives the same text as
# collapsing every run, without touching each gap between two words.
WS_RUN = r"(?U:[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+)"

# --- content types and item states -------------------------------------------------------------
CONTENT_TYPES = ("text", "audio", "video", "image", "markdown", "url", "json")
GROUP_CHAT_STYLE = 43
APPLE_EPOCH_SECONDS = 978_307_200  # 2001-01-01T00:00:00Z

# --- defaults ----------------------------------------------------------------------------------
LOOKBACK_DAYS = 7
MAX_ARTICLES_PER_FEED = 25
LOOKBACK_HOURS = 24
MAX_MESSAGES = 100
MUTE_AFTER_ERRORS = 5
WARN_AFTER_EMPTY = 5
SUBSTANTIAL_CONTENT = 500
SHORT_CONTENT = 1000
TOPIC_SAMPLE_CHARS = 4000
MESSAGE_MAX_CHARS = 2000
TRUNCATION_RESERVE = 20
TRUNCATION_NOTE = "...\n[Message truncated]"

# --- content sniffing and cleaning -------------------------------------------------------------
MARKDOWN_MARKS = ("*", ">", "- ", "```")
ENRICHMENT_HINTS = ("[...]", "read more", "continue reading")

TAG = r"<[^>]+>"
EMPTY_LINK = rf"\[{WS}*\]\({WS}*\)"
EMPTY_HTTP_LINK = rf"\[{WS}*\]\(http[^)]+\)"
MANY_NEWLINES = r"\n{3,}"
SCRIPT_BLOCK = r"(?s)<script[^>]*>.*?</script>"
STYLE_BLOCK = r"(?s)<style[^>]*>.*?</style>"
COMMENT = r"(?s)<!--.*?-->"
FEED_ENTITIES = (
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
)

ORIGIN_HREF = rf"""(?i)<a{WS}+(?:[^>]*?{WS}+)?href=(["'])(https?://[^"'>]+)\1"""
BARE_URL = r"""(?i)https?://(?U:[^\s\x1c-\x1f<>"')])+"""

# --- dates -------------------------------------------------------------------------------------
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
ZONE_HOURS = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}

# --- podcast links -----------------------------------------------------------------------------
TRANSCRIPT_TYPES = ("application/json", "text/vtt", "text/srt", "text/plain")

# --- prompts -----------------------------------------------------------------------------------
DEFAULT_PROMPT = "Please process the following content:\n\n{content}"
DEFAULT_SYSTEM_MESSAGE = "You are a helpful AI assistant."

PROMPT_PRESETS = {
    "summarize": (
        "Please summarize the following content in a clear and concise manner:\n\n{content}",
        "You are a helpful AI assistant that summarizes content accurately while preserving key information.",
    ),
    "analyze": (
        "Please analyze the following content, highlighting key points, patterns, and insights:\n\n{content}",
        "You are an analytical AI assistant that provides insightful analysis of content.",
    ),
    "format_markdown": (
        "Please convert the following content into well-formatted Markdown suitable for Obsidian notes:\n\n{content}",
        "You are an AI assistant specialized in converting content to clean, well-structured Markdown "
        "for note-taking applications.",
    ),
}

DOMAIN_PROMPT = """Given the following podcast title and transcript sample, determine the specific professional or technical domain this content belongs to. Focus on identifying specialized fields that might have unique terminology (e.g., Brazilian Jiu-Jitsu, Quantum Physics, Constitutional Law, etc.).

Title: {title}

Transcript Sample:
{sample}

Respond with just the domain name, nothing else."""

CORRECTION_PROMPT = """You are a professional transcriptionist with extensive expertise in {domain}. Your task is to correct any technical terms, jargon, or domain-specific language in this transcript that might have been misinterpreted during speech-to-text conversion.

Focus on:
1. Technical terminology specific to {domain}
2. Names of key figures or concepts in the field
3. Specialized vocabulary and acronyms
4. Common terms that might have been confused with domain-specific ones

Transcript:
{transcript}

Provide your response in the following format:

CORRECTED TRANSCRIPT:
[Your corrected transcript here, maintaining all original formatting and structure]

CHANGES MADE:
- List each significant correction you made
- Include the original text and what you changed it to
- If no changes were needed, state that"""

CORRECTION_HEADER = "CORRECTED TRANSCRIPT:\n"
CHANGES_SEPARATOR = "\nCHANGES MADE:"
CORRECTION_FORMAT_ERROR = "Error in correction format"
NO_CORRECTION = "No domain correction applied"
FALLBACK_DOMAIN = "General"

# --- models ------------------------------------------------------------------------------------
# (name, model id, preset, parameters that differ from the common ones)
COMMON_MODEL_PARAMS = {
    "temperature": 0.7,
    "max_tokens": 1000,
    "top_p": 0.95,
    "frequency_penalty": 0.0,
    "presence_penalty": 0.0,
}
MODEL_CATALOGUE = (
    ("gpt4o", "openai/gpt-4o", "format_markdown", {}),
    ("claude", "anthropic/claude-3-7-sonnet", "analyze", {}),
    ("o3mini", "mistralai/o3-mini", "summarize", {}),
    ("deepseek", "deepseek-r1:32b", "format_markdown", {"max_tokens": 2000}),
)
CORRECTION_MODEL = "anthropic/claude-3-5-sonnet"
MODEL_CONCURRENCY = 32
MODEL_RETRIES = 3
MODEL_RETRY_SECONDS = 5.0
BAD_RESPONSE = "Unexpected API response format"
NO_RESULTS = "No results from any processor"

# --- metadata key order of rendered notes ------------------------------------------------------
ARTICLE_KEYS = (
    "title", "url", "author", "feed_id", "feed_title", "description", "word_count",
    "summary", "quality_tier", "quality_score", "labels", "original_id", "guid",
)
EPISODE_KEYS = (
    "title", "podcast_title", "podcast_author", "description", "audio_url", "transcript_source",
    "podcast_id", "original_id", "guid", "summary", "quality_tier", "quality_score",
)
MESSAGE_KEYS = (
    "from_me", "sender", "thread_id", "thread_name", "is_group", "original_id", "message_id",
)
PAGE_KEYS = ("url", "title", "status_code")
TEXT_KEYS = ("size", "source")

# The thread of messages that have neither chat nor sender.
NO_THREAD = "None"
