"""Fixed values of the SQL, written out here so that a wrong value in the engine shows as a difference."""

# White space: the control characters, the space, and those of Unicode.
WHITESPACE = "".join(map(chr, (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201,
    8202, 8232, 8233, 8239, 8287, 12288,
)))
FEED_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))

DEFAULT_PROMPT_HEAD = "Please process the following content:\n\n"
# (name, text before the content, system message)
PRESETS = (
    (
        "summarize", "Please summarize the following content in a clear and concise manner:\n\n",
        "You are a helpful AI assistant that summarizes content accurately while preserving key information.",
    ),
    (
        "analyze", "Please analyze the following content, highlighting key points, patterns, and insights:\n\n",
        "You are an analytical AI assistant that provides insightful analysis of content.",
    ),
    (
        "format_markdown", "Please convert the following content into well-formatted Markdown suitable for Obsidian notes:\n\n",
        "You are an AI assistant specialized in converting content to clean, well-structured Markdown for note-taking applications.",
    ),
)
DOMAIN_PROMPT = (
    "Given the following podcast title and transcript sample, determine the specific professional or technical domain this "
    "content belongs to. Focus on identifying specialized fields that might have unique terminology (e.g., Brazilian "
    "Jiu-Jitsu, Quantum Physics, Constitutional Law, etc.).\n\nTitle: {title}\n\nTranscript Sample:\n{sample}\n\n"
    "Respond with just the domain name, nothing else."
)
CORRECTION_PROMPT = (
    "You are a professional transcriptionist with extensive expertise in {domain}. Your task is to correct any technical "
    "terms, jargon, or domain-specific language in this transcript that might have been misinterpreted during "
    "speech-to-text conversion.\n\nFocus on:\n1. Technical terminology specific to {domain}\n2. Names of key figures or "
    "concepts in the field\n3. Specialized vocabulary and acronyms\n4. Common terms that might have been confused with "
    "domain-specific ones\n\nTranscript:\n{transcript}\n\nProvide your response in the following format:\n\n"
    "CORRECTED TRANSCRIPT:\n[Your corrected transcript here, maintaining all original formatting and structure]\n\n"
    "CHANGES MADE:\n- List each significant correction you made\n- Include the original text and what you changed it to\n"
    "- If no changes were needed, state that"
)
# (name, model id, most tokens)
MODELS = (
    ("gpt4o", "openai/gpt-4o", 1000),
    ("claude", "anthropic/claude-3-7-sonnet", 1000),
    ("o3mini", "mistralai/o3-mini", 1000),
    ("deepseek", "deepseek-r1:32b", 2000),
)
