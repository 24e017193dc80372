"""Fixed values, thresholds and the category dimension seed.

Everything in the block marked FIXED VALUES must stay equal to the behaviour being
reproduced (rule order, patterns, names, colours, limits); it is data, not logic.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reproduced application's behaviour)
# ---------------------------------------------------------------------------

# URL rules: first matching category wins, in this declaration order. Patterns are
# case-insensitive and unanchored (searched anywhere in the URL).
URL_RULES: list[tuple[str, list[str]]] = [
    ("Mindless Scroll", [
        r"instagram\.com\/reels",
        r"youtube\.com\/shorts",
        r"tiktok\.com",
        r"facebook\.com\/(watch|reels)",
    ]),
    ("Focused Work", [
        r"github\.com\/.*\/pull",
        r"github\.com\/.*\/issues",
        r"notion\.so",
        r"linear\.app",
        r"figma\.com",
        r"canva\.com",
        r"docs\.google\.com\/document",
        r"docs\.google\.com\/spreadsheets",
        r"overleaf\.com",
        r"replit\.com",
        r"codesandbox\.io",
        r"stackblitz\.com",
        r"vscode\.dev",
    ]),
    ("Learning", [
        r"coursera\.org",
        r"udemy\.com",
        r"edx\.org",
        r"khanacademy\.org",
        r"codecademy\.com",
        r"freecodecamp\.org",
        r"udacity\.com",
        r"pluralsight\.com",
        r"skillshare\.com",
        r"leetcode\.com",
        r"hackerrank\.com",
        r"brilliant\.org",
        r"duolingo\.com",
        r"youtube\.com.*\/watch.*tutorial",
        r"youtube\.com.*\/watch.*learn",
        r"youtube\.com.*\/watch.*course",
        r"linkedin\.com\/learning",
        r"reddit\.com\/r\/learnprogramming",
        r"reddit\.com\/r\/askscience",
        r"reddit\.com\/r\/history",
    ]),
    ("Research", [
        r"stackoverflow\.com",
        r"github\.com(?!.*\/(pull|issues))",
        r"medium\.com",
        r"dev\.to",
        r"arxiv\.org",
        r"scholar\.google\.com",
        r"wikipedia\.org",
        r"docs\.",
        r"documentation",
        r"readthedocs\.io",
        r"npmjs\.com",
        r"pypi\.org",
        r"mdn\.mozilla\.org",
        r"w3schools\.com",
    ]),
    ("Social Connection", [
        r"facebook\.com",
        r"instagram\.com",
        r"twitter\.com",
        r"x\.com",
        r"linkedin\.com",
        r"reddit\.com",
        r"discord\.com",
        r"whatsapp\.com",
        r"telegram\.org",
        r"pinterest\.com",
        r"tumblr\.com",
    ]),
    ("Relaxation", [
        r"youtube\.com\/watch",
        r"netflix\.com",
        r"hulu\.com",
        r"disneyplus\.com",
        r"primevideo\.com",
        r"spotify\.com",
        r"twitch\.tv",
        r"soundcloud\.com",
        r"vimeo\.com",
        r"chess\.com",
        r"lichess\.org",
        r"steam",
    ]),
    ("Communication", [
        r"mail\.google\.com",
        r"outlook\.live\.com",
        r"outlook\.office\.com",
        r"slack\.com",
        r"teams\.microsoft\.com",
        r"zoom\.us",
        r"meet\.google\.com",
        r"webex\.com",
        r"calendar\.google\.com",
    ]),
]

# Category dimension seed: (id, name, description, color, wellness_type); id = position.
CATEGORY_SEED: list[tuple[int, str, str, str, str]] = [
    (1, "Focused Work", "Deep work and productivity", "#4CAF50", "productive"),
    (2, "Learning", "Educational content and skill development", "#2196F3", "growth"),
    (3, "Research", "Information gathering and exploration", "#9C27B0", "growth"),
    (4, "Social Connection", "Meaningful social interactions", "#FF9800", "social"),
    (5, "Relaxation", "Intentional rest and recovery", "#00BCD4", "rest"),
    (6, "Mindless Scroll", "Passive content consumption", "#F44336", "drain"),
    (7, "Communication", "Email, messaging, and collaboration", "#FFC107", "productive"),
    (8, "Uncategorized", "Sessions awaiting categorization", "#9E9E9E", "unknown"),
]

# Category name -> wellness type used by the score (not the dimension column).
WELLNESS_TYPE_BY_NAME: dict[str, str] = {
    "Focused Work": "productive",
    "Learning": "growth",
    "Research": "growth",
    "Social Connection": "social",
    "Relaxation": "rest",
    "Mindless Scroll": "drain",
    "Communication": "productive",
    "Uncategorized": "unknown",
}

# Ideal share per wellness type, subtracted in this order.
IDEAL_SHARES: list[tuple[str, float]] = [
    ("productive", 0.35),
    ("growth", 0.25),
    ("rest", 0.25),
    ("social", 0.15),
]
DRAIN_PENALTY = 30

# Score labels: (minimum score, label); below the last threshold -> last label.
SCORE_LABELS = [(70, "Great balance!"), (50, "Room for improvement")]
SCORE_LABEL_LOW = "Consider rebalancing"

DEFAULT_CATEGORY_NAME = "Uncategorized"
DEFAULT_CATEGORY_COLOR = "#9E9E9E"
DEFAULT_WELLNESS_TYPE = "unknown"

# Internal pages are never tracked.
INTERNAL_URL_PREFIXES = ["chrome://", "chrome-extension://"]
INTERNAL_URL_PARTS = ["localhost", "127.0.0.1"]

# Time thresholds, milliseconds.
AUTOSAVE_MS = 30_000
MIN_CHUNK_MS = 3_000
CHUNK_ID_FACTOR = 1 << 20   # autosave chunks of one session that have an id of their own
INGEST_LOOKBACK_MS = 120_000
INGEST_MAX_GAP_MS = 35_000
CLEANUP_MAX_GAP_MS = 120_000
DISPLAY_MERGE_WINDOW_MS = 300_000
IDLE_AFTER_MS = 60_000
BREAK_EVERY_MS = 3_600_000
LATE_NIGHT_FROM_HOUR = 1
LATE_NIGHT_UNTIL_HOUR = 7
DAY_MS = 86_400_000

# Limits.
SESSION_LIST_LIMIT = 100
CONTEXT_SESSION_LIMIT = 200
CONTEXT_SITES_PER_CATEGORY = 5
REFLECTION_HISTORY_LIMIT = 20
SIMILAR_TOP_K = 8
SCORE_HISTORY_DAYS = 7
LOCAL_BACKUP_CHUNKS = 500
BACKLOG_LIMIT = 50

# Vector metadata defaults.
VECTOR_DEFAULT_TITLE = "Untitled session"
VECTOR_DEFAULT_SOURCE = "browser_session"

# Text templates: session text (lines), context (head, category block, site, matches).
SESSION_TEXT_HEAD = "Browsing session"
SESSION_TEXT_TITLE, SESSION_TEXT_URL = "Title: ", "URL: "
SESSION_TEXT_DURATION, SESSION_TEXT_CATEGORY = "DurationMinutes: ", "Category: "
SESSION_TEXT_NOTES, SESSION_TEXT_TIME = "Notes: ", "Timestamp: "
CONTEXT_TOTAL, CONTEXT_BY_CATEGORY = "Total sessions: ", "\n\nTime by category:\n"
CONTEXT_TOP_SITES, CONTEXT_SITE = "  Top sites:\n", "    • "
CONTEXT_RELEVANT, CONTEXT_NO_TIME = "\nRelevant sessions for user query:\n", "Unknown time"
NO_ACTIVITY_CONTEXT = "No browsing activity found for this time period."
NO_ACTIVITY_INSIGHT = "No activity recorded yet today. Start browsing to get personalized insights!"

# Named reflection ranges (length before `now`; 'today' = local midnight).
RANGE_LENGTH_MS = {"week": 7 * DAY_MS, "month": 30 * DAY_MS}
RANGE_DEFAULT_MS = DAY_MS
