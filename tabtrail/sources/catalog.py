"""Fixture site catalog: maps the driver's ``site_id`` (0..39) to a URL and a title.

These rows are test-input data (see FIXTURES.md), chosen to hit every rule edge: the
unanchored ``x\\.com`` rule, the lookahead rule, internal pages and an unparsable URL.
"""

from __future__ import annotations

# site_id -> (url, title); position in the list is the site_id.
SITES: list[tuple[str, str | None]] = [
    ("https://github.com/acme/app/pull/42", "Fix login PR"),
    ("https://github.com/acme/app/issues/7", "Crash on start"),
    ("https://github.com/acme/app", "acme/app"),
    ("https://github.com/pull", "GitHub"),
    ("https://www.notion.so/roadmap", "Roadmap"),
    ("https://docs.google.com/document/d/1", "Design doc"),
    ("https://docs.google.com/presentation/d/9", "Slides"),
    ("https://www.figma.com/file/1", "Mockups"),
    ("https://www.coursera.org/learn/ml", "ML course"),
    ("https://leetcode.com/problems/two-sum", "Two Sum"),
    ("https://www.youtube.com/watch?v=1&list=python-tutorial", "Python tutorial"),
    ("https://www.youtube.com/watch?v=2", "Cat video"),
    ("https://www.youtube.com/shorts/abc", "Short"),
    ("https://www.tiktok.com/@a", "TikTok"),
    ("https://www.instagram.com/reels/1", "Reel"),
    ("https://www.instagram.com/p/1", "Photo"),
    ("https://www.facebook.com/watch?v=3", "Clip"),
    ("https://www.facebook.com/groups/1", "Group"),
    ("https://www.linkedin.com/learning/sql", "SQL course"),
    ("https://www.linkedin.com/feed", "Feed"),
    ("https://www.reddit.com/r/learnprogramming", "r/learnprogramming"),
    ("https://www.reddit.com/r/aww", "r/aww"),
    ("https://x.com/home", "Home"),
    ("https://www.netflix.com/watch/1", "Movie"),
    ("https://acme.webex.com/meet/1", "Standup"),
    ("https://open.spotify.com/album/1", "Album"),
    ("https://www.twitch.tv/live", "Live"),
    ("https://lichess.org/tv", "Chess"),
    ("https://store.steampowered.com/app/1", "Game"),
    ("https://stackoverflow.com/questions/1", "How to join"),
    ("https://en.wikipedia.org/wiki/Spark", "Spark"),
    ("https://example.org/documentation/intro", "Intro"),
    ("https://mail.google.com/mail/u/0", "Inbox"),
    ("https://app.slack.com/client/1", "Slack"),
    ("https://zoom.us/j/1", "Call"),
    ("https://news.example.com/story/1?utm_source=a", "Local news"),
    ("https://news.example.com/story/1?utm_source=b", "Local news"),
    ("http://localhost:3000/admin", "Admin"),
    ("chrome://settings", "Settings"),
    ("not a url", None),
]

N_SITES = len(SITES)

# Expected first-matching category per site (None = no rule), for the rule tests.
EXPECTED_CATEGORY: list[str | None] = [
    "Focused Work", "Focused Work", "Research", None, "Focused Work", "Focused Work",
    "Research", "Focused Work", "Learning", "Learning", "Learning", "Relaxation",
    "Mindless Scroll", "Mindless Scroll", "Mindless Scroll", "Social Connection",
    "Mindless Scroll", "Social Connection", "Learning", "Social Connection", "Learning",
    "Social Connection", "Social Connection", "Social Connection", "Social Connection",
    "Relaxation", "Relaxation", "Relaxation", "Relaxation", "Research", "Research",
    "Research", "Communication", "Communication", "Communication", None, None, None,
    None, None,
]
