"""Classification of commit messages by portable regular expressions.

Word boundaries are spelt out over ASCII word characters, as Java's own are Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the conventional types, and the ordered keyword rules (first match wins) -----------------
CONVENTIONAL = "^(build|chore|ci|docs|feat|fix|perf|refactor|revert|style|test)(\\([^)]*\\))?!?: [^\\n]+"
KEYWORDS = (
    ("revert", "revert"),
    ("merge", "merge branch|merge pull request|merge remote-tracking"),
    ("fix", "fix|fixes|fixed|bugfix|hotfix|patch|resolves?|resolved|correct"),
    ("feat", "add|adds|added|implement|introduce|create|new feature|feature"),
    ("docs", "doc|docs|documentation|readme|comment"),
    ("test", "test|tests|testing|spec|specs"),
    ("refactor", "refactor|rename|restructure|cleanup|clean up|simplify|extract"),
    ("style", "style|format|formatting|lint|prettier|gofmt"),
    ("build", "build|compile|makefile"),
    ("ci", "ci|pipeline|workflow|release|deploy"),
    ("chore", "bump|upgrade|update dependenc|dependency|deps"),
)
#: The order and classes of the golden outputs: refactor and test before docs, chore before style, no build.
GOLDEN_ORDER = ("revert", "merge", "fix", "feat", "refactor", "test", "docs", "chore", "style", "ci")
GOLDEN_CI = "ci|pipeline|workflow|build|release|deploy"
TYPO = "typos?"
WIP = "wip|work in progress|do not merge"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}]"
ISSUE = "(#[0-9]+)|((^|[^A-Za-z0-9_])[A-Z][A-Z0-9]*-[0-9]+)"
# -------------------------------------------------------------------------------------------------------------


def word_pattern(words: str) -> str:
    return f"(?i)(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)"


def subject_of(message: Column) -> Column:
    return F.split(F.coalesce(message, F.lit("")), "\n").getItem(0)


def body_of(message: Column) -> Column:
    """Everything behind the first blank line; empty if there is none."""
    return F.regexp_extract(F.coalesce(message, F.lit("")), "(?s)\\n[ \\t\\r]*\\n(.*)$", 1)


def trim_space(x: Column) -> Column:
    return F.regexp_replace(x, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")


def conventional_type(subject: Column) -> Column:
    """The type of a conventional subject, else empty."""
    return F.regexp_extract(subject, CONVENTIONAL, 1)


def is_conventional(subject: Column) -> Column:
    return subject.rlike(CONVENTIONAL)


def keyword_class(subject: Column, golden: bool = False) -> Column:
    rules = dict(KEYWORDS)
    if golden:
        rules["ci"] = GOLDEN_CI
    out = F.lit("other")
    for name in reversed(GOLDEN_ORDER if golden else [n for n, _ in KEYWORDS]):
        pattern = "(?i)^revert([^A-Za-z0-9_]|$)" if name == "revert" else word_pattern(rules[name])
        out = F.when(subject.rlike(pattern), name).otherwise(out)
    return out


def is_revert(subject: Column, golden: bool = False) -> Column:
    """By the catalogue: the host's own revert subject, or classified so; golden: any subject that begins with the word."""
    trimmed = trim_space(subject)
    if golden:
        return trimmed.rlike("(?i)^revert([^A-Za-z0-9_]|$)")
    kind = F.when(is_conventional(subject), conventional_type(subject)).otherwise(keyword_class(subject))
    return trimmed.startswith('Revert "') | (kind == "revert")


def is_typo_fix(subject: Column) -> Column:
    return trim_space(subject).rlike(word_pattern(TYPO))


def is_wip(subject: Column) -> Column:
    return subject.rlike(word_pattern(WIP))


def has_emoji(subject: Column) -> Column:
    return subject.rlike(EMOJI)


def has_issue_reference(message: Column) -> Column:
    return message.rlike(ISSUE)


def is_merge_subject(subject: Column) -> Column:
    return subject.startswith("Merge ")
