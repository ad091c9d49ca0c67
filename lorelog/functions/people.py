"""Addresses, names and digests of contributors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorelog.functions.text import trim_space

#: Automation accounts left out by default; fixed values.
EXCLUDED_AUTHORS = (
    "dependabot[bot]", "renovate[bot]", "github-actions[bot]", "gitlab-bot", "imgbot[bot]", "allcontributors[bot]", "snyk-bot", "greenkeeper[bot]", "semantic-release-bot",
)


def normal_address(address: Column) -> Column:
    return F.lower(trim_space(F.coalesce(address, F.lit(""))))


def digest(address: Column) -> Column:
    """The stable id of an address: 16 hexadecimal digits."""
    return F.substring(F.sha2(normal_address(address), 256), 1, 16)


def local_part(address: Column) -> Column:
    """What stands before the last @, empty if nothing does."""
    return F.regexp_extract(normal_address(address), "(?s)^(.+)@[^@]*$", 1)


def noreply_account(address: Column) -> Column:
    """The account in a hosting service's noreply address, empty for other addresses."""
    a = normal_address(address)
    first = F.regexp_extract(a, "^(?:[0-9]+\\+)?([^@+]+)@users\\.noreply\\.github\\.com$", 1)
    return F.when(first != "", first).otherwise(F.regexp_extract(a, "^(?:[0-9]+-)?([^@]+)@users\\.noreply\\.gitlab\\.com$", 1))


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(trim_space(F.coalesce(name, F.lit("")))), "\\s+", " ")


def has_address(text: Column) -> Column:
    return text.rlike("[^\\s@]+@[^\\s@]+")


def is_bot_name(name: Column) -> Column:
    return trim_space(F.coalesce(name, F.lit(""))).endswith("[bot]")


def matches_entry(name: Column, address: Column, entry: str) -> Column:
    """Whether an exclusion entry names this contributor: 16 hex digits are a digest, an @ an address, else name or address text."""
    entry = entry.strip()
    if len(entry) == 16 and all(c in "0123456789abcdef" for c in entry.lower()):
        return digest(address) == entry.lower()
    if "@" in entry:
        return digest(address) == digest(F.lit(entry))
    return (F.lower(trim_space(F.coalesce(name, F.lit("")))) == entry.lower()) | (normal_address(address) == entry.lower())
