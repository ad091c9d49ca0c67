"""Schemas, configuration, scope, limits and family status."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorelog.functions.paths import EXCLUDED_PATHS
from lorelog.functions.people import EXCLUDED_AUTHORS

HISTORY_VERSION = 5

FILE_CHANGE = "struct<path:string,previous_path:string,added:bigint,deleted:bigint,is_binary:boolean,old_blob:string,new_blob:string>"
MERGE_CHANGE = "struct<path:string,new_blob:string,parents:array<struct<path:string,blob:string>>>"
COMMITS = (
    "hash string, seq bigint, tree string, author_name string, author_email string, author_source_email string, author_ts timestamp_ntz, author_off_min int, "
    f"committer_ts timestamp_ntz, committer_off_min int, parents array<string>, is_merge boolean, subject string, body string, files array<{FILE_CHANGE}>, merge_changes array<{MERGE_CHANGE}>"
)
BLOBS = "oid string, content binary, size bigint, oversized boolean"
TREE = "path string, type string, blob string"
OWNERSHIP = "path string, line_no int, owner_id string, day date, commit_hash string"
EVENTS = "kind string, editor string, owner string, age_days int, year int, commit_hash string, path string, lines bigint"

#: Bounds on what a report lists; verified, never settable.  Fixed values.
LIMITS = {
    "identities": 200,
    "most_modified_files": 25,
    "extensions": 20,
    "directory_activity_entries": 50,
    "coupling_pairs": 200,
    "coupling_graph_nodes": 150,
    "coupling_graph_edges": 400,
    "identities_per_directory": 10,
    "hotspot_entries": 100,
    "churn_files": 100,
    "bulk_commits_listed": 10,
}

#: Reasons in the order in which a status lists them; fixed values.
FAMILY_REASONS = (
    "not_implemented", "empty_population", "cardinality_limit", "low_classification_confidence", "shallow_clone",
    "limit_reached_commits", "limit_reached_size", "limit_reached_duration", "limit_reached_memory", "symlink_escaped_root",
    "capability_unavailable_in_mode", "external_service_unavailable", "binary_file_skipped", "history_rewritten", "unresolved_identity",
)
ERROR_REASONS = (
    "invalid_invocation", "invalid_configuration", "git_unavailable", "git_version_unsupported", "path_not_found", "not_a_repository",
    "path_outside_allowed_roots", "empty_repository", "year_below_threshold", "request_too_large", "shallow_clone",
)


class UserError(ValueError):
    """A refusal with one of ERROR_REASONS; the command line ends with status 2."""

    def __init__(self, reason: str, text: str):
        if reason not in ERROR_REASONS:
            raise ValueError(reason)
        super().__init__(f"{reason}: {text}")
        self.reason = reason


@dataclass(frozen=True)
class Config:
    identities: tuple = ()  # ((canonical address, name, (other addresses...)), ...)
    exclude_authors: tuple = EXCLUDED_AUTHORS
    exclude_paths: tuple = EXCLUDED_PATHS
    outlier_threshold_lines: int = 10_000
    count_merges: bool = False
    date_source: str = "author"
    use_mailmap: bool = True
    anonymize: bool = False
    since: str = ""
    until: str = ""
    year: int = 0
    recency_window_days: int = 30
    cardinality_limits: tuple = ()

    def __post_init__(self):
        if self.date_source not in ("author", "committer"):
            raise UserError("invalid_configuration", f"date_source {self.date_source}")
        if self.outlier_threshold_lines < 1 or self.recency_window_days < 1 or self.year < 0:
            raise UserError("invalid_configuration", "thresholds are positive")
        for name, value in sorted(dict(self.cardinality_limits).items()):
            if LIMITS.get(name) != value:
                raise UserError("invalid_configuration", f"cardinality_limits.{name} is fixed")

    def merged(self, given: dict) -> tuple[Config, list[str]]:
        """Lists add to what is there, an empty list clears it; unknown keys come back as warnings."""
        known, warnings = asdict(self), []
        out = self
        for key, value in given.items():
            if key not in known:
                warnings.append(f"unknown key {key}")
                continue
            if isinstance(value, dict):
                value = tuple(sorted(value.items()))
            elif isinstance(value, list):
                value = tuple(tuple(x) if isinstance(x, list) else x for x in value)
                value = tuple(dict.fromkeys((*getattr(out, key), *value))) if value else ()
            out = replace(out, **{key: value})
        return out, warnings

    def shown(self) -> dict:
        """The configuration as a report shows it: addresses never; names, and entries that name authors, not when anonymised.

        What is hidden stands as a reference, the first digits of its digest.
        """
        hide = lambda x: "ref:" + hashlib.sha256(x.strip().lower().encode()).hexdigest()[:16]
        person = lambda x: hide(x) if self.anonymize or "@" in x else x
        out = asdict(self)
        out["identities"] = [[hide(address), person(name), [hide(x) for x in others]] for address, name, others in self.identities]
        out["exclude_authors"] = [x if x in EXCLUDED_AUTHORS else person(x) for x in self.exclude_authors]
        return out

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Scope:
    """An identity selection (empty: everyone) and a year (0: every year)."""

    ids: frozenset = field(default_factory=frozenset)
    year: int = 0

    def check(self, individual: set[str], given: list[str] | None = None) -> None:
        """Only individually represented identities can be selected, each once."""
        given = list(self.ids) if given is None else given
        if len(set(given)) != len(given) or not set(given) <= individual:
            raise UserError("invalid_invocation", "the selection holds an identity twice, or one that isn't individual")

    def includes(self, id_col: Column | None, year_col: Column | None) -> Column:
        """The fold bucket (null id) is only in the scope of everyone."""
        out = F.lit(True)
        if self.ids and id_col is not None:
            out = out & F.coalesce(id_col.isin(sorted(self.ids)), F.lit(False))
        if self.year and year_col is not None:
            out = out & (year_col == self.year)
        return out


@dataclass
class Status:
    """ok, degraded or skipped, with reasons in their fixed order and the lowest confidence met."""

    status: str = "ok"
    reasons: tuple = ()
    confidence: str | None = None

    def degrade(self, reason: str, confidence: str = "partial") -> Status:
        if reason not in FAMILY_REASONS:
            raise ValueError(reason)
        reasons = tuple(r for r in FAMILY_REASONS if r in {*self.reasons, reason})
        lower = "low" if "low" in (self.confidence, confidence) else "partial"
        return Status("skipped" if self.status == "skipped" else "degraded", reasons, lower)

    @staticmethod
    def skipped(reason: str) -> Status:
        return Status("skipped", (reason,))
