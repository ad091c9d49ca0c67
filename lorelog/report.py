"""The report: every family in its envelope.  Families run as independent jobs and meet as small Python values."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelog.functions import paths, people
from lorelog.model import LIMITS, Config, Status
from lorelog.operators import annotate, assisted, axes, commit_size, coupling, files, hotspot, identities, interpret, messages, ownership, replay, temporal, worktype

DOCUMENT_VERSION = "2.0"
MIN_YEAR_COMMITS = 10
#: Files in which replay and tree differ that a report names; any one is a fault.
LISTED_DIFFERENCES = 20


def _row(df: DataFrame) -> dict:
    """Absent is not zero: nulls are left out."""
    row = df.first()
    return {k: v for k, v in row.asDict(recursive=True).items() if v is not None} if row else {}


def _rows(df: DataFrame) -> list[dict]:
    return [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in df.collect()]


def envelope(status: Status, metrics: dict | None, method: str, version: tuple[int, int] = (1, 0)) -> dict:
    out = {"version": {"major": version[0], "minor": version[1]}, "status": status.status}
    if status.reasons:
        out["reasons"] = list(status.reasons)
    if status.confidence:
        out["confidence"] = status.confidence
    return out | {"method": method} | ({"metrics": metrics} if metrics is not None else {})


def build(
    annotated: DataFrame, changes: DataFrame, head: DataFrame, config: Config, repository: dict, shallow: bool = False, replayed: DataFrame | None = None, head_lines: DataFrame | None = None, attributes: str = ""
) -> dict:
    """All families over annotated commits (see annotate), their file changes and the head's files (path, text).

    replayed: what replay.replay gives; head_lines: (path, line_no, text) of the head's text files.  Without them the
    families that need them are skipped.
    """
    annotated, changes = annotated.cache(), changes.cache()
    everyone = annotate.analysed(annotated)
    scoped = annotate.scoped_changes(annotated, changes)
    touched = scoped.select(F.col("hash").alias("commit"), "path", F.col("active_date").alias("date"), F.unix_seconds(F.col("local_ts").cast("timestamp")).alias("at"), "previous_path", F.col("old_blob").isNull().alias("is_new"))
    m = temporal.moments(everyone, "identity_id", "local_ts")
    some = not everyone.isEmpty()
    empty = Status().degrade("empty_population")

    def temporal_family() -> dict:
        metrics = _row(temporal.profile(m)) | {"hour_histogram": [r["commits"] for r in _rows(temporal.histogram(m, "hour", range(24)).orderBy("bucket"))]}
        metrics["weekday_histogram"] = [r["commits"] for r in _rows(temporal.histogram(m, "weekday", range(7)).orderBy("bucket"))]
        metrics["month_histogram"] = [r["commits"] for r in _rows(temporal.histogram(m, "month", range(1, 13)).orderBy("bucket"))]
        metrics["year_histogram"] = _rows(temporal.year_histogram(m).orderBy("year"))
        metrics["year_deltas"] = _rows(temporal.year_delta(m).orderBy("year"))
        return envelope(Status(), metrics, "local time in each commit's own offset")

    def size_family() -> dict:
        counted = everyone.join(changes.filter(~F.col("excluded") & ~F.col("is_binary")).groupBy("hash").agg(F.sum("added").alias("added_lines")), "hash", "left")
        sized = counted.select(F.col("hash").alias("commit"), "active_date", F.col("effective_lines").alias("lines"), F.col("included_files").alias("files"), F.coalesce("added_lines", F.lit(0)).alias("added"), "seq")
        metrics = _row(commit_size.profile(sized, config.outlier_threshold_lines))
        metrics |= {"largest_commit": _row(commit_size.largest(sized, config.outlier_threshold_lines, "active_date")), "size_buckets": _rows(commit_size.buckets(sized, config.outlier_threshold_lines))}
        metrics["bulk_commits"] = _rows(commit_size.bulk(sized, config.outlier_threshold_lines, "active_date"))
        status = Status().degrade("cardinality_limit") if metrics["bulk_commit_count"] > LIMITS["bulk_commits_listed"] else Status()
        return envelope(status, metrics, "effective lines of commits that aren't bulk")

    def message_family() -> dict:
        metrics = _row(messages.profile(everyone)) | {"prefix_distribution": _rows(messages.prefixes(everyone)), "keyword_distribution": _rows(messages.keywords(everyone))}
        status = Status().degrade("low_classification_confidence", "low") if metrics["conventional_ratio"] < messages.LOW_CONFIDENCE else Status()
        return envelope(status, metrics, "English keyword rules; accuracy on other languages is unknown")

    def file_family() -> dict:
        paths_touched = touched.select("path").distinct().count()
        metrics = _row(files.counts(touched, head)) | {"most_modified": _rows(files.most_modified(touched, head)), "oldest_untouched": _row(files.oldest_untouched(touched, head))}
        metrics |= {"extension_distribution": _rows(files.extensions(touched, head)), "directory_activity": _rows(files.directory_activity(touched))}
        return envelope(Status().degrade("cardinality_limit") if paths_touched > LIMITS["most_modified_files"] else Status(), metrics, "included paths of analysed commits")

    def coupling_family() -> dict:
        found = coupling.qualifying(touched).cache()
        listed = coupling.pairs(found)
        metrics = _row(coupling.coupled_ratio(found, touched)) | {"pairs": _rows(listed), "graph": _rows(coupling.graph(listed))}
        over = found.count() > LIMITS["coupling_pairs"] or len(metrics["graph"]) < len(metrics["pairs"])
        return envelope(Status().degrade("cardinality_limit") if over else Status(), metrics, "pairs of paths in commits with at most 50")

    included = lambda rows: paths.with_exclusion(rows, "path", config.exclude_paths, attributes).filter("not excluded")
    known = identities.table(everyone.select(F.col("identity_id").alias("id"), F.col("author_ts").alias("at"), F.col("active_date").alias("day"))).cache()
    individual = known.filter("individual").select("id")
    if replayed is not None:
        in_year = F.col("year") == config.year if config.year else F.lit(True)
        owned = included(replay.ownership_lines(replayed)).groupBy("path", "owner_id", "day", F.col("commit_hash").alias("commit")).agg(F.count(F.lit(1)).alias("n")).cache()
        events = included(replay.edit_events(replayed)).filter(in_year).cache()
        limited = not replayed.filter("limited").isEmpty()
        breakdown = worktype.breakdown(events, config.recency_window_days, individual).cache()
    message = F.concat(F.col("subject"), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    per_change = changes.filter(~F.col("excluded") & ~F.col("is_binary")).groupBy("hash").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    told = everyone.join(per_change, "hash", "left").select(
        F.col("identity_id").alias("id"), "hash", F.col("active_date").alias("day"), F.unix_seconds(F.col("author_ts").cast("timestamp")).alias("at"), F.col("effective_lines").alias("lines"), F.col("included_files").alias("files"),
        F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("deleted", F.lit(0)).alias("deleted"), "subject", "body", F.col("is_bulk").alias("bulk"), assisted.tool_of(message).alias("tool"),
    ).withColumn("assisted", F.col("tool").isNotNull())

    def of_lines(metrics, method: str) -> dict:
        """A family over replayed lines."""
        if replayed is None:
            return envelope(Status.skipped("capability_unavailable_in_mode"), None, "")
        found = metrics()
        return envelope(Status().degrade("limit_reached_size") if limited else Status(), found, method)

    def ownership_metrics() -> dict:
        n = F.col("n")
        day = annotated.filter(F.col("hash") == repository.get("head_commit")).select("active_date").first()
        day = F.lit(day[0]) if day else F.current_date()
        seen = known.select(F.col("id").alias("owner_id"), F.col("last_commit_date").alias("last_day"))
        by_owner = ownership.by_owner(owned, n=n)
        spread = files.with_directories(owned)
        per_directory = ownership.by_owner(spread, ["depth", "directory"], n)
        widest = spread.groupBy("depth", "directory").agg(F.sum("n").cast("long").alias("lines")).orderBy(F.desc("lines"), "depth", "directory").limit(LIMITS["directory_activity_entries"])
        metrics = _row(ownership.bus_factor(by_owner)) | _row(ownership.summary(owned, day, seen, n))
        metrics["age_distribution"] = _rows(ownership.age_distribution(owned, n).orderBy("year"))
        metrics["owners"] = _rows(by_owner.join(F.broadcast(individual), F.col("owner_id") == F.col("id"), "left_semi").orderBy(F.desc("lines"), "owner_id"))
        metrics["lines_by_directory"] = _rows(widest.orderBy(F.desc("lines"), "depth", "directory"))
        named = per_directory.join(F.broadcast(widest.select("depth", "directory")), ["depth", "directory"])
        metrics["directory_ownership"] = _rows(ownership.top_owners(named, ["depth", "directory"]).orderBy("depth", "directory", "place"))
        return metrics

    def worktype_metrics() -> dict:
        return {"repository_shares": _row(worktype.shares(breakdown, config.recency_window_days)), "breakdown": _rows(breakdown.orderBy("editor", "owner", "work_class"))}

    def assisted_metrics() -> dict:
        commits = told.select(F.col("hash").alias("commit"), "id", "day", F.col("lines").alias("effective"), "bulk", "assisted")
        edits = events.select(F.col("commit_hash").alias("commit"), "kind", "age_days", "writer", F.col("lines").alias("n"))
        return _row(assisted.summary(commits, owned.groupBy("commit").agg(F.sum("n").alias("n")), edits, config.recency_window_days)) | {"tools": _rows(assisted.tools(told).orderBy(F.desc("commits"), "tool"))}

    def hotspot_family() -> dict:
        listed = _rows(hotspot.churn(touched, limit=LIMITS["churn_files"] + 1))
        status = Status().degrade("cardinality_limit") if len(listed) > LIMITS["churn_files"] else Status()
        metrics = {"churn_files": listed[: LIMITS["churn_files"]]}
        if head_lines is not None:
            metrics["hotspots"] = _rows(hotspot.hotspots(hotspot.frequency(touched), hotspot.complexity(included(head_lines))))
        return envelope(status, metrics, "touches in any rolling 30 days; changes times complexity; proxies, not measures of quality")

    builders = {
        "temporal": temporal_family, "commit_size": size_family, "messages": message_family, "files": file_family, "coupling": coupling_family, "hotspot": hotspot_family,
        "ownership": lambda: of_lines(ownership_metrics, "lines that survive at the head, by forward replay"),
        "worktype": lambda: of_lines(worktype_metrics, "line edits against the owners before them"),
        "ai_archaeology": lambda: of_lines(assisted_metrics, "marks in commit messages; a lower bound"),
    }
    with ThreadPoolExecutor(4) as pool:
        jobs = {name: pool.submit(f) for name, f in builders.items()} if some else {}
        families = {name: jobs[name].result() if some else envelope(empty, {}, "no analysed commits") for name in builders}
    families["static_analysis"] = envelope(Status.skipped("not_implemented"), None, "")
    if shallow:
        for f in families.values():
            if f["status"] != "skipped":
                f |= {"status": "degraded", "confidence": "low", "reasons": [*f.get("reasons", []), "shallow_clone"]}
    names = identities.display_names(everyone, "identity_id", "identity_name", "author_ts", "seq", config.anonymize)
    addresses = everyone.groupBy(F.col("identity_id").alias("id")).agg(F.count_distinct(people.normal_address(F.col("author_source_email"))).alias("source_address_count"))
    listed = _rows(identities.listing(known).join(names, "id", "left").join(addresses, "id", "left").orderBy("aggregate", "first_commit_date", "id"))
    signs = identities.evidence(everyone.join(F.broadcast(individual), F.col("identity_id") == F.col("id"), "left_semi"), "identity_id", "author_name", ["author_email", "author_source_email"])
    candidates = _rows(identities.merge_candidates(signs).orderBy("id", "candidate", "signal"))
    return {
        "document_version": DOCUMENT_VERSION, "metadata": {"configuration_digest": config.digest()}, "repository": repository,
        "configuration": config.shown(), "identities": listed, "merge_candidates": candidates, "families": families,
        "interpretation": _interpretation(families, m, told, touched, head, owned if replayed is not None else None, events if replayed is not None else None, breakdown if replayed is not None else None) if some else {},
    }


def _interpretation(families: dict, m: DataFrame, told: DataFrame, touched: DataFrame, head: DataFrame, owned: DataFrame | None, events: DataFrame | None, breakdown: DataFrame | None) -> dict:
    """Archetypes and badges of the individual people and of the repository; what lacks an axis is named, never dropped."""
    got = lambda family, metric: (families[family].get("metrics") or {}).get(metric)
    first = lambda rows, *names: tuple(rows[0][n] for n in names) if rows else None
    by_person = touched.join(told.select(F.col("hash").alias("commit"), "id"), "commit").select("id", "commit", "path", "is_new", "at")
    parts = [axes.after_return(m), axes.sizes(told, got("commit_size", "p90_files")), axes.words(told), axes.days(told), axes.places(by_person, head, told), temporal.instants(m)]
    constants = {"repo_formality": got("messages", "conventional_ratio")}
    if owned is not None:
        constants["repo_assistance"] = got("ai_archaeology", "assisted_commit_ratio")
        oldest, pair, hot = (got("files", "oldest_untouched") or {}).get("path"), first(got("coupling", "pairs"), "a", "b"), first(got("hotspot", "hotspots"), "path")
        starter = told.filter("assisted").orderBy("at", "id").select("id").limit(1).withColumn("first_assisted_commit", F.lit(True))
        parts += [axes.lines(owned, events), worktype.person_shares(breakdown.filter("editor is not null")), axes.holders(by_person, owned, oldest, pair, hot[0] if hot else None), starter]
    person = axes.person_table(interpret.person_axes(temporal.profile(m, ["id"]), m), parts, constants, LIMITS["identities"]).cache()
    badges: dict[str, list[str]] = {}
    for r in interpret.awarded(person, "id").orderBy("id").collect():
        badges.setdefault(r["id"], []).append(r["badge"])
    people_rows = [{"id": r["id"], "archetype": r["archetype"], "badges": badges.get(r["id"], [])} for r in person.select("id", interpret.archetype(person, interpret.PERSON).alias("archetype")).orderBy("id").collect()]
    extra = {
        "days_since_last_commit": 0, "identity_count": len(people_rows), "directory_count": got("files", "directory_count"), "coupled_file_ratio": got("coupling", "coupled_file_ratio"),
        "bus_factor": got("ownership", "bus_factor"), "knowledge_concentration": got("ownership", "largest_share"), "median_line_age_days": got("ownership", "median_line_age_days"),
        "revision": (got("worktype", "repository_shares") or {}).get("rework"), "repo_assistance": got("ai_archaeology", "assisted_commit_ratio"),
    }
    whole = interpret.repository_axes(temporal.profile(m)).withColumns({k: F.lit(v).cast("double") for k, v in extra.items() if v is not None})
    return {
        "people": people_rows, "skipped_badges": _rows(interpret.skipped(person).orderBy("badge")), "repository": _row(whole.select(interpret.archetype(whole, interpret.REPOSITORY).alias("archetype")))["archetype"],
    }
