"""The contributors: resolution, the listing with its bound, and candidates for merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorelog.functions import people
from lorelog.model import LIMITS, Config

#: The map is sent to all tasks, so its size is checked.
MAX_ADDRESSES = 500_000


def address_map(spark, mailmap: list[tuple[str, str, str]], config: Config) -> DataFrame:
    """(address, canonical, name) after the mail map, then the configuration; small by nature: it is written by hand."""
    if len(mailmap) > MAX_ADDRESSES:
        raise ValueError(f"the mail map is bounded by {MAX_ADDRESSES} lines")
    folded: dict[str, tuple[str, str]] = {a.strip().lower(): (c.strip().lower(), n) for a, c, n in mailmap} if config.use_mailmap else {}
    for canonical, name, others in config.identities:
        for a in (canonical, *others):
            folded[a.strip().lower()] = (canonical.strip().lower(), name)
    for a, (c, n) in list(folded.items()):
        if c in folded and folded[c][0] != c:
            folded[a] = (folded[c][0], folded[c][1] or n)
    return spark.createDataFrame([(a, c, n) for a, (c, n) in sorted(folded.items())], "address string, canonical string, mapped_name string")


def resolve(commits: DataFrame, config: Config, mapped: DataFrame | None = None, name: str = "author_name", email: str = "author_email") -> DataFrame:
    """Adds identity_id, identity_name and author_excluded.  One automation-like address marks the whole identity."""
    c = commits.withColumn("__address", people.normal_address(F.col(email)))
    if mapped is not None:
        c = c.join(F.broadcast(mapped), F.col("__address") == F.col("address"), "left")
        c = c.withColumn("__canonical", F.coalesce("canonical", "__address")).withColumn("identity_name", F.coalesce(F.nullif(F.col("mapped_name"), F.lit("")), F.col(name)))
        c = c.drop("address", "canonical", "mapped_name")
    else:
        c = c.withColumn("__canonical", F.col("__address")).withColumn("identity_name", F.col(name))
    c = c.withColumn("identity_id", people.digest(F.col("__canonical")))
    bot = people.is_bot_name(F.col(name))
    for entry in config.exclude_authors:
        bot = bot | people.matches_entry(F.col(name), F.col(email), entry) | people.matches_entry(F.col("identity_name"), F.col("__canonical"), entry)
    marked = c.groupBy("identity_id").agg(F.max(bot).alias("author_excluded"))
    return c.join(marked, "identity_id").drop("__address", "__canonical")


def table(commits: DataFrame, who: str = "id", at: str = "at", day: str = "day", limit: int = LIMITS["identities"]) -> DataFrame:
    """(id, commit_count, first_commit_date, last_commit_date, individual): the bound takes most commits, then the earlier, then the id."""
    people_rows = commits.groupBy(F.col(who).alias("id")).agg(
        F.count(F.lit(1)).alias("commit_count"), F.min(F.struct(F.col(at), F.col(day)))[day].alias("first_commit_date"), F.max(F.struct(F.col(at), F.col(day)))[day].alias("last_commit_date")
    )
    # the bounded top is found first; the flag comes back by a broadcast join of at most ``limit`` rows
    top = people_rows.orderBy(F.desc("commit_count"), "first_commit_date", "id").limit(limit).select(F.col("id").alias("__id"))
    return people_rows.join(F.broadcast(top), F.col("id") == F.col("__id"), "left").select("id", "commit_count", "first_commit_date", "last_commit_date", F.col("__id").isNotNull().alias("individual"))


def resolver_listing(commits: DataFrame, who: str = "id", address: str | None = None) -> DataFrame:
    """(id, commits, addresses) of all identities, most commits first, then by id."""
    addresses = F.count_distinct(people.normal_address(F.col(address))) if address else F.lit(1).cast("long")
    return commits.groupBy(F.col(who).alias("id")).agg(F.count(F.lit(1)).alias("commits"), addresses.alias("addresses")).orderBy(F.desc("commits"), "id")


def listing(known: DataFrame) -> DataFrame:
    """The individual rows and one that sums up the others (id null, aggregate true)."""
    one = known.filter("individual").select("id", "first_commit_date", "last_commit_date", "commit_count", F.lit(1).cast("long").alias("identities"), F.lit(False).alias("aggregate"))
    rest = known.filter("not individual").agg(
        F.first(F.lit(None).cast(known.schema["id"].dataType)).alias("id"), F.min("first_commit_date").alias("first_commit_date"), F.max("last_commit_date").alias("last_commit_date"),
        F.sum("commit_count").alias("commit_count"), F.count(F.lit(1)).alias("identities"), F.lit(True).alias("aggregate"),
    )
    return one.unionByName(rest.filter("identities > 0"))


def display_names(commits: DataFrame, who: str, name: str, at: str, seq: str, anonymize: bool = False) -> DataFrame:
    """(id, display_name): the name of the latest commit, the id where it is empty, holds an address or must stay hidden."""
    latest = commits.groupBy(F.col(who).alias("id")).agg(F.max_by(F.trim(F.col(name)), F.struct(F.col(at), -F.col(seq))).alias("n"))
    hide = F.lit(anonymize) | F.col("n").isNull() | (F.col("n") == "") | people.has_address(F.col("n"))
    return latest.select("id", F.when(hide, F.col("id")).otherwise(F.col("n")).alias("display_name"))


def evidence(commits: DataFrame, who: str, name: str, emails: list[str]) -> DataFrame:
    """(id, kind, token): name, compact name, local part, noreply account."""
    n = people.normal_name(F.col(name))
    tokens = [F.struct(F.lit("name").alias("kind"), n.alias("token")), F.struct(F.lit("compact").alias("kind"), F.regexp_replace(n, " ", "").alias("token"))]
    for e in emails:
        account = people.noreply_account(F.col(e))
        tokens.append(F.struct(F.when(account != "", "account").otherwise("local").alias("kind"), F.when(account != "", account).otherwise(people.local_part(F.col(e))).alias("token")))
    return commits.select(F.col(who).alias("id"), F.inline(F.array(*tokens))).filter("token <> ''").distinct()


def merge_candidates(found: DataFrame) -> DataFrame:
    """(id, candidate, signal), both ways round.  Evidence meets by token, never identity by identity.

    Give it the evidence of individual identities only: they are at most the bound, which bounds a token's group.
    """
    a = found.select(F.col("id").alias("id_a"), F.col("kind").alias("kind_a"), "token")
    b = found.select(F.col("id").alias("id_b"), F.col("kind").alias("kind_b"), "token")
    signal = (
        F.when((F.col("kind_a") == "name") & (F.col("kind_b") == "name"), "display_name")
        .when((F.col("kind_a") == "local") & (F.col("kind_b") == "local"), "local_part")
        .when((F.col("kind_a") == "account") & F.col("kind_b").isin("local", "account", "compact"), "noreply")
    )
    one_way = a.join(b, "token").filter("id_a <> id_b").select("id_a", "id_b", signal.alias("signal")).filter("signal is not null")
    other_way = one_way.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "signal")
    return one_way.unionByName(other_way).distinct().select(F.col("id_a").alias("id"), F.col("id_b").alias("candidate"), "signal")
