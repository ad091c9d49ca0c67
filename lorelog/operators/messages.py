"""What commit messages say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelog.functions import text
from lorelog.functions.numbers import ratio, round_places

#: Below this share of conventional subjects the family is degraded.
LOW_CONFIDENCE = 0.30


def classified(commits: DataFrame, subject: str = "subject", golden: bool = False) -> DataFrame:
    """Adds conventional, kind (type or keyword class), and the tests on the subject."""
    s = F.col(subject)
    return commits.withColumns({
        "conventional": text.is_conventional(s),
        "kind": F.when(text.is_conventional(s), text.conventional_type(s)).otherwise(text.keyword_class(s, golden)),
        "chars": F.length(s),
    })


def profile(commits: DataFrame, subject: str = "subject", body: str | None = "body", merges: str | None = None, by: list[str] | None = None, golden: bool = False) -> DataFrame:
    """Scalar figures; ``merges``: a boolean column of commits that count only for merge_subject_ratio."""
    s = F.col(subject)
    b = F.coalesce(F.col(body), F.lit("")) if body else F.lit("")
    ok = ~F.col(merges) if merges else F.lit(True)
    n, every = F.count_if(ok), F.count(F.lit(1))
    own = F.when(ok, F.length(s))
    places = 4 if golden else None
    return commits.groupBy(*(by or [])).agg(
        n.cast("long").alias("commits"),
        ratio(F.count_if(ok & text.is_conventional(s)), n, places).alias("conventional_ratio"),
        round_places(F.sum(own) / n, 1).alias("mean_subject_length"),
        F.percentile(own, 0.5).alias("median_subject_length"),
        ratio(F.count_if(ok & (text.trim_space(b) != "")), n).alias("body_ratio"),
        F.count_if(ok & (F.length(s) <= 10)).cast("long").alias("very_short_count"),
        ratio(F.count_if(ok & text.has_emoji(s)), n).alias("emoji_ratio"),
        F.count_if(ok & text.is_revert(s, golden)).cast("long").alias("revert_count"),
        F.count_if(ok & text.is_typo_fix(s)).cast("long").alias("fix_typo_count"),
        ratio(F.count_if(ok & text.is_wip(s)), n).alias("wip_ratio"),
        ratio(F.count_if(ok & (text.has_issue_reference(s) | text.has_issue_reference(b))), n).alias("issue_reference_ratio"),
        ratio(F.count_if(text.is_merge_subject(s)), every).alias("merge_subject_ratio"),
    )


#: The additive marks of a commit: name -> test on subject and body.
MARKS = {
    "conventional": lambda s, b: text.is_conventional(s),
    "with_body": lambda s, b: text.trim_space(b) != "",
    "very_short": lambda s, b: F.length(s) <= 10,
    "emoji": lambda s, b: text.has_emoji(s),
    "revert": lambda s, b: text.is_revert(s),
    "fix_typo": lambda s, b: text.is_typo_fix(s),
    "wip": lambda s, b: text.is_wip(s),
    "issue": lambda s, b: text.has_issue_reference(s) | text.has_issue_reference(b),
}


def cells(commits: DataFrame, who: str = "id", year: str = "year", subject: str = "subject", body: str = "body") -> DataFrame:
    """The additive form: per identity, year and length of subject the commits, and how many have each mark."""
    s, b = F.col(subject), F.coalesce(F.col(body), F.lit(""))
    marks = {name: F.count_if(test(s, b)).cast("long") for name, test in MARKS.items()}
    return commits.groupBy(F.col(who).alias("id"), F.col(year).alias("year"), F.length(s).alias("chars")).agg(F.count(F.lit(1)).alias("commits"), *(c.alias(n) for n, c in marks.items()))


def profile_of_cells(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The figures of ``profile`` (all but the share of merges, which aren't in cells) from cells."""
    n = F.sum("commits")
    share = lambda mark: ratio(F.sum(mark), n)
    return found.groupBy(*(by or [])).agg(
        n.cast("long").alias("commits"), share("conventional").alias("conventional_ratio"), round_places(F.sum(F.col("chars") * F.col("commits")) / n, 1).alias("mean_subject_length"),
        F.percentile("chars", 0.5, F.col("commits")).alias("median_subject_length"), share("with_body").alias("body_ratio"), F.sum("very_short").cast("long").alias("very_short_count"),
        share("emoji").alias("emoji_ratio"), F.sum("revert").cast("long").alias("revert_count"), F.sum("fix_typo").cast("long").alias("fix_typo_count"),
        share("wip").alias("wip_ratio"), share("issue").alias("issue_reference_ratio"),
    )


def prefixes(commits: DataFrame, subject: str = "subject") -> DataFrame:
    s = F.col(subject)
    return commits.filter(text.is_conventional(s)).groupBy(text.conventional_type(s).alias("prefix")).agg(F.count(F.lit(1)).alias("commits"))


def keywords(commits: DataFrame, subject: str = "subject", golden: bool = False) -> DataFrame:
    s = F.col(subject)
    return commits.filter(~text.is_conventional(s)).groupBy(text.keyword_class(s, golden).alias("keyword")).agg(F.count(F.lit(1)).alias("commits"))


def longest(commits: DataFrame, commit: str, date: str, message: str) -> DataFrame:
    return commits.select(F.col(commit).alias("commit"), F.col(date).alias("date"), F.length(message).cast("long").alias("chars")).orderBy(F.desc("chars"), "date", "commit").limit(1)
