"""Archetypes and badges: ordered conditions over named axes.  The first archetype that fits wins; the last always does."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorelog.functions.numbers import ratio

# --- fixed values: ids and conditions, in their order -----------------------------------------------------------
PERSON = (
    ("night-watchman", {"nocturnality": ">=0.38"}),
    ("dawn-patrol", {"earliness": ">=0.30"}),
    ("weekend-architect", {"weekend_presence": ">=0.35"}),
    ("friday-daredevil", {"friday_evening_share": ">=0.12", "cadence": ">=1.5"}),
    ("comet", {"endurance": "<0.10", "cadence": ">=4.0", "volume_share": ">=0.05"}),
    ("metronome", {"regularity": ">=0.55", "endurance": ">=0.40", "cadence": "0.8..3.0"}),
    ("sprinter", {"cadence": ">=5.0"}),
    ("surgeon", {"granularity": ">=0.55", "breadth": "<0.25"}),
    ("avalanche", {"breadth": ">=0.65", "granularity": "<0.20"}),
    ("founder", {"first_contributor": "true", "persistence": ">=0.25"}),
    ("restorer", {"restoration": ">=0.45"}),
    ("sculptor", {"revision": ">=0.30"}),
    ("diplomat", {"collaboration": ">=0.30"}),
    ("groundlayer", {"collaboration": ">=0.15", "persistence": "<0.15", "volume_share": ">=0.05"}),
    ("lighthouse-keeper", {"concentration": ">=0.60", "endurance": ">=0.30"}),
    ("cartographer", {"reach": ">=0.60"}),
    ("firefighter", {"fix_share": ">=0.45", "cadence": ">=2.0"}),
    ("pathfinder", {"creation": ">=0.55", "new_file_share": ">=0.30"}),
    ("chronicler", {"verbosity": ">=0.50"}),
    ("telegraphist", {"verbosity": "<0.12"}),
    ("standard-bearer", {"formality": ">=0.85"}),
    ("cyborg", {"assistance": ">=0.40"}),
    ("hand-tooled", {"assistance": "<0.02", "repo_assistance": ">=0.25", "volume_share": ">=0.05"}),
    ("steady-hand", {}),
)
REPOSITORY = (
    ("nocturnal-workshop", {"nocturnality": ">=0.35"}),
    ("weekend-project", {"weekend_presence": ">=0.40"}),
    ("nine-to-five", {"office_hours": ">=0.70", "weekend_presence": "<0.10"}),
    ("always-on", {"regularity": "<0.32", "span_ratio": ">=0.40"}),
    ("sprint-and-sleep", {"span_ratio": "<0.15", "longest_silence_days": ">=90"}),
    ("ghost-town", {"days_since_last_commit": ">=365"}),
    ("newborn", {"repository_age_days": "<180"}),
    ("solo-vessel", {"bus_factor": "==1", "identity_count": "<=2"}),
    ("duet", {"bus_factor": "<=2", "identity_count": "3..6"}),
    ("crowd", {"bus_factor": ">=6"}),
    ("fortress", {"knowledge_concentration": ">=0.70", "identity_count": ">=6"}),
    ("fossil-bed", {"median_line_age_days": ">=1095"}),
    ("shifting-sands", {"revision": ">=0.30"}),
    ("archipelago", {"directory_count": ">=20", "coupled_file_ratio": "<0.15"}),
    ("tangle", {"coupled_file_ratio": ">=0.40"}),
    ("machine-assisted", {"repo_assistance": ">=0.30"}),
    ("working-repository", {}),
)
BADGES = (
    ("night-owl", {"rank_nocturnality": "==1", "identity_count": ">=2"}),
    ("early-bird", {"rank_earliness": "==1", "identity_count": ">=2"}),
    ("weekender", {"rank_weekend": "==1", "identity_count": ">=2"}),
    ("first-light", {"first_contributor": "true"}),
    ("last-standing", {"most_recent_contributor": "true", "identity_count": ">=3"}),
    ("longest-streak", {"rank_streak": "==1", "streak_days": ">=7"}),
    ("marathon", {"streak_days": ">=30"}),
    ("return-of-the-king", {"longest_personal_silence_days": ">=180", "commits_after_return": ">=10"}),
    ("one-liner", {"single_line_commits": ">=20"}),
    ("big-bang", {"rank_largest_commit": "==1", "largest_commit_lines": ">=2000"}),
    ("file-founder", {"rank_new_files": "==1", "new_files_created": ">=25"}),
    ("the-eraser", {"deletion_ratio": ">=0.60", "volume_share": ">=0.05"}),
    ("typo-hunter", {"fix_typo_commits": ">=10"}),
    ("reverter", {"revert_commits": ">=5"}),
    ("essayist", {"rank_message_length": "==1", "mean_subject_length": ">=60"}),
    ("minimalist", {"very_short_subjects": ">=25"}),
    ("emoji-enthusiast", {"emoji_ratio": ">=0.20"}),
    ("conventionalist", {"formality": ">=0.95", "commits": ">=50"}),
    ("freestyler", {"formality": "<0.05", "repo_formality": ">=0.50"}),
    ("deep-diver", {"rank_single_file_focus": "==1", "single_file_ratio": ">=0.70"}),
    ("everywhere", {"rank_reach": "==1", "reach": ">=0.50"}),
    ("the-untouched", {"owns_oldest_untouched_file": "true"}),
    ("survivor", {"persistence": ">=0.60", "volume_share": ">=0.05"}),
    ("ephemeral", {"persistence": "<0.05", "volume_share": ">=0.05"}),
    ("bus-factor", {"sole_owner_of_directories": ">=1"}),
    ("helper", {"rank_collaboration": "==1", "collaboration": ">=0.20"}),
    ("refactorer", {"rank_restoration": "==1", "restoration": ">=0.35"}),
    ("coupled", {"owns_top_coupled_pair": "true"}),
    ("hotspot-owner", {"owns_top_hotspot": "true"}),
    ("first-assist", {"first_assisted_commit": "true"}),
    ("cyborg-badge", {"assistance": ">=0.50", "commits": ">=20"}),
    ("purely-human", {"assistance": "==0", "repo_assistance": ">=0.30", "commits": ">=20"}),
    ("friday-shipper", {"friday_evening_commits": ">=15"}),
    ("holiday-worker", {"commits_on_dec_25_or_jan_1": ">=1"}),
    ("midnight-exact", {"commits_in_hour_0": ">=5"}),
    ("leap-day", {"commits_on_feb_29": ">=1"}),
    ("same-minute", {"max_commits_in_one_minute": ">=5"}),
    ("long-haul", {"personal_span_days": ">=1095"}),
    ("one-day-wonder", {"active_days": "==1", "commits": ">=10"}),
    ("the-completer", {"rank_volume": "==1", "volume_share": ">=0.50"}),
)
# -----------------------------------------------------------------------------------------------------------------

#: Axes that come from commit times alone.
TIME_AXES = frozenset(
    "nocturnality earliness weekend_presence friday_evening_share regularity cadence endurance personal_span_days volume_share first_contributor most_recent_contributor identity_count "
    "commits active_days streak_days longest_personal_silence_days friday_evening_commits rank_nocturnality rank_earliness rank_weekend rank_streak rank_volume".split()
)


def condition_sql(axis: str, rule: str) -> str:
    """The grammar: >=x, <=x, <x, >x, ==x, a..b (both ends included), true."""
    if rule == "true":
        return axis
    if m := re.fullmatch(r"(-?[\d.]+?)\.\.(-?[\d.]+)", rule):
        return f"({axis} >= {m[1]} AND {axis} <= {m[2]})"
    if m := re.fullmatch(r"(>=|<=|==|<|>)(-?[\d.]+)", rule):
        return f"{axis} {'=' if m[1] == '==' else m[1]} {m[2]}"
    raise ValueError(f"no condition: {rule}")


def archetype_sql(rules, available) -> str:
    """A CASE chain; a rule with an axis that isn't available never fits."""
    arms = [f"WHEN {' AND '.join(condition_sql(a, r) for a, r in when.items())} THEN '{name}'" for name, when in rules if when and set(when) <= set(available)]
    return f"CASE {' '.join(arms)} ELSE '{rules[-1][0]}' END"


def archetype(axes: DataFrame, rules) -> Column:
    return F.expr(archetype_sql(rules, axes.columns))


def badge_sql(available) -> list[tuple[str, str]]:
    return [(name, " AND ".join(condition_sql(a, r) for a, r in when.items())) for name, when in BADGES if set(when) <= set(available)]


def awarded(axes: DataFrame, who: str) -> DataFrame:
    """(id, badge); a badge that lacks an axis isn't awarded, see ``skipped``.  A rank needs two people."""
    every = F.array(*(F.when(F.expr(cond), name) for name, cond in badge_sql(axes.columns)))
    return axes.select(who, F.explode(F.array_compact(every)).alias("badge"))


def skipped(axes: DataFrame) -> DataFrame:
    """(badge, missing): the badges whose axes aren't available, never silently dropped."""
    rows = [(name, ",".join(sorted(set(when) - set(axes.columns)))) for name, when in BADGES if not set(when) <= set(axes.columns)]
    return axes.sparkSession.createDataFrame(rows, "badge string, missing string")


def person_axes(profile: DataFrame, moments: DataFrame) -> DataFrame:
    """The axes of commit times, one row per person; the ranks are among all of them (1 is the greatest)."""
    ends = moments.groupBy("id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    p = profile.join(ends, "id")
    whole = p.agg(
        F.sum("commits").alias("n"), F.count(F.lit(1)).alias("people"), F.min("first_at").alias("a"), F.max("last_at").alias("z"),
        F.datediff(F.max_by("last_commit_date", "last_at"), F.min_by("first_commit_date", "first_at")).alias("age"),
    )
    x = p.join(F.broadcast(whole))  # one row
    axes = x.select(
        "id",
        F.col("night_ratio").alias("nocturnality"),
        F.col("early_ratio").alias("earliness"),
        F.col("weekend_ratio").alias("weekend_presence"),
        ratio(F.col("friday_evening_count"), F.col("commits")).alias("friday_evening_share"),
        "regularity",
        F.col("commits_per_active_day").alias("cadence"),
        ratio(F.col("active_days"), F.col("age")).alias("endurance"),
        F.col("repository_age_days").alias("personal_span_days"),
        ratio(F.col("commits"), F.col("n")).alias("volume_share"),
        (F.col("first_at") == F.col("a")).alias("first_contributor"),
        (F.col("last_at") == F.col("z")).alias("most_recent_contributor"),
        F.col("people").alias("identity_count"),
        "commits",
        "active_days",
        F.col("longest_streak_days").alias("streak_days"),
        F.col("elapsed_silence_days").alias("longest_personal_silence_days"),
        F.col("friday_evening_count").alias("friday_evening_commits"),
    )
    ranks = {"nocturnality": "nocturnality", "earliness": "earliness", "weekend": "weekend_presence", "streak": "streak_days", "volume": "volume_share"}
    return reduce(lambda d, kv: d.withColumn(f"rank_{kv[0]}", F.rank().over(Window.orderBy(F.desc(kv[1]))).cast("long")), ranks.items(), axes)


def repository_axes(profile: DataFrame) -> DataFrame:
    """The repository's axes of commit times, from its one-row profile."""
    return profile.select(
        F.col("night_ratio").alias("nocturnality"), F.col("weekend_ratio").alias("weekend_presence"), F.col("office_hours_ratio").alias("office_hours"),
        "regularity", "span_ratio", "longest_silence_days", "repository_age_days",
    )
