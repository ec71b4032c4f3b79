"""Explained filters: every rule a posting breaks is reported, in rule order.

Work that depends on the posting alone (text patterns, place parsing) happens before postings fan
out over profiles, so the description is read once and never copied per profile.

A short list of profiles is inlined. A long one is a table: its place phrases are an index that the
words of every distinct location meet by an equi-join, and the other rules are columns of blocks of
profiles that postings meet one after the other, so the plan is the same for any number of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postgrain.functions.fanout import explode_rows, inline_rows
from postgrain.functions.patterns import SPACE, any_of, jvm
from postgrain.functions.taxonomy import seniority_rank
from postgrain.functions.text import trim
from postgrain.operators.profiles import PROFILE_LIMIT, Profile
from postgrain.rules import places as P
from postgrain.rules.constants import SENIORITY_LEVELS
from postgrain.session import checkpointed


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-z]+"), lambda w: w != "")


def _padded(words: Column) -> Column:
    """Words as ` a b c `, so that a phrase is contained exactly when its words are in sequence."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _phrase(text: str) -> str | None:
    words = [w for w in re.split("[^a-z]+", text) if w]
    return f" {' '.join(words)} " if words else None


def _has_any(padded: Column, phrases) -> Column:
    needles = [n for n in map(_phrase, phrases) if n]
    hits = [F.contains(padded, F.lit(n)) for n in needles]
    out = F.lit(False)
    for hit in hits:
        out = out | hit
    return out


def _last_word_is_code(location: Column) -> Column:
    parts = F.split(location, rf"[,/|;]|{SPACE}+[-–—]{SPACE}+")
    last = F.transform(
        parts, lambda p: F.regexp_extract(F.replace(p, F.lit("."), F.lit("")), "([a-z]+)[^a-z]*$", 1)
    )
    return F.exists(last, lambda w: w.isin(*P.US_CODES))


def _us_region(words: Column) -> Column:
    return F.exists(words, lambda w: w.isin(*P.US_REGIONS)) | F.array_join(words, " ").isin(
        *P.US_REGIONS
    )


def _specific(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*P.GENERIC_REMOTE))


def place_features(postings: DataFrame) -> DataFrame:
    """Profile-independent facts about where a posting is open."""
    loc = F.lower(F.coalesce(F.col("location"), F.lit("")))
    staged = postings.withColumns({"_loc": loc, "_words": _words(loc)})
    words = F.col("_words")
    us_name = F.concat(
        F.lit(" (?:us|usa|united states|"), F.lit("|".join(P.US_STATES)), F.lit(") ")
    )
    regions = F.filter(
        F.transform(F.split(F.col("_loc"), "[,/]"), trim), lambda p: p != ""
    )
    return staged.withColumns({
        "_padded": _padded(words),
        "_us": F.regexp_like(_padded(words), us_name) | _last_word_is_code(F.col("_loc")),
        "_specific": _specific(words),
        "_regions": F.transform(regions, _words),
        "_says_remote": F.array_contains(words, "remote"),
    })


def location_accepted(profile: Profile) -> Column:
    """Whether a posting prepared by :func:`place_features` suits the profile's places."""
    places = profile.accepted_locations
    specific, regions = F.col("_specific"), F.col("_regions")

    def region_fits(words: Column) -> Column:
        narrowed = _specific(words)
        return _us_region(words) | ((F.size(narrowed) > 0) & _has_any(_padded(narrowed), places))

    anywhere = _has_any(F.col("_padded"), places)
    remote_fit = (
        F.when(F.size(specific) == 0, True)
        .when(F.size(regions) > 1, F.exists(regions, region_fits))
        .when(F.col("_says_remote"), _us_region(specific) | _has_any(_padded(specific), places))
        .otherwise(anywhere)
    )
    return (
        F.when(F.col("_loc") == "", F.col("remote"))
        .when(F.col("_us"), True)
        .when(F.col("remote"), remote_fit)
        .otherwise(anywhere)
    )


def _kept(reasons: list[Column]) -> Column:
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


def work_auth_reasons(description: Column | str, rules=P.WORK_AUTH_PATTERNS) -> Column:
    text = F.col(description) if isinstance(description, str) else description
    found = _kept([
        F.when(F.regexp_like(text, F.lit(jvm(pattern, ignore_case=True))), f"work-auth:{label}")
        for label, pattern in rules
    ])
    if not rules:
        return found
    # one search for all rules, as few texts match any
    some = F.regexp_like(text, F.lit(any_of([pattern for _, pattern in rules], ignore_case=True)))
    return F.when(some, found).otherwise(F.array().cast("array<string>"))


def profile_reasons(profile: Profile) -> Column:
    """Reasons, in rule order, that depend on the profile."""
    family, level = F.col("title_family"), F.col("seniority")
    rank = seniority_rank(level)
    low = SENIORITY_LEVELS.index(profile.seniority_min)
    high = SENIORITY_LEVELS.index(profile.seniority_max)
    return _kept([
        F.when(family.isNull(), F.lit("role-family:unclassified"))
        .when(~family.isin(*profile.target_families), F.concat(F.lit("role-family:"), family)),
        F.when(rank < low, F.concat(F.lit("seniority-below:"), level)),
        F.when(rank > high, F.concat(F.lit("seniority-above:"), level)),
        F.when(F.lit(profile.remote_only) & ~F.col("remote"), F.lit("remote-only")),
        F.when(
            ~location_accepted(profile),
            F.concat(F.lit("location:"), F.lower(F.coalesce("location", F.lit("unspecified")))),
        ),
    ])


def hard_filter_verdicts(postings: DataFrame, profiles: list[Profile]) -> DataFrame:
    """One verdict per active posting and profile: ``reasons`` and ``hard_filter_pass``.

    ``postings`` needs id, status, description, description_hash, title_family, seniority, remote
    and location. Up to ``PROFILE_LIMIT`` profiles, the plan is scan -> project -> generate: no join,
    no shuffle. Beyond, see :func:`verdicts_by_table`; the result is the same.
    """
    if len(profiles) > PROFILE_LIMIT:
        return verdicts_by_table(postings, profile_rules(postings.sparkSession, profiles))
    active = _active(postings)
    per_profile = F.array(*[
        F.struct(
            F.lit(p.version).alias("profile_version"),
            F.concat("_auth", profile_reasons(p)).alias("reasons"),
        )
        for p in profiles
    ])
    return active.select(
        F.col("id").alias("job_id"), "description_hash", F.inline(per_profile)
    ).withColumn("hard_filter_pass", F.size("reasons") == 0)


def _active(postings: DataFrame) -> DataFrame:
    return place_features(postings.where("status = 'active'").select(
        "id", "description_hash", "title_family", "seniority", "remote", "location",
        work_auth_reasons("description").alias("_auth"),
    ))


# --- any number of profiles ---------------------------------------------------------------------

RULES = ("profile_version string, families array<string>, low int, high int, remote_only boolean, "
         "places array<string>")


def profile_rules(spark: SparkSession, profiles: list[Profile]) -> DataFrame:
    """Profiles as a table of their rules; places as words with one blank between them."""
    return spark.createDataFrame([
        (p.version, list(p.target_families), SENIORITY_LEVELS.index(p.seniority_min),
         SENIORITY_LEVELS.index(p.seniority_max), p.remote_only,
         sorted({n.strip() for n in map(_phrase, p.accepted_locations) if n}))
        for p in profiles
    ], RULES)


def _open_anywhere() -> Column:
    """Whether a posting suits every profile's places, as far as they do not matter."""
    specific, regions = F.col("_specific"), F.col("_regions")
    return F.coalesce(
        F.when(F.col("remote"), F.when(F.size(specific) == 0, True)
               .when(F.size(regions) > 1, F.exists(regions, _us_region))
               .when(F.col("_says_remote"), _us_region(specific))), F.lit(False))


def _place_words() -> Column:
    """The runs of words in which a profile's place must stand."""
    specific, regions = F.col("_specific"), F.col("_regions")
    whole = F.array(F.col("_words"))
    narrowed = F.filter(F.transform(regions, _specific), lambda w: F.size(w) > 0)
    return F.when(
        F.col("remote"),
        F.when(F.size(specific) == 0, F.array().cast("array<array<string>>"))
        .when(F.size(regions) > 1, narrowed)
        .when(F.col("_says_remote"), F.array(specific)).otherwise(whole),
    ).otherwise(whole)


def _accepting(locations: DataFrame, rules: DataFrame) -> DataFrame:
    """(_place, lists): for each distinct location, the lists of places with a phrase in it."""
    index = explode_rows(rules.select("list", "places").distinct(), "places", "phrase", "list").distinct()
    longest = rules.agg(F.max(F.array_max(F.transform("places", lambda p: F.size(F.split(p, " ")))))).first()[0] or 0
    sizes = F.sequence(F.lit(1), F.lit(max(1, longest)))

    def grams(words: Column) -> Column:
        return F.flatten(F.transform(sizes, lambda n: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda k: k + n - 1 <= F.size(words)),
            lambda k: F.array_join(F.slice(words, k, n), " "))))

    found = F.array_distinct(F.flatten(F.transform("_places", grams)))
    return explode_rows(locations, found, "phrase", "_place").join(index, "phrase").groupBy("_place").agg(
        F.collect_set("list").alias("lists"))


def verdicts_by_table(postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """:func:`hard_filter_verdicts` for a table of :func:`profile_rules` of any length.

    Every distinct location is looked up once in the index of place phrases. Postings then meet blocks
    of at most about ``PROFILE_LIMIT`` profiles, because each pair of them has a verdict.
    """
    rules = checkpointed(profiles.withColumn("list", F.md5(F.array_join("places", "|"))))
    count = rules.count()
    if not count:
        return hard_filter_verdicts(postings, [])
    # the key of what location rules look at
    place = F.concat_ws("|", F.coalesce(F.col("remote").cast("string"), F.lit("-")), "_loc")
    active = _active(postings).withColumns({
        "_place": place, "_any": _open_anywhere(), "_rank": seniority_rank(F.col("seniority"))})
    facts = place_features(postings.where("status = 'active'").select("location", "remote").distinct())
    facts = facts.select(place.alias("_place"), _place_words().alias("_places")).distinct()
    narrow = active.select(
        F.col("id").alias("job_id"), "description_hash", "_auth", "title_family", "seniority", "remote", "_rank",
        "location", "_loc", "_us", "_any", "_place")
    known = narrow.join(checkpointed(_accepting(facts, rules)), "_place", "left").drop("_place")
    blocks = -(-count // PROFILE_LIMIT)
    dealt = rules.groupBy(F.pmod(F.xxhash64("profile_version"), F.lit(blocks)).cast("int").alias("_block")).agg(
        F.collect_list(F.struct("profile_version", "families", "low", "high", "remote_only", "list")).alias("_profiles"))
    met = explode_rows(known, F.sequence(F.lit(0), F.lit(blocks - 1)), "_block", *known.columns).join(
        checkpointed(dealt), "_block").drop("_block")
    kept = [c for c in met.columns if c != "_profiles"]
    pairs = inline_rows(met, "_profiles", *kept)
    accepted = (
        F.when(F.col("_loc") == "", F.col("remote")).when(F.col("_us"), True)
        .otherwise(F.col("_any") | F.coalesce(F.array_contains("lists", F.col("list")), F.lit(False)))
    )
    family, level = F.col("title_family"), F.col("seniority")
    reasons = _kept([
        F.when(family.isNull(), F.lit("role-family:unclassified"))
        .when(~F.array_contains("families", family), F.concat(F.lit("role-family:"), family)),
        F.when(F.col("_rank") < F.col("low"), F.concat(F.lit("seniority-below:"), level)),
        F.when(F.col("_rank") > F.col("high"), F.concat(F.lit("seniority-above:"), level)),
        F.when(F.col("remote_only") & ~F.col("remote"), F.lit("remote-only")),
        F.when(~accepted, F.concat(F.lit("location:"), F.lower(F.coalesce("location", F.lit("unspecified"))))),
    ])
    return pairs.select(
        "job_id", "description_hash", "profile_version", F.concat("_auth", reasons).alias("reasons")
    ).withColumn("hard_filter_pass", F.size("reasons") == 0)


def merge_verdicts(scores: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Refresh verdicts in the score table, keyed by (job_id, rubric_version, profile_version).

    A stored rubric result survives only while the description is unchanged. Retrieval and
    provenance columns are never touched; rows without a new verdict stay as they are.
    """
    keys = ["job_id", "rubric_version", "profile_version"]
    new = verdicts.select(
        *keys, F.col("description_hash").alias("_hash"), F.col("hard_filter_pass").alias("_pass"),
        F.col("reasons").alias("_reasons"), F.col("scored_at").alias("_at"),
        F.lit(True).alias("_new"),
    )
    merged = scores.join(new, keys, "full_outer")
    fresh, same = F.col("_new").isNotNull(), F.col("description_hash") == F.col("_hash")
    kept = {
        c: F.when(~fresh | same, F.col(c))
        for c in ("rubric_score", "dimensions", "uncertainty", "rationale")
        if c in scores.columns
    }
    fixed = merged.withColumns(kept).withColumns({
        "hard_filter_pass": F.when(fresh, F.col("_pass")).otherwise(F.col("hard_filter_pass")),
        "reasons": F.when(fresh, F.col("_reasons")).otherwise(F.col("reasons")),
        "scored_at": F.when(fresh, F.col("_at")).otherwise(F.col("scored_at")),
        "description_hash": F.when(fresh, F.col("_hash")).otherwise(F.col("description_hash")),
    })
    if "retrieval_score" in scores.columns:
        fixed = fixed.withColumn("retrieval_score", F.coalesce("retrieval_score", F.lit(0.0)))
    if "recall_paths" in scores.columns:
        fixed = fixed.withColumn(
            "recall_paths", F.coalesce("recall_paths", F.array().cast("array<string>"))
        )
    return fixed.select(*scores.columns)


def reason_counts(verdicts: DataFrame) -> DataFrame:
    """How often each reason occurs, per profile."""
    return (
        verdicts.select("profile_version", F.explode("reasons").alias("reason"))
        .groupBy("profile_version", "reason").agg(F.count("*").alias("postings"))
    )
