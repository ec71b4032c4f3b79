"""Market statistics: skill demand, unknown terms, gaps, dominance.

Texts are read once, in the scan stage, and only skill names or terms travel further. Counts are
reduced per (skill, company) before they are reduced per skill, so a skill asked for everywhere
costs one small row per company and task rather than one row per posting.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postgrain.functions.fanout import explode_rows
from postgrain.functions.money_time import round_half_up
from postgrain.functions.skills import match_skill_list, match_skills, term_pattern
from postgrain.functions.terms import terms_of
from postgrain.operators.profiles import Profile
from postgrain.operators.term_filter import BUCKETS, bits_of, level_of_share, reaching_test, term_counters
from postgrain.rules import constants as C
from postgrain.rules.skills import SKILLS, prose_terms
from postgrain.rules.stopwords import STOPWORDS
from postgrain.session import bounded, checkpointed

STOPWORD_LIMIT = 5_000
FIRST_SHARE = 6  # term discovery first counts the most frequent terms, with at most a sixth of all (term, posting) pairs
COHORTS = ("market", "shortlist")


def read_stopwords(spark: SparkSession, path: str) -> list[str]:
    """Stopwords from a text file, one per line, blank lines ignored."""
    rows = spark.read.text(path).limit(STOPWORD_LIMIT + 1).collect()
    words = bounded((r.value.strip().lower() for r in rows), STOPWORD_LIMIT, "stopwords")
    return sorted({w for w in words if w})


def market_cohort(postings: DataFrame) -> DataFrame:
    """Active postings with a title family."""
    return postings.where("status = 'active' AND title_family IS NOT NULL")


def shortlist_cohort(postings: DataFrame, scores: DataFrame) -> DataFrame:
    """Active postings with any passing score row, each once."""
    passing = scores.where("hard_filter_pass").select(F.col("job_id").alias("id"))
    return postings.where("status = 'active'").join(passing, "id", "left_semi")


def cohort_skills(postings: DataFrame, scores: DataFrame, skills=SKILLS) -> DataFrame:
    """(cohort, company_normalized, skills) for both cohorts from one pass over the texts."""
    narrow = postings.where("status = 'active'").select(
        "id", "company_normalized", F.col("title_family").isNotNull().alias("_market"),
        match_skills("description", skills).alias("skills"),
    )
    passing = scores.where("hard_filter_pass").select(
        F.col("job_id").alias("id"), F.lit(True).alias("_shortlist")
    ).distinct()
    cohorts = F.filter(
        F.array(F.when(F.col("_market"), "market"), F.when(F.col("_shortlist"), "shortlist")),
        lambda c: c.isNotNull(),
    )
    return explode_rows(
        narrow.join(passing, "id", "left"), cohorts, "cohort", "company_normalized", "skills"
    )


def skill_demand(rows: DataFrame, examples: int = C.EXAMPLE_COMPANIES) -> DataFrame:
    """Companies and postings per (cohort, skill), with the first few company names."""
    # read by both branches below; without the cut the texts would be matched once per branch
    per_company = checkpointed(
        explode_rows(rows, "skills", "skill", "cohort", "company_normalized")
        .groupBy("cohort", "skill", "company_normalized").agg(F.count("*").alias("n"))
    )
    totals = per_company.groupBy("cohort", "skill").agg(
        F.count("*").alias("companies"), F.sum("n").alias("postings")
    )
    # row_number <= k is applied before the shuffle as well, so no group is ever collected whole
    by_name = W.partitionBy("cohort", "skill").orderBy("company_normalized")
    named = (
        per_company.withColumn("_rank", F.row_number().over(by_name))
        .where(F.col("_rank") <= examples)
        .groupBy("cohort", "skill")
        .agg(F.array_sort(F.collect_list("company_normalized")).alias("example_companies"))
    )
    return totals.join(named, ["cohort", "skill"])


def _words(stopwords) -> tuple[str, ...]:
    return tuple(bounded(stopwords, STOPWORD_LIMIT, "stopwords"))


def candidate_terms(text: Column | str, stopwords=STOPWORDS, keep=None) -> Column:
    """Distinct unigrams and adjacent bigrams of a text, without stopwords and bare numbers.

    ``keep`` is a test of hashes (:func:`reaching_test`) that terms must pass.
    """
    words = _words(stopwords)

    @F.arrow_udf("array<string>")
    def terms(texts: pa.Array) -> pa.Array:
        return terms_of(texts, words, keep)

    return terms(text)


def term_counts(
    rows: DataFrame, stopwords=STOPWORDS, least: int = 1, buckets: int = BUCKETS,
    counters: DataFrame | None = None,
) -> DataFrame:
    """(term, companies, postings) over rows of (company_normalized, description).

    With ``least`` above 1, terms in fewer postings may be missing, and most of them are: the texts
    are read once more before, and only terms that a counting filter of ``buckets`` counters lets
    through are made and shuffled. Counts of the terms that are returned are exact. ``counters`` are
    those of :func:`term_counters` over the same texts, where they are at hand.
    """
    keep = None
    if least > 1:
        if counters is None:
            counters = term_counters(rows.select("description"), _words(stopwords), buckets)
        keep = reaching_test(bits_of(counters, least, buckets), buckets)
    terms = candidate_terms("description", stopwords, keep)
    return (
        explode_rows(rows, terms, "term", "company_normalized")
        .groupBy("term", "company_normalized").agg(F.count("*").alias("n"))
        .groupBy("term").agg(F.count("*").alias("companies"), F.sum("n").alias("postings"))
    )


def discover_terms(
    rows: DataFrame, stopwords=STOPWORDS, skills=SKILLS,
    min_postings: int = C.DISCOVERY_MIN_POSTINGS, min_companies: int = C.DISCOVERY_MIN_COMPANIES,
    limit: int = C.DISCOVERY_LIMIT, buckets: int = BUCKETS,
) -> DataFrame:
    """The most widespread terms the lexicon does not know (a top-k report).

    ``buckets`` is the size of the filter that keeps rare terms from being shuffled; it never
    changes the result. Terms of the most frequent buckets are counted first, from a level on. All others
    are in fewer postings, so in fewer companies, than that level: if the last reported term is in as many
    companies, none of them belongs in the report. If not, all that may come before it are counted.
    """
    # a term of so many companies is in at least as many postings
    least = max(min_postings, min_companies)
    known = F.regexp_like("term", F.lit(term_pattern(prose_terms(skills))))
    counters = checkpointed(term_counters(rows.select("description"), _words(stopwords), buckets))

    def report(level: int) -> DataFrame:
        return checkpointed(
            term_counts(rows, stopwords, level, buckets, counters)
            .where((F.col("postings") >= min_postings) & (F.col("companies") >= min_companies))
            .where(~known)
            .orderBy(F.desc("companies"), F.desc("postings"), "term").limit(limit)
        )

    level = max(least, level_of_share(counters, FIRST_SHARE, 4 * limit))
    found = report(level)
    if level > least:
        last = found.agg(F.count("*").alias("n"), F.min(F.struct("companies", "postings")).alias("row")).head()
        needed = 0
        if last.n == limit > 0:
            needed = last.row.companies
            # a term of all companies can only be passed by others of all companies, in as many postings
            if needed < level and needed == rows.select("company_normalized").distinct().count():
                needed = last.row.postings
        if needed < level:
            found = report(max(least, needed))
    return found


def company_counts(rows: DataFrame) -> DataFrame:
    """Postings per (cohort, company)."""
    return rows.groupBy("cohort", "company_normalized").agg(F.count("*").alias("postings"))


def cohort_totals(counts: DataFrame) -> DataFrame:
    """Postings, distinct companies and the largest company of each cohort.

    ``counts`` is :func:`company_counts`; ties for the largest go to the smaller name.
    """
    return counts.groupBy("cohort").agg(
        F.sum("postings").alias("postings"), F.count("*").alias("companies"),
        F.min(F.struct((-F.col("postings")).alias("n"), "company_normalized")).alias("_top"),
    ).select(
        "cohort", "postings", "companies", F.col("_top.company_normalized").alias("top_company"),
        (-F.col("_top.n")).alias("top_postings"),
    )


def dominance(totals: DataFrame) -> DataFrame:
    """The cohort whose largest company has the greatest share; market wins a tie."""
    order = F.array_position(F.array(*[F.lit(c) for c in COHORTS]), F.col("cohort"))
    share = F.col("top_postings") / F.col("postings")
    return totals.orderBy(F.desc(share), order).limit(1).select(
        "cohort", "top_company", "top_postings", "postings",
        round_half_up(share * 100).alias("percent"),
    )


def _have(profile: Profile, skills=SKILLS) -> Column:
    return match_skill_list(F.array(*[F.lit(s) for s in profile.skills]).cast("array<string>"), skills)


def skill_gaps(
    demand: DataFrame, profile: Profile, min_companies: int = C.GAP_MIN_COMPANIES
) -> DataFrame:
    """Shortlist skills the profile lacks, with their market reach (0 when unseen there)."""
    market = demand.where("cohort = 'market'").select(
        "skill", F.col("companies").alias("_market")
    )
    return (
        demand.where("cohort = 'shortlist'").where(F.col("companies") >= min_companies)
        .where(~F.array_contains(_have(profile), F.col("skill")))
        .join(market, "skill", "left")
        .select("skill", "companies", "postings", "example_companies",
                F.coalesce("_market", F.lit(0)).alias("market_companies"))
    )


def skills_you_have(demand: DataFrame, profile: Profile) -> DataFrame:
    """Profile skills either cohort asks for."""

    def pick(cohort: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("cohort") == cohort, F.col(column))), F.lit(0))

    return (
        demand.where(F.array_contains(_have(profile), F.col("skill")))
        .groupBy("skill").agg(
            pick("shortlist", "companies").alias("shortlist_companies"),
            pick("shortlist", "postings").alias("shortlist_postings"),
            pick("market", "companies").alias("market_companies"),
        )
    )


def tracked_skills(lines: DataFrame) -> DataFrame:
    """Skills already on a checklist of `- [ ] skill — note` lines (column ``value``)."""
    item = F.regexp_extract("value", r"^(?i)\s*-\s+\[\s*x?\s*\]\s*(.+?)\s*$", 1)
    skill = F.lower(F.trim(F.substring_index(item, "—", 1)))
    return lines.select(skill.alias("skill")).where("skill <> ''").distinct()


def new_gap_lines(
    lines: DataFrame, gaps: DataFrame, today: str, shortlist_companies: Column | int = 0
) -> DataFrame:
    """Checklist lines for gaps not tracked yet; existing lines are not touched."""
    total = F.lit(shortlist_companies) if isinstance(shortlist_companies, int) else shortlist_companies
    share = F.when(total > 0, F.concat_ws("/", F.col("companies"), total)).otherwise(
        F.col("companies").cast("string")
    )
    return gaps.join(tracked_skills(lines), "skill", "left_anti").select(
        "skill",
        F.concat(
            F.lit("- [ ] "), "skill", F.lit(" — "), share, F.lit(" shortlist companies, "),
            F.col("postings").cast("string"), F.lit(f" postings (added {today})"),
        ).alias("line"),
    )
