"""Deterministic bindings of the driver tables to the engine's tables.

The driver tables hold invented words, so titles, places and phrases are taken from short lists
indexed by key arithmetic; texts, companies, dates and scores come from the tables. Everything
grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postgrain.operators.normalize import normalize
from postgrain.operators.profiles import Profile
from postgrain.rules.constants import DIMENSIONS, RUBRIC_VERSION, SOURCE_IDS
from postgrain.session import read_table

TITLES = (
    "Senior Agentic Engineer", "AI Agents Platform Lead", "Forward-Deployed Engineer",
    "LLM Engineer", "Staff Inference Engineer", "AI Product Engineer", "Applied AI Engineer, Search",
    "AI-Native Software Developer", "Computer Scientist (Artificial Intelligence)",
    "Machine Learning Engineer", "Junior ML Engineer", "Principal MLOps Engineer",
    "Data Engineer II", "Analytics Engineer", "Data Analyst Intern", "BI Developer",
    "Software Engineer", "Senior Full-Stack Software Engineer", "Back-End Engineer (Founding)",
    "Product Manager, AI", "Engineering Program Manager - Data Platform", "Director of Research",
    "Sr. Software Engineer", "Account Executive",
)
LOCATIONS = (
    "San Francisco, CA", "London, UK; Ontario, CAN; San Francisco, CA", "Remote - US", "EMEA",
    "Sydney, Australia", "Vienna, Austria", "", "New York City, NY | Seattle, WA", "Remote",
    "Berlin, Germany", "Remote - Americas", "Anywhere", "Washington, D.C.", "Portland, OR",
    "Hyderabad, IN", "Remote, Canada / North America", "Toronto", "Remote Europe", "Wilmington, DE",
    "Dublin, Ireland", "United States", "Paris - France", "Remote (Worldwide)", "Austin, Texas",
)
PHRASES = (
    "You will build AI agents with Python and SQL.", "Fully remote team; 5+ years of experience.",
    "Must be eligible to work in the UK.", "Kubernetes, Docker, and Terraform on AWS.",
    "Active TS/SCI clearance required.", "3 to 6 years with PySpark, dbt and Airflow.",
    "RAG, evals and prompt engineering; multi-agent orchestration.",
    "Work from anywhere. TypeScript and React.js.", "Must be a German citizen.",
    "10 years of distributed systems.", "Customer-facing proof of concept work, 1 year minimum.",
    "You must currently reside in Canada.", "LangGraph, LangChain and the model context protocol.",
    "Node.js, GraphQL and Postgres with CI/CD.", "Remote-first culture, mentoring, technical writing.",
    "LLM evaluation harness and fine-tuning with LoRA.", "Power BI, DAX and data modeling.",
    "Anthropic Claude and GPT-4 tool calling.", "Go to market with stakeholder management.",
    "Snowflake streaming ingestion at petabyte scale.", "Snowflake cost tuning, 2 years.",
    "Petabyte scale lakehouse tuning.", "Streaming ingestion with exactly-once delivery.",
)
COMPANY_SUFFIXES = ("", ", Inc.", " LLC", " GmbH")

PROFILES = (
    Profile(
        "p1", False, ("united states", "new york", "remote"),
        ("agentic-engineer", "llm-engineer", "ai-engineer", "ml-engineer", "software-engineer"),
        "mid", "staff", ("python", "sql", "agents", "llm", "docker", "go"),
        ("agents", "rag", "evals", "mcp"), ("supplier 000000003", "supplier 000000005"),
    ),
    Profile(
        "p2", True, ("canada", "united kingdom"),
        ("data-engineer", "data-analyst", "software-engineer"), "junior", "senior",
        ("sql", "spark", "airflow", "dbt", "power bi"), ("power bi", "presales"),
        ("supplier 000000001",),
    ),
    Profile("p3", False, ("germany", "dublin"), target_companies=("supplier 000000002",),
            skills=("terraform", "kubernetes"), rare_skills=("customer facing",)),
)


def pick(values, index: Column) -> Column:
    """``values[index]`` for a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw items: a document is a role, replicated over one to three locations."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    suppliers = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    d = F.col("doc_id")
    keyed = docs.withColumn("_sup", d % suppliers.agg(F.count("*")).scalar())
    joined = keyed.join(suppliers, keyed["_sup"] == suppliers["s_suppkey"])
    k = F.col("k")
    return joined.withColumn("k", F.explode(F.sequence(F.lit(0), (d % 3).cast("int")))).select(
        (d * 10 + k).alias("id"), (d * 10 + k).alias("seq"), "doc_id", "k",
        pick(SOURCE_IDS, d % 15).alias("source"),
        F.concat(F.lit("n"), (d * 10 + k).cast("string")).alias("source_native_id"),
        F.concat(
            F.lit("https://www.Jobs.example.com/"), d.cast("string"), F.lit("/"), k.cast("string"),
            F.when(d % 2 == 0, F.lit("/?utm_source=feed&b=2&a=1#top")).otherwise(F.lit("")),
        ).alias("url"),
        F.concat("s_name", pick(COMPANY_SUFFIXES, F.floor(d / 7) % 4)).alias("company"),
        pick(TITLES, d % 24).alias("title"),
        pick(LOCATIONS, (F.floor(d / 3) + 5 * k) % 24).alias("location"),
        F.when(d % 4 == 0, True).when(d % 4 == 1, False).alias("remote"),
        F.concat("text", F.lit(" "), pick(PHRASES, F.floor(d / 5) % 23)).alias("description"),
        F.when(d % 3 != 0, F.concat(F.lit("$"), F.floor("s_acctbal").cast("string"))).alias("salary_text"),
        F.when(d % 11 != 0, F.timestamp_seconds(F.lit(1704067200) + (d % 30) * 86400)).alias("posted_at"),
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised postings; one in seventeen has expired."""
    return normalize(raw_postings(spark, sf_dir)).withColumn(
        "status", F.when(F.col("doc_id") % 17 == 3, "expired").otherwise("active")
    )


def text_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are, the document source standing for the company."""
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("company_normalized"), F.col("text").alias("description")
    )


def _dimensions(base: Column) -> Column:
    return F.struct(*[
        F.struct(
            ((base + n) % 13).cast("double").alias("score"),
            F.array(F.lit("e1"), F.lit(name)).alias("evidence"), F.lit(f"note {n}").alias("note"),
        ).alias(name)
        for n, (name, _) in enumerate(DIMENSIONS)
    ])


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows for every posting: verdict, retrieval and, for some, a stored rubric result."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d, k = F.col("doc_id"), F.col("k")
    rows = docs.join(labels, "doc_id", "left").withColumn(
        "k", F.explode(F.sequence(F.lit(0), (d % 3).cast("int"))))
    scored = (d % 5 != 2) & (F.coalesce("toxic", F.lit(0)) == 0)
    quality = F.coalesce("quality", F.lit(0)).cast("bigint")
    return rows.select(
        (d * 10 + k).alias("job_id"),
        F.sha2(F.trim(F.concat("text", F.lit(" "), pick(PHRASES, F.floor(d / 5) % 23))), 256)
        .alias("description_hash"),
        F.lit(RUBRIC_VERSION).alias("rubric_version"),
        F.when(d % 7 == 6, "p2").otherwise("p1").alias("profile_version"),
        (d % 6 != 1).alias("hard_filter_pass"),
        F.when(d % 6 == 1, F.array(F.lit("remote-only"))).otherwise(
            F.array().cast("array<string>")).alias("reasons"),
        ((d * 7 + k) % 101).cast("double").alias("retrieval_score"),
        F.array().cast("array<string>").alias("recall_paths"),
        F.when(scored, ((d * 13) % 80 + quality * 20).cast("double")).alias("rubric_score"),
        F.when(scored, _dimensions(d)).alias("dimensions"),
        F.when(scored & (d % 9 != 0), pick(("low", "medium", "high"), d % 3)).alias("uncertainty"),
        F.when(scored & (d % 10 != 0), F.concat(F.lit("because "), d.cast("string"))).alias("rationale"),
        F.when(scored, F.when((d + k) % 8 == 0, "v1").otherwise("v2")).alias("prompt_version"),
        F.when(scored, F.when(d % 12 == 0, "m0").otherwise("m1")).alias("model_id"),
        F.timestamp_seconds(F.lit(1706745600) + (d % 1000) * 60).alias("scored_at"),
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings: a run per day, a feed per event type, a posting per user."""
    return read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("source_native_id"),
        F.to_date("ts").alias("run"), F.col("ts").cast("timestamp").alias("seen_at"), F.col("event_id").alias("seq"),
        "value",
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per day of the events, with per-source statistics; some failed, stuck or score-only."""
    from postgrain.operators.lifecycle import run_stats

    seen = sightings(spark, sf_dir)
    stats = run_stats(seen).groupBy("run").agg(F.array_sort(F.collect_list(F.struct(
        "source", "fetched", "created", "updated", "expired",
        F.when((F.col("source") == "error"), F.lit(2)).otherwise(F.lit(0)).cast("bigint").alias("errors"),
    ))).alias("stats"))
    days = seen.groupBy("run").agg(F.min("seen_at").alias("started_at"), F.max("seen_at").alias("done"))
    ident = F.datediff("run", F.lit("2023-12-31")).cast("bigint")
    empty = F.array().cast(
        "array<struct<source:string,fetched:bigint,created:bigint,updated:bigint,expired:bigint,errors:bigint>>")
    return days.join(stats, "run").withColumn("id", ident).select(
        "id", "started_at", F.when(F.col("id") % 11 != 5, F.col("done")).alias("finished_at"),
        F.when(F.col("id") % 11 == 5, "running").when(F.col("id") % 7 == 3, "failed")
        .otherwise("completed").alias("status"),
        F.when(F.col("id") % 5 == 4, empty).otherwise(F.col("stats")).alias("stats"),
        F.when(F.col("id") % 7 == 2, F.lit("job 1 scoring failed: x | job 2 scoring failed: y")).alias("error"),
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as application events; urgent ones are notes."""
    o = read_table(spark, sf_dir, "orders")
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    status = (
        F.when(F.col("o_orderstatus") == "O", pick(
            ("shortlisted", "tailored", "applied", "response", "interview"), level - 1))
        .when(F.col("o_orderstatus") == "F", pick(
            ("applied", "offer", "rejected", "dismissed", "applied"), level - 1))
        .otherwise(F.lit("applied"))
    )
    is_note = F.col("o_orderkey") % 4 == 1
    note = F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit("note "), F.col("o_orderkey").cast("string")))
    return o.select(
        F.col("o_custkey").alias("job_id"),
        F.when(is_note, "note").otherwise("status").alias("kind"),
        F.when(is_note, note).otherwise(status).alias("value"),
        F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("seq"),
    )


def identity_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Existing postings (first location of each role) and a batch in four known arms."""
    base = postings(spark, sf_dir).where("k = 0").select(
        "doc_id", "source", "source_native_id", "canonical_url", "company_normalized",
        "title_family", "location_key", "variant_markers", "title", "url", "company", "location",
        "remote", "description",
    )
    d = F.col("doc_id")
    existing = base.withColumns({
        "seq": d, "canonical_id": F.concat(F.lit("c"), d.cast("string")),
    })
    arm = d % 4
    moved = raw_postings(spark, sf_dir).where("k = 0").withColumns({
        "seq": F.lit(1_000_000_000_000) + d,
        "source": F.when(arm == 0, F.col("source")).otherwise(pick(SOURCE_IDS, (d + 1) % 15)),
        "source_native_id": F.when(arm == 0, F.col("source_native_id")).otherwise(
            F.concat(F.lit("b"), d.cast("string"))),
        "url": F.when(arm == 1, F.concat("url", F.when(F.contains("url", F.lit("?")), F.lit("")).otherwise(
            F.lit("?gclid=1")))).when(arm == 0, F.col("url")).otherwise(
            F.concat(F.lit("https://other.example.org/"), d.cast("string"))),
        "title": F.when(arm == 2, F.concat("title", F.lit(" Remote"))).when(
            arm == 3, F.concat(F.lit("Staff Principal "), F.col("title"))).otherwise(F.col("title")),
    })
    batch = normalize(moved)
    keep = ["seq", "source", "source_native_id", "canonical_url", "company_normalized",
            "title_family", "location_key", "variant_markers", "title"]
    return existing.select(*keep, "canonical_id"), batch.select(*keep)
