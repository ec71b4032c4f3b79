"""Secret scanning over versions of files, with a ledger of what was scanned before.

Every version is known by the SHA-256 of its text, its blob. Only pairs of a blob and a rule version
that the ledger does not hold are scanned; their findings, empty ones too, are appended to it. The
findings of all blobs are then joined back to every path that has or had them. DataFrame functions
only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postgrain.llm.shared import by_place, new_folder, picked, position, staged


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters, in order."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


#: Fixed: the first three kinds and their lengths. Patterns whose matches are whole runs have the
#: length in them, which leaves the same matches.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob string, kind string, version int, spans array<struct<start: int, end: int>>"


_RUN = 128  # items whose output is collected before it joins the rest


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _walked(items: Column, start: Column, step, empty: Column) -> Column:
    """(at, outs) after ``step(at, item) -> (at, outputs)`` over all items; ``outs`` are all outputs in order.

    Arrays are copied when they grow, so outputs are gathered by runs of items and the runs by runs of
    runs: a million items copy each output some hundred times, not half a million times.
    """
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / _RUN), F.lit(0))),
                       lambda k: F.slice(items, (k * _RUN + 1).cast("int"), _RUN))
    nothing = F.struct(start.alias("at"), empty.alias("outs"))

    def within(at: Column, run: Column) -> Column:
        def one(state: Column, item: Column) -> Column:
            return _bound(step(state["at"], item), lambda s: F.struct(
                s["at"].alias("at"), F.concat(state["outs"], s["outs"]).alias("outs")))
        return F.aggregate(run, F.struct(at.alias("at"), empty.alias("outs")), one)

    def joined(state: Column, run: Column) -> Column:
        return _bound(within(state["at"], run), lambda s: F.struct(
            s["at"].alias("at"), F.concat(state["outs"], F.array(s["outs"])).alias("outs")))

    begin = F.struct(start.alias("at"), F.slice(F.array(empty), 1, 0).alias("outs"))
    all_runs = F.aggregate(runs, begin, joined, lambda s: F.struct(s["at"].alias("at"), F.flatten(s["outs"]).alias("outs")))
    return F.when(F.size(items) > 0, all_runs).otherwise(nothing)


def rule_spans(text: Column, rule: Rule) -> Column:
    """[start, end) of the matches of a rule, in code points: leftmost, without overlaps.

    The text around the matches and the matches alternate, so places are sums of lengths. A text
    without a match is only searched once.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    around = F.split(text, rule.pattern, -1)
    pairs = F.arrays_zip(matches.alias("match"), around.alias("before"))
    empty = F.lit([]).cast("array<struct<start: int, end: int>>")

    def step(at: Column, pair: Column) -> Column:
        match, start = pair["match"], at + F.length(pair["before"])
        end = start + F.coalesce(F.length(match), F.lit(0))
        secret = match if not rule.group else F.regexp_extract(match, rule.pattern, rule.group)
        found = F.when(F.length(secret) >= rule.least, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(empty)
        return F.struct(end.alias("at"), found.alias("outs"))

    return F.when(text.rlike(rule.pattern), _walked(pairs, F.lit(0), step, empty)["outs"]).otherwise(empty)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what ``ledger`` (a Parquet folder, made if it is missing) lacks for ``versions`` (text).

    Copies of a text are folded before they move, so one text in a third of all rows costs no more
    than any other; a blob whose rules were all scanned is dropped before its text is searched.
    """
    rows = picked(versions, "text").select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = rows.groupBy("blob").agg(F.first("text").alias("text"))
    seen = F.lit([]).cast("array<string>")
    if _exists(versions.sparkSession, ledger):
        current = _current(versions.sparkSession.read.schema(LEDGER).parquet(ledger), rules)
        blobs = blobs.join(current.groupBy("blob").agg(F.collect_set("kind").alias("seen")), "blob", "left")
        seen = F.coalesce("seen", seen)
        blobs = blobs.where(F.size(seen) < len(rules))
    pending = [
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                 F.when(~F.array_contains(seen, r.kind), rule_spans(F.col("text"), r)).alias("spans"))
        for r in rules]
    found = blobs.select("blob", F.explode(F.filter(F.array(*pending), lambda p: p["spans"].isNotNull())).alias("p"))
    found.select("blob", "p.kind", "p.version", "p.spans").write.mode("append").parquet(ledger)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _current(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of the given rule versions."""
    versions = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    return ledger.where(F.element_at(versions, F.col("kind")) == F.col("version"))


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): all findings of a blob, by start, then rule; blobs without any are left out.

    A pair that two runs scanned at the same time is counted once."""
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)])
    rows = _current(spark.read.schema(LEDGER).parquet(ledger), rules).where(F.size("spans") > 0)
    rows = rows.dropDuplicates(["blob", "kind"])
    spans = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.element_at(order, F.col("kind")).alias("rank"), s["end"].alias("end"), F.col("kind").alias("kind")))
    return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("spans"))


def secrets(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` (text and any other columns) with ``spans``: structs (start, rank, end, kind).

    Without a ledger a new one is made in the shared folder. Null text: empty, no findings. Repeated
    rows and empty tables give as many rows. Columns may have any name; one called ``spans`` is replaced.
    """
    spark = versions.sparkSession
    ledger = ledger or new_folder(spark, "secret-ledger")
    scan(versions, ledger, rules)
    found = staged(findings(spark, ledger, rules), "secret-findings")
    none = F.lit([]).cast(found.schema["spans"].dataType)
    names = [c for c in versions.columns if c.lower() != "spans"]
    stay = [F.col(f"c{k}") for k, c in enumerate(versions.columns) if c.lower() != "spans"]
    keyed = by_place(versions).withColumn("blob", blob_of(F.col(f"c{position(versions, 'text')}")))
    # one blob may have a third of all rows: plain tables on both sides, so skewed parts are split.
    # Findings grow with the data, so they are merged at every size and never broadcast.
    joined = keyed.join(found.hint("merge"), "blob", "left")
    return joined.select(*stay, F.coalesce("spans", none)).toDF(*names, "spans")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every run of overlapping spans replaced by a mark.

    Pieces are cut from the text with four bytes a code point, where any place is found at once.
    """
    wide = F.encode(text, "UTF-32")
    empty = F.lit([]).cast("array<string>")

    def cut(data: Column, start: Column, size: Column) -> Column:
        return F.decode(F.substring(data, start * 4 + 1, size * 4), "UTF-32")

    def cleaned(data: Column) -> Column:
        def step(at: Column, span: Column) -> Column:
            apart = span["start"] >= at
            out = F.when(apart, F.array(cut(data, at, span["start"] - at), F.lit(mark))).otherwise(empty)
            return F.struct(F.greatest(at, span["end"]).alias("at"), out.alias("outs"))

        return _bound(_walked(spans, F.lit(0), step, empty), lambda s: F.concat(
            F.array_join(s["outs"], ""), cut(data, s["at"], F.length(text) - s["at"])))

    return F.when(F.size(spans) > 0, _bound(wide, cleaned)).otherwise(text)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
