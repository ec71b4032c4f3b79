"""Cross-source identity: which earlier posting, if any, is this the same role as?

Every row of the batch gets a parent: the earliest row that matches in the first stage with a
match (source id, then URL, then fingerprint block with similar title). Parents may be batch rows
themselves; following parents to the root gives the identity. Matching is against the table as it
was when the batch started plus the earlier rows of the batch.

No stage compares rows pair by pair. Stages one and two look up the smallest sequence number of a
key. Stage three looks up shared token subsets: two token sets x and y are similar exactly when
some common subset s has |s| / (|x| + |y| - |s|) at the threshold or above, so each distinct title
publishes its large subsets with its smallest sequence number, and a lookup is a join against one
row per (block, subset, size) however many postings share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.functions.fanout import inline_rows
from postgrain.functions.taxonomy import fingerprint, title_tokens, token_similarity
from postgrain.rules.constants import TITLE_SIMILARITY
from postgrain.session import checkpointed

# Above this many distinct words a title has too many subsets to publish; such titles are joined
# on their rarest words instead.
SUBSET_WORDS = 12

_KEYS = ("source", "source_native_id", "canonical_url")


def _nodes(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select(
        "seq", *_KEYS,
        fingerprint(
            F.col("company_normalized"), F.col("title_family"), F.col("location_key"),
            F.col("variant_markers"),
        ).alias("block"),
        F.array_sort(title_tokens("title")).alias("tokens"),
        *extra,
    )


def _subset_keys(block: Column, tokens: Column, threshold: float) -> Column:
    """(key, size) of every subset large enough to prove similarity with anything."""
    n = F.size(tokens)
    need = F.ceil(n * F.lit(threshold))
    masks = F.filter(
        F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), n) - 1),
        lambda m: F.bit_count(m) >= need,
    )
    chosen = F.transform(
        masks,
        lambda m: F.struct(
            F.md5(F.concat(block, F.lit("|"), F.array_join(F.filter(
                tokens, lambda t, i: F.getbit(m.cast("bigint"), i) == 1), " "
            ))).alias("key"),
            F.bit_count(m).alias("shared"),
        ),
    )
    return F.when(n > 0, chosen).otherwise(F.array().cast(
        "array<struct<key:string,shared:int>>"
    ))


def _short_matches(lookup: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """(block, tokens) -> smallest sequence number of a similar title, both titles short."""

    def published(groups: DataFrame) -> DataFrame:
        short = groups.where(F.size("tokens") <= SUBSET_WORDS)
        keys = _subset_keys(F.col("block"), F.col("tokens"), threshold)
        return inline_rows(short, keys, *groups.columns)

    offers = published(index).groupBy(
        "key", "shared", F.size("tokens").alias("other_size")
    ).agg(F.min("first_seq").alias("first_seq"))
    own = F.size("tokens")
    return (
        published(lookup).join(offers, ["key", "shared"])
        .where(F.col("shared") / (own + F.col("other_size") - F.col("shared")) >= threshold)
        .select("block", "tokens", "first_seq")
    )


def _long_matches(lookup: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """The same where at least one title is long: join on the rarest words, then verify.

    A set of n words similar to another shares one of its n - ceil(t*n) + 1 rarest words with the
    other's rarest words, whatever the common order of words is. Where they share the i-th and the j-th,
    at most the words from there on can be common as well, so most pairs go before titles are compared.
    """
    longest = F.size("tokens") >= F.ceil(F.lit(SUBSET_WORDS * threshold))
    rarity = (
        index.where(longest).select(F.explode("tokens").alias("word"))
        .groupBy("word").agg(F.count("*").alias("uses"))
    )

    def prefixed(groups: DataFrame) -> DataFrame:
        ranked = (
            groups.where(longest).select("block", "tokens", F.explode("tokens").alias("word"))
            .join(rarity, "word", "left")
            .groupBy("block", "tokens")
            .agg(F.array_sort(F.collect_list(
                F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "word"))).alias("order"))
        )
        n = F.size("tokens")
        keep = n - F.ceil(n * F.lit(threshold)).cast("int") + 1
        return ranked.select(
            "block", "tokens", F.posexplode(F.slice("order", F.lit(1), keep)).alias("place", "_w")
        ).select("block", "tokens", "place", F.col("_w.word").alias("word"))

    left = prefixed(lookup)
    right = prefixed(index).join(index, ["block", "tokens"]).select(
        "block", "word", F.col("tokens").alias("other"), F.col("place").alias("other_place"), "first_seq"
    )
    a, b = F.size("tokens"), F.size("other")
    # the first word they share has only unshared ones before it
    rest = F.least(a - F.col("place"), b - F.col("other_place"))
    return (
        left.join(right, ["block", "word"])
        .where((1 + F.lit(threshold)) * rest >= F.lit(threshold) * (a + b) - 1e-9)
        .where((F.greatest(a, b) > SUBSET_WORDS) & (F.least(a, b) >= F.greatest(a, b) * threshold))
        .where(token_similarity(F.col("tokens"), F.col("other")) >= threshold)
        .select("block", "tokens", "first_seq")
    )


def similar_titles(
    lookup: DataFrame, index: DataFrame, threshold: float = TITLE_SIMILARITY
) -> DataFrame:
    """(block, tokens, first_seq): earliest row of the block with a similar title.

    ``lookup`` has distinct (block, tokens); ``index`` has distinct (block, tokens) with the
    smallest sequence number of each.
    """
    found = _short_matches(lookup, index, threshold).unionByName(
        _long_matches(lookup, index, threshold)
    )
    return found.groupBy("block", "tokens").agg(F.min("first_seq").alias("first_seq"))


# A key with more than this part of the rows a task would get on average is looked up in place.
HEAVY_SHARE = 4


def look_up(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key, without a task for a heavy key.

    Fewer than ``HEAVY_SHARE`` keys per shuffle partition can be heavy, so their rows of ``table`` are
    broadcast and their rows stay where they are. Pass stored rows: they are counted first.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*by).count()
    heavy = checkpointed(counts.where(F.col("count") > max(1, rows.count() // (HEAVY_SHARE * parts))).select(*by))
    hot = rows.join(F.broadcast(table.join(F.broadcast(heavy), by, "left_semi")), by)
    return rows.join(F.broadcast(heavy), by, "left_anti").join(table, by).unionByName(hot)


def assign_parents(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch rows with the stage that matched and the sequence number of their parent."""
    # the batch is read by every stage; the stored side is scanned per stage, few columns each
    rows = checkpointed(_nodes(batch))
    nodes = _nodes(existing).unionByName(rows)

    def earliest(by: list[str], within: DataFrame, name: str) -> DataFrame:
        # minima first: a key with many rows leaves each scan task as one row
        minima = nodes.groupBy(*by).agg(F.min("seq").alias(name))
        return checkpointed(minima.join(within.select(*by).distinct(), by, "left_semi"))

    key = ["source", "source_native_id"]
    one = checkpointed(look_up(rows, earliest(key, rows, "by_id"), key))
    open_one = one.where("by_id = seq")
    url = ["canonical_url"]
    two = checkpointed(look_up(open_one, earliest(url, open_one, "by_url"), url))
    open_two = two.where("by_url = seq")
    # stage three touches only blocks that still hold an unresolved row
    index = (
        nodes.groupBy("block", "tokens").agg(F.min("seq").alias("first_seq"))
        .join(open_two.select("block"), "block", "left_semi")
    )
    lookup = open_two.select("block", "tokens").distinct()
    three = open_two.join(similar_titles(lookup, index), ["block", "tokens"], "left")
    earlier = F.col("first_seq") < F.col("seq")
    columns = ("seq", "block")
    return (
        one.where("by_id < seq")
        .select(*columns, F.lit("source-id").alias("stage"), F.col("by_id").alias("parent"))
        .unionByName(two.where("by_url < seq").select(
            *columns, F.lit("canonical-url").alias("stage"), F.col("by_url").alias("parent")))
        .unionByName(three.select(
            *columns,
            F.when(earlier, "fingerprint").otherwise("new").alias("stage"),
            F.when(earlier, F.col("first_seq")).otherwise(F.col("seq")).alias("parent")))
    )


def find_roots(parents: DataFrame) -> DataFrame:
    """Follow parents to the root by doubling: each round halves the remaining distance.

    A row without a parent row in the table, or that is its own parent, is a root.
    """
    links = checkpointed(parents.select("seq", F.col("parent").alias("root")))
    while True:
        # only rows that have a parent elsewhere can move anything further
        inner = links.where("root <> seq").select(
            F.col("seq").alias("root"), F.col("root").alias("next")
        )
        stepped = links.join(inner, "root", "left").select(
            "seq", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        stepped = checkpointed(stepped)
        links = stepped.select("seq", "root")
        if stepped.where("moved").isEmpty():
            return links


def resolve_identity(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """(seq, stage, canonical_id) for each batch row.

    ``existing`` and ``batch`` carry seq, source, source_native_id, canonical_url,
    company_normalized, title_family, location_key, variant_markers and title; ``existing`` also
    carries canonical_id. Sequence numbers of the batch follow those of ``existing``.
    """
    parents = checkpointed(assign_parents(existing, batch))
    roots = find_roots(parents)
    known = existing.select(F.col("seq").alias("root"), "canonical_id").unionByName(
        parents.where("stage = 'new'").select(
            F.col("seq").alias("root"), F.substring("block", 1, 32).alias("canonical_id")
        )
    )
    return (
        parents.select("seq", "stage").join(roots, "seq").join(known, "root")
        .select("seq", "stage", "canonical_id")
    )
