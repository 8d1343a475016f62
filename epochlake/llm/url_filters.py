"""URL filters (operator 8, native): association rules mined by Spark's FP-growth, matched by an inverted index.

``mine_rules`` turns labelled URLs into token sets (host labels, path words, query keys, their shapes) plus the label, and
keeps the rules "tokens -> block" whose support and confidence suffice. Two steps keep FP-growth small and lose no
rule: a token that too few blocked URLs have can be in no rule and is left out; tokens that stand in exactly the same
labelled URLs (the words of one site's template, say) are one item, of which a URL needs any one. ``judge`` matches every URL
against the mined rules and a list of written rules in one pass: each rule stands in an index under the tokens of its rarest
item, or its host, each URL is exploded into its keys, and one equi-join finds the candidates. A written rule, the
longest that fits, beats the mined ones.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is allowed. Rows are
kept one for one, repeated rows and equal ids included. With no labels, or none that block, no rule is mined. Names that
the result adds are refused among the columns kept.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, refuse_columns

#: Rules up to this number are broadcast; above it the index is joined by a salted shuffle.
BROADCAST_RULES = 20_000
#: Pieces that a hot key is dealt to where the index isn't broadcast.
SALTS = 32
BLOCK = "label=block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, parts, 1)), F.regexp_extract(text, parts, 2)


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels ``h:``, path words ``p:`` (digits become 0), query keys ``q:``, the fragment ``f:``."""
    host, path = host_and_path(url)
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(text, r"(?s)^.*?://[^#]*#(.*)", 1)

    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))

    shaped = F.regexp_replace(ascii_lower(path), "[0-9]+", "0")
    return F.array_distinct(
        F.concat(
            tagged("h:", F.split(host, r"\.")),
            tagged("p:", F.split(shaped, "[/._-]+")),
            tagged("q:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
            tagged("f:", F.array(fragment)),
        )
    )


def least_share(k: Column, n: Column, z: float) -> Column:
    """Lower end of Wilson's interval for a share of k in n, ``z`` standard errors wide to each side."""
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine_rules(labelled: DataFrame, url: str, block: Column, min_support: float = 0.002, min_confidence: float = 0.5, min_count: int = 5, z: float = 4.0) -> DataFrame:
    """Rules (items, tokens, key, confidence, lift, support) whose consequent is "block".

    ``items`` is an array of items, each an array of equivalent tokens; ``tokens`` names each item by its first token. A
    combination must occur in ``min_support`` of the labelled URLs and in ``min_count`` blocked ones, and the lower end of its confidence's
    interval (Wilson's, ``z`` standard errors) must exceed the share of blocked URLs. Of the many combinations that are
    tried hardly one gets there by chance, so few or unrelated labels give no rules, whatever the table's size. The frequent
    tokens that FP-growth keeps on the driver number at most tokens-per-URL / ``min_support``. Rules that a rule
    of one item less implies with at least the same confidence are dropped: they decide nothing.
    """
    rows = cut(labelled.select(url_tokens(F.col(url)).alias("tokens"), block.alias("block")).filter("block is not null").withColumn("row", F.monotonically_increasing_id()))
    total, blocked = rows.agg(F.count(F.lit(1)), F.count_if("block")).first()
    least = max(total * min_support, min_count)
    places = rows.select("row", "block", F.explode("tokens").alias("token"))
    counts = places.groupBy("token").agg(F.count_if("block").alias("n_block"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y"))
    common = counts.filter((F.col("n_block") >= least) & (F.col("n_block") > 0))
    classes = cut(common.groupBy("n", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("members")).select("members", F.col("members")[0].alias("item"), "n"))
    single = classes.select(F.col("item").alias("token"))
    found = places.join(single, "token").groupBy("row").agg(F.collect_list("token").alias("own"))
    kept = rows.select("row", "block").join(found, "row", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    items = kept.select(F.when(F.col("block"), F.array_append("own", F.lit(BLOCK))).otherwise(F.col("own")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(total, 1)), minConfidence=min_confidence).fit(items)
    rules = cut(model.associationRules.filter(F.col("consequent")[0] == BLOCK).select(F.array_sort("antecedent").alias("tokens"), "confidence", "lift", "support"))
    hits = F.round(F.col("support") * total)
    rules = rules.filter((hits >= min_count) & (least_share(hits, hits / F.col("confidence"), z) > blocked / max(total, 1)))
    less = rules.filter(F.size("tokens") > 1).select("tokens", "confidence", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("part"))
    implied = less.join(rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("before")), "part").filter(F.col("before") >= F.col("confidence")).select("tokens").distinct()
    rules = rules.join(implied, "tokens", "left_anti")
    each = rules.select("tokens", F.explode("tokens").alias("item")).join(classes, "item")
    whole = each.groupBy("tokens").agg(F.array_sort(F.collect_list("members")).alias("items"), F.min_by("members", F.struct("n", "item")).alias("keys"))
    return rules.join(whole, "tokens").select("items", "tokens", F.explode("keys").alias("key"), "confidence", "lift", "support")


def written_rules(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """Rows of (verdict, ``host/path``) as the index holds them, from literals."""
    made = [F.struct(F.lit(r).alias("rule"), ascii_lower(F.lit(r.partition("/")[0])).alias("host"), F.lit("/" + r.partition("/")[2]).alias("prefix"), F.lit(v).alias("verdict")) for v, r in rules]
    if not made:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("rule", "host", "prefix", "verdict")])
    return spark.range(1).select(F.explode(F.array(*made)).alias("r")).select("r.*")


def judge(pages: DataFrame, mined: DataFrame, written: DataFrame, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep``, ``host``, ``path``, ``rule``, ``verdict``, ``confidence`` and ``tokens`` of the mined rule that decided."""
    keep = [c for c in pages.columns if c != url] if keep is None else keep
    refuse_columns(keep, ["host", "path", "rule", "verdict", "confidence", "tokens"])
    depth = written.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0))).first()[0]
    index = mined.select(F.concat(F.lit("t/"), "key").alias("key"), "items", "tokens", "confidence", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("prefix"), F.lit("block").alias("says")).unionByName(
        written.select(F.concat(F.lit("s/"), "host").alias("key"), F.array().cast("array<array<string>>").alias("items"), F.array().cast("array<string>").alias("tokens"), F.lit(None).cast("double").alias("confidence"), "rule", "prefix", F.col("verdict").alias("says"))
    )
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), host.alias("host"), path.alias("path"), url_tokens(F.col(url)).alias("own"), F.monotonically_increasing_id().alias("row"))
    labels = F.split("host", r"\.")
    levels = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(depth, 1))))
    suffixes = F.transform(levels, lambda k: F.concat(F.lit("s/"), F.array_join(F.slice(labels, -k, k), ".")))
    keys = F.concat(F.transform("own", lambda x: F.concat(F.lit("t/"), x)), suffixes)
    exploded = rows.withColumn("key", F.explode(keys))
    if index.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        joined = exploded.join(F.broadcast(index), "key", "left")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = exploded.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    fits = F.when(F.col("rule").isNotNull(), F.startswith("path", F.col("prefix"))).otherwise(F.forall("items", lambda x: F.arrays_overlap(x, F.col("own")))) & F.col("says").isNotNull()
    hit = F.struct(F.coalesce(F.length("rule"), F.lit(-1)).alias("weight"), F.coalesce("confidence", F.lit(0.0)).alias("sure"), "rule", "says", "tokens")
    best = joined.groupBy("row").agg(F.first("kept").alias("kept"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(fits, hit)).alias("hit"))
    mined_hit = F.col("hit").isNotNull() & F.col("hit.rule").isNull()
    return best.select("kept.*", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.says", F.lit("allow")).alias("verdict"), F.when(mined_hit, F.col("hit.sure")).alias("confidence"), F.when(mined_hit, F.col("hit.tokens")).alias("tokens"))
