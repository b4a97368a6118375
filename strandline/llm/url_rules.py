"""URL filters by association rules.

Fixed rules over host and path decide first. The urls that one of them decides are the
labelled ones, without the tokens that this rule itself tests: those would only repeat how
the label was made. FP-growth mines which combinations of the other tokens go with block and
with allow. Rules are pruned: by support, by confidence, if a part of their tokens says the
same at least as surely, and unless urls of at least two fixed rules bear them out. What is
left judges the urls that no fixed rule fits, by an inverted index: a rule stands under its
rarest token alone, and fires when all its tokens are met; the surest wins. A url that no
rule fits is allowed.

All tokens of a url count: host labels and path steps by place, every query name, scheme,
fragment. Tokens of less than the support can be in no rule and go first; tokens that stand
in the very same urls stand for one another, so that they don't multiply combinations. What
reaches the driver are the tokens that are left: at most the tokens of a url over the support.
Urls meet the index once for each distinct set of these.

Defined results: a null url, or one without ://, has empty host and path, no tokens, and is
allowed; repeated rows are judged each; of rules equally sure the one of more support, then
the first by its tokens wins; long urls count whole; null ids pass through; an empty table,
or one without labelled urls, gives no mined rules; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, spread_join, table

#: Verdict, host, path.
FIXED = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
SUPPORT = 0.01
CONFIDENCE = 0.9
UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER_CASE)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = FIXED) -> Column:
    """The longest fitting rule as (rule, verdict); null if none fits."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """All tokens of a url; numbers are all alike, so ids don't count as words."""
    text = F.coalesce(url, F.lit(""))
    labels = F.reverse(F.split(host, r"\."))
    steps = F.array_remove(F.split(path, "/"), "")
    names = F.split(F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    plain = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    told = lambda kind, c: F.when(c != "", F.concat(F.lit(f"{kind}="), plain(c)))
    placed = lambda kind, cs: F.transform(cs, lambda c, i: F.when(c != "", F.concat(F.lit(kind), i + 1, F.lit("="), plain(c))))
    single = F.array(told("scheme", F.regexp_extract(text, r"(?s)^(.*?)://", 1)), told("part", F.regexp_extract(text, r"(?s)#(.*)$", 1)), told("last", F.when(F.size(steps) > 1, F.element_at(steps, -1))))
    queries = F.transform(names, lambda q: told("query", F.regexp_extract(q, "(?s)^([^=]*)", 1)))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(single, placed("host", labels), placed("step", steps), queries))))


def untested(tokens_: Column, rule: Column, rules: list[tuple[str, str, str]] = FIXED) -> Column:
    """The tokens that the fixed rule (host and path as one text) doesn't look at."""
    out = tokens_
    for _, h, p in rules:
        steps = len([x for x in p.split("/") if x])
        tested = [f"host{i + 1}" for i in range(len(h.split(".")))] + [f"step{i + 1}" for i in range(steps)]
        left = F.filter(tokens_, lambda t: ~F.substring_index(t, "=", 1).isin(*tested))  # noqa: B023
        # the last step is a tested one, too, if the rule reaches it
        out = F.when(rule == h + p, F.filter(left, lambda t: ~(t.startswith("last=") & (F.size(F.filter(tokens_, lambda x: x.startswith("step"))) <= steps)))).otherwise(out)  # noqa: B023
    return out


def stand_ins(labelled: DataFrame, support: float = SUPPORT) -> dict[str, str]:
    """Each token of at least `support` of the labelled urls, with the first of the tokens that stand in the very same urls."""
    rows = materialize(labelled.select("tokens", F.monotonically_increasing_id().alias("id")))
    least = support * rows.count()
    per = rows.select("id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"))
    frequent = per.where(F.col("n") >= least).collect()  # at most the tokens of a url over the support
    release(rows)
    first: dict = {}
    for r in sorted(frequent, key=lambda r: r["token"]):
        first.setdefault((r["n"], r["mark"]), r["token"])
    return {r["token"]: first[r["n"], r["mark"]] for r in frequent}


def reduced(tokens_: Column, stand_in: dict[str, str]) -> Column:
    """The stand-ins of the tokens that have one."""
    if not stand_in:
        return F.array().cast("array<string>")
    known = F.create_map(*[F.lit(x) for kv in sorted(stand_in.items()) for x in kv])
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(tokens_, lambda t: F.try_element_at(known, t)))))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (tokens, verdict, confidence, support) from (tokens, verdict) rows."""
    from pyspark.ml.fpm import FPGrowth

    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0].startswith("verdict=")).select(
        F.array_sort("antecedent").alias("tokens"),
        F.substring_index(F.col("consequent")[0], "=", -1).alias("verdict"),
        "confidence",
        "support",
    )
    return materialize(rules)


def prune(rules: DataFrame) -> DataFrame:
    """Without the rules of which a part, one token shorter or more, says the same at least as surely."""
    short = rules.select(F.explode("tokens").alias("token"), F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("least"))
    met = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("token")).join(short, ["token", "verdict"])
    worse = met.where(
        (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("least") >= F.col("confidence"))
    )
    return rules.join(worse.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti")


def fired(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """sets (tokens, n and more) joined to the rules whose tokens they hold: rule, verdict, confidence, support.

    A rule stands under its rarest token alone; a set looks under each of its tokens and
    compares the rest. Many sets share a token, so tokens are joined as `spread_join` does.
    """
    some = sets.withColumn("token", F.explode("tokens"))
    seen = some.groupBy("token").agg(F.count(F.lit(1)).alias("__n"))
    named = rules.select(F.col("tokens").alias("rule"), "verdict", "confidence", "support")
    at = named.withColumn("token", F.explode("rule")).join(seen, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("__n", F.lit(0)), "token")).alias("token")
    keyed = at.groupBy("rule", "verdict", "confidence", "support").agg(rarest)
    index = keyed.groupBy("token").agg(F.collect_list(F.struct("rule", "verdict", "confidence", "support")).alias("under")).join(seen, "token")  # of the rules, which support bounds
    met = spread_join(some, materialize(index), "token", "__n").withColumn("r", F.explode("under"))
    return met.where(F.size(F.array_except("r.rule", "tokens")) == 0).select(*sets.columns, "r.*")


def borne_out(rules: DataFrame, labelled: DataFrame, least: int = 2) -> DataFrame:
    """The rules that urls of at least `least` fixed rules bear out."""
    sets = labelled.select("tokens", "by", F.col("verdict").alias("told")).distinct()
    found = fired(sets, rules).where(F.col("told") == F.col("verdict")).groupBy(F.col("rule").alias("tokens"), "verdict")
    enough = found.agg(F.countDistinct("by").alias("k")).where(F.col("k") >= least)
    return rules.join(enough.select("tokens", "verdict"), ["tokens", "verdict"], "left_semi")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined_rule, mined_verdict): the surest rule that fires on each distinct token set of `sets`."""
    best = F.min(F.struct(-F.col("confidence"), -F.col("support"), F.col("rule"), F.col("verdict"))).alias("b")
    text = F.array_join("b.rule", " & ").alias("mined_rule")
    return fired(sets.select("tokens"), rules).groupBy("tokens").agg(best).select("tokens", text, F.col("b.verdict").alias("mined_verdict"))


def judge(pages: DataFrame) -> DataFrame:
    """host, path, rule and verdict of every row of (page_id, url), and the mined rule where one decides."""
    split = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = split.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"))).withColumn(
        "tokens", F.when(F.col("host") != "", tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>"))
    )
    seen = materialize(
        seen.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.col("fixed.verdict").alias("fixed_verdict"), "tokens")
    )
    told = seen.where(F.col("rule").isNotNull()).select(untested(F.col("tokens"), F.col("rule")).alias("tokens"), F.col("rule").alias("by"), F.col("fixed_verdict").alias("verdict"))
    stand_in = stand_ins(told)
    labelled = told.withColumn("tokens", reduced(F.col("tokens"), stand_in))
    open_ = seen.where(F.col("rule").isNull()).withColumn("tokens", reduced(F.col("tokens"), stand_in))
    sets = materialize(open_.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")))
    rules = materialize(borne_out(prune(mine(labelled)), labelled)) if stand_in else None
    none = {"mined_rule": F.lit(None).cast("string"), "mined_verdict": F.lit(None).cast("string")}
    if rules is None or rules.isEmpty():
        judged = open_.withColumns(none)
    else:
        found = materialize(sets.join(match(sets, rules), "tokens", "left"))
        judged = spread_join(open_, found, "tokens", "n").drop("n")
    decided = seen.where(F.col("rule").isNotNull()).withColumns(none)
    out = decided.unionByName(judged)
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed_verdict", "mined_verdict", F.lit("allow")).alias("verdict"), "mined_rule")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
