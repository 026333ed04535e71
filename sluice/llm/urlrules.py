"""URL filters: fixed host and path rules, and association rules mined from the URLs they judge.

A fixed rule names a host (with its subdomains) and the beginning of a path; the longest that fits
decides. URLs that one decides are the labelled examples: Spark's FP-growth mines their token sets
together with the verdict, and the rules `tokens -> verdict` that reach the support and the
confidence asked for, and aren't implied by a shorter rule of at least their confidence, judge the
other URLs. The shortest rule of all has no tokens and says the verdict that most examples have. Each
other rule is filed under its rarest token; a URL looks up its own tokens there, and of the rules
whose tokens it has all, the surest decides (then the better supported, then the order of the
verdict's name); where there is none, the rule without tokens.

Tokens that stand in the same examples throughout, and would double the number of frequent sets each,
are mined as one, under the first one's name; those that stand in all examples say nothing and are left
out. What else bounds the mining is the support; no rule is dropped for its length or its rank.

All of it is DataFrame functions. Up to `max_rules` filed rules reach the pages as the value of a
scalar subquery, so that pages are neither shuffled nor joined; more are joined by token.

Results in special cases: a null url, or one without `://`, has an empty host and path and no token, so
the rule without tokens decides; so does it for every url no fixed rule fits if there are no mined ones;
without labelled URLs that rule says `default`; repeated rows are judged, and count as examples, each;
urls may be of any length, and all of their host labels, path segments and query keys are tokens.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import keep_written, scratch, written

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.6
#: Filed rules up to which they are sent to every task.
MAX_RULES = 5000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, _, tail = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + tail)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: ends of the host at its dots, its first label, path segments by place (of one that begins with a number its first digit), extension, query keys, fragment, scheme."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    hosts = F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, n - k + 1, k), "."))),
            F.array(F.concat(F.lit("first:"), F.get(labels, F.lit(0)))),
        )
    )
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    paths = F.transform(segments, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), F.when(s.rlike(r"^\d+"), F.concat(F.lit("#"), F.substring(s, 1, 1))).otherwise(s)))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    keys = F.transform(F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1)), lambda k: F.concat(F.lit("key:"), k))
    rest = F.array(F.when(ending != "", F.concat(F.lit("ext:"), ending)), F.when(F.instr(url, "#") > 0, F.lit("fragment")), F.concat(F.lit("scheme:"), F.regexp_extract(url, r"^([A-Za-z]+)://", 1)))
    return F.coalesce(F.array_distinct(F.array_compact(F.concat(hosts, paths, keys, rest))), F.array().cast("array<string>"))


def _informative(labelled: DataFrame, min_support: float) -> DataFrame:
    """labelled with `tokens` cut down to those that are frequent, of several that always stand together the first, and without those that always stand."""
    rows = labelled.withColumn("example", F.xxhash64("tokens", "verdict", F.monotonically_increasing_id()))
    rows = written(rows, "examples")
    n = rows.count()
    mark = F.xxhash64("example", F.lit(1)).cast("decimal(38,0)")
    each = rows.select("example", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("example").alias("x"), F.sum(mark).alias("y"))
    each = each.filter((F.col("n") >= min_support * n) & (F.col("n") < n))
    first = each.groupBy("n", "x", "y").agg(F.min("token").alias("token"))
    names = first.agg(F.sort_array(F.collect_list("token")).alias("tokens"))  # at most 1 / min_support times the tokens of a URL
    return rows.select("verdict", F.array_intersect("tokens", names.scalar()).alias("tokens"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """labelled: tokens, verdict. One row per rule: tokens, verdict, confidence, support, filed (its rarest token)."""
    mark = "verdict="
    items = _informative(labelled, min_support).select(F.concat(F.col("tokens"), F.array(F.concat(F.lit(mark), F.col("verdict")))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items).freqItemsets
    sets = sets.withColumn("verdict", F.filter("items", lambda t: t.startswith(mark))).withColumn("tokens", F.array_sort(F.filter("items", lambda t: ~t.startswith(mark))))
    sets = written(sets.filter(F.size("tokens") > 0).select("tokens", F.substring(F.get("verdict", F.lit(0)), len(mark) + 1, 1 << 20).alias("verdict"), "freq"), "sets")
    plain = sets.filter(F.col("verdict").isNull()).select("tokens", F.col("freq").alias("of"))
    alone = plain.filter(F.size("tokens") == 1).select(F.get("tokens", F.lit(0)).alias("t"), F.col("of").alias("f"))
    rules = sets.filter(F.col("verdict").isNotNull()).join(plain, "tokens").withColumn("confidence", F.col("freq") / F.col("of")).filter(F.col("confidence") >= min_confidence)
    rules = written(rules, "rules")
    # A rule goes if a part of it, with the same verdict, is as sure.
    parts = rules.select("tokens", "verdict", "confidence", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), F.size("tokens")).cast("int") - 2), lambda m: F.filter(F.col("tokens"), lambda t, i: F.expr("1") == F.getbit(m, i))), lambda p: F.size(p) > 0)).alias("part"))
    shorter = rules.select(F.col("tokens").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    implied = parts.join(shorter, (parts.part == shorter.part) & (parts.verdict == shorter.v) & (F.col("c") >= F.col("confidence")), "left_semi").select("tokens", "verdict").distinct()
    rules = rules.join(implied, ["tokens", "verdict"], "left_anti")
    rarest = rules.select("tokens", "verdict", F.explode("tokens").alias("t")).join(alone, "t").groupBy("tokens", "verdict").agg(F.min_by("t", F.struct("f", "t")).alias("filed"))
    return keep_written(rules.join(rarest, ["tokens", "verdict"]).select("tokens", "verdict", "confidence", F.col("freq").alias("support"), "filed"), "mined")


def _best(rule: Column) -> Column:
    return F.struct(rule["confidence"].alias("c"), rule["support"].alias("s"), rule["verdict"].alias("v"))


def _looked_up(seen: DataFrame, mined: DataFrame) -> DataFrame:
    """seen with the mined verdict of each row, the rules being one value."""
    files = mined.groupBy("filed").agg(F.collect_list(F.struct("confidence", "support", "verdict", "tokens")).alias("rules"))
    index = files.agg(F.map_from_entries(F.collect_list(F.struct("filed", "rules"))).alias("index"))
    found = seen.withColumn("index", index.scalar())
    hits = F.flatten(F.array_compact(F.transform("tokens", lambda t: F.try_element_at(F.col("index"), t))))
    fits = F.filter(hits, lambda r: F.size(F.array_except(r["tokens"], F.col("tokens"))) == 0)
    return found.withColumn("mined", F.array_max(F.transform(fits, _best))["v"]).drop("index")


def _joined(seen: DataFrame, mined: DataFrame) -> DataFrame:
    """The same for any number of rules."""
    rows = written(seen.withColumn("row", F.monotonically_increasing_id()), "seen")
    asked = rows.filter("fixed is null").select("row", F.col("tokens").alias("own"), F.explode("tokens").alias("filed"))
    hits = asked.join(mined, "filed").filter(F.size(F.array_except("tokens", "own")) == 0)
    best = hits.groupBy("row").agg(F.max(F.struct("confidence", "support", "verdict"))["verdict"].alias("mined"))
    return rows.join(best, "row", "left").drop("row")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, default: str = "allow", max_rules: int = MAX_RULES, **mining) -> DataFrame:
    """Per row of pages: page_id, host, path, rule (the fixed rule, else null), verdict."""
    seen = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = seen.withColumn("fixed", fitting_rule(F.col("host"), F.col("path"), rules))
    seen = seen.withColumn("tokens", F.when(F.col("host") != "", tokens_of(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>")))
    with scratch(pages.sparkSession):
        labelled = seen.filter(F.col("fixed").isNotNull()).select("tokens", F.col("fixed.verdict").alias("verdict"))
        mined = mine(labelled, **mining)
        most = labelled.groupBy("verdict").agg(F.count("*").alias("n")).agg(F.min_by("verdict", F.struct(-F.col("n"), "verdict")).alias("v"))
        judged = _looked_up(seen, mined) if mined.count() <= max_rules else _joined(seen, mined)
        verdict = F.coalesce(F.col("fixed.verdict"), "mined", most.scalar(), F.lit(default))
        return keep_written(judged.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict")), "judged")
