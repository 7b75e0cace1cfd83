"""URL filters: host-suffix and path-prefix expressions, equi-joined on short hash prefixes.

A rule (host, path) fits a URL whose host is the rule's or a subdomain of it and whose path starts
with the rule's. Every different URL is expanded into the (host suffix, path prefix) expressions that some rule could
have: for each number of host labels and path length among the rules. Expressions meet rules on the
first 32 bits of their SHA-256; the full digest then confirms, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of the join key.
PREFIX = 8
#: Rules broadcast at most, some 150 bytes each; beyond it the join shuffles.
MAX_BROADCAST = 200_000
#: The rules of the query, host and path with verdict, and the method's own block list beneath them.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
SPAM = [(f"{name}.example.{top}", "", "block") for name in ("casino-win", "free-bets", "cheap-pills") for top in ("com", "net", "org")]


def host(url: Column) -> Column:
    """From after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ascii_lower(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bare_host(host: Column) -> Column:
    """A host without user, port and the dots at its end."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.*(:[0-9]*)?$", "")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]], tier: int = 0, bare: bool = False) -> DataFrame:
    """Rules as rows (host, path, verdict, tier, bare); a lower tier is asked first; a bare rule looks at bare_host()."""
    return spark.createDataFrame([(*r, tier, bare) for r in rules], "host string, path string, verdict string, tier int, bare boolean")


def _digest(h: Column, p: Column) -> Column:
    return F.sha2(F.concat(h, p), 256)


def _expressions(host: Column, path: Column, shapes: list[int], mark: str) -> Column:
    """Digests of the (host suffix, path prefix) expressions of the given shapes, labels << 32 | characters, that a URL has.

    Shapes are data, not parts of the plan; a URL has no more of them than it has suffixes times prefixes.
    """
    if not shapes:
        return F.array().cast("array<string>")
    parts, size = F.split(host, r"\."), F.length(path)
    n = F.size(parts)
    known = F.split(F.lit(",".join(map(str, sorted(shapes)))), ",").cast("array<bigint>")
    labels, chars = (lambda s: F.shiftright(s, 32).cast("int")), (lambda s: s.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    fitting = F.filter(known, lambda s: (labels(s) <= n) & (chars(s) <= size))
    suffix = lambda s: F.array_join(F.slice(parts, n - labels(s) + 1, labels(s)), ".")
    return F.transform(fitting, lambda s: _digest(F.concat(F.lit(mark), suffix(s)), F.substring(path, F.lit(1), chars(s))))


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """`urls` (column url) with host, path, tier, rule and verdict; rule null and verdict `default` where none fits.

    The longest rule of the lowest tier wins; of equally long rules the one with the longer host, then block.
    Null urls and urls without `://` have an empty host, which no rule fits. Rows stay as they are, repeated ones too;
    the columns it adds replace columns of the same name, all others stay. Rules with a null are left out; no rules leave
    all URLs to the default; an empty table stays empty. Each different host and path is judged once.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").select("host", "path", "verdict", "tier", "bare").distinct()
    shape = F.shiftleft(F.size(F.split("host", r"\.")).cast("long"), 32) + F.length("path")
    shapes: dict[bool, list[int]] = {False: [], True: []}
    for r in rules.select("bare", shape.alias("shape")).distinct().collect():
        shapes[r["bare"]].append(r["shape"])
    mark = F.when(F.col("bare"), F.lit("~")).otherwise(F.lit(""))
    keyed = rules.select(
        _digest(F.concat(mark, "host"), F.col("path")).alias("full"),
        F.struct((-F.col("tier")).alias("tier"), (F.length("host") + F.length("path")).alias("chars"), F.length("host").alias("host_chars"), F.col("verdict").alias("verdict"), F.concat("host", "path").alias("rule")).alias("r"),
    ).withColumn("prefix", F.substring("full", 1, PREFIX))
    small = rules.count() <= MAX_BROADCAST

    url = F.col("url").cast("string")
    parsed = urls.drop("host", "path", "tier", "rule", "verdict").withColumn("host", host(url)).withColumn("path", path(url))
    different = parsed.where(F.col("host") != "").select("host", "path").distinct()
    digests = F.concat(_expressions(F.col("host"), F.col("path"), shapes[False], ""), _expressions(bare_host(F.col("host")), F.col("path"), shapes[True], "~"))
    asked = different.select("host", "path", F.explode(digests).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX))
    hits = asked.join(F.broadcast(keyed) if small else keyed, "prefix").where("digest = full").groupBy("host", "path").agg(F.max("r").alias("_ev_hit"))
    out = parsed.join(hits, ["host", "path"], "left")
    columns = [F.col(f"`{c}`") for c in parsed.columns]
    return out.select(*columns, F.col("_ev_hit.rule").alias("rule"), F.coalesce("_ev_hit.verdict", F.lit(default)).alias("verdict"), (-F.col("_ev_hit.tier")).alias("tier"))


def op5(pages: DataFrame, blocked: list[tuple[str, str, str]] = SPAM) -> DataFrame:
    """page_id, host, path, rule, verdict and method_rule, the entry of the `blocked` list that decides where no rule fits.

    Nulls, ties, repeated rows, other columns and empty tables are treated as judge() says.
    """
    spark = pages.sparkSession
    rules = rule_table(spark, RULES).unionByName(rule_table(spark, blocked, 1, True))
    judged = judge(pages.select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", F.when(F.col("tier") == 0, F.col("rule")).alias("rule"), "verdict", F.when(F.col("tier") == 1, F.col("rule")).alias("method_rule"))


def sql() -> str:
    values = lambda rules, tier: [f"('{h}', '{p}', '{v}', {tier})" for h, p, v in rules]
    return rf"""
    with rules(h, p, v, tier) as (values {", ".join(values(RULES, 0) + values(SPAM, 1))}),
    parsed as (select row_number() over () as r, page_id,
                 translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
    asked as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), '\.*(:[0-9]*)?$', '') as bare from parsed),
    hits as (select r, arg_max({{'rule': h || p, 'v': v, 'tier': tier}}, -tier * 100000 + length(h) + length(p)) as hit
             from asked join rules on (case when tier = 1 then bare else host end = h or ends_with(case when tier = 1 then bare else host end, '.' || h)) and starts_with(path, p) group by r)
    select page_id, host, path, case when hit.tier = 0 then hit.rule end as rule, coalesce(hit.v, 'allow') as verdict, case when hit.tier = 1 then hit.rule end as method_rule
    from parsed left join hits using (r)"""
