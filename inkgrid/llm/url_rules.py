"""URL filters, native: host and path rules looked up by hashed expressions.

Each distinct (host, start of path) is expanded into host suffixes times path prefixes, only of the sizes that rules have.
Expressions meet rules in an equi-join on the first hexadecimal digits of a SHA-256 digest; the whole digest confirms, and
the longest rule wins (then block over allow, then the smaller text).

Defined results: a null url, or one without "://", has an empty host and path and fits no rule; without a fitting rule `rule`
is null and the verdict is the default; repeated rows each get their verdict; an empty table gives no rows; other columns of
`pages` are not read by `judge` and all kept by `annotate`.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digits of the digest that the join compares.
SHORT = 8
#: A rule table of up to so many rows is broadcast; a larger one is shuffled by the short hash.
SMALL_RULES = 50_000


@dataclass(frozen=True)
class UrlRule:
    """A host without a leading dot, a path prefix beginning with "/" (or empty: any path), allow or block."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (UrlRule("org", "/", "allow"), UrlRule("example.org", "/es/", "block"), UrlRule("example.org", "/en/1", "block"), UrlRule("com", "/fr/", "allow"), UrlRule("com", "/de/", "block"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) columns."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def expressions(host: Column, path: Column, sizes: Iterable[tuple[int, int]]) -> Column:
    """array of host suffix plus path prefix, for each (number of labels, length of path) of the rules."""
    labels = F.split(host, "\\.", -1)
    pairs = [F.when((F.size(labels) >= n) & (F.length(path) >= m), F.concat(F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."), F.substring(path, 1, m))) for n, m in sorted(set(sizes))]
    return F.array_compact(F.array(*pairs)) if pairs else F.array().cast("array<string>")


def _decide(keys: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """Of distinct (_h, _p): those that some rule fits, with its text and verdict."""
    spark = keys.sparkSession
    table = spark.createDataFrame([(r.text, r.verdict) for r in rules], "_rule string, _verdict string").withColumn("_digest", F.sha2("_rule", 256))
    table = table.select(F.substring("_digest", 1, SHORT).alias("_short"), F.col("_digest").alias("_full"), "_rule", "_verdict")
    sizes = {(len(r.host.split(".")), len(r.path)) for r in rules}
    asked = keys.select("_h", "_p", F.explode(expressions(F.col("_h"), F.col("_p"), sizes)).alias("_x")).withColumn("_digest", F.sha2("_x", 256)).withColumn("_short", F.substring("_digest", 1, SHORT))
    hits = asked.join(F.broadcast(table) if len(rules) <= SMALL_RULES else table, "_short").filter(F.col("_digest") == F.col("_full"))
    best = F.max(F.struct(F.length("_rule").alias("n"), (F.col("_verdict") == "block").alias("b"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict")))
    return hits.groupBy("_h", "_p").agg(best.alias("_best")).select("_h", "_p", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("_verdict"))


def annotate(pages: DataFrame, rules: Iterable[UrlRule] = RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages, all columns, with host, path, rule and verdict (same-named columns of pages are replaced).

    Shuffles: distinct keys (map-side combined, only the longest rule path's length of each path), and a join back that AQE
    may broadcast or split where a key is hot.  Rows without a host take no part in the join.
    """
    rules = list(rules)
    for r in rules:
        if "/" in r.host or r.host != r.host.translate(str.maketrans(UPPER, LOWER)) or r.verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {r}")
    longest = max((len(r.path) for r in rules), default=0)
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.struct("*").alias("_row"), host.alias("host"), path.alias("path"))
    key = F.substring("path", 1, longest)
    keys = rows.filter(F.col("host") != "").select(F.col("host").alias("_h"), key.alias("_p")).distinct()
    found = _decide(keys, rules)
    joined = rows.withColumns({"_h0": F.when(F.col("host") != "", F.col("host")), "_p0": key}).join(found, (F.col("_h0") == F.col("_h")) & (F.col("_p0") == F.col("_p")), "left")
    added = ("host", "path", "rule", "verdict")
    kept = [F.col("_row")[c].alias(c) for c in pages.columns if c not in added]
    return joined.withColumn("verdict", F.coalesce("_verdict", F.lit(default))).select(*kept, *added)


def judge(pages: DataFrame, rules: Iterable[UrlRule] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    return annotate(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")), rules, "_url", default).select("page_id", "host", "path", "rule", "verdict")


def judge_sql(rules: Iterable[UrlRule] = RULES, default: str = "allow") -> str:
    """The same over table pages, in DuckDB's SQL."""
    values = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    return f"""
    WITH rules(h, p, v) AS (VALUES {values}),
    rest AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
    hosts AS (SELECT page_id, k, r, regexp_extract(r, '^[^/?#]*', 0) AS h0 FROM rest),
    parts AS (SELECT page_id, k, translate(h0, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(r, length(h0) + 1), '^[^?#]*', 0) AS path FROM hosts),
    hits AS (SELECT k, h || p AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, v DESC, h || p DESC) AS n
      FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
    SELECT page_id, host, path, rule, coalesce(v, '{default}') AS verdict FROM parts LEFT JOIN (SELECT * FROM hits WHERE n = 1) USING (k)
    """
