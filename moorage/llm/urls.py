"""URL verdicts from host-suffix and path-prefix rules, by hashed expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Hex digits of a digest that rows are joined on before whole digests are compared.
PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _whole_numbers(rules: DataFrame, value: Column) -> list[int]:
    """Distinct label counts or path lengths of rules: bounded by what a URL can have."""
    return sorted(r[0] for r in rules.select(value).distinct().collect() if r[0] is not None)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """(key, host, path, rule, verdict), one row per page row.

    ``rules`` has (host, path, verdict). A rule fits its host and all subdomains if the
    page's path starts with the rule's path. The longest rule (host and path together)
    wins, then the one with the longer host, then ``block`` over ``allow``.

    Every URL is expanded into host suffixes joined with path prefixes, of the label
    counts and path lengths that rules have at all. Expressions meet rules by the first
    digits of their SHA-256, and whole digests confirm. Without a rule the verdict is
    ``default`` and ``rule`` NULL. NULL URLs and those without ``://`` have an empty host and
    path. Repeated rows stay repeated; rules with a NULL are ignored; an empty table gives no
    rows; further columns are left out.
    """
    rules = (
        rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
        .dropna()
        .where("rule_host <> ''")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("verdict"))
    )
    labels = _whole_numbers(rules, F.size(F.split("rule_host", r"\.")))
    lengths = _whole_numbers(rules, F.length("rule_path"))
    listed = rules.select(
        F.sha2(F.concat("rule_host", "rule_path"), 256).alias("rule_digest"),
        F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("size"),
            F.length("rule_host").alias("host_size"),
            F.col("verdict"),
            F.concat("rule_host", "rule_path").alias("rule"),
        ).alias("found"),
    )
    # One row per prefix, so that the join never repeats an expression.
    listed = listed.groupBy(F.substring("rule_digest", 1, PREFIX_DIGITS).alias("rule_prefix")).agg(
        F.map_from_entries(F.collect_list(F.struct("rule_digest", "found"))).alias("rules")
    )

    host, path = host_and_path(F.col(url))
    whole = lambda values: F.array(*map(F.lit, values)).cast("array<int>")
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(whole(labels), lambda n: n <= F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(whole(lengths), lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n)
    )
    expressions = F.flatten(
        F.transform(suffixes, lambda suffix: F.transform(prefixes, lambda prefix: F.concat(suffix, prefix)))
    )
    expanded = (
        pages.select(F.col(key), host.alias("host"), path.alias("path"))
        .select("*", F.posexplode_outer(expressions).alias("place", "expression"))
        .select(
            key,
            "host",
            "path",
            # One expression of a row stands for the row, so that equal rows can be counted.
            F.coalesce((F.col("place") == 0).cast("int"), F.lit(1)).alias("row"),
            F.sha2(F.col("expression"), 256).alias("digest"),
        )
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    met = expanded.join(listed, F.col("prefix") == F.col("rule_prefix"), "left")
    confirmed = F.element_at("rules", F.col("digest"))
    judged = met.groupBy(key, "host", "path").agg(
        F.sum("row").alias("rows"), F.max(confirmed).alias("found")
    )
    return judged.select(
        key,
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_copy"),
    ).drop("_copy")
