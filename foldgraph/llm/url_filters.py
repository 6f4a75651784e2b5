"""URL filters: host-suffix and path-prefix expressions joined to hashed rules."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Hex digits of the short prefix that the join is on (four bytes).
PREFIX = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no ``://`` or no url."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a rule table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def hashed_rules(rules: DataFrame) -> DataFrame:
    """Rules with digests, one per expression: where verdicts differ for the same one, block stands.

    Rules with a null in any column, or with an empty host, fit nothing.
    """
    host = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    whole = rules.where("verdict is not null and host <> '' and path is not null").select(
        host.alias("rule_host"), F.col("path").alias("rule_path"), F.concat(host, "path").alias("rule"),
        (F.col("verdict") == "block").cast("int").alias("block"),
    )
    one = whole.groupBy("rule", "rule_host", "rule_path").agg(F.max("block").alias("block"))
    # Host and path are kept apart by a character that no host holds.
    digest = F.sha2(F.concat_ws("/", "rule_host", "rule_path"), 256)
    return one.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, PREFIX))


def host_suffixes(host: Column, labels: list[int]) -> Column:
    """The ends of a host that have one of these numbers of labels, the whole host included."""
    n = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return F.array_compact(F.array(*[F.when(n >= k, F.substring_index(host, ".", -k)) for k in sorted(labels)]).cast("array<string>"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", *, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, the longest rule that fits, verdict.

    Each url is expanded into the ends of its host that have as many labels as
    some rule's times the prefixes of its path whose length some rule has, so
    a very long host or path makes no more of them; the expressions meet the rules on the first
    eight hex digits of their SHA-256 and are confirmed by all of them. The
    longest expression wins, at equal length the longer host, then block. Where
    no rule fits, the rule is null and the verdict is ``default``.

    The lengths of rule paths and the label counts of rule hosts are gathered first; they are at
    most as many as the longest rule has characters. Rules are joined by a
    plain equi-join: Spark broadcasts them only below its size threshold, else
    both sides are shuffled by prefix and adaptive execution splits hot ones.

    Null or ``://``-less urls have an empty host and path and fit no rule. An
    empty table gives no rows, an empty rule table the default everywhere.
    Rows repeated whole give as many equal rows: (key, url) is judged once and
    its count expanded again. Other columns, of any name, are not read.
    """
    hashed = hashed_rules(rules)
    lengths, labels = hashed.agg(F.collect_set(F.length("rule_path")), F.collect_set(F.size(F.split("rule_host", r"\.")))).first()
    host, path = url_parts(F.col("_url"))
    judged = (
        pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
        .groupBy("_key", "_url").agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("host", host).withColumn("path", path)
    )
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(F.col("_hosts"), lambda h: F.transform(F.col("_paths"), lambda p: F.sha2(F.concat_ws("/", h, p), 256))))
    expanded = (
        judged.withColumn("_hosts", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(host_suffixes(F.col("host"), labels)))
        .withColumn("_paths", prefixes)
        .select("_key", "_url", "_copies", "host", "path", F.explode_outer(expressions).alias("_digest"))
        .withColumn("_short", F.substring("_digest", 1, PREFIX))
    )
    fits = (F.col("_short") == F.col("short")) & (F.col("_digest") == F.col("digest"))
    met = expanded.join(hashed, fits, "left")
    order = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "block", "rule")
    best = met.groupBy("_key", "_url", "host", "path", "_copies").agg(F.max(F.when(F.col("rule").isNotNull(), order)).alias("_best"))
    return (
        best.select(
            F.col("_key").alias(key), "host", "path", F.col("_best.rule").alias("rule"),
            F.when(F.col("_best").isNull(), F.lit(default)).when(F.col("_best.block") == 1, "block").otherwise("allow").alias("verdict"),
            F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"),
        )
        .drop("_copy")
    )
