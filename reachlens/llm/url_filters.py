"""URL filters: host-suffix and path-prefix expressions joined to a rule table by digest.

A rule is (host, path, verdict). It fits its host and all subdomains where the URL's path
starts with the rule's path; the longest rule that fits decides. Each URL is expanded into
the (host suffix, path prefix) expressions a rule could be equal to: only for the pairs of
label count and path length that occur among the rules, so a URL has at most as many
expressions as the rules have shapes. Expressions meet rules in an equi-join on the first
four bytes of a SHA-256 digest; the whole digest is compared after that. The join is left
to Spark: a small rule table is broadcast after its size check, a large one is shuffled and
crowded expressions are split by the skew join.

Defined results: a null URL or one without ``://`` has an empty host and path, which no rule
fits; of equally long rules the one with the longer host decides, then ``block``; a rule
with a null part fits nothing; repeated rows and ids are judged row by row; an empty rule
table gives every URL the default; columns besides id and URL are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_LABELS = "size(split({0}, '[.]'))"


def _lowered(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def host_and_path(url: str) -> tuple[str, str]:
    """SQL for the host (A-Z lower-cased) and the path of a URL."""
    has = f"coalesce(locate('://', {url}), 0) > 0"
    rest = f"substring({url}, locate('://', {url}) + 3)"
    host = _lowered(f"regexp_extract({rest}, r'\\A([^/?#]*)', 1)")
    path = f"regexp_extract({rest}, r'\\A[^/?#]*([^?#]*)', 1)"
    return f"CASE WHEN {has} THEN {host} ELSE '' END", f"CASE WHEN {has} THEN {path} ELSE '' END"


def _keyed(df: DataFrame, expression: str) -> DataFrame:
    """With the whole digest of an expression and its short prefix."""
    return df.withColumn("digest", F.unhex(F.sha2(F.expr(expression), 256))).withColumn(
        "short", F.substring("digest", 1, 4)
    )


def prepared_rules(rules: DataFrame) -> DataFrame:
    """``host, path, verdict`` with digests; one row per expression, ``block`` before ``allow``."""
    one = (
        rules.filter("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(F.expr(_lowered("host")).alias("host"), "path").agg(F.max("verdict").alias("rule_verdict"))
    )
    return _keyed(one, "concat(host, '\\n', path)").selectExpr(
        "short AS rule_short", "digest AS rule_digest", "rule_verdict", "concat(host, path) AS rule",
        "length(host) AS host_length", f"{_LABELS.format('host')} AS labels", "length(path) AS path_length",
    )


def filtered(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per page: id, host, path, the deciding rule (or null) and the verdict.

    ``verdict`` of a rule is ``allow`` or ``block``; ``default`` holds where no rule fits.
    """
    host, path = host_and_path("url")
    urls = (
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
        .select("page_id", F.expr(host).alias("host"), F.expr(path).alias("path"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    rules = prepared_rules(rules)
    # The distinct label counts and path lengths of the rules: bounded by what a URL can have.
    shapes = rules.select("labels", "path_length").distinct().collect()
    listed = ", ".join(f"struct({n} AS labels, {size} AS path_length)" for n, size in shapes)
    fitting = f"filter(array({listed}), s -> host <> '' AND s.labels <= {_LABELS.format('host')} AND s.path_length <= length(path))"
    expressions = (
        urls.withColumn("shape", F.expr(f"explode_outer({fitting})" if shapes else "CAST(NULL AS STRUCT<labels: INT, path_length: INT>)"))
        .withColumn("expression", F.expr("concat(substring_index(host, '.', -shape.labels), '\n', left(path, shape.path_length))"))
    )
    met = _keyed(expressions, "expression").join(
        rules.drop("labels", "path_length"),
        (F.col("short") == F.col("rule_short")) & (F.col("digest") == F.col("rule_digest")), "left",
    )
    best = met.groupBy("row", "page_id", "host", "path").agg(
        F.max(F.expr("CASE WHEN rule IS NOT NULL THEN struct(length(rule) AS n, host_length, rule_verdict, rule) END")).alias("best")
    )
    return best.selectExpr(
        "page_id", "host", "path", "best.rule AS rule", f"coalesce(best.rule_verdict, '{default}') AS verdict"
    )
