"""URL filters: host-suffix and path-prefix expressions matched by short hash prefixes, native SQL only.

A rule is (host, path, action). It fits the host itself and every subdomain, if the url's path starts with the
rule's path. Each url is expanded into the (host suffix, path prefix) expressions whose label count and path length
occur in the rules, so the expansion is bounded by the rules' shape and not by the url's length. Expressions meet the
rules in an equi-join on the first 32 bits of their SHA-256; full digests confirm; the longest rule wins, and for
one expression listed twice ``block`` wins.

Defined results: null url or one without ``://``: empty host and path, no rule, the default verdict. Empty input: no rows.
Repeated rows are all returned. Columns of the input keep their values; those named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "host string, path string, action string"
_PREFIX = 8  # hex digits of the digest that the join uses

#: The contract's rules.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str) -> tuple:
    """Columns (host, path) of a url column."""
    u = f"coalesce({url}, '')"
    at = f"instr({u}, '://')"
    rest = f"CASE WHEN {at} > 0 THEN substring({u}, {at} + 3) ELSE '' END"
    host = F.expr(f"regexp_extract({rest}, '^[^/?#]*', 0)")
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.expr(f"substring({rest}, length(regexp_extract({rest}, '^[^/?#]*', 0)) + 1)"), "^[^?#]*", 0)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict. ``rules``: frame of host, path, action (allow or block).

    Only the distinct label counts and path lengths of the rules come to the driver (a few small integers). The
    rules side of the join is left to the planner, which broadcasts it only under its size threshold.
    """
    rules = rules.select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    rules = rules.where("host <> '' AND (path = '' OR path LIKE '/%')")
    shape = rules.agg(F.collect_set(F.size(F.split("host", "\\."))).alias("k"), F.collect_set(F.length("path")).alias("p")).first()
    counts, lengths = (",".join(f"{x}" for x in sorted(v)) for v in (shape["k"], shape["p"]))
    r = rules.select(F.concat("host", "path").alias("rule"), "action").groupBy("rule").agg(F.max("action").alias("action"))  # block > allow
    r = r.select("rule", "action", F.sha2("rule", 256).alias("_rd"), F.substring(F.sha2("rule", 256), 1, _PREFIX).alias("_rp"))

    host, path = split_url(f"`{url}`")
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    base = df.select(*kept, host.alias("host"), path.alias("path")).withColumn("_uid", F.monotonically_increasing_id())
    if not counts:
        return base.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    expanded = base.withColumn("_labels", F.split("host", "\\.")).withColumn(
        "_expr",
        F.expr(f"""flatten(transform(
            transform(filter(array({counts}), k -> k <= size(_labels)), k -> array_join(slice(_labels, size(_labels) - k + 1, k), '.')),
            h -> transform(filter(array({lengths}), p -> p <= length(path)), p -> concat(h, substring(path, 1, p)))))"""),
    ).drop("_labels")
    digested = expanded.withColumn("_d", F.explode_outer(F.expr("transform(_expr, e -> sha2(e, 256))"))).drop("_expr")
    hit = digested.withColumn("_p", F.substring("_d", 1, _PREFIX)).join(r, F.expr("_p = _rp AND _d = _rd"), "left")
    best = hit.groupBy("_uid").agg(
        F.first(F.struct(*[F.col(f"`{c}`") for c in kept], "host", "path")).alias("_row"),
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "action", "rule"))).alias("_best"),
    )
    return best.select("_row.*", F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH r(host, path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
a AS (SELECT page_id, row_number() OVER () AS uid, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, uid, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT page_id, uid, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
m AS (SELECT c.uid, r.host || r.path AS rule, r.action, row_number() OVER (PARTITION BY c.uid ORDER BY length(r.host || r.path) DESC, r.action DESC) AS k
      FROM c JOIN r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.action, 'allow') AS verdict FROM c LEFT JOIN m ON c.uid = m.uid AND m.k = 1
"""
