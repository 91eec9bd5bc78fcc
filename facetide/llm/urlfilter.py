"""URL filters: explicit rules first, then a path-template tree per host. DataFrame functions only.

A template is a host's path with every run of digits as ``#``. Level by level, as deep as paths go, segments that vary become ``*``: where a prefix has more than ``BRANCHES`` different next segments, those that hold
less than 1 / ``BRANCHES`` of its pages. Templates that differ in their last segment only are branches of one parent. A
branch whose share of bad labelled pages does not differ from that of its siblings by more than ``Z`` standard errors is
merged with the other such siblings; one that does stands alone. Purity is the share of good labelled pages, smoothed by ``SMOOTHING``
pages of the host's purity, and that by as many of the purity of all; a template of purity below ``LEAST_PURITY`` is blocked.

The pages are only aggregated (partial sums before every shuffle) and joined with the far smaller table of templates; how, is
left to Spark's size check and its splitting of skewed joins, so one host or template may hold any share.

Defined cases: a null url or one without ``://`` has an empty host and path and is a template of its own; a host or path
without labelled page takes the smoothed purity; without any label everything not ruled is allowed; equal urls
count each; null ids of pages are kept; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

LEVELS = 3  # of the SQL in oracles.py; the tree here has as many as the paths
BRANCHES = 50
Z = 1.96
SMOOTHING = 20
LEAST_PURITY = 0.5

# The verdict of each rule (host and its subdomains, beginning of the path).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def parsed(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])):  # later ones go before
        name, slash, begin = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + begin)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _tree(templates: DataFrame) -> DataFrame:
    """``host``, ``lexical`` (digits as #), ``template`` (varying segments as ``*``), ``parent``, and the counts."""
    rows = templates.withColumns({"segments": F.split("lexical", "/"), "prefix": F.lit("")})
    level = 0
    while True:
        level += 1
        here = F.get("segments", F.lit(level))
        children = rows.where(here.isNotNull()).groupBy("host", "prefix", here.alias("segment")).agg(F.sum("pages").alias("in_child"))
        parents = children.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("kinds"), F.sum("in_child").alias("in_all"))
        varying = children.join(parents.where(F.col("kinds") > BRANCHES), ["host", "prefix"])
        varying = varying.where(F.col("in_child") * BRANCHES < F.col("in_all")).select("host", "prefix", "segment", F.lit(True).alias("varies"))
        rows = rows.withColumn("segment", here).join(varying, ["host", "prefix", "segment"], "left")
        segment = F.when(F.col("varies"), F.lit("*")).otherwise(F.col("segment"))
        rows = rows.withColumn("prefix", F.when(F.col("segment").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), segment))).drop("segment", "varies")
        rows = stored(rows, "level")
        # a segment varies only below a prefix of more than BRANCHES templates that go on
        if rows.where(F.size("segments") > level + 1).groupBy("host", "prefix").count().where(F.col("count") > BRANCHES).isEmpty():
            break
    rest = F.expr(f"array_join(slice(segments, {level + 2}, greatest(size(segments) - {level + 1}, 0)), '/')")
    template = F.when(F.size("segments") > level + 1, F.concat("prefix", F.lit("/"), rest)).otherwise(F.col("prefix"))
    return rows.withColumn("template", template).withColumn("parent", F.regexp_replace("template", "/[^/]*$", "")).drop("segments", "prefix")


def judged(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict`` and ``template`` of every page.

    ``labels`` has ``id`` and ``bad`` (boolean) of some pages.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = parsed(F.col("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict, "lexical": F.regexp_replace("path", "[0-9]+", "#")})

    known = labels.where("id IS NOT NULL AND bad IS NOT NULL").groupBy("id").agg(F.bool_or("bad").alias("bad"))
    counted = rows.select("id", "host", "lexical").join(known, "id", "left").groupBy("host", "lexical")
    counted = counted.agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.count_if("bad").alias("b"))
    tree = stored(_tree(stored(counted, "templates")), "tree")  # each is read several times

    totals = lambda by, n, b: tree.groupBy(*by).agg(F.sum("n").alias(n), F.sum("b").alias(b))
    branches = totals(["host", "parent", "template"], "n", "b").join(totals(["host", "parent"], "n_all", "b_all"), ["host", "parent"])
    m, others = F.col("n_all") - F.col("n"), F.col("b_all") - F.col("b")
    pooled = F.try_divide(F.col("b_all"), F.col("n_all"))
    apart = F.abs(F.try_divide(F.col("b"), F.col("n")) - F.try_divide(others, m))
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.lit(1.0), m)))
    alone = F.coalesce(apart > Z * error, F.lit(False))
    branches = branches.withColumn("branch", F.when(alone, F.col("template")).otherwise(F.lit("")))
    merged = branches.groupBy("host", "parent", "branch").agg(F.sum("n").alias("n_m"), F.sum("b").alias("b_m"))
    hosts = totals(["host"], "n_h", "b_h")
    every = tree.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()

    purity_all = F.lit((every.n - every.b) / every.n if every.n else 1.0)
    purity_host = (F.col("n_h") - F.col("b_h") + SMOOTHING * purity_all) / (F.col("n_h") + SMOOTHING)
    purity = (F.col("n_m") - F.col("b_m") + SMOOTHING * purity_host) / (F.col("n_m") + SMOOTHING)
    found = branches.select("host", "parent", "template", "branch").join(merged, ["host", "parent", "branch"]).join(hosts, "host")
    found = found.select("host", "template", F.when(purity < LEAST_PURITY, "block").otherwise("allow").alias("learned"))
    named = tree.select("host", "lexical", "template").join(found, ["host", "template"])
    out = rows.join(named, ["host", "lexical"], "left")
    return out.select("id", "host", "path", "rule", F.coalesce("said", "learned").alias("verdict"), "template")


def document_labels(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id`` and ``bad`` of pages whose path ends with the number of a labelled document: bad if of low quality or toxic."""
    _, path = parsed(F.col("url"))
    number = F.expr("try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1), '') AS bigint)")
    numbered = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumn("path", path).select("id", number.alias("doc_id"))
    bad = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return numbered.join(bad, "doc_id").select("id", "bad")
