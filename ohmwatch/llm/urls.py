"""URL filter: allow and block rules by host and path; for the rest, trust and distrust propagated over host links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ohmwatch.llm.common import store, table

# The rules of the query: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ROUNDS, DAMPING = 8, 0.85
#: A host is blocked when its distrust exceeds its trust by more than this factor.
FACTOR = 1.000001
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "://([^/?#]*)([^?#]*)"
_LINK = "(?:href|src)=[\"'](?:https?:)?//([^/?#\"' >]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def matched(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of the longest rule that fits each distinct (host, path); block wins a tie.

    ``rules`` has verdict, host and path.  Hosts meet rules by each domain above them, so any number of rules is
    one join; Spark broadcasts them only if they are small.
    """
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict"))
    above = places.select("host", "path", F.explode(_suffixes(F.col("host"))).alias("above"))
    fits = above.join(rules, (F.col("above") == F.col("rule_host")) & F.startswith("path", "rule_path"))
    rule = F.concat("rule_host", "rule_path")
    best = F.max_by(F.struct(rule.alias("rule"), F.col("verdict").alias("verdict")), F.struct(F.length(rule), F.col("verdict") == "block"))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, out, in: distinct links between different hosts, with how many leave src and enter dst.

    Absolute links in the pages' HTML count, and each host is linked with the domain above it, both ways, down
    to two labels: a site's hosts vouch for one another even where pages hold relative links only.
    """
    named = pages.select(host_of(F.col("url")).alias("src"), "html")
    found = named.select("src", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
    found = found.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).distinct()
    hosts = named.select(F.col("src").alias("host")).distinct().unionByName(found.select(F.col("dst").alias("host")))
    domains = hosts.select(F.explode(_suffixes(F.col("host"))).alias("src")).filter("src LIKE '%.%.%'").distinct()
    up = domains.select("src", F.regexp_replace("src", r"^[^.]*\.", "").alias("dst"))
    links = found.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = store(links.filter("src <> '' AND dst <> '' AND src <> dst").distinct(), "hosts")
    out, into = links.groupBy("src").agg(F.count("*").alias("out")), links.groupBy("dst").agg(F.count("*").alias("in"))
    return store(links.join(out, "src").join(into, "dst").select("src", "dst", "out", "in"), "links")


def propagate(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust after ``rounds`` rounds of personalised PageRank.

    ``seeds`` has host, good and bad, the shares of the two restart vectors.  Trust flows along links, split over
    those that leave a host; distrust flows against them, split over those that enter it.  Each round is one
    aggregation over the links; every fourth is written, so that a lost executor costs at most four.
    """
    start = seeds.select("host", (F.col("good") * (1 - damping)).alias("trust"), (F.col("bad") * (1 - damping)).alias("distrust"))
    rank = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    zero = F.lit(0.0)
    for number in range(1, rounds + 1):
        forth = links.join(rank, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (damping * F.col("trust") / F.col("out")).alias("trust"), zero.alias("distrust"))
        back = links.join(rank, F.col("dst") == F.col("host")).select(F.col("src").alias("host"), zero.alias("trust"), (damping * F.col("distrust") / F.col("in")).alias("distrust"))
        rank = start.unionByName(forth).unionByName(back).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if number % 4 == 0 or number == rounds:
            rank = store(rank, "rank")
    return rank


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row of ``pages`` (page_id, url, html).

    A host is a trusted seed when rules allow more than half of its pages, a blocked seed when they block more than
    half; seeds restart in proportion to those pages.  Pages that no rule fits are blocked when their host's
    distrust is above its trust; hosts that neither reaches are allowed.  Null urls and urls without "://" have
    an empty host and path and are allowed.  Null html has no links.  Repeated rows are judged each.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    places = store(named.groupBy("host", "path").agg(F.count("*").alias("n")), "places")
    ruled = store(matched(places, rules), "ruled")
    by_host = places.join(ruled, ["host", "path"], "left").groupBy("host").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("allowed"),
        F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("blocked"),
    )
    seeds = by_host.select(
        "host", F.when(F.col("allowed") * 2 > F.col("n"), F.col("allowed")).otherwise(0).alias("good"), F.when(F.col("blocked") * 2 > F.col("n"), F.col("blocked")).otherwise(0).alias("bad")
    ).filter("good + bad > 0")
    totals = seeds.agg(F.greatest(F.sum("good"), F.lit(1)).alias("all_good"), F.greatest(F.sum("bad"), F.lit(1)).alias("all_bad")).first()
    seeds = store(seeds.select("host", (F.col("good") / (totals[0] or 1)).alias("good"), (F.col("bad") / (totals[1] or 1)).alias("bad")), "seeds")
    rank = propagate(seeds, host_links(pages))
    bad = rank.filter(F.col("distrust") > F.col("trust") * FACTOR).select(F.col("host").alias("bad_host"))
    side = ruled.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "rule", F.col("verdict").alias("_verdict"))
    joined = named.join(side, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").join(bad, F.col("host") == F.col("bad_host"), "left")
    method = F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("_verdict", method).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judged(table(spark, sf_dir, "pages"), rules)


def sql() -> str:
    """The same in DuckDB, one step per round."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    link = _LINK.replace("'", "''")
    steps = []
    for n in range(1, ROUNDS + 1):
        steps.append(f"""r{n} AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
  SELECT host, good * {1 - DAMPING!r} AS trust, bad * {1 - DAMPING!r} AS distrust FROM seeds UNION ALL
  SELECT dst, {DAMPING} * trust / n_out, 0 FROM w JOIN r{n - 1} ON src = host UNION ALL
  SELECT src, 0, {DAMPING} * distrust / n_in FROM w JOIN r{n - 1} ON dst = host) GROUP BY host)""")
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    return f"""
WITH named AS (SELECT page_id, {lower(f"coalesce(regexp_extract(url, '{_URL}', 1), '')")} AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path, html FROM pages),
rules(verdict, rh, rp) AS (VALUES {rules}),
places AS (SELECT host, path, count(*) AS n FROM named GROUP BY host, path),
fits AS (SELECT host, path, rh || rp AS rule, verdict FROM places JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
ruled AS (SELECT host, path, rule, verdict FROM fits QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, verdict DESC) = 1),
by_host AS (SELECT host, sum(n) AS n, coalesce(sum(n) FILTER (verdict = 'allow'), 0) AS allowed, coalesce(sum(n) FILTER (verdict = 'block'), 0) AS blocked
  FROM places LEFT JOIN ruled USING (host, path) GROUP BY host),
marked AS (SELECT host, CASE WHEN allowed * 2 > n THEN allowed ELSE 0 END AS good, CASE WHEN blocked * 2 > n THEN blocked ELSE 0 END AS bad FROM by_host),
seeds AS (SELECT host, good / greatest((SELECT sum(good) FROM marked), 1) AS good, bad / greatest((SELECT sum(bad) FROM marked), 1) AS bad FROM marked WHERE good + bad > 0),
found AS (SELECT DISTINCT host AS src, {lower("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM named),
hosts AS (SELECT host FROM named UNION SELECT dst FROM found),
parts AS (SELECT DISTINCT string_split(host, '.') AS labels FROM hosts),
cut AS (SELECT labels, unnest(range(1, len(labels) + 1)) AS i FROM parts),
domains AS (SELECT DISTINCT array_to_string(labels[i:], '.') AS src FROM cut WHERE len(labels) - i >= 2),
up AS (SELECT src, regexp_replace(src, '^[^.]*\\.', '') AS dst FROM domains),
links AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM found UNION ALL SELECT src, dst FROM up UNION ALL SELECT dst, src FROM up) WHERE src <> '' AND dst <> '' AND src <> dst),
w AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n_out, count(*) OVER (PARTITION BY dst) AS n_in FROM links),
r0 AS (SELECT host, good AS trust, bad AS distrust FROM seeds),
{", ".join(steps)},
bad AS (SELECT host FROM r{ROUNDS} WHERE distrust > trust * {FACTOR})
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN ruled USING (host, path)
"""


OP9_SQL = sql()
