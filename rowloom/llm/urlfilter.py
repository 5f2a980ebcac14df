"""URL filters: curated rules first, and an empirical-Bayes host reputation for what no rule decides.

Labelled outcomes of pages (1: to block, 0: to allow) are counted per host. Beta-binomial priors pass down a tree: the
rate of all labelled pages is the prior mean of a suffix, the posterior mean of the suffix that of a registered domain,
and that of the domain the prior mean of the host. Each level's prior strength is the method-of-moments estimate from the
spread of its groups around their parents. A host is blocked where the lower posterior bound of its rate passes a
threshold. DataFrame functions only; every shuffle of pages is pre-aggregated by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import cut, let

#: (host, path prefix, verdict); a rule fits its host and all subdomains.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Share of the posterior below the bound, and the block rate that the bound must pass.
TAIL, THRESHOLD = 0.05, 0.5
#: The posterior's log odds are summed at 2 * REACH + 1 places, STEP deviations apart.
REACH, STEP = 90, 0.1
#: Bounds of the estimated prior strengths, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 0.5, 1000.0
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty without :// or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host to the next ? or #; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


# Second-level labels under which two-letter suffixes register domains, and what looks like an address.
_SHARED = r"(^|\.)(ac|co|com|edu|go|gob|gov|ne|net|or|org)\.[a-z]{2}$"
_ADDRESS = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$"


def bare_host(host: Column) -> Column:
    """Without a user before @, a port, or a dot at the end."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")


def host_suffix(host: Column) -> Column:
    """The last label, or the last two where domains register under both; all numeric addresses share one."""
    name = bare_host(host)
    return F.when(name.rlike(_ADDRESS), "address").when(name.rlike(_SHARED), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def registered_domain(host: Column) -> Column:
    """The suffix and the label before it; a suffix alone and an address are their own domains."""
    name = bare_host(host)
    return F.when(name.rlike(_ADDRESS), name).when(name.rlike(_SHARED), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def beta_quantile(a: Column, b: Column, p: float) -> Column:
    """The p-quantile of a beta law: its log odds have density proportional to t^a (1 - t)^b, summed by trapezoids around the
    mode in steps of their deviation, and interpolated where the sum passes p."""
    deviation = F.sqrt(1 / a + 1 / b + 1 / (a * a) + 1 / (b * b))
    odds = lambda u: F.log(a / b) + deviation * (u * STEP)
    top = a * F.log(a / (a + b)) + b * F.log(b / (a + b))

    def weight(u: Column) -> Column:
        return let(odds(u), lambda z: F.exp(a * (-F.greatest(-z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))) + b * (-F.greatest(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))) - top))

    places = F.sequence(F.lit(-REACH), F.lit(REACH))

    def find(w: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.lit(2 * REACH)), lambda i: (F.get(w, i - 1) + F.get(w, i)) / 2)
        target = p * F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)

        def step(s: Column, x: Column) -> Column:
            passed = s["at"].isNull() & (s["sum"] + x >= target)
            return F.struct((s["sum"] + x).alias("sum"), (s["i"] + 1).alias("i"), F.when(passed, s["i"] + (target - s["sum"]) / x).otherwise(s["at"]).alias("at"))

        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("i"), F.lit(None).cast("double").alias("at"))
        return F.aggregate(parts, start, step)["at"]

    return 1 / (1 + F.exp(-odds(let(F.transform(places, weight), find) - REACH)))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(groups: DataFrame) -> float:
    """The prior strength from groups (n, bad, prior): intraclass correlation by moments, turned into pages."""
    n, p, m = F.col("n"), F.col("bad") / F.col("n"), F.col("prior")
    sums = groups.agg(
        F.sum(n * (p - m) * (p - m)).alias("s"), F.sum(m * (1 - m)).alias("v"), F.sum(n * m * (1 - m)).alias("nv"), F.count("*").alias("k")
    )
    rho = (F.col("s") - F.col("v")) / F.greatest(F.col("nv") - F.col("v"), F.lit(1e-9))
    strength = F.when(rho <= 0, MOST_STRENGTH).otherwise(1 / F.least(rho, F.lit(1.0)) - 1)
    return sums.select(F.least(F.greatest(F.coalesce(strength, F.lit(1.0)), F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))).first()[0]


def host_reputation(labelled: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, alpha, beta, rate, bound) for each distinct host of `hosts`, from `labelled` (host, bad 0/1; null bad: no label).

    No labels at all: rate 0.5 with a prior of one page. The overall rate and the three strengths, single numbers, come to
    the driver. Tables of one row per host, domain or suffix
    are cut into the checkpoint folder, as each is read again for its strength. The table of suffixes and domains is as large as there are such names, so Spark picks its join.
    """
    by_host = labelled.where("host is not null").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = cut(hosts.select("host").distinct().join(by_host, "host", "left").select(
        "host", registered_domain(F.col("host")).alias("domain"), host_suffix(F.col("host")).alias("suffix"),
        F.coalesce("n", F.lit(0)).cast("double").alias("n"), F.coalesce("bad", F.lit(0)).cast("double").alias("bad"),
    ))
    overall = tree.agg((F.coalesce(F.sum("bad"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 1)).first()[0]
    domains = tree.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("prior", F.lit(overall))

    def posterior(groups: DataFrame) -> DataFrame:
        strength = F.lit(_strength(groups.where("n > 0")))
        mean = (F.col("bad") + strength * F.col("prior")) / (F.col("n") + strength)
        return groups.withColumns({"strength": strength, "rate": mean})

    suffixes = posterior(cut(suffixes)).select("suffix", F.col("rate").alias("prior"))
    domains = posterior(cut(domains.join(suffixes, "suffix"))).select("domain", F.col("rate").alias("prior"))
    out = posterior(cut(tree.join(domains, "domain")))
    size = F.col("n") + F.col("strength")
    out = out.select("host", (F.col("rate") * size).alias("alpha"), ((1 - F.col("rate")) * size).alias("beta"), "rate")
    return out.withColumn("bound", beta_quantile(F.col("alpha"), F.col("beta"), TAIL))


def filter_urls(pages: DataFrame, url_col: str = "url", id_col: str = "page_id", labelled: DataFrame | None = None, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, host, path, rule, verdict, rate, bound) for every row of pages; any other columns of pages are left out.

    `labelled` has host and bad; without it the pages that a rule decides are the labelled ones. verdict: that of the
    longest fitting rule; else block where the lower posterior bound (the TAIL quantile of the host's beta law) of the host's block
    rate exceeds `threshold`, else allow. Null and malformed urls have an empty host, which is judged like any other.
    Repeated rows each keep their own row; an empty table gives an empty table.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("fit", matched_rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = parts.where("fit is not null").select("host", (F.col("fit.verdict") == "block").cast("int").alias("bad"))
    reputation = host_reputation(labelled, parts)
    judged = F.when(F.col("bound") > threshold, "block").otherwise("allow")
    return parts.join(reputation.select("host", "rate", "bound"), "host", "left").select(
        id_col, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", judged).alias("verdict"), "rate", "bound"
    )
