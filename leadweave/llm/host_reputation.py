"""URL filters: rules first, then empirical-Bayes reputation of the host.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; the path goes on to ``?``, ``#`` or the end. A rule is ``host/path...``: it fits
its host and all subdomains where the path starts with the rule's; the longest rule wins, the
first listed of equally long ones.

Where no rule fits, labelled page outcomes decide. The rate of bad pages is a beta variable
whose prior comes from the level above: all pages, suffix, registered domain, host. How far a
level trusts its parent (the prior's weight, in pages) is estimated from the spread of the rates
around their parents by the method of moments. A host is blocked if the lower bound of its
posterior rate exceeds ``threshold``. Hosts without labelled pages have the prior of their
registered domain, or of their suffix, or of all pages.

The registered domain is the label before the suffix, with the suffix; the suffix is the last
label, or the last two where they are listed in ``two_label_suffixes``.

DataFrame functions only. Reputations are aggregates per host; their table is written and met
by host once, split on hot hosts where it is too large to broadcast.

Defined results: NULL urls and urls without ``://`` have empty host and path, which no rule
fits, and are judged as a host without labelled pages. Repeated rows are judged each. Labelled
rows with NULLs are not used; of several for one page the worst counts. Without labelled pages
nothing is blocked but by rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import packed, unpacked, written

#: Second-level suffixes under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.za", "com.br", "co.in", "co.kr", "com.cn", "com.mx", "com.tr")
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        of, slash, rest = self.text.partition("/")
        return ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)


def with_host(pages: DataFrame, url_col: str = "url") -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(url, _URL, 1), _CAPITALS, _SMALL),
        "path": F.regexp_extract(url, _URL, 2)})


def rule_of(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, NULL if none does."""
    by_length = sorted(rules, key=lambda r: -len(r.text))
    name = F.coalesce(*[F.when(r.fits(host, path), r.text) for r in by_length], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(r.fits(host, path), r.verdict) for r in by_length], F.lit(None).cast("string"))
    return name, verdict


def with_levels(hosts: DataFrame, two_label_suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    labels = F.split("host", r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    width = F.when(two.isin(*two_label_suffixes), 2).otherwise(1)
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return hosts.withColumns({"suffix": tail(width), "domain": tail(width + 1)})


def _weight(children: DataFrame, of: str) -> float:
    """Pages a prior of this level is worth: from the excess of the children's spread around
    their parent's rate over binomial spread, between 1 and 10000."""
    both = F.col("bad") / F.col("n")
    mean = F.try_divide(F.col("bad_of"), F.col("n_of"))
    row = children.filter(mean.between(1e-9, 1 - 1e-9)).agg(
        F.sum(F.col("n") * (both - mean) ** 2 / (mean * (1 - mean))).alias("spread"),
        F.sum(F.lit(1) - F.col("n") / F.col("n_of")).alias("freedom"),
        F.sum(F.col("n") * (F.lit(1) - F.col("n") / F.col("n_of"))).alias("pages")).first()
    if not row["freedom"] or row["pages"] <= row["freedom"]:
        return 10000.0
    excess = (row["spread"] - row["freedom"]) / (row["pages"] - row["freedom"])
    return min(max(1 / excess - 1, 1.0), 10000.0) if excess > 0 else 10000.0


def reputations(hosts: DataFrame, outcomes: DataFrame, sd: float = 1.645, two_label_suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, rate (posterior mean of bad pages), lower (its bound ``sd`` deviations below) for
    every host of ``hosts``; ``outcomes`` has host and bad (0 or 1), a row per labelled page."""
    seen = written(with_levels(
        outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").cast("long").alias("bad")), two_label_suffixes), "host-outcomes")

    def level(rows: DataFrame, key: str, *above: str) -> DataFrame:
        return written(rows.groupBy(key, *above).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), f"{key}-outcomes")

    def under(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        return rows.join(parents.select(key, F.col("n").alias("n_of"), F.col("bad").alias("bad_of")), key)

    domains = level(seen, "domain", "suffix")
    suffixes = level(domains, "suffix")
    n, bad = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    top = (bad + 0.5) / (n + 1.0)
    w_suffix = _weight(suffixes.withColumns({"n_of": F.lit(n), "bad_of": F.lit(bad)}), "all")
    w_domain = _weight(under(domains, suffixes, "suffix"), "suffix")
    w_host = _weight(under(seen, domains, "domain"), "domain")

    def joined(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
        return rows.join(table.select(key, F.col("n").alias("_n"), F.col("bad").alias("_bad")), key, "left").withColumns({
            "_n": F.coalesce("_n", F.lit(0)), "_bad": F.coalesce("_bad", F.lit(0))})

    def shrunk(prior: Column, weight: float) -> Column:
        return (F.col("_bad") + prior * weight) / (F.col("_n") + weight)

    rows = with_levels(hosts.select("host").distinct(), two_label_suffixes)
    for key, table, prior, weight in (
        ("suffix", suffixes, F.lit(top), w_suffix), ("domain", domains, F.col("rate_suffix"), w_domain), ("host", seen, F.col("rate_domain"), w_host)):
        rows = joined(rows, table, key).withColumns({f"rate_{key}": shrunk(prior, weight), "_pages": F.col("_n")}).drop("_n", "_bad")
    rate = F.col("rate_host")
    return rows.select("host", rate.alias("rate"), (
        rate - F.lit(sd) * F.sqrt(rate * (1 - rate) / (F.col("_pages") + F.lit(w_host + 1)))).alias("lower"))


def filter_urls(
    pages: DataFrame, rules: list[Rule], outcomes: DataFrame, url_col: str = "url", id_col: str = "page_id", threshold: float = 0.5, **options,
) -> DataFrame:
    """``pages`` with host, path, rule, rate, lower, verdict in place of columns of these names.
    ``outcomes``: ``id_col`` and bad."""
    new = ["host", "path", "rate", "lower", "rule", "verdict"]
    given = with_host(pages.select(packed(pages).alias("given"), F.col(url_col).alias("url"), F.col(id_col).alias("id")), "url").drop("url")
    worst = outcomes.filter(F.col(id_col).isNotNull() & F.col("bad").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("bad").alias("bad"))
    labelled = given.filter("host <> ''").select("id", "host").join(worst, "id").select("host", "bad")
    known = written(reputations(given, labelled, **options), "reputations").withColumnRenamed("host", "_host")
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    out = given.join(known, given["host"] == known["_host"]).drop("_host")
    return out.withColumns({
        "rule": rule,
        "verdict": F.coalesce(verdict, F.when((F.col("lower") > threshold) & (F.col("host") != ""), "block").otherwise("allow"))}).select(
        *unpacked([c for c in pages.columns if c not in new]), *new)
