"""Review-comment archetypes: promotion, frequencies, Pareto, slices, regional drift, clustering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normwerk.operators.tables import running_sum
from normwerk.sources.shared import stored

SEVERITY_SHARES = {"major": 0.50, "minor": 0.35, "critical": 0.10, "recommendation": 0.05}


def promoted(comments: DataFrame, least: int = 3, reports: int = 2) -> DataFrame:
    """archetype_id, n, n_reports of clusters with enough comments from enough reports.

    Comments are first counted per archetype and report, so that a frequent archetype is summed before it is shuffled.
    """
    per = comments.groupBy("archetype_id", "report_id").agg(F.count("*").alias("n"))
    return per.groupBy("archetype_id").agg(F.sum("n").alias("n"), F.count("*").alias("n_reports")).filter((F.col("n") >= least) & (F.col("n_reports") >= reports))


def statistics(comments: DataFrame) -> DataFrame:
    per = comments.groupBy("archetype_id", "report_id").agg(F.count("*").alias("n"), F.max("report_date").alias("d"))
    return per.groupBy("archetype_id").agg(F.sum("n").alias("occurrences"), F.count("*").alias("reports"), F.max("d").alias("last_seen"))


def job_summary(comments: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    return comments.groupBy("report_id").agg(F.count("*").alias("total"), n("critical").alias("critical"), n("major").alias("substantial"), n("minor").alias("minor"))


def severity_check(comments: DataFrame, expected: dict[str, float] = SEVERITY_SHARES) -> DataFrame:
    """severity, n, share, expected, difference."""
    n = comments.groupBy("severity").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # over one row per severity
    want = F.coalesce(*[F.when(F.col("severity") == k, F.lit(v)) for k, v in expected.items()], F.lit(0.0))
    return n.select("severity", "n", share.alias("share"), want.alias("expected"), (share - want).alias("difference"))


def only_major(comments: DataFrame) -> DataFrame:
    """Reports all of whose comments are major."""
    return comments.groupBy("report_id").agg(F.count("*").alias("n"), F.bool_and(F.col("severity") == "major").alias("all_major")).filter("all_major").select("report_id", "n")


def frequencies(comments: DataFrame, axes: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """Counts by several sets of axes at once; `axes_used` is a bit mask of the axes that are summed over.

    Comments are first counted at the finest grain, so the sets expand that and not the comments.
    """
    fine = comments.groupBy(*axes).agg(F.count("*").alias("_n"))
    used = F.grouping_id(*axes)
    return fine.groupingSets([[F.col(a) for a in s] for s in sets], *axes).agg(F.sum("_n").alias("n"), used.alias("axes_used"))


def report_shares(comments: DataFrame, item: str, slice_by: str) -> DataFrame:
    """Of the reports of each slice, the share that has each item."""
    per = comments.select(slice_by, item, "report_id").distinct()
    hit = per.groupBy(slice_by, item).agg(F.count("*").alias("reports"))
    total = comments.select(slice_by, "report_id").distinct().groupBy(slice_by).agg(F.count("*").alias("of"))
    return hit.join(total, slice_by).select(slice_by, item, "reports", F.round(F.col("reports") / F.col("of"), 6).alias("share"))


def pareto(comments: DataFrame, until: float = 0.8) -> DataFrame:
    """archetype_id, n, running share, and whether it belongs to the smallest prefix that reaches `until`.

    The running sum goes over archetypes, not comments, and over ranges of them side by side.
    """
    n = comments.groupBy("archetype_id").agg(F.count("*").alias("n"))
    summed = running_sum(n, "n", [F.desc("n"), F.col("archetype_id")], "_run")
    total = comments.agg(F.count("*").alias("_total"))  # one row
    run, of = F.col("_run"), F.col("_total")
    return summed.crossJoin(F.broadcast(total)).select("archetype_id", "n", (run / of).alias("running_share"), ((run - F.col("n")) / of < until).alias("in_core"))


def pareto_summary(p: DataFrame, target: float = 0.25) -> DataFrame:
    share = F.count_if("in_core") / F.count("*")
    return p.agg(F.count_if("in_core").alias("core"), F.count("*").alias("archetypes"), F.round(share, 6).alias("share"), (share <= target).alias("reached"))


def top_per_slice(comments: DataFrame, slice_by: str, n: int = 20) -> DataFrame:
    c = comments.groupBy(slice_by, "archetype_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy(slice_by).orderBy(F.desc("n"), "archetype_id")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def regional_drift(comments: DataFrame, a: str, b: str) -> DataFrame:
    """Per archetype: counts, shares and ranks in two regions, the difference of shares and the two-proportion z.

    Ranks are made for distinct counts: one more than the number of archetypes with a larger one.
    """
    count = lambda region: F.count_if(F.col("region") == region)
    t = stored(comments.filter(F.col("region").isin(a, b)).groupBy("archetype_id").agg(count(a).alias("n_a"), count(b).alias("n_b")), "drift")
    totals = t.agg(F.sum("n_a").alias("t_a"), F.sum("n_b").alias("t_b"))  # one row
    for c in ("a", "b"):
        each = t.groupBy(f"n_{c}").agg(F.count("*").alias("_k"))
        ranks = running_sum(each, "_k", [F.desc(f"n_{c}")], "_run").select(f"n_{c}", (F.col("_run") - F.col("_k") + 1).cast("int").alias(f"rank_{c}"))
        t = t.join(ranks, f"n_{c}")
    t = t.crossJoin(F.broadcast(totals))
    pa, pb, p = F.try_divide("n_a", "t_a"), F.try_divide("n_b", "t_b"), (F.col("n_a") + F.col("n_b")) / (F.col("t_a") + F.col("t_b"))
    z = F.try_divide(pa - pb, F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1), "t_a") + F.try_divide(F.lit(1), "t_b"))))  # null without a region's comments
    return t.select("archetype_id", "n_a", "n_b", "rank_a", "rank_b", F.round(pa - pb, 6).alias("difference"), F.round(z, 6).alias("z"))


# The normal distribution's upper tail, as density times a polynomial in 1 / (1 + 0.2316419 z), to 8e-8
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def two_sided(z: str) -> Column:
    """The chance of at least |z| either way."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    powers = sum((c * F.pow(t, F.lit(i + 1.0)) for i, c in enumerate(TAIL)), F.lit(0.0))
    return F.when(F.col(z).isNotNull(), F.least(F.lit(1.0), 2 * F.exp(-F.col(z) * F.col(z) / 2) * 0.3989422804014327 * powers))


def significant(drift: DataFrame, rate: float = 0.05, z: str = "z") -> DataFrame:
    """`drift` with p (two-sided, of `z`), q and significant: q, the least false-discovery rate at which the row is found, is at most `rate`.

    Step-up: with m rows, q is the least of p m / rank over the rows with as large a p.  Ranks and minima run over ranges of p side by side.  Rows without z have no p,
    don't count and aren't significant.
    """
    rows = stored(drift.withColumn("p", F.round(two_sided(z), 9)), "significance")
    m = rows.agg(F.count("p").alias("_m"))  # one row
    each = rows.filter("p is not null").groupBy("p").agg(F.count("*").alias("_c"))
    ranks = running_sum(each, "_c", [F.col("p")], "_rank").crossJoin(F.broadcast(m)).withColumn("_ratio", F.col("p") * F.col("_m") / F.col("_rank"))
    q = running_sum(ranks, "_ratio", [F.desc("p")], "q", least=True).select("p", F.round("q", 9).alias("q"))
    return rows.join(q, "p", "left").select(*drift.columns, "p", "q", F.coalesce(F.col("q") <= rate, F.lit(False)).alias("significant"))


def quotes_checked(comments: DataFrame, reports: DataFrame) -> DataFrame:
    """Comments with `found`: the quoted text is in its report.

    A report's comments are brought to it, not its text to each of them.
    """
    every = [F.col(f"`{c}`") for c in comments.columns]
    mine = comments.groupBy("report_id").agg(F.collect_list(F.struct(*every)).alias("_c"))
    j = mine.join(reports.select("report_id", F.col("raw_text").alias("_report")), "report_id", "left")
    checked = F.transform("_c", lambda c: F.struct(c.alias("c"), F.coalesce(F.contains(F.col("_report"), c["raw_text"]), F.lit(False)).alias("found")))
    return j.select(F.explode(checked).alias("_x")).select("_x.c.*", "_x.found")


def counts_checked(comments: DataFrame, reports: DataFrame) -> DataFrame:
    """report_id, extracted, numbered, complete: no fewer comments than numbered items."""
    n = comments.groupBy("report_id").agg(F.count("*").alias("extracted"))
    r = reports.select("report_id", F.regexp_count("raw_text", F.lit(r"(?m)^\s*\d+[.)]\s")).cast("long").alias("numbered"))
    return r.join(n, "report_id", "left").select("report_id", F.coalesce("extracted", F.lit(0)).alias("extracted"), "numbered", (F.coalesce("extracted", F.lit(0)) >= F.col("numbered")).alias("complete"))


def needs_review(confidence: str, decision: str | None = None, least: float = 0.75):
    low = F.col(confidence) < least
    return F.coalesce(low | (F.col(decision) == "NEEDS_REVIEW") if decision else low, F.lit(True))


def clusters(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, cluster: the smallest id reachable over links (a, b).

    Minimum labels with pointer jumping: each round takes the smallest label among neighbours, then the label's label.  Each round is written to
    the shared folder.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cluster-links")
    labels = stored(nodes.select("id", F.col("id").alias("cluster")), "cluster-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("cluster").alias("_m"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("cluster").alias("_old"), F.least("cluster", "_m").alias("cluster"))
        jump = step.select(F.col("id").alias("cluster"), F.col("cluster").alias("_j"))
        new = stored(step.join(jump, "cluster", "left").select("id", "_old", F.least("cluster", "_j").alias("cluster")), "cluster-labels")
        moved = new.filter("_old <> cluster").limit(1).count()
        labels = new.select("id", "cluster")
        if not moved:
            return labels
