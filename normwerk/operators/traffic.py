"""Access-log reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normwerk.functions.text import is_bot, is_unknown_agent, parse_access_line
from normwerk.operators.tables import day_spine


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with is_bot and is_unknown_agent, and the lines that couldn't be read."""
    p = lines.select("line", parse_access_line("line").alias("r"))
    good = p.filter(F.col("r").isNotNull() & F.col("r.ts").isNotNull()).select("r.*")
    bad = p.filter(F.col("r").isNull() | F.col("r.ts").isNull()).select("line")
    return good.withColumns({"is_bot": is_bot("ua"), "is_unknown_agent": is_unknown_agent("ua")}), bad


def of_day(lines: DataFrame, day: str) -> DataFrame:
    """Lines whose stamp has this day, told by their text alone: the others needn't be parsed."""
    return lines.filter(F.contains(F.col("line"), F.concat(F.lit("["), F.date_format(F.lit(day).cast("date"), "dd/MMM/yyyy"), F.lit(":"))))


def by_class(access: DataFrame, day: str) -> DataFrame:
    """class (all, human, bot), distinct addresses, requests of one day; `all` is there without requests too.

    One pass: requests are summed by address where they are read, an address counts for each class that it has requests of.
    """
    n = lambda c: F.count_if(c).alias
    bot = F.coalesce(F.col("is_bot"), F.lit(False))
    each = access.filter(F.to_date("ts") == F.lit(day).cast("date")).groupBy("ip").agg(n(~bot)("_human"), n(bot)("_bot"))
    sums = [(name, F.count_if((c > 0) & F.col("ip").isNotNull() if name == "all" else c > 0), F.coalesce(F.sum(c), F.lit(0))) for name, c in (("all", F.col("_human") + F.col("_bot")), ("human", F.col("_human")), ("bot", F.col("_bot")))]
    row = each.agg(*[c.alias(f"{name}_{i}") for name, *cs in sums for i, c in enumerate(cs)])
    classes = F.array(*[F.struct(F.lit(name).alias("class"), F.col(f"{name}_0").alias("ips"), F.col(f"{name}_1").alias("requests")) for name, *_ in sums])
    return row.select(F.inline(classes)).filter("class = 'all' or requests > 0")


def daily(access: DataFrame, first: str, last: str) -> DataFrame:
    """A row per day from first to last, days without requests too."""
    days = day_spine(first, last, access.sparkSession)
    a = access.select(F.to_date("ts").alias("day"), "ip", "is_bot").filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    a = a.groupBy("day", "ip", "is_bot").agg(F.count("*").alias("n"))
    part = lambda bot: F.col("is_bot") == bot
    total = lambda bot: F.coalesce(F.sum(F.when(part(bot), F.col("n"))), F.lit(0))
    s = a.groupBy("day").agg(F.count_if(part(False)).alias("human_ips"), total(False).alias("human_requests"), F.count_if(part(True)).alias("bot_ips"), total(True).alias("bot_requests"))
    return days.join(s, "day", "left").na.fill(0)


def top(access: DataFrame, column: str, n: int, bots: bool) -> DataFrame:
    return access.filter(F.col("is_bot") == bots).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def approximate_top(access: DataFrame, column: str, n: int, bots: bool, tracked: int = 10_000) -> DataFrame:
    """As `top`, from one sketch of at most `tracked` values a task: nothing is shuffled by value, and counts of values that it tracks throughout are exact."""
    best = access.filter(F.col("is_bot") == bots).agg(F.expr(f"approx_top_k({column}, {n}, {tracked})").alias("_t"))
    return best.select(F.inline("_t")).select(F.col("item").alias("value"), F.col("count").alias("n"))


def approximate_by_class(access: DataFrame, error: float = 0.01) -> DataFrame:
    """day, class, addresses (approximate, by sketches), requests; `error` is the standard error of addresses, so it has to be a small part of the error that a reader can bear."""
    return access.groupBy(F.to_date("ts").alias("day"), F.when(F.col("is_bot"), "bot").otherwise("human").alias("class")).agg(F.approx_count_distinct("ip", error).alias("ips"), F.count("*").alias("requests"))


def _class() -> Column:
    return F.when(F.col("is_bot"), "bot").otherwise("human").alias("class")


def daily_sketches(access: DataFrame, tracked: int = 1000, precision: int = 14) -> DataFrame:
    """day, class, requests, ips (a sketch of distinct addresses, 2 ** precision registers), agents (a sketch of the commonest, `tracked` of them): a row for each day and class, to be stored.

    Rows of later days are added; any range of days follows from them (`sketched`) without reading a line again.
    """
    return access.groupBy(F.to_date("ts").alias("day"), _class()).agg(F.count("*").alias("requests"), F.hll_sketch_agg("ip", precision).alias("ips"), F.expr(f"approx_top_k_accumulate(ua, {tracked})").alias("agents"))


def sketched(sketches: DataFrame, first: str, last: str, n: int = 3) -> DataFrame:
    """class, requests (exact), ips (approximate distinct addresses over all days, an address of several days once), agents (value and count of the n commonest) of the days from first to last.

    The standard error of ips is 1.04 / sqrt(registers), 0.8 % by default; counts of agents are exact while no more than `tracked` are met.
    """
    some = sketches.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    merged = some.groupBy("class").agg(F.sum("requests").alias("requests"), F.hll_union_agg("ips").alias("_ips"), F.expr("approx_top_k_combine(agents)").alias("_agents"))
    top = F.transform(F.expr(f"approx_top_k_estimate(_agents, {int(n)})"), lambda x: F.struct(x["item"].alias("value"), x["count"].alias("n")))
    return merged.select("class", "requests", F.hll_sketch_estimate("_ips").alias("ips"), top.alias("agents"))


def labelled(ips: DataFrame, geo: DataFrame) -> DataFrame:
    """ip, place: 'City, Country [ISP]' where the table of places has the address."""
    place = F.concat(F.concat_ws(", ", "city", "country"), F.lit(" ["), F.col("isp"), F.lit("]"))
    return ips.join(geo.select("ip", place.alias("place")), "ip", "left")
