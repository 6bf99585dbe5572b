"""Documents to clauses, page accounting, run journals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normwerk.functions import text as t
from normwerk.operators.tables import first_by, running_sum
from normwerk.sources.shared import stored


def clauses(docs: DataFrame, least: int = 30) -> DataFrame:
    """doc_id, pos, clause_no, section_path, section_top, body of each accepted clause; the first of equal numbers in a document stays.

    The choice of the first carries numbers and places only as far as Spark needs them: a window partition is one document.
    """
    parts = docs.select("doc_id", F.posexplode(t.clause_parts("text")).alias("pos", "_p"))
    rows = parts.select("doc_id", "pos", t.clause_number("_p").alias("clause_no"), t.clause_body("_p").alias("body"))
    good = rows.filter(t.is_clause(F.col("clause_no"), F.col("body"), least))
    return first_by(good, ["doc_id", "clause_no"], ["pos"]).select("doc_id", "pos", "clause_no", t.section_path("clause_no").alias("section_path"), F.element_at(F.split("clause_no", r"\."), 1).alias("section_top"), "body")


def with_content(rows: DataFrame, code: str = "doc_code") -> DataFrame:
    """id, content and content_hash for clauses that have a document code."""
    content = F.format_string("%s\nп.%s\n%s\n%s", F.col(code), F.col("clause_no"), F.col("section_path"), F.col("body"))
    return rows.withColumns({"id": F.concat_ws("-", F.col("doc_id").cast("string"), F.col("clause_no")), "content": content}).withColumn("content_hash", F.md5("content"))


def pages(docs: DataFrame, total: str = "total") -> DataFrame:
    """doc_id, page_no, text, confidence, reason for every page from 1 to `total`; the last of repeated markers counts."""
    marked = docs.select("doc_id", total, F.size(t.split_pages("text")).alias("_n"), F.col("text").alias("_whole"), F.explode(F.sequence(F.lit(1), F.greatest(F.col(total), F.lit(1)))).alias("page_no"))
    found = docs.select("doc_id", F.posexplode(t.split_pages("text")).alias("_at", "_p")).select("doc_id", "_at", F.element_at(F.split("_p", "\u0002"), 1).cast("int").alias("page_no"), t.strip(F.element_at(F.split("_p", "\u0002"), 2)).alias("_t"))
    last = found.groupBy("doc_id", "page_no").agg(F.max_by("_t", "_at").alias("_t"))
    j = marked.join(last, ["doc_id", "page_no"], "left")
    none = F.col("_n") == 0
    whole = none & (F.col("page_no") == 1)
    return j.filter(~none | (F.col("page_no") == 1)).select(
        "doc_id", "page_no", F.when(whole, F.col("_whole")).otherwise(F.coalesce("_t", F.lit(""))).alias("text"), F.when(whole, 0.7).when(F.col("_t").isNull(), 0.0).otherwise(1.0).alias("confidence"),
        F.when(whole, "no_page_markers").when(F.col("_t").isNull(), "page_missing").alias("reason"),
    )


def unfinished(inputs: DataFrame, journal: DataFrame, force: bool = False) -> DataFrame:
    """Inputs whose sha256 has no run that ended well."""
    return inputs if force else inputs.join(journal.filter("status = 'ok'").select("sha256").distinct(), "sha256", "left_anti")


def latest_ok(journal: DataFrame) -> DataFrame:
    """sha256 and its latest run that ended well."""
    return journal.filter("status = 'ok'").groupBy("sha256").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def tier_accounting(page_rows: DataFrame) -> DataFrame:
    """run_id, tier: pages and mean confidence."""
    p = page_rows.withColumn("_t", t.page_tier(F.col("text_len"), F.col("l2_text_len"), F.col("l2_confidence")))
    return p.groupBy("run_id", F.col("_t.tier").alias("tier")).agg(F.count("*").alias("pages"), F.round(F.avg("l2_confidence"), 6).alias("confidence"))


def fallback_reasons(page_rows: DataFrame) -> DataFrame:
    p = page_rows.select(t.page_tier(F.col("text_len"), F.col("l2_text_len"), F.col("l2_confidence")).alias("_t"))
    return p.filter(F.col("_t.reason").isNotNull()).groupBy(F.col("_t.reason").alias("reason")).agg(F.count("*").alias("pages"))


def rendered(rows: DataFrame) -> DataFrame:
    """doc_id, text: a document's clauses in natural order of their sections, each under its heading.  A document is one row here; see `rendered_parts` for larger ones."""
    parts = F.sort_array(F.collect_list(F.struct(t.section_key("section_path").alias("k"), F.col("pos"), F.concat(F.lit("## п."), F.col("clause_no"), F.lit("\n\n"), F.col("body")).alias("t"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))


def rendered_parts(rows: DataFrame, size: int = 1 << 20) -> DataFrame:
    """doc_id, part (from 0, with gaps where a clause is longer than `size`), start, text: the rendered documents in parts of whole clauses, of about `size` characters.

    `start` is the part's first character in the document; parts one after another are the text of `rendered`.  Clauses are ordered and their places added up over ranges, so
    neither a document nor the clauses of one have to meet in one task.
    """
    text = F.concat(F.lit("## п."), F.col("clause_no"), F.lit("\n\n"), F.col("body"), F.lit("\n\n"))
    each = rows.select("doc_id", t.section_key("section_path").alias("_k"), "pos", text.alias("_t")).withColumn("_n", F.length("_t").cast("long"))
    placed = stored(running_sum(each, "_n", [F.col("doc_id"), F.col("_k"), F.col("pos"), F.col("_t")], "_end"), "rendered-places")
    first = placed.groupBy("doc_id").agg(F.min(F.col("_end") - F.col("_n")).alias("_first"), F.max("_end").alias("_last"))
    start = placed.join(first, "doc_id").withColumn("start", F.col("_end") - F.col("_n") - F.col("_first"))
    own = F.when(F.col("_end") == F.col("_last"), F.substring("_t", F.lit(1), (F.col("_n") - 2).cast("int"))).otherwise(F.col("_t"))  # nothing follows the last clause
    parts = start.groupBy("doc_id", F.floor(F.col("start") / size).alias("part")).agg(F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("start", own.alias("t")))).alias("_p"))
    return parts.select("doc_id", "part", "start", F.array_join(F.transform("_p", lambda x: x["t"]), "").alias("text"))


def run_counters(documents: DataFrame, clause_rows: DataFrame, errors: DataFrame, pages: DataFrame | None = None, stored_rows: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """One row per run: documents, clauses, errors; with their tables also pages, inserted and updated (`stored_rows` has is_new) and duration_ms (`runs` has started_at, finished_at)."""
    n = lambda df, **c: df.groupBy("run_id").agg(*[x.alias(k) for k, x in c.items()])
    parts = [n(documents, documents=F.count("*")), n(clause_rows, clauses=F.count("*")), n(errors, errors=F.count("*"))]
    if pages is not None:
        parts.append(n(pages, pages=F.count("*")))
    if stored_rows is not None:
        parts.append(n(stored_rows, inserted=F.count_if("is_new"), updated=F.count_if(~F.col("is_new"))))
    if runs is not None:
        parts.append(runs.select("run_id", (F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))).alias("duration_ms")))
    return reduce(lambda a, b: a.join(b, "run_id", "full_outer"), parts).na.fill(0)


def run_by_id(runs: DataFrame, run_id: object) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id).limit(1)


def filled_headers(sheet: DataFrame, header: str, default: str, rows_per_part: int = 100_000) -> DataFrame:
    """`sheet` (sheet, row_no, ...) with `complex`, the last header at or above each row.

    Sheets are cut into parts of row numbers.  Headers are filled inside a part; a part that begins without one takes the last of the parts before, of which there is
    one row each.  So no sheet has to be ordered in one task.
    """
    part = F.floor(F.col("row_no") / rows_per_part)
    rows = sheet.withColumns({"_part": part, "_header": F.expr(header)})
    inside = Window.partitionBy("sheet", "_part").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("sheet").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy("sheet", "_part").agg(F.max_by("_header", F.when(F.col("_header").isNotNull(), F.col("row_no"))).alias("_last"))
    carried = last.select("sheet", "_part", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    filled = rows.withColumn("_own", F.last("_header", ignorenulls=True).over(inside)).join(carried, ["sheet", "_part"])
    return filled.select(*sheet.columns, F.coalesce("_own", "_carried", F.lit(default)).alias("complex"))
