"""Functions for reviewed answers: confidence, winning answers, prompts, reviews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from normwerk.functions import rules
from normwerk.functions.text import bound, strip

MARKER = r"(?iu)confidence\s*[:=]\s*(high|medium|low)\b"
LAST_LINE = r"(?iuU)^\s*confidence\s*[:=]\s*(high|medium|low)\s*$"
LEVELS = ("high", "medium", "low")
NOTE_HEADING = "[уточнение эксперта]"


def _rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def extract_confidence(answer: Column) -> Column:
    v = F.lower(F.regexp_extract(answer, r"(?iu)confidence[\s:=\-–—]*([a-zа-я]+)", 1))
    return F.when(v.startswith("высок"), "high").when(v.startswith("сред"), "medium").when(v.startswith("низк"), "low").when(v.isin(*LEVELS), v)


def resolved_confidence(level: Column) -> Column:
    v = F.lower(F.trim(level))
    return F.when(v.isin(*LEVELS), v).otherwise("medium")


def ensure_confidence_marker(text: Column, default: Column) -> Column:
    """Untouched if the last line that isn't empty is a marker; else without markers inside, and one at the end."""

    def marked(s: Column) -> Column:
        last = F.element_at(F.split(s["stripped"], "\n"), -1)
        return F.when((s["stripped"] == "") | last.rlike(LAST_LINE), s["text"]).otherwise(F.concat(_rstrip(F.regexp_replace(s["stripped"], MARKER, "")), F.lit("\nconfidence: "), s["default"]))

    return bound(bound(text, lambda t: F.struct(t.alias("text"), _rstrip(t).alias("stripped"), default.alias("default"))), marked)


def winning_answer(decision: Column, answer: Column, notes: Column, level: Column) -> Column:
    """Null where there is no answer to learn from."""
    full = lambda c: bound(strip(c), lambda s: F.when(s != "", s))

    def chosen(s: Column) -> Column:
        a, n = s["a"], s["n"]
        right = F.when(a.isNotNull() & n.isNotNull(), F.concat(a, F.lit(f"\n\n{NOTE_HEADING}\n"), n)).otherwise(F.coalesce(a, n))
        return F.when(decision == "claude_was_right", right).when(decision.isin("gpt_was_right", "both_wrong", "split"), n)

    target = bound(F.struct(full(answer).alias("a"), full(notes).alias("n")), chosen)
    return ensure_confidence_marker(target, resolved_confidence(level))


def format_clauses(clauses: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        m = c["metadata"]
        some = lambda k: F.when(m[k] != "", m[k])
        body = F.substring(F.replace(strip(F.coalesce(c["content"], F.lit(""))), F.lit("\n"), F.lit(" ")), 1, 800)
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(some("doc_code"), F.lit("НТД")), F.lit(" п."), F.coalesce(some("clause_no"), some("clause"), some("number"), F.lit("")), F.lit("\n"), body)

    return F.array_join(F.transform(F.coalesce(clauses, F.array()), one), "\n\n")


def format_prompt(question: Column, clauses: Column) -> Column:
    return prompt_of(question, format_clauses(clauses))


def prompt_of(question: Column, body: Column) -> Column:
    """The prompt of a question and clauses that are already formatted."""
    return F.concat(F.lit("ВОПРОС:\n"), question, F.lit("\n\n\n\nКЛОЗЫ ИЗ БАЗЫ НТД:"), F.when(body != "", F.concat(F.lit("\n\n"), body)).otherwise(F.lit("")))


def has_citation(notes: Column) -> Column:
    return F.coalesce(notes, F.lit("")).rlike("(?iuU)(?:" + "|".join(rules.CITATIONS) + ")")


def normalize_review(raw: Column) -> Column:
    """struct(verdict, critique, missed_norms, disagreement) of a reviewer's JSON."""
    verdict = F.lower(F.get_json_object(raw, "$.verdict"))
    verdict = F.when(verdict.isin("confirmed", "rejected", "uncertain", "error"), verdict).otherwise("error")
    norms = F.get_json_object(raw, "$.missed_norms")
    listed = F.filter(F.from_json(norms, "array<string>"), lambda x: x.isNotNull() & (x != ""))
    missed = F.when(norms.startswith("["), listed).when(F.trim(norms) != "", F.array(norms)).otherwise(F.array().cast("array<string>"))
    return F.struct(verdict.alias("verdict"), F.coalesce(F.get_json_object(raw, "$.rationale"), F.lit("")).alias("critique"), F.coalesce(missed, F.array().cast("array<string>")).alias("missed_norms"), (verdict != "confirmed").alias("disagreement"))


def claim(answer: Column, n: int = 400) -> Column:
    return F.substring(strip(F.regexp_replace(strip(F.coalesce(answer, F.lit(""))), r"\A#+[^\n]*\n", "")), 1, n)


def strip_fences(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?m)^\s*```[A-Za-z]*\s*$", ""))


def safe_parse(text: Column, schema: str) -> Column:
    """The parsed object, null where the text isn't valid JSON."""
    clean = strip_fences(text)
    return F.when(F.try_parse_json(clean).isNotNull() & clean.startswith("{"), F.from_json(clean, schema))


def parse_classification(raw: Column, message: Column) -> Column:
    """struct(type, summary, priority, tags, feasibility, impact), with defaults where the JSON is bad."""
    clean = strip_fences(raw)
    ok = F.try_parse_json(clean).isNotNull()
    at = lambda k: F.when(ok, F.get_json_object(clean, f"$.{k}"))
    tags = F.when(ok, F.from_json(F.get_json_object(clean, "$.tags"), "array<string>"))
    score = lambda k: F.when(F.coalesce(at(k).try_cast("int"), F.lit(0)) != 0, at(k).try_cast("int"))
    return F.struct(
        F.coalesce(at("type"), F.lit("NOTE")).alias("type"), F.coalesce(at("summary"), F.substring(message, 1, 100)).alias("summary"), F.coalesce(at("priority"), F.lit("medium")).alias("priority"),
        F.coalesce(tags, F.array(F.lit("unclassified"))).alias("tags"), score("feasibility_score").alias("feasibility"), score("impact_score").alias("impact"),
    )
