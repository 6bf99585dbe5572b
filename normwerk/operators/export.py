"""The review log: labelling views, constraints, and training data from labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normwerk.functions import crossval, rules
from normwerk.operators.tables import missing, outside

ANALYST = "You answer from the clauses given and end with a line `confidence: high|medium|low`."
REVIEWER = "You check an answer against the clauses given and return JSON with verdict, rationale and missed_norms."


def _no_notes() -> Column:
    return F.col("final_decision").isNotNull() & (F.col("final_decision") != "claude_was_right") & (F.length(F.trim(F.coalesce(F.col("expert_notes"), F.lit("")))) == 0)


class _Constraints:
    """Declared constraints, made when they are read: columns need a session."""

    def __iter__(self):
        yield missing("question")
        yield missing("analyst_answer")
        yield outside("reviewer_verdict", rules.REVIEW_VERDICTS)
        yield outside("final_decision", rules.DECISIONS, nullable=True)
        yield outside("expert_verdict", rules.EXPERT_VERDICTS, nullable=True)
        yield "notes_missing", _no_notes()


CONSTRAINTS = _Constraints()


def labelled(log: DataFrame) -> DataFrame:
    return log.filter(F.col("expert_verdict").isNotNull() & F.col("final_decision").isNotNull())


def next_unlabelled(log: DataFrame, only_disagreements: bool = False) -> DataFrame:
    rows = log.filter(F.col("expert_verdict").isNull())
    return (rows.filter("disagreement") if only_disagreements else rows).orderBy("id").limit(1)


def labelling_stats(log: DataFrame) -> DataFrame:
    """Nine counts in one pass."""
    free = F.col("expert_verdict").isNull()
    n = lambda c, name: F.count_if(c).alias(name)
    return log.agg(
        F.count("*").alias("total"), n(free, "unlabeled"), n(~free, "labeled"), n(F.col("disagreement"), "disagreements"), n(F.col("disagreement") & free, "unlabeled_disagree"), *[n(F.col("final_decision") == d, d) for d in rules.DECISIONS]
    )


def label_buckets(log: DataFrame) -> DataFrame:
    """field, value, n for both label fields in one pass."""
    value = lambda c: F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit("null")).alias("value"))
    return log.select(F.explode(F.array(value("final_decision"), value("expert_verdict"))).alias("b")).groupBy("b.field", "b.value").agg(F.count("*").alias("n"))


def may_store(decision: Column, notes: Column) -> Column:
    """Whether a label may be stored: all decisions but the analyst's need notes that cite a norm."""
    return (decision == "claude_was_right") | crossval.has_citation(notes)


def _metadata(*more: Column) -> Column:
    return F.struct(F.col("id").alias("log_id"), "final_decision", "expert_verdict", "reviewer_verdict", "analyst_model", "reviewer_model", "k_used", *more).alias("metadata")


def _prepared(rows: DataFrame) -> DataFrame:
    """`rows` with the parts that the streams share, each worked out once: _clauses, _level, _notes, _answer (null: nothing there)."""
    full = lambda c: F.when(F.trim(c) != "", F.trim(c))
    level = crossval.resolved_confidence(F.col("analyst_confidence"))
    return rows.withColumns({"_clauses": crossval.format_clauses(F.col("context_clauses")), "_level": level, "_notes": full(F.col("expert_notes")), "_answer": full(F.col("analyst_answer"))})


def _has_dpo() -> Column:
    return (F.col("final_decision") == "gpt_was_right") & F.col("disagreement") & (F.col("analyst_answer") != "") & F.col("_notes").isNotNull()


def _has_critic() -> Column:
    return (F.col("final_decision") == "claude_was_right") & F.col("disagreement") & F.col("_answer").isNotNull() & F.lower(F.get_json_object("reviewer_raw", "$.verdict")).isin("rejected", "uncertain")


def _prompt(*before: str) -> Column:
    return F.concat(F.lit("".join(before)), crossval.prompt_of(F.col("question"), F.col("_clauses")))


def _target() -> Column:
    target = crossval.winning_answer(F.col("final_decision"), F.col("analyst_answer"), F.col("expert_notes"), F.col("analyst_confidence"))
    return F.when(F.length(target) > 0, target)


def _messages(target: Column) -> Column:
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(said("system", F.lit(ANALYST)), said("user", _prompt()), said("assistant", target))


def _dpo_fields() -> list[Column]:
    """prompt, chosen, rejected."""
    marked = lambda c: crossval.ensure_confidence_marker(c, F.col("_level"))
    return [_prompt(f"[SYSTEM]\n{ANALYST}\n\n[USER]\n").alias("prompt"), marked(F.col("_notes")).alias("chosen"), marked(F.col("analyst_answer")).alias("rejected")]


def _critic_fields() -> list[Column]:
    notes = F.coalesce("_notes", F.lit("ответ корректен и подкреплён цитированными клозами"))
    chosen = F.to_json(F.struct(F.lit("confirmed").alias("verdict"), notes.alias("rationale"), F.array().cast("array<string>").alias("missed_norms")))
    prompt = F.concat(F.lit(f"[SYSTEM]\n{REVIEWER}\n\n[USER]\nВОПРОС:\n"), F.col("question"), F.lit("\n\nОТВЕТ ПЕРВОГО ЭКСПЕРТА:\n"), F.col("_answer"), F.lit("\n\nКЛОЗЫ ИЗ БАЗЫ НТД:\n"), F.col("_clauses"))
    return [prompt.alias("prompt"), chosen.alias("chosen"), F.col("reviewer_raw").alias("rejected")]


def sft(rows: DataFrame) -> DataFrame:
    """messages, metadata for rows that have a winning answer."""
    r = _prepared(rows).withColumn("_t", _target()).filter(F.col("_t").isNotNull())
    return r.select(_messages(F.col("_t")).alias("messages"), _metadata())


def dpo(rows: DataFrame) -> DataFrame:
    """prompt, chosen, rejected, metadata: the expert's notes against the analyst's answer."""
    return _prepared(rows).filter(_has_dpo()).select(*_dpo_fields(), _metadata())


def dpo_critic(rows: DataFrame) -> DataFrame:
    """prompt, chosen, rejected, metadata: a confirming review against the wrong one that was given."""
    return _prepared(rows).filter(_has_critic()).select(*_critic_fields(), _metadata(F.lit("critic").alias("role")))


def training_set(log: DataFrame) -> DataFrame:
    """All three streams, tagged: each labelled row gives those of its streams that it has, in one pass over the log without a shuffle."""
    r = _prepared(labelled(log)).withColumn("_t", _target())
    nothing = F.lit(None).cast("string")

    def row(stream: str, messages: Column, metadata: Column, fields: list[Column]) -> Column:
        return F.struct(F.lit(stream).alias("stream"), messages.alias("messages"), F.to_json(metadata).alias("metadata"), *fields)

    none = [nothing.alias(c) for c in ("prompt", "chosen", "rejected")]
    rows = F.array(
        F.when(F.col("_t").isNotNull(), row("sft", F.to_json(_messages(F.col("_t"))), _metadata(), none)),
        F.when(_has_dpo(), row("dpo", nothing, _metadata(), _dpo_fields())),
        F.when(_has_critic(), row("dpo_critic", nothing, _metadata(F.lit("critic").alias("role")), _critic_fields())),
    )
    return r.select(F.inline(F.array_compact(rows)))


def summary(log: DataFrame) -> DataFrame:
    """One row: total, labelled and the streams' counts; one pass, and no stream is written out for it."""
    has = {"sft": _target().isNotNull(), "dpo": _has_dpo(), "dpo_critic": _has_critic()}
    known = F.col("expert_verdict").isNotNull() & F.col("final_decision").isNotNull()
    return _prepared(log).agg(F.count("*").alias("total"), F.count_if(known).alias("labelled"), *[F.count_if(known & c).alias(k) for k, c in has.items()])
