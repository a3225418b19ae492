"""Scores, routes and issues of match candidates as Columns; scores are decimals, so that thresholds are exact."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of routing, priors of trust, penalties.
AUTO_ACCEPT, LLM_REVIEW = "0.92", "0.55"
TRUST_PRIORS = (("trusted", "0.08"), ("provisional", "-0.02"), ("suspect", "-0.16"), ("deprecated", "-0.32"))
PENALTIES = (("unit_conflict", "0.28", True), ("value_kind_conflict", "0.32", True), ("product_type_mismatch", "0.2", True), ("co_occurrence_conflict", "0.16", False))
ISSUE_PENALTIES = (("high", "0.35"), ("medium", "0.22"), ("low", "0.08"))
UNSAFE_RELATIONS = ("split_component", "qualifier_variant", "composite_value", "wrong_scope", "different_concept")


def dec(x: str | Column) -> Column:
    return (F.lit(x) if isinstance(x, str) else x).cast("decimal(18,6)")


def clamp(c: Column) -> Column:
    return F.round(F.greatest(dec("0"), F.least(dec("1"), c)), 3).cast("decimal(18,6)")


def _choice(c: Column, pairs: Sequence[tuple[str, str]], otherwise: str) -> Column:
    return reduce(lambda a, p: F.when(c == p[0], dec(p[1])).otherwise(a), reversed(pairs), dec(otherwise))


def _if(flag: str, amount: str) -> Column:
    return F.when(F.coalesce(F.col(flag), F.lit(False)), dec(amount)).otherwise(dec("0"))


def policy_score(df: DataFrame) -> DataFrame:
    """``df`` with trust_score, risk_score, context_score, constraint_score, unified_score and blocks.

    Expects base_score, trust_tier, audit_risk (null without an audit), audit_blocks, alias_exact, synonym, usage, reviews, signals, the conflict
    flags of PENALTIES, together, relation, occurrences and issues array<struct<risk, blocks>>.
    """
    n = lambda c, rate, most: F.least(dec(most), dec(F.coalesce(F.col(c), F.lit(0))) * dec(rate))
    trust = _choice(F.col("trust_tier"), TRUST_PRIORS, "-0.02") + _if("alias_exact", "0.05") + F.when(F.col("synonym") >= 0.8, dec("0.03")).otherwise(dec("0")) + n("reviews", "0.02", "0.06")
    context = n("usage", "0.01", "0.04") + n("signals", "0.01", "0.03")
    audit = F.when(F.col("audit_risk").isNotNull(), F.least(dec("0.45"), dec(F.greatest(F.lit(0), F.col("audit_risk"))) / dec("180"))).otherwise(dec("0"))
    conflicts = reduce(lambda a, b: a + b, [_if(c, p) for c, p, _ in PENALTIES])
    together = F.when(F.col("together") > 4, dec("0.05")).otherwise(dec("0"))
    issue = lambda x: _choice(x["risk"], ISSUE_PENALTIES, "0.08")
    issues = F.aggregate("issues", dec("0"), lambda a, x: (a + issue(x)).cast("decimal(18,6)"))
    split = F.when(F.col("relation") == "split_component", dec("0.18")).otherwise(dec("0"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    blocks = reduce(lambda a, b: a + b, [flag(F.col(c)) for c, _, b in PENALTIES if b]) + flag(F.col("audit_blocks")) + flag(F.col("relation").isin(*UNSAFE_RELATIONS)) + F.size(F.filter("issues", lambda x: x["blocks"]))
    scored = df.withColumns(
        {
            "trust_score": clamp(dec(F.col("base_score")) + trust),
            "risk_score": clamp(audit + conflicts + together + issues + split),
            "context_score": clamp(dec("0.8") + context + n("occurrences", "0.01", "0.08")),
            "constraint_score": clamp(dec("1") - dec(blocks) * dec("0.35")),
            "blocks": blocks > 0,
        }
    )
    unified = F.col("trust_score") * dec("0.55") + F.col("context_score") * dec("0.25") + F.col("constraint_score") * dec("0.2") - F.col("risk_score") * dec("0.45")
    return scored.withColumn("unified_score", clamp(unified.cast("decimal(18,6)")))


def route() -> Column:
    """The route of a candidate: the first rule of the list that holds, then what must never pass on its own.

    Over kind, relation, action, risk, unified_score, blocks, occurrences, alias_exact, issue_count, passes (term types whose values pass), structured
    (evidence of a qualifier) and llm.
    """
    c = F.col
    accept, review = dec(AUTO_ACCEPT), dec(LLM_REVIEW)
    strong, free, low = c("unified_score") >= accept, ~c("blocks"), c("risk") == "low"
    rules = [
        (c("relation").isin("extraction_error", "non_config_noise"), "auto_reject_pending"),
        ((c("kind") == "value") & c("passes") & low, "auto_pass"),
        ((c("occurrences") < 2) & ~c("alias_exact") & (c("issue_count") == 0), "defer_until_more_occurrences"),
        (c("relation") == "split_component", "human_review"),
        ((c("kind") == "value") & (c("relation") == "exact_alias") & (c("action") == "add_alias") & low & free, "auto_accept_pending"),
        ((c("kind") == "term_type") & (c("relation") == "exact_alias") & (c("action") == "map_to_existing_termtype") & (c("issue_count") == 0) & strong & free, "auto_pass"),
        ((c("relation") == "qualifier_variant") & low & c("structured"), "auto_pass"),
        ((c("kind") == "term_type") & strong, "human_review"),
        (strong & c("blocks"), "human_review"),
        ((c("kind") == "value") & c("relation").isin("exact_alias", "synonym_alias") & (c("action") == "add_alias") & strong & free, "auto_accept_pending"),
        ((c("unified_score") >= review) & (c("issue_count") == 0) & c("llm"), "llm_review"),
    ]
    chosen = reduce(lambda later, r: F.when(F.coalesce(r[0], F.lit(False)), r[1]).otherwise(later), reversed(rules), F.lit("human_review"))
    never = (c("kind") == "term_type") | c("relation").isin(*UNSAFE_RELATIONS[1:]) | c("blocks")
    return F.when((chosen == "auto_accept_pending") & never, "human_review").otherwise(chosen)


def detected(rules: Sequence[tuple[str, str, str, Column]]) -> Column:
    """array<struct<confidence, detector, risk>> of the rules (detector, confidence, risk, condition) that hold, most certain first."""
    found = F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(dec(conf).alias("confidence"), F.lit(name).alias("detector"), F.lit(risk).alias("risk"))) for name, conf, risk, when in rules])
    return F.sort_array(F.array_compact(found), asc=False)


def risk_total(dimensions: Sequence[Column]) -> Column:
    """The sum of dimensions of 0 to 10 each, at most 100."""
    bound = lambda d: F.greatest(dec("0"), F.least(dec("10"), F.round(dec(d), 2)))
    return F.least(dec("100"), reduce(lambda a, b: a + b, map(bound, dimensions))).cast("decimal(18,6)")


def first_action(pairs: Sequence[tuple[Column, str]], otherwise: Column) -> Column:
    """The action of the first condition that holds."""
    return reduce(lambda later, p: F.when(p[0], p[1]).otherwise(later), reversed(pairs), otherwise)
