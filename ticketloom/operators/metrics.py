"""Evaluation as aggregates; every metric can be computed for all variants at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.config import CostSettings


def confusion_matrix(df: DataFrame, true: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(
        F.count("*").alias("n")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def classification_metrics(
    df: DataFrame, true: str, pred: str, labels: Sequence, keys: Sequence[str] = ()
) -> DataFrame:
    """Accuracy over all rows; macro and weighted scores over the given label list.

    A label that never occurs counts as 0.
    """
    keys = list(keys)
    confusion = confusion_matrix(df, true, pred, keys)
    same = F.col("true_label") == F.col("pred_label")
    zero = F.lit(0).cast("bigint")
    sides = F.explode(
        F.array(
            F.struct(
                F.col("true_label").alias("label"),
                F.when(same, F.col("n")).otherwise(zero).alias("tp"),
                F.col("n").alias("actual"),
                zero.alias("predicted"),
            ),
            F.struct(
                F.col("pred_label").alias("label"),
                zero.alias("tp"),
                zero.alias("actual"),
                F.col("n").alias("predicted"),
            ),
        )
    )
    per_label = (
        confusion.select(*keys, sides.alias("s"))
        .groupBy(*keys, "s.label")
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.actual").alias("actual"), F.sum("s.predicted").alias("predicted"))
    )
    listed = F.col("label").isin(list(labels))
    per_label = per_label.select(
        *keys,
        "tp",
        "actual",
        F.when(listed, F.col("actual")).otherwise(zero).alias("support"),
        F.when(listed, _ratio(F.col("tp"), F.col("predicted"))).otherwise(0.0).alias("p"),
        F.when(listed, _ratio(F.col("tp"), F.col("actual"))).otherwise(0.0).alias("r"),
        F.when(listed, _ratio(2 * F.col("tp"), F.col("predicted") + F.col("actual"))).otherwise(0.0).alias("f1"),
    )
    k = float(len(labels))
    return per_label.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("actual")).alias("accuracy"),
        (F.sum("f1") / k).alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        (F.sum("p") / k).alias("macro_precision"),
        (F.sum("r") / k).alias("macro_recall"),
    )


def escalation_metrics(
    df: DataFrame, true: str, pred: str, keys: Sequence[str] = (), costs: CostSettings = CostSettings()
) -> DataFrame:
    t, p = F.col(true), F.col(pred)
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(t & ~p).alias("false_auto_handle_count"),
        F.count_if(~t & p).alias("false_escalation_count"),
        F.count_if(~t & ~p).alias("true_auto_handle_count"),
        F.count_if(t & p).alias("true_escalation_count"),
    )
    fa, fe = F.col("false_auto_handle_count"), F.col("false_escalation_count")
    ta, te = F.col("true_auto_handle_count"), F.col("true_escalation_count")
    cost = fa * costs.false_auto_handle + fe * costs.false_escalation
    return counts.select(
        *keys,
        _ratio(ta + te, F.col("n")).alias("accuracy"),
        _ratio(te, te + fe).alias("precision"),
        _ratio(te, te + fa).alias("recall"),
        _ratio(2 * te, 2 * te + fa + fe).alias("f1"),
        fa.alias("false_auto_handle_count"),
        fe.alias("false_escalation_count"),
        ta.alias("true_auto_handle_count"),
        te.alias("true_escalation_count"),
        cost.alias("total_business_cost"),
        (cost / F.greatest(F.lit(1), F.col("n"))).alias("average_cost_per_ticket"),
    )


def reliability_table(df: DataFrame, confidence: str, correct: str, n_bins: int = 10) -> DataFrame:
    """``(bin, n, accuracy, confidence)`` for bins (lo, hi]; confidence 0 falls in none."""
    step = 1.0 / n_bins
    c = F.col(confidence)
    b = F.ceil(c / step)
    b = F.when(c <= (b - 1) * step, b - 1).when(c > b * step, b + 1).otherwise(b)
    return (
        df.filter(c > 0)
        .groupBy(b.cast("bigint").alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.avg(F.col(correct).cast("double")).alias("accuracy"),
            F.avg(c).alias("confidence"),
        )
    )


def calibration_error(df: DataFrame, confidence: str, correct: str, n_bins: int = 10) -> DataFrame:
    table = reliability_table(df, confidence, correct, n_bins)
    total = df.agg(F.count("*").alias("n")).scalar()
    gap = F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")
    return table.agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("gap")).select(
        (F.col("gap") / total).alias("ece")
    )


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``(n, agreement, kappa)``; kappa is null where chance agreement is 1."""
    pairs = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sides = F.explode(
        F.array(
            F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb"),
                     F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("same")),
            F.struct(F.col("b").alias("label"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb"),
                     F.lit(0).cast("bigint").alias("same")),
        )
    )
    margins = pairs.select(sides.alias("s")).groupBy("s.label").agg(
        F.sum("s.na").alias("na"), F.sum("s.nb").alias("nb"), F.sum("s.same").alias("same")
    )
    summed = margins.agg(
        F.sum("na").alias("n"),
        F.sum("same").alias("same"),
        F.sum(F.col("na").cast("double") * F.col("nb")).alias("cross"),
    )
    n = F.col("n").cast("double")
    po, pe = F.col("same") / n, F.col("cross") / (n * n)
    return summed.select(
        F.col("n"), po.alias("agreement"), ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa")
    )


def annotation_agreement(joined: DataFrame) -> DataFrame:
    """Agreement of golden and pre-label rows already joined on ``example_id``."""
    intent = cohen_kappa(joined, "ground_truth_intent", "llm_predicted_intent").select(
        F.lit(1).alias("_k"),
        F.col("n").alias("total_samples"),
        F.col("kappa").alias("intent_cohens_kappa"),
        F.col("agreement").alias("intent_percent_agreement"),
        F.round((1 - F.col("agreement")) * F.col("n")).cast("bigint").alias("human_corrections_count"),
    )
    escalation = cohen_kappa(joined, "ground_truth_escalate", "rule_escalate").select(
        F.lit(1).alias("_k"),
        F.col("kappa").alias("escalation_cohens_kappa"),
        F.col("agreement").alias("escalation_percent_agreement"),
    )
    return intent.join(escalation, "_k").drop("_k")


def gold_prelabel_join(gold: DataFrame, pre: DataFrame) -> DataFrame:
    """Inner join on ``example_id``; shared column names get ``_gold`` and ``_pre``."""
    shared = [c for c in gold.columns if c in pre.columns and c != "example_id"]
    left = gold.withColumnsRenamed({c: f"{c}_gold" for c in shared})
    right = pre.withColumnsRenamed({c: f"{c}_pre" for c in shared})
    return left.join(right, "example_id")


def judge_summary(scores: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Means of rubric scores over valid rows (all scores in 1..5), with the rejected count."""
    valid = F.lit(True)
    for c in columns:
        valid = valid & F.coalesce(F.col(c).between(1.0, 5.0), F.lit(False))
    return scores.groupBy(*keys).agg(
        F.count_if(valid).alias("n_valid"),
        F.count_if(~valid).alias("n_rejected"),
        *[F.avg(F.when(valid, F.col(c))).alias(f"avg_{c}") for c in columns],
    )


def variant_rollup(runs: DataFrame) -> DataFrame:
    """``(level, variant, true_intent, n, intent_accuracy, escalation_accuracy)`` for all sets of the two keys.

    ``level`` is ``total``, ``variant``, ``intent`` or ``both``; a null key at its own level is a null in the rows.
    """
    same = F.avg((F.col("true_intent") == F.col("pred_intent")).cast("double"))
    escalated = F.avg((F.col("true_escalate") == F.col("pred_escalate")).cast("double"))
    names = F.array(*map(F.lit, ("both", "variant", "intent", "total")))
    level = F.get(names, (2 * F.grouping("variant") + F.grouping("true_intent")).cast("int"))
    return runs.cube("variant", "true_intent").agg(
        level.alias("level"), F.count("*").alias("n"), F.round(same, 6).alias("intent_accuracy"), F.round(escalated, 6).alias("escalation_accuracy")
    )


def variant_comparison(
    runs: DataFrame, labels: Sequence, costs: CostSettings = CostSettings()
) -> DataFrame:
    """One row per variant from long-form runs of all variants.

    ``runs``: ``(variant, example_id, true_intent, pred_intent, true_escalate,
    pred_escalate, latency_ms, judge)``.  The judge mean is over all judged rows
    of a variant and falls back to 4.0.
    """
    intents = classification_metrics(runs, "true_intent", "pred_intent", labels, ["variant"])
    escalations = escalation_metrics(runs, "true_escalate", "pred_escalate", ["variant"], costs)
    latency = runs.groupBy("variant").agg(F.avg("latency_ms").alias("latency"))
    judge = runs.groupBy("variant").agg(F.avg("judge").alias("judge"))
    return (
        intents.select("variant", F.col("accuracy").alias("ia"), "macro_f1")
        .join(escalations, "variant")
        .join(latency, "variant")
        .join(judge, "variant", "left")
        .select(
            "variant",
            F.round("ia", 3).alias("intent_accuracy"),
            F.round("macro_f1", 3).alias("intent_macro_f1"),
            F.round("accuracy", 3).alias("escalation_accuracy"),
            F.round("precision", 3).alias("escalation_precision"),
            F.round("recall", 3).alias("escalation_recall"),
            F.col("false_auto_handle_count").alias("false_auto_handles"),
            F.col("false_escalation_count").alias("false_escalations"),
            F.round("total_business_cost", 2).alias("total_cost"),
            F.round("average_cost_per_ticket", 2).alias("avg_cost_per_ticket"),
            F.round("latency", 1).alias("avg_latency_ms"),
            F.round(F.coalesce("judge", F.lit(4.0)), 2).alias("judge_faithfulness"),
        )
    )
