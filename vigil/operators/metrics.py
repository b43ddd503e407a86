"""Classifier evaluation over (label, score) columns.

Counts are single-pass conditional aggregates.  Rank-based measures (AUC,
ROC) need cumulative sums over the score order; they aggregate by distinct
score first and then use the chunked ordered scan, so no single task sees the
whole score range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.plans.ordered_scan import CHUNK, GID, UNB, chunk_prefix, sequence_within


def with_prediction(df: DataFrame, score: str = "score", threshold: float = 0.5, out: str = "prediction") -> DataFrame:
    """Class 1 when P(threat) > threshold (argmax of two probabilities)."""
    return df.withColumn(out, (F.col(score) > threshold).cast("int"))


def confusion_matrix(df: DataFrame, label: str = "is_threat", pred: str = "prediction") -> DataFrame:
    """Tn, fp, fn, tp in one row."""
    y, p = F.col(label), F.col(pred)
    return df.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def key_metrics(cm: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 with zero guards (from M12's row)."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    out = cm.select("*", ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * (p * r) / (p + r)).otherwise(F.lit(0.0)))


def classification_report(df: DataFrame, label: str = "is_threat", pred: str = "prediction") -> DataFrame:
    """Per class precision/recall/F1/support, accuracy, macro and weighted
    averages (sklearn layout, zero-division as 0)."""
    cm = confusion_matrix(df, label, pred)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))

    def div(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def f1(p, r):
        return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))

    p0, r0 = div(tn, tn + fn), div(tn, tn + fp)
    p1, r1 = div(tp, tp + fp), div(tp, tp + fn)
    s0, s1 = tn + fp, tp + fn
    n = s0 + s1
    rows = F.array(
        F.struct(F.lit("0").alias("class"), p0.alias("precision"), r0.alias("recall"), f1(p0, r0).alias("f1"),
                 s0.alias("support")),
        F.struct(F.lit("1").alias("class"), p1.alias("precision"), r1.alias("recall"), f1(p1, r1).alias("f1"),
                 s1.alias("support")),
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), div(tp + tn, n).alias("f1"), n.alias("support")),
        F.struct(F.lit("macro avg").alias("class"), ((p0 + p1) / 2).alias("precision"),
                 ((r0 + r1) / 2).alias("recall"), ((f1(p0, r0) + f1(p1, r1)) / 2).alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), div(p0 * s0 + p1 * s1, n).alias("precision"),
                 div(r0 * s0 + r1 * s1, n).alias("recall"),
                 div(f1(p0, r0) * s0 + f1(p1, r1) * s1, n).alias("f1"), n.alias("support")))
    return cm.select(F.inline(rows))


def _score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    return (df.groupBy(F.col(score).cast("double").alias("s"))
              .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))


def _cumulative(counts: DataFrame, descending: bool) -> DataFrame:
    """Inclusive running sums of pos/neg along the score order (chunked scan)."""
    key = F.lit(0).alias("_k")
    order_col = (-F.col("s")) if descending else F.col("s")
    base = counts.select(key, "s", "pos", "neg", order_col.alias("_o"))
    seq = sequence_within(base, "_k", ["_o"])
    pre = chunk_prefix(seq, "_k", {"cp": "pos", "cn": "neg"})
    w = Window.partitionBy("_k", CHUNK).orderBy(GID).rowsBetween(UNB, 0)
    return seq.join(pre, ["_k", CHUNK]).select(
        "s", "pos", "neg",
        (F.col("cp_before") + F.sum("pos").over(w)).alias("cum_pos"),
        (F.col("cn_before") + F.sum("neg").over(w)).alias("cum_neg"))


def auc_roc(df: DataFrame, label: str = "is_threat", score: str = "score") -> DataFrame:
    """Area under ROC with mid-ranks for ties:
    sum over distinct scores of pos * (neg below + neg at / 2) / (P * N)."""
    cum = _cumulative(_score_counts(df, label, score), descending=False)
    below = F.col("cum_neg") - F.col("neg")
    out = cum.agg(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)).alias("_u"),
                  F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return out.select(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_u") / (F.col("P") * F.col("N")))
                      .alias("auc"), F.col("P").alias("positives"), F.col("N").alias("negatives"))


def roc_curve(df: DataFrame, label: str = "is_threat", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, highest first;
    rates are cumulative counts at or above the threshold."""
    counts = _score_counts(df, label, score)
    totals = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum = _cumulative(counts, descending=True)
    p_tot, n_tot = totals.select("P").scalar(), totals.select("N").scalar()
    return cum.select(F.col("s").alias("threshold"),
                      (F.col("cum_neg") / F.greatest(F.lit(1), n_tot)).alias("fpr"),
                      (F.col("cum_pos") / F.greatest(F.lit(1), p_tot)).alias("tpr"))


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """M5: zero mean, unit population variance per column (global aggregates
    as scalar subqueries; a constant column maps to 0)."""
    out = df
    for c in cols:
        mean = df.select(F.avg(c)).scalar()
        sd = df.select(F.stddev_pop(c)).scalar()
        out = out.withColumn(f"{c}_z", F.when(sd > 0, (F.col(c) - mean) / sd).otherwise(F.lit(0.0)))
    return out


def class_balance(df: DataFrame, label: str = "is_threat") -> DataFrame:
    """Total rows, threats and threat percentage."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.sum(label).cast("long").alias("threats")) \
             .withColumn("threat_pct", F.lit(100.0) * F.col("threats") / F.greatest(F.lit(1), F.col("total")))


def overlap_analysis(df: DataFrame, label: str = "is_threat") -> DataFrame:
    """How label and single features overlap (five conditional counts)."""
    y = F.col(label)
    return df.agg(
        F.count_if((y == 1) & (F.col("files_accessed") < 100)).alias("threats_low_files"),
        F.count_if((y == 0) & (F.col("files_accessed") > 200)).alias("normals_high_files"),
        F.count_if((y == 1) & (F.col("foreign_ip") == 0)).alias("threats_local_ip"),
        F.count_if((y == 0) & (F.col("foreign_ip") == 1)).alias("normals_foreign_ip"),
        F.count_if((y == 0) & F.col("hour_of_day").isin(0, 1, 2, 3, 4, 5)).alias("late_night_normals"))
