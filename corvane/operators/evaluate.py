"""Evaluation of answers against references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.metrics import bertscore_f1, bleu, rouge_l

METRICS = ("Latency_ms", "Peak_Script_Memory_MB", "BLEU_Score", "ROUGE_L_F1", "BERTScore_F1")
REQUIRED = ("Question", "Answer")


def references(golden: DataFrame) -> DataFrame:
    """(Question, Reference_Answer) of a golden table, whose two columns are checked; a null answer is empty."""
    missing = [c for c in REQUIRED if c not in golden.columns]
    if missing:
        raise ValueError(f"columns missing from the questions: {', '.join(missing)}")
    return golden.select("Question", F.coalesce("Answer", F.lit("")).alias("Reference_Answer"))


def score_rows(rows: DataFrame, stemmed: bool = True) -> DataFrame:
    """rows with the three scores (ROUGE-L over stems unless told otherwise); where either answer is empty or the call failed they are 0. rows: (Reference_Answer, Generated_Answer, Status, ...)."""
    usable = (F.coalesce("Reference_Answer", F.lit("")) != "") & (F.coalesce("Generated_Answer", F.lit("")) != "") & (F.col("Status") == "Success")
    ref, cand = (F.when(usable, F.col(c)).otherwise("") for c in ("Reference_Answer", "Generated_Answer"))
    return rows.withColumns({"BLEU_Score": bleu(ref, cand), "ROUGE_L_F1": rouge_l(ref, cand, stemmed), "BERTScore_F1": bertscore_f1(ref, cand)})


def summary(scored: DataFrame) -> DataFrame:
    """One row: total, successes, and each metric's mean over the successes (zeros count, nulls don't; metrics that aren't there are left out)."""
    ok = F.col("Status") == "Success"
    means = [F.avg(F.when(ok, F.col(m))).alias(m) for m in METRICS if m in scored.columns]
    return scored.agg(F.count("*").alias("total"), F.count_if(ok).alias("successes"), *means)
