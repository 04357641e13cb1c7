"""Release gates over a table of check results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.quality import count_rows

HARD = ("BLOCKER", "CRITICAL", "HIGH")
WEIGHTS, OTHER_WEIGHT = {"CRITICAL": 35, "HIGH": 20, "MEDIUM": 10, "LOW": 5}, 10


def _bad(status: str, layers: tuple[str, ...] | None = None, severities: tuple[str, ...] | None = None) -> Column:
    test = F.col("status") == status
    if layers:
        test = test & F.col("layer").isin(*layers)
    return test & F.col("severity").isin(*severities) if severities else test


def release_states(checks: DataFrame) -> DataFrame:
    """Six states with PASS or FAIL, the class that follows from them, and the counts behind it."""
    row = checks.agg(
        count_rows(_bad("FAIL", ("raw", "processed", "dashboard", "scoring"))).alias("technical"), count_rows(_bad("FAIL", ("impact", "scoring", "reporting", "dashboard"))).alias("analytical"), count_rows(_bad("FAIL", severities=HARD)).alias("hard_fail"),
        count_rows(_bad("FAIL", severities=HARD[:2])).alias("blocker_fail_count"), count_rows(_bad("FAIL", severities=HARD[2:])).alias("high_fail_count"), count_rows(_bad("WARN", severities=HARD)).alias("high_warn_count"),
    )
    valid = F.col("technical") == 0
    accepted = valid & (F.col("analytical") == 0) & (F.col("high_warn_count") == 0)
    blocked = ~valid | (F.col("hard_fail") > 0) | (F.col("high_warn_count") > 0)
    decided = F.when(blocked, "publish-blocked").when(accepted, "decision-support only").when(valid, "screening-grade only").otherwise("not-classified")
    states = {"technically_valid": valid, "analytically_acceptable": accepted, "decision_support_only": accepted, "screening_grade_only": valid & ~accepted, "not_committee_grade": F.lit(True), "publish_blocked": blocked}
    lines = F.array(*[F.struct(F.lit(k).alias("state_name"), F.when(v, "PASS").otherwise("FAIL").alias("status"), decided.alias("release_classification"), F.col("blocker_fail_count"), F.col("high_fail_count"), F.col("high_warn_count")) for k, v in states.items()])
    return row.select(F.inline(lines))


def confidence(checks: DataFrame) -> DataFrame:
    """100 less a weight for each failure and two fifths of it (rounded down) for each warning, and its band."""
    weight = F.coalesce(*[F.when(F.col("severity") == s, w) for s, w in WEIGHTS.items()], F.lit(OTHER_WEIGHT))
    loss = F.when(F.col("status") == "FAIL", weight).when(F.col("status") == "WARN", F.floor(weight * 0.4)).otherwise(0)
    score = checks.agg(F.greatest(100 - F.coalesce(F.sum(loss), F.lit(0)), F.lit(0)).cast("long").alias("confidence_score"))
    band = F.when(F.col("confidence_score") >= 90, "High").when(F.col("confidence_score") >= 75, "Moderate-High").when(F.col("confidence_score") >= 60, "Moderate").otherwise("Low")
    return score.withColumn("band", band)


def gate(checks: DataFrame) -> DataFrame:
    """Counts of results and whether publication is blocked; no result at all blocks too."""
    row = checks.agg(F.count(F.lit(1)).alias("checks"), count_rows(_bad("FAIL")).alias("fails"), count_rows(_bad("WARN")).alias("warns"), count_rows(F.col("status") != "PASS").alias("not_passed"), count_rows(_bad("FAIL", severities=HARD) | _bad("WARN", severities=HARD)).alias("blocking"))
    return row.withColumn("publish_blocked", (F.col("blocking") > 0) | (F.col("checks") == 0)).drop("blocking")
