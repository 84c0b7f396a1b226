"""License state of accounts as of a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRACE_DAYS = 5  # fixed value


def entitlement(licenses: DataFrame, now: Column, grace_days: int = GRACE_DAYS) -> DataFrame:
    """Paid license first, with grace after the last check, then the trial."""
    active = F.coalesce(F.col("active"), F.lit(False))
    expires, trial = F.col("expires_at"), F.col("trial_ends_at")
    open_ended = active & expires.isNull()
    current = active & (now <= expires)
    grace_end = F.col("last_validated_at") + F.make_dt_interval(F.lit(grace_days))
    in_grace = active & F.coalesce(now <= grace_end, F.lit(False))
    on_trial = now <= trial
    state = (
        F.when(open_ended | current, "active").when(in_grace, "grace").when(active, "expired")
        .when(on_trial, "trial").when(trial.isNotNull(), "trial-expired").otherwise("none")
    )
    # The first number of whole days from now that reaches the end.
    left = {c: F.ceil((F.unix_seconds(F.col(c)) - F.unix_seconds(now)) / 86400.0).cast("int") for c in ("expires_at", "trial_ends_at")}
    days = (
        F.when(open_ended, F.lit(None).cast("int")).when(current, left["expires_at"]).when(in_grace, 0)
        .when(active, F.lit(None).cast("int")).when(on_trial, left["trial_ends_at"]).when(trial.isNotNull(), 0)
    )
    out = licenses.withColumns({"entitlement": state, "days_left": days})
    return out.withColumn("allowed", F.col("entitlement").isin("active", "grace", "trial"))
