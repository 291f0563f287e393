"""Nearest-in-time (as-of) correlation within a tolerance window.

Spark has no public as-of join and a plain ``abs(t1 - t2) <= w`` join plans as a
nested loop.  ``nearest_within`` is exact and linear, and no group it forms grows
with data volume:

1. Both sides together are reduced to one row per instant and key in one
   aggregation (partial, skew-safe): on the right side the row with the smallest id
   wins an instant, which is exactly the (diff, time, id) tie-break.
2. Instants are bucketed twice: a fine bucket of width ``g = ceil(w / 1024)``
   and a coarse bucket of 1024 fine buckets (width >= w).
3. For every left instant the nearest right instant before and after it is the
   best of:  (a) its own fine bucket (two windows over one fine bucket, one in each
   direction, so that both take the last value of a growing frame), (b) the other fine buckets of its coarse bucket (a
   window over at most 1024 fine-bucket summaries), (c) the last / first
   instant of the neighbouring coarse buckets.  Each level's summaries come out
   of the level below it, so the rows are read and keyed once.
   Anything farther is more than ``w`` away.
4. The winning candidate is kept when ``diff <= w`` and joined back to the left
   rows on (key, instant); AQE's skew join splits a hot instant.

No pairs are emitted and nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.scalar import is_camera_source, parse_timestamp, to_micros

FINE_PER_COARSE = 1024

# Fixed claim text of a temporal correlation.
CLAIM_TEMPORAL = "temporal_cooccurrence_only"


def window_seconds(minutes: int | float = 15) -> int:
    """Correlation window in seconds: max(1, minutes) * 60."""
    return int(max(1, int(minutes)) * 60)


def nearest_within(
    left: DataFrame,
    right: DataFrame,
    *,
    key: str,
    left_us: str,
    right_id: str,
    right_us: str,
    window_us: int,
    right_cols: tuple[str, ...] = (),
    prefix: str = "match_",
) -> DataFrame:
    """Left rows + nearest right row of the same key within ``window_us``.

    Adds ``{prefix}id``, ``{prefix}us``, ``{prefix}diff_us`` and one column per
    ``right_cols`` (all null when there is no right row within the window or the
    left time is null).  Ties break on (diff, right time, right id).
    """
    w = int(window_us)
    g = max(1, -(-w // FINE_PER_COARSE))

    obs_fields = [F.col(right_id).alias("rid")] + [F.col(c).alias(f"rc_{i}") for i, c in enumerate(right_cols)]
    r = right.where(F.col(right_us).isNotNull()).select(
        F.col(key).alias("k"), F.col(right_us).alias("t"), F.struct(*obs_fields).alias("obs"))
    none = F.lit(None).cast(r.schema["obs"].dataType)
    lk = left.where(F.col(left_us).isNotNull()).select(F.col(key).alias("k"), F.col(left_us).alias("t"), none.alias("obs"))
    both = r.withColumn("is_left", F.lit(False)).unionByName(lk.withColumn("is_left", F.lit(True)))

    # One row per instant of either side; the smallest right id wins an instant.
    instants = both.groupBy("k", "t").agg(F.min("obs").alias("obs"), F.max("is_left").alias("is_left")).select(
        "k", "t", "is_left", F.floor(F.col("t") / g).alias("f"),
        F.when(F.col("obs").isNotNull(), F.struct(F.col("t").alias("t"), F.col("obs").alias("obs"))).alias("c"))

    # (a) within the own fine bucket, and that bucket's first and last right instant.
    wk = Window.partitionBy("k", "f")
    wf, back = wk.orderBy("t"), wk.orderBy(F.desc("t"))
    so_far = lambda c, w, end: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end))
    u = instants.select(
        "k", "t", "f", "is_left",
        so_far("c", wf, Window.currentRow).alias("prior_in"), so_far("c", back, Window.currentRow).alias("next_in"),
        F.max("c").over(wk).alias("last_f"), F.min("c").over(wk).alias("first_f"), F.row_number().over(wf).alias("n"))

    # (b) other fine buckets of the same coarse bucket, from one row per fine bucket, and
    #     that coarse bucket's first and last right instant.
    fine = u.where("n = 1").select("k", "f", F.floor(F.col("f") / FINE_PER_COARSE).alias("cb"), "last_f", "first_f")
    wb = Window.partitionBy("k", "cb")
    wc, wd = wb.orderBy("f"), wb.orderBy(F.desc("f"))
    fine = fine.select(
        "k", "f", "cb",
        so_far("last_f", wc, -1).alias("prev_fine"), so_far("first_f", wd, -1).alias("next_fine"),
        F.max("last_f").over(wb).alias("last_c"), F.min("first_f").over(wb).alias("first_c"), F.row_number().over(wc).alias("n"))
    # (c) neighbouring coarse buckets: one row per coarse bucket tells both neighbours.
    side = lambda cb, prev, next_: F.struct(cb.alias("cb"), prev.alias("prev_coarse"), next_.alias("next_coarse"))
    blank = F.lit(None).cast(u.schema["last_f"].dataType)
    around = fine.where("n = 1").select("k", F.explode(F.array(
        side(F.col("cb") + 1, F.col("last_c"), blank), side(F.col("cb") - 1, blank, F.col("first_c")))).alias("s")).groupBy(
        "k", F.col("s.cb").alias("cb")).agg(F.max("s.prev_coarse").alias("prev_coarse"), F.max("s.next_coarse").alias("next_coarse"))
    fs = fine.select("k", "f", "cb", "prev_fine", "next_fine").join(around, ["k", "cb"], "left").drop("cb")
    u = u.where("is_left").select("k", "t", "f", "prior_in", "next_in")

    best = u.join(fs, ["k", "f"], "left")
    t = F.col("t")

    def scored(c: str) -> Column:
        return F.when(
            F.col(c).isNotNull(),
            F.struct(F.abs(t - F.col(c)["t"]).alias("diff"), F.col(c)["t"].alias("rt"), F.col(c)["obs"].alias("obs")),
        )

    cands = ["prior_in", "next_in", "prev_fine", "next_fine", "prev_coarse", "next_coarse"]
    best = best.select("k", "t", F.least(*[scored(c) for c in cands]).alias("b")).where(F.col("b.diff") <= w)

    out_cols = [
        F.col("b.obs.rid").alias(f"{prefix}id"),
        F.col("b.rt").alias(f"{prefix}us"),
        F.col("b.diff").alias(f"{prefix}diff_us"),
    ] + [F.col(f"b.obs.rc_{i}").alias(f"{prefix}{c}") for i, c in enumerate(right_cols)]
    best = best.select(F.col("k").alias("_nk"), F.col("t").alias("_nt"), *out_cols)
    joined = left.join(
        best, (left[key] == best["_nk"]) & (left[left_us] == best["_nt"]), "left"
    )
    return joined.drop("_nk", "_nt")


def with_instant(evidence: DataFrame, text_col: str = "occurred_at", out: str = "occurred_us") -> DataFrame:
    """Add epoch microseconds parsed from ISO text (null when unparseable)."""
    return evidence.withColumn(out, to_micros(parse_timestamp(F.col(text_col))))


def nearest_observation(evidence: DataFrame, window_minutes: int = 15) -> DataFrame:
    """System records matched to the nearest observation of the same store.

    One row per corroborated system record: ids, difference and the fixed
    claim; uncorroborated records are absent (see ``corroboration_coverage``).
    """
    ev = with_instant(evidence.select("id", "store_id", "kind", "occurred_at"))
    sys_ = ev.where(F.col("kind") == "system_record")
    obs = ev.where(F.col("kind") == "observation")
    m = nearest_within(
        sys_, obs, key="store_id", left_us="occurred_us", right_id="id", right_us="occurred_us",
        window_us=window_seconds(window_minutes) * 1_000_000,
    ).where(F.col("match_id").isNotNull())
    return m.select(
        "store_id",
        F.col("id").alias("system_record_id"),
        F.col("match_id").alias("observation_id"),
        F.col("match_diff_us").alias("time_difference_us"),
        (F.col("match_diff_us") / F.lit(1_000_000.0)).alias("time_difference_seconds"),
        F.lit(CLAIM_TEMPORAL).alias("claim"),
        F.lit(False).alias("verified"),
    )


def nearest_camera(events: DataFrame, evidence: DataFrame, window_minutes: int = 15) -> DataFrame:
    """Events + nearest camera observation (kind observation, camera-like source)."""
    ev = with_instant(events, out="event_us")
    cams = with_instant(
        evidence.where((F.col("kind") == "observation") & is_camera_source(F.col("source"))).select(
            "id", "store_id", "occurred_at"
        )
    )
    m = nearest_within(
        ev, cams, key="store_id", left_us="event_us", right_id="id", right_us="occurred_us",
        window_us=window_seconds(window_minutes) * 1_000_000, prefix="camera_",
    )
    return m.withColumnRenamed("camera_id", "camera_observation_id").withColumn(
        "camera_time_difference_seconds", F.col("camera_diff_us") / F.lit(1_000_000.0)
    )
