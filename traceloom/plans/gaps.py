"""Trace errors, the gaps around them and the stretches free of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators import asof_join, ordered_scan, quantile_slices
from traceloom.operators.slices import DEFAULT_SLICE_ROWS, group_of
from traceloom.plans.distribution import TRACE_BEGIN
from traceloom.plans.ranges import timestamped_samples
from traceloom.session import materialise


def number_errors(
    errors: DataFrame, rows_per_slice: int = DEFAULT_SLICE_ROWS, keys: Sequence[str] = ()
) -> DataFrame:
    """Give the errors of each key an ``id`` from 0 in order of time, cpu and code; further ties follow a hash of all columns.

    Equal rows are counted before anything is ordered. Rows that share time, cpu and code are ranked among
    themselves in slices of the hash, so a burst of errors at one place is spread over many tasks.
    """
    place = [*keys, *[c for c in ("time", "cpu", "code") if c not in keys]]
    rows = errors.groupBy(*errors.columns).agg(F.count(F.lit(1)).alias("_rows"))
    rows = materialise(rows.withColumn("_hash", F.xxhash64(*errors.columns)), "errors")
    tie = F.shiftleft(F.coalesce("cpu", F.lit(0)).cast("long"), 32) + F.coalesce("code", F.lit(0))
    places = rows.groupBy(*place).agg(F.sum("_rows").alias("_here")).withColumn("_tie", tie)
    places = materialise(places, "error_places")
    upto = ordered_scan(
        places,
        "time",
        tie="_tie",
        keys=keys,
        sums={"_upto": "_here"},
        slices=quantile_slices(places, "time", rows_per_slice, keys=keys, tie="_tie"),
    ).select(*[F.col(c).alias(f"_{c}") for c in place], (F.col("_upto") - F.col("_here")).alias("_base"))
    within = ordered_scan(
        rows, "_hash", keys=place, sums={"_rank": "_rows"}, slices=quantile_slices(rows, "_hash", rows_per_slice)
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]
    last = F.col("_base") + F.col("_rank") - 1
    ids = F.explode(F.sequence(last - F.col("_rows") + 1, last))
    return within.join(upto, same).select(ids.alias("id"), *errors.columns)


def error_gaps(
    errors: DataFrame, samples: DataFrame, rows_per_slice: int = DEFAULT_SLICE_ROWS, keys: Sequence[str] = ()
) -> DataFrame:
    """Each error with the samples of its key just before, at and after its time.

    Neighbours are found among all samples; their ids and branch types come from the counted samples at
    those times, so several counted samples at one time give several rows. ``samples`` needs ``id``,
    ``time``, ``branch_type_name`` and the two counts.
    """
    group = group_of(keys).alias("_of")
    at = materialise(errors.select(group, "id", "time", "code", "msg"), "errors")
    seen = samples.select(group, "id", "time", "branch_type_name", "insn_count", "cyc_count")
    near = materialise(_neighbour_times(at, seen, rows_per_slice), "neighbours")
    wanted = near.select(
        "_of", F.explode(F.array("time", "next_sample_time", "prev_sample_time")).alias("time")
    ).distinct()
    around = materialise(seen.join(wanted, ["_of", "time"], "left_semi"), "around")
    exact = around.select("_of", "time", F.col("time").alias("matching_sample_time")).distinct()
    found = near.join(exact, ["_of", "time"], "left")
    found = found.withColumns(
        {
            "next_gap_duration": F.col("next_sample_time") - F.col("time"),
            "prev_gap_duration": F.col("time") - F.col("prev_sample_time"),
        }
    )
    counted = timestamped_samples(around)
    for name in ("next", "prev", "matching"):
        details = counted.select(
            "_of",
            F.col("time").alias(f"{name}_sample_time"),
            F.col("id").alias(f"{name}_sample_id"),
            F.col("branch_type_name").alias(f"{name}_branch_type"),
        )
        found = found.join(details, ["_of", f"{name}_sample_time"], "left")
    return found.select(
        *[F.col("_of")[k].alias(k) for k in keys],
        "id",
        "time",
        "code",
        "msg",
        "next_gap_duration",
        "prev_gap_duration",
        *[
            f"{name}_{column}"
            for name in ("next", "prev", "matching")
            for column in ("sample_time", "sample_id", "branch_type")
        ],
    )


def _neighbour_times(errors: DataFrame, samples: DataFrame, rows_per_slice: int) -> DataFrame:
    """Errors with the nearest strictly earlier and strictly later sample time, in one ordered scan.

    Times are doubled: an error asks from the odd places just before and just after its own time, so
    samples at the same time are on neither side.
    """
    none = F.lit(None).cast("long")
    place = F.col("time") * 2
    ask = F.array(
        F.struct((place - 1).alias("place"), (-1 - F.col("id") * 2).alias("tie")),
        F.struct((place + 1).alias("place"), (-2 - F.col("id") * 2).alias("tie")),
    )
    stream = samples.select(
        "_of", place.alias("place"), F.col("id").alias("tie"), F.col("time").alias("seen"), none.alias("error")
    ).unionByName(
        errors.select("_of", F.inline(ask), none.alias("seen"), F.col("id").alias("error"))
    )
    scanned = ordered_scan(
        stream,
        "place",
        tie="tie",
        keys=["_of"],
        last_known={"before": "seen"},
        next_known={"after": "seen"},
        slices=quantile_slices(stream, "place", rows_per_slice, keys=["_of"], tie="tie"),
    )
    # The lower place saw the earlier sample, the higher one the later.
    seen = scanned.filter("error is not null").groupBy("_of", F.col("error").alias("id")).agg(
        F.min_by("before", "place").alias("prev_sample_time"),
        F.max_by("after", "place").alias("next_sample_time"),
    )
    timed = F.col("time").isNotNull()
    return errors.join(seen, ["_of", "id"]).withColumns(
        {c: F.when(timed, F.col(c)) for c in ("prev_sample_time", "next_sample_time")}
    )


def errors_begin_one_to_one(errors: DataFrame, samples: DataFrame) -> DataFrame:
    """Errors without a trace begin at their time, and trace begins without an error; none if 1:1.

    Two anti-joins: matched pairs, which would all be thrown away, are never formed.
    """
    begins = samples.filter(F.col("branch_type_name") == TRACE_BEGIN).select("id", "time")
    lost = errors.join(begins.select("time"), "time", "left_anti")
    alone = begins.join(errors.select("time"), "time", "left_anti")
    none = F.lit(None).cast("long")
    return lost.select(
        F.col("time").alias("err_time"),
        none.alias("sample_time"),
        F.col("id").alias("err_id"),
        none.alias("sample_id"),
    ).unionByName(
        alone.select(
            none.alias("err_time"),
            F.col("time").alias("sample_time"),
            none.alias("err_id"),
            F.col("id").alias("sample_id"),
        )
    )


def error_free_ranges(samples: DataFrame, rows_per_slice: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """Stretches from each trace begin, and the first counted sample, to the last counted one before the next.

    The last stretch stays open: its end is NULL.
    """
    is_counted = F.coalesce((F.col("insn_count") > 0) | (F.col("cyc_count") > 0), F.lit(False))
    begins = F.coalesce(F.col("branch_type_name") == TRACE_BEGIN, F.lit(False))
    narrow = materialise(samples.select("id", "time", is_counted.alias("_counted"), begins.alias("_begins")), "times")
    counted = narrow.filter("_counted").select("id", "time")
    first_time, begin, end = narrow.agg(
        F.min(F.when(F.col("_counted"), F.col("time"))), F.min(F.when(F.col("time") > 0, F.col("time"))), F.max("time")
    ).first()
    begin, end = F.lit(begin).cast("long"), F.lit(end).cast("long")
    starts = (
        narrow.filter("_begins")
        .select("id", "time")
        .unionByName(counted.filter(F.col("time") == F.lit(first_time).cast("long")))
    )
    starts = materialise(starts, "starts")
    following = materialise(ordered_scan(starts, "id", leads={"next_time": "time"}), "starts")
    ended = asof_join(
        following.select(F.col("time").alias("start_time"), "next_time"),
        counted.withColumn("_newest", -F.col("id")),
        left_on="next_time",
        right_on="time",
        right_id="_newest",
        columns={"end_time": "time", "end_id": "id"},
        direction="backward",
        rows_per_slice=rows_per_slice,
    )
    start_times = starts.select("time").distinct()
    start_ids = (
        counted.join(start_times, "time", "left_semi").groupBy("time").agg(F.min("id").alias("start_id"))
    ).withColumnRenamed("time", "start_time")
    return ended.join(start_ids, "start_time", "left").select(
        (F.col("end_time") - F.col("start_time")).alias("duration"),
        "start_time",
        "end_time",
        "start_id",
        "end_id",
        (F.col("start_time") - begin).alias("time_after_start"),
        (end - F.col("end_time")).alias("time_to_end"),
    )


def top_error_free_ranges(stretches: DataFrame, count: int = 10) -> DataFrame:
    """The longest stretches."""
    return stretches.orderBy(F.col("duration").desc_nulls_last(), "start_time").limit(count)
