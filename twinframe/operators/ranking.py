"""Keep order, and ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.config import Settings
from twinframe.functions.dates import filename_date
from twinframe.session import materialise


def epoch(ts: Column) -> Column:
    return ts.cast("timestamp").cast("double")


def keep_order(settings: Settings) -> Column:
    """A struct that sorts the copy to keep first. Ties end at ``image_id``, so the order is total."""
    raw_last = F.lit(0) if settings.keep_all_formats else F.when(F.col("is_raw"), 0).otherwise(1)
    if settings.keep_strategy == "oldest":
        sources = []
        if settings.sort_by_exif_date:
            sources.append(epoch(F.col("exif_date")))
        if settings.sort_by_filename_date:
            sources.append(epoch(filename_date(F.col("name"))))
        first = F.coalesce(*sources, epoch(F.col("mtime")))
    else:
        first = -(F.col("width").cast("long") * F.col("height")).cast("double")
    return F.struct(
        raw_last.alias("format"), first.alias("first"), (-F.col("file_size")).alias("size"), F.col("image_id")
    )


def rank_in_large_groups(df: DataFrame, group: str, order: str) -> DataFrame:
    """``rank`` from 0 by ``order`` within ``group``, for groups too large for one task.

    Rows are range-partitioned on (group, order), ranked inside each range, and shifted by the number of rows of
    the group in earlier ranges. The ranges are written once, so a retried task sees the same ones.
    """
    ranged = df.repartitionByRange(F.col(group), F.col(order)).withColumn("range_no", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    counts = ranged.groupBy(group, "range_no").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(group).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows")
    inside = Window.partitionBy(group, "range_no").orderBy(order)
    ranked = ranged.withColumn("inside", F.row_number().over(inside) - 1)
    return ranked.join(counts, [group, "range_no"]).withColumn("rank", F.col("before") + F.col("inside")).drop(
        "before", "inside", "range_no"
    )


def running_sum(df: DataFrame, order: str | list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before a row in ``order``, over the whole table and in no one task.

    Rows are range-partitioned on ``order``, summed inside each range, and shifted by the sums of earlier ranges.
    """
    order = [order] if isinstance(order, str) else order
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("range_no", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    # One row per range.
    sums = ranged.groupBy("range_no").agg(F.sum(value).alias("of_range"))
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("shift", F.coalesce(F.sum("of_range").over(earlier), F.lit(0))).drop("of_range")
    inside = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(sums, "range_no").withColumn(name, F.col("shift") + F.col("inside")).drop("shift", "inside", "range_no")


def bit_totals(hash_column: Column, name: str = "bits") -> list[Column]:
    """How many hashes of a group have each bit set: 32 sums, each counting bit k below and bit k + 32 above."""
    pair = F.lit((1 << 32) + 1)
    return [F.sum(F.shiftrightunsigned(hash_column, k).bitwiseAND(pair)).alias(f"{name}{k}") for k in range(32)]


def bit_total_sql(k: int, name: str = "bits") -> str:
    """The count of one bit out of :func:`bit_totals`, as SQL text (64 of these are quicker to parse than to build)."""
    return f"({name}{k} & 4294967295)" if k < 32 else f"shiftrightunsigned({name}{k - 32}, 32)"


def distance_to_all(hash_name: str, n: str) -> Column:
    """Sum of Hamming distances from one hash to ``n`` hashes, from their bit totals: linear, no pairs."""
    return F.expr(" + ".join(
        f"if(shiftright({hash_name}, {k}) & 1L = 1L, {n} - {bit_total_sql(k)}, {bit_total_sql(k)})" for k in range(64)
    ))


def group_medoids(members: DataFrame, group: list[str], order: Column) -> DataFrame:
    """The member with the smallest total distance per group; ties go to the first in ``order``."""
    totals = members.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *bit_totals(F.col("phash")))
    scored = members.join(totals, group).withColumn("total", distance_to_all("phash", "n"))
    best = scored.groupBy(*group).agg(F.min(F.struct("total", order.alias("order"), "image_id")).alias("m"))
    return best.select(*group, F.col("m.image_id").alias("medoid"))
