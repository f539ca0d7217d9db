"""Pair and member predicates as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinframe.config import Params
from twinframe.functions.hashing import hamming, rotation_distance
from twinframe.functions.stats import histogram_similarity


def trunc(x: Column) -> Column:
    """``int()`` of a value that is never negative."""
    return F.floor(x).cast("int")


def both(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def relative_gap(x: Column, y: Column) -> Column:
    """``|x - y|`` as a share of the larger; callers make sure the larger is above zero."""
    return F.abs(x - y) / F.greatest(x, y)


def same_dimensions(a: Column, b: Column, tolerance_pct: Column) -> Column:
    tol = tolerance_pct / 100.0
    known = both(*[s[c] > 0 for s in (a, b) for c in ("width", "height")])
    return F.when(
        known, (relative_gap(a["width"], b["width"]) <= tol) & (relative_gap(a["height"], b["height"]) <= tol)
    ).otherwise(F.lit(False))


def aspect_ratio(r: Column) -> Column:
    return F.when(r["height"] > 0, r["width"] / r["height"]).otherwise(F.lit(1.0))


def ratio_gap(x: Column, y: Column) -> Column:
    return F.abs(x - y) / F.greatest(x, y, F.lit(0.001))


class PairRule:
    """The layered similarity rule over two feature structs, with every guard open to inspection.

    ``similar`` is the decision; ``blocked_by`` names the first guard that rejects a pair. Both are made of
    the same sub-expressions, so a diagnosis never disagrees with a decision.
    """

    def __init__(self, a: Column, b: Column, p: Params):
        s = p.settings
        self.cross = a["is_raw"] != b["is_raw"]
        factor = F.when(self.cross, p.cross_format_threshold_factor).otherwise(F.lit(1.0))

        ra, rb = aspect_ratio(a), aspect_ratio(b)
        turned = F.when(rb > 0, ratio_gap(ra, F.try_divide(F.lit(1.0), rb))).otherwise(F.lit(1.0))
        self.ar_diff = F.least(ratio_gap(ra, rb), turned)
        self.ar_ok = self.ar_diff <= p.ar_tolerance_pct / 100.0

        if s.date_guard:
            stamp = lambda r: r["exif_date"].cast("timestamp").cast("double")
            gap = F.abs(stamp(a) - stamp(b))
            self.date_ok = ~self.cross | F.coalesce(gap <= s.date_guard_seconds, F.lit(True))
        else:
            self.date_ok = F.lit(True)

        self.brightness_diff = F.abs(a["brightness"] - b["brightness"])
        self.brightness_ok = self.brightness_diff <= p.brightness_max_diff * factor

        self.same_dims = same_dimensions(a, b, p.series_tolerance_pct)
        base = F.when(self.same_dims, trunc(p.threshold * p.series_threshold_factor)).otherwise(p.threshold)
        crossed = F.when(p.raw_use_embedded_thumb, F.least(base, F.lit(s.embedded_cap))).otherwise(
            F.greatest(base, trunc(F.lit(s.cross_base) * p.cross_format_threshold_factor))
        )
        thr = F.when(self.cross, crossed).otherwise(base)
        dark = p.dark_protection & ((a["brightness"] < p.dark_threshold) | (b["brightness"] < p.dark_threshold))
        thr = F.when(dark, F.greatest(F.lit(1), trunc(thr * p.dark_tighten_factor))).otherwise(thr)

        self.upright = hamming(a["phash"], b["phash"])
        self.low_entropy = F.coalesce(
            (a["hist_entropy"] < s.low_entropy) & (b["hist_entropy"] < s.low_entropy), F.lit(False)
        )
        self.dist = F.when(self.cross | self.low_entropy, self.upright).otherwise(rotation_distance(a, b))
        self.rotated = self.dist < self.upright
        floor = trunc(F.lit(s.rotation_base) * p.rotation_threshold_factor)
        self.threshold = F.when(self.rotated, F.greatest(thr, floor)).otherwise(thr)
        self.phash_ok = self.dist <= self.threshold

        self.dhash_dist = hamming(a["dhash"], b["dhash"])
        limit = self.threshold * F.lit(s.dhash_factor)
        over = (self.dhash_dist >= limit) if s.dhash_inclusive else (self.dhash_dist > limit)
        collapsed = (self.upright == 0) & self.low_entropy & (self.dhash_dist >= s.low_entropy_dhash)
        blocked = collapsed | ((self.upright > 0) & over)
        self.dhash_ok = ~(p.use_dual_hash & ~self.cross & ~self.rotated & blocked)

        known = p.use_histogram & (F.size(a["histogram"]) > 0) & (F.size(b["histogram"]) > 0)
        self.hist_sim = F.when(known, histogram_similarity(a["histogram"], b["histogram"]))
        floor_sim = F.when(self.cross, F.lit(s.cross_hist_floor)).otherwise(p.hist_min_similarity)
        self.hist_ok = F.coalesce(self.hist_sim >= floor_sim, F.lit(True))

    @property
    def similar(self) -> Column:
        """Cheap guards first: the conjunction short-circuits, so histograms are read last."""
        return both(self.ar_ok, self.date_ok, self.brightness_ok, self.phash_ok, self.dhash_ok, self.hist_ok)

    @property
    def similar_but_histogram(self) -> Column:
        """All guards that need no histogram: what passes is worth fetching one."""
        return both(self.ar_ok, self.date_ok, self.brightness_ok, self.phash_ok, self.dhash_ok)

    @property
    def blocked_by(self) -> Column:
        return (
            F.when(~self.ar_ok, "AR")
            .when(~self.date_ok, "date")
            .when(~self.brightness_ok, "brightness")
            .when(~self.phash_ok, "pHash")
            .when(~self.dhash_ok, "dHash")
            .when(~self.hist_ok, "histogram")
        )


def preview_of(member: Column, best: Column, p: Params) -> Column:
    """A copy of ``best`` with the same or swapped size, or clearly smaller on both sides."""
    same = (member["width"] == best["width"]) & (member["height"] == best["height"])
    swapped = (member["width"] == best["height"]) & (member["height"] == best["width"])
    # Written as 1 - (1 - ratio) so that borderline sizes round the same way.
    share = F.lit(1.0) - (F.lit(1.0) - p.preview_ratio)
    smaller = (member["width"] < best["width"] * share) & (member["height"] < best["height"] * share)
    sized = (best["width"] != 0) & (best["height"] != 0)
    return sized & (member["image_id"] != best["image_id"]) & (same | swapped | smaller)


def borderline_pair(a: Column, b: Column, p: Params) -> Column:
    """Close, but not close enough: between the threshold and its widened form. No rotated shapes."""
    dist = hamming(a["phash"], b["phash"])
    return both(
        ratio_gap(aspect_ratio(a), aspect_ratio(b)) <= p.ar_tolerance_pct / 100.0,
        F.abs(a["brightness"] - b["brightness"]) <= p.brightness_max_diff,
        dist > p.threshold,
        dist <= p.threshold * p.ambiguous_threshold_factor,
    )


def video_content_match(a: Column, b: Column, p: Params) -> Column:
    """Durations close and enough sampled frames alike. A frame missing on either side does not count."""
    s = p.settings
    longest = F.greatest(a["duration"], b["duration"])
    known = (a["duration"] > 0) & (b["duration"] > 0) & (longest >= 0.001)
    close = F.abs(a["duration"] - b["duration"]) / longest * 100 <= s.video_duration_pct
    hits = F.zip_with(
        a["frame_hashes"],
        b["frame_hashes"],
        lambda x, y: F.when(x.isNotNull() & y.isNotNull(), (hamming(x, y) <= s.video_frame_radius).cast("int")),
    )
    valid = F.size(F.filter(hits, lambda h: h.isNotNull()))
    matched = F.size(F.filter(hits, lambda h: h == 1))
    return F.coalesce(
        F.when(known & close & (valid > 0), matched / valid >= s.video_frame_ratio), F.lit(False)
    )
