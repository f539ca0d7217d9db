"""Settings and fixed values."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Results must agree with these.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tiff", ".tif", ".gif", ".heic", ".heif"]
RAW_EXTENSIONS = [".cr2", ".cr3", ".nef", ".arw", ".dng", ".raf", ".orf", ".rw2", ".pef", ".srw", ".x3f", ".3fr"]
VIDEO_EXTENSIONS = [
    ".mp4", ".mov", ".avi", ".mkv", ".wmv", ".m4v", ".webm", ".flv", ".3gp", ".ts", ".mts", ".m2ts",
    ".mpg", ".mpeg", ".rm", ".rmvb", ".vob", ".divx", ".asf", ".f4v",
]
SIDECAR_EXTENSIONS = [".xmp", ".aae"]
SKIPPED_EXIF_TAGS = ["MakerNote", "UserComment", "PrintImageMatching"]
DEFAULT_SKIP_NAMES = [".thumbnails", "thumbs", "@eaDir", "Thumbs"]


@dataclass(frozen=True)
class Settings:
    """Every value that changes a result. Immutable; use :meth:`with_` for a variant."""

    # The defaults.

    threshold: int = 2
    preview_ratio: float = 0.90
    series_tolerance_pct: float = 0.0
    series_threshold_factor: float = 1.0
    ar_tolerance_pct: float = 5.0
    dark_protection: bool = True
    dark_threshold: float = 40.0
    dark_tighten_factor: float = 0.5
    use_dual_hash: bool = True
    use_histogram: bool = True
    hist_min_similarity: float = 0.70
    brightness_max_diff: float = 60.0
    cross_format_threshold_factor: float = 6.0
    rotation_threshold_factor: float = 3.0
    raw_use_embedded_thumb: bool = True
    disable_series_detection: bool = False
    keep_strategy: str = "pixels"
    keep_all_formats: bool = True
    sort_by_filename_date: bool = False
    sort_by_exif_date: bool = False
    min_dimension: int = 0
    recursive: bool = True
    ambiguous_detection: bool = False
    ambiguous_threshold_factor: float = 1.5
    max_group_size: int = 50
    video_use_thumb: bool = True
    video_match_format: bool = True
    video_match_size: bool = True
    video_match_content: bool = True
    # Expert values, fixed in the ordinary product.
    exact_radius: int = 2
    cross_size_tolerance: float = 0.02
    cross_base: int = 2
    embedded_cap: int = 3
    cross_hist_floor: float = 0.0
    rotation_base: int = 2
    low_entropy: float = 3.0
    low_entropy_dhash: int = 3
    dhash_factor: float = 1.0
    dhash_inclusive: bool = True
    date_guard: bool = True
    date_guard_seconds: int = 300
    video_thumb_radius: int = 8
    video_frame_radius: int = 10
    video_frame_ratio: float = 0.6
    video_duration_pct: float = 5.0

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)

    # -- radii: the widest Hamming distance the pair rule can accept, per class --

    def _dark(self, thr: int) -> int:
        return max(thr, 1, int(thr * self.dark_tighten_factor)) if self.dark_protection else thr

    @property
    def same_format_radius(self) -> int:
        return self._dark(max(self.threshold, int(self.threshold * self.series_threshold_factor)))

    @property
    def rotation_radius(self) -> int:
        return max(self.same_format_radius, int(self.rotation_base * self.rotation_threshold_factor))

    @property
    def cross_format_radius(self) -> int:
        thr = max(self.threshold, int(self.threshold * self.series_threshold_factor))
        if self.raw_use_embedded_thumb:
            return self._dark(min(thr, self.embedded_cap))
        return self._dark(max(thr, int(self.cross_base * self.cross_format_threshold_factor)))


# The settings a pair decision reads; a grid carries them as columns.
PAIR_FIELDS = [
    "threshold", "series_tolerance_pct", "series_threshold_factor", "ar_tolerance_pct", "dark_protection",
    "dark_threshold", "dark_tighten_factor", "use_dual_hash", "use_histogram", "hist_min_similarity",
    "brightness_max_diff", "cross_format_threshold_factor", "rotation_threshold_factor", "raw_use_embedded_thumb",
]
CLASSIFY_FIELDS = ["preview_ratio", "disable_series_detection"]


class Params:
    """Settings seen as Columns: literals for one configuration, ``cfg`` struct fields for a grid."""

    def __init__(self, settings: Settings, grid_column: str | None = None):
        self.settings = settings
        self.grid_column = grid_column

    def __getattr__(self, name: str) -> Column:
        if self.grid_column is not None and name in PAIR_FIELDS + CLASSIFY_FIELDS:
            return F.col(f"{self.grid_column}.{name}")
        return F.lit(getattr(self.settings, name))


class AtThreshold(Params):
    """The same settings under another threshold, given as a Column."""

    def __init__(self, params: Params, threshold: Column):
        super().__init__(params.settings, params.grid_column)
        self.threshold = threshold


def settings_grid(spark: SparkSession, combos: list[Settings], ids: list[int] | None = None) -> DataFrame:
    """One row per configuration: ``combo_id`` and a ``cfg`` struct. The caller lists them, so the size is known."""
    names = PAIR_FIELDS + CLASSIFY_FIELDS
    types = {f.name: f.type for f in fields(Settings)}
    sql = {"int": "int", "float": "double", "bool": "boolean", "str": "string"}
    ddl = "combo_id int, cfg struct<" + ",".join(f"{n}:{sql[types[n]]}" for n in names) + ">"
    kinds = {"int": int, "float": float, "bool": bool, "str": str}
    ids = ids if ids is not None else list(range(len(combos)))
    rows = [(i, tuple(kinds[types[n]](getattr(s, n)) for n in names)) for i, s in zip(ids, combos)]
    return spark.createDataFrame(rows, ddl)
