"""Fixed table schemas."""

FEATURES = (
    "image_id string, dir string, name string, stem string, ext string, is_raw boolean, is_video boolean, "
    "width int, height int, file_size bigint, mtime timestamp, phash bigint, phash_r90 bigint, phash_r180 bigint, "
    "phash_r270 bigint, dhash bigint, brightness double, histogram array<double>, hist_entropy double, "
    "metadata_count int, exif_date timestamp_ntz, companions array<string>, hash_mode string"
)
VIDEO_FEATURES = (
    "path string, size bigint, mtime timestamp, phash bigint, duration double, frame_hashes array<bigint>"
)
TRACKED_FOLDERS = (
    "path string, drive_type string, volume_serial string, folder_fingerprint string, "
    "last_updated timestamp, file_count bigint"
)
GROUP_MEMBERS = "group_id string, image_id string, role string, is_series boolean, is_ambiguous boolean, in_series boolean"
OPS_MANIFEST = (
    "run_id string, type string, from_path string, to_path string, status string, group_id string, "
    "role string, renamed boolean"
)
GROUND_TRUTH = "kind string, label string, path string"
REVIEW_DECISIONS = "group_id string, image_id string, selected boolean"
SCAN_HISTORY = (
    "date timestamp, duration_s double, src_folder string, total_files bigint, `groups` bigint, "
    "duplicates bigint, dup_pct double, dry_run boolean, applied boolean"
)
