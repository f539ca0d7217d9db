"""Hand-made feature rows, and the pair rule as plain arithmetic."""

import datetime as dt
import math
import random

from twinframe.config import RAW_EXTENSIONS
from twinframe.schemas import FEATURES

FLAT = [1 / 32] * 96
NARROW = ([0.95] + [0.0] * 30 + [0.05]) * 3
EPOCH = dt.datetime(2024, 1, 1)


def signed(v):
    v &= (1 << 64) - 1
    return v - (1 << 64) if v >> 63 else v


def entropy(h):
    if not h:
        return None
    total = sum(h)
    return -sum(x / total * math.log(x / total) for x in h if x > 0) if total > 0 else 0.0


def row(path, phash=0, dhash=0, width=6000, height=4000, size=1000, brightness=120.0, hist=FLAT, rotations=None,
        exif=None, mtime=0, mode=""):
    name = path.rsplit("/", 1)[-1]
    ext = "." + name.rsplit(".", 1)[-1].lower()
    r = [None if x is None else signed(x) for x in (rotations or (None, None, None))]
    return dict(
        image_id=path, dir=path.rsplit("/", 1)[0], name=name, stem=name.rsplit(".", 1)[0], ext=ext,
        is_raw=ext in RAW_EXTENSIONS, is_video=False, width=width, height=height, file_size=size,
        mtime=EPOCH + dt.timedelta(seconds=mtime), phash=signed(phash), phash_r90=r[0], phash_r180=r[1],
        phash_r270=r[2], dhash=signed(dhash), brightness=float(brightness), histogram=list(hist),
        hist_entropy=entropy(hist), metadata_count=0, exif_date=exif, companions=[], hash_mode=mode,
    )


def frame(spark, rows):
    columns = [c.split()[0] for c in FEATURES.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], FEATURES)


def ham(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


def seven_way(a, b):
    out = [ham(a["phash"], b["phash"])]
    for r in ("phash_r90", "phash_r180", "phash_r270"):
        if b[r] is not None:
            out.append(ham(a["phash"], b[r]))
        if a[r] is not None:
            out.append(ham(a[r], b["phash"]))
    return min(out)


def similar(a, b, s):
    """The rule list, one rule after the other."""
    ra = a["width"] / a["height"] if a["height"] else 1.0
    rb = b["width"] / b["height"] if b["height"] else 1.0
    gaps = [abs(ra - rb) / max(ra, rb, 0.001)]
    gaps.append(abs(ra - 1 / rb) / max(ra, 1 / rb, 0.001) if rb else 1.0)
    if min(gaps) > s.ar_tolerance_pct / 100:
        return False
    cross = a["is_raw"] != b["is_raw"]
    if cross and a["exif_date"] and b["exif_date"]:
        if abs((a["exif_date"] - b["exif_date"]).total_seconds()) > 300:
            return False
    if abs(a["brightness"] - b["brightness"]) > s.brightness_max_diff * (s.cross_format_threshold_factor if cross else 1):
        return False
    tol = s.series_tolerance_pct / 100
    sides = [(a[c], b[c]) for c in ("width", "height")]
    same = all(x and y for x, y in sides) and all(abs(x - y) / max(x, y) <= tol for x, y in sides)
    thr = int(s.threshold * s.series_threshold_factor) if same else s.threshold
    if cross:
        thr = min(thr, 3) if s.raw_use_embedded_thumb else max(thr, int(2 * s.cross_format_threshold_factor))
    if s.dark_protection and min(a["brightness"], b["brightness"]) < s.dark_threshold:
        thr = max(1, int(thr * s.dark_tighten_factor))
    up = ham(a["phash"], b["phash"])
    hists = bool(a["histogram"]) and bool(b["histogram"])
    low = hists and a["hist_entropy"] < s.low_entropy and b["hist_entropy"] < s.low_entropy
    dist = up if cross or low else seven_way(a, b)
    if dist < up:
        thr = max(thr, int(2 * s.rotation_threshold_factor))
    if dist > thr:
        return False
    if s.use_dual_hash and not cross and dist == up:
        d = ham(a["dhash"], b["dhash"])
        if (up == 0 and low and d >= 3) or (up > 0 and d >= thr):
            return False
    if s.use_histogram and hists and not cross:
        return sum(map(min, a["histogram"], b["histogram"])) / 3 >= s.hist_min_similarity
    return True


def components(rows, s, rule=similar):
    """``image -> smallest image`` over all linked pairs."""
    parent = {r["image_id"]: r["image_id"] for r in rows}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    linked = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if rule(a, b, s):
                linked |= {a["image_id"], b["image_id"]}
                x, y = sorted((find(a["image_id"]), find(b["image_id"])))
                parent[y] = x
    return {x: find(x) for x in linked}


def random_rows(n, seed, centres=12, spread=4):
    """Rows around a few hashes, with every guard in play."""
    rng = random.Random(seed)
    bases = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(centres)]
    out = []
    for i in range(n):
        p, d = rng.choice(bases)
        for _ in range(rng.randint(0, spread)):
            p ^= 1 << rng.randrange(64)
        for _ in range(rng.randint(0, 3)):
            d ^= 1 << rng.randrange(64)
        turned = [p ^ 0x5555555555555555, p ^ 0xFFFFFFFFFFFFFFFF, p ^ 0xAAAAAAAAAAAAAAAA]
        if rng.random() < 0.2:
            p = rng.choice(turned)
        bins = [rng.random() ** 3 for _ in range(96)] if rng.random() < 0.5 else list(NARROW)
        hist = []
        for c in range(3):
            part = bins[32 * c:32 * c + 32]
            hist += [x / sum(part) for x in part]
        w, h = rng.choice([(6000, 4000), (4000, 6000), (3000, 2000), (5900, 4000), (1920, 1080), (4000, 4000), (0, 0)])
        out.append(row(
            f"/d/{i:05d}{rng.choice(['.jpg', '.jpg', '.png', '.cr2'])}", p, d, w, h, rng.randrange(1, 50),
            rng.choice([20.0, 35.0, 60.0, 110.0, 150.0]), hist if rng.random() < 0.9 else [],
            turned if rng.random() < 0.8 else None,
            EPOCH + dt.timedelta(seconds=rng.randrange(0, 900)) if rng.random() < 0.7 else None, i,
        ))
    return out
