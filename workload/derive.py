"""Media feature tables derived from ``documents``; the same rules are written in SQL in :mod:`workload.oracle`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.config import Settings
from twinframe.functions.stats import histogram_entropy
from twinframe.operators.ranking import bit_total_sql, bit_totals
from twinframe.session import materialise

SETTINGS = Settings(low_entropy=2.0)  # the derived histograms have 12 bins, so at most ln 12 nats
ALTERNATING = 0x5555555555555555
CHANNELS = ["aeio", "ntsr", "ldhu"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def simhashes(docs: DataFrame, key: list[str], text: str, hashes: dict[str, int]) -> DataFrame:
    """One 64-bit SimHash per name in ``hashes`` (name to first md5 digit) for every key.

    A bit is set when more than half of the words have it. Counts combine map-side, so a long text is no hot spot.
    A table of few files is spread over the cores first, since hashing costs far more than moving the text.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores)
    words = docs.select(*key, F.explode(F.split(text, " ")).alias("w")).select(*key, F.md5("w").alias("m"))
    half = lambda at: F.conv(F.substring("m", at, 8), 16, 10).cast("long")
    longs = [F.shiftleft(half(d), 32).bitwiseOR(half(d + 8)).alias(n) for n, d in hashes.items()]
    sums = [c for n in hashes for c in bit_totals(F.col(n), f"{n}_")]
    totals = words.select(*key, *longs).groupBy(*key).agg(F.count(F.lit(1)).alias("words"), *sums)

    def assemble(name: str) -> Column:
        bits = (
            f"if({bit_total_sql(k, name + '_')} * 2 > words, shiftleft(1L, {k}), 0L)" for k in range(64)
        )
        return F.expr(" | ".join(bits)).alias(name)

    return totals.select(*key, *[assemble(n) for n in hashes])


def _letters(letter: str) -> Column:
    return F.length("text") - F.length(F.replace(F.col("text"), F.lit(letter)))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``features`` table of a document collection."""
    docs = table(spark, sf_dir, "documents")
    hashes = simhashes(docs, ["doc_id"], "text", {"phash": 1, "dhash": 17})
    counts = docs.select(
        "doc_id", "lang", "source", "n_chars", F.length("text").alias("len"),
        *[_letters(c).cast("double").alias(f"n_{c}") for ch in CHANNELS for c in ch],
    )
    df = counts.join(hashes, "doc_id")
    d = F.col("doc_id")
    flip = lambda c: c.bitwiseXOR(F.lit(ALTERNATING))
    ext = F.when((d % 10).isin(4, 8), ".cr2").when((d % 10).isin(3, 6), ".png").otherwise(".jpg")
    size = F.when(d % 7 == 0, 1920).when(d % 5 < 2, 6000).when(d % 5 == 2, 4000).when(d % 5 == 3, 3000).otherwise(1620)
    tall = F.when(d % 7 == 0, 1080).when(d % 5 < 2, 4000).when(d % 5 == 2, 6000).when(d % 5 == 3, 2000).otherwise(1080)
    bins = []
    for ch in CHANNELS:
        total = sum((F.col(f"n_{c}") for c in ch), F.lit(0.0))
        bins += [F.when(total > 0, F.col(f"n_{c}") / total).otherwise(F.lit(0.0)) for c in ch]
    minutes = (F.lit(1704067200) + d * 60).cast("long")
    df = df.withColumns({
        "ext": ext,
        "dir": F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang"),
        "stem": F.concat(F.lit("doc_"), d.cast("string")),
        "phash": F.when(d % 11 == 0, flip(F.col("phash"))).otherwise(F.col("phash")),
        "histogram": F.array(*bins),
        "mtime": F.timestamp_seconds(minutes),
    })
    df = df.withColumns({
        "name": F.concat("stem", "ext"),
        "image_id": F.concat("dir", F.lit("/"), "stem", "ext"),
        "is_raw": F.col("ext") == ".cr2",
        "is_video": F.lit(False),
        "width": size.cast("int"), "height": tall.cast("int"),
        "file_size": F.col("n_chars") * 1000 + d % 1000,
        "phash_r90": flip(F.col("phash")),
        "phash_r180": F.bitwise_not(F.col("phash")),
        "phash_r270": F.bitwise_not(flip(F.col("phash"))),
        "brightness": F.round(
            F.lit(255.0) * (F.col("n_a") + F.col("n_e") + F.col("n_i")) / F.greatest(F.col("len"), F.lit(1)), 6
        ),
        "hist_entropy": histogram_entropy(F.col("histogram")),
        "metadata_count": (d % 9).cast("int"),
        "exif_date": F.when(d % 3 != 0, F.col("mtime").cast("timestamp_ntz")),
        "companions": F.array().cast("array<string>"),
        "hash_mode": F.when(F.col("ext") == ".cr2", "embedded").otherwise(""),
        "side": F.when(F.col("source").rlike("^src[0-9]$"), "main").otherwise("check"),
        "root": F.concat(F.lit("/lib/"), "source"),
    })
    df = df.select(
        "image_id", "dir", "name", "stem", "ext", "is_raw", "is_video", "width", "height",
        F.col("file_size").cast("long").alias("file_size"), "mtime", "phash", "phash_r90", "phash_r180", "phash_r270",
        "dhash", "brightness", "histogram", "hist_entropy", "metadata_count", "exif_date", "companions", "hash_mode",
        "side", "root", "doc_id",
    )
    return df


_kept: dict[tuple, DataFrame] = {}


def kept_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`features`, written once per session and folder, as a catalogue would store it."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        _kept[key] = materialise(features(spark, sf_dir), "features")
    return _kept[key]
