"""Texts for people: sizes, durations, explanations of matches, bit maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names.
MATCH_NAMES = {"Exact": "Exact Match", "NearExact": "Near-Exact Match", "Similar": "Similar", "MaybeSimilar": "Maybe Similar"}
REASON_NAMES = {"in_root": "In root folder", "shallow_folder": "In shallow folder", "no_date_pattern": "Not in date folder", "generic_name": "Generic filename"}
KEEP_NAMES = {"HighestResolution": "Highest resolution", "LargestFileSize": "Largest file size (best quality)", "OriginalFormat": "Original format", "OldestTimestamp": "Oldest file (likely original)", "BestMetadata": "Most complete metadata", "FirstAlphabetically": "First alphabetically"}
ALGORITHM_NAMES = {"average": "aHash", "difference": "dHash", "perceptual": "pHash", "fusion": "fusion"}
CONFIDENCE_NAMES = {"High": "High (3/3)", "Medium": "Medium (2/3)", "Low": "Low (1/3)", "None": "No match"}
UNITS = ("KB", "MB", "GB")


def named(value: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value), value)


def byte_size(n: Column, small: str = "B") -> Column:
    """'1.5 MB'; below 1 KB whole bytes with the unit ``small``."""
    scaled = lambda power: F.format_string("%.1f " + UNITS[power - 1], F.bround(n / F.lit(float(1024**power)), 1))
    return F.when(n >= 1024**3, scaled(3)).when(n >= 1024**2, scaled(2)).when(n >= 1024, scaled(1)).otherwise(F.concat(n.cast("string"), F.lit(f" {small}")))


def byte_size_short(n: Column) -> Column:
    """As :func:`byte_size`, without a trailing '.0'."""
    return F.regexp_replace(byte_size(n), r"\.0 ", " ")


def _seconds(ms: Column) -> Column:
    """Seconds with one digit, as the binary fraction ``ms / 1000`` rounds: what is exactly half goes to the even digit."""
    tenths, rest = F.floor(ms / 100), ms % 100
    scaled = (ms / F.lit(1000.0) * F.lit(2.0**52)).cast("long") * 20  # exact below 64 seconds
    half = (2 * tenths + 1) * F.lit(1 << 52)
    up = (rest > 50) | ((rest == 50) & ((scaled > half) | ((scaled == half) & (tenths % 2 == 1))))
    rounded = tenths + up.cast("long")
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"), F.lit("s"))


def duration(ms: Column) -> Column:
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60000, _seconds(ms))
        .otherwise(F.concat(F.floor(ms / 60000).cast("string"), F.lit("m "), F.floor((ms % 60000) / 1000).cast("string"), F.lit("s")))
    )


def time_ago(now: Column, then: Column) -> Column:
    """Age of an epoch second in words; a week or older gives the date."""
    age = now - then
    part = lambda size, unit: F.concat(F.floor(age / size).cast("string"), F.lit(f"{unit} ago"))
    return F.when(age < 60, "Just now").when(age < 3600, part(60, "m")).when(age < 86400, part(3600, "h")).when(age < 604800, part(86400, "d")).otherwise(F.date_format(F.timestamp_seconds(then), "yyyy-MM-dd"))


def is_aged(now: Column, then: Column) -> Column:
    return now - then > 604800


def sensitivity(threshold: Column) -> Column:
    return F.when(threshold <= 3, "Surgical Precision").when(threshold <= 6, "Standard Balance").otherwise("Extended Similarity")


def match_summary(kind: Column, similarity: Column) -> Column:
    """One sentence on a match (fixed values)."""
    percent = F.concat(F.bround(similarity, 0).cast("long").cast("string"), F.lit("% match"))
    say = lambda before, after: F.concat(F.lit(before + " ("), percent, F.lit(")" + after))
    return (
        F.when(kind == "Exact", "These photos are identical")
        .when(kind == "NearExact", say("These photos are virtually identical", ""))
        .when(kind == "Similar", say("These photos are very similar", " - likely the same photo with different edits"))
        .otherwise(say("These photos might be related", " - please review carefully"))
    )


def match_details(kind: Column, distance: Column, bits: int = 64) -> Column:
    """What a match rests on: its class, and how many bits agree and differ."""
    agree = (F.lit(bits) - distance).cast("string")
    return F.concat(named(kind, MATCH_NAMES), F.lit(": "), agree, F.lit(" bits agree, "), distance.cast("string"), F.lit(f" of {bits} differ"))


def explain(distance: Column, kind: Column, similarity: Column, a: Column, b: Column, bits: int = 64) -> Column:
    return F.struct(match_summary(kind, similarity).alias("summary"), match_details(kind, distance, bits).alias("details"), distance.alias("distance"), F.lit(bits).alias("bits"), F.lower(F.hex(a)).alias("hash_a"), F.lower(F.hex(b)).alias("hash_b"))


def difference_map(a: Column, b: Column, side: int = 8) -> Column:
    """Rows of '.' (same bit) and 'X' (other bit), the lowest bit first."""
    bit = lambda i: F.when(F.shiftrightunsigned(a.bitwiseXOR(b), i).bitwiseAND(F.lit(1).cast("long")) == 1, "X").otherwise(".")
    return F.concat_ws("\n", *[F.concat(*[bit(r * side + c) for c in range(side)]) for r in range(side)])


def difference_summary(distance: Column, bits: int = 64) -> Column:
    return F.format_string(f"%d of {bits} bits differ (%.1f%% similar)", distance, F.bround(F.lit(100.0) - distance / F.lit(float(bits)) * 100.0, 1))


def similarity_bar(percent: Column) -> Column:
    filled = F.round(percent / 10).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(10) - filled), F.lit("] "), F.bround(percent, 0).cast("long").cast("string"), F.lit("%"))


def camera_name(make: Column, model: Column) -> Column:
    return F.when(make.isNull() | model.isNull(), F.coalesce(model, make)).when(F.startswith(model, make), model).otherwise(F.concat_ws(" ", make, model))


def dimensions_text(width: Column, height: Column) -> Column:
    return F.concat(width.cast("string"), F.lit("x"), height.cast("string"))


def megapixels(width: Column, height: Column) -> Column:
    return width.cast("double") * height / 1e6


def exif_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))


def lenient_date(text: Column) -> Column:
    """Date of a loosely written time stamp: quotes are dropped, ':' may stand for '-', the time is ignored."""
    first = F.regexp_extract(F.regexp_replace(F.trim(F.regexp_replace(text, '"', "")), ":", "-"), r"^([^ ]*)", 1)
    parts = [F.regexp_extract(first, r"^(\d{4})-(\d{1,2})-(\d{1,2})", g) for g in (1, 2, 3)]
    return F.try_to_date(F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")), "yyyy-MM-dd")


def per_second(n: Column, ms: Column) -> Column:
    """Items a second, 0 where no time has passed."""
    return F.when(ms > 0, n * 1000.0 / ms).otherwise(F.lit(0.0))


def progress_percent(done: Column, total: Column, start: float = 10.0, share: float = 70.0) -> Column:
    return F.when(total > 0, start + share * done / total).otherwise(F.lit(start))
