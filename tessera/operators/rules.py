"""Rule classification of files: badly filed items and screenshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

# Patterns and names that the rules look for.
DATE_PATTERN = r"(?:19|20)\d{2}[-_/]?\d{0,2}[-_/]?\d{0,2}"
GENERIC_PATTERN = r"(?i)^(IMG|DSC|DCIM|P|DSCN|DSCF|SAM|MOV|VID|MVI|Screenshot|Screen Shot|Untitled|Photo|Image|Picture)[-_]?\d*"
REASON_PRIORITY = {"in_root": 4, "generic_name": 3, "shallow_folder": 2, "no_date_pattern": 1}
SCREENSHOT_NAMES = ("screenshot", "screen shot", "capture", "simulator screen shot", "cleanshot", "snagit", "monosnap", "skitch", "snip", "grab")
SCREENSHOT_SOFTWARE = ("screencaptureui", "grab", "screenshot", "snipping tool", "snip & sketch", "cleanshot", "snagit", "monosnap", "lightshot", "greenshot")
SCREEN_SIZES = ((1170, 2532), (1125, 2436), (1080, 2340), (750, 1334), (1242, 2688), (1284, 2778), (2048, 1536), (1024, 768), (2224, 1668), (2732, 2048), (1440, 900), (1680, 1050), (2560, 1600), (3440, 1440), (2560, 1440), (1920, 1080))


def unorganized_reasons(relative_path: Column, min_depth: int = 2, check_root: bool = True, check_dates: bool = True, check_names: bool = True) -> Column:
    """The reasons, in the order they are tested, why a path counts as badly filed; an empty array where none holds."""
    depth = paths.depth(relative_path)
    place = F.when((depth == 0) & F.lit(check_root), "in_root").when(depth < min_depth, "shallow_folder")
    dated = F.when(F.lit(check_dates) & ~relative_path.rlike(DATE_PATTERN), "no_date_pattern")
    named = F.when(F.lit(check_names) & paths.stem(relative_path).rlike(GENERIC_PATTERN), "generic_name")
    return F.array_compact(F.array(place, dated, named))


def unorganized_files(files: DataFrame, path_col: str = "path", **options) -> DataFrame:
    """Media files with at least one reason, as ``files`` with an array ``reasons``."""
    media = files.filter(paths.has_extension(F.col(path_col), paths.LIBRARY_EXTENSIONS))
    return media.withColumn("reasons", unorganized_reasons(F.col(path_col), **options)).filter(F.size("reasons") > 0)


def primary_reason(reasons: Column) -> Column:
    """The reason with the highest priority."""
    order = sorted(REASON_PRIORITY, key=REASON_PRIORITY.get, reverse=True)
    return F.coalesce(*[F.when(F.array_contains(reasons, r), F.lit(r)) for r in order])


def reason_summary(flagged: DataFrame, size_col: str = "size") -> DataFrame:
    """Files and bytes by reason; a file counts once for each of its reasons."""
    return flagged.select(F.explode("reasons").alias("reason"), F.col(size_col).alias("b")).groupBy("reason").agg(F.count("*").alias("files"), F.sum("b").alias("bytes"))


def screenshot_candidate(path: Column) -> Column:
    lowered = F.lower(paths.file_name(path))
    named = F.lit(False)
    for pattern in SCREENSHOT_NAMES:
        named = named | F.contains(lowered, F.lit(pattern))
    return named | (paths.extension(path) == "png")


def screenshot_verdict(path: Column, software: Column | None = None, width: Column | None = None, height: Column | None = None) -> Column:
    """``struct(confidence, reason)`` of the first rule that fires (software, name, screen size), else null."""
    verdict = lambda fires, confidence, reason: F.when(fires, F.struct(F.lit(confidence).alias("confidence"), reason.alias("reason")))
    name = F.lower(paths.file_name(path))
    first = F.get(F.filter(F.array(*map(F.lit, SCREENSHOT_NAMES)), lambda p: F.contains(name, p)), F.lit(0))
    rules = [verdict(first.isNotNull(), "Medium", F.concat(F.lit("Filename matches pattern: "), first))]
    if software is not None:
        tool = F.get(F.filter(F.array(*map(F.lit, SCREENSHOT_SOFTWARE)), lambda s: F.contains(F.lower(software), s)), F.lit(0))
        rules.insert(0, verdict(tool.isNotNull(), "High", F.concat(F.lit("Software: "), software)))
    if width is not None and height is not None:
        known = F.array(*[F.lit(min(s) * 100_000 + max(s)) for s in SCREEN_SIZES])
        fits = F.array_contains(known, (F.least(width, height) * 100_000 + F.greatest(width, height)).cast("int"))
        rules.append(verdict(width.isNotNull() & height.isNotNull() & fits, "Low", F.concat(F.lit("Screen size: "), width.cast("string"), F.lit("x"), height.cast("string"))))
    return F.coalesce(*rules)


def screenshots(files: DataFrame, path_col: str = "path", prefilter: bool = True) -> DataFrame:
    """Files that a screenshot rule accepts, with ``confidence`` and ``reason``.  Columns ``software``, ``width`` and
    ``height`` are used where ``files`` has them."""
    rows = files.filter(screenshot_candidate(F.col(path_col))) if prefilter else files
    extra = {c: F.col(c) if c in files.columns else None for c in ("software", "width", "height")}
    found = rows.withColumn("_verdict", screenshot_verdict(F.col(path_col), **extra)).filter("_verdict IS NOT NULL")
    return found.select(*files.columns, "_verdict.confidence", "_verdict.reason")
