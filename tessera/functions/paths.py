"""Path parts, file kinds and name predicates as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name extensions by use.
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "heic", "heif", "gif", "bmp", "tiff", "tif")
RAW_EXTENSIONS = ("arw", "cr2", "cr3", "nef", "dng", "raf", "orf", "rw2", "raw")
VIDEO_EXTENSIONS = ("mp4", "mov", "avi", "mkv", "wmv", "flv", "webm", "m4v")
LIBRARY_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "tif", "heic", "heif", "raw", "cr2", "nef", "dng", "arw", "raf", "mp4", "mov", "avi", "mkv", "wmv", "webm", "m4v")
LARGE_FILE_EXTENSIONS = (*LIBRARY_EXTENSIONS, "flv")
FORMATS = {"jpg": "Jpeg", "jpeg": "Jpeg", "png": "Png", "webp": "WebP", "heic": "Heic", "heif": "Heic", "gif": "Gif", "bmp": "Bmp", "tiff": "Tiff", "tif": "Tiff"}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; '' for names without one and for dot files."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def depth(relative_path: Column) -> Column:
    """How many folders lie between the root and the file."""
    return F.size(F.split(relative_path, "/")) - 1


def is_photo_name(path: Column, extensions: tuple[str, ...] = PHOTO_EXTENSIONS, include_hidden: bool = False) -> Column:
    ok = extension(path).isin(*[e.lower() for e in extensions])
    return ok if include_hidden else ok & ~file_name(path).startswith(".")


def in_hidden_folder(path: Column) -> Column:
    return path.rlike(r"(^|/)\.[^/]+/")


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    return extension(path).isin(*extensions)


def image_format(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("Unknown"))


def file_kind(path: Column) -> Column:
    """'image', 'video' or 'other'."""
    ext = extension(path)
    return F.when(ext.isin(*PHOTO_EXTENSIONS), "image").when(ext.isin(*VIDEO_EXTENSIONS), "video").otherwise("other")


def header_format(content: Column) -> Column:
    """Image format by the first bytes, null where they are no known image header."""
    at = lambda start, n: F.hex(F.substring(content, start, n))
    size = F.octet_length(content)
    brands = [b.encode().hex().upper() for b in ("heic", "heix", "mif1", "hevc")]
    found = (
        F.when(at(1, 3) == "FFD8FF", "Jpeg")
        .when(at(1, 8) == "89504E470D0A1A0A", "Png")
        .when(at(1, 4) == "47494638", "Gif")
        .when((size >= 12) & (at(1, 4) == "52494646") & (at(9, 4) == "57454250"), "WebP")
        .when((size >= 12) & (at(5, 4) == "66747970") & at(9, 4).isin(*brands), "Heic")
        .when(at(1, 2) == "424D", "Bmp")
        .when(at(1, 4).isin("49492A00", "4D4D002A"), "Tiff")
    )
    return F.when(size >= 8, found)


def is_safe_name(name: Column) -> Column:
    size = F.octet_length(name)
    return (size >= 1) & (size <= 255) & name.rlike(r"^[\p{L}\p{N} .\-_()\[\]]+$") & ~name.isin(".", "..")


def fold_home(path: Column, home: str) -> Column:
    return F.regexp_replace(path, "^" + re.escape(home.rstrip("/")) + "/", "~/")


def glob_pattern(query: str) -> str:
    """Unanchored, case-insensitive pattern of a search text: ``*`` and ``?`` are wild, all else is literal."""
    return "(?i)" + "".join({"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c == " " else "\\" + c) for c in query)


def matches_search(path: Column, query: str) -> Column:
    if "*" in query or "?" in query:
        return file_name(path).rlike(glob_pattern(query))
    return F.contains(F.lower(file_name(path)), F.lit(query.lower()))


def fuzzy_matches(text: Column, query: str) -> Column:
    """The characters of the query occur in order."""
    return F.lower(text).rlike(".*".join(c if c.isalnum() else "\\" + c for c in query.lower()))
