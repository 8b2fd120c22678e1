"""Reports on duplicate groups: CSV, JSON, plain paths, HTML and console text."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wording
from ..tables import Workspace
from .keyed import Files

CSV_COLUMNS = ["Group ID", "Photo Path", "Is Representative", "Match Type", "Duplicate Size (bytes)"]


def csv_rows(groups: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """One row per group and member; the size is what dropping the member would free."""
    rows = members.join(groups.select("group_key", "match_type"), "group_key").join(files.select("id", "path", "size"), "id")
    freed = F.when(F.col("is_representative"), F.lit(0)).otherwise(F.col("size"))
    return rows.select(F.col("group_key").alias(CSV_COLUMNS[0]), F.col("path").alias(CSV_COLUMNS[1]), F.col("is_representative").alias(CSV_COLUMNS[2]), F.col("match_type").alias(CSV_COLUMNS[3]), freed.alias(CSV_COLUMNS[4]))


def json_rows(groups: DataFrame, members: DataFrame | None = None, files: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """JSON documents, one a line: a 'summary' if ``totals`` are given, a 'group' each with the displayed class, and a 'member'
    each if ``members`` are given, so that a group may have any number of them."""
    document = lambda kind, columns: F.to_json(F.struct(F.lit(kind).alias("kind"), *columns)).alias("value")
    shown = [wording.named(F.col(c), wording.MATCH_NAMES).alias(c) if c == "match_type" else F.col(c) for c in groups.columns]
    out = groups.select(document("group", shown))
    if totals is not None:
        out = totals.select(document("summary", totals.columns)).union(out)
    if members is not None:
        rows = members.join(files.select("id", "path", "size"), "id")
        out = out.union(rows.select(document("member", ["group_key", "path", "size", "is_representative"])))
    return out


def first_members(members: DataFrame, files: DataFrame, shown: int = 3) -> DataFrame:
    """Rows ``(group_key, id, path, place)``: per group the first ``shown`` members in the order of their paths."""
    w = Window.partitionBy("group_key").orderBy("path", "id")
    rows = members.join(files.select("id", "path"), "id").withColumn("place", F.row_number().over(w))
    return rows.filter(F.col("place") <= shown).select("group_key", "id", "path", "place")


def ordered_members(members: DataFrame, files: DataFrame) -> DataFrame:
    """Rows ``(group_key, path, is_representative)`` by group and path."""
    return members.join(files.select("id", "path"), "id").select("group_key", "path", "is_representative").orderBy("group_key", "path")


def duplicates_only(members: DataFrame, files: DataFrame) -> DataFrame:
    return members.filter(~F.col("is_representative")).join(files.select("id", "path"), "id").select(F.col("path").alias("value"))


def export(groups: DataFrame, members: DataFrame, files: DataFrame, path: str, format: str, totals: DataFrame | None = None) -> tuple[str, str, int]:
    """Writes 'csv', 'json', 'paths' or 'html' (which needs ``totals``) into the folder ``path``, on any file system that Spark knows;
    returns (path, format, number of groups)."""
    if format == "csv":
        csv_rows(groups, members, files).write.mode("overwrite").option("header", True).csv(path)
    elif format == "json":
        json_rows(groups, members, files, totals).write.mode("overwrite").text(path)
    elif format == "paths":
        duplicates_only(members, files).write.mode("overwrite").text(path)
    elif format == "html":
        write_html(groups, members, files, totals, path, path.rstrip("/").rpartition("/")[2])
    else:
        raise ValueError("format must be 'csv', 'json', 'paths' or 'html'")
    return path, format, groups.count()


def _size(n: int) -> str:
    for unit, power in (("GB", 3), ("MB", 2), ("KB", 1)):
        if n >= 1024**power:
            return f"{n / 1024**power:.1f} {unit}"
    return f"{n} B"


def _frame(title: str, back: str | None = None) -> tuple[str, str]:
    """What begins and what ends a page."""
    link = f"<p><a href='{back}'>All pages</a></p>" if back else ""
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{link}", "</body></html>"


def html_lines(rows: DataFrame, title: str) -> DataFrame:
    """Rows ``value``: the lines of one page for each partition of ``rows``, which are sorted by group within it."""
    begin, end = _frame(title, "../index.html")

    def page(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, started = None, False
        for frame in frames:
            lines = []
            for r in frame.itertuples(index=False):
                if not started:
                    lines.append(begin + "<ul>")
                if not started or r.group_key != last:
                    last, started = r.group_key, True
                    lines.append(f'</ul><h2 class="{html.escape(r.match_type.lower())}">{html.escape(wording.MATCH_NAMES.get(r.match_type, r.match_type))}, {_size(int(r.duplicate_bytes))}</h2><ul>')
                lines.append(f"<li>{html.escape(r.path)}{' <b>KEEP</b>' if r.is_representative else ''}</li>")
            yield pd.DataFrame({"value": lines})
        if started:
            yield pd.DataFrame({"value": ["</ul>" + end]})

    return rows.mapInPandas(page, "value string")


def write_html(groups: DataFrame, members: DataFrame, files: DataFrame, totals: DataFrame, path: str, title: str, rows_per_page: int = 20_000) -> int:
    """Writes a report into the folder ``path`` on any file system: ``index.html`` with the totals, and pages of about
    ``rows_per_page`` files; returns the number of pages.

    All members of all groups are listed, by reclaimable bytes; a group that is longer than a page goes on on the next one.  The
    executors write the pages, and the driver gives them their names and writes the index at last, so a folder with an index
    is a whole report.  All texts are escaped; files without a path are listed by their id.
    """
    spark, store = groups.sparkSession, Files(groups.sparkSession, path)
    named = files.select("id", F.coalesce(F.col("path"), F.col("id").cast("string")).alias("path"))
    rows = members.join(groups.select("group_key", "match_type", F.coalesce("duplicate_bytes", F.lit(0)).alias("duplicate_bytes")), "group_key").join(named, "id")
    rows = Workspace(spark, "report").save(rows.select("group_key", "match_type", "duplicate_bytes", "path", "is_representative"), "rows")
    order = [F.desc("duplicate_bytes"), "group_key", "path"]
    dealt = rows.repartitionByRange(max(1, -(-rows.count() // rows_per_page)), *order).sortWithinPartitions(*order)
    store.delete("index.html")
    html_lines(dealt, title).write.mode("overwrite").text(f"{path.rstrip('/')}/pages")
    pages = []
    for name in store.names("pages"):
        if name.startswith("part-") and store.size(f"pages/{name}"):
            pages.append(f"pages/page-{len(pages) + 1:05d}.html")
            store.rename(f"pages/{name}", pages[-1])
        else:
            store.delete(f"pages/{name}")
    s, (begin, end) = totals.first(), _frame(title)
    stats = "".join(f"<div><b>{value}</b> {label}</div>" for value, label in ((s.groups, "Duplicate Groups"), (s.duplicates, "Duplicate Photos"), (_size(s.savings_bytes), "Potential Savings")))
    links = "".join(f"<li><a href='{p}'>Page {i}</a></li>" for i, p in enumerate(pages, 1))
    store.write("index.html", f"{begin}{stats}<ul>{links}</ul>{end}")
    return len(pages)


def console_text(summary: DataFrame, groups: DataFrame, shown: int = 20, members: DataFrame | None = None, files: DataFrame | None = None, home: str | None = None) -> str:
    """The totals and the first ``shown`` groups by reclaimable bytes; with ``members``, the first ten paths of each, ``home``
    written as '~'."""
    s = summary.first()
    lines = [f"{s.files} files, {s.groups} groups, {s.duplicates} duplicates, {_size(s.savings_bytes)} reclaimable"]
    top = groups.orderBy(F.desc("duplicate_bytes"), "group_key").limit(shown)
    paths_of: dict = {}
    if members is not None:
        for r in first_members(members.join(F.broadcast(top.select("group_key")), "group_key"), files, 10).orderBy("group_key", "place").collect():
            paths_of.setdefault(r.group_key, []).append(f"    ~{r.path[len(home) :]}" if home and r.path.startswith(home) else f"    {r.path}")
    for r in top.collect():
        lines += [f"  {r.group_key}: {r['size']} files, {r.match_type}, {_size(r.duplicate_bytes)}", *paths_of.get(r.group_key, [])]
    return "\n".join(lines)


def sorted_groups(groups: DataFrame, mode: str) -> DataFrame:
    """Groups by 'size' (bytes), 'count' or 'type' (strongest class first)."""
    from ..functions.signatures import match_ordinal

    order = {"size": F.desc("duplicate_bytes"), "count": F.desc("size"), "type": match_ordinal(F.col("match_type")).asc()}[mode]
    return groups.orderBy(order, "group_key")


def of_kind(groups: DataFrame, kind: str) -> DataFrame:
    """'exact', 'near' or 'similar'; the last takes both similar classes."""
    return groups.filter({"exact": F.col("match_type") == "Exact", "near": F.contains("match_type", F.lit("Near")), "similar": F.contains("match_type", F.lit("Similar"))}[kind])


def master_summary(*modules: tuple[str, DataFrame, str, str | None]) -> DataFrame:
    """One row per module ``(module, items, bytes)`` and a total row, from (name, rows, item column, byte column)."""
    parts = [rows.agg(F.count(item).alias("items"), (F.coalesce(F.sum(size), F.lit(0)) if size else F.lit(0)).cast("long").alias("bytes")).select(F.lit(name).alias("module"), "items", "bytes") for name, rows, item, size in modules]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.unionByName(union.agg(F.sum("items").alias("items"), F.sum("bytes").alias("bytes")).select(F.lit("total").alias("module"), "items", "bytes"))
