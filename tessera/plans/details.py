"""Registered queries of the smaller operators: lookups, stored history, lists, labels and texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import codecs, paths, wording
from ..functions import signatures as S
from ..operators import groups as G
from ..operators import report, simjoin, stores
from ..sources import files as sources
from ..tables import shared_root
from . import proxies
from .catalog import _GROUPS, FILES, _grouped, _pairs, query
from .proxies import table

_MODIFIED = "make_timestamp((id * 3601) * 1000000)"


@query(f"""WITH {FILES} SELECT path, name AS filename, size, strftime({_MODIFIED}, '%Y-%m-%d %H:%M') AS modified, CAST(CASE WHEN id % 2 = 1 THEN 4000 END AS INTEGER) AS width, CAST(CASE WHEN id % 2 = 1 THEN 3000 END AS INTEGER) AS height
FROM parts WHERE path = 'photos/DSC_151.PNG'""")
def file_info(spark, d):
    files = proxies.files(spark, d)
    known = files.filter("id % 2 = 1").select("path", F.lit(4000).alias("width"), F.lit(3000).alias("height"))
    return sources.file_info(files.withColumn("modified", F.timestamp_seconds(F.col("id") * 3601)), known, "photos/DSC_151.PNG")


def _history(spark, d):
    """The events as scans in a stored history: each user's scans replace the ones before."""
    e = table(spark, d, "events")
    none = lambda kind: F.lit(None).cast(kind)
    zero = lambda name: F.lit(0).cast("long").alias(name)
    scans = e.select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("module"), F.col("ts").cast("timestamp").alias("scan_time"), zero("duration_ms"), F.col("event_id").alias("total_files"), zero("groups"), zero("duplicates"), zero("savings_bytes"), F.lit("completed").alias("status"), none("string").alias("error"), none("string").alias("settings"), none("array<string>").alias("paths"))
    store = stores.scan_history(spark, f"{shared_root(spark)}/tessera-history-{uuid.uuid4().hex}")
    for part in range(2):
        store.upsert(scans.filter(F.col("total_files") % 2 == part))
    return store


_LAST = "SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS id, event_type AS module, (epoch_us(ts) // 1000) AS ms, event_id AS total_files, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1"


@query(f"SELECT id, module, ms, total_files FROM ({_LAST})")
def history_upsert(spark, d):
    return _history(spark, d).read().select("id", "module", F.unix_millis("scan_time").alias("ms"), "total_files")


@query(f"SELECT id, module, ms, total_files FROM ({_LAST}) WHERE module <> 'view'")
def history_delete(spark, d):
    store = _history(spark, d)
    store.remove(store.read().filter("module = 'view'"))
    return store.read().select("id", "module", F.unix_millis("scan_time").alias("ms"), "total_files")


@query(f"SELECT id, module, ms, total_files FROM ({_LAST}) WHERE id IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'purchase' AND value > 50)")
def history_lookup(spark, d):
    wanted = table(spark, d, "events").filter("event_type = 'purchase' AND value > 50").select(F.col("user_id").cast("string").alias("id"))
    return _history(spark, d).lookup(wanted).select("id", "module", F.unix_millis("scan_time").alias("ms"), "total_files")


def _members(spark, d):
    members, found = _grouped(spark, d)
    return G.group_members(found, members), proxies.files(spark, d).select("id", "path", "size")


@query(_GROUPS + f""", {FILES} SELECT f.path AS value FROM comp c JOIN groups ON group_key = c.g JOIN files f ON f.id = c.id WHERE c.id <> representative""")
def duplicate_paths(spark, d):
    return report.duplicates_only(*_members(spark, d))


@query(_GROUPS + f""", {FILES} SELECT group_key, f.path, c.id = representative AS is_representative FROM comp c JOIN groups ON group_key = c.g JOIN files f ON f.id = c.id ORDER BY group_key, path""")
def ordered_members(spark, d):
    return report.ordered_members(*_members(spark, d))


_ODD = "CASE page_id % 4 WHEN 0 THEN '.git/' || page_id WHEN 1 THEN 'a/.b/' || page_id || '.jpg' WHEN 2 THEN 'a/b/.' || page_id || '.jpg' ELSE 'a.b/c.d/' || page_id END"


@query(f"SELECT page_id, regexp_matches({_ODD}, '(^|/)\\.[^/]+/') AS hidden FROM pages")
def hidden_folders(spark, d):
    return table(spark, d, "pages").select("page_id", paths.in_hidden_folder(F.expr(_ODD)).alias("hidden"))


_NOW = 1706745600  # 2024-02-01


@query(f"SELECT event_id, {_NOW} - (epoch_us(ts) // 1000000) > 604800 AS aged FROM events")
def aged_trash(spark, d):
    return table(spark, d, "events").select("event_id", wording.is_aged(F.lit(_NOW), F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("aged"))


@query(f"WITH {FILES} SELECT CASE WHEN ext IN ('jpg', 'png', 'heic') THEN 'image' WHEN ext IN ('mp4', 'mov') THEN 'video' ELSE 'other' END AS kind, count(*) AS files FROM (SELECT CASE WHEN id % 5 = 0 THEN 'mp4' WHEN id % 7 = 0 THEN 'mov' ELSE ext END AS ext FROM parts) GROUP BY 1")
def file_kinds(spark, d):
    path = F.when(F.col("id") % 5 == 0, F.concat("path", F.lit(".MP4"))).when(F.col("id") % 7 == 0, F.concat("path", F.lit(".mov"))).otherwise(F.col("path"))
    return proxies.files(spark, d).groupBy(paths.file_kind(path).alias("kind")).agg(F.count("*").alias("files"))


@query("SELECT o_custkey AS group_key, o_orderkey AS kept FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_custkey % 3 = 0 THEN o_totalprice END DESC NULLS LAST, o_orderkey % 4 = 0 DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def keep_fallback(spark, d):
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select(cust.alias("group_key"), k.alias("pos"), F.when(cust % 3 == 0, F.col("o_totalprice")).alias("overall"), (k % 4 == 0).alias("is_representative"))
    return G.keep_strategy(rows, "sharpest").filter("keep").select("group_key", F.col("pos").alias("kept"))


@query("SELECT doc_id, lower(md5(text)) AS hex, CAST(8 * least(doc_id % 9, strlen(text)) AS INTEGER) AS bits FROM documents")
def signature_texts(spark, d):
    part = F.substring(F.col("text").cast("binary"), F.lit(1), (F.col("doc_id") % 9).cast("int"))
    return table(spark, d, "documents").select("doc_id", S.to_hex(F.unhex(F.md5("text"))).alias("hex"), codecs.hash_bits(part).alias("bits"))


@query("SELECT p_partkey, (p_size * 100) || 'x' || (p_size * 75) AS dimensions, CAST(p_size * 100 AS DOUBLE) * (p_size * 75) / 1e6 AS megapixels FROM part")
def dimensions(spark, d):
    width, height = F.col("p_size") * 100, F.col("p_size") * 75
    return table(spark, d, "part").select("p_partkey", wording.dimensions_text(width, height).alias("dimensions"), wording.megapixels(width, height).alias("megapixels"))


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE strftime(CAST(o_orderdate AS DATE), '%Y:%m:%d') || ' 10:11:12' END AS text FROM orders)
SELECT o_orderkey, epoch_ms(try_strptime(text, '%Y:%m:%d %H:%M:%S')) AS ms FROM t""")
def exif_times(spark, d):
    text = F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise(F.concat(F.date_format(F.to_date("o_orderdate"), "yyyy:MM:dd"), F.lit(" 10:11:12")))
    return table(spark, d, "orders").select("o_orderkey", F.unix_millis(wording.exif_timestamp(text).cast("timestamp")).alias("ms"))


@query(f"""WITH RECURSIVE {_pairs(0, 8)} SELECT p.a, p.b, CASE WHEN distance = 0 THEN 'Exact Match' WHEN distance <= 4 THEN 'Near-Exact Match' ELSE 'Similar' END || ': ' || (64 - distance) || ' bits agree, ' || distance || ' of 64 differ' AS details,
64 AS bits, format('{{:x}}', s.h) AS hash_a, format('{{:x}}', t.h) AS hash_b FROM pairs p JOIN sig s ON s.id = a JOIN sig t ON t.id = b""")
def explain_details(spark, d):
    rows = simjoin.matches(proxies.signatures(spark, d).withColumn("own", F.col("h")), 8, carried=("own",))
    e = wording.explain(F.col("distance"), F.col("match_type"), F.col("similarity_percent"), F.col("own_a"), F.col("own_b"))
    return rows.select("a", "b", e.alias("e")).select("a", "b", "e.details", "e.bits", "e.hash_a", "e.hash_b")


@query("""SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'Exact Match' WHEN 1 THEN 'Near-Exact Match' WHEN 2 THEN 'Maybe Similar' ELSE 'other' END AS match_name,
CASE user_id % 3 WHEN 0 THEN 'In root folder' WHEN 1 THEN 'In shallow folder' ELSE 'Generic filename' END AS reason_name, CASE user_id % 2 WHEN 0 THEN 'High (3/3)' ELSE 'No match' END AS confidence_name FROM events""")
def display_names(spark, d):
    u = F.col("user_id")
    match = F.when(u % 4 == 0, "Exact").when(u % 4 == 1, "NearExact").when(u % 4 == 2, "MaybeSimilar").otherwise("other")
    reason = F.when(u % 3 == 0, "in_root").when(u % 3 == 1, "shallow_folder").otherwise("generic_name")
    confidence = F.when(u % 2 == 0, "High").otherwise("None")
    return table(spark, d, "events").select("event_id", wording.named(match, wording.MATCH_NAMES).alias("match_name"), wording.named(reason, wording.REASON_NAMES).alias("reason_name"), wording.named(confidence, wording.CONFIDENCE_NAMES).alias("confidence_name"))


@query("SELECT event_id, CASE WHEN user_id % 7 > 0 THEN 10 + 70 * (user_id % 3) / CAST(user_id % 7 AS DOUBLE) ELSE 10.0 END AS percent, CASE WHEN user_id % 5 > 0 THEN event_id * 1000.0::DOUBLE / (user_id % 5) ELSE 0.0 END AS per_second FROM events")
def progress(spark, d):
    u = F.col("user_id")
    return table(spark, d, "events").select("event_id", wording.progress_percent(u % 3, u % 7).alias("percent"), wording.per_second(F.col("event_id"), u % 5).alias("per_second"))
