"""Every registered query of the file-collection operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, paths, wording
from ..functions import signatures as S
from ..operators import groups as G
from ..operators import keyed, organize, prefilter, report, rules, simjoin, stores, topk, totals, trash
from ..streaming import watch
from ..tables import Workspace
from . import proxies
from .proxies import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _grid(cells: int) -> str:
    return f"""toks{cells} AS (SELECT doc_id, CAST('0x' || substr(md5(t), 1, 4) AS INTEGER) % {cells} AS k FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS t FROM documents)),
cnt{cells} AS (SELECT doc_id, k, count(*) AS n FROM toks{cells} GROUP BY ALL),
grid{cells} AS MATERIALIZED (SELECT d.doc_id, r.k, coalesce(c.n, 0) AS n FROM documents d CROSS JOIN (SELECT unnest(range({cells})) AS k) r LEFT JOIN cnt{cells} c ON c.doc_id = d.doc_id AND c.k = r.k)"""


_BIT = "(1::UBIGINT << CAST({} AS INTEGER))::HUGEINT"
SIG = f"""{_grid(72)},
sig AS MATERIALIZED (SELECT a.doc_id AS id, CAST(sum(CASE WHEN a.n > b.n THEN {_BIT.format("(a.k // 9) * 8 + a.k % 9")} ELSE 0 END) AS UBIGINT) AS h
  FROM grid72 a JOIN grid72 b ON a.doc_id = b.doc_id AND b.k = a.k + 1 WHERE a.k % 9 <> 8 GROUP BY 1)"""
CLASS = "CASE WHEN {d} = 0 THEN 'Exact' WHEN {d} <= 4 THEN 'NearExact' WHEN {d} <= 10 THEN 'Similar' ELSE 'MaybeSimilar' END"


def _pairs(low: int = 0, high: int = 8) -> str:
    return f"""{SIG},
pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM sig a JOIN sig b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) BETWEEN {low} AND {high}),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(id, m) AS (SELECT a, a FROM edges UNION SELECT e.b, r.m FROM reach r JOIN edges e ON e.a = r.id),
comp AS MATERIALIZED (SELECT id, min(m) AS g FROM reach GROUP BY id)"""


_GROUPS = f"""WITH RECURSIVE {_pairs()},
sized AS (SELECT c.g, c.id, d.n_chars AS s FROM comp c JOIN documents d ON d.doc_id = c.id),
grp AS MATERIALIZED (SELECT g, count(*) AS size, max(struct_pack(s := s, id := id)) AS top, sum(s) AS total FROM sized GROUP BY g),
st AS (SELECT c.g, CAST(sum(p.distance) AS DOUBLE) / count(*) AS average_distance, min(CASE WHEN p.distance = 0 THEN 0 WHEN p.distance <= 4 THEN 1 WHEN p.distance <= 10 THEN 2 ELSE 3 END) AS o FROM pairs p JOIN comp c ON c.id = p.a GROUP BY c.g),
groups AS MATERIALIZED (SELECT grp.g AS group_key, CAST(size AS BIGINT) AS size, top.id AS representative, ['Exact', 'NearExact', 'Similar', 'MaybeSimilar'][o + 1] AS match_type, average_distance, CAST(total - top.s AS BIGINT) AS duplicate_bytes FROM grp JOIN st ON st.g = grp.g)
"""
FILES = """files AS (SELECT doc_id AS id, n_chars AS size, text, CASE doc_id % 6 WHEN 0 THEN 'IMG_' || doc_id || '.jpg' WHEN 1 THEN 'photos/DSC_' || doc_id || '.PNG'
  WHEN 2 THEN '2024/' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '/trip_' || doc_id || '.jpg' WHEN 3 THEN 'vacation/beach/sunset_' || doc_id || '.heic'
  WHEN 4 THEN 'misc/Screenshot ' || doc_id || '.png' ELSE 'docs/a/notes_' || doc_id || '.txt' END AS path FROM documents),
named AS (SELECT *, string_split(path, '/')[-1] AS name, len(string_split(path, '/')) - 1 AS depth FROM files),
parts AS (SELECT *, lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) AS ext, regexp_replace(name, '^(.+)\\.[^.]*$', '\\1') AS stem FROM named)"""
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)

# ---------------------------------------------------------------- pairs and groups


def _matches(spark, d, threshold=8, **options):
    return simjoin.matches(proxies.signatures(spark, d), threshold, **options)


def _sizes(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))


def _grouped(spark, d):
    """(members, groups) of the documents at the default threshold."""
    members, stats = G.signature_groups(proxies.signatures(spark, d))
    return members, G.duplicate_groups(stats, _sizes(spark, d), members)


_PAIR_COLUMNS = f"a AS doc_a, b AS doc_b, distance, (1 - distance / 64.0::DOUBLE) * 100 AS similarity_percent, {CLASS.format(d='distance')} AS match_type"


@query(f"WITH RECURSIVE {_pairs()} SELECT {_PAIR_COLUMNS} FROM pairs")
def dup_pairs_exact(spark, d):
    return _matches(spark, d).withColumnsRenamed({"a": "doc_a", "b": "doc_b"})


_SHARED = " OR ".join(f"((x >> {16 * i}) & 65535) = 0" for i in range(4))


@query(f"WITH RECURSIVE {_pairs()} SELECT {_PAIR_COLUMNS} FROM (SELECT p.*, xor(s.h, t.h) AS x FROM pairs p JOIN sig s ON s.id = a JOIN sig t ON t.id = b) WHERE {_SHARED}")
def dup_pairs_lsh(spark, d):
    return _matches(spark, d, candidates="lsh").withColumnsRenamed({"a": "doc_a", "b": "doc_b"})


@query(f"""WITH {SIG}, e AS (SELECT i AS band, (h >> CAST(16 * i AS INTEGER)) & 65535 AS value FROM sig CROSS JOIN (SELECT unnest(range(4)) AS i)),
b AS (SELECT band, value, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT count(*) AS m FROM sig), c AS (SELECT count(*) AS k FROM (SELECT xor(a.h, b.h) AS x FROM sig a JOIN sig b ON a.id < b.id) WHERE {_SHARED})
SELECT 4 AS bands, count(*) AS buckets, max(n) AS max_bucket, CAST(sum(n) AS DOUBLE) / count(*) AS avg_bucket, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS bucket_pairs, any_value(k) AS candidates, any_value(m * (m - 1) // 2) AS naive_pairs, any_value(m * (m - 1) // 2) / CAST(any_value(greatest(k, 1)) AS DOUBLE) AS reduction, any_value(m) AS "rows" FROM b, t, c""")
def lsh_stats(spark, d):
    return simjoin.index_stats(proxies.signatures(spark, d))


@query(_GROUPS + "SELECT * FROM groups")
def dup_groups(spark, d):
    return _grouped(spark, d)[1]


@query(_GROUPS + "SELECT c.g AS group_key, c.id AS doc_id, c.id = representative AS is_representative FROM comp c JOIN groups ON group_key = c.g")
def dup_group_members(spark, d):
    members, found = _grouped(spark, d)
    return G.group_members(found, members).withColumnRenamed("id", "doc_id")


@query(_GROUPS + """, t AS (SELECT count(*) AS groups, CAST(coalesce(sum(size - 1), 0) AS BIGINT) AS duplicates, CAST(coalesce(sum(duplicate_bytes), 0) AS BIGINT) AS savings_bytes FROM groups),
l AS (SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS total_bytes FROM documents)
SELECT files, total_bytes, groups, duplicates, savings_bytes, round(duplicates * 100.0::DOUBLE / files, 1) AS duplicate_percent, files - duplicates AS remaining_files, total_bytes - savings_bytes AS remaining_bytes FROM l, t""")
def dup_summary(spark, d):
    return G.summary(_grouped(spark, d)[1], _sizes(spark, d))


@query(f"WITH RECURSIVE {_pairs(0, 12)} SELECT {CLASS.format(d='distance')} AS match_type, count(*) AS pairs FROM pairs GROUP BY 1")
def match_type_summary(spark, d):
    return G.class_summary(simjoin.distance_counts(proxies.signatures(spark, d), 12))


@query("SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY n_chars) AS n FROM documents) WHERE n >= 2")
def prefilter_size(spark, d):
    return prefilter.same_size(_sizes(spark, d)).select(F.col("id").alias("doc_id"))


@query("SELECT doc_id FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY md5(substr(text, 1, 4096))) AS n FROM documents) WHERE n >= 2 OR text IS NULL")
def prefilter_prefix(spark, d):
    return prefilter.same_prefix(table(spark, d, "documents"), F.col("text")).select("doc_id")


@query("""WITH a AS (SELECT *, count(*) OVER (PARTITION BY n_chars) AS n FROM documents), b AS (SELECT * FROM a WHERE n >= 2), c AS (SELECT *, count(*) OVER (PARTITION BY substr(text, 1, 4096)) AS m FROM b)
SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM b) AS skipped_by_size, (SELECT count(*) FROM b) - (SELECT count(*) FROM c WHERE m >= 2) AS skipped_by_prefix""")
def prefilter_skips(spark, d):
    return prefilter.skips(table(spark, d, "documents").withColumn("size", F.col("n_chars")), F.col("text"))


@query("SELECT md5(text) AS content_hash, count(*) AS copies, min(doc_id) AS kept FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy(F.md5("text").alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept")).filter("copies > 1")


_FUSION = f"""WITH RECURSIVE {_pairs()}, {_grid(64)}, {_grid(25)},
mean AS (SELECT doc_id, sum(n) // 64 AS m FROM grid64 GROUP BY 1),
ah AS MATERIALIZED (SELECT doc_id AS id, CAST(sum(CASE WHEN n > m THEN {_BIT.format("k")} ELSE 0 END) AS UBIGINT) AS h FROM grid64 JOIN mean USING (doc_id) GROUP BY 1),
ph AS MATERIALIZED (SELECT id, CAST(sum(v) AS UBIGINT) AS h FROM (
  SELECT a.doc_id AS id, CASE WHEN a.n > b.n THEN {_BIT.format("(a.k // 5) * 4 + a.k % 5")} ELSE 0 END AS v FROM grid25 a JOIN grid25 b ON a.doc_id = b.doc_id AND b.k = a.k + 1 WHERE a.k % 5 <> 4
  UNION ALL SELECT a.doc_id, CASE WHEN a.n > b.n THEN {_BIT.format("20 + a.k")} ELSE 0 END FROM grid25 a JOIN grid25 b ON a.doc_id = b.doc_id AND b.k = a.k + 5) GROUP BY 1),
v AS (SELECT p.a, p.b, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS ahash_distance, p.distance AS dhash_distance, CAST(bit_count(xor(z.h, w.h)) AS INTEGER) AS phash_distance
  FROM pairs p JOIN ah x ON x.id = a JOIN ah y ON y.id = b JOIN ph z ON z.id = a JOIN ph w ON w.id = b),
u AS (SELECT *, CAST(ahash_distance <= 8 AS INTEGER) + CAST(dhash_distance <= 8 AS INTEGER) + CAST(phash_distance <= 8 AS INTEGER) AS votes FROM v)
SELECT *, CASE votes WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'None' END AS confidence,
  least(CASE WHEN ahash_distance <= 8 THEN ahash_distance END, CASE WHEN dhash_distance <= 8 THEN dhash_distance END, CASE WHEN phash_distance <= 8 THEN phash_distance END) AS min_distance, votes >= 2 AS is_duplicate FROM u"""


@query(_FUSION)
def fusion_votes(spark, d):
    h = proxies.three_hashes(spark, d)
    return simjoin.fusion_votes(h, simjoin.similar_pairs(h.withColumn("h", F.col("dhash")), 8, carried=("ahash", "dhash", "phash")))


@query(f"WITH RECURSIVE {_pairs(0, 4)} SELECT DISTINCT a AS doc_id FROM edges")
def two_phase_candidates(spark, d):
    return prefilter.with_partner(proxies.signatures(spark, d), "h", 4).select(F.col("id").alias("doc_id"))


def _stars(spark, d):
    return G.similar_stars(proxies.signatures(spark, d), 5, 15)


_STARS = f"""WITH RECURSIVE {_pairs(5, 15)}, stars AS MATERIALIZED (SELECT g AS reference, c.id AS member, CAST(bit_count(xor(s.h, r.h)) AS INTEGER) AS distance FROM comp c JOIN sig s ON s.id = c.id JOIN sig r ON r.id = c.g WHERE c.id <> c.g) """


@query(_STARS + f"SELECT reference, member, distance, (1 - distance / 64.0::DOUBLE) * 100 AS similarity_percent, {CLASS.format(d='distance')} AS match_type FROM stars")
def similar_groups(spark, d):
    return _stars(spark, d)


@query(_STARS + """SELECT reference, count(*) AS members, (1 - (CAST(sum(distance) AS DOUBLE) / count(*)) / 64.0::DOUBLE) * 100 AS average_similarity,
CAST(sum(m.n_chars) + any_value(r.n_chars) AS BIGINT) AS total_bytes FROM stars JOIN documents m ON m.doc_id = member JOIN documents r ON r.doc_id = reference GROUP BY reference""")
def similar_group_stats(spark, d):
    return G.star_stats(_stars(spark, d), _sizes(spark, d))


@query(_STARS + "SELECT count(DISTINCT reference) AS groups, count(*) + count(DISTINCT reference) AS photos FROM stars")
def similar_totals(spark, d):
    return totals.similar_totals(_stars(spark, d))


@query(_GROUPS + "SELECT group_key, c.id AS doc_id, CASE WHEN c.id = representative THEN 0 ELSE duplicate_bytes // (size - 1) END AS share FROM comp c JOIN groups ON group_key = c.g")
def share_estimate(spark, d):
    members, found = _grouped(spark, d)
    return totals.share_estimate(found, G.group_members(found, members)).withColumnRenamed("id", "doc_id")


@query(_GROUPS + "SELECT group_key, doc_id, path, CAST(row_number() OVER (PARTITION BY group_key ORDER BY path, doc_id) AS INTEGER) AS place FROM (SELECT group_key, c.id AS doc_id, 'p' || lpad(CAST(c.id % 7 AS VARCHAR), 2, '0') AS path FROM comp c JOIN groups ON group_key = c.g) QUALIFY place <= 3")
def member_previews(spark, d):
    members, found = _grouped(spark, d)
    files = _sizes(spark, d).withColumn("path", F.concat(F.lit("p"), F.lpad((F.col("id") % 7).cast("string"), 2, "0")))
    return report.first_members(G.group_members(found, members), files, 3).withColumnRenamed("id", "doc_id")


@query(f"WITH RECURSIVE {_pairs(0, 4)} SELECT p.a, p.b, CASE WHEN x.n_chars > y.n_chars THEN 'a' WHEN y.n_chars > x.n_chars THEN 'b' END AS larger, CASE WHEN x.doc_id % 9 > y.doc_id % 9 THEN 'a' WHEN y.doc_id % 9 > x.doc_id % 9 THEN 'b' END AS sharper FROM pairs p JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b")
def pair_comparison(spark, d):
    files = _sizes(spark, d).select("id", "size", (F.col("id") % 9).alias("width"), F.lit(1).alias("height"))
    return totals.compare_pairs(simjoin.similar_pairs(proxies.signatures(spark, d), 4).select("a", "b"), files)


@query("SELECT count(*) AS files, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes FROM documents WHERE doc_id IN (SELECT o_orderkey FROM orders)")
def selected_size(spark, d):
    return totals.selected_size(_sizes(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("id")))


# ---------------------------------------------------------------- files


@query(f"WITH {FILES} SELECT path, name AS filename, size AS size_bytes, ext AS file_type FROM parts WHERE size >= 1048 AND ext IN ({_LIST(paths.LARGE_FILE_EXTENSIONS)}) ORDER BY size DESC, path LIMIT 50")
def large_topk(spark, d):
    return topk.large_files(proxies.files(spark, d), 1048 / 1024**2)


@query(f"WITH {FILES} SELECT count(*) AS files_scanned, count(*) FILTER (WHERE size >= 1048 AND ext IN ({_LIST(paths.LARGE_FILE_EXTENSIONS)})) AS qualifying, CAST(sum(size) FILTER (WHERE size >= 1048 AND ext IN ({_LIST(paths.LARGE_FILE_EXTENSIONS)})) AS BIGINT) AS total_size_bytes FROM parts")
def large_totals(spark, d):
    return topk.large_totals(proxies.files(spark, d), 1048 / 1024**2)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def lineitem_topk(spark, d):
    return table(spark, d, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50).select("l_orderkey", "l_linenumber", "l_extendedprice")


_FLAGS = f"""WITH {FILES}, flags AS (SELECT id, path, size, depth = 0 AS in_root, depth = 1 AS shallow_folder, NOT regexp_matches(path, '{rules.DATE_PATTERN}') AS no_date_pattern, regexp_matches(stem, '{rules.GENERIC_PATTERN}') AS generic_name
FROM parts WHERE ext IN ({_LIST(paths.LIBRARY_EXTENSIONS)})), hit AS (SELECT * FROM flags WHERE in_root OR shallow_folder OR no_date_pattern OR generic_name) """


@query(_FLAGS + "SELECT id, path, in_root, shallow_folder, no_date_pattern, generic_name FROM hit")
def unorganized_files(spark, d):
    found = rules.unorganized_files(proxies.files(spark, d))
    return found.select("id", "path", *[F.array_contains("reasons", r).alias(r) for r in ("in_root", "shallow_folder", "no_date_pattern", "generic_name")])


@query(_FLAGS + "SELECT reason, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM hit, LATERAL (SELECT unnest(list_filter([CASE WHEN in_root THEN 'in_root' END, CASE WHEN shallow_folder THEN 'shallow_folder' END, CASE WHEN no_date_pattern THEN 'no_date_pattern' END, CASE WHEN generic_name THEN 'generic_name' END], lambda x: x IS NOT NULL)) AS reason) GROUP BY reason")
def unorganized_by_reason(spark, d):
    return rules.reason_summary(rules.unorganized_files(proxies.files(spark, d)))


@query(_FLAGS + "SELECT id, CASE WHEN in_root THEN 'in_root' WHEN generic_name THEN 'generic_name' WHEN shallow_folder THEN 'shallow_folder' ELSE 'no_date_pattern' END AS reason FROM hit")
def primary_reason(spark, d):
    return rules.unorganized_files(proxies.files(spark, d)).select("id", rules.primary_reason(F.col("reasons")).alias("reason"))


@query(_FLAGS + "SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM hit")
def unorganized_total(spark, d):
    return totals.size_total(rules.unorganized_files(proxies.files(spark, d)), "files", "bytes")


@query(f"WITH {FILES} SELECT CASE WHEN ext IN ('jpg', 'jpeg') THEN 'Jpeg' WHEN ext = 'png' THEN 'Png' WHEN ext IN ('heic', 'heif') THEN 'Heic' ELSE 'Unknown' END AS format, count(*) AS n, count(*) FILTER (WHERE ext IN ({_LIST(paths.PHOTO_EXTENSIONS)})) AS photos FROM parts GROUP BY 1")
def ext_format_counts(spark, d):
    files = proxies.files(spark, d)
    return files.groupBy(paths.image_format(F.col("path")).alias("format")).agg(F.count("*").alias("n"), F.count_if(paths.is_photo_name(F.col("path"))).alias("photos"))


_SHOT_SIZES = " OR ".join(f"(least(w, h) = {min(s)} AND greatest(w, h) = {max(s)})" for s in rules.SCREEN_SIZES)


_SHOTS = f"""WITH {FILES}, shot AS (SELECT id, path, size, lower(name) AS ln, ext, CASE WHEN id % 5 = 0 THEN 'Snipping Tool 10' WHEN id % 5 = 1 THEN 'camera' END AS software, CASE WHEN id % 4 = 0 THEN 2532 WHEN id % 4 = 1 THEN 4000 END AS w, CASE WHEN id % 4 = 0 THEN 1170 WHEN id % 4 = 1 THEN 3000 END AS h FROM parts),
cand AS (SELECT *, list_filter([{_LIST(rules.SCREENSHOT_NAMES)}], lambda p: contains(ln, p))[1] AS pat FROM shot), c2 AS (SELECT * FROM cand WHERE pat IS NOT NULL OR ext = 'png'),
v AS (SELECT id, size, CASE WHEN len(list_filter([{_LIST(rules.SCREENSHOT_SOFTWARE)}], lambda s: contains(lower(software), s))) > 0 THEN 'High' WHEN pat IS NOT NULL THEN 'Medium' WHEN {_SHOT_SIZES} THEN 'Low' END AS confidence, software, pat, w, h FROM c2)
"""


def _screenshots(spark, d):
    i = F.col("id")
    rows = proxies.files(spark, d).withColumns({"software": F.when(i % 5 == 0, "Snipping Tool 10").when(i % 5 == 1, "camera"), "width": F.when(i % 4 == 0, 2532).when(i % 4 == 1, 4000), "height": F.when(i % 4 == 0, 1170).when(i % 4 == 1, 3000)})
    return rules.screenshots(rows)


@query(_SHOTS + """SELECT id, confidence, CASE confidence WHEN 'High' THEN 'Software: ' || software WHEN 'Medium' THEN 'Filename matches pattern: ' || pat ELSE 'Screen size: ' || w || 'x' || h END AS reason FROM v WHERE confidence IS NOT NULL""")
def screenshot_rules(spark, d):
    return _screenshots(spark, d).select("id", "confidence", "reason")


@query(_SHOTS + "SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM v WHERE confidence IS NOT NULL")
def screenshot_total(spark, d):
    return totals.size_total(_screenshots(spark, d), "files", "bytes")


@query(f"WITH {FILES} SELECT id, regexp_matches(name, '(?i)s.*_1.*\\.h') AS globbed, contains(lower(name), 'trip_') AS searched, regexp_matches(lower(name), 't.*p.*9') AS fuzzy FROM parts")
def search_glob(spark, d):
    p = F.col("path")
    return proxies.files(spark, d).select("id", paths.matches_search(p, "s*_1*.h").alias("globbed"), paths.matches_search(p, "Trip_").alias("searched"), paths.fuzzy_matches(paths.file_name(p), "tp9").alias("fuzzy"))


@query(f"WITH {FILES} SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, count(*) AS files FROM files GROUP BY 1")
def parent_folders(spark, d):
    return proxies.files(spark, d).groupBy(paths.parent(F.col("path")).alias("folder")).agg(F.count("*").alias("files"))


# ---------------------------------------------------------------- organising

_PLAN = """WITH o AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS source, o_orderpriority || '.jpg' AS name, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS date, CAST(round(o_totalprice) AS BIGINT) AS size FROM orders),
p AS (SELECT *, coalesce(strftime(date, '%Y/%m - %B'), 'Unsorted') AS folder FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY source) - 1 AS n FROM p),
plan AS (SELECT source, date, size, folder, folder || '/' || CASE WHEN n = 0 THEN name ELSE regexp_replace(name, '^(.+)\\.[^.]*$', '\\1') || '_' || n || '.jpg' END AS destination, n > 0 AS has_conflict FROM r) """


def _plan(spark, d):
    o = table(spark, d, "orders")
    date = F.when(F.col("o_orderkey") % 50 != 0, F.to_date("o_orderdate"))
    return organize.plan(o.select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("source"), F.concat("o_orderpriority", F.lit(".jpg")).alias("name"), date.alias("date"), F.round("o_totalprice").cast("long").alias("size")))


@query(_PLAN + "SELECT source, folder, destination, has_conflict FROM plan")
def organize_plan(spark, d):
    return _plan(spark, d).select("source", "folder", "destination", "has_conflict")


@query("""WITH f AS (SELECT o_orderkey AS k, strftime(CAST(o_orderdate AS DATE), '%Y:%m:%d') || ' 10:11:12' AS t, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT 'in/' || k || '.jpg' AS source, k || '.jpg' AS name, CASE WHEN k % 3 = 0 OR k % 3 = 1 THEN day ELSE day + INTERVAL 1 DAY END::DATE AS date, k AS size FROM f""")
def organize_source(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    text = F.concat(F.date_format(day, "yyyy:MM:dd"), F.lit(" 10:11:12"))
    none = F.lit(None).cast("string")
    files = o.select(F.concat(F.lit("in/"), k.cast("string"), F.lit(".jpg")).alias("path"), k.alias("size"), F.date_add(day, 1).cast("timestamp").alias("modified"), F.when(k % 3 == 0, text).otherwise(none).alias("exif_original"), F.when(k % 3 == 1, text).when(k % 3 == 2, "no date").alias("exif_changed"))
    return organize.dated_files(files)


@query(_PLAN + "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM plan WHERE date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC")
def organize_by_year(spark, d):
    return organize.by_year(_plan(spark, d))


@query(_PLAN + "SELECT min(date) AS earliest, max(date) AS latest FROM plan")
def organize_date_range(spark, d):
    return organize.date_range(_plan(spark, d))


@query(_PLAN + "SELECT count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (WHERE date IS NULL) AS no_date, count(*) FILTER (WHERE has_conflict) AS conflicts, count(DISTINCT regexp_replace(destination, '/?[^/]*$', '')) AS folders FROM plan")
def organize_counters(spark, d):
    return organize.counters(_plan(spark, d))


# ---------------------------------------------------------------- keep rules


def _kept(spark, d, strategy):
    """Orders of a customer as a group: price as size, date as time."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("group_key"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("modified"))
    return G.keep_strategy(o, strategy).filter("keep").select("group_key", F.col("pos").alias("kept"))


def _kept_sql(order: str) -> str:
    return f"SELECT o_custkey AS group_key, o_orderkey AS kept FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {order}, o_orderkey) AS r FROM orders) WHERE r = 1"


@query(_kept_sql("o_totalprice DESC"))
def keep_largest(spark, d):
    return _kept(spark, d, "largest")


@query(_kept_sql("date_trunc('minute', o_orderdate)"))
def keep_oldest(spark, d):
    return _kept(spark, d, "oldest")


@query(_kept_sql("date_trunc('minute', o_orderdate) DESC"))
def keep_recent(spark, d):
    return _kept(spark, d, "most_recent")


@query("SELECT source AS group_key, doc_id AS kept FROM (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY quality DESC NULLS LAST, d.doc_id) AS r FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE r = 1")
def keep_quality(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rows = docs.select(F.col("source").alias("group_key"), F.col("doc_id").alias("pos"), F.col("quality").alias("overall"), F.lit(False).alias("is_representative"))
    return G.keep_strategy(rows, "sharpest").filter("keep").select("group_key", F.col("pos").alias("kept"))


@query("""WITH p AS (SELECT p_brand || '|' || p_type AS g, p_size AS r, CAST(round(p_retailprice * 100) AS BIGINT) AS s, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS p FROM part),
st AS (SELECT g, count(*) AS n, max(r) AS r1, max(struct_pack(r := r, p := p)).p AS by_r, max(struct_pack(s := s, p := p)).p AS by_s, min(p) AS oldest FROM p GROUP BY g),
nr AS (SELECT p.g, count(*) AS n_r FROM p JOIN st ON st.g = p.g AND p.r = st.r1 GROUP BY 1),
ss AS (SELECT g, s, row_number() OVER (PARTITION BY g ORDER BY s DESC) AS k FROM p),
x AS (SELECT st.*, n_r, a.s AS s1, b.s AS s2 FROM st JOIN nr ON nr.g = st.g LEFT JOIN ss a ON a.g = st.g AND a.k = 1 LEFT JOIN ss b ON b.g = st.g AND b.k = 2)
SELECT g, CASE WHEN n = 1 OR n_r = 1 THEN by_r WHEN s1 > s2 * 110 // 100 THEN by_s ELSE oldest END AS kept, CASE WHEN n = 1 THEN 'OnlyOption' WHEN n_r = 1 THEN 'HighestResolution' WHEN s1 > s2 * 110 // 100 THEN 'LargestFileSize' ELSE 'OldestCreation' END AS reason FROM x""")
def keeper_with_reason(spark, d):
    rows = table(spark, d, "part").withColumn("g", F.concat_ws("|", "p_brand", "p_type"))
    return G.keeper_with_reason(rows, "g", F.col("p_size"), F.round(F.col("p_retailprice") * 100).cast("long"), F.lit(None).cast("timestamp"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))


# ---------------------------------------------------------------- stores

_EV = "e AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id, ts, event_type, value FROM events), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS r FROM e) WHERE r = 1)"


def _cache_log(spark, d):
    """Events as a log of cache writes: the user as path, the type as algorithm, the id as size."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("algorithm"), F.col("event_type").cast("binary").alias("hash"), F.col("event_id").alias("file_size"), F.col("ts").cast("timestamp").alias("file_modified"), F.col("ts").cast("timestamp").alias("cached_at"))


def _cache(spark, d):
    return keyed.latest(_cache_log(spark, d), ["path"], "cached_at", "file_size")


@query(f"WITH {_EV}, f AS (SELECT path, event_id AS size, ts FROM e WHERE event_type = 'view') SELECT f.path, f.size, CASE WHEN l.event_id = f.size AND date_trunc('second', l.ts) = date_trunc('second', f.ts) AND l.event_type = 'view' THEN l.event_type END AS hash FROM f LEFT JOIN last l ON l.path = f.path")
def cache_lookup(spark, d):
    log = _cache_log(spark, d).filter("algorithm = 'view'").select("path", F.col("file_size").alias("size"), F.col("file_modified").alias("modified"), "algorithm")
    return stores.cache_lookup(log, _cache(spark, d)).select("path", "size", F.col("hash").cast("string").alias("hash"))


@query(f"WITH {_EV} SELECT path, event_type AS algorithm FROM last WHERE path IN (SELECT path FROM e WHERE event_type = 'purchase')")
def cache_prune(spark, d):
    alive = _cache_log(spark, d).filter("algorithm = 'purchase'")
    return stores.cache_prune(_cache(spark, d), alive).select("path", "algorithm")


@query(f"WITH {_EV} SELECT count(*) AS removed FROM last WHERE path NOT IN (SELECT path FROM e WHERE event_type = 'purchase')")
def cache_prune_count(spark, d):
    alive = _cache_log(spark, d).filter("algorithm = 'purchase'")
    return stores.pruned(_cache(spark, d), alive).agg(F.count("*").alias("removed"))


@query(f"WITH {_EV} SELECT count(*) AS entries, CAST(sum(strlen(event_type)) AS BIGINT) AS bytes, (epoch_us(min(ts)) // 1000) AS oldest_ms, (epoch_us(max(ts)) // 1000) AS newest_ms FROM last")
def cache_stats(spark, d):
    s = stores.cache_stats(_cache(spark, d))
    return s.select("entries", "bytes", F.unix_millis("oldest").alias("oldest_ms"), F.unix_millis("newest").alias("newest_ms"))


@query(f"WITH {_EV} SELECT path, event_type AS algorithm, event_id AS file_size FROM last")
def cache_upsert(spark, d):
    log = _cache_log(spark, d)
    old, new = log.filter("file_size % 2 = 0"), log.filter("file_size % 2 = 1")
    return stores.upsert(keyed.latest(old, ["path"], "cached_at", "file_size"), keyed.latest(new, ["path"], "cached_at", "file_size"), ["path"], "cached_at").select("path", "algorithm", "file_size")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def history_page(spark, d):
    return stores.history_page(table(spark, d, "events"), 50, 100, "ts", "event_id").select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id = 42")
def history_point(spark, d):
    return stores.history_point(table(spark, d, "events"), 42, "event_id").select("event_id", "user_id", "event_type")


@query("SELECT user_id, (epoch_us(ts) // 1000) AS ms, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def scan_states(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("directory"), F.col("ts").cast("timestamp").alias("last_scan"), F.col("event_id").alias("files"))
    old, new = e.filter("files % 3 = 0"), e.filter("files % 3 <> 0")
    state = stores.upsert(keyed.latest(old, ["directory"], "last_scan", "files"), keyed.latest(new, ["directory"], "last_scan", "files"), ["directory"], "last_scan")
    return state.select(F.col("directory").cast(e.sparkSession.read.parquet(f"{d}/events.parquet").schema["user_id"].dataType).alias("user_id"), F.unix_millis("last_scan").alias("ms"), F.col("files").alias("event_id"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'Average' WHEN 'click' THEN 'Perceptual' ELSE 'Difference' END AS algorithm, '[\"' || event_type || '\",\"' || user_id || '\"]' AS paths, 2 AS n_paths, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS has_data FROM events")
def codecs_of_events(spark, d):
    e = table(spark, d, "events")
    code = F.when(F.col("event_type") == "view", "average").when(F.col("event_type") == "click", "perceptual").otherwise(F.col("event_type"))
    text = codecs.paths_to_json(F.array("event_type", F.col("user_id").cast("string")))
    data = codecs.has_data(F.when(F.col("event_id") % 4 == 0, F.col("event_type")), F.lit(None).cast("long"))
    return e.select("event_id", codecs.decode(code, codecs.ALGORITHMS, "Difference").alias("algorithm"), text.alias("paths"), F.size(codecs.paths_from_json(text)).alias("n_paths"), data.cast("int").alias("has_data"))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def history_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


_MILESTONES = (1000.0, 5000.0, 10000.0, 50000.0, 100000.0)
_REACHED = " + ".join(f"CAST({{t}} >= {m} AS INTEGER)" for m in _MILESTONES)


@query(f"""WITH w AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_type = 'purchase' AND value > 0),
t AS (SELECT *, sum(cents) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM w), r AS (SELECT user_id, event_id, CAST(total AS BIGINT) AS total, {_REACHED.format(t="total")} AS reached, {_REACHED.format(t="(total - cents)")} AS before FROM t)
SELECT user_id, event_id, total, reached FROM r WHERE reached > before""")
def milestones(spark, d):
    rows = table(spark, d, "events").filter("event_type = 'purchase' AND value > 0").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return stores.milestones_passed(rows, "user_id", "event_id", "cents", _MILESTONES)


# ---------------------------------------------------------------- trash

_TRASH = """WITH r AS (SELECT CAST(event_id AS VARCHAR) AS request_id, 'lib/' || CASE WHEN user_id % 11 = 0 THEN 'a:' ELSE 'photo ' END || user_id || '.jpg' AS path,
  CASE event_type WHEN 'view' THEN 'trash' WHEN 'click' THEN 'restore' ELSE 'open' END AS action, event_id AS seq, user_id % 10 <> 0 AS there, user_id % 11 = 0 AS odd FROM events),
j AS (SELECT *, CASE WHEN action = 'open' THEN 'Unknown action' WHEN action = 'restore' AND odd THEN 'Invalid filename (contains unsafe characters)' WHEN action = 'trash' AND NOT there THEN 'File not found' END AS refused FROM r),
a AS (SELECT *, lag(action) OVER (PARTITION BY path, refused IS NULL ORDER BY seq, request_id) AS before FROM j),
e AS (SELECT request_id, path, action, seq, CASE WHEN refused IS NOT NULL THEN refused WHEN action = 'trash' AND before = 'trash' THEN 'Already in trash' WHEN action = 'restore' AND before IS DISTINCT FROM 'trash' THEN 'Not found in trash' END AS error FROM a),
actions AS (SELECT request_id, path, action, CASE WHEN error IS NULL THEN 'planned' ELSE 'failed' END AS status, error, seq FROM e),
gone AS (SELECT path FROM (SELECT path, action, row_number() OVER (PARTITION BY path ORDER BY seq DESC, request_id DESC) AS k FROM actions WHERE status = 'planned') WHERE k = 1 AND action = 'trash') """


def _actions(spark, d):
    """All events as requests: the earlier ones are in the log when all of them are asked for (again)."""
    e, user = table(spark, d, "events"), F.col("user_id").cast("string")
    path = F.concat(F.lit("lib/"), F.when(F.col("user_id") % 11 == 0, "a:").otherwise("photo "), user, F.lit(".jpg"))
    action = F.when(F.col("event_type") == "view", "trash").when(F.col("event_type") == "click", "restore").otherwise("open")
    requests = e.select(F.col("event_id").cast("string").alias("request_id"), path.alias("path"), action.alias("action"), F.col("event_id").alias("seq"))
    files = e.filter("user_id % 10 <> 0").select(path.alias("path"))
    log = Workspace(spark, "trash").save(trash.resolve(requests.filter("seq < 2500"), files), "log")
    return log.unionByName(trash.resolve(requests, files, log))


@query(_TRASH + "SELECT * FROM actions")
def trash_actions(spark, d):
    return _actions(spark, d)


@query(_TRASH + "SELECT count(*) FILTER (WHERE action = 'trash' AND status = 'planned') AS trashed, count(*) FILTER (WHERE action = 'restore' AND status = 'planned') AS restored, count(*) FILTER (WHERE status = 'failed') AS failed FROM actions")
def trash_outcome(spark, d):
    return trash.outcome(_actions(spark, d))


@query(_TRASH + "SELECT event_id, path FROM (SELECT event_id, 'lib/photo ' || user_id || '.jpg' AS path FROM events) WHERE path NOT IN (SELECT path FROM gone)")
def trash_evicted(spark, d):
    cache = table(spark, d, "events").select("event_id", F.concat(F.lit("lib/photo "), F.col("user_id").cast("string"), F.lit(".jpg")).alias("path"))
    return trash.evict(cache, _actions(spark, d)).select("event_id", "path")


# ---------------------------------------------------------------- streams, as batches


@query("""WITH g AS (SELECT user_id, ts, event_type, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, (epoch_us(min(ts)) // 1000) AS start_ms, count(*) AS events, max(struct_pack(ts := ts, kind := event_type)).kind AS kind FROM s GROUP BY user_id, k""")
def session_debounce(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "kind").select("user_id", "ts", "kind")
    return watch.debounce(e, "user_id", "1 hour").select("user_id", F.unix_millis("start").alias("start_ms"), "events", "kind")


@query("""WITH b AS (SELECT doc_id, n_chars AS s FROM documents WHERE doc_id % 10 <> 0), a AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS s FROM documents WHERE doc_id % 7 <> 0)
SELECT * FROM (SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'create' WHEN a.doc_id IS NULL THEN 'remove' WHEN a.s <> b.s THEN 'modify' END AS kind FROM b FULL JOIN a ON a.doc_id = b.doc_id) WHERE kind IS NOT NULL""")
def watch_changes(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit(0).cast("timestamp").alias("modified"))
    after = docs.filter("path % 7 <> 0").withColumn("size", F.when(F.col("path") % 4 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return watch.changes(docs.filter("path % 10 <> 0"), after).withColumnRenamed("path", "doc_id")


@query("SELECT user_id, event_type AS kind, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def watch_latest_state(spark, d):
    return watch.latest_state(table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("kind")), "user_id", "ts", "event_id").select("user_id", "kind", "event_id")


@query("SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NULL OR value > m")
def monotonic_progress(spark, d):
    return watch.running_maximum(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


# ---------------------------------------------------------------- reports and texts


@query(_GROUPS + "SELECT group_key, size, match_type FROM groups WHERE contains(match_type, 'Similar') ORDER BY duplicate_bytes DESC")
def ui_filter_sort(spark, d):
    return report.sorted_groups(report.of_kind(_grouped(spark, d)[1], "similar"), "size").select("group_key", "size", "match_type")


_SIZE = "CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE n || ' B' END"


@query(f"SELECT o_orderkey, {_SIZE} AS size_text, regexp_replace({_SIZE}, '\\.0 ', ' ') AS short_text FROM (SELECT o_orderkey, (o_orderkey * 7919) % 5000000000 * (o_orderkey % 3) AS n FROM orders)")
def fmt_bytes(spark, d):
    n = (F.col("o_orderkey") * 7919) % 5000000000 * (F.col("o_orderkey") % 3)
    return table(spark, d, "orders").select("o_orderkey", wording.byte_size(n).alias("size_text"), wording.byte_size_short(n).alias("short_text"))


_MAP = " || chr(10) || ".join("(" + " || ".join(f"CASE WHEN (x >> {8 * r + c}) & 1 = 1 THEN 'X' ELSE '.' END" for c in range(8)) + ")" for r in range(8))


@query(f"WITH RECURSIVE {_pairs(0, 4)} SELECT a, b, {_MAP} AS difference_map, distance || ' of 64 bits differ (' || printf('%.1f', 100.0::DOUBLE - distance / 64.0::DOUBLE * 100) || '% similar)' AS summary FROM (SELECT p.*, xor(s.h, t.h) AS x FROM pairs p JOIN sig s ON s.id = a JOIN sig t ON t.id = b)")
def hash_diff_map(spark, d):
    rows = simjoin.similar_pairs(proxies.signatures(spark, d).withColumn("own", F.col("h")), 4, carried=("own",))
    return rows.select("a", "b", wording.difference_map(F.col("own_a"), F.col("own_b")).alias("difference_map"), wording.difference_summary(F.col("distance")).alias("summary"))


@query(f"""WITH RECURSIVE {_pairs()}, m AS (SELECT a, b, distance, (1 - distance / 64.0::DOUBLE) * 100 AS s FROM pairs)
SELECT a, b, CASE WHEN distance = 0 THEN 'These photos are identical' WHEN distance <= 4 THEN 'These photos are virtually identical (' || printf('%.0f', s) || '% match)' ELSE 'These photos are very similar (' || printf('%.0f', s) || '% match) - likely the same photo with different edits' END AS summary,
'[' || repeat('█', CAST(round(s / 10) AS INTEGER)) || repeat('░', 10 - CAST(round(s / 10) AS INTEGER)) || '] ' || printf('%.0f', s) || '%' AS bar FROM m""")
def explain_pair(spark, d):
    m = _matches(spark, d)
    return m.select("a", "b", wording.match_summary(F.col("match_type"), F.col("similarity_percent")).alias("summary"), wording.similarity_bar(F.col("similarity_percent")).alias("bar"))


@query(f"""WITH {FILES}, m AS (SELECT 'large' AS module, count(*) AS items, CAST(sum(size) AS BIGINT) AS bytes FROM parts WHERE size >= 1048 AND ext IN ({_LIST(paths.LARGE_FILE_EXTENSIONS)})
UNION ALL SELECT 'copies', count(*), CAST(sum(n_chars) AS BIGINT) FROM (SELECT n_chars, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r > 1)
SELECT * FROM m UNION ALL SELECT 'total', CAST(sum(items) AS BIGINT), CAST(sum(bytes) AS BIGINT) FROM m""")
def master_summary(spark, d):
    files = proxies.files(spark, d)
    large = files.filter((F.col("size") >= 1048) & paths.has_extension(F.col("path"), paths.LARGE_FILE_EXTENSIONS))
    first = files.groupBy(F.md5("text").alias("c")).agg(F.min("id").alias("first"))
    copies = files.withColumn("c", F.md5("text")).join(first, "c").filter("id <> first")
    return report.master_summary(("large", large, "id", "size"), ("copies", copies, "id", "size"))


@query("SELECT o_orderkey, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', ms / 1000.0::DOUBLE) ELSE (ms // 60000) || 'm ' || (ms % 60000 // 1000) || 's' END AS duration FROM (SELECT o_orderkey, (o_orderkey * 37) % 200000 AS ms FROM orders)")
def fmt_duration(spark, d):
    ms = F.expr("(o_orderkey * 37) % 200000")
    return table(spark, d, "orders").select("o_orderkey", wording.duration(ms).alias("duration"))


@query("SELECT p_partkey, p_name NOT IN ('.', '..') AND strlen(p_name) BETWEEN 1 AND 255 AND regexp_full_match(p_name, '[\\p{L}\\p{N} .\\-_()\\[\\]]+') AS safe FROM part")
def safe_names(spark, d):
    return table(spark, d, "part").select("p_partkey", paths.is_safe_name(F.col("p_name")).alias("safe"))
