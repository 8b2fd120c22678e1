"""Operators against brute force and the values that the semantics fix."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths, wording
from tessera.functions import signatures as S
from tessera.operators import groups, organize, prefilter, report, rules, simjoin, stores
from tessera.operators.components import connected_components
from tessera.tables import Workspace, temporary_tables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def _hashes(n=120, seed=3):
    r = random.Random(seed)
    seeds = [r.getrandbits(64) for _ in range(8)]
    out = []
    for i in range(n):
        h = r.choice(seeds)
        for _ in range(r.randrange(9)):
            h ^= 1 << r.randrange(64)
        out.append((i, h - (1 << 64) if h >> 63 else h))
    return out


@pytest.mark.parametrize("threshold", [0, 5, 8])
def test_exact_join_equals_brute_force(spark, threshold):
    rows = _hashes()
    want = {(i, j, (a ^ b & (2**64 - 1)).bit_count() if a >= 0 and b >= 0 else ((a ^ b) & (2**64 - 1)).bit_count()) for i, a in rows for j, b in rows if i < j}
    want = {x for x in want if x[2] <= threshold}
    df = spark.createDataFrame([*rows, (None, 5), (999, None)], "id long, h long")
    got = {tuple(r) for r in simjoin.similar_pairs(df, threshold).collect()}
    assert got == want
    lsh = {tuple(r) for r in simjoin.similar_pairs(df, threshold, candidates="lsh").collect()}
    assert lsh <= want
    if threshold <= 3:
        assert lsh == want


def test_threshold_range_and_candidates_are_checked(spark):
    df = spark.createDataFrame([(1, 1)], "id long, h long")
    with pytest.raises(ValueError):
        simjoin.similar_pairs(df, 65)
    with pytest.raises(ValueError):
        simjoin.similar_pairs(df, 5, candidates="other")


@pytest.mark.parametrize("threshold", [0, 3, 8, 12, 15])
def test_all_plans_give_the_same_pairs(spark, threshold):
    rows = _hashes(300, 17)
    distinct = spark.createDataFrame([(h,) for h in {h for _, h in rows}], "h long")
    n = distinct.count()
    pairs = lambda df: sorted(map(tuple, df.collect()))
    product = pairs(simjoin.product_pairs(distinct, threshold, n))
    u = lambda h: h & (2**64 - 1)
    hs = sorted(r.h for r in distinct.collect())
    assert product == sorted((a, b, (u(a) ^ u(b)).bit_count()) for i, a in enumerate(hs) for b in hs[i + 1 :] if (u(a) ^ u(b)).bit_count() <= threshold)
    assert pairs(simjoin.product_pairs(distinct, threshold, n, block=40)) == product
    for layout in simjoin._layouts(threshold, 300)[:3]:
        assert pairs(simjoin.lookup_pairs(distinct, layout, threshold)) == product


def test_the_plan_follows_the_cost(spark):
    few = spark.createDataFrame([(i * 7919,) for i in range(50)], "h long")
    assert simjoin.choose_plan(few, 50, 8) is None and simjoin.choose_plan(few, 9_000, 15) is None
    # Very many signatures are looked up, unless the bands' values are all the same.
    spread = spark.range(2000).select(F.xxhash64("id").alias("h"))
    assert simjoin.choose_plan(spread, 50_000_000, 3) is not None
    alike = spark.range(2000).select((F.xxhash64("id") % 2).alias("h")).distinct()
    share = simjoin.band_recurrence(spread.union(alike), 2002, [(0, 8), (0, 64)])
    assert abs(share[0, 8] - 1 / 256) < 1e-3 and share[0, 64] < 1e-6


def test_partners_are_found_without_pairs_of_rows(spark):
    rows = _hashes(150, 9) + [(500, 3), (501, 3), (None, 3), (502, None)]
    u = lambda h: h & (2**64 - 1)
    want = {i for i, h in rows if i is not None and h is not None and any(j is not None and j != i and g is not None and (u(h) ^ u(g)).bit_count() <= 4 for j, g in rows)}
    assert {r.id for r in prefilter.with_partner(spark.createDataFrame(rows, "id long, h long"), "h", 4).collect()} == want


def test_links_connect_like_pairs(spark):
    df = spark.createDataFrame(_hashes(80, 5) + [(500, 7), (501, 7), (502, 7)], "id long, h long")
    by = lambda edges: {tuple(r) for r in connected_components(edges, "a", "b").collect()}
    assert by(simjoin.links(df, 8)) == by(simjoin.similar_pairs(df, 8))


@pytest.mark.parametrize("edges,want", [([("a", "b"), ("b", "c")], {"a": "a", "b": "a", "c": "a"}), ([("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")], {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}), ([], {})])
def test_components(spark, edges, want):
    df = spark.createDataFrame(edges, "u string, v string")
    assert dict(map(tuple, connected_components(df, "u", "v").collect())) == want


def test_components_of_a_long_chain(spark):
    df = spark.range(99).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    rows = connected_components(df, "u", "v").collect()
    assert len(rows) == 100 and {r.component for r in rows} == {0}


@pytest.mark.parametrize(("hot_degree", "chunk"), [(100_000, 2_000_000), (5, 3), (3, 1)])
def test_components_equal_a_plain_search(spark, hot_degree, chunk):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000, i) for i in range(1001, 1060)] + [(i, i + 1) for i in range(2000, 2070)] + [(7, 7), (None, 3), (4, None)]
    parent = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a in parent and b in parent and (a, b) != (7, 7):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    df = spark.createDataFrame(edges, "u long, v long").repartition(6)
    assert dict(map(tuple, connected_components(df, "u", "v", hot_degree=hot_degree, chunk=chunk).collect())) == {x: root(x) for x in parent}
    names = df.select(F.lpad(F.col("u").cast("string"), 5, "0").alias("u"), F.lpad(F.col("v").cast("string"), 5, "0").alias("v"))
    assert dict(map(tuple, connected_components(names, "u", "v", hot_degree=hot_degree, chunk=chunk).collect())) == {f"{x:05d}": f"{root(x):05d}" for x in parent}


def test_match_classes_and_similarity(spark):
    assert [value(spark, S.match_type(F.lit(d))) for d in (0, 3, 7, 15)] == ["Exact", "NearExact", "Similar", "MaybeSimilar"]
    assert value(spark, S.similarity(F.lit(0))) == 100 and value(spark, S.similarity(F.lit(64))) == 0
    assert value(spark, S.hamming_binary(F.lit(b"\xff\x00"), F.lit(b"\x00\x00"))) == 8
    assert value(spark, S.hamming_binary(F.lit(b"\xff"), F.lit(b"\x00\x00"))) is None


def test_fusion_codec(spark):
    parts = [b"\x01", b"\x02\x03", b"\x04"]
    code = value(spark, S.fusion_encode([F.lit(p) for p in parts]))
    assert bytes(code) == b"\x01\0\x01\x02\0\x02\x03\x01\0\x04"
    assert [bytes(x) for x in value(spark, S.fusion_decode(F.lit(bytes(code))))] == parts
    assert value(spark, S.fusion_decode(F.lit(b"\x05\0\x01"))) is None


def test_fusion_votes(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 0, 255), (3, 0, 255, 255)], "id long, ahash long, dhash long, phash long")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    got = {(r.a, r.b): (r.votes, r.confidence, r.is_duplicate) for r in simjoin.fusion_votes(rows, pairs, 5).collect()}
    assert got == {(1, 2): (2, "Medium", True), (1, 3): (1, "Low", False)}


def test_prefilters(spark):
    files = spark.createDataFrame([(1, 1000, b"a"), (2, 1000, b"a"), (3, 2000, b"c"), (4, 3000, None)], "id long, size long, content binary")
    assert {r.id for r in prefilter.same_size(files).collect()} == {1, 2}
    assert {r.id for r in prefilter.same_prefix(files, F.col("content")).collect()} == {1, 2, 4}
    assert prefilter.prefilter(files, F.col("content"), "exact").count() == 4  # below the gate
    text = lambda i, size, begin: (i, size, begin)
    many = spark.createDataFrame([text(1, 5, b"a"), text(2, 5, b"a"), text(3, 5, b"b"), text(4, 6, b"a"), text(5, None, b"a"), text(6, 5, None), text(7, 8, b"c"), text(8, 8, b"c")], "id long, size long, content binary")
    kept = prefilter.same_size(many)
    assert tuple(prefilter.skips(many, F.col("content")).first()) == (many.count() - kept.count(), kept.count() - prefilter.same_prefix(kept, F.col("content")).count())
    two = prefilter.two_phase(spark.createDataFrame([(1, 0, 9), (2, 1, 9), (3, -1, 9)], "id long, a long, d long"), "a", ["d"], 3)
    assert {(r.id, r.d) for r in two.collect()} == {(1, 9), (2, 9), (3, None)}


def test_group_representative_and_savings(spark):
    matches = spark.createDataFrame([(1, 2, 0, "Exact"), (2, 3, 6, "Similar")], "a long, b long, distance int, match_type string")
    members = groups.members_of(matches)
    files = spark.createDataFrame([(1, 10), (2, 30), (3, 30)], "id long, size long")
    row = groups.duplicate_groups(groups.pair_stats(matches, members), files, members).first()
    assert (row.group_key, row["size"], row.representative, row.match_type, row.average_distance, row.duplicate_bytes) == (1, 3, 3, "Exact", 3.0, 40)


@pytest.mark.parametrize("strategy,kept", [("duplicates", 2), ("largest", 1), ("oldest", 3), ("most_recent", 1), ("highest_resolution", 2), ("raw", 3), ("most_metadata", 1), ("sharpest", 3), ("composite", 3)])
def test_keep_strategies(spark, strategy, kept):
    t = lambda d: datetime.datetime(2024, 1, d)
    rows = spark.createDataFrame([(1, 1, "a.jpg", 90, 10, 10, t(9), False, 1.0), (1, 2, "b.jpg", 50, 20, 20, t(8), True, None), (1, 3, "c.NEF", 70, None, None, t(7), False, 5.0)], "group_key long, pos long, path string, size long, width int, height int, modified timestamp, is_representative boolean, overall double")
    assert [r.pos for r in groups.keep_strategy(rows, strategy).filter("keep").collect()] == [kept]


def test_conflict_numbers_skip_taken_names(spark):
    files = spark.createDataFrame([("a", "p.jpg", None, 1), ("b", "p.jpg", None, 1), ("c", "p_1.jpg", None, 1), ("d", "p.jpg", None, 1)], "source string, name string, date date, size long")
    got = {r.source: r.destination for r in organize.plan(files).collect()}
    assert len(set(got.values())) == 4 and got["a"] == "Unsorted/p.jpg" and got["c"] == "Unsorted/p_1.jpg"


def test_folders(spark):
    day = F.lit(datetime.date(2024, 1, 15))
    assert [value(spark, organize.folder(day, s)) for s in organize.FOLDERS] == ["2024/01 - January", "2024/01/15", "2024-01"]
    assert value(spark, organize.folder(F.lit(None).cast("date"))) == "Unsorted"


def test_plan_execution(spark, tmp_path):
    source = tmp_path / "x.jpg"
    source.write_bytes(b"1234")
    planned = spark.createDataFrame([(str(source), "2024/x.jpg"), (str(tmp_path / "none"), "2024/y.jpg")], "source string, destination string")
    assert {r.status for r in organize.execute(planned, str(tmp_path)).collect()} == {"planned"}
    got = {r.destination: r.status for r in organize.execute(planned, str(tmp_path / "out"), move=True, dry_run=False).collect()}
    assert got == {"2024/x.jpg": "done", "2024/y.jpg": "failed"} and not source.exists() and (tmp_path / "out/2024/x.jpg").read_bytes() == b"1234"


@pytest.mark.parametrize("path,want", [("IMG_001.jpg", ["in_root", "no_date_pattern", "generic_name"]), ("photos/DSC_0001.jpg", ["shallow_folder", "no_date_pattern", "generic_name"]), ("2024/01/vacation_photo.jpg", [])])
def test_unorganized(spark, path, want):
    assert value(spark, rules.unorganized_reasons(F.lit(path))) == want
    assert value(spark, rules.primary_reason(F.array(F.lit("no_date_pattern"), F.lit("in_root")))) == "in_root"


def test_screenshots(spark):
    verdict = lambda name, software=None, w=None, h=None: value(spark, rules.screenshot_verdict(F.lit(name), F.lit(software).cast("string"), F.lit(w).cast("int"), F.lit(h).cast("int")))
    assert verdict("a/Screenshot 1.png").confidence == "Medium"
    assert verdict("a/Screenshot 1.png", "Snipping Tool").confidence == "High"
    assert verdict("a/x.png", None, 2532, 1170).confidence == "Low"
    assert verdict("a/x.jpg", "camera", 4000, 3000) is None


def test_wording(spark):
    assert [value(spark, wording.byte_size(F.lit(n).cast("long"))) for n in (500, 1024, 5_000_000)] == ["500 B", "1.0 KB", "4.8 MB"]
    assert value(spark, wording.difference_map(F.lit(0).cast("long"), F.lit(-1).cast("long"))).count("X") == 64
    assert value(spark, wording.camera_name(F.lit("Apple"), F.lit("Apple iPhone 15 Pro"))) == "Apple iPhone 15 Pro"
    assert value(spark, wording.camera_name(F.lit("Canon"), F.lit("EOS R5"))) == "Canon EOS R5"
    assert value(spark, wording.lenient_date(F.lit('"2024:01:15 14:30:00"'))) == datetime.date(2024, 1, 15)
    assert value(spark, wording.duration(F.lit(61000))) == "1m 1s" and value(spark, wording.sensitivity(F.lit(5))) == "Standard Balance"
    assert value(spark, wording.time_ago(F.lit(10_000), F.lit(2_000))) == "2h ago"


def test_paths(spark):
    assert [value(spark, paths.is_photo_name(F.lit(p))) for p in ("a/b.JPG", "a/.b.jpg", "a/b.pdf", "a/b")] == [True, False, False, False]
    assert value(spark, paths.header_format(F.lit(b"\x89PNG\r\n\x1a\n"))) == "Png" and value(spark, paths.header_format(F.lit(bytes(range(8))))) is None
    assert value(spark, paths.is_safe_name(F.lit("a (1)_é.jpg"))) and not value(spark, paths.is_safe_name(F.lit("a/b")))
    assert value(spark, paths.fold_home(F.lit("/home/x/y"), "/home/x")) == "~/y"


def test_stores(spark, tmp_path):
    store = stores.hash_cache(spark, str(tmp_path / "cache"))
    t = datetime.datetime(2024, 1, 1)
    row = lambda p, h, c: (p, "difference", h, 4, t, c)
    assert store.read().count() == 0
    store.upsert(spark.createDataFrame([row("a", b"1", t), row("b", b"2", t)], stores.CACHE_SCHEMA))
    store.upsert(spark.createDataFrame([row("a", b"9", datetime.datetime(2024, 1, 2))], stores.CACHE_SCHEMA))
    assert {(r.path, bytes(r.hash)) for r in store.read().collect()} == {("a", b"9"), ("b", b"2")}
    files = spark.createDataFrame([("a", 4, t, "difference"), ("b", 5, t, "difference"), ("c", 4, t, "difference")], "path string, size long, modified timestamp, algorithm string")
    assert {r.path: r.hash is not None for r in stores.cache_lookup(files, store.read()).collect()} == {"a": True, "b": False, "c": False}
    assert store.remove(spark.createDataFrame([("a", "difference")], "path string, algorithm string")) == 1 and store.clear() == 1 and store.read().count() == 0


def test_trash_and_totals(spark):
    lines = spark.createDataFrame([("x.jpg|/a|12|99",), ("short|1",), ("y|/b|bad|7",)], "value string")
    assert {tuple(r) for r in stores.parse_trash(lines).collect()} == {("x.jpg", "/a", 12, 99), ("y", "/b", 0, 7)}
    assert stores.lifetime_savings(spark.createDataFrame([('{"lifetime_bytes": 5}',)], "value string")).first().bytes == 5
    assert stores.lifetime_savings(spark.createDataFrame([("broken",)], "value string")).first().bytes == 0
    assert value(spark, stores.milestone_progress(F.lit(150.0), (100.0, 200.0))) == 50.0


def test_reports(spark, tmp_path):
    found = spark.createDataFrame([("g", 2, "Exact", 40)], "group_key string, size int, match_type string, duplicate_bytes long").withColumn("representative", F.lit("a"))
    members = spark.createDataFrame([("g", "a", True), ("g", "b", False)], "group_key string, id string, is_representative boolean")
    files = spark.createDataFrame([("a", "x,1.jpg", 40), ("b", "<y>.jpg", 40)], "id string, path string, size long")
    assert report.export(found, members, files, str(tmp_path / "csv"), "csv") == (str(tmp_path / "csv"), "csv", 1)
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert len(rows) == 2 and sum(r["Is Representative"] == "true" for r in rows) == 1 and {r["Photo Path"] for r in rows} == {"x,1.jpg", "<y>.jpg"}
    totals = spark.createDataFrame([(1, 1, 40)], "groups int, duplicates int, savings_bytes long")
    assert report.export(found, members, files, str(tmp_path / "T & t"), "html", totals)[1:] == ("html", 1)
    index, page = ((tmp_path / "T & t" / n).read_text() for n in ("index.html", "pages/page-00001.html"))
    assert index.startswith("<!DOCTYPE html>") and "T &amp; t" in index and "pages/page-00001.html" in index and "40 B" in index
    assert page.startswith("<!DOCTYPE html>") and "&lt;y&gt;" in page and page.count("<li>") == 2 and page.count("KEEP") == 1
    with pytest.raises(ValueError):
        report.export(found, members, files, "x", "pdf")


def test_temporary_tables_go(spark):
    import os

    with temporary_tables():
        kept = Workspace(spark, "scope")
        assert kept.save(spark.range(3), "t").count() == 3 and os.path.isdir(kept.path)
    assert not os.path.isdir(kept.path)


def test_sort_modes(spark):
    rows = spark.createDataFrame([(1, 2, "Similar", 50), (2, 9, "Exact", 10), (3, 5, "NearExact", 90)], "group_key long, size long, match_type string, duplicate_bytes long")
    order = lambda mode: [r.group_key for r in report.sorted_groups(rows, mode).collect()]
    assert order("size") == [3, 1, 2] and order("count") == [2, 3, 1] and order("type") == [2, 3, 1]


def test_html_pages_hold_all_members(spark, tmp_path):
    groups_ = spark.range(40).select(F.col("id").alias("group_key"), F.lit("Exact").alias("match_type"), (F.col("id") * 10).alias("duplicate_bytes"))
    members = spark.range(1000).select((F.col("id") % 40).alias("group_key"), "id", (F.col("id") < 40).alias("is_representative"))
    files = spark.range(1000).select("id", F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(".jpg")).alias("path"), F.lit(1).alias("size"))
    totals = spark.createDataFrame([(40, 960, 5)], "groups int, duplicates int, savings_bytes long")
    out = "file://" + str(tmp_path / "report")
    n = report.write_html(groups_, members, files, totals, out, "all", rows_per_page=120)
    pages = sorted((tmp_path / "report/pages").glob("*.html"))
    assert 6 <= len(pages) == n <= 9 and len(list((tmp_path / "report/pages").iterdir())) <= 2 * n
    texts = [p.read_text() for p in pages]
    assert sorted(re.findall(r"f\d{4}", "".join(texts))) == [f"f{i:04d}" for i in range(1000)] and all(t.startswith("<!DOCTYPE") and t.rstrip().endswith("</html>") for t in texts)
    assert "f0039.jpg <b>KEEP</b>" in texts[0]  # the group with the most bytes comes first
    # Again into the same folder, without groups.
    assert report.write_html(groups_.limit(0), members, files, totals, out, "all") == 0 and (tmp_path / "report/index.html").exists() and not list((tmp_path / "report/pages").glob("*.html"))
