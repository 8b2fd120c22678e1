"""Keyed stores under concurrent writers, pruned lookups, the trash log, and running values over large groups."""

import datetime
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import groups, keyed, organize, simjoin, stores, trash
from tessera.operators.running import Running, running
from tessera.streaming import neardup, watch
from tessera.tables import Workspace

T = datetime.datetime(2024, 1, 1)


def total(spark, name, n, minute):
    return spark.createDataFrame([(name, n, T + datetime.timedelta(minutes=minute))], stores.LIFETIME_SCHEMA)


def content(store):
    return {(r.name, r.lifetime_bytes) for r in store.read().collect()}


def test_two_writers_lose_nothing(spark, tmp_path):
    path, problems = str(tmp_path / "totals"), []

    def write(who):
        try:
            store = stores.lifetime_totals(spark, path)
            store.most_changes = 5
            for i in range(8):
                store.upsert(total(spark, f"{who}{i}", i, i).union(total(spark, "both", i, 10 * i + (who == "b"))))
        except Exception as problem:  # noqa: BLE001
            problems.append(problem)

    threads = [threading.Thread(target=write, args=(who,)) for who in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not problems
    store = stores.lifetime_totals(spark, path)
    assert content(store) == {(f"{who}{i}", i) for who in "ab" for i in range(8)} | {("both", 7)}
    numbers = [e["number"] for e in store.log()]
    assert len(set(numbers)) == len(numbers)


def test_a_taken_number_is_not_taken_again(spark, tmp_path):
    store = stores.lifetime_totals(spark, str(tmp_path / "totals"))
    assert store.files.publish("{}", "log/x") and not store.files.publish("[]", "log/x") and store.files.read("log/x") == "{}"
    store.files.delete("log/x")
    # Both list an empty log; the second one finds its number taken.
    other = stores.lifetime_totals(spark, str(tmp_path / "totals"))
    listed = other.files.names
    other.files.names = lambda folder: []
    assert store.upsert(total(spark, "a", 1, 1)) == 1 and other._commit(keyed.ROWS, other._write(total(spark, "b", 2, 1))) == 2
    other.files.names = listed
    assert content(store) == content(other) == {("a", 1), ("b", 2)}


def test_removals_and_whole_versions_keep_later_changes(spark, tmp_path):
    store = stores.lifetime_totals(spark, str(tmp_path / "totals"))
    store.upsert(total(spark, "a", 1, 5).union(total(spark, "b", 1, 5)))
    assert store.remove(spark.createDataFrame([("a",), ("none",)], "name string")) == 1 and content(store) == {("b", 1)}
    store.upsert(total(spark, "a", 2, 1))  # an earlier time, but a later change than the removal
    assert content(store) == {("a", 2), ("b", 1)}
    # A change that comes while a whole version is being written stays.
    slow, write = stores.lifetime_totals(spark, store.path), keyed.KeyedStore._write

    def meanwhile(rows):
        store.upsert(total(spark, "c", 3, 3))
        return write(slow, rows)

    slow._write = meanwhile
    slow.compact(buckets=3)
    assert content(store) == {("a", 2), ("b", 1), ("c", 3)}
    assert store.clear() == 3 and content(store) == set()
    store.upsert(total(spark, "d", 4, 4))
    store.compact()
    store.compact()
    assert content(store) == {("d", 4)} and len(store.files.names("data")) <= 2
    os.makedirs(tmp_path / "totals/data/lost")
    assert store.vacuum(seconds=3600) == 0 and store.vacuum(seconds=0) == 1 and content(store) == {("d", 4)}


def test_lookups_read_only_touched_buckets(spark, tmp_path):
    store = stores.hash_cache(spark, str(tmp_path / "cache"))
    rows = spark.range(2000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") % 2 == 0, "average").otherwise("difference").alias("algorithm"), F.lit(b"h").alias("hash"), F.col("id").alias("file_size"), F.lit(T).alias("file_modified"), F.lit(T).alias("cached_at"))
    store.upsert(rows)
    files = spark.createDataFrame([("p4", 4, T, "average"), ("p5", 5, T, "average"), ("p6", 7, T, "average"), ("none", 1, T, "average")], "path string, size long, modified timestamp, algorithm string")
    found = stores.cached(files, store)
    assert {r.path: r.hash is not None for r in found.collect()} == {"p4": True, "p5": False, "p6": False, "none": False}
    assert {r.path: r.hash is not None for r in stores.cached(files, store, by_algorithm=False).collect()} == {"p4": True, "p5": True, "p6": False, "none": False}
    touched = store.touched(files)
    assert 0 < len(touched) <= 4 < store.buckets
    # The scan's own counts: one folder for each touched bucket of the one change.
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert scans and all("_bucket" in line and all(str(b) in line for b in touched) for line in scans)
    read = store._table(store._current()[0][0], {store.buckets: touched}).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.partition("_bucket=")[2].partition("/")[0] for r in read} == {str(b) for b in touched}
    point = store.lookup(spark.createDataFrame([("p7", "difference")], "path string, algorithm string"))
    assert [r.file_size for r in point.collect()] == [7]
    # Buckets of several numbers are read side by side until a whole version deals all rows anew.
    wide = stores.hash_cache(spark, store.path)
    wide.buckets = 5
    wide.upsert(rows.filter("file_size = 4").withColumn("hash", F.lit(b"new")).withColumn("cached_at", F.lit(T + datetime.timedelta(days=1))))
    assert {bytes(r.hash) for r in stores.cached(files, store).filter("path = 'p4'").collect()} == {b"new"}
    wide.compact()
    assert {e["buckets"] for e in wide._current()[0]} == {5} and wide.read().count() == 2000


def test_null_keys_are_keys(spark, tmp_path):
    store = stores.lifetime_totals(spark, str(tmp_path / "totals"))
    store.upsert(total(spark, None, 1, 1))
    store.upsert(total(spark, None, 2, 2))
    assert content(store) == {(None, 2)} and store.lookup(spark.createDataFrame([(None,)], "name string")).count() == 1
    assert store.remove(spark.createDataFrame([(None,)], "name string")) == 1 and content(store) == set()


# Trash -----------------------------------------------------------------------------------------------------------------


def plain_actions(requests, files):
    there, state, out, seen = set(files), {}, {}, set()
    for rid, path, action, _ in sorted(requests, key=lambda r: (r[3], r[0])):
        if rid in seen:
            continue
        seen.add(rid)
        name = (path or "").rpartition("/")[2]
        if path is None:
            error = "No path"
        elif action not in ("trash", "restore"):
            error = "Unknown action"
        elif action == "restore" and ":" in name:
            error = "Invalid filename (contains unsafe characters)"
        elif action == "trash":
            error = "Already in trash" if state.get(path) == "trash" else None if path in there else "File not found"
        else:
            error = None if state.get(path) == "trash" else "Not found in trash"
        if error is None:
            state[path] = action
        out[rid] = (path, action, "failed" if error else "planned", error)
    return out


REQUEST = "request_id string, path string, action string, seq long"


@pytest.mark.parametrize("group_rows", [3, 100_000])
def test_actions_equal_a_plain_replay(spark, group_rows):
    r = random.Random(5)
    names = ["d/a.jpg", "d/b.jpg", "d/x:y.jpg", "d/none.jpg", None]
    requests = [(f"r{i}", r.choice(names[:2] if i % 3 else names), r.choice(["trash", "restore", "restore", "open"]), r.randrange(60)) for i in range(120)]
    files = spark.createDataFrame([(n,) for n in names[:3]], "path string")
    asked = spark.createDataFrame(requests + requests[:20], REQUEST)
    rows = lambda df: {x.request_id: (x.path, x.action, x.status, x.error) for x in df.collect()}
    want = plain_actions(requests, names[:3])
    assert rows(trash.resolve(asked, files, group_rows=group_rows)) == want
    # In two parts, with all of the first asked for again: nothing is done twice.
    first = spark.createDataFrame([x for x in requests if x[3] < 30], REQUEST)
    saved = lambda name, df: Workspace(spark, name).save(df, "rows")
    log = saved("log", trash.resolve(first, files, group_rows=group_rows))
    second = saved("second", trash.resolve(asked, files, log, group_rows=group_rows))
    assert rows(log.unionByName(second)) == want and second.count() == len(want) - first.count()
    assert trash.resolve(asked, files, log.unionByName(second)).count() == 0
    assert trash.resolve(asked.limit(0), files, log).count() == 0


def test_files_go_to_the_trash_and_come_back(spark, tmp_path):
    for name in ("a.jpg", "b.jpg", "c.jpg"):
        (tmp_path / name).write_text(name)
    path = lambda n: str(tmp_path / n)
    exist = lambda: {n for n in ("a.jpg", "b.jpg", "c.jpg") if (tmp_path / n).exists()}
    listing = lambda: spark.createDataFrame([(path(n),) for n in sorted(exist())], "path string")
    log, root = trash.action_log(spark, str(tmp_path / "log")), str(tmp_path / "bin")
    ask = lambda *rows: spark.createDataFrame([(i, path(n), a, s) for i, n, a, s in rows], REQUEST)
    first = ask(("1", "a.jpg", "trash", 1), ("2", "b.jpg", "trash", 2), ("3", "b.jpg", "restore", 3), ("4", "none.jpg", "trash", 4))
    assert tuple(trash.run(first, listing(), log, root).first()) == (2, 1, 0) and exist() == {"b.jpg", "c.jpg"}
    states = lambda: {r.request_id: r.status for r in log.read().collect()}
    assert states() == {"1": "done", "2": "done", "3": "restored", "4": "failed"}
    # The same again changes nothing.
    before = log.read().drop("saved_at").collect()
    assert tuple(trash.run(first, listing(), log, root).first()) == (0, 0, 0) and exist() == {"b.jpg", "c.jpg"}
    assert sorted(map(str, log.read().drop("saved_at").collect())) == sorted(map(str, before))
    # A run that was cut off after a move is finished by the next one.
    trash.record(log, trash.resolve(ask(("5", "c.jpg", "trash", 5)), listing(), log.read()))
    trash.execute(log.read().filter("status = 'planned'").drop("saved_at"), root, dry_run=False).collect()
    assert exist() == {"b.jpg"} and states()["5"] == "planned"
    assert tuple(trash.run(ask(("6", "a.jpg", "restore", 6)), listing(), log, root).first()) == (1, 1, 0)
    assert states()["5"] == "done" and states()["6"] == "restored" and exist() == {"a.jpg", "b.jpg"} and (tmp_path / "a.jpg").read_text() == "a.jpg"
    assert {os.path.basename(r.path) for r in trash.in_trash(log.read()).collect()} == {"c.jpg"}
    # Its cache entries go.
    cache = stores.hash_cache(spark, str(tmp_path / "cache"))
    cache.upsert(spark.createDataFrame([(path(n), "difference", b"1", 4, T, T) for n in ("a.jpg", "c.jpg")], stores.CACHE_SCHEMA))
    assert trash.evict(cache.read(), log.read()).count() == 1 and trash.evict_from(cache, log.read()) == 1
    assert {os.path.basename(r.path) for r in cache.read().collect()} == {"a.jpg"}
    # A file that stands where another one should come back is not overwritten.
    (tmp_path / "c.jpg").write_text("new")
    assert tuple(trash.run(ask(("7", "c.jpg", "restore", 7)), listing(), log, root).first()) == (0, 0, 1)
    assert (tmp_path / "c.jpg").read_text() == "new" and {os.path.basename(r.path) for r in trash.in_trash(log.read()).collect()} == {"c.jpg"}


# Running values --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("group_rows", [7, 100_000])
def test_running_values_equal_a_plain_loop(spark, group_rows):
    r = random.Random(8)
    rows = [(r.choice(["big", "big", "big", "small", None]), i, r.choice([None, -3, 0, 2, 9]), r.choice(["x", "y", None])) for i in range(300)] + [("one", 0, 5, "z")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o long, v long, w string").repartition(5)
    what = Running(number="n", sums={"s": "v"}, maxima={"m": "v"}, previous={"p": "w"})
    got = {(x.k, x.o): (x.n, x.s, x.m, x.p) for x in running(df, ["k"], ["o"], what, group_rows).collect()}
    want, last = {}, {}
    for k, o, v, w in sorted(rows, key=lambda x: x[1]):
        n, s, m, p = last.get(k, (0, None, None, None))
        add = s if v is None else v if s is None else s + v
        want[k, o] = (n + 1, add, m, p)
        last[k] = (n + 1, add, m if v is None else v if m is None else max(m, v), w)
    assert got == want
    with pytest.raises(ValueError):
        running(df, ["k"], ["o"], Running(number="v"))


def test_plans_and_progress_of_large_groups(spark):
    files = spark.range(500).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("source"), F.when(F.col("id") % 9 == 0, "p_3.jpg").otherwise("p.jpg").alias("name"), F.lit(None).cast("date").alias("date"), F.lit(1).alias("size"))
    one, many = ({tuple(x) for x in organize.plan(files, group_rows=n).collect()} for n in (100_000, 20))
    assert one == many and len({x[4] for x in many}) == 500
    progress = spark.range(400).select(F.lit("s").alias("k"), F.col("id").alias("o"), ((F.col("id") * 37) % 101).alias("v"))
    one, many = ({tuple(x) for x in watch.running_maximum(progress, "k", "o", "v", n).collect()} for n in (100_000, 20))
    assert one == many and len(one) > 3
    one, many = ({tuple(x) for x in stores.milestones_passed(progress, "k", "o", "v", (100.0, 5000.0), n).collect()} for n in (100_000, 20))
    assert one == many and len(one) == 2


# Near duplicates on a stream -------------------------------------------------------------------------------------------


def test_groups_of_a_stream_equal_one_run(spark, tmp_path):
    r = random.Random(12)
    seeds, rows = [r.getrandbits(63) for _ in range(6)], []
    for i in range(90):
        h = r.choice(seeds) if i % 3 else r.getrandbits(63)
        for _ in range(r.randrange(7)):
            h ^= 1 << r.randrange(62)
        rows.append((i, h))
    rows += [(200, rows[0][1]), (201, rows[5][1]), (None, 5), (202, None)]
    # A late signature that joins two groups of earlier batches.
    rows = [(300, 0), (301, 0b11110000), *rows, (302, 0b00110000), (303, 0b11110000)]
    df = spark.createDataFrame(rows, "id long, h long")
    weighted = simjoin.weighted_pairs(df, 3)
    want = {tuple(x) for x in groups.signature_members(weighted, df)[0].collect()}
    src, kept = str(tmp_path / "in"), neardup.NearDuplicateStream(spark, str(tmp_path / "state"), threshold=3, buckets=4)
    for part in (rows[:40], rows[40:80], rows[80:]):
        spark.createDataFrame(part, "id long, h long").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("id long, h long").option("maxFilesPerTrigger", 1).parquet(src)
    query = kept.run(stream, str(tmp_path / "check"))
    assert query.awaitTermination(300)
    assert {tuple(x) for x in kept.groups().collect()} == want and (300, 302) in want and (300, 301) in want
    # A batch that runs again, as after a failure, changes nothing.
    kept.add(spark.createDataFrame(rows[80:], "id long, h long"), 2)
    assert {tuple(x) for x in kept.groups().collect()} == want
