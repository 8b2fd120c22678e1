"""Quality network, fill-in-the-middle and vector codes against brute force, gradients and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import infill, quality, queries, vector_codes

RND = random.Random(23)
ODD = "abZ <PSM>\n\x00é漢😀-.1"


def odd_text(n):
    return "".join(RND.choice(ODD) for _ in range(n))


# Quality ---------------------------------------------------------------------------------------------------------------


def test_pooling_equals_plain_chunks():
    rng = np.random.default_rng(3)
    net = quality.Network.new(rng)
    net.out = rng.standard_normal(net.out.shape).astype(np.float32)
    net.filter_bias = rng.standard_normal(net.filter_bias.shape).astype(np.float32)
    span, step = quality.CHUNK * quality.BLOCK, quality.STEP * quality.BLOCK

    def plain(data):
        size = max(1, -(-len(data) // quality.BLOCK)) * quality.BLOCK
        full = np.concatenate([data, np.full(size - len(data), quality.PAD)])
        starts = list(range(0, max(1, size - span + step), step))
        hidden = []
        for s in starts:
            places = [p for p in range(s, min(s + span, size), quality.STRIDE) if p + quality.WIDTH <= size]
            response = np.stack([net.bytes_[full[p : p + quality.WIDTH]].ravel() @ net.filters for p in places])
            pooled = np.append(np.maximum(response.max(axis=0) + net.filter_bias, 0), min(len(data) - s, span) / span)
            hidden.append(np.maximum(pooled @ net.hidden + net.hidden_bias, 0))
        # The chunks cover the whole text.
        assert starts[-1] + span >= len(data)
        hidden = np.array(hidden)
        return float(np.concatenate([hidden.max(axis=0), hidden.mean(axis=0), [1]]) @ net.out)

    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 1, 7, 63, 64, 65, 128, 255, 256, 257, 600, 1000, 140_000)]
    got = quality.logits(net, texts)
    assert np.allclose(got, [plain(t) for t in texts], rtol=1e-3, atol=1e-3)
    alone = [quality.logits(net, [t])[0] for t in texts]
    assert np.allclose(got, alone, rtol=1e-4, atol=1e-4)


def test_gradients_equal_differences():
    rng = np.random.default_rng(4)
    net = quality.Network.new(rng)
    net.out = (0.3 * rng.standard_normal(net.out.shape)).astype(np.float32)
    texts, y = [rng.integers(97, 110, n).astype(np.uint8) for n in (30, 300, 900)], np.array([0, 1, 0])

    def loss():
        p = quality.probability(quality.logits(net, texts))
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    found = quality.gradients(net, texts, y)
    for w, g in zip(net.weights(), found, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept, h = w[at], np.float32(2e-3)
        w[at] = kept + h
        up = loss()
        w[at] = kept - h
        down = loss()
        w[at] = kept
        assert abs((up - down) / (2 * h) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_quality_of_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op11_quality_convolution(spark, d).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i].held_out for i in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    right = [rows[i].predicted == labels[i] for i in held]
    low = [rows[i].predicted == 0 for i in held if labels[i] == 0]
    assert len(held) > 80 and np.mean(right) >= 0.95 and np.mean(low) >= 0.9


def test_quality_of_odd_tables(spark):
    schema = "doc_id long, text string, score double, quality string, held_out string"
    good, bad = "the cat sat on the mat. ", "###$$$ "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 30), 0.1, "x", "y") for i in range(60)] + [(None, None, 0.1, "x", "y"), (3, "", 0.1, "x", "y"), (3, good * 20_000, 0.1, "x", "y"), (3, good, 0.1, "x", "y"), (3, good, 0.1, "x", "y")]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (4, None), (7, 0)], "doc_id long, quality int")
    found = quality.scores(docs, labels, steps=60)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert Counter(r.doc_id for r in found.collect()) == Counter(r[0] for r in rows)
    kept = quality.keep_good(docs, labels, steps=60)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.filter("doc_id < 60 AND length(text) > 200").collect()} == {1}
    assert quality.scores(docs.limit(0), labels, steps=60).count() == 0
    # Without both classes every score is the share; without labels it is one half.
    assert {r.score for r in quality.scores(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_are_never_read(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda own: sorted((r.doc_id, r.score) for r in quality.scores(docs, own, steps=40).collect())
    assert np.allclose([s for _, s in scores(labels)], [s for _, s in scores(turned)])


# Fill in the middle ----------------------------------------------------------------------------------------------------


def plain_infill(i, text, plain_percent=10, spm_percent=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 100 - plain_percent:
        return i, n, "plain", None, None, text
    if h4 % 100 < spm_percent:
        return i, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_functions_compose_to_the_whole_scan():
    for _ in range(400):
        data = np.frombuffer(odd_text(RND.randint(0, 60)).encode(), np.uint8)
        size = RND.randint(1, 7)
        parts = [data[i : i + size] for i in range(0, len(data), size)]
        own = [infill.summary(p) for p in parts]
        whole = infill.summary(data)
        before = infill.entries(own)
        assert before[-1] == (whole[0], whole[infill.STATES], len(data), whole[-1])
        text = data.tobytes().decode()
        assert whole[infill.STATES] == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text)) and whole[2 * infill.STATES] == len(re.findall("<[PSM]>", text))
        starts = [b[2] + s for p, b in zip(parts, before, strict=False) for s in infill.token_starts(p, b[0]).tolist()]
        assert starts == infill.token_starts(data, infill.OUTSIDE).tolist()
        if len(own) > 2:
            a, b, c = own[:3]
            assert infill.compose(infill.compose(a, b), c) == infill.compose(a, infill.compose(b, c))


@pytest.mark.parametrize(("chunk", "giant"), [(5, 8), (64, 100), (infill.CHUNK_BYTES, infill.GIANT_BYTES)])
def test_infill_equals_brute_force(spark, chunk, giant):
    rows = [(i, odd_text(RND.randint(0, 400)) if i % 3 else " ".join(RND.choice(["one", "two<", "P>", "drei", "é"]) for _ in range(RND.randint(0, 90)))) for i in range(150)]
    rows += [(None, "a null id with text"), (None, None), (7, None), (8, ""), (9, "same"), (9, "same"), (10, "x" * 70_000), (11, "long text, é " * 9_000), (11, "long text, é " * 9_000), (12, "<" * 300 + "P>")]
    docs = spark.createDataFrame([(i, t, 1, "k", "f", b"d") for i, t in rows], "doc_id long, text string, n int, key string, form string, data binary").repartition(3)
    found = infill.fill_in_middle(docs, chunk_bytes=chunk, giant_bytes=giant)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert Counter(map(tuple, found.collect())) == Counter(plain_infill(i, t) for i, t in rows)
    # The text comes back from output and form.
    back = infill.digests(docs, chunk_bytes=chunk, giant_bytes=giant)
    assert Counter(r.restored_sha256 for r in back.collect()) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert infill.fill_in_middle(docs.limit(0), chunk_bytes=chunk, giant_bytes=giant).count() == 0


def test_infill_has_the_shares_that_were_asked_for(spark):
    rows = [(i, "some words to cut") for i in range(3000)]
    found = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), plain_percent=0, spm_percent=50)
    forms = Counter(r.form for r in found.collect())
    assert forms["plain"] == 0 and abs(forms["spm"] - 1500) < 150


def test_infill_sql(spark, same):
    same(spark, queries.op12_fill_in_middle, queries.ORACLE_SQL["op12_fill_in_middle"], "/root/testdata/sf0.001")


# Vector codes ----------------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    own = defaultdict(list)
    for i, label, v in rows:
        if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v):
            own[len(v)].append((i, label, [int(np.floor(scale * x)) for x in v]))
    out = []
    for dim, mine in own.items():
        d = dim // parts
        cut = lambda v: [tuple(v[p * d : (p + 1) * d]) for p in range(parts)]  # noqa: B023, E731
        mine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        books = [[cut(v)[p] for _, _, v in mine[:entries]] for p in range(parts)]
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        near = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))  # noqa: B023, E731
        for _ in range(rounds):
            members = defaultdict(list)
            for _, _, v in mine:
                for p, x in enumerate(cut(v)):
                    members[p, near(p, x)].append(x)
            for (p, e), xs in members.items():
                books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, label, v in mine:
            code = [near(p, x) for p, x in enumerate(cut(v))]
            out.append((i, label, "".join(f"{c:02x}" for c in code), sum(far(x, books[p][c]) for p, (x, c) in enumerate(zip(cut(v), code, strict=True))), sha))
    total = Counter()
    for _, label, _, e, _ in out:
        total[label] += e
    return Counter((i, c, e, total[label], sha) for i, label, c, e, sha in out)


def test_codes_equal_brute_force(spark):
    coarse = lambda n: [RND.choice([-0.5, 0.0, 0.25, 0.25001, 1.0]) for _ in range(n)]
    rows = [(i, RND.choice([1, 2, 3, None]), coarse(16)) for i in range(120)] + [(200 + i, 9, [RND.gauss(0, 1) for _ in range(24)]) for i in range(40)]
    rows += [(5, 1, rows[5][2]), (5, 1, rows[5][2]), (5, 2, coarse(16)), (None, 2, coarse(16)), (None, None, coarse(16)), (300, 1, None), (301, 1, []), (302, 1, [0.5, None] * 8), (303, 1, [float("nan")] * 16), (304, 1, [float("inf")] * 16), (305, 1, coarse(15)), (306, 7, coarse(8)), (307, 7, [0.0] * 8)]
    table = spark.createDataFrame([(i, y, v, "c", 1) for i, y, v in rows], "vec_id long, label int, embedding array<double>, code string, error int").repartition(3)
    found = vector_codes.compress(table)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, found.collect())) == plain_codes(rows)
    assert vector_codes.compress(table.limit(0)).count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, 1, [1e30] * 8)], "vec_id long, label int, embedding array<double>")).collect()


def test_screening_is_rigorous():
    rng = np.random.default_rng(9)
    for size in (8, 1000, 1 << 14, 1 << 22, 1 << 28):
        x, book = rng.integers(-size, size, (3000, 8)), rng.integers(-size, size, (16, 8))
        book[5:9] = book[4] + rng.integers(-1, 2, (4, 8))  # entries that float32 cannot tell apart
        book[9] = book[4]
        x[:500] = book[4] + rng.integers(-2, 3, (500, 8))
        exact = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
        middle, radius = vector_codes.intervals(x, book)
        rest = (x.astype(object) ** 2).sum(axis=1)
        for i in range(0, 3000, 7):
            for j in range(16):
                assert abs(int(exact[i, j] - rest[i]) - int(middle[i, j])) <= radius[i, j] + 1
        checked = []
        index, error = vector_codes.assign(x, book, checked)
        assert index.tolist() == [min(range(16), key=lambda j: (e[j], j)) for e in exact] and error.tolist() == exact.min(axis=1).tolist()
        assert sum(checked) < len(x) * 16  # the product decides most entries


def test_hot_and_rare_labels(spark):
    rows = spark.range(5000).selectExpr("id AS vec_id", "CASE WHEN id < 2500 THEN NULL WHEN id < 3000 THEN -1 ELSE id END AS label", "id % 7 AS error")
    got = {(r.vec_id, r.label, r.label_error) for r in vector_codes.with_label_error(rows).collect()}
    total = Counter()
    for i in range(5000):
        total[None if i < 2500 else -1 if i < 3000 else i] += i % 7
    assert got == {(i, y, total[y]) for i in range(5000) for y in [None if i < 2500 else -1 if i < 3000 else i]}


def test_codes_sql(spark, same):
    same(spark, queries.op13_vector_codes, queries.ORACLE_SQL["op13_vector_codes"], "/root/testdata/sf0.001")


# Inverted multi-index --------------------------------------------------------------------------------------------------


def test_only_walked_cells_are_touched():
    from tessera.llm import multi_index

    rng = np.random.default_rng(6)
    for scale in (1.0, 1e6):
        v = scale * rng.standard_normal((3000, 8))
        v[:900] = v[0] + 1e-3 * scale * rng.standard_normal((900, 8))  # a cell with a third of all rows
        books = {8: (multi_index.fit_codebook(v[:, :4], 12), multi_index.fit_codebook(v[:, 4:], 12))}
        cell = multi_index.quantise(v[:, :4], books[8][0]) * 12 + multi_index.quantise(v[:, 4:], books[8][1])
        sizes = np.bincount(cell, minlength=144)
        layout = multi_index.lay_out(sizes, 200)
        block = layout.of_rows(cell, rng.integers(0, 1 << 40, 3000))
        assert np.bincount(block).max() <= 320 and set(block) <= set(range(layout.blocks))
        ids, queries = np.arange(3000), v[:40]
        near = [-queries[:, :4] @ books[8][0].T, -queries[:, 4:] @ books[8][1].T]
        limits = np.array([multi_index.cutoff(a, b, dict(enumerate(sizes.tolist())), 500) for a, b in zip(*near, strict=True)])
        met = np.zeros(40, np.int64)
        best = {}
        for b in range(layout.blocks):
            own = block == b
            for i in range(40):
                summed = near[0][i][:, None] + near[1][i][None]
                walked = np.flatnonzero(summed.ravel() <= limits[i] * (1 - np.sign(limits[i]) * 1e-13))
                walked = walked[sizes[walked] > 0]
                blocks = set(layout.of_cells(walked).tolist())
                assert (b in blocks) == bool(np.isin(cell[own], walked).any()) or layout.parts[walked].max() > 1
            touched = []
            q, r, s = multi_index.block_top(5, books, touched)(ids[own], v[own], cell[own], ids[:40], queries, limits)
            for x, y, z in zip(q, r, s, strict=True):
                best.setdefault(int(x), []).append((-z, int(y)))
            met += np.array([np.isin(cell[own], np.flatnonzero((near[0][i][:, None] + near[1][i][None]).ravel() <= limits[i] + 1e-9 * scale)).sum() for i in range(40)])
            assert sum(touched) == sum(np.isin(cell[own], np.flatnonzero((near[0][i][:, None] + near[1][i][None]).ravel() <= limits[i] + 1e-9 * scale)).sum() for i in range(40))
        assert (met >= 500).all() and (met < 500 + sizes.max()).all()
        for i in range(40):
            mine = np.flatnonzero(np.isin(cell, np.flatnonzero((near[0][i][:, None] + near[1][i][None]).ravel() <= limits[i] + 1e-9 * scale)) & (ids != i))
            want = sorted((-float(np.einsum("d,d->", v[r], queries[i])), int(r)) for r in mine)[:5]
            got = sorted(best[i])[:5]
            assert [r for _, r in got] == [r for _, r in want] and np.allclose([s for s, _ in got], [s for s, _ in want])


# Line templates at the registered settings ------------------------------------------------------------------------------


def plain_template_lines(rows, depth=3, least=5, constant=0.5, share=0.2):
    """Texts without recurring lines, by definition: shares decide first, then counts, for lines whose template did not recur."""
    mask = lambda line: tuple("<*>" if re.search(r"\d", w) else w for w in line.split())
    leaf = defaultdict(lambda: defaultdict(set))
    for i, t in rows:
        for w in {mask(line) for line in (t or "").split("\n")} - {()}:
            leaf[len(w), w[:depth]][w].add(i)
    lost = {}
    for lines in leaf.values():
        holders = defaultdict(set)
        for w, ids in lines.items():
            for p, x in enumerate(w):
                holders[p, x] |= ids
        docs = len(set().union(*lines.values()))
        for needed in [share * docs, least] if share * docs > least else [least]:
            by = defaultdict(list)
            for w in lines:
                by[tuple(x if x != "<*>" and (p < depth or len(holders[p, x]) >= needed) else None for p, x in enumerate(w))].append(w)
            for t, ws in by.items():
                own = t[depth:] or t
                ids = set().union(*(lines[w] for w in ws))
                if len(ids) >= least and sum(x is not None for x in own) / len(own) >= constant:
                    for w in ws:
                        lost.setdefault(w, min(ids))
    return {i: "\n".join(line for line in t.split("\n") if lost.get(mask(line), i) == i) if t is not None else None for i, t in rows}


@pytest.mark.parametrize("leaf_rows", [50_000, 0])
def test_line_templates_with_shares_equal_brute_force(spark, leaf_rows):
    from tessera.llm import line_dedup

    words = [f"{a}{b}" for a in ("ka", "lo", "mi") for b in ("na", "ri", "po")]
    rows = []
    for i in range(140):
        lines = [
            f"posted by the user {words[i % 9]} in {words[i // 9 % 9]} city today",  # fields whose values recur
            f"we all like {words[i % 9]}{i % 31} {words[i % 7]}x",  # only the leading tokens are constant: stays
            f"see also the {'rare' if i % 28 == 0 else words[i % 9]} page of this site",
            f"page {i} of many pages here",
            "short line" if i % 3 else "other words of the day",
        ]
        if i % 10 == 0:
            lines.append(f"posted by the user {words[i % 5]} in {words[0]} city today")  # two lines of one leaf
        RND.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, "")]
    want = plain_template_lines(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring(docs, leaf_rows=leaf_rows, min_share=line_dedup.SHARE).collect()}
    assert got == want
    # The case tells the rule: lines with nothing but their leading tokens constant stay everywhere.
    assert all("we all like" in want[i] for i in range(140)) and sum("posted by the user" in want[i] for i in range(140)) < 20


# Near duplicates at similarity 0.8 --------------------------------------------------------------------------------------


def _similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def _edited(text, k, words):
    w = text.split()
    for i in RND.sample(range(len(w)), k):
        w[i] = RND.choice(words)
    return " ".join(w)


def _pairs_of(bases, low, high, words):
    out = []
    for t in bases:
        other = ""
        while not low <= _similarity(t, other) < high:
            other = _edited(t, RND.randint(3, 9), words)
        out += [t, other]
    return out


@pytest.mark.parametrize(("kind", "n", "limit"), [("unrelated", 250, 64), ("family", 300, 64), ("family", 120, 8)])
def test_near_duplicates_reach_the_recall(spark, kind, n, limit):
    """Pairs at 0.80 to 0.84: of texts that share nothing else, and of texts that all derive from one (the others at about 0.65)."""
    from tessera.llm import simhash_golay

    words = [f"w{i}" for i in range(5000)]
    fresh = lambda: " ".join(RND.choice(words) for _ in range(300))
    base = fresh()
    texts = _pairs_of([fresh() if kind == "unrelated" else _edited(base, 6, words) for _ in range(n)], 0.80, 0.84, words)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash_golay.similar_documents(df, group_limit=limit, partners=(1, 4)).collect()}
    assert np.mean([got[2 * i] == got[2 * i + 1] for i in range(n)]) >= 0.95
    for i in range(0, 2 * n, 2):  # no false links: a group is connected by pairs at 0.8
        group = [j for j in got if got[j] == got[i]]
        assert len(group) == 1 or all(any(_similarity(texts[j], texts[k]) >= 0.8 for k in group if k != j) for j in group[:5])


def test_crowded_keys_are_compared_to_the_end(spark):
    """Whatever the limits, the groups are the same: rounds go on until nothing is left to try."""
    from tessera.llm import simhash_golay

    words = [f"v{i}" for i in range(300)]
    base = " ".join(RND.choice(words) for _ in range(120))
    texts = [_edited(base, RND.randint(1, 9), words) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(500, None), (501, ""), (None, texts[0])], "doc_id long, text string").repartition(4)
    rows = lambda **o: sorted((str(r.doc_id), r.component_id) for r in simhash_golay.similar_documents(df, **o).collect())
    all_pairs = rows(group_limit=1000)
    assert rows(group_limit=4, partners=(1,)) == all_pairs and rows(group_limit=16, partners=(2, 8)) == all_pairs
    assert simhash_golay.similar_documents(df.limit(0)).count() == 0
