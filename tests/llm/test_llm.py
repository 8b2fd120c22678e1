"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and odd columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bitslice, licenses, line_dedup, multi_index, packing, pii, sentencepiece_viterbi, simhash_golay, suffix_dedup, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
RND = random.Random(11)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "ser") for b in ("na", "ri", "po", "x", "dem")]
SCHEMA = "doc_id long, text string, fingerprint string, spans string, score double, keys string, pii string"


def sentence(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [sentence(RND.randint(1, 60)) for _ in range(25)]
    out = [*base, base[0], base[0], base[1] + " tail", None, "", "   ", "a", "x" * 5000, "ä" * 300, base[2] + "\n" + base[3], base[4][:20] + "!" + base[5]]
    return list(enumerate(out)) + [(3, base[3]), (None, base[6]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Ids with repeats and nulls, and columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "f", "s", 0.5, "k", "p") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoding_equals_the_library(spark, docs, texts, empty):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentencepiece_viterbi.round_trip(docs, path).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((i, tuple(library.encode(t or ""))) for i, t in texts)
    assert Counter((r.doc_id, r.decoded_sha256) for r in rows) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    assert sentencepiece_viterbi.round_trip(empty, path).count() == 0


def test_window_is_bounded_and_exact():
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_viterbi.Model.load(path)
    for _ in range(30):
        text = "".join(RND.choice("abetno_.-/=\n  012é漢▁") for _ in range(400))
        assert model.ids_of(model.normalise(text)) == library.encode(text)
    # A long text without a word border: few positions are held, and ids leave while most of the text is unread.
    long = "".join(RND.choice("abetnos") for _ in range(20_000))

    class Tape(str):
        read = 0

        def __getitem__(self, at):
            Tape.read = max(Tape.read, at.stop if isinstance(at, slice) else at)
            return str.__getitem__(self, at)

    widths = []
    ids = model.viterbi(Tape(model.normalise(long)), widths)
    first = [next(ids) for _ in range(20)]
    assert Tape.read < 1_000
    assert first + list(ids) == library.encode(long)
    assert max(widths) <= 12 * model.longest


def test_unigram_viterbi_equals_brute_force():
    kinds = [("<unk>", 0.0, sentencepiece_viterbi.UNKNOWN)] + [(p, s, sentencepiece_viterbi.NORMAL) for p, s in (("a", -2.0), ("b", -2.5), ("ab", -3.0), ("ba", -2.2), ("aba", -5.5), ("bb", -4.4))]
    model = sentencepiece_viterbi.Model(kinds, sentencepiece_viterbi.UNIGRAM, dummy_prefix=False)

    def best(text):
        score = {0: 0.0}
        for e in range(1, len(text) + 1):
            score[e] = max(score[s] + model.scores[model.ids[text[s:e]]] for s in range(e) if text[s:e] in model.ids)
        return score[len(text)]

    for _ in range(40):
        text = "".join(RND.choice("ab") for _ in range(RND.randint(1, 90)))
        ids = model.ids_of(text)
        assert "".join(model.pieces[i][0] for i in ids) == text and abs(sum(model.scores[i] for i in ids) - best(text)) < 1e-9


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_pattern_spans_equal_the_plain_patterns():
    for _ in range(4000):
        t = "".join(RND.choice("aB.@ 0123-+()%_é") for _ in range(RND.randint(1, 40)))
        assert pii.base_spans(t) == plain_spans(t)
    assert [k for k, _, _ in pii.base_spans("x 4111 1111 1111 1111 a@b.co +49 (30) 123456 10.0.0.1")] == ["email", "ip", "card", "phone"]


def plain_disclosures(rows, alpha=1.1, least=3):
    """All spans and replacements by definition: counts over documents, evidence by different texts."""
    docs = [(i, t or "") for i, t in rows]
    outside = {t: {w for w, _, _ in pii.terms(t, plain_spans(t))} for _, t in docs}
    classes = lambda ws: ws | {w[:3] + "*" for w in ws}
    own = {t: {e for k, a, b in plain_spans(t) for e in pii.levels(k, t[a:b])} for _, t in docs}
    n = Counter(w for _, t in docs for w in classes(outside[t]))
    n_e, n_et, s_e, s_et = Counter(), Counter(), defaultdict(set), defaultdict(set)
    for _, t in docs:
        for e in own[t]:
            n_e[e] += 1
            s_e[e].add(t)
            for w in classes(outside[t]):
                n_et[e, w] += 1
                s_et[e, w].add(t)
    tells = {(e, w) for (e, w), ts in s_et.items() if len(ts) >= least and len(s_e[e]) >= least and n_et[e, w] / n[w] >= 2 ** (-math.log2(len(docs) / n_e[e]) * (1 - 1 / alpha)) - 1e-12}
    return [(i, ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t) + [("term", a, b) for w, a, b in pii.terms(t, plain_spans(t)) if any((e, w) in tells for e in own[t])])) for i, t in docs]


def test_disclosures_equal_brute_force(spark):
    rows = []
    for i in range(240):
        host, name = RND.choice(["corp.example", "lab.example", "x.org"]), RND.choice(["zorblax", "Quibble", "İzmir", "zorbling"])
        text = f"{sentence(6)} {name if i % 3 else ''} "
        if i % 4 == 0:
            text += f"write to {RND.choice(['ann', 'bob'])}{i % 12}@{host} {'orbital' if host[0] == 'l' else 'corp'}"
        if i % 7 == 0:
            text += f" from 10.{i % 2}.0.{i} gateway"
        rows.append((i, text))
    rows += rows[:20] + [(900, None), (901, "")]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = plain_disclosures(rows)
    assert sum("term" in s for _, s in want) > 10
    assert Counter((r.doc_id, r.spans) for r in got) == Counter(want)


def test_disclosing_terms(spark):
    rows = [(i, f"{sentence(5)} zorblax says {RND.choice(WORDS)} mail boss@corp.example now {i}") for i in range(6)]
    rows += [(100 + i, sentence(12)) for i in range(60)] + [(500, None), (501, ""), (None, "a@b.cd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(found) == len(rows) and found[100].spans == "" and found[500].n_email == 0 and found[None].n_email == 1
    for i in range(6):
        text = rows[i][1]
        spans = [s.split(":") for s in found[i].spans.split(",")]
        assert ["zorblax"] == [text[int(a) : int(b)] for k, a, b in spans if k == "term" and text[int(a) : int(b)] == "zorblax"]
        assert found[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text)).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("boss@" not in (t or "") and "zorblax" not in (t or "") for t in clean.values()) and clean[100] == rows[6][1] and clean[500] is None


def test_terms_beside_values_that_never_recur(spark):
    rows = [(i, f"{sentence(5)} zorblax says {RND.choice(WORDS)} mail me{i}@corp{i}.example now") for i in range(8)]
    rows += [(100 + i, sentence(12)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.find(docs).filter("doc_id < 100").collect():
        spans = [s.split(":") for s in r.spans.split(",")]
        assert "zorblax" in [rows[r.doc_id][1][int(a) : int(b)] for k, a, b in spans if k == "term"]
    assert all("zorblax" not in r.text for r in pii.sanitise(docs).collect())
    assert pii.levels("phone", "+49 (30) 123456") == ["phone:4930123456", "phone-prefix:4930", "kind:phone"]
    assert pii.levels("ip", "010.0.0.1")[1] == "network:10.0" and pii.levels("email", "A@B.co")[1] == "domain:b.co"


def test_pii_of_odd_tables(docs, texts, empty):
    assert Counter(r.doc_id for r in pii.find(docs).collect()) == Counter(i for i, _ in texts)
    kept = pii.sanitise(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    assert pii.find(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_licences(spark, docs, empty):
    rows = [(1, "foo\nReleased under the  MIT licence-free License.\nbar"), (2, "Released under the MIT License!"), (3, None), (4, ""), (5, licenses.TEMPLATES[16][1].replace(". ", ".\n").replace(", to", ",\nto")), (6, "\n\nAll rights reserved.\n\n all  rights ")]
    got = {(r.doc_id, r.unit, r.unit_no, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (2, "line", 0, "mit") in got and (5, "text", 0, "mit") in got and (6, "line", 2, "all-rights-reserved") in got
    assert not {g for g in got if g[0] in (3, 4)}
    assert licenses.scan(docs).count() == 0 and licenses.scan(empty).count() == 0


def test_toxicity_learns_and_ignores_held_out_labels(spark, empty):
    bad = ["grunfel", "snorvak", "blimph"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = sentence(30).split()
        if toxic:
            words[RND.randrange(30)] = RND.choice(bad)
        rows.append((i, " ".join(words)))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        labels.append((i, int(toxic) if not held else 1 - int(toxic)))  # wrong where they must not be read
    rows += [(1000, None), (1001, ""), (None, "grunfel")]
    labels += [(None, 1), (5, None)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs, known).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [i for i in range(400) if got[i].held_out]
    assert {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0} == set(held)
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) / len(held) > 0.95
    assert {r.doc_id for r in toxicity.keep_clean(docs, known).collect()} == {i for i, r in got.items() if r.score < 0.5}
    none = toxicity.scores(docs, known.filter("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0} and toxicity.scores(empty, known).count() == 0


def test_toxicity_settles_repeats_and_contradictions(spark):
    rows = [(i, f"{sentence(12)} {'grunfel' if i % 3 == 0 else 'tea'}") for i in range(90)]
    docs = spark.createDataFrame([(*r, "x") for r in rows + rows[:10] + [(3, "another text")]], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] * 2 + [(6, 0), (7, 1)], "doc_id long, toxic int")
    models = [toxicity.fit(part, labels.repartition(n))[0] for part, n in ((docs.repartition(1), 1), (docs.repartition(5), 4))]
    assert models[0] == models[1]
    out = toxicity.keep_clean(docs, labels)
    assert out.columns == docs.columns and set(r.score for r in out.collect()) == {"x"}


def plain_lines(rows, depth, least, constant):
    mask = lambda line: tuple("<*>" if re.search(r"\d", w) else w for w in line.split())
    leaf = defaultdict(lambda: defaultdict(list))
    for i, t in rows:
        for w in {mask(line) for line in (t or "").split("\n")} - {()}:
            leaf[len(w), w[:depth]][w].append(i)
    lost = {}
    for lines in leaf.values():
        count = Counter()
        for w, ids in lines.items():
            for p, x in enumerate(w):
                count[p, x] += len(ids)
        by = defaultdict(list)
        for w in lines:
            by[tuple(x if x != "<*>" and (p < depth or count[p, x] >= least) else None for p, x in enumerate(w))].append(w)
        for t, ws in by.items():
            if sum(len(lines[w]) for w in ws) >= least and sum(x is not None for x in t) / len(t) >= constant:
                lost |= {w: min(min(lines[w]) for w in ws) for w in ws}
    return {i: "\n".join(line for line in t.split("\n") if lost.get(mask(line), i) == i) if t is not None else None for i, t in rows}


@pytest.mark.parametrize("leaf_rows", [50_000, 0])
def test_line_templates_equal_brute_force(spark, leaf_rows):
    rows = []
    for i in range(80):
        lines = [sentence(RND.randint(1, 6)), f"page {i} of {RND.choice(WORDS)} this is the footer", "static line of the site here", ""]
        rows.append((i, "\n".join(RND.sample(lines, len(lines)))))
    rows += [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring(docs, leaf_rows=leaf_rows).collect()}
    assert got == plain_lines(rows, 3, 5, 0.5)


@pytest.mark.parametrize("leaf_rows", [50_000, 0])
def test_lines_of_few_documents_stay(spark, leaf_rows):
    rows = [(1, "\n".join(f"the price of {x} is high" for x in ("tea", "salt", "rice", "corn"))), (2, "the price of oil is high")]
    rows += [(10 + i, f"we all like {a} {b}" if i else "we all like x y") for i, (a, b) in enumerate(zip("abcdefgh", "klmnopqr", strict=True))]
    rows += [(30 + i, f"out of {x} for today") for i, x in enumerate(("tea", "salt", "rice", "corn"))] * 2  # repeated rows are one document
    rows += [(50 + i, f"sign up for {x} right now") for i, x in enumerate(("tea", "salt", "rice", "corn", "oil"))] + [(56, "sign up for ham right now\nsign up for jam right now")]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), leaf_rows=leaf_rows).collect()}
    assert got == {i: "" if 50 < i else t for i, t in rows}


@pytest.mark.parametrize("leaf_rows", [50_000, 0])
def test_fields_whose_values_recur_at_two_sizes(spark, leaf_rows):
    import corpus_pipeline

    stage = lambda df: corpus_pipeline.line_dedup_stage(spark, df, "") if leaf_rows else line_dedup.drop_recurring(df, leaf_rows=0, min_share=line_dedup.SHARE)
    for n in (60, 300, 900):
        rows = [(i, f"This item was posted by name{'abcdefghij'[i % 10]} from the city of town{'klmnopqrst'[i // 10 % 10]} in our archive\nText {i}") for i in range(n)]
        got = stage(spark.createDataFrame(rows, "doc_id long, text string"))
        assert [r.doc_id for r in got.collect() if "This item" in r.text] == [0], n


def test_one_leaf_with_very_many_tokens(spark):
    """Tokens are not mixed up however many a position has: the template does not split."""
    n = 40_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('our offer of ', translate(hex(id * 7919), '0123456789', 'ghijklmnop'), ' is still open today') AS text")
    out = line_dedup.drop_recurring(docs, min_share=line_dedup.SHARE).filter("text <> ''").collect()
    assert [r.doc_id for r in out] == [0]


def test_line_templates_of_odd_tables(docs, texts, empty):
    out = line_dedup.drop_recurring(docs)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in texts)
    assert line_dedup.line_report(empty).count() == 0


def _vectors(spark, n=300, dim=12):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=dim)]) for i in range(n)]
    rows[7] = (7, rows[8][1])
    rows += [(n, None), (n + 1, [None] * dim), (n + 2, [float("nan")] * dim), (n + 3, [float("inf")] + [0.0] * (dim - 1)), (n + 4, []), (n + 5, [0.0] * dim), (None, rows[1][1]), (n + 6, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_bit_sliced_top_k_equals_brute_force(spark):
    rows, df = _vectors(spark)
    ok = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = {(q, rank + 1, i, s) for q, x in ok if q % 50 == 0 for rank, (s, i) in enumerate(sorted(((int(x @ y), i) for i, y in ok if i != q and len(y) == len(x)), key=lambda t: (-t[0], t[1]))[:5])}
    got = {tuple(r) for r in bitslice.exact_top_k(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == want
    assert bitslice.exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_neighbours_reach_the_recall(spark):
    rows, df = _vectors(spark, 1500, 24)
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    got = defaultdict(list)
    for r in multi_index.nearest(df, F.col("vec_id") % 20 == 0, least=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = []
    for q, x in ok:
        if q % 20 == 0 and len(x) == 24:
            best = [i for _, i in sorted(((-float(x @ y), i) for i, y in ok if i != q and len(y) == 24))[:20]]
            hits.append(len(set(best) & {i for i, _ in got[q]}) / 20)
            assert len(got[q]) == 20 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert np.mean(hits) >= 0.9
    assert multi_index.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_recall_on_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in table.collect() if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = defaultdict(set)
    for r in multi_index.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for q, v in rows:
        if q % 20 == 0:
            score = np.where(ids == q, -np.inf, x @ v)
            hits.append(len(got[q] & set(ids[np.lexsort((ids, -score))[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_cutoff_meets_enough_rows():
    r = np.random.default_rng(3)
    a, b, cells = r.normal(size=6), r.normal(size=5), r.integers(0, 30, 200)
    size = dict(Counter(cells.tolist()))
    limit = multi_index.cutoff(a, b, size, 70)
    inside = (a[cells // 5] + b[cells % 5] <= limit).sum()
    assert inside >= 70 and inside - max(size.values()) < 70 and multi_index.cutoff(a, b, size, 500) == np.inf


def test_cells_come_by_summed_distance():
    r = np.random.default_rng(1)
    a, b = r.normal(size=7), r.normal(size=5)
    walked = list(multi_index.walk_cells(a, b))
    assert len(set(walked)) == 35 and [a[i] + b[j] for i, j in walked] == sorted(a[i] + b[j] for i, j in walked)


def test_suffix_array():
    for _ in range(300):
        s = bytes(RND.choice(b"ab\0c") for _ in range(RND.randint(0, 60)))
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_is_linear_on_one_letter():
    import tracemalloc

    peaks = []
    for n in (50_000, 200_000):
        tracemalloc.start()
        order = suffix_dedup.suffix_array(b"a" * n + b"b")
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert order == list(range(n + 1))
    assert peaks[1] < 5 * peaks[0] and peaks[1] < 400 * 200_000


@pytest.mark.parametrize(("group_limit", "batch_limit"), [(20_000, 256), (1, 256), (20_000, 1)])
def test_repeats_equal_brute_force(spark, docs, texts, group_limit, batch_limit, empty):
    passage, extra = sentence(30), []
    for i in range(100, 130):
        extra.append((i, sentence(RND.randint(0, 12)) + " " + passage[RND.randint(0, 60) :] + sentence(RND.randint(0, 12))))
    rows = texts + extra + [(140, "z" * 400), (141, "z" * 120 + "y"), (142, "ab " * 4000 + passage), (143, "x" + "ab " * 5000)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows[len(texts) :], "doc_id long, text string"))
    seen = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - 49):
                seen[b[k : k + 50]] = min(i, seen.get(b[k : k + 50], i))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49 if i is not None else 0):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        want[i, len(b), sum(gone), sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone)), bytes(x for x, g in zip(b, gone) if not g)] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, group_limit=group_limit, batch_limit=batch_limit).collect())
    assert got == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [(i, plain_fingerprint(t or "")) for i, t in rows]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(prints):
        low[find(a)] = min((x for x in (low.get(find(a)), i) if x is not None), default=None)
    return Counter((i, f"{p:016x}", low[find(a)]) for a, (i, p) in enumerate(prints))


@pytest.mark.parametrize("group_limit", [512, 1])
def test_near_duplicates_equal_brute_force(spark, docs, texts, group_limit, empty):
    more = [(200 + i, sentence(3)) for i in range(30)] + [(300 + i, "one two three four " + "pad " * i) for i in range(10)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = Counter(tuple(r) for r in simhash_golay.near_duplicates(df, group_limit=group_limit).collect())
    assert got == plain_components(texts + more)
    assert simhash_golay.near_duplicates(empty).count() == 0


def test_golay_keys_are_shared_within_two_bits():
    r = np.random.default_rng(4)
    prints = r.integers(0, 2**64, 300, dtype=np.uint64)
    keys = lambda p: set(simhash_golay.fuzzy_keys(np.array([p], np.uint64))[1].tolist())
    for p in prints:
        i, j = r.integers(0, 64, 2)
        assert keys(p) & keys(p ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)))
    assert (simhash_golay.codeword_indices(np.arange(64)) >= 0).sum(axis=1).max() == 6


def test_keep_first(docs, texts):
    kept = simhash_golay.keep_first(docs)
    assert kept.columns == docs.columns
    want = Counter(i for (i, _, c), n in plain_components(texts).items() for _ in range(n) if i is None or i == c)
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_near_dedup_stage_reaches_similarity(spark, docs, texts):
    import corpus_pipeline

    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [[rnd.choice(words) for _ in range(300)] for _ in range(20)]
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, want = [], set()
    for i, own in enumerate(base):
        near, far = own[:], own[:]
        for at in (20, 120, 220, 280):
            near[at] = "edited"
        for at in range(0, 300, 15):
            far[at] = "other"
        alike = lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b))
        assert alike(own, near) >= 0.8 and alike(own, far) < 0.6 and alike(near, far) < 0.6
        rows += [(1000 + i, " ".join(own)), (2000 + i, " ".join(near)), (3000 + i, " ".join(far))]
        want |= {1000 + i, 3000 + i}
    group = base[0] + base[1]
    rows += [(5000 + i, " ".join([*group[:i], "x", *group[i:]])) for i in range(400)]  # more than a window and its partners hold
    kept = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert {r.doc_id for r in kept.collect()} == want | {5000}
    kept = simhash_golay.keep_dissimilar(docs)
    assert kept.columns == docs.columns and None in {r.doc_id for r in kept.select("doc_id").collect()}
    assert simhash_golay.keep_dissimilar(docs.limit(0)).count() == 0


def test_packing(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, capacity=64).collect()
    want = Counter()
    for i, t in texts:
        ids = tool.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4").tobytes()
            want[i, k // 64, k, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 64
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // 64) + 2
    assert packing.pack_documents(empty, path).count() == 0


def test_separators_that_are_no_white_space():
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    tool, cache = Tokenizer.from_file(path), packing.TokenCache(path)
    for text in ("a\x1cb c", "\x1c", "a \x1d b", "\x1e\x1fa.\x1c", "\x85a\x1f\xa0b", "one, two"):
        assert cache.encode(text) == np.array(tool.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_odd_texts_have_the_ids_of_the_tokenizer():
    """Texts of one batch together: other white space, marks that join letters, tokens found as they are written, any case."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path, rnd = tokenizers.path("word_bpe_49k.json"), random.Random(10)
    tool = Tokenizer.from_file(path)
    parts = ["a", "The", "don't", "'S", "'", "''ll", ".", "...", ",", "42", "\u00b2", "\xaa", "\xb5", "\xdf", "\u1e9e", "\xc5", "\u212b", "\u212a", "\u0130", "\xc9t\xe9", "e\u0301", "\u0301", "T\u0308", "W", "\u030a", "\u03a3", "\u6f22", "\U0001f600"]
    parts += ["<|endoftext|>", "<|ENDOFTEXT|>", "<|", " ", "  ", "\n", "\t", "\x0b", "\x00", "\x1c", "\x1f", "\x7f", "\x85", "\xa0", "\u2028", "\u3000", "\u200b", "x" * 70, "Upper", "word"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(3000)] + [None, ""]
    # A batch without such tokens, and without capitals before a mark, is lower-cased at once.
    plain = [t for t in texts if t is None or ("<|end" not in t.lower() and not re.search("[A-Z][\u0300-\u036f]", t))]
    for own in (texts, plain):
        cache = packing.TokenCache(path, limit=100)
        for at in range(0, len(own), 700):
            batch = own[at : at + 700]
            for text, ids in zip(batch, cache.encode_all(pa.array(batch, pa.string())), strict=True):
                assert ids.tolist() == tool.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_each_chunk_of_a_batch_is_cut_once(monkeypatch):
    import pyarrow as pa

    cut, own = [], packing.units
    monkeypatch.setattr(packing, "units", lambda text: cut.append(text) or own(text))
    cache = packing.TokenCache(tokenizers.path("word_bpe_49k.json"))
    first, *others = list(cache.encode_all(pa.array(["The cat, don't; a cat, the end."] * 200)))
    assert len(others) == 199 and all((x == first).all() for x in others)
    assert sorted(cut) == ["cat,", "don't;", "end."]


def test_groups_of_texts_are_whole():
    for sizes, want in (([], []), ([0], [1]), ([5, 5, 5, 5], [1, 2, 1]), ([50, 1, 1], [3]), ([1, 50, 1], [1, 2])):
        assert packing._groups(np.array(sizes, np.int64), 10) == want and sum(want) == len(sizes)


def test_plan_is_joined_beyond_the_limit(spark, monkeypatch):
    monkeypatch.setattr(packing, "PLAN_ROWS_SENT", 0)
    rows = spark.createDataFrame([(i, 1 + (i * 7) % 40) for i in range(300)], "doc_id long, length long")
    got = packing.pack(rows, 40).collect()
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert len(got) == 300 and max(fill.values()) <= 40 and len({(r.sequence_id, r.offset) for r in got}) == 300


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    first = spark.read.parquet(f"{d}/documents.parquet")
    docs = first
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == first.columns
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("name", ["op3_license_dice", "op6_bit_sliced_top_k"])
def test_registered_sql(spark, same, name):
    from tessera.llm import queries

    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001")


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, an empty table, columns with names that the stages use."""
    import corpus_pipeline

    long = " ".join(sentence(9) for _ in range(6000))
    rows = [(1, None, None, "a", None, 1, "x"), (2, "", "en", None, 0, 2, "x"), (3, long, "en", "a", len(long), 3, "y"), (None, "mail me a@b.cd", None, None, None, 4, None)]
    rows += [(10 + i, f"{sentence(30)}\nThis is the footer of page {i} here\nann@corp.example", "en", "b", None, 5, "z") for i in range(12)]
    rows += [(30, sentence(40), "en", "b", None, 6, "z")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, text_key string")
    labels = spark.createDataFrame([(10, 0), (11, 1), (12, 1), (12, 0), (None, 1), (13, None)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for frame, n in ((docs, len(rows)), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            found = out.collect()
            if name == "packing":
                assert set(out.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and len(found) >= n
                assert sum(r.length for r in found if r.doc_id == 3) > 40_000 or not n
                continue
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            kept = Counter(r.doc_id for r in found)
            if name in ("line_dedup", "pii"):
                assert kept == Counter(r[0] for r in rows[:n]), name
            if n and name == "line_dedup":
                assert [r.doc_id for r in found if r.text and "footer" in r.text] == [10]
                assert next(r.text for r in found if r.doc_id == 3) == long
            if n and name == "near_dedup":
                assert kept[30] == 3 and kept[3] == 1 and kept[None] == 1 and kept[1] == 1 and kept[2] == 0  # empty texts are one
            if n and name == "pii":
                assert not any("corp.example" in (r.text or "") or "a@b.cd" in (r.text or "") for r in found)
