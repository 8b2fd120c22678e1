"""Personal data: exact patterns first, then information-theoretic sanitisation of the terms that give them away.

Pattern matches (e-mail, IP, card and phone numbers) are always removed; their values are the protected entities, and so
are what values have in common (see :func:`levels`), as most values occur in one text only.  A
term ``t`` that stays in the text discloses an entity ``e`` when the corpus ties them together: with
``IC(e) = -log2 p(e)`` and ``PMI(t, e) = log2(p(t, e) / (p(t) p(e)))``, both from document counts over the whole
corpus, ``t`` discloses ``e`` if ``PMI(t, e) >= IC(e) / alpha``, that is ``p(e | t) >= 2 ** (-IC(e) (1 - 1 / alpha))``.
Evidence must come from ``min_support`` different texts, so copies of one text prove nothing.  In texts that hold the
entity, a disclosing term is generalised to its class (its first letters) where the class itself stays below the
threshold, and removed otherwise.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Workspace
from ..workers import lean

KINDS = ("email", "ip", "card", "phone")
#: Letters of a term that name its class.
CLASS_LETTERS = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats and look-behinds change no match of the plain patterns; they keep long runs linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{2,}")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the pattern matches, by kind as in ``KINDS``, then by start; code points, end exclusive."""
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


def entity(kind: str, value: str) -> str:
    """One name for all spellings of a value."""
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{re.sub('[^0-9]', '', value)}"


#: Leading digits that name the issuer of a card, or the country and network of a phone number.
PREFIX_DIGITS = {"card": 6, "phone": 4}


def levels(kind: str, value: str) -> list[str]:
    """The value, then the wider entities that it belongs to: its domain, network or number prefix, and its kind."""
    name = entity(kind, value)
    if kind == "email":
        wider = "domain:" + name.rpartition("@")[2]
    elif kind == "ip":
        wider = "network:" + ".".join(str(int(p)) for p in value.split(".")[:2])
    else:
        wider = f"{kind}-prefix:{name.partition(':')[2][: PREFIX_DIGITS[kind]]}"
    return [name, wider, f"kind:{kind}"]


def _hash(text: str) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))).view(np.int64))


def _text_key(text: str) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def terms(text: str, hidden: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(lower-cased term, start, end) of the terms outside the hidden spans."""
    covered = sorted((a, b) for _, a, b in hidden)
    found, i = [], 0
    for m in _TERM.finditer(text):
        while i < len(covered) and covered[i][1] <= m.start():
            i += 1
        if i == len(covered) or m.end() <= covered[i][0]:
            found.append((m[0].lower(), *m.span()))
    return found


SCAN = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,base:string,entities:array<bigint>,text_key:string>"
_SCAN_TYPE = pa.struct([(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("base", pa.string()), ("entities", pa.list_(pa.int64())), ("text_key", pa.string())])


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that no input column has."""
    lowered = {t.lower() for t in taken}
    while name in lowered:
        name += "_"
    return name


def scan(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """All columns of ``docs`` and a struct ``out`` with the pattern matches of each whole text."""
    names = docs.columns
    at = names.index(text_col)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(at):
                text = x.as_py() or ""
                spans = base_spans(text)
                base, count = _joined(spans), Counter(k for k, _, _ in spans)
                rows.append({f"n_{k}": count[k] for k in KINDS} | {"base_sha256": hashlib.sha256(base.encode()).hexdigest(), "base": base, "entities": sorted({_hash(e) for k, a, b in spans for e in levels(k, text[a:b])}), "text_key": _text_key(text)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _SCAN_TYPE)], names=[*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{out}` {SCAN}"
    return docs.mapInArrow(lean(scanned), schema)


def _with_classes(found: set[str]) -> set[str]:
    return found | {t[:CLASS_LETTERS] + "*" for t in found}


def term_counts(docs: DataFrame, parsed: DataFrame, text_col: str) -> DataFrame:
    """Rows ``(term, n)``: in how many documents each term and each term class occurs (hashes) outside of pattern matches, over
    all documents; ``parsed`` has the texts with entities, their ``copies`` and the terms that are ``hidden`` in them."""
    import xxhash  # noqa: F401

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([_hash(t) for t in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for x in batch.column(0):
                counts.update(_with_classes({t.lower() for t in set(_TERM.findall(x.as_py() or ""))}))
                if len(counts) > 300_000:
                    yield flush()
        yield flush()

    everywhere = docs.select(F.col(text_col).cast("string")).mapInArrow(lean(counted), "term long, n long")
    only_hidden = parsed.select(F.explode("hidden").alias("term"), (-F.col("copies")).alias("n"))
    return everywhere.union(only_hidden).groupBy("term").agg(F.sum("n").alias("n"))


PARSED = "text_key string, copies long, entities array<bigint>, text string, terms array<struct<term:bigint,class:bigint>>, hidden array<bigint>"


def parse(texts: DataFrame) -> DataFrame:
    """Rows ``(text_key, copies, entities, text)`` with the different terms of each text, each with its class, and the classes by
    themselves; and the terms and classes that only stand inside of pattern matches."""
    names = ["text_key", "copies", "entities", "text", "terms", "hidden"]
    pair = pa.struct([("term", pa.int64()), ("class", pa.int64())])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, hidden = [], []
            for text in batch.column(3).to_pylist():
                own = {t for t, _, _ in terms(text, base_spans(text))}
                classes = {t: _hash(t[:CLASS_LETTERS] + "*") for t in own}
                found.append([{"term": _hash(t), "class": c} for t, c in classes.items()] + [{"term": c, "class": None} for c in set(classes.values())])
                hidden.append([_hash(t) for t in _with_classes({m.lower() for m in set(_TERM.findall(text))}) - _with_classes(own)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pair)), pa.array(hidden, pa.list_(pa.int64()))], names=names)

    return texts.select(*names[:4]).mapInArrow(lean(parsed), PARSED)


def disclosures(docs: DataFrame, scanned: DataFrame, text_col: str, out: str, work: Workspace, alpha: float = 1.1, min_support: int = 3) -> DataFrame:
    """Rows ``(text_key, extra, actions)`` for the texts in which terms disclose the text's own entities.

    ``extra`` joins ``term:start:end`` by start; ``actions`` has for each such span its class, or '' if it is removed.
    """
    s = lambda name: F.col(f"{out}.{name}")
    texts = scanned.filter(F.size(s("entities")) > 0)
    one_text = texts.groupBy(s("text_key").alias("text_key")).agg(F.count("*").alias("copies"), F.first(s("entities")).alias("entities"), F.first(F.col(text_col)).alias("text"))
    parsed = work.save(parse(one_text), "parsed")
    pairs = parsed.select("text_key", "copies", F.explode("entities").alias("e"))
    frequent = work.save(pairs.groupBy("e").agg(F.count("*").alias("support"), F.sum("copies").alias("n_e")).filter(F.col("support") >= min_support).select("e", "n_e"), "frequent")
    held = pairs.join(frequent, "e").groupBy("text_key").agg(F.collect_list("e").alias("es"))
    recurrent = work.save(held.join(parsed.select("text_key", "copies", "text", "terms"), "text_key"), "recurrent")
    together = recurrent.select("text_key", "copies", "es", F.explode("terms").alias("t")).select("text_key", "copies", "t.term", "t.class", F.explode("es").alias("e"))
    joint = work.save(together.groupBy("e", "term", "class").agg(F.count("*").alias("support"), F.sum("copies").alias("n_et")).filter(F.col("support") >= min_support), "joint")
    documents = docs.count()
    threshold = F.pow(F.lit(2.0), -F.log2(F.lit(float(max(documents, 1))) / F.col("n_e")) * (1 - 1 / alpha))
    known = work.save(term_counts(docs, parsed, text_col), "terms")
    # A third of all pairs may share one entity; the table of entities has one row for each.
    telling = joint.join(known, "term").join(frequent, "e").filter(F.col("n_et") / F.col("n") >= threshold).select("e", "term", "class")
    telling = work.save(telling, "telling")
    classes = telling.filter("class IS NULL").select("e", F.col("term").alias("class"), F.lit(True).alias("tells"))
    decided = telling.filter("class IS NOT NULL").join(classes, ["e", "class"], "left").select("e", "term", F.coalesce("tells", F.lit(False)).alias("remove"))
    hits = together.filter("class IS NOT NULL").join(decided, ["e", "term"]).groupBy("text_key", "term").agg(F.max("remove").alias("remove"))
    found = hits.groupBy("text_key").agg(F.collect_list(F.struct("term", "remove")).alias("hits")).join(recurrent.select("text_key", "text"), "text_key")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, hits, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                remove = {h["term"]: h["remove"] for h in hits}
                own = [(t, a, b) for t, a, b in terms(text or "", base_spans(text or "")) if _hash(t) in remove]
                rows.append((key, _joined([("term", a, b) for _, a, b in own]), ["" if remove[_hash(t)] else t[:CLASS_LETTERS] + "*" for t, _, _ in own]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["text_key", "extra", "actions"])

    result = work.save(found.select("text_key", "hits", "text").mapInArrow(lean(spans), "text_key string, extra string, actions array<string>"), "disclosures")
    work.drop("parsed", "frequent", "recurrent", "joint", "terms", "telling")
    return result


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.1, min_support: int = 3) -> DataFrame:
    """One row per input row: ``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms)``.

    ``spans`` joins ``kind:start:end`` of the pattern matches and then of the disclosing terms (kind ``term``).  Null
    texts count as empty; null and repeated ids come back as they are; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "pii")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = scan(narrow, "text", "pii")
    scanned = work.save(found.withColumn("text", F.when(F.size("pii.entities") > 0, F.col("text"))), "scanned")
    extra = disclosures(narrow, scanned, "text", "pii", work, alpha, min_support)
    base, key = F.col("pii.base"), F.col("pii.text_key")
    rows = scanned.filter(F.size("pii.entities") > 0).join(extra.withColumnRenamed("text_key", "k"), F.col("k") == key, "left").select("doc_id", "pii", "extra", "actions")
    rows = rows.union(scanned.filter(F.size("pii.entities") == 0).select("doc_id", "pii", F.lit(None).cast("string"), F.lit(None).cast("array<string>")))
    joined = F.concat_ws(",", F.when(base != "", base), F.col("extra"))
    return rows.select("doc_id", *(F.col(f"pii.n_{k}") for k in KINDS), F.col("pii.base_sha256").alias("base_sha256"), joined.alias("spans"), F.coalesce(F.size("actions"), F.lit(0)).alias("n_terms"))


def replace(text: str, base: str, extra: str | None, actions: list[str] | None) -> str:
    """The text with each pattern match replaced by its kind in brackets and each disclosing term by its class or nothing."""
    parse = lambda joined: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in (joined or "").split(",") if x)]
    edits = sorted([(a, b, f"[{k.upper()}]") for k, a, b in parse(base)] + [(a, b, w) for (_, a, b), w in zip(parse(extra), actions or [], strict=True)])
    parts, at = [], 0
    for a, b, words in edits:
        if a >= at:
            parts += [text[at:a], words]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame, text_col: str = "text", alpha: float = 1.1, min_support: int = 3) -> DataFrame:
    """All rows and columns of ``docs``, with sanitised texts (see :func:`replace`); texts without finds stay as they are.

    Null texts stay null; repeated rows each come back; columns may have any names; an empty table gives no rows.
    """
    work, out = Workspace(docs.sparkSession, "pii"), fresh("pii", docs.columns)
    scanned = work.save(scan(docs, text_col, out), "scanned")
    extra = disclosures(docs, scanned, text_col, out, work, alpha, min_support)
    key, more, acts = (fresh(n, docs.columns) for n in ("text_key", "extra", "actions"))
    extra = extra.toDF(key, more, acts)
    dirty = scanned.filter(F.size(f"{out}.entities") > 0).join(extra, F.col(key) == F.col(f"{out}.text_key"), "left")
    names = docs.columns
    inputs = [*names, *(fresh(f"_{n}", names) for n in ("base", "extra", "actions"))]
    dirty = dirty.select(*names, F.col(f"{out}.base").alias(inputs[-3]), F.col(more).alias(inputs[-2]), F.col(acts).alias(inputs[-1]))
    at = names.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, base, extra, actions = (batch.column(i).to_pylist() for i in (at, len(names), len(names) + 1, len(names) + 2))
            new = pa.array([replace(*row) for row in zip(texts, base, extra, actions, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in range(len(names))], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return dirty.mapInArrow(lean(clean), schema).unionByName(scanned.filter(F.size(f"{out}.entities") == 0).select(*names))
