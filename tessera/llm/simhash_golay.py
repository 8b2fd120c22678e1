"""Near-duplicate detection: 64-bit SimHash fingerprints linked through Golay-code fuzzy keys.

A fingerprint is cut into three segments.  Two fingerprints at 2 or fewer differing bits agree exactly on at least one
segment (pigeonhole), and on any other segment they differ in at most 2 bits.  That other segment is read as a word
of the perfect (23, 12) Golay code and decoded to every codeword at distance 4 or less: one codeword where the
nearest is at distance 2 or less, else six.  Two words at distance 2 or less always share one of these codewords
(their midpoint has a codeword within 3, which is within 4 of both).  So the key (exact segment, codeword index of
the next segment) is shared by every pair that must link: at most 18 keys a fingerprint, each 33 bits or more wide.
Rows that share a key are verified by their real distance.

Only distinct fingerprints take part, however many copies a text has.  A key held by very many distinct fingerprints
is resolved exactly without comparing pairs: see :func:`midpoint_links`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..tables import Workspace
from ..workers import lean

#: Bit ranges (low bit, width) of the three segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator of the (23, 12) Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, words_per_shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one UTF-8 text: a bit is set where it is set in over half of the shingle hashes."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z only, and exactly space and 09-0D
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        digests, n = xxhash.xxh64_digest(b" ".join(words), seed), 1
    else:
        joined, hashed = b" ".join(words), xxhash.xxh64_digest
        ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
        starts = [0, *(e + 1 for e in ends)]
        digests = b"".join([hashed(joined[a:b], seed) for a, b in zip(starts, ends[words_per_shingle - 1 :], strict=False)])
        n = len(digests) // 8
    set_bits = np.zeros(64, np.int64)
    rows = np.frombuffer(digests, np.uint8).reshape(n, 8)
    for at in range(0, n, 255):  # 255 ones still fit in a byte
        set_bits += np.unpackbits(rows[at : at + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """Rows ``(doc_id, fp)``, ``fp`` the fingerprint as a signed 64-bit number."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py() or b"", words_per_shingle) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(lean(hashed), f"doc_id {kind}, fp long")


# ---------------------------------------------------------------- Golay keys


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


@lru_cache(maxsize=1)
def _error_patterns() -> np.ndarray:
    """For each syndrome the error patterns of weight 4 or less that have it, -1 where there are fewer than six."""
    patterns = np.array([sum(1 << b for b in bits) for w in range(5) for bits in combinations(range(23), w)], dtype=np.int64)
    table, used = np.full((2048, 6), -1, dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for pattern, s in zip(patterns, syndrome(patterns), strict=True):
        table[s, used[s]] = pattern
        used[s] += 1
    return table


def nearest_codewords(words: np.ndarray) -> np.ndarray:
    """For each column of :func:`codeword_indices`, whether it is the codeword within distance 3, of which every word has one."""
    errors = _error_patterns()[syndrome(words)]
    return (errors >= 0) & (np.bitwise_count(np.maximum(errors, 0)) <= 3)


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """The 12-bit indices of all codewords within distance 4 of each 23-bit word, in six columns, -1 where unused."""
    errors = _error_patterns()[syndrome(words)]
    return np.where(errors < 0, -1, (words.astype(np.int64)[:, None] ^ errors) >> 11)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of unsigned fingerprints: (position of the fingerprint, key)."""
    parts = [(prints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    rows, keys = [], []
    for s in range(3):
        near = codeword_indices(parts[(s + 1) % 3])
        row, _ = np.nonzero(near >= 0)
        rows.append(row)
        keys.append(np.int64(s) << 40 | parts[s][row] << 12 | near[near >= 0])
    return np.concatenate(rows), np.concatenate(keys)


# ---------------------------------------------------------------- links


def _group_links(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the distinct fingerprints of one key, a star for each set that is connected by real distances."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= max_bits
    label = np.arange(len(prints))
    while True:
        lower = np.where(near, label[None, :], len(prints)).min(axis=1)
        if (lower == label).all():
            break
        label = lower
    moved = label != np.arange(len(prints))
    return prints[moved], prints[label[moved]]


def golay_links(distinct: DataFrame, max_bits: int = 2, group_limit: int = 512) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the fingerprints of column ``fp`` at ``max_bits`` (2 or less) or fewer bits.

    Of a key with more than ``group_limit`` distinct fingerprints come rows ``(a, null)``, for :func:`midpoint_links`.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("Golay keys of three segments find pairs at 2 or fewer bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            rows, keys = fuzzy_keys(signed.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(signed[rows])], names=["key", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hot = None  # a key beyond the limit whose first rows are out already

        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            two = first[size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
            a, b, over = [fp[two + 1]], [fp[two]], []
            for at, n in zip(first[size > 2], size[size > 2], strict=True):
                if n > group_limit or key[at] == hot:
                    over.append(fp[at : at + n])
                else:
                    x, y = _group_links(fp[at : at + n], max_bits)
                    a.append(x)
                    b.append(y)
            over.extend(fp[at : at + n] for at, n in zip(first[size <= 2], size[size <= 2], strict=True) if hot is not None and key[at] == hot)
            a, b, over = np.concatenate(a), np.concatenate(b), np.concatenate(over) if over else np.zeros(0, np.uint64)
            right = pa.concat_arrays([pa.array(b.view(np.int64)), pa.nulls(len(over), pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, over]).view(np.int64)), right], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if len(key) - cut > group_limit:
                yield links(key[:cut], fp[:cut]) if cut else links(key[:0], fp[:0])
                hot, key, fp = key[-1], key[cut:], fp[cut:]
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64())], names=["a", "b"])
                key, fp = key[:0], fp[:0]
            elif cut:
                yield links(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield links(key, fp)

    keys = distinct.select("fp").mapInArrow(lean(keyed), "key long, fp long")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(lean(linked), "a long, b long")


def midpoint_links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect the fingerprints at 2 or fewer bits, in linear work.

    Every fingerprint gives itself and its 64 one-bit neighbours.  Two fingerprints share one of these exactly where
    they differ in 2 bits or fewer, so each shared neighbour links all of its holders to the smallest.
    """
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    near = distinct.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    low = near.groupBy("near").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return near.join(low, "near").filter("fp <> b").select(F.col("fp").alias("a"), "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, max_bits: int = 2, group_limit: int = 512) -> DataFrame:
    """One row per input row: ``(doc_id, fingerprint, component_id)``.

    ``fingerprint`` is 16 hexadecimal digits; ``component_id`` the smallest id that links of ``max_bits`` or fewer
    differing bits reach, the row's own included.  Texts without words, null texts included, have fingerprint zero and
    link like any other.  Repeated rows each come back; a null id gets the smallest id of its component, null if it
    has none.  Other columns of ``docs`` are not read; an empty table gives no rows.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "simhash")
    own = work.save(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    distinct = work.save(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links = work.save(golay_links(distinct, max_bits, group_limit), "links")
    edges = links.filter("b IS NOT NULL")
    if max_bits == 2 and (hot := links.filter("b IS NULL").select(F.col("a").alias("fp")).distinct()).take(1):
        edges = edges.union(midpoint_links(hot))
    elif links.filter("b IS NULL").take(1):
        raise ValueError("group_limit must not be reached where max_bits is below 2")
    component = connected_components(edges, "a", "b").withColumnRenamed("node", "fp")
    known = distinct.join(component, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    looked_up = work.save(known.join(lowest, "component").select("fp", "component_id"), "components")
    work.drop("links", "distinct")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(looked_up, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of its near-duplicate group.

    Repeated rows of a kept id are the same document and all stay; rows without an id stay.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone.hint("merge"), id_col, "left_anti").select(*docs.columns)  # their number grows with the corpus


# ---------------------------------------------------------------- similarity of texts


def shingle_digests(text: bytes, words_per_shingle: int) -> tuple[bytes, list[bytes]]:
    """The words of one text, joined by spaces, and the 16-byte digests of its different shingles (of all words if they are fewer)."""
    import xxhash

    words = text.lower().split()
    joined, hashed = b" ".join(words), xxhash.xxh3_128_digest
    if len(words) <= words_per_shingle:
        return joined, [hashed(joined)]
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends)]
    return joined, list({hashed(joined[a:b]) for a, b in zip(starts, ends[words_per_shingle - 1 :], strict=False)})


def _node(joined: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(joined) - (1 << 63)


#: Numbers of a text's fingerprint, 64 bits each; two of them are one half, with a ring of six segments.
WORDS = 4
PRINTS = ", ".join(f"f{i} long" for i in range(WORDS))


def wide_bits(digests: list[bytes]) -> np.ndarray:
    """SimHash of 256 bits over 16-byte shingle hashes: their own 128 bits, and 128 more that are mixed from them."""
    own = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    mixed = (own ^ own >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    rows, set_bits = np.ascontiguousarray(np.concatenate([own, mixed ^ mixed >> np.uint64(31)], axis=1)).view(np.uint8), np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(rows), 255):  # 255 ones still fit in a byte
        set_bits += np.unpackbits(rows[at : at + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(set_bits * 2 > len(rows)).view(np.int64)


def wide_prints(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """Rows ``(doc_id, node, f0 to f3)``: equal ``node`` means equal words; the rest is a SimHash of 256 bits."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints = [], np.zeros((batch.num_rows, WORDS), np.int64)
            for i, x in enumerate(batch.column(1)):
                joined, digests = shingle_digests(x.as_py() or b"", words_per_shingle)
                nodes.append(_node(joined))
                prints[i] = wide_bits(digests)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), *(pa.array(c.copy()) for c in prints.T)], names=["doc_id", "node", *(f"f{i}" for i in range(WORDS))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(lean(hashed), f"doc_id {kind}, node long, {PRINTS}")


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    """The six segments of one half of the fingerprints (two columns)."""
    return [(prints[:, c] >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for c in range(2) for low, width in SEGMENTS]


def wide_parts(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the keys of one half of the fingerprints (two columns) begin with: (position of the fingerprint, part).

    A part is a segment and one of its codewords within distance 4; a fingerprint has some 32.
    """
    rows, parts = [], []
    for s, word in enumerate(_segments(prints)):
        codes = codeword_indices(word)
        rows.append(np.nonzero(codes >= 0)[0])
        parts.append(np.int64(s) << 12 | codes[codes >= 0])
    return np.concatenate(rows), np.concatenate(parts)


def keys_of_parts(prints: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of one half of the fingerprints (two columns) that begin with the part beside each: (position, key).

    The six segments stand in a ring.  A key is a pair of segments next to each other or next but one, each by one of its
    codewords within distance 4, of which one at least is the nearest: 24 bits, some 10 keys a pair; keys of one part stand together.  At similarity 0.8 some 19
    of 128 bits differ, and two texts share a key of one half or the other with probability 0.96, at 0.82 with 0.97 and at 0.88 with
    0.996.
    """
    segment, code, words = parts >> 12, parts & 0xFFF, np.stack(_segments(prints))
    at = np.arange(len(parts))
    own = words[segment, at]
    is_nearest = ((codeword_indices(own) == code[:, None]) & nearest_codewords(own)).any(axis=1)
    rows, keys = [], []
    for step in (1, 2):
        other = words[(segment + step) % 6, at]
        codes = codeword_indices(other)
        valid = (codes >= 0) & (is_nearest[:, None] | nearest_codewords(other))
        rows.append(np.nonzero(valid)[0])
        keys.append((parts << 13 | (step - 1) << 12)[rows[-1]] | codes[valid])
    return np.concatenate(rows), np.concatenate(keys)


def first_parts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest part that begins a common key of each pair of halves (two columns each), -1 where there is none."""
    none, own = 1 << 20, []
    for u, v in zip(_segments(x), _segments(y), strict=True):
        codes = codeword_indices(u)
        same = (codes[:, :, None] == codeword_indices(v)[:, None, :]) & (codes >= 0)[:, :, None]
        own.append((codes, same.any(axis=2), nearest_codewords(u), (same & nearest_codewords(v)[:, None, :]).any(axis=2)))
    found = np.full(len(x), none, np.int64)
    for t, (codes, common, near_x, near_y) in enumerate(own):
        for step in (1, 2):
            _, other, other_x, other_y = own[(t + step) % 6]
            meets = common[:, :, None] & other[:, None, :] & (near_x[:, :, None] | other_x[:, None, :]) & (near_y[:, :, None] | other_y[:, None, :])
            found = np.minimum(found, np.where(meets.any(axis=2), t << 12 | codes, none).min(axis=1))
    return np.where(found == none, -1, found)


#: The fingerprint in a key's rows: the half that gives the keys, and the other one.
OWN = ["f0", "f1", "f2", "f3"]


def _apart(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Differing bits of fingerprints that are given word by word."""
    apart = np.bitwise_count(x[0] ^ y[0]).astype(np.int16)
    for a, b in zip(x[1:], y[1:], strict=True):
        apart += np.bitwise_count(a ^ b)
    return apart


def wide_candidates(distinct: DataFrame, max_bits: int, group_limit: int, steps: int = 2) -> DataFrame:
    """Of rows ``(node, f0 to f3)``, whose first two words give the keys: candidate pairs and crowded rows ``(key, a, b, f0 to f3)``.

    Of a key with up to ``group_limit`` rows come all pairs ``(a, b)`` that differ in ``max_bits`` or fewer of 256 bits (``key`` is
    their number).  A key with more is crowded: its rows come out themselves (``b`` is null), for :func:`crowded_candidates`, and each
    with its next ``steps`` rows as pairs, which already links most near copies.
    """

    def halves(part: pa.RecordBatch, first: int) -> np.ndarray:
        return np.stack([part.column(first + i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1)], axis=1)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                rows, parts = wide_parts(halves(piece, 1))
                yield pa.RecordBatch.from_arrays([pa.array(parts), *piece.take(pa.array(rows)).columns], names=["part", "node", *OWN])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = keys_of_parts(halves(batch, 2), batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(keys), *batch.take(pa.array(rows)).columns[1:]], names=["key", "node", *OWN])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, hot = [np.zeros(0, np.int64)] * (2 + WORDS), None

        def out(key, node, *words) -> pa.RecordBatch:
            """All of whole keys, or more of the hot one."""
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            crowded = np.repeat((size > group_limit) | (key[first] == hot if hot is not None else False), size)
            unsigned, left, right, bits = [w.view(np.uint64) for w in words], [key[:0]], [key[:0]], [key[:0]]
            live = np.arange(len(key))
            for k in range(1, group_limit + 1):
                live = live[live + k < len(key)]
                live = live[(key[live + k] == key[live]) & (~crowded[live] | (k <= steps))]
                if not len(live):
                    break
                apart = _apart([u[live] for u in unsigned], [u[live + k] for u in unsigned])
                now = live[apart <= max_bits]
                left.append(now)
                right.append(now + k)
                bits.append(apart[apart <= max_bits].astype(np.int64))
            rows, left, right, bits = np.flatnonzero(crowded), np.concatenate(left), np.concatenate(right), np.concatenate(bits)
            a, b, part = np.maximum(node[left], node[right]), np.minimum(node[left], node[right]), key[left] >> 13
            # Near copies share most keys with one beginning, which follow each other: their pairs come out once a batch, and
            # of all parts only from the first one.  Where its keys are crowded, their rows come out and are compared later.
            order = np.lexsort((b, a, part, crowded[left]))
            a, b, part, bits, left, right = a[order], b[order], part[order], bits[order], left[order], right[order]
            once = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (part[1:] != part[:-1])][: len(a)])
            half, own = np.stack(unsigned[:2], axis=1), []
            for at in range(0, len(once), 10_000):
                now = once[at : at + 10_000]
                own.append(now[crowded[left[now]] | (first_parts(half[left[now]], half[right[now]]) == part[now])])
            once = np.concatenate([once[:0], *own])
            none = pa.nulls(len(once), pa.int64())
            columns = [pa.array(np.concatenate([bits[once], key[rows]])), pa.array(np.concatenate([a[once], node[rows]])), pa.concat_arrays([pa.array(b[once]), pa.nulls(len(rows), pa.int64())])]
            columns += [pa.concat_arrays([none, pa.array(w[rows])]) for w in words]
            return pa.RecordBatch.from_arrays(columns, names=["key", "a", "b", *OWN])

        for batch in batches:
            columns = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns, strict=True)]
            key = columns[0]
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if cut:
                yield out(*(c[:cut] for c in columns))
            rest = [c[cut:] for c in columns]
            if len(rest[0]) > group_limit:
                hot = int(key[-1])
                yield out(*rest)
                rest = [c[:0] for c in rest]
        if len(rest[0]):
            yield out(*rest)

    # All keys with one beginning are made where it was dealt to, so a row goes through the shuffle 32 times and not once a key.
    parts = distinct.select("node", *OWN).mapInArrow(lean(dealt), f"part long, node long, {PRINTS}").repartition("part")
    return parts.mapInArrow(lean(keyed), f"key long, node long, {PRINTS}").sortWithinPartitions("key", "f0").mapInArrow(lean(linked), f"key long, a long, b long, {PRINTS}")


def crowded_candidates(crowded: DataFrame, max_bits: int, partners: int | None, block: int = 2048) -> DataFrame:
    """Rows ``(a, b, more)``: pairs of nodes of different components among the rows ``(key, node, component, f0 to f3)`` of crowded
    keys that differ in ``max_bits`` or fewer bits; of each row and key only the ``partners`` nearest ones in a block, with
    ``more`` true where there are others (``b`` is then null).

    Rows of a key's most frequent component need no comparison among themselves, so only the others are compared, with all of
    the key.  Both are dealt to blocks of about ``block`` rows, and each pair of blocks is a group of its own.
    """
    per_component = crowded.groupBy("key", "component").agg(F.count("*").alias("n"))
    # Keys whose rows are all in one component have no pairs any more.
    sizes = per_component.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("components")).filter("components > 1")
    blocks = lambda n: F.greatest(F.lit(1).cast("long"), F.ceil(n / block)).cast("int")
    sizes = sizes.select("key", F.col("top.component").alias("frequent"), blocks(F.col("n")).alias("right"), blocks(F.col("n") - F.col("top.n")).alias("left"))
    rows = crowded.join(sizes.hint("merge"), "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    left = rows.filter("component <> frequent").select("key", own(F.col("left"), 1).alias("i"), every(F.col("right")).alias("j"), F.lit(0).alias("side"), "node", "component", *OWN)
    right = rows.select("key", every(F.col("left")).alias("i"), own(F.col("right"), 2).alias("j"), F.lit(1).alias("side"), "node", "component", *OWN)

    def compared(node, component, words, n_left) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, more = [], [], []
        yn, yc = node[n_left:], component[n_left:]
        for at in range(0, n_left, 64):
            own = slice(at, min(at + 64, n_left))
            apart = _apart([w[own, None] for w in words], [w[None, n_left:] for w in words])
            apart[component[own, None] == yc[None]] = 999
            if partners is not None and apart.shape[1] > partners:
                # Whole numbers in the order of distance, then place.
                rank = apart.astype(np.int64) * apart.shape[1] + np.arange(apart.shape[1])
                worst = np.partition(rank, partners, axis=1)[:, partners, None]
                cut = (worst[:, 0] // apart.shape[1]) <= max_bits
                more.append(node[own][cut])
                apart[rank >= worst] = 999
            i, j = np.nonzero(apart <= max_bits)
            a.append(np.maximum(node[own][i], yn[j]))
            b.append(np.minimum(node[own][i], yn[j]))
        return np.concatenate(a), np.concatenate(b), np.concatenate([node[:0], *more])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, i, j, side, node, component, *words = columns
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            for s, e in zip(starts, np.r_[starts[1:], len(key)], strict=True):
                n_left = int((side[s:e] == 0).sum())
                if n_left and n_left < e - s:
                    a, b, more = compared(node[s:e], component[s:e], [w[s:e].view(np.uint64) for w in words], n_left)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, more])), pa.concat_arrays([pa.array(b), pa.nulls(len(more), pa.int64())]), pa.array(np.arange(len(a) + len(more)) >= len(a))], names=["a", "b", "more"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)] if rest else columns
            if not len(columns[0]):
                continue
            changed = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]) | (columns[2] != columns[2][-1]))
            cut = int(changed[-1]) + 1 if len(changed) else 0
            yield from out([c[:cut] for c in columns]) if cut else ()
            rest = [c[cut:] for c in columns]
        if rest and len(rest[0]):
            yield from out(rest)

    dealt = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return dealt.mapInArrow(lean(linked), "a long, b long, more boolean").distinct()


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows ``(node, text)`` of the given nodes, one each, ``text`` the words joined by spaces."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [b" ".join((x.as_py() or b"").lower().split()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(j) for j in joined], pa.int64()), pa.array(joined, pa.binary())], names=["node", "text"])

    texts = docs.select(F.col("text").cast("binary")).mapInArrow(lean(named), "node long, text binary")
    return texts.join(nodes.hint("merge"), "node", "left_semi").dropDuplicates(["node"])


def shingle_sets(texts: DataFrame, nodes: DataFrame, words_per_shingle: int) -> DataFrame:
    """Rows ``(node, shingles)`` of the given nodes of :func:`texts_of`, ``shingles`` the different 64-bit shingle hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(b"".join(shingle_digests(x.as_py(), words_per_shingle)[1]), np.int64)[::2] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.join(nodes.hint("merge"), "node", "left_semi").mapInArrow(lean(cut), "node long, shingles array<long>")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8, max_bits: int = 55, group_limit: int = 64, partners: tuple[int, ...] = (4, 64)) -> DataFrame:
    """One row per input row: ``(doc_id, component_id)``, the smallest id that links of texts reach whose sets of shingles
    have a Jaccard similarity of ``similarity`` or more.

    Candidates share a Golay key of one half of their fingerprints and differ in ``max_bits`` or fewer of all 256 bits, which at
    0.8 holds for 0.96 of all pairs; every link is verified on the whole texts.  In keys with more than ``group_limit`` texts, rounds
    compare each text with its nearest ones of other components first (``partners`` of them, more from round to round) and at
    last with all that are left, until no text has a candidate that was not tried; so no limit drops a link.  Equal texts, those
    without words included, are one node.  A null id counts last in its group; an empty table gives no rows; repeated rows each
    come back.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "similar")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = work.save(wide_prints(narrow, words_per_shingle), "prints")
    prints = [f"f{i}" for i in range(WORDS)]
    distinct = work.save(own.groupBy("node", *prints).agg(F.min("doc_id").alias("first")), "distinct")
    halves = []
    for h in range(2):
        half = distinct.select("node", *[F.col(prints[(2 * h + i) % WORDS]).alias(OWN[i]) for i in range(WORDS)])
        halves.append(work.save(wide_candidates(half, max_bits, group_limit).withColumn("half", F.lit(h)), f"half_{h}"))
        work.release()  # else the keys' shuffle files of both halves are there at once
    found = halves[0].unionByName(halves[1])
    crowded = found.filter("b IS NULL").select(((F.col("key") * 2) + F.col("half")).alias("key"), F.col("a").alias("node"), *OWN)

    # Texts without a candidate are read once and go no further.
    held = found.select(F.col("a").alias("node")).union(found.filter("b IS NOT NULL").select("b")).distinct()
    texts = work.save(texts_of(narrow, held), "texts")

    def verified(pairs: DataFrame, step: str) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = work.save(shingle_sets(texts, nodes, words_per_shingle), f"sets_{step}")
        # Many pairs may have one b: it is looked up while rows are short.  The tables grow with the corpus: none is broadcast.
        both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a")
        shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("total"))
        links = work.save(shared.filter(F.col("n") >= F.lit(similarity) * (F.col("total") - F.col("n"))).select("a", "b"), f"links_{step}")
        work.drop(f"sets_{step}")
        return links

    tried = work.save(found.filter("b IS NOT NULL").groupBy("a", "b").agg(F.min("key").alias("bits")), "pairs_0")

    def apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
        """The pairs whose sides are in different components."""
        side = lambda x: component.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")).hint("merge")
        joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        return joined.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b", "bits")

    # A large group of near copies has far more pairs than it needs links: each text is first compared with its nearest one, and
    # again, and only pairs that are still in different components are compared after that.
    links, open_ = spark.createDataFrame([], "a long, b long"), tried
    for step in ("1", "2", "all"):
        chosen = open_.select("a", "b")
        if step != "all":
            nearest = [open_.groupBy(x).agg(F.min(F.struct("bits", y)).alias("n")).select(*([x, F.col(f"n.{y}").alias(y)] if x == "a" else [F.col(f"n.{y}").alias(y), x])) for x, y in (("a", "b"), ("b", "a"))]
            chosen = work.save(nearest[0].union(nearest[1]).distinct(), f"nearest_{step}")
        links = links.union(verified(chosen, step))
        if step != "all":
            left = open_.join(chosen.hint("merge"), ["a", "b"], "left_anti")
            open_ = work.save(apart(left, connected_components(links, "a", "b")), f"apart_{step}")
            if not open_.take(1):
                break
    more = bool(crowded.take(1))
    for i, most in enumerate((*partners, None), start=1):
        if not more:
            break
        component = connected_components(links, "a", "b")
        rows = crowded.join(component.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        met = work.save(crowded_candidates(rows, max_bits, most), f"met_{i}")
        pairs = work.save(met.filter("NOT more").select("a", "b").join(tried.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), f"pairs_{i}")
        if pairs.take(1):
            links, tried = links.union(verified(pairs, f"crowded_{i}")), tried.select("a", "b").union(pairs)
        more = bool(met.filter("more").take(1))
    component = connected_components(links, "a", "b")
    known = distinct.join(component, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    lowest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    looked_up = work.save(known.join(lowest, "component").select("node", "component_id"), "components")
    work.drop("distinct", "half_0", "half_1", "texts")
    return own.join(looked_up, "node").select("doc_id", "component_id")


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Like :func:`keep_first`, with the groups of :func:`similar_documents`."""
    gone = similar_documents(docs, id_col, text_col, **options).filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone.hint("merge"), id_col, "left_anti").select(*docs.columns)
