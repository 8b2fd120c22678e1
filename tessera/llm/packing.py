"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

The method is bulk-synchronous best fit.  Pieces are range-sorted by length; a sweep takes the length classes from
long to short and matches a whole class at once to the successor gaps (the smallest gap that still holds the
length); pieces of one class that compete for the same gaps are told apart by their rank; gaps shrink, and the next
sweep begins.  Pieces of equal length are interchangeable and lengths are whole numbers up to the capacity, so the
sweeps only need the number of pieces per length, at most ``capacity`` counters however large the corpus is.  Ranks
are counted in parallel: a running number inside each range partition plus the totals of the partitions before.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Workspace
from ..workers import kept, lean

#: Rows of the placement plan that are sent to the executors; a larger plan is joined instead.
PLAN_ROWS_SENT = 1_000_000
#: Texts of about this many bytes are split at once (or one longer text).
GROUP_BYTES = 16_000_000


class TokenCache(dict):
    """Unit of text (see :func:`units`) -> its ids as little-endian 32-bit words.

    A text's ids are those of its chunks between white space in order, a chunk's those of its units.  A batch of texts is
    split once, each different chunk of it is cut into units once, and the words that it adds are encoded together.  Two
    generations of at most ``limit`` units bound the memory.
    """

    def __init__(self, tokenizer_path: str, limit: int = 500_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.limit, self.old = Tokenizer.from_file(tokenizer_path), limit, {}
        #: The same merges without normalisation and without the split by a pattern, which leave words as they are.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        #: Tokens that are found in the text as it is written, before anything else.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.added_lower = pc.ascii_lower(pa.array(added, pa.string())).to_pylist()

    def units(self, chunk: str) -> list[str]:
        if not self.added.search(chunk):
            return units(chunk)
        return [u for part in _CHUNK.findall(chunk) for u in ([part] if self.added.search(part) else units(part))]

    def _encode(self, unit: str) -> bytes:
        return np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _add_words(self, words: list[str]) -> None:
        """Encodes Latin words, some hundreds in one call; each ends with the first id that ends a word."""
        lines = [" ".join(words[at : at + 200]) for at in range(0, len(words), 200)]
        found = (e.ids for at in range(0, len(lines), 50) for e in self.merges.encode_batch_fast(lines[at : at + 50], add_special_tokens=False))
        ids = np.fromiter(chain.from_iterable(found), "<u4")
        ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
        if len(ends) != len(words):  # a vocabulary without word ends
            self.update((w, self._encode(w)) for w in words)
        else:
            data = ids.tobytes()
            self.update((w, data[a:b]) for w, a, b in zip(words, [0, *ends[:-1]], ends, strict=True))

    def _add(self, wanted: set[str]) -> set[str]:
        """Adds what is missing of the ``wanted`` units, and returns what had to be encoded."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        new = {u for u in wanted if u not in self}
        known = new & self.old.keys()
        self.update((u, self.old[u]) for u in known)
        new -= known
        words = [u for u in new if _WORD.fullmatch(u)]
        if words:
            self._add_words(words)
        self.update((u, self._encode(u)) for u in new.difference(words))
        return new

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The different chunks, the number of the chunk at each place, and where the places of each text begin and end."""
        texts = texts.fill_null("")
        lower = pc.ascii_lower(texts)
        as_written = [*(pc.match_substring(lower, t) for t in self.added_lower), pc.match_substring_regex(texts, _MARKED)]
        if not any(pc.any(x).as_py() for x in as_written):
            texts = lower  # fewer different chunks
        # Other white space than ASCII's stays within a chunk, whose units tell it.
        split = pc.ascii_split_whitespace(texts)
        found = split.flatten().dictionary_encode()
        return found.dictionary, found.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy()

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        chunks, chunk, borders = self._split(texts)
        word = pc.match_substring_regex(chunks, f"^{_WORD.pattern}$").to_numpy(zero_copy_only=False)
        flat, n_units = chunks.filter(pa.array(word)).to_numpy(zero_copy_only=False).tolist(), []
        for c in chunks.filter(pa.array(~word)).to_numpy(zero_copy_only=False):
            own = self.units(c)
            flat += own
            n_units.append(len(own))
        new = self._add(set(flat))
        ids = list(map(self.__getitem__, flat))
        for unit in new:  # long ones are not met again
            if len(unit) > 64:
                del self[unit]
        # The chunks' ids one behind the other, words first; those of the texts are taken from there.
        data, n_words = np.frombuffer(b"".join(ids), "<u4"), int(word.sum())
        n_ids = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        ends = np.r_[0, np.cumsum(n_ids)][np.r_[0 : n_words + 1, n_words + np.cumsum(np.array(n_units, np.int64))]]
        del flat, ids, new
        place = np.where(word, np.cumsum(word) - 1, n_words + np.cumsum(~word) - 1)
        start, length = ends[:-1][place], np.diff(ends)[place]
        for a, b in pairwise(borders.tolist()):
            at = chunk[a:b]
            n = length[at]
            end = np.cumsum(n)
            yield data[np.repeat(start[at] - end + n, n) + np.arange(end[-1] if b > a else 0)]

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text]))).tobytes()


#: Words of letters that are lower-cased one by one and that normalisation leaves as they are.
_WORD = re.compile("[a-zß-öø-ÿ]+")
#: The tokenizer's own split (fixed values), for texts of ASCII characters and those letters alone.
_UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+|[\x1c-\x1f]+")
_OTHER = re.compile("[^\x00-\x1b -~ß-öø-ÿ]")
#: White-space chunks; str.split() would drop the separators 1C-1F, which are no white space to the tokenizer.
_CHUNK = re.compile(r"[\S\x1c-\x1f]+")
#: The tokenizer composes before it lower-cases, and some small letters have a composed form where the capital has none.
_MARKED = r"[A-Z]\p{M}"


def units(text: str) -> list[str]:
    """Parts of a text that are tokenised by themselves: words, digits and marks; whole chunks, as written, where they hold other characters."""
    lower = text.lower() if text.isascii() else _lower_latin(text)
    if not _OTHER.search(lower):
        return _UNIT.findall(lower)
    own: list[str] = []
    for chunk in _CHUNK.findall(text):
        lower = _lower_latin(chunk)
        own += [chunk] if _OTHER.search(lower) else _UNIT.findall(lower)
    return own


_LATIN = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"}


def _lower_latin(text: str) -> str:
    """Lower case where that is one letter for one; the tokenizer does the rest."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.translate(_LATIN)
    return text.lower()


def _groups(sizes: np.ndarray, limit: int) -> list[int]:
    """Lengths of runs of consecutive items with a sum of about ``limit``."""
    group = np.cumsum(sizes, dtype=np.int64) // limit
    return np.diff(np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]).tolist() if len(group) else []


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, piece, start, length, ids_crc32)``: every document's ids and ``end_id``, cut at ``capacity``."""
    id_type = docs.schema[id_col].dataType

    def cached(cache: TokenCache, texts: pa.Array) -> Iterator[np.ndarray]:
        at = 0
        for n in _groups(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), GROUP_BYTES):
            yield from cache.encode_all(texts.slice(at, n))
            at += n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = kept(tokenizer_path, lambda: TokenCache(tokenizer_path))
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(cached(cache, batch.column(1))):
                ids = ids.tobytes() + end
                total = len(ids) // 4
                for k, at in enumerate(range(0, total, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(cut), f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Sweeps over length classes: rows ``(length, first rank, end rank, first sequence, offset)``.

    Ranks ``first..end-1`` of a length go to consecutive sequences from ``first sequence`` on, at ``offset``.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, number of sequences) with that gap
    order: list[int] = []  # gaps in use, ascending
    opened = 0

    def give(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                insort(order, gap)
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (at := bisect_left(order, length)) < len(order):
            gap = order[at]
            first, n = runs[gap].pop()
            taken = min(n, left)
            plan.append((length, rank, rank + taken, first, capacity - gap))
            give(gap, first + taken, n - taken)
            if not runs[gap]:
                del runs[gap], order[bisect_left(order, gap)]
            give(gap - length, first, taken)
            rank, left = rank + taken, left - taken
        per = capacity // length
        for n_sequences, each in ((left // per, per), (1, left % per)):
            if n_sequences and each:
                for k in range(each):
                    plan.append((length, rank, rank + n_sequences, opened, k * length))
                    rank += n_sequences
                give(capacity - each * length, opened, n_sequences)
                opened += n_sequences
    return plan


def pack(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of :func:`pieces` (any table with ``length`` in 1..capacity).

    Every row gets a place, repeated rows each their own; an empty table gives an empty result.  Sequences are
    filled without holes from offset 0.
    """
    spark, work = found.sparkSession, Workspace(found.sparkSession, "packing")
    columns = found.columns
    saved = work.save(found, "pieces")
    by = ["length", *[c for c in columns if c != "length"]]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            at = np.arange(len(length))
            first = np.flatnonzero(np.r_[True, length[1:] != length[:-1]]) if len(length) else at
            rank = at - np.repeat(first, np.diff(np.r_[first, len(length)]))
            if len(length):
                rank = rank + np.where(length == last, seen, 0)
                last, seen = length[-1], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(rank.astype(np.int64))], names=[*columns, "_part", "_rank"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields) + ", _part int, _rank long"
    sorted_pieces = work.save(saved.repartitionByRange(*by).sortWithinPartitions("length").mapInArrow(lean(ranked), schema), "ranked")
    # One row for each length in each range partition: neighbours share at most one length.
    totals = sorted_pieces.groupBy("length", "_part").agg(F.count("*").alias("n")).orderBy("length", "_part").collect()
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for length, part, n in totals:
        before[part, length] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    plan = sorted(best_fit_plan(counts, capacity))
    work.drop("pieces")
    if len(plan) > PLAN_ROWS_SENT:
        starts = spark.createDataFrame([(p, n, b) for (p, n), b in before.items()], "_part int, length long, _before long")
        table = spark.createDataFrame(plan, "length long, _from long, _to long, _first long, offset long")
        numbered = sorted_pieces.join(starts, ["_part", "length"]).withColumn("_r", F.col("_rank") + F.col("_before"))
        placed = numbered.join(table, "length").filter("_r >= _from AND _r < _to")
        return placed.select(*columns, (F.col("_first") + F.col("_r") - F.col("_from")).alias("sequence_id"), "offset")
    length_of, from_of, _, first_of, offset_of = (np.array(x, dtype=np.int64) for x in zip(*plan, strict=True)) if plan else (np.zeros(0, np.int64),) * 5
    by_class = {int(n): (int(a), int(b)) for n, a, b in zip(*(lambda u, i, c: (u, i, i + c))(*np.unique(length_of, return_index=True, return_counts=True)), strict=True)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, part, rank = (data[n].to_numpy(zero_copy_only=False) for n in ("length", "_part", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for p, n in {*zip(part.tolist(), length.tolist(), strict=True)}:
                own = (part == p) & (length == n)
                r = rank[own] + before[p, n]
                a, b = by_class[n]
                at = a + np.searchsorted(from_of[a:b], r, side="right") - 1
                sequence[own], offset[own] = first_of[at] + r - from_of[at], offset_of[at]
            yield pa.RecordBatch.from_arrays([*(data[c] for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields) + ", sequence_id long, offset long"
    return sorted_pieces.mapInArrow(lean(place), out)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises, cuts and packs whole documents; one row per piece.

    A null text counts as empty: one piece that holds ``end_id`` alone.  Null or repeated ids are kept as they are;
    other columns of ``docs`` are not read.  An empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), capacity)
