"""Removal of passages that an earlier document already has, by suffix arrays built with linear grouping.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a document with a smaller id.

1.  Anchors: every window of ``length`` bytes has the smallest hash of its 16-byte strings.  A run is a longest stretch of
    windows with one such hash, some 35 bytes further than a window; equal windows lie in runs of equal hash, so runs are
    dealt to tasks by it.  A repeated letter or phrase is one run, however long.
2.  Runs travel as two hashes, a place and a length.  Equal runs are one text: it goes from every document but the smallest.
    Where a hash has different runs in different documents, the bytes of those runs are fetched, each once.
3.  A task cuts the fetched runs down to the stretches whose windows another document has too (by window hashes, which only
    choose what is sorted), joins the different stretches and builds one suffix array.  Equal windows are neighbours in
    it; a window goes from every document but the smallest that has it.

The suffix array is built by linear grouping, see :func:`suffix_array`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Workspace

GRAM = 16
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Bytes whose hashes are made at once.
_BLOCK = 1 << 22
#: Longer stretches are sorted in pieces of this many bytes that overlap by a window less a byte.
_PIECE = 4096


# ---------------------------------------------------------------- suffix arrays


def suffix_array(data: bytes) -> list[int]:
    """Starts of all suffixes in order; a suffix that is a prefix of another comes first.  Linear time and memory.

    Suffixes are grouped by what is known of their longest Lyndon prefix, at first one byte; a group's name is the place in
    the order where it begins.  Groups are taken in descending order.  A member points to the last place before it
    whose group is smaller; the places that members point to are continued by this group's prefix, once per member, so they
    leave their groups for the end of them, those with the most members last.  When all groups are done they are final, and
    one pass over the order places each suffix before the one just read, and what it points to, at the head of its group.
    """
    n = len(data)
    codes = np.frombuffer(data, np.uint8)
    by_code = np.argsort(codes, kind="stable")
    count = np.bincount(codes, minlength=256)
    first = np.cumsum(count) - count
    place = np.empty(n, np.int64)
    place[by_code] = np.arange(n)
    group, order, where = first[codes].tolist(), by_code.tolist(), place.tolist()
    end = [0] * (n + 1)
    for a, c in zip(first.tolist(), count.tolist(), strict=True):
        if c:
            end[a] = a + c
    previous = [-1] * n
    top = n
    while top:
        name = group[order[top - 1]]
        members = order[name:top]
        if top - name > 1:
            members.sort()
        top = name
        pointed: dict[int, list[int]] = {}  # number of members -> places that so many members point to
        last, times = -1, 0
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= name:
                j = previous[j]
            previous[i] = j
            if j == last:
                times += 1
            else:  # members that point to one place follow one another
                if last >= 0:
                    pointed.setdefault(times, []).append(last)
                last, times = j, 1
        if last >= 0:
            pointed.setdefault(times, []).append(last)
        for times in sorted(pointed, reverse=True):
            old_end: dict[int, int] = {}
            for p in pointed[times]:
                g = group[p]
                e = end[g]
                if g not in old_end:
                    old_end[g] = e
                e -= 1
                other, at = order[e], where[p]
                order[e], order[at] = p, other
                where[p], where[other] = e, at
                end[g] = e
            for p in pointed[times]:
                group[p] = end[group[p]]
            for g, e in old_end.items():
                end[end[g]] = e
    out, head, placed = [-1] * n, list(range(n)), bytearray(n)
    for r in range(-1, n):
        i = (out[r] if r >= 0 else n) - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[head[g]] = i
            head[g] += 1
            placed[i] = 1
            i = previous[i]
    return out


# ---------------------------------------------------------------- hashes of bytes


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = a ^ (b * _M1)
    a ^= a >> np.uint64(31)
    a *= _M2
    a ^= a >> np.uint64(29)
    return a


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place on."""
    b = data.astype(np.uint64)
    u = b[:-1] | b[1:] << np.uint64(8)
    u = u[:-2] | u[2:] << np.uint64(16)
    u = u[:-4] | u[4:] << np.uint64(32)
    h = u[:-8] * _M1
    h ^= h >> np.uint64(31)
    h += u[8:] * _M2
    h ^= h >> np.uint64(29)
    h *= _M3
    h ^= h >> np.uint64(32)
    return h


def _window_hash(grams: np.ndarray, at: np.ndarray | slice, length: int, salt: int = 0) -> np.ndarray:
    """A hash of the windows that start at the given places, from grams that cover them."""
    steps = [*range(0, length - GRAM, GRAM), length - GRAM]
    if isinstance(at, slice):
        parts = [grams[s : len(grams) - (length - GRAM) + s] for s in steps]
    else:
        parts = [grams[at + s] for s in steps]
    found = parts[0] + np.uint64(salt)
    for part in parts[1:]:
        found = _mix(found, part)
    return found


def _span_hash(grams: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """A hash of the bytes ``start..end-1``: of the first and last window, or of all bytes where these leave some out."""
    import xxhash

    found = _mix(_mix(_window_hash(grams, start, length), _window_hash(grams, end - length, length)), (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > 2 * length).tolist():
        found[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return found


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins in sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def runs_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after the other: anchor hash, hash, text, start in it and size of every run."""
    out = []
    n, at = len(ends), 0
    begins = np.r_[0, ends[:-1]]
    while at < n:
        # Whole texts up to a block; a text beyond it by itself, in blocks that overlap by a window less a byte.
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + _BLOCK, side="right")))
        a, b = int(begins[at]), int(ends[to - 1])
        size = b - a
        step = size if to > at + 1 or size <= _BLOCK else _BLOCK - length + 1
        for x in range(a, max(a + 1, b - length + 1), max(step, 1)):
            part = data[x : min(b, x + step + length - 1)]
            if len(part) < length:
                continue
            grams = _grams(part)
            low, done, width = grams, 1, length - GRAM + 1
            while 2 * done <= width:
                low = np.minimum(low[:-done], low[done:])
                done *= 2
            if done < width:
                low = np.minimum(low[: len(low) - (width - done)], low[width - done :])
            text = np.repeat(np.arange(at, to), np.diff(np.r_[begins[at], ends[at:to]])) if to > at + 1 else np.full(len(part), at)
            windows = np.flatnonzero(text[: len(low)] == text[length - 1 : length - 1 + len(low)])
            if not len(windows):
                continue
            low, text = low[windows], text[windows]
            first = np.flatnonzero(_groups(low, text))
            start, end = windows[first], windows[np.r_[first[1:], len(windows)] - 1] + length
            out.append((low[first], _span_hash(grams, part, start, end, length), text[first], start + x - begins[text[first]], end - start))
        at = to
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


# ---------------------------------------------------------------- packed rows

_PLACE = [("doc", np.int64), ("key", np.int32), ("start", np.int32), ("size", np.int32)]


def _pack(columns: list[np.ndarray], compressor) -> bytes:
    doc, *rest = columns
    return compressor.compress(b"".join([np.diff(doc, prepend=0).astype(np.int64).tobytes(), *(c.astype(np.int32).tobytes() for c in rest)]))


def _unpack(blobs: list[bytes], decompressor) -> list[np.ndarray]:
    parts = []
    for blob in blobs:
        data = decompressor.decompress(blob)
        n = len(data) // 20
        parts.append([np.cumsum(np.frombuffer(data, np.int64, n)), *(np.frombuffer(data, np.int32, n, 8 * n + 4 * n * k) for k in range(3))])
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, (_, t) in enumerate(_PLACE)]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column one after the other, and where each ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def _steps(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, as the arrays made of a part are many times its size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _least(new: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each sorted row the smallest document of its group."""
    return np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1] if len(doc) else doc


FOUND = "doc_id long, text_key int, start int, size int, hash long, run long, hot boolean"


def _found(doc: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray | None = None, run: np.ndarray | None = None, hot: np.ndarray | None = None) -> pa.Table:
    n = len(doc)
    given = lambda c, t: pa.nulls(n, t) if c is None else pa.array(c.view(np.int64) if t == pa.int64() else c, t)
    columns = [pa.array(doc.astype(np.int64)), *(pa.array(c.astype(np.int32)) for c in (key, start, size)), given(hashes, pa.int64()), given(run, pa.int64()), given(hot, pa.bool_())]
    return pa.table(columns, names=["doc_id", "text_key", "start", "size", "hash", "run", "hot"])


def compared_runs(texts: DataFrame, length: int, group_limit: int, batch_limit: int = 256) -> DataFrame:
    """Rows ``(doc_id, text_key, start, size)`` of runs that go, and, with ``hash``, ``run`` and ``hot``, of runs whose bytes
    are needed; ``hot`` are those of anchor hashes with very many different runs.

    A batch sends an equal run only for its smallest document.  An anchor hash with over ``batch_limit`` different runs in one
    batch is known to be hot there: its runs are not sent, only word of it.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(512, total // 3_000_000)
    names = ["bucket", "keys", "places", "gone", "hot_keys", "hot_places"]

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=1)
        for number, batch in enumerate(_steps(batches)):
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            anchor, run, text, start, size = runs_of(*_texts(batch.column(2)), length)
            doc, key = ids[text], keys[text]
            order = np.argsort(_mix(anchor, run), kind="stable")
            new = _groups(anchor[order], run[order])
            kept = np.empty(len(doc), bool)
            kept[order] = doc[order] == _least(new, doc[order])
            gone = list(_joined_spans(doc[~kept], key[~kept], start[~kept], size[~kept]))
            # Hot anchor hashes of this batch.
            head = order[new]
            by_anchor = np.sort(anchor[head])
            at = np.flatnonzero(_groups(by_anchor))
            many = by_anchor[at][np.diff(np.r_[at, len(by_anchor)]) > batch_limit]
            hot = kept & np.isin(anchor, many) if len(many) else np.zeros(len(doc), bool)
            sent = np.flatnonzero(kept & ~hot)
            bucket = ((anchor[sent] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(bucket.astype(np.uint16) if buckets <= 65536 else bucket, kind="stable")
            sent, bucket = sent[by_bucket], bucket[by_bucket]
            at = np.flatnonzero(_groups(bucket)).tolist()
            blobs, places = [], []
            for a, b in zip(at, [*at[1:], len(sent)], strict=True):
                own = sent[a:b]
                blobs.append(anchor[own].tobytes() + run[own].tobytes())
                places.append(_pack([doc[own], key[own], start[own], size[own]], compressor))
            rows = [(int(bucket[a]), x, y, None, None, None) for a, x, y in zip(at, blobs, places, strict=True)]
            rows += [(int((h >> np.uint64(20)) % np.uint64(buckets)), None, None, None, np.array([h]).tobytes(), None) for h in many]
            aside = (int(ids[0]) + number) % buckets if len(ids) else 0
            if len(gone[0]):
                rows.append((aside, None, None, _pack(gone, compressor), None, None))
            if hot.any():
                own = np.flatnonzero(hot)
                rows.append((aside, None, None, None, anchor[own].tobytes() + run[own].tobytes(), _pack([doc[own], key[own], start[own], size[own]], compressor)))
            types = [pa.int64(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    def compared(table: pa.Table) -> pa.Table:
        import zstandard

        decompressor, some = zstandard.ZstdDecompressor(), lambda name: [x for x in table.column(name).to_pylist() if x is not None]
        out = [_found(*_unpack(some("gone"), decompressor))]
        hot_keys = np.zeros(0, np.uint64)
        for blob, places in zip(table.column("hot_keys").to_pylist(), table.column("hot_places").to_pylist(), strict=True):
            if blob is not None and places is None:
                hot_keys = np.r_[hot_keys, np.frombuffer(blob, np.uint64)]
            elif blob is not None:  # runs that a batch has marked as hot itself
                columns = _unpack([places], decompressor)
                n = len(columns[0])
                out.append(_found(*columns, np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.uint64, n, 8 * n), np.ones(n, bool)))
        blobs = some("keys")
        anchor = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 16) for b in blobs]) if blobs else np.zeros(0, np.uint64)
        run = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 16, len(b) // 2) for b in blobs]) if blobs else np.zeros(0, np.uint64)
        doc, key, start, size = _unpack(some("places"), decompressor)
        order = np.lexsort((run, anchor))
        anchor, run, doc, key, start, size = (c[order] for c in (anchor, run, doc, key, start, size))
        if len(doc):
            new_run, new_anchor = _groups(anchor, run), _groups(anchor)
            kept = doc == _least(new_run, doc)
            out.append(_found(doc[~kept], key[~kept], start[~kept], size[~kept]))
            at = np.flatnonzero(new_anchor)
            which = np.cumsum(new_anchor) - 1
            runs = np.add.reduceat(new_run.astype(np.int64), at)
            bytes_ = np.add.reduceat(np.where(kept, size, 0).astype(np.int64), at)
            several = (runs > 1) & (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at))
            too_many = (runs > group_limit) | (bytes_ > 100 * group_limit) | np.isin(anchor[at], hot_keys)
            needed = kept & (several | too_many)[which]
            out.append(_found(*(c[needed] for c in (doc, key, start, size, anchor, run)), (too_many & (several | np.isin(anchor[at], hot_keys)))[which][needed]))
        return pa.concat_tables(out)

    packed = texts.select("doc_id", "text_key", F.col("text").cast("binary")).mapInArrow(collected, "bucket long, keys binary, places binary, gone binary, hot_keys binary, hot_places binary")
    return packed.groupBy("bucket").applyInArrow(compared, FOUND)


def _joined_spans(doc: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of one text that overlap or touch, joined: (doc, key, start, size)."""
    if not len(doc):
        return doc, key, start, size
    order = np.lexsort((start, key, doc))
    doc, key, start = doc[order], key[order], start[order].astype(np.int64)
    end = start + size[order]
    text = np.cumsum(_groups(doc, key)) - 1
    base = text * (int(end.max()) + 2)  # texts do not touch one another
    reach = np.maximum.accumulate(end + base)
    first = np.flatnonzero(np.r_[True, start[1:] + base[1:] > reach[:-1]])
    ends = reach[np.r_[first[1:], len(doc)] - 1] - base[first]
    return doc[first], key[first], start[first], ends - start[first]


# ---------------------------------------------------------------- different runs of one anchor hash


def later_windows(parts: list[bytes], least: list[int], length: int) -> list[tuple[int, int]]:
    """(part, start) of the windows that a part with a smaller ``least`` document has too, read off one suffix array."""
    joined = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(parts)), sizes)
    inside = np.arange(len(joined)) - begins[owner] <= sizes[owner] - length  # a window never reaches into the next part
    order = np.array(suffix_array(joined.tobytes()), np.int64)
    order = order[inside[order]]
    windows = np.lib.stride_tricks.sliding_window_view(joined, length)
    new = np.ones(len(order), bool)
    for at in range(1, len(order), 100_000):
        to = min(len(order), at + 100_000)
        new[at:to] = (windows[order[at:to]] != windows[order[at - 1 : to - 1]]).any(axis=1)
    doc = np.array(least, np.int64)[owner[order]]
    gone = order[doc > _least(new, doc)]
    return list(zip(owner[gone].tolist(), (gone - begins[owner[gone]]).tolist(), strict=True))


def resolve(data: np.ndarray, ends: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs that lie one after the other: (run, start, size) of the stretches that a smaller document has too."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3))
    if len(data) < length:
        return none
    begins = np.r_[0, ends[:-1]]
    owner = np.repeat(np.arange(len(ends)), ends - begins)
    grams = _grams(data)
    hashes = _window_hash(grams, slice(None), length)
    at = np.flatnonzero(owner[: len(hashes)] == owner[length - 1 : length - 1 + len(hashes)])
    order = np.argsort(hashes[at], kind="stable")
    by_hash = at[order]
    new = _groups(hashes[by_hash])
    if not len(new):
        return none
    edge = np.flatnonzero(new)
    owners = doc[owner[by_hash]]
    shared = (np.minimum.reduceat(owners, edge) != np.maximum.reduceat(owners, edge))[np.cumsum(new) - 1]
    spot = np.sort(by_hash[shared])
    if not len(spot):
        return none
    # Stretches of shared windows, in pieces.
    first = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1] + 1) | (owner[spot[1:]] != owner[spot[:-1]])])
    starts, stops = spot[first], spot[np.r_[first[1:], len(spot)] - 1] + length
    count = -(-(stops - starts - length + 1) // _PIECE)
    which = np.repeat(np.arange(len(starts)), count)
    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    start = starts[which] + step * _PIECE
    stop = np.minimum(stops[which], start + _PIECE + length - 1)
    # Equal pieces are one text.
    key = _span_hash(grams, data, start, stop, length)
    order = np.lexsort((doc[owner[start]], key))
    start, stop, key = start[order], stop[order], key[order]
    new = _groups(key, stop - start)
    least = _least(new, doc[owner[start]])
    mine = doc[owner[start]] == least
    found = [(start[~mine], stop[~mine])]
    head = np.flatnonzero(new)
    # Different pieces with a window in common are sorted.
    sizes = stop[head] - start[head] - length + 1
    piece = np.repeat(np.arange(len(head)), sizes)
    inner = hashes[np.repeat(start[head] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    order = np.argsort(inner, kind="stable")
    again = _groups(inner[order])
    group = np.cumsum(again) - 1
    chosen = np.unique(piece[order[np.bincount(group)[group] > 1]])
    if len(chosen) > 1:
        gone = later_windows([data[start[head[i]] : stop[head[i]]].tobytes() for i in chosen.tolist()], least[head[chosen]].tolist(), length)
        if gone:
            part, offset = np.array(gone, np.int64).T
            # A window goes from all places where the smallest document of its piece has the piece.
            rows = np.flatnonzero(mine)
            places = (np.cumsum(new) - 1)[rows]
            a, b = np.searchsorted(places, chosen[part]), np.searchsorted(places, chosen[part], side="right")
            row = rows[np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())]
            spots = start[row] + np.repeat(offset, b - a)
            found.append((spots, spots + length))
    start, stop = (np.concatenate(c) for c in zip(*found, strict=True))
    return owner[start], start - begins[owner[start]], stop - start


def _cut(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """Rows ``(doc_id, text_key, places, text)`` of the texts with needed runs."""
    lists = needed.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "size", "hash")).alias("places"))
    one = docs.join(lists.hint("merge"), ["doc_id", "text_key"])  # repeated rows are equal texts
    return one.select("doc_id", "text_key", "places", F.col("text").cast("binary").alias("text"))


def _wanted(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """For each needed run of a batch of :func:`_cut`: row, start, size, anchor hash; and the bytes of all texts, with their begins."""
    lists = batch.column(2)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    start, size, anchor = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    data, ends = _texts(batch.column(3))
    return row, start, size, anchor, data, np.r_[0, ends[:-1]]


def _sorted_ranges(docs: DataFrame, needed: DataFrame, length: int) -> DataFrame:
    """Rows ``(doc_id, text_key, start, size)``: the different runs of each anchor hash resolved together."""
    total = needed.agg(F.sum("size")).first()[0] or 0
    buckets = max(512, total // 1_000_000)
    names = ["bucket", "places", "bytes"]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=1)
        for batch in _steps(batches):
            row, start, size, anchor, data, begins = _wanted(batch)
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            bucket = ((anchor.view(np.uint64) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            row, start, size, bucket = row[order], start[order], size[order], bucket[order]
            taken = data[np.repeat(begins[row] + start - (np.cumsum(size) - size), size) + np.arange(size.sum())] if len(row) else data[:0]
            cut = np.r_[0, np.cumsum(size)]
            at = np.flatnonzero(_groups(bucket)).tolist()
            rows = []
            for a, b in zip(at, [*at[1:], len(row)], strict=True):
                place = _pack([ids[row[a:b]], keys[row[a:b]], start[a:b], size[a:b]], compressor)
                rows.append((int(bucket[a]), place, compressor.compress(taken[cut[a] : cut[b]].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=names)

    def resolved(table: pa.Table) -> pa.Table:
        import zstandard

        decompressor = zstandard.ZstdDecompressor()
        doc, key, start, size = _unpack(table.column("places").to_pylist(), decompressor)
        data = np.frombuffer(b"".join([decompressor.decompress(x) for x in table.column("bytes").to_pylist()]), np.uint8)
        run, at, n = resolve(data, np.cumsum(size, dtype=np.int64), doc, length)
        doc, key, start, size = _joined_spans(doc[run], key[run], start[run] + at, n)
        return pa.table([pa.array(doc), *(pa.array(c.astype(np.int32)) for c in (key, start, size))], names=["doc_id", "text_key", "start", "size"])

    packed = _cut(docs, needed).mapInArrow(sent, "bucket long, places binary, bytes binary")
    return packed.groupBy("bucket").applyInArrow(resolved, "doc_id long, text_key int, start int, size int")


def _ranges_by_window(docs: DataFrame, needed: DataFrame, length: int) -> DataFrame:
    """The same rows by grouped minima over two hashes of each window, for anchor hashes with very many runs."""
    names = ["one", "two", "doc_id", "text_key", "starts"]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, size, _, data, begins = _wanted(batch)
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for r, s, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True):
                grams = _grams(data[begins[r] + s : begins[r] + s + n])
                one, two = _window_hash(grams, slice(None), length), _window_hash(grams, slice(None), length, 1)
                order = np.lexsort((two, one))
                at = np.flatnonzero(_groups(one[order], two[order]))
                starts = [(o + s).astype(np.int32) for o in np.split(order, at[1:])]
                first = order[at]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[at, len(order)].astype(np.int32)), pa.array(np.concatenate(starts)))
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(one[first].view(np.int64)), pa.array(two[first].view(np.int64)), pa.array(np.full(m, ids[r], np.int64)), pa.array(np.full(m, keys[r], np.int32)), lists], names=names)

    found = _cut(docs, needed).mapInArrow(windows, "one long, two long, doc_id long, text_key int, starts array<int>")
    first = found.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last").select("one", "two", "first")
    later = found.join(first.hint("merge"), ["one", "two"]).filter("doc_id > first")
    return later.select("doc_id", "text_key", F.explode("starts").alias("start"), F.lit(length).alias("size"))


# ---------------------------------------------------------------- the operator


def _kept(spans: DataFrame) -> DataFrame:
    """Rows ``(doc_id, text_key, n_removed, n_spans, starts, sizes)``: joined spans and, in one-based places, what lies between."""
    names = ["doc_id", "text_key", "n_removed", "n_spans", "starts", "sizes"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, offsets = lists.flatten(), lists.offsets.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            start, size = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            row, _, start, size = _joined_spans(row, np.zeros(len(row), np.int64), start, size)
            n = np.bincount(row, minlength=batch.num_rows)
            removed = np.bincount(row, weights=size, minlength=batch.num_rows).astype(np.int64)
            # Before each span lies what is kept since the one before it; the rest of the text follows the last one.
            end = start + size
            head = _groups(row)
            kept_from = np.where(head, 0, np.r_[0, end[:-1]])
            tail = np.flatnonzero(np.r_[head[1:], True]) + 1
            starts, sizes = np.insert(kept_from, tail, end[tail - 1]) + 1, np.insert(start - kept_from, tail, np.iinfo(np.int32).max)
            cut = pa.array(np.r_[0, np.cumsum(n + 1)].astype(np.int32))
            kept = [pa.ListArray.from_arrays(cut, pa.array(c.astype(np.int32))) for c in (starts, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed), pa.array(n.astype(np.int64)), *kept], names=names)

    lists = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    return lists.mapInArrow(joined, "doc_id long, text_key int, n_removed long, n_spans long, starts array<int>, sizes array<int>")


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", group_limit: int = 20_000, batch_limit: int = 256) -> DataFrame:
    """Rows ``(doc_id, n_bytes, n_removed, n_spans, kept)``, one per input row; ``kept`` holds the remaining bytes.

    Ids are whole numbers.  Null texts count as empty.  A row without an id is neither changed nor a source; rows that
    repeat an id are not smaller than one another.  Other columns are not read; an empty table gives no rows.  Texts of any
    length are read whole; a repeated letter or phrase makes one run, and equal pieces of long runs are sorted once.
    """
    if length < GRAM + 2:
        raise ValueError(f"length must be at least {GRAM + 2}")
    work = Workspace(docs.sparkSession, "repeats")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = narrow.withColumn("text_key", F.shiftrightunsigned(F.xxhash64("text"), 33).cast("int"))
    known = keyed.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    found = work.save(compared_runs(known, length, group_limit, batch_limit), "found")
    spans = found.filter("hash IS NULL").select("doc_id", "text_key", "start", "size")
    needed = found.filter("hash IS NOT NULL")
    spans = spans.union(_sorted_ranges(known, needed.filter("NOT hot"), length))
    if needed.filter("hot").take(1):
        spans = spans.union(_ranges_by_window(known, needed.filter("hot"), length))
    kept = work.save(_kept(spans), "kept")
    work.drop("found")
    joined = keyed.join(kept.hint("merge"), ["doc_id", "text_key"], "left")
    data = F.col("text").cast("binary")
    parts = F.zip_with("starts", "sizes", lambda a, n: F.substring(data, a, n).cast("string"))
    rest = F.when(F.col("starts").isNull(), data).otherwise(F.array_join(parts, "").cast("binary"))
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), rest.alias("kept"))
