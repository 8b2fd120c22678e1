"""SentencePiece encoding and decoding with a streaming Viterbi search.

The model file gives pieces, scores and the kind of model.  Encoding walks over the text and keeps a backpointer for
each position of a window as long as the longest piece; whenever the paths of all positions in the window run through
one boundary, the ids up to it are final and are handed out.  So memory does not grow with the text.

* unigram models: a position's best path has the largest sum of scores (ties: the longer last piece);
* BPE models: a path is admissible where each two neighbouring pieces are what merging gives for their joined text.
  Every prefix then has exactly one admissible path, the one that merging finds, so the search needs no scores.

A place that no piece of the vocabulary can span, such as the start of a word, is always such a boundary: all paths meet
there whatever stands around it.  The encoder takes these boundaries as commit points in advance and keeps the ids between
two of them, so a part that recurs is searched once, and parts with a common beginning share its search.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Piece kinds of the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model kinds of the public model format.
UNIGRAM, BPE = 1, 2


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else varint(at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """Pieces of a SentencePiece model file with identity normalisation."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True):
        self.pieces, self.kind, self.dummy_prefix = pieces, kind, dummy_prefix
        if any(k == USER_DEFINED for _, _, k in pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.scores = [s for _, s, _ in pieces]
        self.bytes = {p: i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next(i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN)
        self.longest = max(map(len, self.ids), default=1)
        self.lowest = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0  # an unknown character's score
        #: No piece goes on over the start of a word.
        self.cut_at_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, k in pieces]
        #: The longest piece that ends in two given characters; none but single characters end in any others.
        self.reach: dict[str, int] = {}
        for p in self.ids:
            if len(p) > 1:
                self.reach[p[-2:]] = max(self.reach.get(p[-2:], 0), len(p))
        self._pairs: dict[int, bool] = {}
        self._edges: dict[int, tuple | None] = {}
        # States of a search that reads character by character, made as they are met: see _follow.
        self._starts = {p[:i] for p in self.ids for i in range(1, len(p) + 1)}
        self._lengths = [len(p) for p, _, _ in pieces]
        self._states, self._state_text, self._go, self._longest = {"": 0}, [""], [{}], [-1]
        self._shorter: dict[int, int] = {}

    @classmethod
    def load(cls, path: str) -> Model:
        import struct

        pieces, kind, dummy, extra, name = [], UNIGRAM, True, True, "identity"
        with open(path, "rb") as file:
            data = file.read()
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                name, dummy, extra = f.get(1, b"").decode(), bool(f.get(3, 1)), bool(f.get(4, 1))
        if name != "identity" or extra:
            raise ValueError("only models with identity normalisation and kept white space are supported")
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return cls(pieces, kind, dummy)

    # ------------------------------------------------------------ admissible neighbours of BPE

    def _merge(self, text: str) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """What merging makes of a text: the parts, and the two halves of each merged part."""
        parts, halves = list(text), {}
        while True:
            best = max(((self.scores[i], -at) for at in range(len(parts) - 1) if (i := self.ids.get(parts[at] + parts[at + 1])) is not None), default=None)
            if best is None:
                return parts, halves
            at = -best[1]
            halves[parts[at] + parts[at + 1]] = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def edges(self, piece: int) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """How merging builds the piece, seen from its left and from its right end; None where it does not build it.

        Each list goes from the outermost character to the piece, every entry with the score of the next entry.
        """
        found = self._edges.get(piece, ())
        if found == ():
            text, found = self.pieces[piece][0], None
            parts, halves = self._merge(text)
            if len(parts) == 1:
                sides = []
                for side in (0, 1):
                    line = [text]
                    while line[-1] in halves:
                        line.append(halves[line[-1]][side])
                    line.reverse()
                    sides.append([(x, self.scores[self.ids[y]]) for x, y in zip(line, line[1:], strict=False)] + [(text, -math.inf)])
                found = sides[0], sides[1]
            self._edges[piece] = found
        return found

    def neighbours(self, left: int, right: int) -> bool:
        """Merging the joined text of two pieces gives the two pieces: no merge across their border comes first."""
        ok = self._pairs.get(left << 32 | right)
        if ok is None:
            if len(self._pairs) > 200_000:
                self._pairs.clear()
            xs, ys, i, j = self.edges(left)[1], self.edges(right)[0], 0, 0
            while True:
                (x, to_x), (y, to_y) = xs[i], ys[j]
                across = self.ids.get(x + y)
                if across is not None and self.scores[across] > to_x and self.scores[across] >= to_y:  # of equals the leftmost is first
                    ok = False
                    break
                if to_x == to_y == -math.inf:
                    ok = True
                    break
                if to_x >= to_y:
                    i += 1
                else:
                    j += 1
            self._pairs[left << 32 | right] = ok
        return ok

    # ------------------------------------------------------------ the search

    def viterbi(self, text: str, widths: list[int] | None = None) -> Iterator[int]:
        """Ids of normalised text, handed out as soon as they are final; -1 - i stands for the unknown character at i.

        The window holds, for each position, where its last piece begins, the piece and the path's score.  ``widths``
        collects the number of positions held whenever paths are followed back.
        """
        longest, ids, scores, bpe, pairs, built, reach = self.longest, self.ids, self.scores, self.kind == BPE, self._pairs, self._edges, self.reach
        done = 0  # all before it is handed out
        begin: dict[int, int] = {}
        last: dict[int, int] = {0: -1}
        total: dict[int, float] = {0: 0.0}
        check = 4 * longest
        for end in range(1, len(text) + 1):
            found, farthest = -1, max(done, end - reach.get(text[end - 2 : end], 1) if end > 1 else 0)
            if bpe:
                for start in range(farthest, end):
                    piece = ids.get(text[start:end])
                    if piece is None or (built[piece] if piece in built else self.edges(piece)) is None:
                        continue
                    before = last.get(start)
                    if before is not None and (before < 0 or (pairs[before << 32 | piece] if before << 32 | piece in pairs else self.neighbours(before, piece))):
                        begin[end], last[end] = start, piece
                        found = piece
                        break
                if found < 0 and text[end - 1] not in ids and end - 1 in last:
                    begin[end], last[end] = end - 1, -1
            else:
                best = None
                for start in range(farthest, end):
                    piece = ids.get(text[start:end])
                    if piece is not None and start in total and (best is None or total[start] + scores[piece] > best):
                        best, begin[end], last[end] = total[start] + scores[piece], start, piece
                if end - 1 in total and text[end - 1] not in ids and (best is None or total[end - 1] + self.lowest > best):
                    best, begin[end], last[end] = total[end - 1] + self.lowest, end - 1, -1
                if best is not None:
                    total[end] = best
            if end - done >= check and end < len(text):
                # Follow the paths of all positions in the window down to where they meet.
                if widths is not None:
                    widths.append(len(last))
                paths = {p for p in range(max(done, end - longest + 1), end + 1) if p in last}
                while len(paths) > 1:
                    top = max(paths)
                    paths.remove(top)
                    paths.add(begin.get(top, done))
                common = paths.pop()
                if common > done:
                    yield from self._path(begin, last, done, common)
                    for p in range(done, common):
                        begin.pop(p, None), last.pop(p, None), total.pop(p, None)
                    done = common
                check = end - done + 4 * longest if end - done > 2 * longest else 4 * longest
        yield from self._path(begin, last, done, len(text))

    @staticmethod
    def _path(begin: dict[int, int], last: dict[int, int], start: int, end: int) -> list[int]:
        path = []
        while end > start:
            path.append((begin[end], last[end]))
            end = begin[end]
        return [piece if piece >= 0 else -1 - at for at, piece in reversed(path)]

    def ids_of(self, text: str) -> list[int]:
        """Final ids of normalised text."""
        return self._with_unknown(self.viterbi(text), text)

    def _follow(self, state: int, char: str) -> int:
        """The state after a character: the longest end of what was read that begins a piece."""
        text = self._state_text[state] + char
        while text and text not in self._starts:
            text = text[1:]
        found = self._states.get(text)
        if found is None:
            found = self._states[text] = len(self._state_text)
            self._state_text.append(text)
            self._go.append({})
            self._longest.append(self._built_end(text))
        self._go[state][char] = found
        return found

    def _built_end(self, text: str) -> int:
        """The longest piece that ends the text and that merging builds; -1 if none does."""
        for at in range(len(text)):
            piece = self.ids.get(text[at:])
            if piece is not None and self.edges(piece) is not None:
                return piece
        return -1

    def ids_of_sorted(self, parts: list[str]) -> list[bytes]:
        """Packed final ids of short parts in sorted order, of a BPE model.

        The pieces that end at a position follow from one another, the longest first; the search of a part goes on from the
        backpointers of what it has in common with the part before.
        """
        go, longest, shorter, pairs, lengths = self._go, self._longest, self._shorter, self._pairs, self._lengths
        size = max(map(len, parts), default=0) + 1
        begin, last, states = [0] * size, [-2] * size, [0] * size  # -2: no path, -1: the start or an unknown character
        last[0], before, out = -1, "", []
        for part in parts:
            n, k = len(part), 0
            for x, y in zip(part, before, strict=False):
                if x != y:
                    break
                k += 1
            before, state = part, states[k]
            for end in range(k + 1, n + 1):
                char = part[end - 1]
                state = go[state].get(char)
                if state is None:
                    state = self._follow(states[end - 1], char)
                states[end] = state
                piece = longest[state]
                while piece >= 0:
                    start = end - lengths[piece]
                    left = last[start]
                    if left >= 0:
                        ok = pairs.get(left << 32 | piece)
                        if ok is None:
                            ok = self.neighbours(left, piece)
                        if ok:
                            break
                    elif left == -1:
                        break
                    following = shorter.get(piece)
                    if following is None:
                        following = shorter[piece] = self._built_end(self.pieces[piece][0][1:])
                    piece = following
                if piece >= 0:
                    begin[end], last[end] = start, piece
                else:
                    begin[end], last[end] = end - 1, -1 if last[end - 1] > -2 and char not in self.ids else -2
            path, end = [], n
            while end > 0:
                path.append(last[end] if last[end] >= 0 else -1 - begin[end])
                end = begin[end]
            path.reverse()
            if min(path) < 0:
                path = self._with_unknown(path, part)
            out.append(array("i", path).tobytes())
        return out

    def _with_unknown(self, path: Iterable[int], text: str) -> list[int]:
        """Unknown characters become their UTF-8 bytes, or one unknown id for a row of them."""
        out: list[int] = []
        for piece in path:
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out.extend(self.bytes[f"<0x{b:02X}>"] for b in text[-1 - piece].encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def normalise(self, text: str) -> str:
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class Encoder(dict):
    """Part of a text between two commit points -> packed ids; two generations of at most ``limit`` parts bound the memory.

    Commit points that are known in advance are the start of a word (with the spaces before it) and both sides of a line
    feed, where no piece goes on.
    """

    def __init__(self, model: Model, limit: int = 300_000):
        super().__init__()
        self.model, self.limit, self.old = model, limit, {}
        feed = not any("\n" in p for p in model.ids if len(p) > 1) and bool(model.bytes)
        self.part = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if feed else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def parts(self, text: str) -> list[str]:
        text = self.model.normalise(text)
        return self.part.findall(text) if self.model.cut_at_words else [text] if text else []

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The packed ids of whole texts; parts that are new to all of them are searched together."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        split = [self.parts(text) for text in texts]
        new = {p for p in set().union(*split) if p not in self}
        known = {p for p in new if p in self.old}
        self.update((p, self.old[p]) for p in known)
        new -= known
        short = sorted(p for p in new if len(p) <= 64)
        if self.model.kind == BPE:
            self.update(zip(short, self.model.ids_of_sorted(short), strict=True))
        else:
            self.update((p, self.pack(p)) for p in short)
        long = [p for p in new if len(p) > 64]
        self.update((p, self.pack(p)) for p in long)
        out = [b"".join(map(self.__getitem__, own)) for own in split]
        for p in long:  # they are not met again
            del self[p]
        return out

    def pack(self, text: str) -> bytes:
        return np.array(self.model.ids_of(text), dtype="<i4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(Model.load(path)))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, ids)``, one per input row.  Null and empty texts have no ids; ids and repeated rows stay as they are;
    other columns are not read; an empty table gives no rows."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path)
        for batch in batches:
            packed = encoder.encode_all([x or "" for x in batch.column(1).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encoded, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows ``(doc_id, ids, text)``, one per input row.  A null list gives an empty text; bytes that are not UTF-8 become
    U+FFFD; repeated rows each come back, other columns are not read, an empty table gives no rows."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(model_path).model
        none = np.zeros(0, np.int32)
        for batch in batches:
            column = batch.column(1)
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [model.decode(flat[a:b] if a < b else none) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(decoded, f"doc_id {kind}, ids array<int>, text string")


def digest(ids: list[int], text: str) -> tuple[int, str]:
    """What :func:`round_trip` reports of one document."""
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes()), hashlib.sha256(text.encode()).hexdigest()


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", step: int = 500) -> DataFrame:
    """Encodes every whole text and decodes its ids: ``(doc_id, ids, n_ids, decoded_sha256)``, one row per input row.

    Null and empty texts have no ids; null and repeated ids come back as they are; other columns are not read; an empty
    table gives no rows.  ``step`` rows are held in memory at a time.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                packed = encoder.encode_all([x or "" for x in batch.column(1).to_pylist()])
                sizes = np.array([len(x) // 4 for x in packed], np.int32)
                flat = np.frombuffer(b"".join(packed), dtype="<i4")
                ends = np.r_[0, np.cumsum(sizes, dtype=np.int64)].tolist()
                digests = [hashlib.sha256(encoder.model.decode(flat[a:b]).encode()).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes), pa.array(digests, pa.string())], names=["doc_id", "ids", "n_ids", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(both, f"doc_id {kind}, ids array<int>, n_ids int, decoded_sha256 string")
