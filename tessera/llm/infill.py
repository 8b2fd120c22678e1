"""Fill-in-the-middle transformation by a parallel automaton scan.

A text is read as UTF-8 bytes by a small automaton that knows whether it stands inside of a word and how much of a sentinel
(``<P>``, ``<S>``, ``<M>``) it has just seen.  A chunk of bytes is summed up by its function: for every state in which the chunk may
be entered, the state in which it is left and the numbers of tokens and sentinels that begin or end in it.  Functions compose
associatively, so chunks are scanned in any order and by any task; composing them in the order of the text gives every chunk's
entry state and the tokens before it, and a cut after ``k`` tokens then lies in one known chunk, which alone is read again.

Short texts are one chunk and are cut where they are read.  Giant ones are dealt out in chunks: one pass for the functions, one
composition per document over its summaries, one selection of the two chunks with cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import Workspace

#: States: outside of a word, inside, after ``<``, after ``<`` and a sentinel's letter.
OUTSIDE, INSIDE, OPENED, LETTERED = range(4)
STATES = 4
CHUNK_BYTES = 1 << 15
#: Texts of more bytes are dealt out in chunks.
GIANT_BYTES = 1 << 16
PSM, SPM, PLAIN = "psm", "spm", "plain"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, tokens that begin, sentinels that end) by state and byte."""
    code = np.arange(256)
    letter = ((code | 32) >= ord("a")) & ((code | 32) <= ord("z"))
    inner = (code & 0xC0) == 0x80  # bytes that continue a code point
    step = np.where(letter, INSIDE, OUTSIDE)[None].repeat(STATES, axis=0)
    step[:, ord("<")] = OPENED
    step[OPENED, [ord(c) for c in "PSM"]] = LETTERED
    begins = np.where(inner, 0, 1)[None].repeat(STATES, axis=0)
    begins[INSIDE, letter] = begins[LETTERED, letter] = 0
    ends = np.zeros((STATES, 256), np.int64)
    ends[LETTERED, ord(">")] = 1
    return step, begins, ends


NEXT, BEGINS, ENDS = _tables()
_LETTER, _INNER = NEXT[OUTSIDE] == INSIDE, (np.arange(256) & 0xC0) == 0x80
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "PSM"]] = True
#: Bytes after which the state no longer depends on the entry state.
MEMORY = 2


def token_starts(data: np.ndarray, entry: int) -> np.ndarray:
    """Where tokens begin in a chunk that is entered in state ``entry``."""
    if not len(data):
        return np.zeros(0, np.int64)
    word = _LETTER[data]
    begins = ~_INNER[data]
    begins[1:] &= ~(word[1:] & word[:-1])
    begins[0] = BEGINS[entry, data[0]]
    return np.flatnonzero(begins)


def summary(data: np.ndarray) -> list[int]:
    """A chunk's function as one list: exit states, tokens and sentinels by entry state, then its bytes and code points."""
    state, tokens, found = np.arange(STATES), np.zeros(STATES, np.int64), np.zeros(STATES, np.int64)
    for byte in data[:MEMORY].tolist():
        tokens, found, state = tokens + BEGINS[state, byte], found + ENDS[state, byte], NEXT[state, byte]
    if len(data) > MEMORY:
        word = _LETTER[data[1:]]
        tokens = tokens + int(np.count_nonzero(~_INNER[data[MEMORY:]])) - int(np.count_nonzero(word[1:] & word[:-1]))
        found = found + int(np.count_nonzero((data[:-2] == ord("<")) & _MARK[data[1:-1]] & (data[2:] == ord(">"))))
        state = np.arange(STATES)
        for byte in data[-MEMORY:].tolist():
            state = NEXT[state, byte]
    return [*state.tolist(), *tokens.tolist(), *found.tolist(), len(data), int(np.count_nonzero(~_INNER[data]))]


def compose(one: list[int], two: list[int]) -> list[int]:
    """The function of two chunks in a row; associative."""
    leave = [two[one[s]] for s in range(STATES)]
    counts = [one[k * STATES + s] + two[k * STATES + one[s]] for k in (1, 2) for s in range(STATES)]
    return [*leave, *counts, one[-2] + two[-2], one[-1] + two[-1]]


def entries(functions: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """(entry state, tokens, bytes, code points before) of each chunk of a text, and of its end, by an inclusive scan of the
    functions in pairs (each level halves the number of functions)."""

    def scan(own: list[list[int]]) -> list[list[int]]:
        if len(own) < 2:
            return own
        pairs = scan([compose(a, b) for a, b in zip(own[::2], own[1::2], strict=False)])
        return [own[0] if i == 0 else pairs[i // 2] if i % 2 else compose(pairs[i // 2 - 1], own[i]) for i in range(len(own))]

    return [(OUTSIDE, 0, 0, 0)] + [(f[OUTSIDE], f[STATES + OUTSIDE], f[-2], f[-1]) for f in scan(functions)]


def dealt_numbers(doc_id: Column) -> list[Column]:
    """h1 to h4 of a document; a null id counts as the text ``null``."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


_CUT = "n long, found long, first_byte long, second_byte long, first_char long, second_char long"


def _cut_here(data: np.ndarray, h1: int, h2: int) -> tuple[int, ...]:
    """n, sentinels, and both cuts in bytes and code points, of a text that is one chunk."""
    starts = token_starts(data, OUTSIDE)
    n, found = len(starts), summary(data)[2 * STATES + OUTSIDE]
    places = np.append(starts, len(data))
    low, high = sorted((int(places[h1 % (n + 1)]), int(places[h2 % (n + 1)])))
    chars = [int(np.count_nonzero(~_INNER[data[a:b]])) for a, b in ((0, low), (low, high))]
    return n, found, low, high, chars[0], sum(chars)


def _short_cuts(rows: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _CUT.split(", ")]
        for batch in batches:
            h1, h2 = (batch.column(batch.schema.get_field_index(h)).to_pylist() for h in ("h1", "h2"))
            data = batch.column(batch.schema.get_field_index("data"))
            out = np.array([_cut_here(np.frombuffer(d.as_buffer(), np.uint8), a, b) for d, a, b in zip(data, h1, h2, strict=True)], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in out.T)], names=[*batch.schema.names, *names])

    return rows.mapInArrow(cut, _schema(rows) + ", " + _CUT)


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def _dealt(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunks ``(key, chunk, piece)`` of rows ``(key, data)``, one batch for each chunk, so that a task holds few at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                view = memoryview(data.as_buffer())
                for i in range(-(-len(view) // chunk_bytes)):
                    piece = pa.array([bytes(view[i * chunk_bytes : (i + 1) * chunk_bytes])], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.string()), pa.array([i], pa.int32()), piece], names=["key", "chunk", "piece"])

    return rows.mapInArrow(cut, "key string, chunk int, piece binary").repartition("key", "chunk")


def _giant_cuts(work: Workspace, rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """``key`` and the columns of ``_CUT`` for each giant text, by chunks."""
    chunks = work.save(_dealt(rows.select("key", "data"), chunk_bytes), "chunks")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [summary(np.frombuffer(d.as_buffer(), np.uint8)) for d in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int64()))], names=["key", "chunk", "f"])

    functions = chunks.mapInArrow(summed, "key string, chunk int, f array<long>")

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a document's functions, in the order of its chunks: the totals and the chunks of both cuts."""
        kind = pa.struct({"chunk": pa.int32(), "entry": pa.int32(), "nth": pa.int64(), "bytes": pa.int64(), "chars": pa.int64()})
        for batch in batches:
            out = []
            for key, own, h1, h2 in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = [f["f"] for f in own]
                before = entries(own)
                n, total = before[-1][1], before[-1]
                found = sum(f[2 * STATES + e[0]] for f, e in zip(own, before, strict=False))
                tokens = np.array([e[1] for e in before])
                cuts = []
                for k in sorted((h1 % (n + 1), h2 % (n + 1))):
                    at = int(np.searchsorted(tokens, k, side="right")) - 1  # the last chunk that k tokens or fewer precede
                    if k == n:
                        cuts.append({"chunk": None, "entry": 0, "nth": 0, "bytes": total[2], "chars": total[3]})
                    else:
                        cuts.append({"chunk": at, "entry": before[at][0], "nth": k - before[at][1], "bytes": before[at][2], "chars": before[at][3]})
                out.append((key, n, found, *cuts))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), kind, kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "n", "found", "one", "two"])

    # A text of at most 2 GB has 65,536 chunks at most, so a document's summaries are bounded.
    gathered = functions.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "f"))).alias("own"))
    spot = "struct<chunk: int, entry: int, nth: bigint, bytes: bigint, chars: bigint>"
    targets = gathered.join(rows.select("key", "h1", "h2"), "key").mapInArrow(resolved, f"key string, n long, found long, one {spot}, two {spot}")
    targets = work.save(targets, "targets")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, spots in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = np.frombuffer(data.as_buffer(), np.uint8)
                for s in spots:
                    at = int(token_starts(data, s["entry"])[s["nth"]])
                    out.append((s["side"], s["bytes"] + at, s["chars"] + int(np.count_nonzero(~_INNER[data[:at]]))))
            counts = [len(s) for s in batch.column(2).to_pylist()]
            side, byte, char = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [])
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(side, pa.int32()), pa.array(byte, pa.int64()), pa.array(char, pa.int64())], names=["key", "side", "byte", "char"])

    both = F.array(*(F.struct(F.lit(i).alias("side"), f"{c}.*") for i, c in enumerate(("one", "two"))))
    asked = targets.select("key", F.explode(both).alias("spot"))
    within = asked.filter("spot.chunk IS NOT NULL").groupBy("key", F.col("spot.chunk").alias("chunk")).agg(F.collect_list("spot").alias("spots"))
    found = chunks.join(within, ["key", "chunk"]).select("key", "piece", "spots").mapInArrow(placed, "key string, side int, byte long, char long")
    ends = asked.filter("spot.chunk IS NULL").select("key", "spot.side", F.col("spot.bytes").alias("byte"), F.col("spot.chars").alias("char"))
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    places = found.unionByName(ends).groupBy("key").agg(pick(0, "byte").alias("first_byte"), pick(1, "byte").alias("second_byte"), pick(0, "char").alias("first_char"), pick(1, "char").alias("second_char"))
    return targets.select("key", "n", "found").join(places, "key")


def rearranged(rows: DataFrame, plain_percent: int, spm_percent: int) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` from rows with data, cuts and h3, h4."""
    plain = (F.length("data") == 0) | (F.col("found") > 0) | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, PLAIN).when(F.col("h4") % 100 < spm_percent, SPM).otherwise(PSM)
    cut = lambda a, b: F.substring(F.col("data"), a + 1, b - a)
    low, high = F.col("first_byte").cast("int"), F.col("second_byte").cast("int")
    prefix, middle, suffix = cut(F.lit(0), low), cut(low, high), cut(high, F.length("data"))
    mark = lambda s: F.lit(s).cast("binary")
    output = (
        F.when(F.col("form") == PLAIN, F.col("data"))
        .when(F.col("form") == PSM, F.concat(mark("<P>"), prefix, mark("<S>"), suffix, mark("<M>"), middle))
        .otherwise(F.concat(mark("<S>"), suffix, mark("<P>"), prefix, mark("<M>"), middle))
    )
    moved = F.col("form") != PLAIN
    return rows.withColumn("form", form).select(
        "doc_id", "n", "form",
        F.when(moved, F.col("first_char")).alias("prefix_chars"),
        F.when(moved, F.col("second_char") - F.col("first_char")).alias("middle_chars"),
        output.cast("string").alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.  The text holds no sentinel where the form is not plain, so the first place of each
    one behind the one before is its own."""
    one = F.when(form == PSM, F.lit("<S>")).otherwise(F.lit("<P>"))
    rest = F.substr(output, F.lit(4))
    first = F.substr(rest, F.lit(1), F.instr(rest, one) - 1)
    behind = F.substr(rest, F.instr(rest, one) + 3)
    second = F.substr(behind, F.lit(1), F.instr(behind, F.lit("<M>")) - 1)
    middle = F.substr(behind, F.instr(behind, F.lit("<M>")) + 3)
    return F.when(form == PLAIN, output).when(form == PSM, F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def fill_in_middle(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, giant_bytes: int = GIANT_BYTES) -> DataFrame:
    """Rows ``(doc_id, n, form, prefix_chars, middle_chars, output)``, one per row of ``docs``.

    Tokens are runs of A-Z and a-z, and every other code point alone.  A text is cut after two numbers of tokens that its id
    deals (see :func:`dealt_numbers`) and put together as ``<P>prefix<S>suffix<M>middle`` (psm) or
    ``<S>suffix<P>prefix<M>middle`` (spm).  It stays as it is (plain; the character counts are null) if it is empty, holds a
    sentinel, or its id says so.  Null texts are empty; a null id is dealt the numbers of the text ``null``; repeated rows each
    come back; an empty table gives no rows; other columns are not read.  Texts of over ``giant_bytes`` bytes are scanned in
    chunks of ``chunk_bytes`` by many tasks; what is kept for a text besides itself is one short list for each chunk.
    """
    work = Workspace(docs.sparkSession, "infill")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.cast("binary").alias("data"), *dealt_numbers(F.col(id_col)))
    short = _short_cuts(rows.filter(F.octet_length("data") <= giant_bytes))
    # Rows of one id and text are cut alike, so they share a key.
    giant = rows.filter(F.octet_length("data") > giant_bytes).withColumn("key", F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("data", 256)))
    giant = work.save(giant, "giant")
    cuts = _giant_cuts(work, giant.dropDuplicates(["key"]), chunk_bytes)
    long = giant.join(cuts, "key").drop("key")
    return rearranged(short.unionByName(long.select(*short.columns)), plain_percent, spm_percent)


def oracle_sql() -> str:
    """The digest columns of the query in DuckDB's SQL."""
    return """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents
), dealt AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM units
), cut AS (
  SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM dealt
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


def digests(docs: DataFrame, **options) -> DataFrame:
    """The columns of :func:`fill_in_middle` with digests of the output and of the text rebuilt from output and form."""
    found = fill_in_middle(docs, **options)
    back = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
