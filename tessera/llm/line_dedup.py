"""Line deduplication with a log-template tree of fixed depth.

A line's place in the tree is its number of tokens, then its leading ``depth`` tokens; tokens with a digit are variable
fields everywhere.  In a leaf a token is constant at its position if ``min_docs`` documents or more have it there; all
other positions are variable fields too.  Lines of a leaf with the same constants at the same positions share a template.
A template recurs if ``min_docs`` different documents or more hold it and at least ``min_constant`` of its positions after
the leading ones are constant (of all positions where a line has no others).
With ``min_share`` a token must also be in that share of the leaf's documents, so that fields whose values recur are
variable at every size of the corpus; only a line whose template then does not recur is judged by counts alone.
Lines of recurring templates are dropped from every document but the first (the smallest id), which keeps them.

Lines travel as two 64-bit hashes, of the leaf and of the whole line.  Only where a leaf has enough lines are the tokens of
its different lines made, as 64-bit hashes, from one document that holds the line.  Equal lines are counted before anything
is compared in a leaf, and a leaf with more than ``leaf_rows`` different lines is resolved by grouped counts over (leaf,
position, token) in place of one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Workspace
from ..workers import lean
from .pii import fresh

#: ``min_share`` of the registered query and the pipeline.
SHARE = 0.2
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Parts of a leaf's lines where they are compared across tasks.
PARTS = 32
#: Texts that are split at once: their tokens take several times the texts' bytes.
_STEP = 500


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    h = (a ^ (b * _M1)) * _M2
    h ^= h >> np.uint64(32)
    h *= _M1
    h ^= h >> np.uint64(29)
    return h


def split_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the texts: text, line number in it, and the ends of its tokens; and the tokens as 64-bit numbers.

    Tokens are what white space separates; a token with a decimal digit is a variable field and has number 0.
    """
    import xxhash

    lines = pc.split_pattern(texts.fill_null(""), "\n")
    per_text = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), per_text)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    words = pc.utf8_split_whitespace(lines.flatten())
    flat, offsets = words.flatten(), words.offsets.to_numpy() - words.offsets[0].as_py()
    encoded = flat.dictionary_encode()
    different = encoded.dictionary
    numbers = np.array([xxhash.xxh3_64_intdigest(w) for w in different.cast(pa.binary()).to_pylist()], np.uint64)
    numbers[numbers == 0] = 1
    numbers[pc.match_substring_regex(different, r"\p{Nd}").to_numpy(zero_copy_only=False).astype(bool)] = 0
    index = encoded.indices.to_numpy(zero_copy_only=False)
    # White space at the ends of a line leaves empty strings, which are no tokens.
    empty = pc.equal(different, "").to_numpy(zero_copy_only=False).astype(bool)[index] if len(index) else np.zeros(0, bool)
    ends = offsets[1:] - np.r_[0, np.cumsum(empty)][offsets[1:]]
    return text, number, ends, numbers[index[~empty]] if len(index) else np.zeros(0, np.uint64)


def line_hashes(ends: np.ndarray, tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of each line and a key that equal lines share, variable fields apart."""
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    size = ends - begins
    leaf = _mix(size.astype(np.uint64), np.uint64(1))
    for p in range(depth):
        has = np.flatnonzero(size > p)
        leaf[has] = _mix(leaf[has], tokens[begins[has] + p] + np.uint64(p))
    at = np.arange(len(tokens)) - np.repeat(begins, size)
    each = np.r_[np.zeros(1, np.uint64), np.cumsum(_mix(tokens, at.astype(np.uint64) + np.uint64(7)), dtype=np.uint64)]
    return leaf, _mix(each[ends] - each[begins], leaf)


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """Rows ``(doc_id, text_key, line, leaf, key)`` of all lines with tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_key", "line", "leaf", "key"]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _STEP):
                batch = whole.slice(first, _STEP)
                text, number, ends, tokens = split_lines(batch.column(2))
                leaf, key = line_hashes(ends, tokens, depth)
                own = np.flatnonzero(np.diff(ends, prepend=0))
                row = pa.array(text[own])
                columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(number[own].astype(np.int32)), pa.array(leaf[own].view(np.int64)), pa.array(key[own].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text_key", "text").mapInArrow(lean(parsed), f"doc_id {kind}, text_key long, line int, leaf long, key long")


def _tokens(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows ``(leaf, key, n, tokens)`` for lines ``(leaf, key, n, doc_id, text_key, line)``."""
    names = ["leaf", "key", "n", "tokens"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _STEP):
                batch = whole.slice(first, _STEP)
                text, number, ends, tokens = split_lines(batch.column(0))
                lists = batch.column(1)
                flat, offsets = lists.flatten(), lists.offsets.to_numpy()
                line, leaf, key, n = (flat.field(k) for k in range(4))
                at = np.searchsorted(text, np.repeat(np.arange(batch.num_rows), np.diff(offsets))) + line.to_numpy()
                begins = np.r_[0, ends[:-1]][at]
                size = ends[at] - begins
                taken = tokens[np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(taken.view(np.int64)))
                yield pa.RecordBatch.from_arrays([leaf, key, n, found], names=names)

    lists = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("line", "leaf", "key", "n")).alias("lines"))
    joined = docs.join(lists.hint("merge"), ["doc_id", "text_key"]).select("text", "lines")
    return joined.mapInArrow(lean(made), "leaf long, key long, n long, tokens array<long>").dropDuplicates(["leaf", "key"])  # rows that repeat a text


def templates_of(tokens: np.ndarray, docs: np.ndarray, depth: int, min_docs: float) -> np.ndarray:
    """The templates of one leaf's lines (rows of equal length): constants, and 0 at variable fields."""
    out = tokens.copy()
    for p in range(tokens.shape[1]):
        if p >= depth:
            _, which = np.unique(tokens[:, p], return_inverse=True)
            out[np.bincount(which, weights=docs)[which] < min_docs, p] = 0
    return out


def _in_leaf(lines: DataFrame, depth: int, min_docs: int, min_share: float) -> DataFrame:
    """Rows ``(leaf, key, level, template, constant)``, level 0 by shares, level 1 by counts: each leaf in one task.  No document may have two lines of a leaf."""
    import xxhash

    names = ["leaf", "key", "level", "template", "constant"]

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # the batches of the last leaf, which may go on
        for batch in batches:
            leaf = batch.column(batch.schema.get_field_index("leaf")).to_numpy()
            if not len(leaf):
                continue
            last = rest[-1].column(rest[-1].schema.get_field_index("leaf"))[-1].as_py() if rest else leaf[-1]
            if leaf[0] == last == leaf[-1]:
                rest.append(batch)
                continue
            cut = int(np.searchsorted(leaf, leaf[-1]))
            yield from leaves(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
            rest = [batch.slice(cut)]
        if rest:
            yield from leaves(pa.Table.from_batches(rest))

    def leaves(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        leaf, n = table.column("leaf").to_numpy(), table.column("n").to_numpy()
        column = table.column("tokens").combine_chunks()
        column = column if isinstance(column, pa.ListArray) else column.chunk(0)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        ends = column.offsets.to_numpy() - column.offsets[0].as_py()
        begin = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        at, level, template, constant = [], [], [], []
        for a, b in zip(begin, np.r_[begin[1:], len(leaf)], strict=True):
            least = min_share * n[a:b].sum()
            for k, docs in enumerate([least, min_docs] if least > min_docs else [min_docs]):
                rows = templates_of(flat[ends[a] : ends[b]].reshape(b - a, -1), n[a:b], depth, docs)
                at.extend(range(a, b))
                level.extend([k] * (b - a))
                template.extend(xxhash.xxh3_64_intdigest(r.tobytes()) - (1 << 63) for r in rows)
                # The leading tokens are the leaf's own and show nothing, unless the line has no others.
                constant.extend((rows[:, depth if rows.shape[1] > depth else 0 :] != 0).mean(axis=1).tolist())
        at = np.array(at, np.int64)
        arrays = [pa.array(leaf[at]), pa.array(table.column("key").to_numpy()[at]), pa.array(level, pa.int32()), pa.array(template, pa.int64()), pa.array(constant, pa.float64())]
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    return lines.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(lean(resolved), "leaf long, key long, level int, template long, constant double")


def _across_tasks(lines: DataFrame, held: DataFrame, crowded: DataFrame, depth: int, min_docs: int, min_share: float) -> DataFrame:
    """The same rows by grouped counts, for leaves too large for one task or with ``crowded`` documents.

    A document counts once for a token at a position, so what its further lines of the leaf add is taken off.
    """
    # Position -1 stands for the whole line: its documents are those of the leaf.
    tokens = lines.select("leaf", "key", "n", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "tokens")).alias("p", "token")).withColumn("p", F.col("p") - 1)
    twice = held.join(crowded.hint("merge"), ["doc_id", "leaf"]).join(tokens.hint("merge"), ["leaf", "key"]).groupBy("doc_id", "leaf", "p", "token").agg((1 - F.count("*")).alias("n"))
    counts = tokens.select("leaf", "p", "token", "n").unionByName(twice.select("leaf", "p", "token", "n").filter("n < 0")).groupBy("leaf", "p", "token").agg(F.sum("n").alias("docs"))
    # One leaf, or one token of it, may have most of the lines: its one row is there for each part of them.
    every, part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")
    least = counts.filter("p < 0").select("leaf", (F.col("docs") * min_share).alias("least"), every)
    frequent = counts.filter((F.col("p") >= 0) & (F.col("docs") >= min_docs)).select("*", every)
    marked = tokens.filter("p >= 0").withColumn("part", part).join(frequent.hint("merge"), ["leaf", "part", "p", "token"], "left").join(least.hint("merge"), ["leaf", "part"])
    levels = F.when(F.col("least") > min_docs, F.array("least", F.lit(float(min_docs)))).otherwise(F.array(F.lit(float(min_docs))))
    marked = marked.select("leaf", "key", "p", "token", "docs", F.posexplode(levels).alias("level", "needed"))
    fixed = ((F.col("p") < depth) | F.coalesce(F.col("docs") >= F.col("needed"), F.lit(False))) & (F.col("token") != 0)
    marked = marked.withColumn("c", F.when(fixed, F.col("token")).otherwise(F.lit(None)))
    made = marked.groupBy("leaf", "key", "level").agg(F.sort_array(F.collect_list(F.struct("p", "c"))).alias("t"))
    own = F.filter("t", lambda x: (x["p"] >= depth) | (F.size("t") <= depth))
    return made.select("leaf", "key", "level", F.xxhash64("t").alias("template"), (F.size(F.filter(own, lambda x: x["c"].isNotNull())) / F.size(own)).alias("constant"))


def recurring_lines(docs: DataFrame, work: Workspace, depth: int = 3, min_docs: int = 5, min_constant: float = 0.5, leaf_rows: int = 1000, min_share: float = 0.0) -> DataFrame:
    """Rows ``(doc_id, text_key, gone)``: which lines each text loses, up to its last one.  ``docs`` has ``doc_id``, ``text_key``, ``text``."""
    known = docs.filter("doc_id IS NOT NULL")
    lines = work.save(_lines(known, depth), "lines")
    # Most leaves hold too few lines.  The tables of leaves, lines and lists grow with the corpus: none is broadcast.
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("rows")).filter(F.col("rows") >= min_docs).select("leaf")
    kept = lines.join(leaves.hint("merge"), "leaf", "left_semi")
    held = work.save(kept.groupBy("doc_id", "leaf", "key").agg(F.collect_list(F.struct("text_key", "line")).alias("at")), "held")
    work.drop("lines")
    different = held.groupBy("leaf", "key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", F.array_min("at").alias("at"))).alias("ref"))
    counted = work.save(_tokens(known, different.select("leaf", "key", "n", "ref.doc_id", "ref.at.text_key", "ref.at.line")), "counted")
    crowded = work.save(held.groupBy("doc_id", "leaf").agg(F.count("*").alias("lines")).filter("lines > 1").select("doc_id", "leaf"), "crowded")
    large = counted.groupBy("leaf").agg(F.count("*").alias("rows")).filter(F.col("rows") > leaf_rows).select("leaf")
    hot = work.save(large.union(crowded.select("leaf")).distinct(), "hot")
    placed = _in_leaf(counted.join(hot.hint("merge"), "leaf", "left_anti"), depth, min_docs, min_share)
    if hot.take(1):
        placed = placed.unionByName(_across_tasks(counted.join(hot.hint("merge"), "leaf", "left_semi"), held.select("doc_id", "leaf", "key"), crowded, depth, min_docs, min_share))
    placed = work.save(placed.filter(F.col("constant") >= min_constant), "placed")
    owned = held.join(placed.hint("merge"), ["leaf", "key"]).select("doc_id", "leaf", "level", "template").distinct()
    templates = owned.groupBy("leaf", "level", "template").agg(F.count("*").alias("docs"), F.min("doc_id").alias("keeper")).filter(F.col("docs") >= min_docs)
    dropped = placed.join(templates.hint("merge"), ["leaf", "level", "template"]).groupBy("leaf", "key").agg(F.min_by("keeper", "level").alias("keeper"))
    lost = held.join(dropped.hint("merge"), ["leaf", "key"]).filter("doc_id <> keeper").select("doc_id", F.explode("at").alias("at"))
    marked = _marks(lost.groupBy("doc_id", "at.text_key").agg(F.collect_list("at.line").alias("lines")))
    found = work.save(marked, "lost")
    work.drop("held", "counted", "crowded", "hot", "placed")
    return found


def _marks(lost: DataFrame) -> DataFrame:
    """Lists of line numbers as lists of truth values."""
    names = ["doc_id", "text_key", "gone"]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = batch.column(2).flatten().to_numpy(), batch.column(2).offsets.to_numpy()
            sizes = np.maximum.reduceat(flat, offsets[:-1]).astype(np.int64) + 1 if batch.num_rows else np.zeros(0, np.int64)
            ends = np.cumsum(sizes)
            gone = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
            gone[np.repeat(ends - sizes, np.diff(offsets)) + flat] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(gone))], names=names)

    kind = lost.schema["doc_id"].dataType.simpleString()
    return lost.mapInArrow(lean(marked), f"doc_id {kind}, text_key long, gone array<boolean>")


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, min_docs: int = 5, min_constant: float = 0.5, leaf_rows: int = 1000, counts: tuple[str, str] | None = None, min_share: float = 0.0) -> DataFrame:
    """All rows and columns of ``docs``, texts without the lines of recurring templates.

    ``counts`` names two extra columns for the numbers of lines before and of lines dropped.  Null texts stay null, rows
    without an id stay as they are and count for nothing; rows that repeat an id are one document.  Blank lines stay.  An
    empty table gives no rows; other columns may have any names.
    """
    work, names = Workspace(docs.sparkSession, "lines"), docs.columns
    key, gone = fresh("text_key", names), fresh("gone", names)
    text_key = F.xxhash64(F.col(text_col).cast("string"))
    lost = recurring_lines(docs.select(F.col(id_col).alias("doc_id"), text_key.alias("text_key"), F.col(text_col).cast("string").alias("text")), work, depth, min_docs, min_constant, leaf_rows, min_share)
    joined = docs.withColumn(key, text_key).join(lost.toDF(id_col, key, gone).hint("merge"), [id_col, key], "left")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda line, i: ~F.coalesce(F.get(F.col(gone), i), F.lit(False)))
    cut = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    extra = []
    if counts:
        n_lines = F.when(F.length(text_col) > 0, F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1).otherwise(0)
        dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(F.filter(gone, lambda x: x)))
        extra = [n_lines.cast("long").alias(counts[0]), dropped.cast("long").alias(counts[1])]
    return joined.select(*[cut.alias(c) if c == text_col else F.col(c) for c in names], *extra)


def digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows ``(doc_id, n_lines, n_dropped, kept_sha256)`` of :func:`drop_recurring`, one per input row; null and empty texts
    have no lines; null and repeated ids come back as they are; other columns are not read."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = drop_recurring(narrow, counts=("n_lines", "n_dropped"), **options)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
