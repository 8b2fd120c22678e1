"""Toxicity by compression distance.

Two zstandard dictionaries are trained from labelled texts: one on ordinary text, one on toxic text.  A window that
the toxic dictionary compresses to fewer bytes than the ordinary one is closer to toxic text.  Windows are runs of
``window_words`` words, written twice after a short carrier that both dictionaries know, so that a match pays for itself
and the block overhead of very short inputs cancels.  A document's features are its largest difference and the numbers of its different windows that reach
each of ``CUTS`` bytes; a logistic curve fitted on the labelled texts calibrates them into a score.

Toxic texts are mostly ordinary words: two dictionaries as zstandard trains them on windows of four or six words, also
retrained on the windows that told most, caught 5 to 14 % of the held-out toxic texts of a sample and left 98 % or more of the
others alone.  So the toxic dictionary's content is chosen by contrast: segments that many
toxic texts share and ordinary ones lack, taken greedily until every toxic text is covered ``cover`` times, on top of the
ordinary content.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import kept, lean

SEGMENT_LENGTHS = (4, 5, 6, 7, 8)
CARRIER_BYTES = 24
#: Differences, in bytes, at which windows are counted.
CUTS = (2, 3, 4, 5, 6)


@dataclass(frozen=True)
class Model:
    """Dictionaries, carrier and the logistic weights of :func:`features`."""

    ordinary: bytes
    toxic: bytes
    carrier: bytes
    weights: tuple[float, ...]
    window_words: int = 1


def _compressor(content: bytes):
    import zstandard as z

    params = z.ZstdCompressionParameters(window_log=14, chain_log=12, hash_log=12, search_log=5, min_match=3, target_length=32, strategy=z.STRATEGY_BTULTRA, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
    known = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=params)
    return z.ZstdCompressor(dict_data=known, compression_params=params)


class Distances(dict):
    """Window -> bytes that the toxic dictionary saves; two generations of at most ``limit`` windows bound the memory."""

    def __init__(self, ordinary: bytes, toxic: bytes, carrier: bytes, limit: int = 300_000):
        super().__init__()
        self.a, self.b, self.carrier, self.limit, self.old = _compressor(ordinary).compress, _compressor(toxic).compress, carrier, limit, {}

    def __missing__(self, window: str) -> int:
        saved = self.old.get(window)
        if saved is None:
            data = self.carrier + 2 * (b" " + window.encode("utf-8", "surrogatepass")) + b" "
            saved = len(self.a(data)) - len(self.b(data))
        if len(window) <= 64:
            self[window] = saved
        return saved

    def of(self, text: str, window_words: int) -> list[int]:
        """The savings of the different windows of a whole text."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        words = text.lower().split()
        if window_words > 1:
            words = [" ".join(words[i : i + window_words]) for i in range(max(1, len(words) - window_words + 1))]
        return list(map(self.__getitem__, set(words)))


def _segments(word: str) -> set[str]:
    word = f" {word} "
    return {word[i : i + k] for k in SEGMENT_LENGTHS for i in range(len(word) - k + 1)}


def contrast_segments(toxic: list[str], ordinary: list[str], cover: int = 40, least_share: float = 0.03, odds: float = 20.0) -> list[str]:
    """Segments for the toxic dictionary, the most telling first (greedy cover of the toxic texts).

    Only words that are rare in ordinary texts can hold a telling segment, so no others are cut into segments.
    """
    plain = Counter(w for t in ordinary for w in set(t.lower().split()))
    rare = 0.002 * len(ordinary)
    words = [[w for w in set(t.lower().split()) if plain[w] <= rare] for t in toxic]
    count = Counter(s for own in words for s in {s for w in own for s in _segments(w)})
    least = max(3, 0.004 * len(toxic))
    count = {s: n for s, n in count.items() if n >= least}
    there: Counter[str] = Counter()
    for w, n in plain.items():
        for s in _segments(w):
            if s in count:
                there[s] += n
    telling = {s for s, n in count.items() if n / len(toxic) > odds * (there[s] + 0.25) / (len(ordinary) + 1)}
    here = [{s for w in own for s in _segments(w) if s in telling} for own in words]
    holders: dict[str, set[int]] = defaultdict(set)
    for i, own in enumerate(here):
        for s in own:
            holders[s].add(i)
    left, chosen, open_ = np.full(len(toxic), cover), [], set(telling)
    while open_:
        best = max(open_, key=lambda s: (sum(left[i] > 0 for i in holders[s]), len(s), s))
        if sum(left[i] > 0 for i in holders[best]) < max(3, least_share * len(toxic)):
            break
        # The longest telling text around it that at least half of its holders share.
        whole = max((s for s in telling if best in s and len(holders[s]) >= 0.5 * len(holders[best])), key=lambda s: (len(s), s), default=best)
        chosen.append(whole)
        left[list(holders[best])] -= 1
        open_ = {s for s in open_ if s not in whole and not (len(holders[s] & holders[best]) > 0.8 * len(holders[s]) and any(s[j : j + 3] in whole for j in range(len(s) - 2)))}
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
    return w


def features(saved: list[int]) -> tuple[float, ...]:
    return 1.0, float(max(saved, default=0)), *(math.log1p(sum(s >= c for s in saved)) for c in CUTS), math.log1p(len(saved))


def train(toxic: list[str], ordinary: list[str], toxic_share: float, window_words: int = 1, dictionary_bytes: int = 8192) -> Model | None:
    """A model from labelled texts, or None where a class is missing.  ``toxic_share`` is the classes' true share."""
    import zstandard as z

    if not any(t.strip() for t in toxic) or not any(t.strip() for t in ordinary):
        return None
    lines = [line.encode("utf-8", "surrogatepass") for t in ordinary for line in t.lower().split("\n") if line]
    try:
        content = z.train_dictionary(dictionary_bytes, lines).as_bytes()[-(dictionary_bytes * 7 // 8) :]
    except z.ZstdError:  # too little text to train on
        content = b"\n".join(lines)[-dictionary_bytes:]
    known = content + "".join(reversed(contrast_segments(toxic, ordinary))).encode("utf-8", "surrogatepass") + content[-CARRIER_BYTES:]
    distances = Distances(content, known, content[-CARRIER_BYTES:])
    saved = [distances.of(t, window_words) for t in [*toxic, *ordinary]]
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    weight = np.where(y > 0, toxic_share / len(toxic), (1 - toxic_share) / len(ordinary)) * len(y)
    x = np.array([features(s) for s in saved])
    return Model(content, known, content[-CARRIER_BYTES:], tuple(_logistic(x, y, weight).tolist()), window_words)


def score(text: str, model: Model) -> float:
    distances = kept((model.ordinary, model.toxic), lambda: Distances(model.ordinary, model.toxic, model.carrier))
    x = features(distances.of(text, model.window_words))
    z = sum(w * v for w, v in zip(model.weights, x, strict=True))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 2000, sample_bytes: int = 20_000) -> tuple[Model | None, float]:
    """Trains on ``sample_rows`` labelled rows of each class at most (those with the smallest hashed ids), whose texts have
    ``sample_bytes`` bytes at most; so the rows that reach the driver are bounded in number and size.

    Rows whose crc32 of the id is divisible by 5 are held out and never read here.  An id that is labelled both ways counts as
    unlabelled; of several texts of one id the smallest counts.  The second value is the share of toxic ids among the labels,
    the score of every text where no model can be trained.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").filter(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    usable = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").select("id", "y")
    n, positive = usable.agg(F.count("*"), F.sum("y")).first()
    share = (positive or 0) / n if n else 0.0
    pick = lambda y: usable.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    sample = pick(1).union(pick(0))  # at most twice sample_rows ids, so small enough to send to every executor
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") <= sample_bytes)
    rows = sorted(texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text")).collect())
    return train([t for _, y, t in rows if y == 1], [t for _, y, t in rows if y == 0], share), share


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 2000, out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and ``out``, the toxicity score of the whole text (0 to 1).

    Null texts count as empty; repeated rows each come back; an empty table gives no rows.  Without labels of both classes every
    score is the share of toxic labels.
    """
    model, share = fit(docs, labels, id_col, text_col, label_col, sample_rows)
    at, names = docs.columns.index(text_col), docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [score(x.as_py() or "", model) if model else share for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{out}` double"
    return docs.mapInArrow(lean(scored, keeps=True), schema)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows ``(doc_id, held_out, score, predicted)``, one per input row; a null id is not held out."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else labels
    found = classify(narrow, known, **options)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    from .pii import fresh

    out = fresh("score", docs.columns)
    return classify(docs, labels, id_col, text_col, out=out, **options).filter(F.col(out) < 0.5).select(*docs.columns)
