"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes become short learned vectors; learned filters slide over them; each filter's response is max-pooled over
overlapping chunks that cover the whole text.  A hidden layer reads each chunk's pooled responses, and the largest and mean
hidden values of the chunks are combined into one probability.  A chunk is ``CHUNK`` blocks long and a new one starts every
``STEP`` blocks, so the filters run once over each byte and chunks are maxima over blocks.

Training (Adam, random stretches of the texts, classes in equal parts) runs on a bounded sample of labelled rows; two more
weights then calibrate the output on the whole texts of that sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii import fresh

#: Bytes a filter sees, bytes between two of its places, bytes of a block, blocks of a chunk and between two chunks.
WIDTH, STRIDE, BLOCK, CHUNK, STEP = 8, 2, 64, 4, 2
#: Dimensions of a byte's vector, filters, hidden values.
EMBED, FILTERS, HIDDEN = 8, 32, 16
#: The number that stands for "no byte" behind a text's end.
PAD = 256
#: Blocks that are worked on at once, so that memory does not follow the length of a text.
SLICE = 2048
#: Shift that keeps a text's probability off 0 and 1.
LIMIT = 30.0


@dataclass
class Network:
    """Weights: byte vectors, filters, hidden layer, output over (largest, mean) hidden values, and the calibration."""

    bytes_: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        def normal(*shape: int, fan: int) -> np.ndarray:
            return (rng.standard_normal(shape) * np.sqrt(2 / fan)).astype(np.float32)

        known = normal(PAD + 1, EMBED, fan=EMBED)
        known[PAD] = 0
        zeros = lambda n: np.zeros(n, np.float32)
        return cls(known, normal(WIDTH * EMBED, FILTERS, fan=WIDTH * EMBED), zeros(FILTERS), normal(FILTERS + 1, HIDDEN, fan=FILTERS), zeros(HIDDEN), zeros(2 * HIDDEN + 1))

    def weights(self) -> list[np.ndarray]:
        return [self.bytes_, self.filters, self.filter_bias, self.hidden, self.hidden_bias, self.out]


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes one after another, each text filled up to whole blocks, and the numbers of blocks (one at least) and bytes of each."""
    blocks = np.array([max(1, -(-len(t) // BLOCK)) for t in texts], np.int64)
    data = np.full(int(blocks.sum()) * BLOCK + WIDTH, PAD, np.int16)
    for at, t in zip(np.cumsum(blocks) - blocks, texts, strict=True):
        data[at * BLOCK : at * BLOCK + len(t)] = t
    return data, blocks, np.array([len(t) for t in texts], np.int64)


def _windows(net: Network, data: np.ndarray) -> np.ndarray:
    """(places, WIDTH * EMBED) inputs of the filters; ``data`` goes ``WIDTH - STRIDE`` bytes beyond the last block."""
    vectors = net.bytes_[data]
    places = (len(data) - WIDTH) // STRIDE + 1
    view = np.lib.stride_tricks.as_strided(vectors, (places, WIDTH * EMBED), (STRIDE * EMBED * 4, 4), writeable=False)
    return np.ascontiguousarray(view)


def _stretch(data: np.ndarray, first: int, last: int) -> np.ndarray:
    """The bytes of blocks ``first`` to ``last`` and what a filter at their end sees beyond."""
    return data[first * BLOCK : last * BLOCK + WIDTH - STRIDE]


def block_maxima(net: Network, data: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each block, (blocks, FILTERS).  A filter may look into the next block of its text, but
    never into the next text."""
    n = int(blocks.sum())
    out = np.empty((n, FILTERS), np.float32)
    ends = np.zeros(n, bool)
    ends[np.cumsum(blocks) - 1] = True
    per = BLOCK // STRIDE
    # Places of a text's last block that reach beyond it are no places.
    beyond = np.arange(per) * STRIDE + WIDTH > BLOCK
    for first in range(0, n, SLICE):
        last = min(n, first + SLICE)
        response = (_windows(net, _stretch(data, first, last)) @ net.filters).reshape(last - first, per, FILTERS)
        response[np.flatnonzero(ends[first:last])[:, None], np.flatnonzero(beyond)[None]] = -np.inf
        out[first:last] = response.max(axis=1)
    return np.maximum(out + net.filter_bias, 0)


def chunk_maxima(maxima: np.ndarray, blocks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block maxima pooled over the chunks of each text, with the filled part of the chunk as a last column (few bytes have few
    different responses), and the number of chunks of each text."""
    chunks = np.maximum(1, -(-(blocks - CHUNK) // STEP) + 1)
    text, at, last = _places(blocks, chunks)
    pooled = np.empty((len(text), FILTERS + 1), np.float32)
    pooled[:, :FILTERS] = maxima[at]
    for j in range(1, CHUNK):
        np.maximum(pooled[:, :FILTERS], maxima[np.minimum(at + j, last)], out=pooled[:, :FILTERS])
    start = (at - (np.cumsum(blocks) - blocks)[text]) * BLOCK
    pooled[:, FILTERS] = np.minimum(sizes[text] - start, CHUNK * BLOCK) / (CHUNK * BLOCK)
    return pooled, chunks


def _places(blocks: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each chunk: its text, its first block, and its text's last block."""
    text = np.repeat(np.arange(len(blocks)), chunks)
    first = (np.cumsum(blocks) - blocks)[text]
    return text, first + STEP * (np.arange(len(text)) - (np.cumsum(chunks) - chunks)[text]), first + blocks[text] - 1


def _combine(net: Network, pooled: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden values of the chunks, and each text's inputs of the output: largest and mean hidden values, 1."""
    hidden = np.maximum(pooled @ net.hidden + net.hidden_bias, 0)
    first = np.cumsum(chunks) - chunks
    most = np.maximum.reduceat(hidden, first)
    mean = np.add.reduceat(hidden, first) / chunks[:, None].astype(np.float32)
    return hidden, np.concatenate([most, mean, np.ones((len(chunks), 1), np.float32)], axis=1)


def logits(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """The calibrated output before the logistic curve, for whole texts given as bytes."""
    if not texts:
        return np.zeros(0)
    data, blocks, sizes = padded(texts)
    _, inputs = _combine(net, *chunk_maxima(block_maxima(net, data, blocks), blocks, sizes))
    return net.scale * (inputs @ net.out).astype(np.float64) + net.shift


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -LIMIT, LIMIT)))


def gradients(net: Network, texts: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean logistic loss, in the order of ``Network.weights`` (texts of a few thousand bytes)."""
    data, blocks, sizes = padded(texts)
    n, per = int(blocks.sum()), BLOCK // STRIDE
    data = _stretch(data, 0, n)
    windows = _windows(net, data)
    response = (windows @ net.filters).reshape(n, per, FILTERS)
    beyond = np.flatnonzero(np.arange(per) * STRIDE + WIDTH > BLOCK)
    response[(np.cumsum(blocks) - 1)[:, None], beyond[None]] = -np.inf
    best = response.argmax(axis=1)
    maxima = np.maximum(np.take_along_axis(response, best[:, None], axis=1)[:, 0] + net.filter_bias, 0)
    pooled, chunks = chunk_maxima(maxima, blocks, sizes)
    hidden, inputs = _combine(net, pooled, chunks)
    text, at, last = _places(blocks, chunks)
    first = np.cumsum(chunks) - chunks

    error = ((probability(inputs @ net.out) - y) / len(y)).astype(np.float32)
    g_out = inputs.T @ error
    to_most, to_mean = error[:, None] * net.out[:HIDDEN], error[:, None] * net.out[HIDDEN : 2 * HIDDEN]
    is_most = hidden == inputs[text, :HIDDEN]
    ties = np.add.reduceat(is_most.astype(np.float32), first)
    g_hidden = (is_most * (to_most / ties)[text] + (to_mean / chunks[:, None])[text]) * (hidden > 0)
    g_pooled = (g_hidden @ net.hidden.T)[:, :FILTERS]

    # A chunk's gradient goes to the first of its blocks that holds its maximum.
    g_max, open_ = np.zeros_like(maxima), np.ones_like(g_pooled, dtype=bool)
    for j in range(CHUNK):
        own = np.minimum(at + j, last)
        here = open_ & (maxima[own] == pooled[:, :FILTERS])
        np.add.at(g_max, own, g_pooled * here)
        open_ &= ~here
    g_max *= maxima > 0

    # Only the place of a block's maximum is changed.
    place = (np.arange(n)[:, None] * per + best).ravel()
    filters = np.tile(np.arange(FILTERS), n)
    flow = g_max.ravel()
    live = np.flatnonzero(flow)
    place, filters, flow = place[live], filters[live], flow[live]
    spread = np.zeros((len(windows), FILTERS), np.float32)
    spread[place, filters] = flow
    used = np.unique(place)
    g_filters = windows[used].T @ spread[used]
    g_windows = (spread[used] @ net.filters.T).reshape(len(used), WIDTH, EMBED)
    letters = data[used[:, None] * STRIDE + np.arange(WIDTH)].ravel()
    flat = g_windows.reshape(-1, EMBED)
    g_bytes = np.stack([np.bincount(letters, flat[:, e], PAD + 1) for e in range(EMBED)], axis=1).astype(np.float32)
    g_bytes[PAD] = 0
    return [g_bytes, g_filters, g_max.sum(axis=0), pooled.T @ g_hidden, g_hidden.sum(axis=0), g_out]


def train(good: list[bytes], bad: list[bytes], good_share: float, steps: int = 900, batch: int = 32, stretch: int = 2048, rate: float = 4e-3, seed: int = 5) -> Network | None:
    """A network from the labelled texts, or None where a class is missing.  ``good_share`` is the classes' true share."""
    if not good or not bad:
        return None
    rng = np.random.default_rng(seed)
    sides = [[np.frombuffer(t, np.uint8) for t in side] for side in (bad, good)]
    net = Network.new(rng)
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    y = np.arange(batch) % 2
    for step in range(1, steps + 1):
        texts = []
        for label in y:
            t = sides[label][rng.integers(len(sides[label]))]
            at = int(rng.integers(max(1, len(t) - stretch + 1)))
            texts.append(t[at : at + stretch])
        pace = rate * min(1.0, step / 20) * (0.02 + 0.98 * (1 - step / steps))
        for w, g, m, v in zip(net.weights(), gradients(net, texts, y), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (pace * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) + 1e-3 * w)).astype(np.float32)
    _calibrate(net, [logits(net, side) for side in sides], good_share)
    return net


def _calibrate(net: Network, z: list[np.ndarray], good_share: float, ridge: float = 1.0) -> None:
    """Scale and shift of a logistic curve over the whole texts, weighted to the classes' true share."""
    share = min(max(good_share, 1e-6), 1 - 1e-6)
    x = np.stack([np.concatenate(z), np.ones(sum(map(len, z)))], axis=1)
    y = np.repeat([0.0, 1.0], list(map(len, z)))
    weight = np.where(y > 0, share / len(z[1]), (1 - share) / len(z[0])) * len(y)
    w, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(30):
        p = probability(x @ w)
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * (w - prior))
        w += step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
    net.scale, net.shift = max(float(w[0]), 1e-3), float(w[1])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never read: crc32 of the id as text leaves 1 when divided by 3.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 1500, sample_bytes: int = 20_000, **options) -> tuple[Network | None, float]:
    """Trains on ``sample_rows`` labelled rows of each class at most (those with the smallest hashed ids), whose texts have
    ``sample_bytes`` bytes at most; so what reaches the driver is bounded in number and size.

    Held-out rows are never read here.  An id that is labelled both ways counts as unlabelled; of several texts of one id the
    smallest counts.  The second value is the share of good ids among the labels, the score of every text where no network can be
    trained (0.5 without labels).
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("id")))
    usable = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").select("id", "y")
    n, good = usable.agg(F.count("*"), F.sum("y")).first()
    share = (good or 0) / n if n else 0.5
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text").between(1, sample_bytes))
    pick = lambda y: usable.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    sample = pick(1).union(pick(0))  # at most twice sample_rows ids, so small enough to send to every executor
    rows = sorted(texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text")).collect())
    side = lambda y: [r.text.encode("utf-8", "surrogatepass") for r in rows if r.y == y]
    return train(side(1), side(0), share, **options), share


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", out: str = "score", batch_bytes: int = 1 << 20, **options) -> DataFrame:
    """All rows and columns of ``docs`` and ``out``, the probability that the whole text is good.

    Null texts count as empty, which is scored as a text without any byte; texts of any length are worked on in slices of bounded
    memory.  Equal texts have equal scores but for the rounding of float32 sums; repeated rows each come back; an empty table gives no rows.  Without labels of both
    classes every score is the share of good labels (0.5 without any).
    """
    net, share = fit(docs, labels, id_col, text_col, label_col, **options)
    at, names = docs.columns.index(text_col), [*docs.columns, out]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full(batch.num_rows, share)
            if net is not None:
                held, size, first = [], 0, 0
                for i, text in enumerate(batch.column(at)):
                    held.append(np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8))
                    size += len(held[-1])
                    if size >= batch_bytes or i + 1 == batch.num_rows:
                        found[first : i + 1] = probability(logits(net, held))
                        held, size, first = [], 0, i + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{out}` double"
    return docs.mapInArrow(scored, schema)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows ``(doc_id, held_out, score, predicted)``, one per input row; see :func:`classify` for odd inputs."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else labels
    found = classify(narrow, known, **options)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that are predicted good."""
    out = fresh("score", docs.columns)
    return classify(docs, labels, id_col, text_col, out=out, **options).filter(F.col(out) >= 0.5).select(*docs.columns)
