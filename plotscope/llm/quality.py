"""Quality by a byte-level convolutional network in numpy.

Every byte is a learned vector. Learned filters see windows of eight bytes, four bytes
apart, and whether the window's bytes occurred just before it. A text is covered by
overlapping chunks; each filter is max-pooled over a chunk, and the mean and the maximum over
all chunks of the whole text are combined into one probability. The network is trained
on a bounded sample of labelled rows and scores every text inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotscope.llm.common import small_slices

#: Most labelled rows that the network is trained on.
TRAIN_ROWS = 1200
EPOCHS = 14
FILTERS, DIMENSIONS = 24, 8
#: Windows per chunk and from one chunk to the next: they overlap.
CHUNK, HOP = 128, 112
STEP = 4
#: How far back a window's bytes are looked for.
LOOK_BACK = 32
KEEP_FROM = 0.3
FOLDS = 5
#: Bytes that are scored together: bounds the memory of a task.
BLOCK_BYTES = 1 << 19


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIMENSIONS
    near: np.ndarray  # first half of a window: STEP * DIMENSIONS x FILTERS
    far: np.ndarray  # second half
    again: np.ndarray  # weight of the repeat mark per filter
    bias: np.ndarray
    mean: np.ndarray  # weights of the mean and the maximum of the pooled filters
    most: np.ndarray
    base: np.ndarray

    @staticmethod
    def fresh(seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
        half = STEP * DIMENSIONS
        return Network(
            draw(256, DIMENSIONS, by=0.5),
            draw(half, FILTERS, by=0.2),
            draw(half, FILTERS, by=0.2),
            draw(FILTERS, by=0.5),
            np.zeros(FILTERS, np.float32),
            draw(FILTERS, by=0.1),
            draw(FILTERS, by=0.1),
            np.zeros(1, np.float32),
        )


class Layout:
    """Texts as one byte array: padded to whole steps, with a blank step after each."""

    def __init__(self, texts: Sequence[bytes]):
        self.windows = np.array([-(-len(t) // STEP) for t in texts], np.int64)
        starts = np.cumsum(np.concatenate([[0], self.windows + 1]))
        raw = np.zeros(int(starts[-1]) * STEP + LOOK_BACK + 2 * STEP, np.uint8)
        for text, start in zip(texts, starts, strict=False):
            raw[start * STEP : start * STEP + len(text)] = np.frombuffer(text, np.uint8)
        self.raw = raw[: int(starts[-1]) * STEP + STEP]
        self.again = self._again(raw, int(starts[-1]))
        first, last, doc = [], [], []
        for i, (start, n) in enumerate(zip(starts, self.windows, strict=False)):
            begins = np.arange(0, max(n - (CHUNK - HOP), 1), HOP) if n else np.empty(0, np.int64)
            first.append(start + begins)
            last.append(start + np.minimum(begins + CHUNK, n))
            doc.append(np.full(len(begins), i))
        self.first, self.last, self.doc = (np.concatenate(x).astype(np.int64) for x in (first, last, doc))

    @staticmethod
    def _again(raw: np.ndarray, steps: int) -> np.ndarray:
        """1 where the eight bytes of a window also stand a little before it."""
        word = np.zeros(len(raw) - 7, np.uint64)
        for k in range(8):
            word |= raw[k : len(raw) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
        word = np.concatenate([np.zeros(LOOK_BACK, np.uint64), word])
        here = word[LOOK_BACK :][: steps * STEP : STEP]
        mark = np.zeros(len(here), bool)
        for lag in range(1, LOOK_BACK + 1):
            mark |= word[LOOK_BACK - lag :][: steps * STEP : STEP] == here
        return (mark & (here != 0)).astype(np.float32)


def _filtered(net: Network, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    halves = net.embed[lay.raw].reshape(-1, STEP * DIMENSIONS)
    both = halves @ np.concatenate([net.near, net.far], axis=1)
    out = both[:-1, :FILTERS] + both[1:, FILTERS:]
    out += lay.again[:, None] * net.again + net.bias
    return halves, out


def _combine(net: Network, pooled: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Scores from the pooled chunks; chunks of a document are adjacent."""
    chunks = np.bincount(doc, minlength=n)
    mean, most = np.zeros((n, FILTERS), pooled.dtype), np.zeros((n, FILTERS), pooled.dtype)
    some = np.flatnonzero(chunks)
    if len(some):
        begin = np.cumsum(chunks) - chunks
        mean[some] = np.add.reduceat(pooled, begin[some]) / chunks[some, None]
        most[some] = np.maximum.reduceat(pooled, begin[some])
    logit = mean @ net.mean + most @ net.most + net.base
    return mean, most, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), chunks


def scores(net: Network, texts: Sequence[str | None]) -> np.ndarray:
    """Probability of quality 1 per text, from all of its bytes; null counts as empty."""
    out, block, size = [], [], 0
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for i, raw in enumerate(raws):
        block.append(raw)
        size += len(raw)
        if size >= BLOCK_BYTES or i + 1 == len(raws):
            lay = Layout(block)
            if len(lay.first):
                _, filtered = _filtered(net, lay)
                edge = np.concatenate([filtered, np.zeros((1, FILTERS), np.float32)])
                ends = np.stack([lay.first, lay.last], axis=1).ravel()
                pooled = np.maximum(np.maximum.reduceat(edge, ends)[::2], 0)
            else:
                pooled = np.zeros((0, FILTERS), np.float32)
            out.append(_combine(net, pooled, lay.doc, len(block))[2])
            block, size = [], 0
    return np.concatenate(out) if out else np.zeros(0)


def train(texts: Sequence[str | None], labels: Sequence[int], epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Fit a network by minibatches of whole texts; no rows give one that scores by its start."""
    net = Network.fresh(seed)
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    wanted = np.array(labels, np.float32)
    if not len(raws):
        return net
    share = np.clip(wanted.mean(), 0.01, 0.99)
    net.base[:] = np.log(share / (1 - share))
    rng, names = np.random.default_rng(seed), [f.name for f in fields(Network)]
    moments = {n: (np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))) for n in names}
    count, size = 0, 32
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(raws)), max(1, len(raws) // size)):
            count += 1
            grads = _gradients(net, Layout([raws[i] for i in part]), wanted[part])
            for name, grad in grads.items():
                first, second = moments[name]
                first += 0.1 * (grad - first)
                second += 0.01 * (grad * grad - second)
                step = 0.01 * (first / (1 - 0.9**count)) / (np.sqrt(second / (1 - 0.99**count)) + 1e-6)
                getattr(net, name)[...] -= step
    return net


def _gradients(net: Network, lay: Layout, wanted: np.ndarray) -> dict[str, np.ndarray]:
    n = len(wanted)
    halves, filtered = _filtered(net, lay)
    chunks = len(lay.first)
    window = np.zeros((chunks, FILTERS), np.int64)
    for c, (lo, hi) in enumerate(zip(lay.first, lay.last, strict=True)):
        window[c] = lo + filtered[lo:hi].argmax(axis=0)
    raw_pooled = filtered[window, np.arange(FILTERS)] if chunks else np.zeros((0, FILTERS), np.float32)
    pooled = np.maximum(raw_pooled, 0)
    mean, most, score, per_doc = _combine(net, pooled, lay.doc, n)
    error = ((score - wanted) / n).astype(np.float32)
    decay = 1e-4
    grads = {
        "mean": mean.T @ error + decay * net.mean,
        "most": most.T @ error + decay * net.most,
        "base": np.array([error.sum()], np.float32),
    }
    back = error[lay.doc, None] * (net.mean / np.maximum(per_doc[lay.doc], 1)[:, None])
    # Overlapping chunks may hold the same maximum; the first of them gets its gradient.
    chunk, f = np.nonzero(pooled == most[lay.doc])
    first = np.full((n, FILTERS), chunks)
    np.minimum.at(first, (lay.doc[chunk], f), chunk)
    back += error[lay.doc, None] * net.most * (first[lay.doc] == np.arange(chunks)[:, None])
    back = (back * (raw_pooled > 0)).astype(filtered.dtype)
    near, far, embed = np.zeros_like(net.near), np.zeros_like(net.far), np.zeros_like(net.embed)
    steps = lay.raw.reshape(-1, STEP)
    for f in range(FILTERS):
        use = np.flatnonzero(back[:, f])
        at, g = window[use, f], back[use, f]
        near[:, f] = halves[at].T @ g
        far[:, f] = halves[at + 1].T @ g
        for half, place in ((net.near, at), (net.far, at + 1)):
            bytes_ = steps[place]
            for k in range(STEP):
                total = np.bincount(bytes_[:, k], weights=g, minlength=256).astype(np.float32)
                embed += total[:, None] * half[k * DIMENSIONS : (k + 1) * DIMENSIONS, f]
    again = (lay.again[window] * back).sum(axis=0) if chunks else np.zeros(FILTERS)
    return grads | {"near": near, "far": far, "embed": embed, "again": again, "bias": back.sum(axis=0)}


def held_out(key: str = "doc_id") -> F.Column:
    """Rows never learned from; a null key is one of them."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train_on_sample(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS
) -> Network:
    """Train on at most ``rows`` labelled documents outside the held-out fold.

    The sample is the first rows in the order of a hash of the key, so it is the same
    however the tables lie, and its keys are few enough to be broadcast. Rows with a null
    label do not count.
    """
    few = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(key)
        .agg(F.min(label).alias("wanted"))
        .orderBy(F.xxhash64(key), key)
        .limit(rows)
    )
    picked = docs.select(key, text).join(F.broadcast(few), key).dropDuplicates([key]).select(key, text, "wanted")
    sample = sorted(picked.collect(), key=lambda r: r[0])
    return train([r[1] for r in sample], [r[2] for r in sample])


def score_documents(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the key, held_out, score (0 to 1) and predicted (1 from a score of 0.3
    on). Null and empty texts get the score of no evidence; repeated rows are kept."""
    picked = docs.select(F.col(key), F.col(text).alias("text"), held_out(key).alias("held_out"))
    out = T.StructType([picked.schema[0], *T.StructType.fromDDL("held_out BOOLEAN, score DOUBLE")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            found = scores(net, batch.column(1).to_pylist())
            columns = [batch.column(0), batch.column(2), pa.array(found.astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    scored = picked.mapInArrow(run, out)
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


def keep_good(docs: DataFrame, net: Network, text: str = "text", least: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            good = scores(net, batch.column(place).to_pylist()) >= least
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
