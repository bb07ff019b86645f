"""Document quality by a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into cells of 32 bytes; two neighbouring cells are a chunk, so
chunks overlap by half and cover the whole text.  Learned filters look at every run of ``WIDTH``
bytes; repetition channels tell, for each lag up to ``LAGS``, how many bytes of the chunk equal the
byte that far before.  Both are max-pooled in a chunk, chunks are pooled over the document by
maximum and mean, and one logistic unit combines them into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.arrays import claim, slices, text_bytes
from shelfmark.llm.names import fresh

CELL, LAGS, WIDTH, FILTERS = 32, 32, 4, 12
REPEATS = 2  # features of a chunk from its lags: the most and the mean
_BLOCK = 1 << 18  # bytes that are convolved at once


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS: weight of each byte at each place
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # of the pooled features
    offset: float


@dataclass
class _Layout:
    """Texts as whole cells, each text followed by one cell of zeros that nothing looks across."""

    data: np.ndarray
    cells: np.ndarray  # numbers of the cells that hold text, text after text
    first: np.ndarray  # of each text, in ``cells``
    paired: np.ndarray  # has a next cell in the same text


def _layout(data: np.ndarray, offsets: np.ndarray) -> _Layout:
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-lengths // CELL))
    starts = np.concatenate([[1], 1 + np.cumsum(counts + 1)])  # one cell of zeros before the first text
    out = np.zeros((int(starts[-1]) + 1) * CELL, dtype=np.uint8)
    place = np.repeat(starts[:-1] * CELL - offsets[:-1], lengths)
    out[place + np.arange(len(data))] = data
    first = np.cumsum(counts) - counts
    cells = np.repeat(starts[:-1] - first, counts) + np.arange(int(counts.sum()))
    paired = np.ones(len(cells), dtype=bool)
    paired[first + counts - 1] = False
    return _Layout(out, cells, first, paired)


def _convolve(net: Network, data: np.ndarray, where: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Per cell and filter the greatest response, and the byte where it begins (only if ``where``)."""
    cells = len(data) // CELL
    best = np.zeros((cells, FILTERS), dtype=np.float32)
    at = np.zeros((cells, FILTERS), dtype=np.int64) if where else None
    step = _BLOCK // CELL
    for c in range(0, cells, step):
        n = (min(cells, c + step) - c) * CELL
        part = np.zeros(n + WIDTH, dtype=np.uint8)
        piece = data[c * CELL: c * CELL + n + WIDTH]
        part[: len(piece)] = piece
        response = net.filters[0].take(part[:n], axis=0)
        for k in range(1, WIDTH):
            response += net.filters[k].take(part[k: n + k], axis=0)
        response = response.reshape(-1, CELL, FILTERS)
        if where:
            place = response.argmax(axis=1)
            at[c: c + step] = place + (np.arange(len(place))[:, None] + c) * CELL
        best[c: c + step] = response.max(axis=1)
    return best + net.bias, at


def _repeats(data: np.ndarray) -> np.ndarray:
    """Per cell, for each lag, how many of its bytes equal the byte that far before; zeros do not count."""
    cells = len(data) // CELL
    solid = data != 0
    out = np.zeros((cells, LAGS + 1), dtype=np.uint8)
    same = np.zeros(len(data), dtype=bool)
    for lag in range(1, LAGS + 1):
        np.equal(data[lag:], data[:-lag], out=same[lag:])
        same &= solid
        out[:, lag - 1] = same.view(np.uint8).reshape(-1, CELL).sum(axis=1, dtype=np.uint8)
    out[:, LAGS] = solid.view(np.uint8).reshape(-1, CELL).sum(axis=1, dtype=np.uint8)
    return out


def _chunks(layout: _Layout, per_cell: np.ndarray, combine) -> np.ndarray:
    """A chunk for each cell that holds text: the cell with the next one of the same text, if there is one."""
    here = per_cell[layout.cells]
    after = per_cell[np.where(layout.paired, layout.cells + 1, layout.cells)]
    return combine(here, after, layout.paired[:, None])


def _pool(layout: _Layout, chunks: np.ndarray) -> np.ndarray:
    counts = np.diff(np.concatenate([layout.first, [len(layout.cells)]]))
    return np.concatenate([np.maximum.reduceat(chunks, layout.first, axis=0), np.add.reduceat(chunks, layout.first, axis=0, dtype=np.float64) / counts[:, None]], axis=1)


def _repeat_features(layout: _Layout) -> np.ndarray:
    sums = _chunks(layout, _repeats(layout.data), lambda a, b, both: a.astype(np.int16) + b * both)
    share = sums[:, :LAGS] / np.maximum(sums[:, LAGS:], 8)
    return _pool(layout, np.stack([share.max(axis=1), share.mean(axis=1)], axis=1).astype(np.float32))


def _hidden(net: Network, layout: _Layout) -> np.ndarray:
    best, _ = _convolve(net, layout.data, where=False)
    return _pool(layout, np.maximum(_chunks(layout, best, lambda a, b, both: np.maximum(a, b)), 0))


def _probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def score_texts(net: Network, column: pa.Array) -> np.ndarray:
    """Probability that each text is good.  It depends on the text alone, not on its neighbours."""
    if not len(column):
        return np.zeros(0)
    layout = _layout(*text_bytes(column))
    features = np.concatenate([_hidden(net, layout), _repeat_features(layout)], axis=1)
    return _probability(features @ net.weights + net.offset)


def train(texts: list[str], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
    """Minimise log loss by Adam; gradients go to the byte runs that won the pooling."""
    rng = np.random.default_rng(seed)
    net = Network((rng.normal(size=(WIDTH, 256, FILTERS)) * 0.1).astype(np.float32), np.zeros(FILTERS, dtype=np.float32),
                  rng.normal(size=2 * FILTERS + 2 * REPEATS) * 0.1, 0.0)
    values = [net.filters, net.bias, net.weights]
    moments = [(np.zeros(v.shape), np.zeros(v.shape)) for v in [*values, np.zeros(1)]]
    labels = np.asarray(labels, dtype=np.float64)
    step = 0
    for _ in range(epochs if len(texts) else 0):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            rows = order[k: k + batch]
            layout = _layout(*text_bytes(pa.array([texts[i] for i in rows], pa.large_string())))
            best, at = _convolve(net, layout.data, where=True)
            chosen = np.where(layout.paired, layout.cells + 1, layout.cells)
            later = best[chosen] > best[layout.cells]
            response = np.where(later, best[chosen], best[layout.cells])
            place = np.where(later, at[chosen], at[layout.cells])
            features = np.concatenate([_pool(layout, np.maximum(response, 0)), _repeat_features(layout)], axis=1)
            error = (_probability(features @ net.weights + net.offset) - labels[rows]) / len(rows)
            # back to chunks: all share the mean, the greatest takes the maximum
            counts = np.diff(np.concatenate([layout.first, [len(layout.cells)]]))
            text_of = np.repeat(np.arange(len(rows)), counts)
            top, mean = net.weights[:FILTERS], net.weights[FILTERS: 2 * FILTERS]
            back = error[text_of, None] * mean / counts[text_of, None]
            peak = np.maximum(response, 0) >= features[text_of, :FILTERS]
            ties = np.add.reduceat(peak, layout.first, axis=0, dtype=np.float64)[text_of]
            back += peak * error[text_of, None] * top / ties
            back *= response > 0
            slot = np.arange(FILTERS)
            gradient = np.stack([np.bincount((layout.data[place + j].astype(np.int64) * FILTERS + slot).reshape(-1), back.reshape(-1), 256 * FILTERS).reshape(256, FILTERS) for j in range(WIDTH)])
            step += 1
            for value, slope, (one, two) in zip([*values, None], [gradient + 1e-5 * net.filters, back.sum(axis=0), error @ features + 1e-4 * net.weights, np.array([error.sum()])], moments, strict=True):
                one += 0.1 * (slope - one)
                two += 0.001 * (slope * slope - two)
                move = rate * (one / (1 - 0.9 ** step)) / (np.sqrt(two / (1 - 0.999 ** step)) + 1e-8)
                if value is None:
                    net.offset -= float(move[0])
                else:
                    value -= move.astype(value.dtype)
    return net


def fold(doc_id: str):
    """crc32 of the id as text, modulo 3: fold 1 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
                sample_rows: int = 1200, sample_bytes: int = 1 << 16) -> Network:
    """A network from at most ``sample_rows`` labelled rows of each class, outside fold 1, each of at most ``sample_bytes``.

    The sample is the rows with the least hash of id.  Labels other than 0 and 1, null ids and
    repeated labels of one id are left out but for the greatest.  Without a sample the network
    says 0.5 for every text.
    """
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    marked = marked.where(fold("doc_id") != 1).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marked.where("y = 0").orderBy(*order).limit(sample_rows).unionAll(marked.where("y = 1").orderBy(*order).limit(sample_rows))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= sample_bytes)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(F.struct("text", "y")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").limit(2 * sample_rows).collect()
    if len({row.y for row in rows}) < 2:
        empty = train([], np.zeros(0))
        empty.weights[:] = 0
        return empty
    return train([row.text for row in rows], np.array([row.y for row in rows]))


SLICE = 1 << 20  # bytes of text that are scored at once; a worker holds some twenty times as much


def score_quality(docs: DataFrame, network: Network, doc_id: str = "doc_id", text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score``: the probability that the whole text is good.

    Null and empty texts score alike; every row is scored, whatever its id; all columns stay, but an own
    column of the name ``score`` is replaced; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    docs = docs.drop(score)
    work = fresh(docs, "__text")
    rows = docs.withColumn(work, F.col(text).cast("string"))

    def run(batches):
        claim("quality")
        for batch in batches:
            for part in slices(batch, work, SLICE):
                columns = part.columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score_texts(shared.value, part.column(work)))], [*part.schema.names[:-1], score])

    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
