"""Benchmark passages in documents, by latent semantic retrieval and exact checks.

1. Words are hashed to ``FEATURES`` features.  One pass counts, over all documents, in how many
   cells of 32 words each feature stands; that gives inverse document frequencies.
2. The benchmark, cut into passages, is a TF-IDF matrix.  A randomised SVD (random start, power
   steps, each a distributed product with the passages) gives its latent space.  Benchmarks of more
   than ``block_words`` words or ``rank`` passages go in several such blocks, so that a block's space
   has a dimension for each of its passages and holds them whole.
3. Four neighbouring cells of a document are a window, the next window begins one cell later, so any
   stretch of 97 words lies in one.  A window's latent vector has each word once a cell.  It is compared
   with all passages: its product with a passage must reach what the verdict below implies (``_least``),
   so length does not matter and no passage that would be accepted is passed over.  Windows whose words
   cannot reach any passage's least are not projected.
4. Each candidate is checked on the words themselves: the longest common subsequence of passage and
   window, the share of the passage's weight that stands there, and its answer (the end of
   the passage).  Where 64 words around it do not resemble the passage as a whole (``cosine``), as with
   short items, it must stand in a stretch of its own length, the share of words in order being that
   of weight, and its answer also by weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.arrays import claim, ragged, slices, text_bytes, words
from shelfmark.llm.names import fresh

FEATURES, CELL, WINDOW = 1 << 17, 32, 4  # a window has so many cells
PASSAGE = 64  # words of a passage at most; longer items have several, overlapping by half


@dataclass
class Settings:
    cosine: float = 0.25  # of two neighbouring cells and a passage; below, ``dense`` must hold too
    near: float = 0.75  # of a passage's words in the common subsequence: a copy
    paraphrase: float = 0.5  # the same, if weight and answer are there too
    weight: float = 0.6  # of a passage's weight that must stand in the text for a paraphrase
    answer: float = 0.5  # of the answer's words
    min_words: int = 5  # shorter items have no passage to look for
    rank: int = 256  # passages of a block, and dimensions of its latent space, at most
    power_steps: int = 2
    block_words: int = 1 << 14


@dataclass
class Passages:
    """One block of the benchmark."""

    items: np.ndarray  # item of each passage
    tokens: list[np.ndarray]  # word hashes of each passage
    answers: list[np.ndarray]
    slot: np.ndarray  # FEATURES: row of a feature in ``space``, or -1
    space: np.ndarray  # rows x dimensions, scaled by inverse document frequency
    latent: np.ndarray  # passages x dimensions, unit
    least: np.ndarray  # product with ``latent`` of any window that holds enough of a passage
    reach: np.ndarray  # of each row of ``space``: the most that its word adds to the share of weight, in units of the share wanted


def feature_weights(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Inverse document frequency of each feature; the documents are the cells of all texts."""

    def count(batches):
        claim("contamination")
        seen, cells = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                hashes, offsets = words(*text_bytes(part.column("text")))
                if not len(hashes):
                    continue
                features = (hashes % np.uint64(FEATURES)).astype(np.int64)
                starts, _ = _cells(offsets)
                cell = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(hashes)]])))
                table = np.full((len(starts), CELL), FEATURES, dtype=np.int32)
                table[cell, np.arange(len(hashes)) - starts[cell]] = features
                table.sort(axis=1)
                fresh = np.ones(table.shape, dtype=bool)
                fresh[:, 1:] = table[:, 1:] != table[:, :-1]
                seen += np.bincount(table[fresh], minlength=FEATURES + 1)[:FEATURES]
                cells += len(starts)
        full = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1)), pa.array(np.append(seen[full], cells))], ["feature", "n"])

    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # at most FEATURES + 1 rows
    feature, n = found.column("feature").to_numpy(), found.column("n").to_numpy()
    cells = max(1, int(n[feature < 0].sum()))
    seen = np.zeros(FEATURES)
    seen[feature[feature >= 0]] = n[feature >= 0]
    return np.log((1 + cells) / (1 + seen)) + 0.01


def _cells(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the cells of all texts begin, and the text of each."""
    lengths = np.diff(offsets)
    counts = -(-lengths // CELL)
    text = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts
    return offsets[:-1][text] + (np.arange(len(text)) - first[text]) * CELL, text


def _answer(text: str, least: int = 5) -> int:
    """Words of the answer: the last sentence, or the last ``least`` words if it is shorter."""
    sentences = [s for s in re.split(r"(?<=[.?!:])\s+|\n", text) if s.strip()]
    return max(least, len(sentences[-1].split())) if sentences else least


def _passages(benchmark: DataFrame, item_id: str, text: str, settings: Settings) -> DataFrame:
    """``item, passage, tokens, answer``: hashed words of each passage and of its item's end."""

    def cut(batches):
        for batch in batches:
            hashes, offsets = words(*text_bytes(batch.column("text")))
            rows: dict[str, list] = {"item": [], "passage": [], "tokens": [], "answer": []}
            for k, (item, body) in enumerate(zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                mine = hashes[offsets[k]: offsets[k + 1]].view(np.int64).tolist()
                if len(mine) < settings.min_words:
                    continue
                starts = range(0, max(1, len(mine) - PASSAGE // 2), PASSAGE // 2) if len(mine) > PASSAGE else [0]
                for n, s in enumerate(starts):
                    end = s + PASSAGE if len(mine) > PASSAGE else len(mine)
                    part = mine[s:end]
                    rows["item"].append(item), rows["passage"].append(n), rows["tokens"].append(part)
                    rows["answer"].append(part[-min(len(part), _answer(body) if end >= len(mine) else 5):])
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("item", batch.schema.field("item").type), ("passage", pa.int32()), ("tokens", pa.list_(pa.int64())), ("answer", pa.list_(pa.int64()))]))

    rows = benchmark.select(F.col(item_id).alias("item"), F.col(text).cast("string").alias("text")).where("text is not null")
    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(cut, f"item {kind}, passage int, tokens array<long>, answer array<long>")


def _matrix(tokens: list[np.ndarray], weights: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages as unit TF-IDF rows: row, column and value of the entries."""
    row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    features = (np.concatenate(tokens).view(np.uint64) % np.uint64(FEATURES)).astype(np.int64)
    key, times = np.unique(row * FEATURES + features, return_counts=True)
    row, features = key // FEATURES, key % FEATURES
    value = times * weights[features]
    norm = np.sqrt(np.bincount(row, value * value, len(tokens)))
    return row, slot[features], value / norm[row]


def latent_space(passages: DataFrame, weights: np.ndarray, slot: np.ndarray, settings: Settings) -> np.ndarray:
    """The leading right singular vectors of the passages' TF-IDF matrix, by randomised SVD.

    Each product runs over the passages in Spark tasks; a task sends one matrix of features x width,
    which ``block_words`` bounds, and the sums are made orthogonal on the driver.
    """
    size = int(slot.max()) + 1
    width = min(settings.rank + 16, size)
    context = passages.sparkSession.sparkContext

    def product(basis: np.ndarray, gram: bool) -> np.ndarray:
        shared = context.broadcast((basis, weights, slot))

        def multiply(batches):
            basis, weights, slot = shared.value
            total = np.zeros((basis.shape[1] if gram else len(basis), basis.shape[1]))
            for batch in batches:
                tokens = [np.array(t, dtype=np.int64) for t in batch.column("tokens").to_pylist()]
                if tokens:
                    row, column, value = _matrix(tokens, weights, slot)
                    dense = np.zeros((len(tokens), len(basis)), dtype=np.float64)
                    dense[row, column] = value
                    image = dense @ basis
                    total += image.T @ image if gram else dense.T @ image
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        parts = passages.mapInArrow(multiply, "part binary").toLocalIterator()
        total = sum(np.frombuffer(row.part).reshape(-1, basis.shape[1]) for row in parts)
        shared.unpersist()
        return total

    basis = np.linalg.qr(np.random.default_rng(11).normal(size=(size, width)))[0]
    for _ in range(1 + settings.power_steps):
        basis = np.linalg.qr(product(basis, gram=False))[0]
    values, turn = np.linalg.eigh(product(basis, gram=True))
    keep = np.argsort(-values)[: settings.rank]
    return (basis @ turn[:, keep[values[keep] > 1e-9]]).astype(np.float32)


GATHERED = 8  # blocks' words that the driver reads at once


SLACK = 1 - 1e-3  # for sums in single precision


def _least(tokens: list[np.ndarray], weights: np.ndarray, share: float) -> np.ndarray:
    """The least product of a passage's unit row and a window that holds ``share`` of its weight.

    The product is the sum of the squared weights of the passage's words that stand in the window,
    through the row's norm.  It is least if the lightest words make up the share.
    """
    out = np.empty(len(tokens))
    for k, passage in enumerate(tokens):
        features, of, times = np.unique((passage.view(np.uint64) % np.uint64(FEATURES)).astype(np.int64), return_inverse=True, return_counts=True)
        light = np.sort(weights[features][of])
        sums = np.cumsum(light)
        full = min(int(np.searchsorted(sums, share * sums[-1])), len(light) - 1)
        rest = share * sums[-1] - (sums[full - 1] if full else 0)
        out[k] = ((light[:full] ** 2).sum() + rest * light[full]) / np.sqrt(((times * weights[features]) ** 2).sum())
    return out * SLACK


def _reach(tokens: list[np.ndarray], weights: np.ndarray, slot: np.ndarray, share: float) -> np.ndarray:
    """The most that a word adds to any passage's share of weight, in units of the share wanted."""
    out = np.zeros(int(slot.max()) + 1)
    for passage in tokens:
        features, times = np.unique((passage.view(np.uint64) % np.uint64(FEATURES)).astype(np.int64), return_counts=True)
        part = times * weights[features]
        out[slot[features]] = np.maximum(out[slot[features]], part / (share * part.sum()) if share else np.inf)
    return out


def _cut(tokens: list[np.ndarray], settings: Settings) -> Iterator[tuple[int, int]]:
    """Runs of passages that make a block: at most ``rank`` of them, and ``block_words`` words unless one alone has more."""
    start = held = 0
    for k, passage in enumerate(tokens):
        if k > start and (k - start == settings.rank or held + len(passage) > settings.block_words):
            yield start, k
            start, held = k, 0
        held += len(passage)
    if tokens:
        yield start, len(tokens)


def prepare(benchmark: DataFrame, weights: np.ndarray, settings: Settings, item_id: str = "item_id", text: str = "text") -> Iterator[Passages]:
    """The benchmark in blocks of at most ``rank`` passages and ``block_words`` words, each with its latent space."""
    from shelfmark.session import stored

    passages = stored(_passages(benchmark, item_id, text, settings), "passages")
    total = passages.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    reads = -(-total // (GATHERED * settings.block_words))
    for k in range(reads):
        rows = passages.where(F.pmod(F.xxhash64("item", "passage"), F.lit(reads)) == k).toArrow()
        gathered = [np.array(t, dtype=np.int64) for t in rows.column("tokens").to_pylist()]
        for start, end in _cut(gathered, settings):
            mine, tokens = rows.slice(start, end - start), gathered[start:end]
            features = np.unique((np.concatenate(tokens).view(np.uint64) % np.uint64(FEATURES)).astype(np.int64))
            slot = np.full(FEATURES, -1, dtype=np.int32)
            slot[features] = np.arange(len(features))
            parts = max(1, min(8, sum(map(len, tokens)) // 2048))
            space = latent_space(passages.sparkSession.createDataFrame(mine.select(["tokens"])).repartition(parts), weights, slot, settings)
            row, column, value = _matrix(tokens, weights, slot)
            latent = np.zeros((len(tokens), space.shape[1]), dtype=np.float32)
            np.add.at(latent, row, value[:, None].astype(np.float32) * space[column])
            latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
            yield Passages(np.array(mine.column("item").to_pylist(), dtype=object), tokens, [np.array(a, dtype=np.int64) for a in mine.column("answer").to_pylist()],
                           slot, (weights[features, None] * space).astype(np.float32), latent,
                           _least(tokens, weights, settings.weight), _reach(tokens, weights, slot, settings.weight))


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one bit of an integer per word of ``a``."""
    where: dict[int, int] = {}
    for k, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for word in b:
        hit = row & where.get(word, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def candidates(block: Passages, weights: np.ndarray, hashes: np.ndarray, offsets: np.ndarray):
    """``(text, first word, end, passage)`` of windows that may hold a passage."""
    if not len(hashes):
        return
    features = (hashes % np.uint64(FEATURES)).astype(np.int64)
    starts, text = _cells(offsets)
    ends = np.append(starts, len(hashes))
    slots = block.slot[features]
    # each word of the benchmark once a cell, by cell
    size = len(block.space)
    at = np.flatnonzero(slots >= 0)
    key = np.unique((np.searchsorted(starts, at, side="right") - 1) * size + slots[at])
    row = key % size
    entry = np.searchsorted(key, np.arange(len(starts) + 1) * size)
    # windows: WINDOW neighbouring cells of a text, or all that it has
    last = np.searchsorted(text, text, side="right") - 1
    first = np.flatnonzero((np.arange(len(starts)) + WINDOW - 1 <= last) | (np.diff(text, prepend=-1) != 0))
    final = np.minimum(first + WINDOW - 1, last[first])

    def windowed(values):
        sums = np.append(0.0, np.cumsum(values))
        return sums[entry[final + 1]] - sums[entry[first]]

    hopeful = windowed(block.reach[row]) >= SLACK
    first, final = first[hopeful], final[hopeful]
    for k in range(0, len(first), 4096):
        a, z = first[k: k + 4096], final[k: k + 4096]
        cells = np.unique(np.concatenate([np.minimum(a + n, z) for n in range(WINDOW)]))
        counts = entry[cells + 1] - entry[cells]
        filled = np.flatnonzero(counts)
        vectors = np.zeros((len(cells), block.space.shape[1]), dtype=np.float32)
        if len(filled):
            begin = (np.cumsum(counts) - counts)[filled]
            vectors[filled] = np.add.reduceat(block.space[row[ragged(entry[cells], counts)]], begin, axis=0)
        product = vectors @ block.latent.T
        place = np.searchsorted(cells, a)
        total = product[place]
        for n in range(1, WINDOW):
            more = np.flatnonzero(a + n <= z)
            total[more] += product[place[more] + n]
        for w, p in zip(*np.nonzero(total >= block.least), strict=True):
            yield int(text[a[w]]), int(starts[a[w]]), int(min(ends[z[w] + 1], offsets[text[a[w]] + 1])), int(p)


def _weight(weights: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return weights[(tokens.view(np.uint64) % np.uint64(FEATURES)).astype(np.int64)]


def cosine(weights: np.ndarray, wanted: np.ndarray, region: np.ndarray) -> float:
    """The largest cosine of a passage and two neighbouring cells."""
    features, times = np.unique((wanted.view(np.uint64) % np.uint64(FEATURES)).astype(np.int64), return_counts=True)
    row = times * weights[features]
    here = (region.view(np.uint64) % np.uint64(FEATURES)).astype(np.int64)
    at = np.minimum(np.searchsorted(features, here), len(features) - 1)
    part = np.where(features[at] == here, row[at], 0) * weights[here] / np.linalg.norm(row)
    power = weights[here] ** 2
    return max(float(part[k: k + 2 * CELL].sum() / np.sqrt(power[k: k + 2 * CELL].sum())) for k in range(0, max(1, len(region) - CELL), CELL))


def _stands(block: Passages, weights: np.ndarray, settings: Settings, passage: int, region: np.ndarray, firm: bool) -> tuple[int, float, bool, bool]:
    """Common subsequence, share of weight, answer found, and whether they are enough; ``firm`` asks for the share of words in order and the answer's weight too."""
    wanted, answer = block.tokens[passage], block.answers[passage]
    here = set(region.tolist())
    weight = _weight(weights, wanted)
    share = float(weight[[w in here for w in wanted.tolist()]].sum() / weight.sum())
    common = common_subsequence(wanted.tolist(), region.tolist())
    there = np.array([w in here for w in answer.tolist()])
    found = bool(there.sum() >= settings.answer * len(answer))
    if firm and found:
        weight = _weight(weights, answer)
        found = bool(weight[there].sum() >= settings.answer * weight.sum())
    least = max(settings.paraphrase, settings.weight) if firm else settings.paraphrase
    return common, share, found, share >= settings.weight and (common >= settings.near * len(wanted) or found and common >= least * len(wanted))


def dense(block: Passages, weights: np.ndarray, settings: Settings, passage: int, region: np.ndarray) -> bool:
    """Whether a stretch of the passage's own length holds enough of it, as a copy or firmly."""
    wanted = block.tokens[passage]
    begins = np.flatnonzero(np.isin(region, wanted))
    return any(_stands(block, weights, settings, passage, region[k: k + len(wanted)], True)[3] for k in begins)


def check(block: Passages, weights: np.ndarray, settings: Settings, passage: int, region: np.ndarray) -> tuple[int, float, bool, float, bool]:
    """Common subsequence, share of weight, answer found, cosine, and the verdict on a passage and a window."""
    common, share, found, good = _stands(block, weights, settings, passage, region, False)
    near = cosine(weights, block.tokens[passage], region) if good else 0.0
    return common, share, found, near, good and (near >= settings.cosine or dense(block, weights, settings, passage, region))


def _loaded(passes: list) -> Iterator[tuple[Passages, np.ndarray]]:
    """Each block and the weights; of several passes a worker holds one at a time."""
    for shared in passes:
        blocks, weights = shared.value
        for block in blocks:
            yield block, weights
        if len(passes) > 1:
            blocks = block = None
            vars(shared).pop("_value", None)


def _hits(passes: list, settings: Settings, column: pa.Array):
    """``{(text, item): (part found, cosine, common, words, share, answer)}`` for the texts of a column; the best passage of each item."""
    hashes, offsets = words(*text_bytes(column))
    signed = hashes.view(np.int64)
    best: dict[tuple, tuple] = {}
    for block, weights in _loaded(passes):
        for t, a, b, p in candidates(block, weights, hashes, offsets):
            common, share, found, near, bad = check(block, weights, settings, p, signed[a:b])
            key, value = (t, block.items[p]), (common / len(block.tokens[p]), near, common, len(block.tokens[p]), share, found)
            if bad and (key not in best or value > best[key]):
                best[key] = value
    return best


SLICE = 1 << 20  # bytes of text that are searched at once
BLOCKS_AT_ONCE = 4  # blocks' words of the benchmark in one broadcast; bounds what a worker holds


def _passes(docs: DataFrame, benchmark: DataFrame, text: str, settings: Settings):
    weights = feature_weights(docs, text)
    held: list[Passages] = []
    for block in prepare(benchmark, weights, settings):
        if sum(len(t) for b in [*held, block] for t in b.tokens) > BLOCKS_AT_ONCE * settings.block_words and held:
            yield docs.sparkSession.sparkContext.broadcast((held, weights))
            held = []
        held.append(block)
    if held:
        yield docs.sparkSession.sparkContext.broadcast((held, weights))


def contamination(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row and benchmark item found in it:
    ``doc_id, item_id, cosine, common_words, passage_words, weight_share, answer_found``; the cosine is
    the largest of two neighbouring cells and the passage.

    Null and empty texts hold nothing; items that are null or shorter than ``min_words`` are not looked
    for; repeated items are found each; documents of equal or null id are searched each; other columns play
    no part; no documents or no items give no rows.
    """
    settings = settings or Settings()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    key, item = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {key}, item_id {item}, cosine double, common_words int, passage_words int, weight_share double, answer_found boolean"
    passes = list(_passes(rows, benchmark, "text", settings))

    def search(batches):
        claim("contamination")
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                hits = _hits(passes, settings, part.column("text"))
                if hits:
                    keys = list(hits)
                    columns = list(zip(*hits.values(), strict=True))
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id").take(pa.array([t for t, _ in keys])), pa.array([i for _, i in keys]), pa.array(columns[1]), pa.array(columns[2], pa.int32()),
                        pa.array(columns[3], pa.int32()), pa.array(columns[4]), pa.array(columns[5])], schema.replace(",", "").split()[::2])

    return rows.mapInArrow(search, schema) if passes else docs.sparkSession.createDataFrame([], schema)


def without_contamination(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which ``contamination`` finds nothing, with all their columns."""
    settings = settings or Settings()
    work = fresh(docs, "__text")
    kept = docs.withColumn(work, F.col(text).cast("string"))

    passes = list(_passes(docs, benchmark, text, settings))

    def keep(batches):
        claim("contamination")
        for batch in batches:
            for part in slices(batch, work, SLICE):
                bad = {t for t, _ in _hits(passes, settings, part.column(work))}
                yield part.filter(pa.array([t not in bad for t in range(part.num_rows)], pa.bool_()))

    return (kept.mapInArrow(keep, T.StructType(kept.schema.fields)) if passes else kept).drop(work)
