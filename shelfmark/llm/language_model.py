"""Scores of texts by a smoothed n-gram model as a weighted backoff automaton.

The model is every n-gram of the training texts up to ``order``.  A state is an n-gram that can
go on; its arcs lead along the n-grams that extend it, and its failure arc, taken when no arc has
the next word, leads to the state without the first word.  With Dirichlet smoothing

    arc      (c(h w) + mu * p(w | shorter h)) / (c(h) + mu)
    failure  mu / (c(h) + mu)

so a text's probability is the product along its one path.  Each block of texts has its part of the
automaton as tables: arcs sorted by state and word, failure arcs by state.  Its texts are walked from left to right
in step, one word of each at a time, each carrying its state and its sum of logarithms; a long text is walked in segments
of ``SEGMENT`` words, as the state depends on the last ``order - 1`` words alone.

The corpus is cut into blocks of texts.  A block sends each distinct n-gram once, with its count
in training texts, to the task that adds up that n-gram over all blocks, and gets the total back.
N-grams are 64-bit hashes (56 bits from order 2 on), sorted and stored as differences.  A block
never needs more of the model than its own n-grams, so nothing is broadcast and no n-gram is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrays import _BASE, claim, mix, slices, text_bytes, words
from shelfmark.session import stored

BLOCK = 1 << 19  # words of a block, unless one text has more
PART = 1 << 22  # words of the corpus for each task that adds up counts, at most
SEGMENT = 1024  # words of a text that are walked one after another
ALPHA = 0.1
START, END = np.uint64(0x5BD1E995A1B2C3D4), np.uint64(0xC2B2AE3D27D4EB4F)

_BLOCKS = "block long, doc_ids array<long>, held array<boolean>, lengths array<long>, vocabulary binary, stream binary"


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys: a byte for the width, then differences of that width."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, data[0])
    full = np.zeros((len(raw), 8), dtype=np.uint8)
    full[:, : data[0]] = raw
    return np.cumsum(full.reshape(-1).view("<u8"), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """One byte a count; those of 255 and more follow at the end."""
    large = counts[counts >= 255].astype("<i8")
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, dtype=np.uint8, count=n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, dtype="<i8", offset=n)
    return counts


class _Block:
    """The tokens of a block's texts, one text after another, each as START, its words, END."""

    def __init__(self, lengths: np.ndarray, vocabulary: np.ndarray, stream: np.ndarray, order: int):
        self.lengths, self.order = lengths, order
        total = int(lengths.sum()) + 2 * len(lengths)
        begins = np.cumsum(lengths + 2) - (lengths + 2)
        self.tokens = np.empty(total, dtype=np.uint64)
        inner = np.ones(total, dtype=bool)
        inner[begins] = inner[begins + lengths + 1] = False
        self.tokens[inner] = vocabulary[stream]
        self.tokens[begins], self.tokens[begins + lengths + 1] = START, END
        self.begins = begins
        self.place = np.arange(total) - np.repeat(begins, lengths + 2)  # START is 0

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the n-grams that end at each position, and the positions that have one."""
        at = np.flatnonzero(self.place >= max(1, order - 1))
        if order == 1:
            return self.tokens[at], at
        key = np.zeros(len(at), dtype=np.uint64)
        for k in range(order):
            key *= _BASE
            key += self.tokens[at - (order - 1 - k)]
        return mix(key) >> np.uint64(8), at

    def parted(self, order: int, parts: int):
        """Distinct keys sorted by part and key; where the parts end; the key of each position; the positions."""
        keys, at = self.grams(order)
        distinct, inverse = np.unique(keys, return_inverse=True)
        part = (distinct % np.uint64(parts)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        rank = np.empty(len(by_part), dtype=np.int64)
        rank[by_part] = np.arange(len(by_part))
        return distinct[by_part], np.cumsum(np.bincount(part, minlength=parts)), rank[inverse], at


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    def cut(batches):
        claim("language model")
        number, held = 0, []

        def row():
            nonlocal number, held
            ids, marks, hashes, lengths = zip(*held, strict=True)
            vocabulary, stream = np.unique(np.concatenate(hashes), return_inverse=True)
            out = pa.RecordBatch.from_pydict({
                "block": [(part << 32) + number], "doc_ids": [[d for some in ids for d in some]], "held": [[m for some in marks for m in some]],
                "lengths": [np.concatenate(lengths).tolist()], "vocabulary": [vocabulary.tobytes()], "stream": [stream.astype("<i4").tobytes()]}, schema=schema)
            number, held = number + 1, []
            return out

        size, part = 0, 0
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                part = piece.column("part")[0].as_py()
                hashes, offsets = words(*text_bytes(piece.column("text")))
                held.append((piece.column("doc_id").to_pylist(), piece.column("held_out").to_pylist(), hashes, np.diff(offsets)))
                size += len(hashes) + piece.num_rows
                if size >= block:
                    yield row()
                    size = 0
        if held:
            yield row()

    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("vocabulary", pa.binary()), ("stream", pa.binary())])
    return docs.select(F.spark_partition_id().alias("part"), "doc_id", "held_out", "text").mapInArrow(cut, _BLOCKS)


def _read(row: dict, order: int) -> _Block:
    return _Block(np.array(row["lengths"], dtype=np.int64), np.frombuffer(row["vocabulary"], dtype=np.uint64), np.frombuffer(row["stream"], dtype="<i4"), order)


def _requests(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """Each block's distinct n-grams by part, with their counts in its training texts."""

    def ask(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = _read(row, order)
                training = np.repeat(~np.array(row["held"], dtype=bool), block.lengths + 2)
                for n in range(1, order + 1):
                    keys, ends, of, at = block.parted(n, parts)
                    counts = np.bincount(of, training[at], len(keys)).astype(np.int64)
                    begin = np.concatenate([[0], ends[:-1]])
                    full = np.flatnonzero(ends > begin)
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array(full, pa.int32()), "order": pa.array([n] * len(full), pa.int32()), "block": pa.array([row["block"]] * len(full), pa.int64()),
                        "keys": pa.array([_pack_keys(keys[begin[p]: ends[p]]) for p in full], pa.binary()),
                        "counts": pa.array([_pack_counts(counts[begin[p]: ends[p]]) for p in full], pa.binary())})

    return blocks.select("block", "held", "lengths", "vocabulary", "stream").mapInArrow(ask, "part int, order int, block long, keys binary, counts binary")


def _totals(requests: DataFrame) -> DataFrame:
    """For each request, the totals over all blocks; ``types`` and ``tokens`` stand once per part and order."""

    def add(asked: pa.Table) -> pa.Table:
        keys = [_unpack_keys(k) for k in asked.column("keys").to_pylist()]
        sizes = np.array([len(k) for k in keys])
        counts = np.concatenate([_unpack_counts(c, n) for c, n in zip(asked.column("counts").to_pylist(), sizes, strict=True)])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inverse, counts).astype(np.int64)
        ends = np.cumsum(sizes)
        answers = [_pack_counts(sums[inverse[e - n: e]]) for e, n in zip(ends, sizes, strict=True)]
        rest = [0] * (len(sizes) - 1)
        return pa.table({"block": asked.column("block"), "order": asked.column("order"), "part": asked.column("part"), "totals": pa.array(answers, pa.binary()),
                         "types": pa.array([int((sums > 0).sum()), *rest], pa.int64()), "tokens": pa.array([int(sums.sum()), *rest], pa.int64())})

    return requests.groupBy("part", "order").applyInArrow(add, "block long, order int, part int, totals binary, types long, tokens long")


class Automaton:
    """The states and arcs that a block's texts can meet.  State 0 is the root, which has an arc for every word, state 1 the start."""

    def __init__(self, block: _Block, totals: dict[int, dict[int, bytes]], parts: int, tokens: int, types: int, mu: float):
        self.block = block
        order, n_tokens = block.order, len(block.tokens)
        gram: dict[int, np.ndarray] = {}  # by order: the n-gram that ends at each position
        last = np.flatnonzero(block.tokens == END)
        sources, labels, weights, goals = [], [], [], []
        self.fails, self.failures = [np.zeros(2, dtype=np.int64)], [np.zeros(2)]
        states, held = {}, 2
        for n in range(1, order + 1):
            keys, ends, of, at = block.parted(n, parts)
            begin = np.concatenate([[0], ends[:-1]])
            count = np.concatenate([np.zeros(0, dtype=np.int64), *(_unpack_counts(totals[n][p], int(ends[p] - begin[p])) for p in np.flatnonzero(ends > begin).tolist())])
            gram[n] = np.zeros(n_tokens, dtype=np.int64)
            gram[n][at] = of
            where = np.zeros(len(keys), dtype=np.int64)
            where[of] = at  # a place of each n-gram
            seen = count > 0
            if n == 1:
                self.word, self.known = gram[1], seen
                self.root = (count + ALPHA) / (tokens + ALPHA * (types + 1))
                p = self.root
                starts = count[gram[1][last[0]]] if len(last) else 0  # every text begins once, as often as it ends
                self.failures[0][1] = np.log10(mu / (starts + mu))
                suffix = np.zeros(len(keys), dtype=np.int64)
            else:
                begins = block.place[where - 1] == 0
                history = np.where(begins, starts, counts[gram[n - 1][where - 1]])
                p = (count + mu * p[gram[n - 1][where]]) / (history + mu)
                suffix = states[n - 1][gram[n - 1][where]]
                sources.append(np.where(begins, 1, states[n - 1][gram[n - 1][where - 1]])[seen])
                labels.append(gram[1][where][seen])
                weights.append(np.log10(p[seen]))
            if n < order:  # an n-gram that was seen is a state, any other stands for its longest part that is one
                states[n] = suffix.copy()
                states[n][seen] = held + np.arange(int(seen.sum()))
                held += int(seen.sum())
                self.fails.append(suffix[seen])
                self.failures.append(np.log10(mu / (count[seen] + mu)))
            if n > 1:
                goals.append((states[n] if n < order else suffix)[seen])
            counts = count
        self.start = min(1, order - 1)
        self.fails, self.failures = np.concatenate(self.fails), np.concatenate(self.failures)
        self.root_goals = states[1] if order > 1 else np.zeros(len(self.root), dtype=np.int64)
        self.root_weights = np.log10(self.root)
        none = np.zeros(0, dtype=np.int64)
        arcs = np.concatenate([none, *sources]) * len(self.root) + np.concatenate([none, *labels])
        by_arc = np.argsort(arcs)
        self.arcs = arcs[by_arc]
        self.weights, self.goals = np.concatenate([none, *weights])[by_arc], np.concatenate([none, *goals])[by_arc]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one word each, and the logarithms of the arcs taken."""
        state, weight = state.copy(), np.zeros(len(state))
        walking = np.arange(len(state))
        while len(walking):
            here, label = state[walking], word[walking]
            rooted = here == 0
            done = walking[rooted]
            weight[done] += self.root_weights[label[rooted]]
            state[done] = self.root_goals[label[rooted]]
            walking, here, label = walking[~rooted], here[~rooted], label[~rooted]
            if not len(walking):
                break
            wanted = here * len(self.root) + label
            place = np.minimum(np.searchsorted(self.arcs, wanted), max(0, len(self.arcs) - 1))
            found = self.arcs[place] == wanted if len(self.arcs) else np.zeros(len(walking), dtype=bool)
            taken = walking[found]
            weight[taken] += self.weights[place[found]]
            state[taken] = self.goals[place[found]]
            walking = walking[~found]
            weight[walking] += self.failures[here[~found]]
            state[walking] = self.fails[here[~found]]
        return state, weight

    def walk(self) -> np.ndarray:
        """The logarithm of each text's probability, its end included."""
        block, before = self.block, self.block.order - 1
        pieces = np.maximum(1, -(-(block.lengths + 1) // SEGMENT))
        text = np.repeat(np.arange(len(block.lengths)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = block.begins[text] + 1 + number * SEGMENT
        size = np.minimum(SEGMENT, block.begins[text] + block.lengths[text] + 2 - first)
        lead = np.where(number > 0, before, 0)  # words that only find the state
        state = np.where(number > 0, 0, self.start)
        at, left = first - lead, size + lead
        order = np.argsort(-left, kind="stable")
        text, at, left, lead, state = text[order], at[order], left[order], lead[order], state[order]
        total = np.zeros(len(text))
        for k in range(int(left[0]) if len(left) else 0):
            running = int(np.searchsorted(-left, -k))  # left > k
            state[:running], weight = self.step(state[:running], self.word[at[:running] + k])
            total[:running] += np.where(lead[:running] <= k, weight, 0.0)
        return np.bincount(text, total, len(block.lengths))

    def base(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: the root's logarithm alone, and how many tokens training texts have."""
        base, known = self.root_weights[self.word], self.known[self.word].astype(np.int64)
        base[self.block.begins] = known[self.block.begins] = 0
        return np.add.reduceat(base, self.block.begins), np.add.reduceat(known, self.block.begins)


def held_out(doc_id: str):
    """crc32 of the id as text, modulo 10, is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def score_texts(docs: DataFrame, order: int = 2, mu: float = 500.0, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    Trained on the rows that are not held out.  Scores are base-10 logarithms of the probability of the
    whole text with its end; ``base_score`` is the unigram root's.  A null or empty text is the end alone;
    a null id counts as the empty id; rows of equal id are scored each; a very long text is a block of its own, walked in
    segments; other columns play no part; with no training rows every count is 0; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    blocks = stored(_blocks(rows, block), "lm-blocks")
    words_held = blocks.agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n)), F.lit(0))).first()[0]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words_held // PART))
    totals = stored(_totals(_requests(blocks, order, parts)), "lm-totals")
    size = totals.where("order = 1").agg(F.coalesce(F.sum("types"), F.lit(0)).alias("types"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    types, tokens = size.types, size.tokens
    answers = totals.groupBy("block").agg(F.collect_list(F.struct("order", "part", "totals")).alias("answers"))  # as many as one block asked for

    def traverse(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                found: dict[int, dict[int, bytes]] = {}
                for answer in row.pop("answers"):
                    found.setdefault(answer["order"], {})[answer["part"]] = answer["totals"]
                texts = _read(row, order)
                automaton = Automaton(texts, found, parts, tokens, types, mu)
                base, known = automaton.base()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"]), pa.array(texts.lengths + 1), pa.array(known),
                     pa.array(np.full(len(texts.lengths), tokens)), pa.array(base), pa.array(automaton.walk())],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return blocks.join(answers, "block").drop("block").mapInArrow(
        traverse, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
