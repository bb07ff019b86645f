"""Exact vector ranking of many queries against a catalogue, without a row-level cross join.

Each task multiplies its catalogue rows with a block of query vectors and keeps
only the best ``need`` rows per query, so what is shuffled is tasks x queries x
need and never queries x rows.  Category limits and the lexical bonus are applied
to the score block before the cut.

The query block is broadcast when it is proven small (``MAX_BROADCAST_QUERIES``
rows and ``QUERY_BYTES``).  Of more queries, those with one vector, scope and terms are ranked once,
and what is left goes round by round, each round a block of ``ROUND_QUERIES``.

Without terms a block is multiplied in single precision first.  Only pairs that its greatest error could
lift over a floor are scored in double precision.  What a task holds is bounded: long lists are
handed on in pieces.

Scores are rounded to ``SCORE_DIGITS`` before ordering.  That is finer than
single precision and makes the order independent of how the rows were batched;
equal scores are ordered by ``row_index``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import vocabulary as V
from shelfmark.functions import vectors as VX
from shelfmark.functions.staging import SPREAD_BELOW, spread
from shelfmark.operators.ordering import top_n
from shelfmark.operators.terms import TermAutomaton
from shelfmark.session import stored, work_dir

SCORE_DIGITS = 7
MAX_BROADCAST_QUERIES = 4096
ROUND_QUERIES = 16384
QUERY_BYTES = 64 << 20  # of the vectors in one block
_QUERY_CHUNK = 256
_HIT_CELLS = 4_000_000  # rows x terms of one hit table
_ROWS = 8192  # scored at once
_PAIRS = 1 << 16  # scored at once in double precision
_HELD = 1 << 21  # rows of all lists that a task holds before it hands them on
_SINGLE_MOST = 1e15  # longest vector whose products fit single precision
_OUT = "query_id long, row_index long, score double"
_OUT_ARROW = pa.schema([("query_id", pa.int64()), ("row_index", pa.int64()), ("score", pa.float64())])


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


class _Queries:
    """One block of queries, ready to be scored against batches of rows."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids = table["query_id"].to_numpy()
        self.need = table["need"].to_numpy()
        self.vectors = _matrix(table["vector"].combine_chunks())
        self.lengths = np.linalg.norm(self.vectors, axis=1)
        scopes = table["scope"].to_pylist() if "scope" in table.column_names else [None] * len(self.ids)
        # scope codes: -1 stands for the whole catalogue
        self.scope_names = sorted({s for s in scopes if s is not None})
        code = {name: i for i, name in enumerate(self.scope_names)}
        self.scopes = np.array([-1 if s is None else code[s] for s in scopes], dtype=np.int64)
        terms = table["terms"].to_pylist() if "terms" in table.column_names else []
        self.terms = sorted({t for wanted in terms for t in wanted or ()})
        place = {term: i for i, term in enumerate(self.terms)}
        self.automaton = TermAutomaton(self.terms)
        self.wanted = [np.array(sorted({place[t] for t in wanted or ()}), dtype=np.int64) for wanted in terms]

    def wants(self, chunk: slice) -> np.ndarray:
        """Which terms some queries look for, queries x terms; dense for one chunk at a time."""
        lists = self.wanted[chunk]
        table = np.zeros((len(lists), len(self.terms)), dtype=np.float32)
        for row, places in enumerate(lists):
            table[row, places] = 1.0
        return table

    def row_scopes(self, batch: pa.RecordBatch) -> np.ndarray | None:
        if not self.scope_names:
            return None
        found = pc.index_in(batch.column("scope"), value_set=pa.array(self.scope_names, pa.string()))
        return pc.fill_null(found, -2).to_numpy(zero_copy_only=False)


class _Hits:
    """Which terms the rows of a slice hold: looked for once in each row, whatever the number of query chunks."""

    def __init__(self, automaton: TermAutomaton, texts: pa.Array):
        self.automaton, self.texts = automaton, texts
        self.table = np.zeros((len(texts), automaton.count), dtype=np.float32)
        self.known = np.zeros(len(texts), dtype=bool)

    def of(self, rows: np.ndarray) -> np.ndarray:
        new = rows[~self.known[rows]]
        if len(new):
            self.table[new] = self.automaton.hits(self.texts.take(pa.array(new)))
            self.known[new] = True
        return self.table if len(rows) == len(self.table) else self.table[rows]


class _Best:
    """The best rows seen so far for each query of a block."""

    def __init__(self, queries: _Queries):
        self.queries = queries
        self.floor = np.full(len(queries.ids), -np.inf)
        self.held = 0
        self._clear()

    def _clear(self) -> None:
        self.rows = [np.empty(0, np.int64)] * len(self.queries.ids)
        self.scores = [np.empty(0)] * len(self.queries.ids)
        self.held = 0

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Takes in a batch; gives lists that have become too long to hold."""
        step = min(_ROWS, max(64, _HIT_CELLS // max(1, len(self.queries.terms))))
        for start in range(0, batch.num_rows, step):
            yield from self._add(batch.slice(start, step))

    def _add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q = self.queries
        row_index = batch.column("row_index").to_numpy()
        matrix, scopes = _matrix(batch.column("embedding")), q.row_scopes(batch)
        lengths = np.linalg.norm(matrix, axis=1)
        longest = float(lengths.max(initial=0.0))
        single = not q.terms and longest < _SINGLE_MOST and float(q.lengths.max(initial=0.0)) < _SINGLE_MOST
        narrow = matrix.astype(np.float32) if single else None
        hits = _Hits(q.automaton, batch.column("descriptor")) if q.terms else None
        for start in range(0, len(q.ids), _QUERY_CHUNK):
            chunk = slice(start, start + _QUERY_CHUNK)
            outside = None
            if scopes is not None:
                wanted = q.scopes[chunk, None]
                outside = (wanted != -1) & (wanted != scopes[None, :])
            if single:
                hit_query, hit_row = self._near(chunk, narrow, longest, outside)
                scores = self._exact(chunk, matrix, hit_query, hit_row)
            else:
                block = self._block(chunk, hits, matrix, outside)
                hit_query, hit_row = np.nonzero(block >= self.floor[chunk, None] - 10.0 ** -SCORE_DIGITS)
                scores = block[hit_query, hit_row]
            scores = np.round(scores, SCORE_DIGITS)
            good = scores >= self.floor[chunk][hit_query]
            hit_query, hit_row, scores = hit_query[good], hit_row[good], scores[good]
            edges = np.searchsorted(hit_query, np.arange(len(q.ids[chunk]) + 1))
            for i in np.flatnonzero(np.diff(edges)):
                part = slice(edges[i], edges[i + 1])
                self._merge(start + i, row_index[hit_row[part]], scores[part])
            if self.held > _HELD:
                yield from self.result()
                self._clear()  # the floors stay: as many rows as are needed have been handed on from above them

    def _block(self, chunk: slice, hits: _Hits | None, matrix: np.ndarray, outside: np.ndarray | None) -> np.ndarray:
        """All scores of a chunk in double precision, with the bonus of terms; not a number outside the scope."""
        q = self.queries
        scores = q.vectors[chunk] @ matrix.T
        if outside is not None:
            scores[outside] = np.nan
        if q.terms:  # words are looked at only in rows that the greatest bonus could lift over a floor
            near = np.flatnonzero((scores + (V.BONUS_CAP + 10.0 ** -SCORE_DIGITS) >= self.floor[chunk, None]).any(axis=0))
            scores[:, near] += np.minimum(V.BONUS_CAP, (q.wants(chunk) @ hits.of(near).T).astype(np.float64) * V.BONUS_STEP)
        return scores

    def _near(self, chunk: slice, narrow: np.ndarray, longest: float, outside: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose score may reach the floor, by products in single precision and their greatest error."""
        q = self.queries
        scores = q.vectors[chunk].astype(np.float32) @ narrow.T
        if outside is not None:
            scores[outside] = -np.inf
        error = (narrow.shape[1] + 8) * 2.0 ** -23 * q.lengths[chunk] * longest + 1e-30
        floor = self.floor[chunk].copy()
        for need in np.unique(q.need[chunk][np.isneginf(floor)]):  # a new list begins above the best of some rows
            if need < scores.shape[1]:
                new = np.flatnonzero(np.isneginf(floor) & (q.need[chunk] == need))
                some = scores[new, :max(512, 16 * int(need))]
                floor[new] = np.partition(some, -need, axis=1)[:, -need] - error[new]
        least = floor - error - 10.0 ** -SCORE_DIGITS
        bound = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        return np.nonzero((scores >= bound[:, None]) & (scores > -np.inf))

    def _exact(self, chunk: slice, matrix: np.ndarray, hit_query: np.ndarray, hit_row: np.ndarray) -> np.ndarray:
        vectors = self.queries.vectors[chunk]
        parts = [slice(start, start + _PAIRS) for start in range(0, len(hit_query), _PAIRS)]
        return np.concatenate([np.empty(0), *[np.einsum("ij,ij->i", vectors[hit_query[p]], matrix[hit_row[p]]) for p in parts]])

    def _merge(self, query: int, rows: np.ndarray, scores: np.ndarray) -> None:
        need, before = self.queries.need[query], len(self.rows[query])
        rows = np.concatenate([self.rows[query], rows])
        scores = np.concatenate([self.scores[query], scores])
        if len(rows) > need:
            keep = np.lexsort((rows, -scores))[:need]
            rows, scores = rows[keep], scores[keep]
        if len(rows) == need and need:
            self.floor[query] = max(self.floor[query], scores.min())
        self.held += len(rows) - before
        self.rows[query], self.scores[query] = rows, scores

    def result(self) -> Iterator[pa.RecordBatch]:
        counts = [len(r) for r in self.rows]
        ends = np.cumsum(counts)
        first = 0
        while first < len(counts):  # lists of about _PAIRS rows together
            after = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _PAIRS, side="right")))
            part = slice(first, after)
            yield pa.record_batch(
                [
                    pa.array(np.repeat(self.queries.ids[part], counts[part]), pa.int64()),
                    pa.array(np.concatenate(self.rows[part]), pa.int64()),
                    pa.array(np.concatenate(self.scores[part]), pa.float64()),
                ],
                schema=_OUT_ARROW,
            )
            first = after


def best_rows(
    items: DataFrame, queries: DataFrame, dim: int, max_broadcast: int = MAX_BROADCAST_QUERIES
) -> DataFrame:
    """``query_id, rank, row_index, score`` of the best ``need`` rows of each query.

    ``items``: ``row_index, embedding`` and, when used, ``scope`` and ``descriptor``.
    ``queries``: ``query_id, vector, need`` and, when used, ``scope`` (null for the
    whole catalogue) and ``terms`` (for the lexical bonus).  Rows whose vector is not
    complete or not ``dim`` long are left out.
    """
    most = max(1, min(max_broadcast, QUERY_BYTES // (8 * dim)))
    columns = ["row_index", "embedding"]
    columns += ["scope"] if "scope" in queries.columns else []
    columns += ["descriptor"] if "terms" in queries.columns else []
    usable = items.select(*columns).filter(VX.is_complete(F.col("embedding"), dim))
    queries = queries.filter(F.col("need") > 0).withColumn("query_id", F.col("query_id").cast("long"))

    head = queries.limit(most + 1).toArrow()
    if head.num_rows <= most and _term_bytes(head) <= QUERY_BYTES:
        return _cut_to_need(_ranked_block(usable, head), _needs_of(items.sparkSession, head))
    return _ranked_groups(usable, queries, most, dim)


def _cut_to_need(ranked: DataFrame, needs: DataFrame | None) -> DataFrame:
    return ranked if needs is None else ranked.join(needs, "query_id").filter(F.col("rank") <= F.col("need")).drop("need")


def _ranked(candidates: DataFrame, need: int) -> DataFrame:
    return top_n(candidates, ["query_id"], [F.desc("score"), F.asc("row_index")], int(need))


def _ranked_block(items: DataFrame, head: pa.Table) -> DataFrame:
    return _ranked(_score_broadcast(items, head), max(head["need"].to_pylist(), default=1))


def _ranked_groups(items: DataFrame, queries: DataFrame, most: int, dim: int) -> DataFrame:
    """Queries with one vector, scope and terms get their lists from the first of them, ranked as far as any of them needs."""
    content = [n for n in ("vector", "scope", "terms") if n in queries.columns]
    keyed = stored(queries.withColumn("__key", F.sha2(F.to_json(F.struct(*content)), 256)), "queries")
    groups = keyed.groupBy("__key").agg(
        F.min("query_id").alias("query_id"), F.max("need").alias("need"), *[F.first(n).alias(n) for n in content])
    groups = stored(groups, "groups")
    firsts = groups.drop("__key")
    head = firsts.limit(most + 1).toArrow()
    if head.num_rows <= most and _term_bytes(head) <= QUERY_BYTES:
        ranked = _ranked_block(items, head)
    else:
        rounds = min(ROUND_QUERIES, QUERY_BYTES // (8 * dim)) if most == MAX_BROADCAST_QUERIES else most
        ranked = _ranked(_score_rounds(items, firsts, max(1, rounds), dim), firsts.agg(F.max("need")).first()[0])
    asked = keyed.select("__key", "query_id", "need").join(groups.select("__key", F.col("query_id").alias("__first")), "__key")
    named = ranked.withColumnRenamed("query_id", "__first").join(asked.drop("__key"), "__first")
    return named.filter(F.col("rank") <= F.col("need")).select("query_id", "row_index", "score", "rank")


def _term_bytes(head: pa.Table) -> int:
    return head["terms"].nbytes if "terms" in head.column_names else 0


def _needs_of(spark, head: pa.Table) -> DataFrame | None:
    """The needs of a broadcast block as a local table, or None when all are the same."""
    if len(set(head["need"].to_pylist())) <= 1:
        return None
    return spark.createDataFrame(head.select(["query_id", "need"]))


def _score_broadcast(items: DataFrame, head: pa.Table) -> DataFrame:
    if head.num_rows == 0:
        return items.sparkSession.createDataFrame([], _OUT)
    shared = items.sparkSession.sparkContext.broadcast(_Queries(head))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(shared.value)
        for batch in batches:
            yield from best.add(batch)
        yield from best.result()

    return items.mapInArrow(score, _OUT)


def _score_rounds(items: DataFrame, queries: DataFrame, most: int, dim: int) -> DataFrame:
    """Queries in rounds of about ``most``: each is broadcast after it was counted, and its lists are written on their own.

    Rows are never copied or shuffled, whatever the number of queries.
    """
    spark = items.sparkSession
    terms = F.length(F.array_join("terms", "  ")) if "terms" in queries.columns else F.lit(0)
    sized = stored(queries.withColumn("__bytes", F.lit(8 * dim) + F.coalesce(terms, F.lit(0))), "queries")
    items = stored(spread(items, SPREAD_BELOW), "items")
    count, size, widest = sized.agg(F.count("*"), F.sum("__bytes"), F.max("__bytes")).first()
    rounds = max(math.ceil(count / most), math.ceil(size / QUERY_BYTES))
    while True:
        dealt = sized.withColumn("__round", F.pmod(F.xxhash64("query_id"), F.lit(rounds)).cast("int"))
        rows, largest = dealt.groupBy("__round").agg(F.count("*").alias("n"), F.sum("__bytes").alias("b")).agg(F.max("n"), F.max("b")).first()
        if rows <= 2 * most + 64 and largest <= 2 * max(QUERY_BYTES, widest):
            break
        rounds *= 2
    folder, blocks = work_dir(spark, "ranked"), work_dir(spark, "rounds")
    dealt.drop("__bytes").repartition("__round").write.partitionBy("__round").parquet(blocks)
    filled = sorted(row[0] for row in dealt.select("__round").distinct().collect())  # numbers of rounds
    for number in filled:
        block = spark.read.schema(queries.schema).parquet(f"{blocks}/__round={number}").toArrow()  # counted above
        _score_broadcast(items, block).write.parquet(f"{folder}/round={number}")
    return spark.read.schema(_OUT).parquet(*[f"{folder}/round={number}" for number in filled])
