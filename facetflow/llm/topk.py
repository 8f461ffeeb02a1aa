"""Exact top-k search by integer inner products, term at a time over all rows.

Every vector becomes a sparse row of terms and integer weights. Rows and queries are dealt over a grid of cells: a row goes to its
share of the rows, once for each share of the queries, and the other way round, so each query meets each row in one cell. A cell
keeps its queries and reads its rows in batches. A batch is turned into postings, one list a term; each query scatters its weights times
the postings into a dense score array, and a partition of the array selects its best rows. A cell keeps k rows a query; the cells' rows
are merged by a window over each query.

No score is skipped or estimated. Scores are summed in doubles where no sum can reach 2^53, else in 64-bit integers where none can
pass them, else in Python's.

Defined results: vectors that are null or hold null or non-finite components take no part; an empty vector and missing components count as
zeros, so vectors of different lengths meet; repeated terms of a sparse row add up; a row is no candidate of its own, but of another
row with the same vec_id; ties go to the smaller vec_id, null ids last; null ids are candidates and no queries; components and scores
beyond 64 bits are the nearest 64-bit number; an empty table gives an empty result; extra columns are left out. Memory of a task: the
queries of a cell (QUERIES sparse rows and k results each) and one Arrow batch of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .pieces import arrow_map

SCALE, K = 1024, 10
#: Rows and queries of a cell, about.
ROWS, QUERIES = 1 << 20, 1 << 15
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def sparse_rows(vectors: DataFrame, vector: str = "embedding", indices: str | None = None, scale: float = SCALE) -> DataFrame:
    """row (a number of its own), vec_id, terms, weights of the vectors that take part: weights floor(scale * component) other than 0, terms
    their positions or, with `indices`, the numbers beside them. It is written, so a row keeps its number."""

    def run(batches):
        for batch in batches:
            column = batch.column("v")
            flat, lens = column.flatten(), np.diff(column.offsets.to_numpy())
            lens[column.is_null().to_numpy(zero_copy_only=False)] = 0
            row = np.repeat(np.arange(batch.num_rows), lens)
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            if "t" in batch.schema.names:
                numbers = batch.column("t")
                sizes = np.where(numbers.is_null().to_numpy(zero_copy_only=False), 0, np.diff(numbers.offsets.to_numpy()))
                if (sizes != lens).any() or numbers.flatten().null_count:
                    raise ValueError("each component needs a term")
                term = numbers.flatten().to_numpy().astype(np.int64)
            else:
                term = np.arange(len(x)) - np.repeat(np.cumsum(lens) - lens, lens)
            good = ~column.is_null().to_numpy(zero_copy_only=False)
            good[row[~np.isfinite(x)]] = False
            with np.errstate(over="ignore", invalid="ignore"):
                w = np.floor(scale * x)
            whole = np.where(w >= 2.0**63, _HIGH, np.where(w < -(2.0**63), _LOW, 0)).astype(np.int64)
            small = np.abs(w) < 2.0**63
            whole[small] = w[small].astype(np.int64)
            stay = good[row] & (whole != 0)
            ends = np.cumsum(np.bincount(row[stay], minlength=batch.num_rows)[good])
            offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(a[stay])) for a in (term, whole)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), *lists], ["vec_id", "terms", "weights"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), *([F.col(indices).cast("array<long>").alias("t")] if indices else []))
    return cut(arrow_map(rows, run, "vec_id long, terms array<long>, weights array<long>").withColumn("row", F.monotonically_increasing_id()), "sparse-rows")


class Rows:
    """Sparse rows of some Arrow batches, ordered by vec_id with nulls last."""

    def __init__(self, table: pa.Table):
        ids = table.column("vec_id")
        table = table.take(np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy())))
        self.none = table.column("vec_id").is_null().to_numpy()
        self.ids = table.column("vec_id").fill_null(0).to_numpy()
        self.row = table.column("row").to_numpy()
        terms, weights = (table.column(c).combine_chunks() for c in ("terms", "weights"))
        self.offsets = terms.offsets.to_numpy() - terms.offsets[0].as_py()
        self.terms, self.weights = terms.flatten().to_numpy(), weights.flatten().to_numpy()
        at = np.repeat(np.arange(len(self)), np.diff(self.offsets))
        order = np.lexsort((self.terms, at))
        self.terms, self.weights, at = self.terms[order], self.weights[order], at[order]
        fresh = np.concatenate(([True], (np.diff(self.terms) != 0) | (np.diff(at) != 0)))[: len(at)]
        if not fresh.all():  # repeated terms add up
            first = np.flatnonzero(fresh)
            sums = np.add.reduceat(self.weights.astype(object), first)
            self.weights = np.array([min(_HIGH, max(_LOW, x)) for x in sums], np.int64)
            self.terms, at = self.terms[first], at[first]
            self.offsets = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(self)))))
        self.at = at

    def __len__(self) -> int:
        return len(self.row)

    def size(self) -> tuple[int, int]:
        """(largest magnitude of a weight, most terms of a row)."""
        most = max(int(self.weights.max()), -int(self.weights.min())) if len(self.weights) else 0
        return most, int(np.diff(self.offsets).max(initial=0))

    def postings(self, kind) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
        """(rows, weights) by term; where a term is in half of the rows, None and a weight for every row."""
        order = np.argsort(self.terms, kind="stable")
        terms, rows, weights = self.terms[order], self.at[order], self.weights[order].astype(kind)
        edge = np.flatnonzero(np.concatenate(([True], np.diff(terms) != 0, [True]))) if len(terms) else [0]
        out = {}
        for a, b in zip(edge[:-1], edge[1:]):
            r, w = rows[a:b], weights[a:b]
            if 2 * len(r) >= len(self):
                every = np.zeros(len(self), kind)
                every[r] = w
                r, w = None, every
            out[int(terms[a])] = r, w
        return out


def kind_of(queries: Rows, rows: Rows):
    """The numbers that hold every sum of products exactly."""
    (a, n), (b, m) = queries.size(), rows.size()
    most = a * b * min(n, m)
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def whole_scores(acc: np.ndarray) -> np.ndarray:
    if acc.dtype == object:
        return np.array([min(_HIGH, max(_LOW, x)) for x in acc], np.int64)
    return acc


def best(scores: np.ndarray, k: int, least) -> np.ndarray:
    """Positions of the k largest scores of at least `least`, the first of equal ones."""
    at = np.flatnonzero(scores >= least)
    if len(at) > k:
        s = scores[at]
        bound = np.partition(s, len(s) - k)[len(s) - k]
        over = at[s > bound]
        at = np.concatenate((over, at[s == bound][: k - len(over)]))
    return at


class Tops:
    """The k best rows so far of each query of a cell."""

    def __init__(self, queries: Rows, k: int):
        n = len(queries)
        self.queries, self.k = queries, k
        self.n = np.zeros(n, np.int64)
        self.score, self.ids, self.none = np.full((n, k), _LOW, np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def meet(self, rows: Rows) -> None:
        q, k = self.queries, self.k
        kind = kind_of(q, rows)
        lists = rows.postings(kind)
        weights = q.weights.astype(kind)
        acc, part = np.zeros(len(rows), kind), np.zeros(len(rows), kind)
        own = dict(zip(rows.row.tolist(), range(len(rows))))
        for i, (a, b) in enumerate(zip(q.offsets[:-1].tolist(), q.offsets[1:].tolist())):
            acc[:] = 0
            for t, w in zip(q.terms[a:b].tolist(), weights[a:b].tolist()):
                hit = lists.get(t)
                if hit is None:
                    continue
                if hit[0] is None:
                    acc += np.multiply(hit[1], w, out=part)
                else:
                    acc[hit[0]] += w * hit[1]
            self._take(i, whole_scores(acc), own.get(int(q.row[i])), rows)

    def _take(self, i: int, scores: np.ndarray, own: int | None, rows: Rows) -> None:
        k, have = self.k, int(self.n[i])
        at = best(scores, k + (own is not None), self.score[i, k - 1] if have == k else _LOW)
        if own is not None:
            at = at[at != own]
        if not len(at):
            return
        score = np.concatenate((self.score[i, :have], scores[at].astype(np.int64)))
        ids, none = np.concatenate((self.ids[i, :have], rows.ids[at])), np.concatenate((self.none[i, :have], rows.none[at]))
        order = np.lexsort((ids, none, ~score))[:k]
        self.n[i] = n = len(order)
        self.score[i, :n], self.ids[i, :n], self.none[i, :n] = score[order], ids[order], none[order]

    def batch(self) -> pa.RecordBatch:
        some = np.arange(self.k)[None, :] < self.n[:, None]
        q = np.repeat(np.arange(len(self.n)), self.n)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.queries.row[q]), pa.array(self.queries.ids[q]), pa.array(self.ids[some], mask=self.none[some]), pa.array(self.score[some])],
            ["q_row", "query_id", "vec_id", "score"],
        )


def _cells(k: int):
    """Rows sorted by cell, a cell's queries first: each cell's (q_row, query_id, vec_id, score)."""

    def run(batches):
        cell, asked, tops = None, [], None
        for batch in batches:
            cells = (batch.column("r").to_numpy() << 32) | batch.column("s").to_numpy()
            asks = batch.column("kind").to_numpy() == 0
            edge = np.flatnonzero(np.concatenate(([True], (np.diff(cells) != 0) | (np.diff(asks) != 0), [True]))).tolist() if len(cells) else []
            for a, b in zip(edge[:-1], edge[1:]):
                if cells[a] != cell:
                    if tops is not None:
                        yield tops.batch()
                    cell, asked, tops = cells[a], [], None
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if asks[a]:
                    asked.append(part)
                elif asked or tops is not None:
                    if tops is None:
                        tops, asked = Tops(Rows(pa.concat_tables(asked)), k), []
                    tops.meet(Rows(part))
        if tops is not None:
            yield tops.batch()

    return run


def search(rows: DataFrame, is_query: Column, k: int = K, cell_rows: int = ROWS, cell_queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all of sparse_rows() for each of its rows where is_query holds (a condition on vec_id)."""
    rows = rows.withColumn("asks", F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull())
    size = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    cores, dealt = rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down = max(1, -(-size["q"] // cell_queries))
    across = max(1, -(-size["n"] // cell_rows), 2 * cores // down)
    share = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cols = ["kind", "row", "vec_id", "terms", "weights"]
    index = rows.withColumn("kind", F.lit(1)).select(share(across).cast("long").alias("r"), every(down).alias("s"), *cols)
    asked = rows.where("asks").withColumn("kind", F.lit(0)).select(every(across).alias("r"), share(down).cast("long").alias("s"), *cols)
    cells = asked.unionByName(index).repartition(min(across * down, 4 * max(cores, dealt)), "r", "s").sortWithinPartitions("r", "s", "kind")
    found = arrow_map(cells, _cells(k), "q_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 1 ELSE 0 END)) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.r <> v.r WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10
"""
