"""Near-duplicate embeddings by product quantisation, within equal labels.

Equal vectors are one class. A coarse quantiser and the codebooks of residual subspaces are fitted on a bounded sample; every
class gets a cell, a residual code with its error, and the cells to probe. The coarse quantiser has as many levels as the rows ask for:
one of up to LEVEL_CENTRES centres, then further ones of centres for what the levels before leave over, so that cells grow with the
rows though the sample is bounded. Each probe meets its cell's inverted list (dealt out in blocks where a list is long): table lookups
give asymmetric distances, a pair stays unless its distance less the code's error proves it too far, and the exact cosine in double
precision decides. The number of probes is calibrated on the sample: it covers `probe_recall` both of partners placed at exactly the
threshold from sample vectors and of pairs of sample vectors at or over it; two classes are missed only if both miss.

A block is compared some hundred probes at a time and keeps counts and roots, never its pairs.

Defined results: null vectors, zero vectors and those with null, NaN or infinite components link with nothing, as do null labels;
vectors of different lengths never link; a null vec_id has a null component and no links; rows that repeat a vec_id count as vectors of
their own, each by its embedding; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import cut
from .pieces import arrow_map

THRESHOLD, PROBE_RECALL = 0.93, 0.99
#: Vectors that the quantisers are fitted on, and that calibrate the probes; vectors of a cell as planned; centres of a coarse level.
SAMPLE, CELL, LEVEL_CENTRES = 16_384, 128, 2_048
SUBSPACES, CODES = 8, 128
#: Index rows and probes of one block comparison, probes of one slice of it, and pairs of one exact comparison.
BLOCK_INDEX, BLOCK_PROBES, SLICE, EXACT = 4_096, 8_192, 128, 32_768


def kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k centres of x, from evenly spaced rows on; fixed for given rows."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        a = nearest(x, centres)
        n = np.bincount(a, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, a, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 2048], centres).argmin(1) for i in range(0, len(x), 2048)]) if len(x) else np.empty(0, int)


def level_sizes(rows: int, sample: int, cell: int = CELL, level_centres: int = LEVEL_CENTRES) -> list[int]:
    """Centres of each coarse level, for about rows / cell cells in all."""
    cells, most, out = max(1, rows // cell), max(1, min(level_centres, sample // 4)), []
    while cells > most > 1:
        out.append(most)
        cells = -(-cells // most)
    return [*out, min(cells, most)]


class Quantiser:
    """Coarse cells of one or more levels, residual codebooks and the calibrated number of probes, for unit vectors padded to a multiple
    of SUBSPACES. A cell is the number that its centres of all levels make; its centre is their sum."""

    def __init__(self, sample: np.ndarray, rows: int, threshold: float, probe_recall: float, cell: int = CELL, level_centres: int = LEVEL_CENTRES):
        self.levels: list[np.ndarray] = []
        residual = sample
        for k in level_sizes(rows, len(sample), cell, level_centres):
            self.levels.append(kmeans(residual, k))
            residual = residual - self.levels[-1][nearest(residual, self.levels[-1])]
        self.books = [kmeans(part, min(CODES, len(sample))) for part in np.split(residual, SUBSPACES, 1)]
        rng = np.random.default_rng(9)
        x = sample[:4096]
        side = rng.standard_normal(x.shape)
        side -= (side * x).sum(1, keepdims=True) * x
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        placed = threshold * x + np.sqrt(1 - threshold**2) * side
        i, j = self._near(sample, threshold)
        every = int(np.prod([len(c) for c in self.levels]))
        beam = min(every, 256)
        while True:
            self.beam = beam
            needed = [self._rank(x, placed)] + ([self._rank(sample[i], sample[j])] if len(i) >= 100 else [])
            self.probes = max(int(np.quantile(r, probe_recall, method="higher")) + 1 for r in needed)
            if self.probes <= beam or beam == every:
                break
            beam = min(every, 4 * beam)
        self.probes = min(self.probes, every)
        self.beam = min(every, max(2 * self.probes, 16))

    @staticmethod
    def _near(sample: np.ndarray, threshold: float, most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the sample at or over the threshold, at most `most` of them."""
        i, j, have = [], [], 0
        for at in range(0, len(sample), 512):
            a, b = np.nonzero(np.triu(sample[at : at + 512] @ sample.T >= threshold, at + 1))
            i.append(a + at)
            j.append(b)
            have += len(a)
            if have >= most:
                break
        return np.concatenate(i)[:most], np.concatenate(j)[:most]

    def _rank(self, x: np.ndarray, partner: np.ndarray) -> np.ndarray:
        """How many cells of the probing order of x come before its partner's cell; the beam's width where it isn't among them."""
        same = self.cells(x)[0] == self.cells(partner)[0][:, :1]
        return np.where(same.any(1), same.argmax(1), max(self.beam, same.shape[1]))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, residual to the first) of each vector: the first is its own, found level by level, then the nearest others of a beam."""
        out, rest = [], []
        widest = max(map(len, self.levels)) * (self.beam if len(self.levels) > 1 else 1)
        step = min(1024, max(1, (1 << 22) // widest))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            cell, left = np.zeros((len(part), 1), np.int64), part[:, None, :]
            own, own_left = np.zeros(len(part), np.int64), part
            for centres in self.levels:
                best = distances(own_left, centres).argmin(1)
                own, own_left = own * len(centres) + best, own_left - centres[best]
                n, b, dim = left.shape
                d = distances(left.reshape(n * b, dim), centres).reshape(n, b * len(centres))
                keep = min(self.beam, d.shape[1])
                order = np.argpartition(d, keep - 1, 1)[:, :keep] if keep < d.shape[1] else np.tile(np.arange(keep), (n, 1))
                order = np.take_along_axis(order, np.argsort(np.take_along_axis(d, order, 1), 1, kind="stable"), 1)
                parent, child = order // len(centres), order % len(centres)
                cell = np.take_along_axis(cell, parent, 1) * len(centres) + child
                left = np.take_along_axis(left, parent[:, :, None], 1) - centres[child]
            first = (cell == own[:, None]).argmax(1)
            first = np.where(cell[np.arange(len(cell)), first] == own, first, cell.shape[1] - 1)
            order = np.arange(cell.shape[1])[None, :] - (np.arange(cell.shape[1])[None, :] <= first[:, None])  # shift those before it by one
            order = np.where(np.arange(cell.shape[1])[None, :] == 0, first[:, None], order)
            cell = np.take_along_axis(cell, order, 1)
            cell[:, 0] = own
            out.append(cell)
            rest.append(own_left)
        return np.concatenate(out), np.concatenate(rest)

    def centre(self, cell: int) -> np.ndarray:
        total = 0
        for centres in reversed(self.levels):
            cell, i = divmod(cell, len(centres))
            total = total + centres[i]
        return total

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, probes, codes, error) of each vector."""
        cells, residual = self.cells(x)
        codes = np.stack([nearest(part, book) for part, book in zip(np.split(residual, SUBSPACES, 1), self.books)], 1)
        back = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)
        return cells[:, 0], cells[:, : self.probes], codes.astype(np.uint8), np.linalg.norm(residual - back, axis=1)

    def lookup(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances of queries to coded vectors of a cell, from one table a subspace."""
        out = np.zeros((len(queries), len(codes)), np.float32)
        for i, (part, book) in enumerate(zip(np.split(queries - self.centre(cell), SUBSPACES, 1), self.books)):
            out += distances(part, book).astype(np.float32)[:, codes[:, i]]
        return out


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Unit rows in double precision, padded with zeros to width."""
    lens = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy().astype(np.float64)
    row = np.repeat(np.arange(len(column)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    out /= np.abs(out).max(1, keepdims=True, initial=1e-300)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _classes(vectors: DataFrame) -> DataFrame:
    """rep (a number of its own), first (least vec_id), copies, label, embedding of the distinct vectors that can link. It is written
    before it is used, so a number stays what it is."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad & some)
    v = v.withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    v = v.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    return cut(v.withColumn("rep", F.monotonically_increasing_id()), "vectors")


def fit(classes: DataFrame, rows: int, width: int, threshold: float, probe_recall: float, sample: int = SAMPLE, cell: int = CELL, level_centres: int = LEVEL_CENTRES) -> Quantiser:
    taken = classes.orderBy(F.xxhash64("first"), "rep").select("embedding").limit(sample)
    return Quantiser(_matrix(taken.toArrow().column("embedding").combine_chunks(), width), rows, threshold, probe_recall, cell, level_centres)


class Roots:
    """The smallest number of each node's component, for edges that come in batches."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        apart = a != b
        if not apart.any():
            return
        pair = np.unique(np.stack((np.minimum(a, b)[apart], np.maximum(a, b)[apart])), axis=1)
        name, at = np.unique(pair, return_inverse=True)
        x, y = at.reshape(2, -1)
        low = np.arange(len(name))
        while True:
            new = low.copy()
            np.minimum.at(new, x, low[y])
            np.minimum.at(new, y, low[x])
            new = new[new]
            if (new == low).all():
                break
            low = new
        to = np.arange(len(self.root))
        to[name] = name[low]
        self.root = to[self.root]


def block_links(model: Quantiser, cell: int, index: dict, probe: dict, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each index row, links of each probe, roots of index rows and probes after them) of a block: the rows of pairs with cosine
    threshold or more, each unordered pair in one cell only."""
    n, m = len(index["rep"]), len(probe["rep"])
    links_i, links_q, roots = np.zeros(n), np.zeros(m), Roots(n + m)
    reach = ((np.sqrt(2 - 2 * threshold) + index["err"]) ** 2 + 1e-4).astype(np.float32)
    some = max(1024, EXACT * 64 // max(64, index["probes"].shape[1]))
    for at in range(0, m, SLICE):
        part = slice(at, at + SLICE)
        every_q, every_i = np.nonzero(model.lookup(probe["vec"][part], cell, index["codes"]) <= reach[None, :])
        for k in range(0, len(every_q), some):
            q, i = every_q[k : k + some] + at, every_i[k : k + some]
            ours = probe["rep"][q] < index["rep"][i]
            twice = (index["probes"][i] == probe["cell"][q][:, None]).any(1)
            keep = (probe["rep"][q] != index["rep"][i]) & (ours | ~twice)
            q, i = q[keep], i[keep]
            exact = np.einsum("ij,ij->i", probe["vec"][q], index["vec"][i]) >= threshold
            q, i = q[exact], i[exact]
            links_i += np.bincount(i, probe["copies"][q], n)
            links_q += np.bincount(q, index["copies"][i], m)
            roots.join(i, q + n)
    return links_i, links_q, roots.root


def _verify(rows: DataFrame, model: Quantiser, width: int, threshold: float) -> DataFrame:
    """(rep, root, links) from rows (label, dim, list, bi, bq, probing, rep, copies, embedding, cell, probes, codes, err) sorted by block."""

    def run(batches):
        key, have, done = None, [], ([], [], [])

        def close():
            t = pa.Table.from_batches(have)
            side = t.column("probing").to_numpy().astype(bool)
            if side.all() or not side.any():
                return
            vec = _matrix(t.column("embedding").combine_chunks(), width)
            col = {"rep": t.column("rep").to_numpy(), "cell": t.column("cell").to_numpy(), "copies": t.column("copies").to_numpy()}
            probe = {k: v[side] for k, v in col.items()} | {"vec": vec[side]}
            listed = t.filter(pa.array(~side))
            flat = lambda c, kind: listed.column(c).combine_chunks().flatten().to_numpy().astype(kind).reshape(listed.num_rows, -1)
            index = {k: v[~side] for k, v in col.items()} | {"vec": vec[~side], "err": listed.column("err").to_numpy(), "probes": flat("probes", np.int64), "codes": flat("codes", np.uint8)}
            links_i, links_q, root = block_links(model, key[2], index, probe, threshold)
            every, links = np.concatenate((index["rep"], probe["rep"])), np.concatenate((links_i, links_q))
            linked = links > 0
            if not linked.any():
                return
            least = np.full(len(every), np.iinfo(np.int64).max)
            np.minimum.at(least, root[linked], every[linked])
            for c, v in zip(done, (every[linked], least[root[linked]], links[linked].astype(np.int64))):
                c.append(v)

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in done], ["rep", "root", "links"])
            for c in done:
                c.clear()
            return out

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "list", "bi", "bq"))))
            first = 0
            for at in range(1, len(keys) + 1):
                if at == len(keys) or keys[at] != keys[first]:
                    if keys[first] != key:
                        if have:
                            close()
                        key, have = keys[first], []
                    have.append(batch.slice(first, at - first))
                    first = at
            if done[0]:
                yield emit()
        if have:
            close()
        if done[0]:
            yield emit()

    return arrow_map(rows, run, "rep long, root long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, probe_recall: float = PROBE_RECALL, sample: int = SAMPLE, cell: int = CELL, level_centres: int = LEVEL_CENTRES) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors."""
    classes = _classes(vectors)
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).alias("embedding"))
    if not size["n"]:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = -(-size["width"] // SUBSPACES) * SUBSPACES
    model = fit(classes, size["n"], width, threshold, probe_recall, sample, cell, level_centres)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                cell, probes, codes, err = model.assign(_matrix(batch.column("embedding"), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(list(probes), pa.list_(pa.int64())), pa.array(list(codes.astype(np.int16)), pa.list_(pa.int16())), pa.array(err)], [*batch.schema.names, "cell", "probes", "codes", "err"])

    label = dict(classes.dtypes)["label"]
    coded = classes.select("rep", "copies", "label", "embedding", F.size("embedding").alias("dim"))
    coded = cut(arrow_map(coded, place, f"rep long, copies long, label {label}, embedding array<double>, dim int, cell long, probes array<long>, codes array<smallint>, err double"), "codes")
    probing = coded.withColumn("list", F.explode("probes"))
    lists = coded.groupBy("label", "dim", F.col("cell").alias("list")).agg(F.count("*").alias("n_index"))
    asked = probing.groupBy("label", "dim", "list").agg(F.count("*").alias("n_probes"))
    lists = lists.join(asked, ["label", "dim", "list"]).select("label", "dim", "list", F.ceil(F.col("n_index") / BLOCK_INDEX).cast("int").alias("ni"), F.ceil(F.col("n_probes") / BLOCK_PROBES).cast("int").alias("nq"))
    own, every = lambda n: F.array(F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    common = ["label", "dim", "list", "bi", "bq", "probing", "rep", "copies", "embedding", "cell", "probes", "codes", "err"]
    none = {"probes": F.lit(None).cast("array<long>"), "codes": F.lit(None).cast("array<smallint>"), "err": F.lit(None).cast("double")}
    index = coded.withColumn("list", F.col("cell")).join(lists, ["label", "dim", "list"]).withColumn("probing", F.lit(0)).withColumn("bi", F.explode(own("ni"))).withColumn("bq", F.explode(every("nq")))
    probe = probing.withColumns(none).join(lists, ["label", "dim", "list"]).withColumn("probing", F.lit(1)).withColumn("bi", F.explode(every("ni"))).withColumn("bq", F.explode(own("nq")))
    block = ["label", "dim", "list", "bi", "bq"]
    rows = index.select(*common).unionByName(probe.select(*common)).repartition(*block).sortWithinPartitions(*block)
    parts = cut(_verify(rows, model, width, threshold), "links")
    groups = components(parts, "rep", "root").withColumnRenamed("node", "rep")
    named = classes.join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = named.join(named.groupBy("component").agg(F.min("first").alias("component_first")), "component").join(parts.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
    named = named.select(F.col("label").alias("c_label"), F.col("embedding").alias("c_vec"), "component_first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = v.join(named, (F.col("vec_id").isNotNull()) & (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_vec")), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_first", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 1 ELSE 0 END)) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT m.x AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, m.x = component_id AS kept FROM m LEFT JOIN k ON k.x = m.x
"""
