"""Approximate dense search: an inverted file over a coarse quantiser, kept as a partitioned table.

``build`` learns ``cells`` centroids by spherical k-means from at most ``SAMPLE`` vectors, those of the smallest hashes of their ids; it
puts every row into the cell of its nearest centroid and writes the rows by cell. A search compares a question with the centroids (a bounded
table), and reads the partitions of the cells that some question of the round probes and no others; in them, a row is scored only for the questions that probe
its cell. Scores are those of the exact search, on the stored vectors. How many cells a question probes is measured when the index is built: the fewest
with which ``CALIBRATION`` questions find ``target`` of their exact ``pool`` nearest rows. ``probes`` overrides it; more than there are cells is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom import config
from textloom.operators import search
from textloom.operators.index_store import CorpusStore
from textloom.scratch import bounded_batches, materialize

S = config.SETTINGS
#: Vectors the quantiser is learned from, its rounds, and the most centroids that it has.
SAMPLE, ROUNDS, MOST_CELLS = 16_384, 12, 4096
#: Probes that are more than any index has cells.
ALL = MOST_CELLS + 1
#: Questions by which the number of probes is chosen, and what they must find.
CALIBRATION, TARGET = 128, 0.95


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def centroids(x: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from evenly spread rows; a cell that empties takes the row that is worst off."""
    x = unit(x)
    at = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)] if len(x) else x
    for _ in range(ROUNDS if len(x) else 0):
        near = x @ at.T
        own, score = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(at)) == 0)
        sums[empty] = x[np.argsort(score, kind="stable")[: len(empty)]]
        at = unit(sums)
    return at


def _placed(cells, vec: int):
    """mapInArrow: rows with the number of the nearest centroid; rows without a vector, or of other size, go to cell -1."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at = cells.value
        for batch in batches:
            for lo in range(0, batch.num_rows, search.SLAB):
                part = batch.slice(lo, search.SLAB)
                lists = part.column(vec).to_pylist()
                good = np.array([bool(v) and len(v) == at.shape[1] and None not in v for v in lists], bool)
                cell = np.full(len(lists), -1, np.int32)
                if good.any() and len(at):
                    cell[good] = (np.array([v for v, ok in zip(lists, good, strict=True) if ok], np.float64) @ at.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell)], [*part.schema.names, "cell"])

    return run


def _probing(shared, pool: int, id_type):
    """mapInArrow over (id, vec, cell): a task's ``pool`` best rows of each broadcast question that probes their cell."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, vectors, asked = shared.value  # asked: questions by cell
        best, kind = search._Best(len(ids), max(1, pool)), None
        for batch in batches:
            kind = batch.column(0).type
            own = np.array(batch.column(0).to_pylist(), object)
            cell = batch.column(2).to_numpy()
            for c in np.unique(cell):
                q = asked.get(int(c))
                if q is None:
                    continue
                rows = np.flatnonzero(cell == c)
                v = search.matrix(batch.column(1).take(pa.array(rows)).to_pylist(), vectors.shape[1])
                for lo in range(0, len(rows), search.SLAB):
                    some = rows[lo : lo + search.SLAB]
                    score = search.rounded(search.cosines(vectors[q], v[lo : lo + search.SLAB]))
                    k = min(pool, len(some))
                    floor = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                    i, j = np.nonzero(score >= np.maximum(floor, best.least[q])[:, None])
                    best.add(q[i], own[some[j]], score[i, j])
        at, got, score = best.rows
        if len(at) and kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in at], id_type), pa.array(got.tolist(), kind), pa.array(score)], ["query", "row", "score"])

    return run


class DenseIndex:
    """The index of a table of vectors in a folder: versions of the lists, of the quantisers that they name, and of the probes measured for these.

    Rows without a vector or with one of another size score 0 for every question, as in the exact search; they lie in a cell of their own, which is
    probed last, so one probe more than there are centroids reads all. Rows with a null id take part under null.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.lists, self.cells, self.probes = (CorpusStore(spark, f"{path.rstrip('/')}/{x}") for x in ("lists", "cells", "probes"))

    def build(self, rows: DataFrame, key: str, vec: str, cells: int | None = None, target: float = TARGET, pool: int = S.retrieval_candidate_pool) -> int:
        """Index all of ``rows`` (every column is kept); returns the version of the lists. ``cells`` is about the square root of the rows unless given."""
        bounded_batches(self.spark)
        n = rows.count()
        size = F.size(vec)
        dim = (rows.filter(size > 0).groupBy(size.alias("d")).count().orderBy(F.desc("count"), "d").first() or [0])[0]  # the usual size
        good = rows.filter((size == dim) & ~F.exists(vec, lambda x: x.isNull())).select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v"))
        taken = good.orderBy(F.xxhash64(F.lit(3), "k"), "k").limit(SAMPLE).collect()  # a bounded sample
        count = cells or max(1, min(MOST_CELLS, round(n**0.5)))
        at = centroids(np.array([r["v"] for r in taken], np.float64).reshape(len(taken), dim), count)
        shared = self.spark.sparkContext.broadcast(at)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        placed = rows.mapInArrow(_placed(shared, rows.columns.index(vec)), f"{kinds}, cell int")
        made = self.cells.rebuild(self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(at)], "cell int, centre array<double>").coalesce(1))
        version = self.lists.rebuild(placed.withColumn("cells", F.lit(made)).hint("rebalance", "cell"), by=["cells", "cell"] if n else None)  # a table of no partition would lose its columns
        if len(taken) and target:
            probes = self._calibrated([list(r["v"]) for r in taken[:CALIBRATION]], key, vec, target, pool, version)
            self.probes.rebuild(self.spark.createDataFrame([(made, probes)], "cells int, probes int"))
        return version

    def _calibrated(self, taken: list, key: str, vec: str, target: float, pool: int, version: int) -> int:
        """The fewest probes (to an eighth), by doubling and then halving, with which the sample finds ``target`` of its exact nearest."""
        asked = materialize(self.spark.createDataFrame(list(enumerate(taken)), "query long, v array<double>"), "asked")
        most = len(self.quantiser(version)[0]) + 1
        want = materialize(self.search(asked, "query", "v", key, vec, pool, most, version).select("query", F.col(key).alias("k")), "exact")
        least = target * want.count()

        def enough(p: int) -> bool:
            got = self.search(asked, "query", "v", key, vec, pool, p, version).select(F.col("query").alias("q"), F.col(key).alias("g"))
            return want.join(got, (F.col("q") == F.col("query")) & F.col("g").eqNullSafe(F.col("k")), "left_semi").count() >= least

        low, high = 0, 1
        while high < most and not enough(high):
            low, high = high, min(most, 2 * high)
        while high - low > max(1, high // 8):
            middle = (low + high) // 2
            low, high = (low, middle) if enough(middle) else (middle, high)
        return high

    def quantiser(self, version: int | None = None) -> tuple[np.ndarray, int]:
        """(centroids, probes) of a version of the lists: MOST_CELLS rows at most. Without a measured number all cells are probed."""
        made = self.lists.read(version).select("cells").first()
        at = sorted(self.cells.read(made[0] if made else None).collect())
        known = self.probes.read().filter(F.col("cells") == (made[0] if made else -1)).first() if self.probes.versions() else None
        return np.array([r["centre"] for r in at], np.float64).reshape(len(at), len(at[0]["centre"]) if at else 0), known["probes"] if known else len(at) + 1

    def search(self, queries: DataFrame, q_id: str, q_vec: str, r_id: str, r_vec: str, k: int = S.retrieval_candidate_pool, probes: int | None = None, version: int | None = None) -> DataFrame:
        """(q_id, r_id, score, rank): of each question the k nearest rows in the cells it probes, by cosine rounded to four places, ties to the smaller id.

        Questions go in rounds of a checked size; a round reads the partitions that it probes. A question without a vector probes the first cells and scores 0.
        """
        bounded_batches(self.spark)
        rows = self.lists.read(version)
        at, measured = self.quantiser(version)
        probes = min(probes or measured, len(at) + 1)
        asked = queries.select(F.col(q_id), F.col(q_vec).cast("array<double>").alias("vec"))
        kinds = f"query {queries.schema[q_id].dataType.simpleString()}, row {rows.schema[r_id].dataType.simpleString()}, score double"
        out = None
        for part in search.dealt(asked, F.coalesce(F.octet_length(F.col(q_id).cast("string")), F.lit(0)) + 8 * F.greatest(F.size("vec"), F.lit(0))):
            got = part.collect()  # about ROUND_BYTES
            if not got:
                continue
            v = search.matrix([r["vec"] for r in got], at.shape[1])
            turn = np.argsort(-(v @ at.T), axis=1, kind="stable")[:, :probes]
            by: dict[int, np.ndarray] = {int(c): np.flatnonzero((turn == c).any(axis=1)) for c in np.unique(turn)}
            if probes > len(at):  # the cell of rows without a vector
                by[-1] = np.arange(len(got))
            shared = self.spark.sparkContext.broadcast(([r[0] for r in got], v, by))
            some = rows.filter(F.col("cell").isin(sorted(by))).select(F.col(r_id), F.col(r_vec).cast("array<double>").alias("vec"), "cell")
            met = some.mapInArrow(_probing(shared, k, search.to_arrow_type(queries.schema[q_id].dataType)), kinds)
            out = met if out is None else out.unionByName(met)
        out = out if out is not None else self.spark.createDataFrame([], kinds)
        w = Window.partitionBy("query").orderBy(F.desc("score"), "row")
        ranked = out.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
        return ranked.select(F.col("query").alias(q_id), F.col("row").alias(r_id), "score", "rank")
