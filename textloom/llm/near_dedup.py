"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

A document is its set of distinct word shingles. Permutation sigma scatters the shingles' hashes over a circle of ``CIRCLE`` places;
permutation pi, shifted by k places, gives coordinate k of the signature, so one gather of neighbouring places yields all coordinates of
a shingle. The signature is cut into bands; documents alike in a band share a bucket. ``banding`` picks the bands so that a pair at the
threshold is missed with a chance of at most ``MISS``; nothing caps buckets or candidates.

Work is by class of equal sets (one representative each), and links are found in two rounds so that a bucket's pairs are never all made:

A. every representative is verified against the smallest representative of its buckets (a pair a document), and the links are followed
   to their ends by pointer jumping;
B. only buckets that still hold more than one component are looked at, for pairs of different components whose sizes allow the threshold and
   whose signatures agree within six standard deviations of it. A pair is looked at in the first bucket that its documents share and nowhere else. Merging
   rounds verify each component's likeliest pair and merge what it links, so a large group of near copies falls into one component in few
   verifications; they end with the first round that merges little, after ``MERGING_ROUNDS`` at the latest. A last round brings the full sets of the documents that
   still have a possible partner to their buckets and confirms there, so no pair is ever a row of a table but the links between components
   that a bucket finds (fewer than it has documents). Large buckets are cut into blocks that meet in twos.

Every link is confirmed on the full sets of 64-bit shingle hashes. Components are the connected components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import bloom
from textloom.llm.common import bounded_batches, mark, materialize, release_since, text_of, tidied

CIRCLE_LOG2 = 20
CIRCLE = 1 << CIRCLE_LOG2
MISS = 2e-7
MOST_BANDS = 52
#: Coordinates kept (a byte each) for the estimate of round B, and its margin in standard deviations.
KEPT, MARGIN = 128, 6
BLOCK = 512
#: Rounds of merging, at most, before all that is left is verified.
MERGING_ROUNDS = 4
#: Merging also ends after a round that linked less than one in so many of its pairs.
SPARSE = 4
#: Pairs that are held at once while the likeliest are looked for.
PAIRS = 1 << 20
#: Documents of a group from which on its pairs are looked at as a matrix.
MATRIX = 24
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows a band): the longest bands of which at most ``MOST_BANDS`` suffice."""
    best = (1, 1)
    for rows in range(1, 13):
        bands = math.ceil(math.log(MISS) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands <= MOST_BANDS:
            best = (bands, rows)
    return best


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[3]
    h = (h ^ (h >> np.uint64(29))) * _MIX[4]
    return h ^ (h >> np.uint64(32))


class _Words(dict):
    """64-bit hashes of words; forgets all when it has many, so that memory is bounded."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


_WORDS = _Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles. Lower-cases A-Z only and cuts at the six ASCII blanks, as bytes methods do."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(width, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ w[i : len(w) - n + 1 + i]) * _MIX[i % 8]
            h ^= h >> np.uint64(31)
        return np.unique(_mixed(h))


@lru_cache(maxsize=2)
def _circle(k: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and pi's windows of k neighbours: row i holds pi at i, i + 1, .. round the circle."""
    rng = np.random.default_rng(20240607)
    sigma = rng.permutation(CIRCLE).astype(np.int32)
    pi = rng.permutation(CIRCLE).astype(np.uint32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.r_[pi, pi[:k]], k)


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """(documents, k) uint32; empty sets get the largest number throughout."""
    sigma, windows = _circle(k)
    out = np.full((len(sets), k), np.iinfo(np.uint32).max, np.uint32)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return out
    owner = np.repeat(np.arange(len(sets)), sizes)
    at = sigma[(np.concatenate(sets) >> np.uint64(64 - CIRCLE_LOG2)).astype(np.int64)]
    for lo in range(0, len(at), 1024):
        own = owner[lo : lo + 1024]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        least = np.minimum.reduceat(windows[at[lo : lo + 1024]], first, axis=0)
        out[own[first]] = np.minimum(out[own[first]], least)
    return out


def _sketch(width: int, bands: int, rows: int):
    k = max(bands * rows, KEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 256):
                sets = [shingles(t, width) for t in texts.slice(lo, 256).to_pylist()]
                sig = signatures(sets, k)
                with np.errstate(over="ignore"):
                    part = sig[:, : bands * rows].reshape(len(sets), bands, rows).astype(np.uint64)
                    key = np.arange(bands, dtype=np.uint64)[None, :] * _MIX[5] + np.uint64(1)
                    for i in range(rows):
                        key = (key ^ part[:, :, i]) * _MIX[i % 8]
                        key ^= key >> np.uint64(29)
                    prints = [[int(x.view(np.int64)) for x in (np.bitwise_xor.reduce(s), (s * _MIX[6] ^ (s >> np.uint64(30))).sum(dtype=np.uint64))] if len(s) else [0, 0] for s in sets]
                key = _mixed(key)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(key.view(np.int64).ravel()))
                low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, 256), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1)), keys, *(pa.array([x.tobytes() for x in c], pa.binary()) for c in (sig[:, :KEPT].astype(np.uint8), low))],
                    ["doc", "n", "fa", "fb", "keys", "sig", "prints"],
                )

    return run


def _sets(width: int, wanted):
    """mapInArrow over (doc, text, h): the sets of documents whose hash the broadcast filter ``wanted`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bloom.held(wanted.value, batch.column(2).to_numpy(zero_copy_only=False))))
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, width).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["doc", "items"])

    return run


def _verify(num: int, den: int):
    """mapInArrow over (a, b, a_items, b_items): the pairs with den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, s = [], None, np.zeros(0, np.uint64)
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                s, last = (s, last) if a == last else (np.frombuffer(x.as_py(), np.uint64), a)
                t = np.frombuffer(y.as_py(), np.uint64)
                short, long = (s, t) if len(s) < len(t) else (t, s)
                at = np.searchsorted(long, short)
                common = int((long[np.minimum(at, len(long) - 1)] == short).sum()) if len(long) else 0
                keep.append(common > 0 and den * common >= num * (len(s) + len(t) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


class _Groups:
    """Rows sorted by (key, i, j), the groups of a bucket's one or two blocks, and their pairs of different components that may be linked.

    A pair belongs to the first band in which its documents are alike, told by 32 bits of the band's key (with 51 bands, a pair is taken for another's with a chance of 1e-8).
    """

    def __init__(self, rows: pa.Table, num: int, den: int):
        key, i, j, self.doc, self.comp, self.n, self.part = (rows.column(c).to_numpy() for c in range(7))
        wide = lambda c, kind: np.frombuffer(b"".join(rows.column(c).to_pylist()), kind).reshape(len(key), -1)
        self.sig, self.prints = wide(7, np.uint8), wide(8, np.uint32)
        self.band = (self.prints == (key.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None]).argmax(axis=1)
        self.group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        self.two = i != j
        self.num, self.den = num, den
        t = num / den
        self.least = math.floor(KEPT * t - MARGIN * math.sqrt(KEPT * t * (1 - t)))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows a, rows b, signature places alike) of parts of all pairs; a large group is met as a matrix, small ones side by side."""
        cuts = np.flatnonzero(np.diff(self.group, prepend=0, append=-1))
        size = np.diff(cuts)
        for at in np.flatnonzero(size >= MATRIX):
            yield from self._of_matrix(np.arange(cuts[at], cuts[at + 1]))
        a, d = np.flatnonzero(np.repeat(size < MATRIX, size)), 0
        while len(a):
            d += 1
            a = a[a + d < len(self.doc)]
            a = a[self.group[a] == self.group[a + d]]
            b = a + d
            short, long = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
            x = a[(self.comp[a] != self.comp[b]) & (short * self.den >= long * self.num) & ~(self.two[a] & (self.part[a] == self.part[b]))]
            for lo, hi in ((0, 8), (8, self.prints.shape[1])):  # most pairs that belong elsewhere are told by the first bands
                if len(x):
                    alike = (self.prints[x, lo:hi] == self.prints[x + d, lo:hi]) & (np.arange(lo, hi) < self.band[x][:, None])
                    x = x[~alike.any(axis=1)]
            yield from self._alike(x, x + d)

    def _of_matrix(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        one = self.part[rows] == self.part[rows[0]]
        a, b = (rows[one], rows[~one]) if self.two[rows[0]] else (rows, rows)
        if not len(b):
            return
        n, m = self.n[a][:, None], self.n[b][None, :]
        ok = (self.comp[a][:, None] != self.comp[b][None, :]) & (n * self.den >= m * self.num) & (m * self.den >= n * self.num)
        if a is b:
            ok &= np.tri(len(a), k=-1, dtype=bool).T
        p, q = np.ascontiguousarray(self.prints[a].T), np.ascontiguousarray(self.prints[b].T)
        for c in range(self.band[rows[0]]):
            ok &= p[c][:, None] != q[c][None, :]
        x, y = np.nonzero(ok)
        for lo in range(0, len(x), 1 << 14):
            yield from self._alike(a[x[lo : lo + (1 << 14)]], b[y[lo : lo + (1 << 14)]])

    def _alike(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if len(a):
            like = (self.sig[a] == self.sig[b]).sum(axis=1)
            ok = like >= self.least
            if ok.any():
                yield a[ok], b[ok], like[ok]


def _grouped(of):
    """mapInArrow over rows sorted by (key, i, j): ``of`` gets tables of whole groups; memory is bounded by a batch and two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not len(rows):
                continue
            last = [rows.column(c)[len(rows) - 1].as_py() for c in range(3)]
            same = np.logical_and.reduce([rows.column(c).to_numpy() == x for c, x in enumerate(last)])
            cut = len(rows) - int(same.sum())
            if cut:
                yield from of(rows.slice(0, cut))
            rest = rows.slice(cut)
        if rest is not None and len(rest):
            yield from of(rest)

    return run


def _likeliest(num: int, den: int):
    """Of whole groups: (comp, like, a, b), the likeliest pair of each component that has one."""

    def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        g, found, held = _Groups(rows, num, den), [], 0
        name, comp = np.unique(g.comp, return_inverse=True)

        def best(found: list[np.ndarray]) -> np.ndarray:
            x = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
            x = x[np.argsort(x[:, 0] * (KEPT + 1) - x[:, 1])]
            return x[np.r_[True, x[1:, 0] != x[:-1, 0]][: len(x)]]

        for a, b, like in g.pairs():
            found += [np.c_[comp[x], like, a, b] for x in (a, b)]
            held += 2 * len(a)
            if held > PAIRS:
                found = [best(found)]
                held = len(found[0])
        out = best(found)
        a, b = g.doc[out[:, 2]], g.doc[out[:, 3]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (name[out[:, 0]], out[:, 1], np.minimum(a, b), np.maximum(a, b))], ["comp", "like", "a", "b"])

    return _grouped(of)


def _possible(num: int, den: int):
    """Of whole groups: the rows that have a partner."""

    def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        g = _Groups(rows, num, den)
        mask = np.zeros(len(rows), bool)
        for a, b, _ in g.pairs():
            mask[a] = mask[b] = True
        yield from rows.filter(pa.array(mask)).to_batches()

    return _grouped(of)


def _confirmed(num: int, den: int):
    """Of whole groups with their full sets (the last column): links (a, b) of components that join what is linked in the group, each link exact."""

    def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        g = _Groups(rows, num, den)
        sets = [np.frombuffer(x, np.uint64) for x in rows.column(9).to_pylist()]
        first = np.r_[0, np.cumsum([len(x) for x in sets])]
        code = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
        has = np.zeros(int(code.max()) + 1 if len(code) else 0, bool)
        name, root = np.unique(g.comp, return_inverse=True)
        label = np.arange(len(name))
        found = list(g.pairs())
        a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        by = np.lexsort((b, a))
        a, b = a[by], b[by]
        cuts, out = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True]) if len(a) else [], []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            x = a[lo]
            y = b[lo:hi]
            y = y[label[root[y]] != label[root[x]]]
            mine = code[first[x] : first[x + 1]]
            has[mine] = True
            for at in range(0, len(y), BLOCK):
                some = y[at : at + BLOCK]
                size = first[some + 1] - first[some]
                starts = np.cumsum(size) - size
                common = np.add.reduceat(has[code[np.repeat(first[some] - starts, size) + np.arange(size.sum())]], starts, dtype=np.int64)
                for z in some[den * common >= num * (len(mine) + size - common)]:
                    p, q = label[root[x]], label[root[z]]
                    if p != q:
                        label[label == max(p, q)] = min(p, q)
                        out.append((min(name[root[x]], name[root[z]]), max(name[root[x]], name[root[z]])))
            has[mine] = False
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in (0, 1)], ["a", "b"])

    return _grouped(of)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that the edges (a, b) reach; nodes without edges are left out.

    Alternates the large-star and small-star steps; all tables are written, so the joins that follow hubs are skew-split.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = materialize(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.unionByName(both.join(least, "u").filter("v < u AND m = v").select("u", "v")).filter("u <> v").distinct(), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        e = materialize(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def _ends(parent: DataFrame) -> DataFrame:
    """(doc, root) from (doc, up) with up < doc: pointers are doubled until none moves."""
    at = materialize(parent.select("doc", F.col("up").alias("root")), "up")
    while True:
        up = at.select(F.col("doc").alias("root"), F.col("root").alias("next"))
        nxt = materialize(at.join(up, "root", "left").select("doc", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "up")
        at = nxt.select("doc", "root")
        if not nxt.filter("moved").limit(1).count():
            return at


def _named(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of different components that pairs of documents join."""
    named = lambda x: roots.select(F.col("doc").alias(x), F.col("root").alias(f"{x}_root"))
    both = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    return both.filter("a <> b").distinct()


def _met(open_: DataFrame, roots: DataFrame, near: DataFrame) -> DataFrame:
    """The rows of ``_Groups`` for buckets (key, doc, size), dealt by group; a bucket of many blocks is met block by block in separate groups."""
    rows = open_.join(roots, "doc", "left").withColumn("comp", F.coalesce("root", "doc")).join(near, "doc")
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("doc"), count).cast("int")
    meets = F.transform(F.sequence(F.lit(0), count - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    met = rows.withColumn("part", mine).withColumn("m", F.explode(meets)).select("key", "m.i", "m.j", "doc", "comp", "n", "part", "sig", "prints")
    return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _still_open(open_: DataFrame, roots: DataFrame) -> DataFrame:
    """Of buckets (key, doc, size) those that hold more than one component."""
    placed = open_.join(roots, "doc", "left").select("key", F.coalesce("root", "doc").alias("comp"))
    split = materialize(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key"), "split")
    return materialize(open_.join(split, "key", "left_semi"), "open")


def _any(rows: DataFrame) -> bool:
    return bool(rows.limit(1).count())


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked if den * |intersection| >= num * |union| of their shingle sets; component_id is the smallest id reachable.
    Documents without a word, or with a null text or id, are linked with nothing; a null id has a null component and is kept. Fewer words
    than ``width`` make one shingle. Rows alike in id are one node. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    began = mark()
    bands, rows = banding(num / den)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    sketch = materialize(source.mapInArrow(tidied(_sketch(width, bands, rows)), "doc long, n long, fa long, fb long, keys array<long>, sig binary, prints binary"), "sketch")
    real = sketch.filter("n > 0 AND doc IS NOT NULL")
    classes = materialize(real.groupBy("fa", "fb", "n").agg(F.min("doc").alias("rep")), "classes")
    nodes = materialize(real.select("doc", "n", "keys", "sig", "prints").join(classes.select(F.col("rep").alias("doc"), "n"), ["doc", "n"], "left_semi"), "nodes")
    exploded = nodes.select(F.explode("keys").alias("key"), "doc")
    buckets = materialize(exploded.groupBy("key").agg(F.min("doc").alias("center"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    members = materialize(exploded.join(buckets, "key"), "members")

    ids = materialize(members.select("doc").distinct(), "candidates")
    wanted = bloom.member_bits(ids.select(F.xxhash64("doc")), ids.count())
    # tested where the sets are made: a task has one Python worker, and as many tasks share the work as read the texts
    sets = materialize(source.filter("doc IS NOT NULL").withColumn("h", F.xxhash64("doc")).mapInArrow(tidied(_sets(width, wanted)), "doc long, items binary"), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("doc").alias(x), F.col("items").alias(f"{x}_items")) for x in "ab")
        whole = pairs.join(b, "b").join(a, "a").select("a", "b", "a_items", "b_items")
        return whole.mapInArrow(tidied(_verify(num, den)), "a long, b long")

    tried = materialize(members.filter("doc <> center").groupBy("doc").agg(F.min("center").alias("a")).withColumnRenamed("doc", "b"), "stars")
    stars = materialize(linked(tried).groupBy("b").agg(F.min("a").alias("a")), "links")
    roots = _ends(stars.select(F.col("b").alias("doc"), F.col("a").alias("up")))

    links: list[DataFrame] = []
    open_ = _still_open(members.select("key", "doc", "size"), roots)
    near = materialize(nodes.join(open_.select("doc").distinct(), "doc", "left_semi").select("doc", "n", "sig", "prints"), "near")
    kinds = "key long, i int, j int, doc long, comp long, n long, part int, sig binary, prints binary"
    for _ in range(MERGING_ROUNDS):
        if not _any(open_):
            break
        each = _met(open_, roots, near).mapInArrow(tidied(_likeliest(num, den)), "comp long, like long, a long, b long")
        pairs = materialize(each.groupBy("comp").agg(F.max(F.struct("like", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "pairs")
        found = materialize(linked(pairs.join(tried, ["a", "b"], "left_anti")), "links")
        if not _any(found):
            break
        tried = tried.unionByName(pairs)
        edges = _named(found, roots)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = _ends(both.filter("b < a").groupBy("a").agg(F.min("b").alias("up")).select(F.col("a").alias("doc"), "up"))
        moved = hooks.select(F.col("doc").alias("was"), F.col("root").alias("now"))
        old = roots.join(moved, roots["root"] == moved["was"], "left").select("doc", F.coalesce("now", "root").alias("root"))
        roots = materialize(old.unionByName(hooks.join(roots, "doc", "left_anti").select("doc", "root")), "roots")
        links.append(found)
        open_ = _still_open(open_, roots)
        if found.count() * SPARSE < pairs.count():
            break
    if _any(open_):
        possible = materialize(_met(open_, roots, near).mapInArrow(tidied(_possible(num, den)), kinds), "possible")
        whole = possible.join(sets, "doc").select(*possible.columns, "items").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        last = materialize(whole.mapInArrow(tidied(_confirmed(num, den)), "a long, b long"), "links")
        links.append(last)
    every = spark.createDataFrame([], "a long, b long")
    for x in links:
        every = every.unionByName(x)
    joined = materialize(components(_named(every, roots)), "joined")

    ends = classes.join(roots.withColumnRenamed("doc", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    ends = materialize(ends.join(joined.select(F.col("node").alias("root"), F.col("root").alias("end")), "root", "left").select("fa", "fb", "n", F.coalesce("end", "root").alias("end")), "ends")
    release_since(docs.sparkSession, began, sketch, ends)
    found = sketch.select("doc", "n", "fa", "fb").join(ends, ["fa", "fb", "n"], "left")
    comp = F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("end")).otherwise(F.col("doc"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("doc"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The kept documents with all their columns: one of each component. Rows that cannot be dropped are not shuffled."""
    gone = materialize(near_duplicates(docs, **options).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    maybe = bloom.member_filter(gone.select(F.xxhash64("__gone")), gone.count())
    hit = docs["doc_id"].isNotNull() & maybe(F.xxhash64(F.coalesce(docs["doc_id"].cast("long"), F.lit(0))))
    rest = docs.filter(hit)
    return docs.filter(~hit).unionByName(rest.join(gone, rest["doc_id"].cast("long") == gone["__gone"], "left_anti"))
