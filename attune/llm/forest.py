"""Most similar vectors for every vector: a hash-prefix forest over sorted arrays of long hash strings."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attune.storage import cut, small

#: Bits of a hash string. They are kept as one unsigned number whose order is the order of the strings.
BITS = 64


@dataclass
class Forest:
    """A fitted forest: centre, the projections of every tree, their thresholds and the bucket borders."""

    centre: np.ndarray  # (dim,)
    planes: np.ndarray  # (trees, dim, BITS)
    cuts: np.ndarray  # (trees, BITS)
    borders: np.ndarray  # (trees, buckets - 1) of uint64, ascending
    halos: np.ndarray  # (trees, buckets - 1) of uint64: from here up to the border, rows visit the bucket above too
    centres: np.ndarray  # (centres, dim) of float32: rows travel as their difference from the nearest one
    splits: list[dict[int, list]] = field(default_factory=list)  # per tree: string that fills several buckets -> its sub-tree

    @property
    def buckets(self) -> int:
        return self.borders.shape[1] + 1

    def strings(self, unit: np.ndarray, tree: int) -> np.ndarray:
        """Hash strings of unit vectors in one tree."""
        bits = (unit - self.centre) @ self.planes[tree] > self.cuts[tree]
        return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)

    def bucket(self, strings: np.ndarray, ids: np.ndarray, tree: int, unit: np.ndarray | None = None) -> np.ndarray:
        """Bucket of each string; a string that fills several buckets is split over them by its sub-tree.

        Where it has none (or no vectors are given), its rows are dealt out by id and tree.
        """
        low = np.searchsorted(self.borders[tree], strings, "left")
        high = np.searchsorted(self.borders[tree], strings, "right")
        own = np.uint64(tree * 0xD1B54A32D192ED03 % 2**64)
        salt = ((ids.astype(np.uint64) + own) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        out = low + (salt % (high - low + 1).astype(np.uint64)).astype(np.int64)
        if unit is not None and self.splits:
            for s in np.unique(strings[high > low]):
                if (node := self.splits[tree].get(int(s))) is not None:
                    rows = np.flatnonzero(strings == s)
                    out[rows] = low[rows] + leaf_of(node, unit[rows])
        return out

    def guests(self, strings: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows so close below a border that their window reaches over it, and the bucket above that they visit."""
        if self.buckets == 1:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low = np.searchsorted(self.borders[tree], strings, "left")
        above = np.searchsorted(self.borders[tree], strings, "right")
        rows = np.flatnonzero((low == above) & (above < self.buckets - 1))
        rows = rows[strings[rows] >= self.halos[tree][above[rows]]]
        return rows, above[rows] + 1


def means(sample: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of the sample by a few rounds of k-means, coarse ones so that none lie on top of each other."""
    c = sample[np.sort(rng.choice(len(sample), min(count, max(1, len(sample) // 16)), replace=False))]
    for _ in range(4):
        at = nearest(sample, c)
        used, at = np.unique(at, return_inverse=True)
        sums = np.zeros((len(used), sample.shape[1]))
        np.add.at(sums, at, sample)
        c = (sums / np.bincount(at)[:, None]).astype(np.float32)
    return np.unique(np.round(c, 4), axis=0).astype(np.float32)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * np.einsum("ij,ij->i", centres, centres), axis=1)


#: Bytes of a code before its dimensions: number of the centre (2) and size of a step (1).
HEAD = 3


def encode(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Codes of unit vectors, a byte per dimension: the difference from the nearest centre in steps fit to its size.

    So vectors of a dense group stay apart. Steps are quarters of a power of two and no finer than float rounding,
    so that copies have equal codes.
    """
    ref = nearest(x, centres)
    rest = x - centres[ref]
    size = np.clip(np.ceil(4 * np.log2(np.maximum(np.abs(rest).max(axis=1), 1e-9))), -56, 8).astype(np.int8)
    out = np.empty((len(x), HEAD + x.shape[1]), np.int8)
    out[:, :2] = ref.astype("<u2").view(np.int8).reshape(-1, 2)
    out[:, 2] = size
    out[:, HEAD:] = np.round(rest / (2.0 ** (size[:, None] / 4.0)) * 127)
    return out


def decode(codes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Unit vectors of codes."""
    ref = np.ascontiguousarray(codes[:, :2]).view("<u2").ravel()
    x = codes[:, HEAD:].astype(np.float32) * (2.0 ** (codes[:, 2:HEAD] / 4.0) / 127).astype(np.float32) + centres[ref]
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]


def directions(x: np.ndarray, width: int) -> np.ndarray:
    """Leading principal directions of a group of vectors, as columns."""
    _, axes = np.linalg.eigh(np.cov((x - x.mean(axis=0)).T) + np.eye(x.shape[1]) * 1e-12)
    return axes[:, ::-1][:, : min(width, x.shape[1])]


def grow(x: np.ndarray, leaves: int, lead: np.ndarray, rng: np.random.Generator) -> list:
    """Sub-tree over the vectors ``x`` of one string: [plane, cut, below, above, leaves below]; [] is a leaf."""
    if leaves == 1 or len(x) < 2:
        return []
    left = leaves // 2
    plane = (lead @ rng.standard_normal(lead.shape[1])).astype(np.float32)
    at = x @ plane
    bound = np.quantile(at, left / leaves).astype(np.float32)
    return [plane, bound, grow(x[at <= bound], left, lead, rng), grow(x[at > bound], leaves - left, lead, rng), left]


def leaf_of(node: list, x: np.ndarray) -> np.ndarray:
    """Leaf number of each vector in a sub-tree."""
    out = np.zeros(len(x), np.int64)
    if node and len(x):
        above = x @ node[0] > node[1]
        out[~above] = leaf_of(node[2], x[~above])
        out[above] = node[4] + leaf_of(node[3], x[above])
    return out


def refine(x: np.ndarray, block: int, rng: np.random.Generator, width: int = 32) -> np.ndarray:
    """Order of the vectors of one string by further bits: halved across their own leading directions down to ``block``."""
    lead = directions(x, width)
    parts, done = [np.arange(len(x))], []
    while parts:
        rows = parts.pop()
        if len(rows) <= block:
            done.append(rows)
            continue
        by = np.argsort(x[rows] @ (lead @ rng.standard_normal(lead.shape[1])), kind="stable")
        half = len(rows) // 2
        parts += [rows[by[half:]], rows[by[:half]]]
    return np.concatenate(done)


def fit(sample: np.ndarray, trees: int, buckets: int, width: int, seed: int, reach: float = 0.0) -> Forest:
    """Fit on unit vectors of a bounded sample; rows visit the bucket above from ``reach`` of a bucket below a border.

    Hyperplanes are random rotations inside the ``width`` leading principal directions, where neighbours
    agree most often per bit; each is cut at its median so that every bit halves the data.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    width = min(width, dim)
    centre = sample.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((sample - centre).T) + np.eye(dim) * 1e-9)
    lead = axes[:, ::-1][:, :width]
    planes = np.empty((trees, dim, BITS), np.float32)
    for t in range(trees):
        turns = [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(-(-BITS // width))]
        planes[t] = lead @ np.hstack(turns)[:, :BITS]
    centre = centre.astype(np.float32)
    cuts = np.stack([np.median((sample - centre) @ p, axis=0) for p in planes]).astype(np.float32)
    model = Forest(centre, planes, cuts, np.empty((trees, 0), np.uint64), np.empty((trees, 0), np.uint64), means(sample, 256, rng))
    at = (np.arange(1, buckets) * len(sample)) // buckets
    back = np.maximum(at - int(np.ceil(min(reach, 1.0) * len(sample) / buckets)), 0)
    strings = [model.strings(sample, t) for t in range(trees)]
    model.borders = np.stack([np.sort(s)[at] for s in strings])
    model.halos = np.stack([np.sort(s)[back] for s in strings])
    for t in range(trees):
        named, times = np.unique(model.borders[t], return_counts=True)
        subs = {}
        for s, n in zip(named, times, strict=True):
            own = sample[strings[t] == s]
            if len(own) > 2 * n:
                subs[int(s)] = grow(own, int(n) + 1, directions(own, width), rng)
        model.splits.append(subs)
    return model


def units(batch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, unit vectors and input positions of the usable rows of an Arrow batch (id, vector).

    Unusable: null id or vector, another size than ``dim``, null, NaN or infinite values, all zeros.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, vectors = batch.column(0), batch.column(1)
    ok = pc.and_(pc.is_valid(ids), pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False))
    at = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
    flat = vectors.take(pa.array(at)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim) if len(at) else np.empty((0, dim), np.float32)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    good = np.isfinite(norm) & (norm > 0)
    x = (x[good] / norm[good, None]).astype(np.float32)
    return ids.to_numpy(zero_copy_only=False)[at[good]].astype(np.int64), x, at[good]


def best(sim: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's k largest values of at least ``least``."""
    r, c = np.nonzero(sim >= least)
    if len(r) == 0:
        return r, c
    count = np.bincount(r, minlength=len(sim))
    full = np.flatnonzero(count > k)
    if len(full) == 0:
        return r, c
    keep = count[r] <= k
    top = np.argpartition(-sim[full], k - 1, axis=1)[:, :k]
    return np.concatenate([r[keep], np.repeat(full, k)]), np.concatenate([c[keep], top.ravel()])


def neighbours(strings: np.ndarray, ids: np.ndarray, codes: np.ndarray, centres: np.ndarray, k: int, least: float, block: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of one bucket: (smaller id, larger id, cosine less one); ``least`` bounds the latter.

    In the sorted array the rows with the longest common prefix of a string stand next to it, and going up a
    level widens that range; so each row is compared with the ``block`` to ``2 * block`` rows on either side,
    its deepest prefix matches and the further ones of the levels above. Rows with equal strings that are more
    than a window are ordered by further bits of their own, drawn from ``seed``, which differs by tree. Rows with equal string and code are
    copies: beyond k + 1 of them the larger ids are paired with the k smallest ones and leave the array,
    since nothing could rank them above those.
    """
    order = np.lexsort((ids, strings))
    order = order[np.append(True, ids[order][1:] != ids[order][:-1])] if len(order) else order
    strings, ids, codes = strings[order], ids[order], codes[order]
    a, b, s = [], [], []
    if len(ids) > k + 1:
        rows = np.ascontiguousarray(codes).view(np.dtype((np.void, codes.shape[1]))).ravel()
        _, group, size = np.unique(rows, return_inverse=True, return_counts=True)
        if size.max() > k + 1:
            by = np.lexsort((ids, group))
            rank = np.empty(len(ids), np.int64)
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            rank[by] = np.arange(len(ids)) - first[group[by]]
            extra = np.flatnonzero(rank > k)
            for j in range(k):
                a.append(ids[by[first[group[extra]] + j]])
                b.append(ids[extra])
                s.append(np.zeros(len(extra), np.float32))
            stay = rank <= k
            strings, ids, codes = strings[stay], ids[stay], codes[stay]
    n = len(ids)
    x = decode(codes, centres)
    edges = np.flatnonzero(np.append(np.append(True, strings[1:] != strings[:-1]), True)) if n else np.zeros(1, np.int64)
    order = np.arange(n)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi - lo > block:
            order[lo:hi] = lo + refine(x[lo:hi], block, np.random.default_rng([seed, int(strings[lo])]))
    ids, x = ids[order], x[order]
    for at in range(0, n, block):
        own, near = x[at : at + block], x[at : at + 2 * block]
        # cosine less one from differences inside the block, else rounding hides the order in dense groups
        mid = near.mean(axis=0)
        own, near = own - mid, near - mid
        sim = own @ near.T
        half = 0.5 * np.einsum("ij,ij->i", near, near)
        m = len(own)
        sim -= half[:m, None]
        sim -= half
        np.fill_diagonal(sim, -3)
        if sim.max(initial=-3) < least:
            continue
        r1, c1 = best(sim, k, least)
        c2, r2 = best(sim[:, m:].T, k, least) if near.shape[0] > m else (np.empty(0, int), np.empty(0, int))
        r, c = np.concatenate([r1, r2]), np.concatenate([c1, c2 + m])
        a.append(ids[at + r])
        b.append(ids[at + c])
        s.append(sim[r, c])
    if not a:
        e = np.empty(0, np.int64)
        return e, e, np.empty(0, np.float32)
    a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
    a, b = np.minimum(a, b), np.maximum(a, b)
    _, once = np.unique(np.stack([a, b]), axis=1, return_index=True)
    return a[once], b[once], s[once]


def similar(df: DataFrame, key: str = "id", vector: str = "vector", dim: int = 96, k: int = 5, least: float = -1.0, trees: int = 14, block: int = 1024, rows_per_bucket: int = 25_000, width: int = 32, sample_rows: int = 16_384, seed: int = 7) -> DataFrame:
    """The k most similar other rows of every usable row, as (key, other, cosine, place).

    ``least`` leaves out neighbours below that cosine. The forest is fitted on at most about ``sample_rows``
    rows picked by a hash of the key and then indexes every row. Per tree each row is shuffled once, as a
    19-byte head and one byte per dimension, packed into one binary per bucket and batch; buckets are ranges
    of hash strings of about ``rows_per_bucket`` rows (more, once the sample could not place the borders: raise
    ``sample_rows`` with billions of rows) cut at quantiles of the sample, so they stay balanced
    when the data are skewed, and a string that alone fills several buckets is split over them by a sub-tree.
    Rows within about ``block`` below a border visit the bucket above as well, so windows reach over borders.
    Nothing quadratic is built: a row meets 2 to 4 ``block`` others per tree. The winners' cosines are computed
    exactly from the original vectors.

    Rows whose vector is null, of another size, zero or not finite take no part. A key that comes twice is
    one record. Equal cosines are ordered by the other's key. Empty tables give an empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    total = rows.count()
    pick = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))) < sample_rows) if total > sample_rows else rows
    out = "id_a BIGINT, id_b BIGINT, sim FLOAT"
    table = pick.limit(2 * sample_rows).toArrow().combine_chunks()
    batches = table.to_batches()
    _, sample, _ = units(batches[0], dim) if batches else (None, np.empty((0, dim), np.float32), None)
    if len(sample) < 2:
        sample = np.vstack([sample, np.eye(dim, dtype=np.float32)[:2]])
    # eight sampled strings a border at least; past that buckets grow instead
    buckets = max(1, min(-(-total // rows_per_bucket), sample_rows // 8))
    model = fit(sample, trees, buckets, width, seed, block / rows_per_bucket)
    shared = spark.sparkContext.broadcast(model)  # a few hundred kB, with many hot strings a few MB, whatever the size of the data

    def deal(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            ids, x, _ = units(batch, dim)
            if len(ids) == 0:
                continue
            codes = encode(x, m.centres)
            parts, blobs = [], []
            for t in range(len(m.planes)):
                strings = m.strings(x, t)
                more, above = m.guests(strings, t)
                where = np.concatenate([m.bucket(strings, ids, t, x), above])
                row = np.concatenate([np.arange(len(ids)), more])
                by = np.argsort(where, kind="stable")
                edges = np.flatnonzero(np.diff(where[by], prepend=-1))
                own = row[by]
                entry = np.empty(len(own), np.dtype([("h", "u8"), ("i", "i8"), ("c", "i1", (HEAD + dim,))]))
                entry["h"], entry["i"], entry["c"] = strings[own], ids[own], codes[own]
                for lo, hi in zip(edges, [*edges[1:], len(own)], strict=True):
                    parts.append(t * m.buckets + int(where[by[lo]]))
                    blobs.append(entry[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    margin = 0.006  # more than the error that one byte per dimension makes

    per_tree = model.buckets

    def meet(group):
        import pyarrow as pa

        kind = np.dtype([("h", "u8"), ("i", "i8"), ("c", "i1", (HEAD + dim,))])
        e = np.concatenate([np.frombuffer(b, kind) for b in group.column("blob").to_pylist()])
        tree = group.column("part")[0].as_py() // per_tree
        a, b, s = neighbours(e["h"], e["i"], e["c"], shared.value.centres, k, least - margin - 1, block, tree)
        return pa.table({"id_a": a, "id_b": b, "sim": s.astype(np.float32)})

    dealt = rows.mapInArrow(deal, "part INT, blob BINARY").repartition(min(trees * buckets, 20_000), "part")
    pairs = dealt.groupBy("part").applyInArrow(meet, out).groupBy("id_a", "id_b").agg(F.max("sim").alias("sim"))
    both = F.array(F.struct(F.col("id_a").alias("id"), F.col("id_b").alias("other")), F.struct(F.col("id_b").alias("id"), F.col("id_a").alias("other")))
    rough = Window.partitionBy("e.id").orderBy(F.desc("sim"), F.asc("e.other"))
    # a few more than k per row, so that the exact cosines decide
    near = pairs.select(F.explode(both).alias("e"), "sim").withColumn("n", F.row_number().over(rough)).where(F.col("n") <= 2 * k)
    near = cut(near.select(F.least("e.id", "e.other").alias("id_a"), F.greatest("e.id", "e.other").alias("id_b")).distinct())
    exact = cosines(rows, near, dim).where(F.col("cosine") >= least)
    final = Window.partitionBy("e.id").orderBy(F.desc("cosine"), F.asc("e.other"))
    ranked = exact.select(F.explode(both).alias("e"), "cosine").withColumn("place", F.row_number().over(final)).where(F.col("place") <= k)
    return ranked.select(F.col("e.id").alias(key), F.col("e.other").alias("other"), "cosine", "place")


def cosines(rows: DataFrame, pairs: DataFrame, dim: int) -> DataFrame:
    """Exact cosine of every pair (id_a, id_b) from the vectors of ``rows`` (id, v).

    Only vectors that occur in a pair travel: the ids are broadcast if there are few, else joined.
    """
    named = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    few = small(named)
    wanted = rows.join(F.broadcast(named) if few else named, "id", "left_semi").where(F.size("v") == dim).dropDuplicates(["id"])
    a = wanted.select(F.col("id").alias("id_a"), F.col("v").alias("va"))
    b = wanted.select(F.col("id").alias("id_b"), F.col("v").alias("vb"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (np.asarray(batch.column(c).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim) for c in (2, 3))
            dot = np.einsum("ij,ij->i", x, y)
            cos = dot / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            # equal up to rounding counts as equal, so that ties go by key
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(cos, 9))], names=["id_a", "id_b", "cosine"])

    joined = pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", "va", "vb")
    return joined.mapInArrow(run, "id_a BIGINT, id_b BIGINT, cosine DOUBLE")
