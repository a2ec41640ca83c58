"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a unit vector passes it if their inner product is at least ``alpha``. The
directions are a random product code: the coordinates are rotated and split into blocks, each block has a few random code words, and a
direction is one code word of each block. So the inner products with all directions are sums of a few numbers, and
the directions that a vector passes are listed by adding up block after block and dropping what can't reach ``alpha`` any more.
The filters of one code are not independent, so several codes are used: as
many as it takes for random pairs right at the least cosine to have a filter in common in at least ``RECALL`` of the cases.

The join on filters carries no vectors, only ids and 128 sign bits of random projections. Pairs of a filter whose sign bits differ in
more places than pairs at the least cosine do (but one in 10,000) are dropped; of what is left a spanning forest of each filter is verified with
the vectors. Where an edge of a forest fails, all pairs of that filter that are still in different groups are verified too.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.graph import local
from sparkweave.graph.components import component_stars
from sparkweave.session import drop_written, written

#: Least cosine, blocks, filters of a code that a vector passes on average, vectors of a filter on average, share of pairs to be found.
LEAST, BLOCKS, PASSES, FILTER_SIZE, RECALL = 0.9, 2, 1, 64, 0.97
#: Random pairs on which the number of codes is settled; codes at most; sign bits; standard deviations beyond the mean that they may differ.
TRIALS, MOST_CODES, BITS, SIGMAS = 1000, 64, 128, 4.0
#: Numbers of a table of inner products that are worked out at once; ids that are broadcast, more are joined by a shuffle.
CELLS, BROADCAST_IDS = 2_000_000, 1_000_000


def code(dim: int, words: int, blocks: int = BLOCKS, seed: int = 11) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation and, for each block of rotated coordinates, its unit code words."""
    rng = np.random.default_rng([seed, dim, words])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    out = []
    for part in np.array_split(np.arange(dim), blocks):
        c = rng.standard_normal((words, len(part)))
        out.append(c / np.maximum(1e-12, np.linalg.norm(c, axis=1, keepdims=True)) if len(part) else np.zeros((words, 0)))
    return rotation, out


def cap(share: float, dim: int) -> float:
    """The inner product with a fixed direction that this share of random unit vectors exceeds."""
    x = np.linspace(-1, 1, 200_001)
    density = np.power(np.maximum(0, 1 - x * x), max(0.0, (dim - 3) / 2))
    above = 1 - np.cumsum(density) / density.sum()
    return float(x[np.searchsorted(-above, -share)])


@lru_cache(maxsize=64)
def plan(vectors: int, dim: int, least: float = LEAST, passes: float = PASSES, blocks: int = BLOCKS) -> tuple[int, float, int]:
    """Code words of a block, alpha and number of codes: filters in proportion to the vectors, alpha so that a vector passes about
    ``passes`` of a code's filters, codes so that random pairs at the least cosine meet."""
    words = max(4, math.ceil((max(1, vectors) * passes / FILTER_SIZE) ** (1 / blocks)))
    alpha = cap(min(0.4, passes / words**blocks), max(2, dim))
    rng = np.random.default_rng([5, dim])
    a, side = rng.standard_normal((2, TRIALS, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.maximum(1e-12, np.linalg.norm(side, axis=1, keepdims=True))
    b, met = least * a + math.sqrt(max(0, 1 - least * least)) * side, np.zeros(TRIALS, bool)
    for k in range(1, MOST_CODES + 1):
        rotation, c = code(dim, words, blocks, k)
        (va, fa), (vb, fb) = list_decode(a @ rotation, c, alpha), list_decode(b @ rotation, c, alpha)
        size = words**blocks
        met[np.intersect1d(va * size + fa, vb * size + fb) // size] = True
        if met.mean() >= RECALL:
            return words, alpha, k
    raise ValueError(f"{MOST_CODES} codes are not enough for a cosine of {least} in {dim} dimensions")


def list_decode(unit: np.ndarray, words: list[np.ndarray], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """``(vector number, filter number)`` of all filters that each of the (rotated) vectors passes; the best one if it passes none."""
    scale, at, parts = 1 / math.sqrt(len(words)), 0, []
    for c in words:
        parts.append(unit[:, at : at + c.shape[1]] @ c.T * scale)
        at += c.shape[1]
    tops = np.stack([p.max(1) for p in parts], 1)
    reach = np.concatenate([np.cumsum(tops[:, ::-1], 1)[:, ::-1][:, 1:], np.zeros((len(unit), 1))], 1)
    need = np.minimum(alpha, tops.sum(1) - 1e-9)
    vec, name, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for k, p in enumerate(parts):
        step, found = max(1, CELLS // p.shape[1]), []
        for lo in range(0, len(vec), step):
            v = vec[lo : lo + step]
            sums = total[lo : lo + step, None] + p[v]
            row, word = np.nonzero(sums + reach[v, k][:, None] >= need[v][:, None])
            found.append((sums[row, word], name[lo : lo + step][row] * p.shape[1] + word, v[row]))
        if found:
            total, name, vec = (np.concatenate(c) for c in zip(*found))
    return vec, name


def signs(unit: np.ndarray) -> np.ndarray:
    """128 sign bits of random projections of each vector, as two numbers of 64 bits."""
    planes = np.random.default_rng([13, unit.shape[1]]).standard_normal((unit.shape[1], BITS))
    return np.packbits(unit @ planes > 0, axis=1).view(np.int64)


def most_apart(least: float) -> int:
    """Sign bits in which vectors at the least cosine differ at most, within :data:`SIGMAS` standard deviations."""
    p = math.acos(max(-1.0, min(1.0, least))) / math.pi
    return math.ceil(BITS * p + SIGMAS * math.sqrt(BITS * p * (1 - p)))


def _alike(s: np.ndarray, most: int, block: int = 1024):
    """Pairs ``(i, j)``, i < j, of rows of sign bits that differ in at most so many places, a block at a time."""
    s = s.view(np.uint64)
    for i in range(0, len(s), block):
        for j in range(i, len(s), block):
            x, y = s[i : i + block, None], s[None, j : j + block]
            near = np.bitwise_count(x[..., 0] ^ y[..., 0]) + np.bitwise_count(x[..., 1] ^ y[..., 1]) <= most
            a, b = np.nonzero(np.triu(near, 1) if i == j else near)
            yield a + i, b + j


def _forest(n: int, s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs that are alike, and the least member of each one's tree."""
    us, vs, label = [], [], np.arange(n)
    for a, b in _alike(s, most):
        while len(a):  # one edge of each tree to the least other tree it meets, until none meets another
            ta, tb = label[a], label[b]
            apart = ta != tb
            a, b, ta, tb = a[apart], b[apart], ta[apart], tb[apart]
            if not len(a):
                break
            order = np.lexsort((np.minimum(ta, tb), np.maximum(ta, tb)))
            first = order[np.flatnonzero(np.diff(np.maximum(ta, tb)[order], prepend=-1))]
            us.append(a[first])
            vs.append(b[first])
            name, low = local.components(ta[first], tb[first])
            to = np.arange(n)
            to[name] = low
            label = to[label]
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(us), cat(vs), label


def _by_key(batches):
    """Frames of whole keys from batches that are sorted by key: a key that a batch ends in waits for the next batch."""
    rest: list[pd.DataFrame] = []
    for b in itertools.chain(batches, [None]):
        if b is not None:
            if not len(b):
                continue
            key = b["key"].values
            if key[0] == key[-1] and (not rest or rest[0]["key"].values[0] == key[0]):
                rest.append(b)
                continue
            start = int(np.searchsorted(key, key[-1]))
            rest.append(b.iloc[:start])
            now, rest = pd.concat(rest, ignore_index=True), [b.iloc[start:]]
        elif rest:
            now, rest = pd.concat(rest, ignore_index=True), []
        else:
            continue
        yield now


def near_duplicate_vectors(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = LEAST, passes: float = PASSES) -> DataFrame:
    """One row per vector: ``(vec_id, group_id, group_size, keep)``; groups are the connected components of pairs with a cosine of at least ``least``.

    The least id of a group is its ``group_id`` and the one to keep. Null vectors, vectors of length 0 and those with a null, NaN or
    infinite part are near duplicates of nothing; vectors of different dimension are never compared. Rows that repeat an id are
    one vector, the greatest of theirs; rows with a null id are left out. An empty table gives an empty result; further columns are
    ignored. A pair at the least cosine is a candidate with the probability :data:`RECALL`, a closer one with a higher.
    """
    slim = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id is not null")
    # Only the ids that repeat are grouped, so that no other vector is shuffled.
    twice = written(slim.groupBy("id").count().where("count > 1").select("id"), "repeated")
    n = twice.count()
    if n:
        some = F.broadcast(twice) if n <= BROADCAST_IDS else twice
        slim = slim.join(some, "id", "left_anti").union(slim.join(some, "id", "left_semi").groupBy("id").agg(F.max("v").alias("v")))
    good = slim.where("v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = float('infinity')) and exists(v, x -> x <> 0)")
    # Equal vectors are one before any filter: 128 bits of hash stand for the vector.
    hashed = good.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    several = hashed.groupBy("h1", "h2").agg(F.min("id").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = written(hashed.join(several, ["h1", "h2"]).where("id <> u").select("u", F.col("id").alias("v")), "copies")
    n = copies.count()
    gone = copies.select(F.col("v").alias("id"))
    reps = good.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, "id", "left_anti") if n else good
    counts = {r["d"]: r["count"] for r in reps.groupBy(F.size("v").alias("d")).count().collect()}
    dims = sorted(counts)
    plans = {d: plan(counts[d], d, least, passes) for d in dims}
    most = most_apart(least)

    def decode(batches):
        codes = {(d, k): code(d, words, BLOCKS, k) for d, (words, _, n) in plans.items() for k in range(1, n + 1)}
        for b in batches:
            sizes = b["v"].map(len).values
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                words, alpha, n = plans[d]
                step = max(1, min(2048, CELLS // max(words, d, BITS)))
                for lo in range(0, len(rows), step):
                    part = b.iloc[rows[lo : lo + step]]
                    x = np.stack(part["v"].to_list()).astype(np.float64)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    ids, s = part["id"].values, signs(x)
                    for k in range(1, n + 1):
                        rotation, c = codes[d, k]
                        vec, name = list_decode(x @ rotation, c, alpha)
                        key = (name * n + k - 1) * len(dims) + dims.index(d)
                        yield pd.DataFrame({"key": key, "id": ids[vec], "s1": s[vec, 0], "s2": s[vec, 1]})

    def first_look(batches):
        """Pairs ``(key, a, b)`` to verify and, of trees of three or more, the members ``(key, a, s1, s2)``."""
        for now in _by_key(batches):
            key, ids, s = now["key"].values, now["id"].values, now[["s1", "s2"]].values
            starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            out = []
            for lo, hi in zip(starts, np.append(starts[1:], len(key))):
                if hi - lo > 1:
                    u, v, label = _forest(hi - lo, s[lo:hi], most)
                    if len(u):
                        a, b = ids[lo:hi][u], ids[lo:hi][v]
                        out.append(pd.DataFrame({"key": key[lo], "a": np.minimum(a, b), "b": np.maximum(a, b), "s1": 0, "s2": 0}))
                        large = np.flatnonzero(np.bincount(label, minlength=hi - lo)[label] > 2)
                        if len(large):
                            out.append(pd.DataFrame({"key": key[lo], "a": ids[lo:hi][large], "b": -1, "s1": s[lo:hi][large, 0], "s2": s[lo:hi][large, 1]}).assign(member=True))
            if out:
                made = pd.concat(out, ignore_index=True)
                made["member"] = made["member"].eq(True) if "member" in made else False
                yield made

    def second_look(batches):
        """All pairs of a filter that are alike and in different groups."""
        for now in _by_key(batches):
            key, ids, g, s = now["key"].values, now["id"].values, now["g"].values, now[["s1", "s2"]].values
            starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            for lo, hi in zip(starts, np.append(starts[1:], len(key))):
                for i, j in _alike(s[lo:hi], most):
                    apart = g[lo:hi][i] != g[lo:hi][j]
                    if apart.any():
                        a, b = ids[lo:hi][i[apart]], ids[lo:hi][j[apart]]
                        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def verified(batches):
        for b in batches:
            for lo in range(0, len(b), 4096):
                part = b.iloc[lo : lo + 4096]
                sizes = part["va"].map(len).values
                keep = np.zeros(len(part), bool)
                for d in np.unique(sizes):
                    k = np.flatnonzero(sizes == d)
                    x, y = (np.stack(part[c].iloc[k].to_list()).astype(np.float64) for c in ("va", "vb"))
                    keep[k] = (x * y).sum(1) >= least * np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
                yield part.loc[keep, ["a", "b"]]

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.distinct(), "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        n = ids.count()
        if n == 0:
            return pairs
        wanted = written(reps.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "id", "left_semi"), "wanted")
        full = pairs.join(wanted.toDF("a", "va"), "a").join(wanted.toDF("b", "vb"), "b")
        sure = written(full.mapInPandas(verified, "a long, b long"), "sure")
        drop_written(wanted)
        return sure

    shape = "key long, id long, s1 long, s2 long"
    passed = reps.select("id", "v").mapInPandas(decode, shape).repartition("key").sortWithinPartitions("key")
    looked = written(passed.mapInPandas(first_look, "key long, a long, b long, s1 long, s2 long, member boolean"), "candidates")
    pairs = looked.where("not member").select("key", "a", "b")
    sure = confirm(pairs.select("a", "b"))
    stars = component_stars(sure.toDF("u", "v").union(copies))
    failed = written(pairs.join(sure, ["a", "b"], "left_anti").select("key").distinct(), "failed")
    members = looked.where("member").select("key", F.col("a").alias("id"), "s1", "s2").join(failed, "key", "left_semi")
    if not members.isEmpty():
        at = members.join(stars, members["id"] == stars["u"], "left").select("key", "id", "s1", "s2", F.coalesce("v", "id").alias("g"))
        more = confirm(at.repartition("key").sortWithinPartitions("key").mapInPandas(second_look, "a long, b long"))
        if not more.isEmpty():
            stars = component_stars(stars.union(more))
    stars = stars.toDF("_id", "group")
    stars = stars.union(stars.select("group", "group").distinct())
    sizes = stars.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    found = stars.join(sizes, "group")
    out = slim.select("id").join(found, F.col("id") == F.col("_id"), "left")
    group = F.coalesce("group", "id")
    return out.select(F.col("id").alias("vec_id"), group.alias("group_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (group == F.col("id")).alias("keep"))


#: All pairs, connected components.
ORACLE = f"""
WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
                     WHERE list_cosine_similarity(a.embedding, b.embedding) >= {LEAST}),
r AS (SELECT vec_id AS id, vec_id AS g FROM embeddings UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id WHERE r.g < e.b),
g AS (SELECT id AS vec_id, min(g) AS group_id FROM r GROUP BY id)
SELECT vec_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, vec_id = group_id AS keep FROM g
"""
