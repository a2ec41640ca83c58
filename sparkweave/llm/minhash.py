"""Near-duplicate documents by HyperMinHash.

The distinct 3-word shingles of a text are thrown into 192 buckets by a hash; a bucket keeps the least of the hash
values it gets. Shingles are thrown again, with other hashes, for the buckets that are still empty, and in the end each
remaining bucket takes the least over all shingles; so every bucket of every text is filled and two texts agree
in a bucket with the probability of their Jaccard coefficient, at a cost of the shingles plus a constant. (Buckets left empty would
make bands of short texts that share one passage agree.)
A bucket is stored as a 16-bit register: its count of leading zeros (6 bits) and the 10 bits after the first one.
Bands of 4 registers (48 of them: a pair at the least coefficient shares one with the probability 0.95) are the candidate keys; pairs that share a band are screened with the
collision-corrected Jaccard estimate of their registers and then verified on the texts, with the exact Jaccard coefficient.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.neardup import bucket_groups
from sparkweave.llm.textarrays import groups, mix, words_of
from sparkweave.session import small_batches, written

#: Words of a shingle, least Jaccard coefficient, registers, registers of a band, mantissa bits.
SHINGLE, LEAST, REGISTERS, BAND, MANTISSA = 3, 0.5, 192, 4, 10
#: Throws at random before each empty bucket is filled for itself.
THROWS = 12
#: Ids of documents to verify that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_SALT = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct shingles of each text, sorted. A text of fewer words has one shingle of all; one without words has none."""
    w = words_of(texts)
    n = len(w.hash)
    count = np.bincount(w.doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    h = w.hash.copy()
    for j in range(1, k):
        if n > j:  # words past the end of their text add nothing; a shingle that isn't whole is dropped below
            same = w.doc[:-j] == w.doc[j:]
            h[:-j] = np.where(same, mix(h[:-j] * np.uint64(3) + w.hash[j:] + np.uint64(j)), h[:-j])
    place = np.arange(n) - first[w.doc]
    whole = (place + k <= count[w.doc]) | (place == 0)
    doc, h = w.doc[whole], h[whole]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def sketch(doc: np.ndarray, h: np.ndarray, texts: int, registers: int = REGISTERS, mantissa: int = MANTISSA) -> np.ndarray:
    """HyperMinHash registers, ``texts x registers`` of uint16: leading zeros + 1, then the mantissa; all 0 for a text without shingles.

    ``doc`` must be sorted.
    """
    least = np.full(texts * registers, np.uint64(0xFFFFFFFFFFFFFFFF))
    filled = np.zeros(texts * registers, bool)
    d, x = doc, h
    for k in range(THROWS):
        g = mix(x ^ np.uint64((int(_SALT) * (k + 1)) & 0xFFFFFFFFFFFFFFFF))
        slot = d * registers + ((g >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
        free = ~filled[slot]
        slot = slot[free]
        np.minimum.at(least, slot, mix(g[free] + _SALT))
        filled[slot] = True
        open_ = ~filled.reshape(texts, registers).all(1)[d]
        d, x = d[open_], x[open_]
        if not len(d):
            break
    size = np.bincount(doc, minlength=texts)
    first = np.cumsum(size) - size
    row, bucket = np.nonzero(~filled.reshape(texts, registers) & (size > 0)[:, None])
    for lo in range(0, len(row), 20_000):
        r, b = row[lo : lo + 20_000], bucket[lo : lo + 20_000]
        n = size[r]
        at = np.repeat(first[r] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        slot = np.repeat(r * registers + b, n)
        np.minimum.at(least, slot, mix(h[at] ^ mix(np.repeat(b, n).astype(np.uint64) + _SALT)))
    zeros = np.clip(63 - np.floor(np.log2(np.maximum(1, least >> np.uint64(11)).astype(np.float64))).astype(np.int64) - 11, 0, 62)
    after = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - mantissa)
    out = ((zeros + 1).astype(np.uint16) << np.uint16(mantissa)) | after.astype(np.uint16)
    return np.where(np.repeat(size > 0, registers), out, 0).astype(np.uint16).reshape(texts, registers)


def band_keys(regs: np.ndarray, band: int = BAND) -> np.ndarray:
    """64-bit key of each band of each text; 0 for a text without shingles."""
    texts, n = regs.shape
    bands = n // band
    r = regs[:, : bands * band].reshape(texts, bands, band).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (texts, bands)).copy()
    for j in range(band):
        h = mix(h * np.uint64(0x100000001B3) + r[:, :, j])
    h[(r == 0).all(2)] = 0
    return h


def estimate(a: np.ndarray, b: np.ndarray, mantissa: int = MANTISSA) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimate of pairs of sketches and the registers used, corrected for registers that agree by chance.

    Two unequal least hashes agree in a register if they have the same leading zeros and, with the probability 2^-mantissa, the same
    mantissa. How often zeros agree follows from how they are distributed over the registers of either text.
    """
    used = (a > 0) | (b > 0)
    n = used.sum(1)
    same = ((a == b) & used).sum(1)
    chance = np.zeros(len(a))
    za, zb = a >> np.uint16(mantissa), b >> np.uint16(mantissa)
    for z in range(1, 64):
        pa, pb = (za == z).mean(1), (zb == z).mean(1)
        chance += pa * pb
    chance *= 2.0**-mantissa
    m = np.maximum(1, n)
    return np.clip((same / m - chance) / (1 - chance), 0, 1), n


def _verify(a: list[str], b: list[str], least: float) -> np.ndarray:
    out = np.zeros(len(a))
    for lo, hi in groups([x + y for x, y in zip(a, b)], 2_000_000):
        k = hi - lo
        doc, h = shingles(a[lo:hi] + b[lo:hi])
        pair = doc % k
        sizes = np.bincount(pair, minlength=k)
        order = np.lexsort((h, pair))
        p, g = pair[order], h[order]
        both = np.bincount(p[1:][(p[1:] == p[:-1]) & (g[1:] == g[:-1])], minlength=k)
        out[lo:hi] = both / np.maximum(1, sizes - both)
    return out >= least


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = LEAST, registers: int = REGISTERS, band: int = BAND) -> DataFrame:
    """One row per document: ``(doc_id, group_id, group_size, keep)``.

    Groups are the connected components of pairs with a Jaccard coefficient of word shingles of at least ``least``; the
    least id of a group is its ``group_id`` and the one to keep. Case and punctuation do not count. Null and empty texts and texts
    without a word are near duplicates of nothing. Rows that repeat an id are one document, whose text is the
    greatest of theirs; rows with a null id are left out. An empty table gives an empty result; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    # Only the ids that repeat are grouped, so that no other text is shuffled.
    twice = written(slim.groupBy("id").count().where("count > 1").select("id"), "repeated")
    n = twice.count()
    if n:
        some = F.broadcast(twice) if n <= BROADCAST_IDS else twice
        slim = slim.join(some, "id", "left_anti").union(slim.join(some, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")))

    def sketches(batches):
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for lo, hi in groups(texts, 500_000):
                doc, h = shingles(texts[lo:hi])
                k = hi - lo
                regs = sketch(doc, h, k, registers)
                size = np.bincount(doc, minlength=k)
                sums, mixed = np.zeros(k, np.uint64), np.zeros(k, np.uint64)
                np.add.at(sums, doc, h)
                np.add.at(mixed, doc, mix(h + np.uint64(1)))
                keys = band_keys(regs, band).view(np.int64)
                yield pd.DataFrame({"id": b["id"].values[lo:hi], "size": size, "s1": sums.view(np.int64), "s2": mixed.view(np.int64), "keys": [r[r != 0] for r in keys], "regs": [r.tobytes() for r in regs]})

    made = slim.where("text is not null").mapInPandas(sketches, "id long, size long, s1 long, s2 long, keys array<long>, regs binary").where("size > 0")
    made = written(made, "sketches")
    # Texts of the same shingles are one before any banding: 128 bits of set hash and the size stand for the set.
    same = made.groupBy("s1", "s2", "size").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    several = same.where("n > 1").select("s1", "s2", "size", "rep")
    copies = written(made.select("id", "s1", "s2", "size").join(several, ["s1", "s2", "size"]).where("id <> rep").select("id", "rep").distinct(), "copies")
    reps = made.join(copies, "id", "left_anti")

    def screen(batches):
        for b in batches:
            if len(b):
                j, n = estimate(np.frombuffer(b"".join(b["ra"]), np.uint16).reshape(len(b), -1), np.frombuffer(b"".join(b["rb"]), np.uint16).reshape(len(b), -1))
                yield b.loc[j >= least - 3.5 * np.sqrt(0.25 / np.maximum(1, n)), ["a", "b"]]

    def verified(batches):
        for b in batches:
            if len(b):
                yield b.loc[_verify(list(b["ta"]), list(b["tb"]), least), ["a", "b"]]

    regs = made.select("id", "regs")

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(regs.toDF("a", "ra"), "a").join(regs.toDF("b", "rb"), "b").mapInPandas(screen, "a long, b long")
        pairs = written(pairs.distinct(), "screened")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        n = ids.count()
        if n == 0:
            return pairs
        wanted = slim.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
        wanted = written(wanted, "texts")
        full = pairs.join(wanted.toDF("a", "ta"), "a").join(wanted.toDF("b", "tb"), "b")
        return full.mapInPandas(verified, "a long, b long")

    rows = reps.select(F.explode("keys").alias("key"), "id")
    found = bucket_groups(rows, confirm)
    through = copies.join(found, copies["rep"] == found["id"], "left").select(copies["id"], F.coalesce("group", "rep").alias("group"))
    grouped = found.union(through).union(copies.join(found, copies["rep"] == found["id"], "left_anti").select(F.col("rep").alias("id"), F.col("rep").alias("group")).distinct())
    sizes = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    grouped = grouped.join(sizes, "group").select(F.col("id").alias("_id"), "group", "n")
    every = slim.select("id").distinct()
    out = every.join(grouped, every["id"] == grouped["_id"], "left")
    group = F.coalesce("group", "id")
    return out.select(F.col("id").alias("doc_id"), group.alias("group_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (group == F.col("id")).alias("keep"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """The rows of the documents that :func:`near_duplicates` keeps; rows with a null id stay."""
    gone = near_duplicates(docs, id_col, text, **params).where("not keep").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")


#: All pairs that share a shingle, exact Jaccard coefficient, connected components.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < {SHINGLE} THEN w ELSE w[i : i + {SHINGLE - 1}] END, ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {LEAST} * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS g FROM documents UNION SELECT u.b, r.g FROM r JOIN u ON u.a = r.id WHERE r.g < u.b),
g AS (SELECT id AS doc_id, min(g) AS group_id FROM r GROUP BY id)
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, doc_id = group_id AS keep FROM g
"""
