"""Hierarchical language identification with linear support vector machines.

The first level tells language families apart, one machine for each pair of families; the second, one
machine for each pair of languages of a family, tells close relatives apart. A machine is linear in the
mean of hashed character 1- to 3-grams, so a text of any length is scored in one pass:
gather a weight row per character, add up per text, divide.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.session import small_batches

from sparkweave.llm.textarrays import codes_of, groups, mix

#: Families of the languages that may occur; a language in none of them is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "af", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
#: Labelled documents used for training, for each language at most; hash buckets.
TRAIN_PER_LANGUAGE, BUCKETS = 300, 1 << 13
UNKNOWN = "und"


def _grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket of the 1-, 2- and 3-gram that starts at each character; weight 0 where it has no letter; text offsets."""
    codes, offsets = codes_of(texts)
    c = codes.astype(np.uint32)
    letter = (c > 64) & ~((c > 90) & (c < 97)) & ~((c > 122) & (c < 192))
    c = np.where(letter, c, np.uint32(32))
    pad = np.concatenate([c, np.full(2, 32, np.uint32)])
    k1, k2, k3 = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
    one = pad[:-2] * k1
    two = one ^ (pad[1:-1] * k2 + np.uint32(0x27D4EB2F))
    third = pad[2:].copy()
    third[np.maximum(0, offsets[1:] - 2)] = 32  # the last character of a text, so that none is seen with the next text's first
    three = two ^ (third * k3 + np.uint32(0x165667B1))
    shift = np.uint32(32 - int(BUCKETS).bit_length() + 1)
    return [((g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> shift for g in (one, two, three)], letter, offsets


def features(texts: list[str]) -> np.ndarray:
    """Mean gram counts of each text, for training."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for lo, hi in groups(texts, 300_000):
        buckets, letter, offsets = _grams(texts[lo:hi])
        doc = np.repeat(np.arange(lo, hi), np.diff(offsets))[letter]
        own = doc - lo
        for b in buckets:
            out[lo:hi] += np.bincount(own * BUCKETS + b[letter], minlength=(hi - lo) * BUCKETS).reshape(hi - lo, BUCKETS)
    out /= np.maximum(1, out.sum(1, keepdims=True))
    return out


def _machine(x: np.ndarray, y: np.ndarray, rounds: int = 80, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by accelerated gradient; classes count equally."""
    s = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    probe, lift = np.ones(x.shape[1], np.float32), np.float32(1)
    size = 1.0
    for _ in range(12):  # power iteration for the largest curvature, the bias a feature of its own
        r = s * (x @ probe + lift)
        probe, lift = r @ x, r.sum()
        size = float(np.sqrt(probe @ probe + lift * lift)) or 1.0
        probe, lift = probe / np.float32(size), lift / np.float32(size)
    top = np.float32(size * 1.1 * 2 * c + 1e-3)
    w = v = np.zeros(x.shape[1], np.float32)
    b0 = b = np.float32(0)
    for k in range(rounds):
        miss = s * y * np.maximum(0, 1 - y * (x @ v + b))
        new, newb = v - (1e-3 * v - 2 * c * (miss @ x)) / top, b - (1e-3 * b - 2 * c * miss.sum()) / top
        go = np.float32(k / (k + 3))
        v, w, b, b0 = new + go * (new - w), new, newb + go * (newb - b0), newb
    return w.astype(np.float32), float(b0)


def family_of(lang: str, families: dict = FAMILIES) -> str:
    return next((f for f, members in families.items() if lang in members), lang)


def train(texts: list[str], langs: list[str], families: dict = FAMILIES, seed: int = 7) -> dict:
    """Machines ``{"pairs": [(level, a, b)], "weights": buckets x machines, "bias", "families": {family: [language]}}``."""
    rng = np.random.default_rng(seed)
    samples, names = [], []
    for t, lang in zip(texts, langs):  # whole texts and a short stretch of each, since texts of a few words occur
        samples += [t, t[(a := int(rng.integers(0, max(1, len(t) - 60)))) : a + int(rng.integers(15, 60))]]
        names += [lang, lang]
    x = features(samples)
    scale = np.float32(0.1 / max(1e-9, float(np.sqrt(np.einsum("ij,ij->", x, x, dtype=np.float64) / max(1, x.size)))))
    x *= scale
    name, family = np.array(names), np.array([family_of(n, families) for n in names])
    groups_ = {str(f): sorted(map(str, set(name[family == f]))) for f in sorted(set(family))}
    pairs, ws, bs = [], [], []
    for level, labels, options in [("family", family, sorted(groups_))] + [("language", name, v) for v in groups_.values()]:
        for a, b in combinations(options, 2):
            rows = (labels == a) | (labels == b)
            w, bias = _machine(x if rows.all() else x[rows], np.where(labels[rows] == a, 1, -1).astype(np.float32))
            pairs.append((level, a, b))
            ws.append(w * scale)
            bs.append(bias)
    weights = np.stack(ws, 1).astype(np.float32) if ws else np.zeros((BUCKETS, 0), np.float32)
    return {"pairs": pairs, "weights": weights, "bias": np.array(bs, np.float32), "families": groups_}


def identify_texts(model: dict, texts: list[str | None]) -> tuple[list[str], list[str], np.ndarray]:
    """Family, language and margin (least |score| of the machines that decided) of each text."""
    n, m = len(texts), len(model["pairs"])
    score, count = np.zeros((n, m)), np.zeros(n)
    filled = [t or "" for t in texts]
    columns = [np.ascontiguousarray(model["weights"][:, k]) for k in range(m)]
    for lo, hi in groups(filled):
        buckets, letter, offsets = _grams(filled[lo:hi])
        w = letter.astype(np.float32)
        count[lo:hi] = 3 * np.add.reduceat(w, offsets[:-1])
        for b in buckets:
            for k in range(m):
                score[lo:hi, k] += np.add.reduceat(columns[k][b] * w, offsets[:-1], dtype=np.float64)
    score = score / np.maximum(1, count)[:, None] + model["bias"]

    def vote(level: str, options: list[str]) -> tuple[np.ndarray, np.ndarray]:
        votes, total, margin = np.zeros((n, len(options))), np.zeros((n, len(options))), np.zeros((n, len(options)))
        margin[:] = np.inf
        for k, (at, a, b) in enumerate(model["pairs"]):
            if at == level and a in options and b in options:
                i, j, s = options.index(a), options.index(b), score[:, k]
                votes[:, i] += s >= 0
                votes[:, j] += s < 0
                total[:, i] += s
                total[:, j] -= s
                margin[:, i], margin[:, j] = np.minimum(margin[:, i], np.abs(s)), np.minimum(margin[:, j], np.abs(s))
        best = (votes + 1e-3 * np.tanh(total)).argmax(1) if options else np.zeros(n, int)
        return best, margin[np.arange(n), best] if options else np.full(n, np.inf)

    families = sorted(model["families"])
    best, margin = vote("family", families)
    family = [families[k] if families else UNKNOWN for k in best]
    lang = [UNKNOWN] * n
    for f, options in model["families"].items():
        inner, m2 = vote("language", options)
        for r in range(n):
            if family[r] == f:
                lang[r], margin[r] = options[inner[r]], min(margin[r], m2[r])
    for r in np.flatnonzero(count == 0):
        family[r] = lang[r] = UNKNOWN
        margin[r] = 0
    return family, lang, np.where(np.isinf(margin), 0, margin)


def training_sample(docs: DataFrame, id_col: str, text: str, lang: str, per_language: int) -> tuple[list[str], list[str]]:
    """Up to ``per_language`` labelled documents of each language, those with the lowest hash of the id; of rows that repeat an id and a language the greatest text is taken."""
    from pyspark.sql import Window

    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(lang).alias("_lang")).where("_lang is not null and _id is not null")
    counts = slim.groupBy("_lang").count().collect()
    if not counts:
        return [], []
    # A hash range that holds a few times the sample leaves little to sort; ids and labels alone are read for it.
    share = {r["_lang"]: min(1.0, 3 * per_language / r["count"]) for r in counts}
    limit = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])
    low = slim.withColumn("_h", F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / (1 << 30)).where(F.col("_h") <= F.try_element_at(limit, F.col("_lang")))
    picked = low.withColumn("_k", F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_id"))).where(F.col("_k") <= per_language).select("_id", "_lang")
    ids = [(r["_id"], r["_lang"]) for r in picked.collect()]  # bounded by per_language times the languages
    table = F.broadcast(docs.sparkSession.createDataFrame(ids, "_id long, _lang string"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text")).join(table, "_id").where("_text is not null").groupBy("_id", "_lang").agg(F.max("_text").alias("_text")).orderBy("_id", "_lang").toPandas()
    return list(rows["_text"]), list(rows["_lang"])


def identify(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", lang: str = "lang", families: dict = FAMILIES, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """One row per document: ``(doc_id, family, language, margin)``.

    Trained on the language labels of ``labelled`` (by default ``docs``), a bounded sample; applied to whole texts of all documents.
    Null texts and texts without a letter are ``und`` with margin 0, as is everything if there are no labels.
    Repeated rows get a row each, a null id stays null; an empty table gives an empty result; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = train(*training_sample(labelled if labelled is not None else docs, id_col, text, lang, per_language), families)

    def score(batches):
        for b in batches:
            family, language, margin = identify_texts(model, [t if isinstance(t, str) else None for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "family": family, "language": language, "margin": margin})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInPandas(score, "doc_id long, family string, language string, margin double")
