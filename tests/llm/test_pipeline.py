"""The pipeline's stages against brute-force versions on a small corpus, and the queries against their SQL."""

import random
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from sparkweave.llm import mixing, packing, secrets, toxicity
from sparkweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    from test_dedup_media import copies

    rng = random.Random(8)
    texts = copies(4)
    rows = [(k, t, "en", f"src{k % 5 if k % 3 else 0}", len(t)) for k, t in texts.items()]
    n = len(rows)
    labels = []
    for k in range(n, n + 120):
        words = ["".join(rng.choice(["ta", "lo", "mi", "ren", "sol"]) for _ in range(3)) for _ in range(rng.randint(5, 90))]
        toxic = k % 3 == 0
        if toxic:
            words.insert(rng.randint(0, len(words)), rng.choice(["stupid", "idiot", "scum"]))
        if k % 10 == 1:
            words.append("password=e3b3ed3cc8548923d6")
        t = " ".join(words)
        rows.append((k, t, "en", f"src{k % 5}", len(t)))
        labels.append((k, 1, int(toxic)))
    rows += [(9000, None, None, None, None), (9001, "", "en", "src1", 0), (9002, "w " * 9000, "en", "src2", 18000)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, corpus):
    from test_dedup_media import groups_of, near_texts, shingles
    from test_chat_packing_mixing import naive_bfd

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], corpus).cache())
    rows = [{r["doc_id"]: r for r in k.collect()} for k in kept[:-1]]
    assert all(k.columns == docs.columns for k in kept[:-1])

    model = toxicity.train(*toxicity.training_sample(docs, spark.read.parquet(f"{corpus}/labels.parquet"), "doc_id", "text", "toxic", toxicity.TRAIN_TOXIC, toxicity.TRAIN_CLEAN))
    assert set(rows[1]) == {k for k, r in rows[0].items() if toxicity.score_texts(model, [r["text"] or ""])[0][0] < model["threshold"]}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{corpus}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic - set(rows[1])) >= 0.95 * len(toxic) and len(set(rows[0]) - toxic - set(rows[1])) <= 0.03 * len(rows[0])

    sets = {k: shingles(r["text"]) for k, r in rows[1].items()}
    label = groups_of(list(sets), near_texts(sets))
    assert set(rows[2]) == {k for k in label if label[k] == k}

    for k, r in rows[3].items():
        t, at = rows[2][k]["text"], 0
        if t is not None:
            for s, e, _ in reversed(secrets.find_secrets(t, f"{secrets.TOKENIZERS}/{secrets.VOCABULARY}")):
                t = t[:s] + "[SECRET]" + t[e:]
        assert r["text"] == t and r["n_chars"] == (None if t is None else len(t))
    assert set(rows[3]) == set(rows[2]) and not any("password=e3b3" in (r["text"] or "") for r in rows[3].values())

    place = {r["doc_id"]: (r["slot"], r["position"]) for r in mixing.mix(kept[3]).collect()}
    assert [r["doc_id"] for r in kept[4].collect()] == sorted(rows[3], key=place.get)

    lengths = []
    for r in rows[4].values():
        n = len((r["text"] or "").split())
        lengths += [packing.CAPACITY] * (n // packing.CAPACITY) + [n % packing.CAPACITY] * (n % packing.CAPACITY > 0)
    assert sorted(sorted(r["lengths"]) for r in kept[5].collect()) == naive_bfd(lengths, packing.CAPACITY)

    ran = corpus_pipeline.run(spark, corpus)
    key = lambda d: sorted((r["window_id"], r["doc_ids"], r["starts"], r["lengths"]) for r in d.collect())
    assert key(ran) == key(kept[5])


ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, group_id int, _new string, _place int, slot int, key string, keep boolean, _at int, score double, class int"


def test_stages_on_odd_rows(spark, corpus, tmp_path):
    """Nulls everywhere, empty and very long texts, repeated rows, an empty table, and columns named as those the stages use."""
    long = "plain words of a text " * 40_000
    extra = ("x", 1, "new", 7, 2, "k", True, 3, 0.5, 4)
    rows = [(1, "one two three four", "en", "a", 18, *extra), (1, "one two three four", "en", "a", 18, *extra), (2, "One two three four!", "en", None, 19, *extra), (None, None, None, None, None, *(None,) * 10),
            (3, "", "en", "b", 0, *extra), (4, long, "en", "b", len(long), *extra), (5, "password=e3b3ed3cc8548923d6", None, "a", None, *extra), (None, "no id here at all", "en", "a", 17, *extra), (6, " \n ", "", "", 3, *extra)]
    docs = spark.createDataFrame(rows, ODD)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{k}"), corpus)
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in ODD.split(", ")]
        if name == "minhash":
            assert sorted((str(r["doc_id"]), (r["text"] or "")[:8]) for r in docs.collect()) == sorted([("1", "one two ")] * 2 + [("None", ""), ("3", ""), ("4", "plain wo"), ("5", "password"), ("None", "no id he"), ("6", " \n ")])
        if name == "secrets":
            assert {(r["doc_id"], r["text"], r["n_chars"], r["_new"]) for r in docs.where("doc_id in (1, 5)").collect()} == {(1, "one two three four", 18, "new"), (5, "password=[SECRET]", 17, "new")}
    windows = docs.collect()
    assert sum(r["used"] for r in windows) == 2 * 4 + 200_000 + 1 + 5
    assert sorted(str(i) for r in windows for i in r["doc_ids"]) == sorted(["1", "1", "5", "None"] + ["4"] * -(-200_000 // packing.CAPACITY))


def test_run_on_an_empty_table(spark, corpus, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns and out.count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    out = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in out.select(*sorted(out.columns)).collect()]
    assert rows or name == "op10_secrets"  # none of the 200 documents has a secret
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("embeddings", "conversations", "documents"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.sql(ORACLES[name])
        names = sorted(want.columns)
        assert names == sorted(out.columns)
        assert sorted(map(str, rows)) == sorted(map(str, want.select(", ".join(names)).fetchall()))
