"""Near duplicates against all pairs, FLAC against its own samples."""

import random
import re

import numpy as np
import plain_flac
import pytest

from sparkweave.llm import flac, minhash, spherical


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def groups_of(ids, near):
    label = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in near:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x], moved = low, True
    return label


def near_texts(sets, least=minhash.LEAST):
    ids = sorted(sets)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least]


def copies(seed=1):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(400)]
    texts, k = {}, 0
    passage = " ".join(rng.choice(words) for _ in range(40))
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 20, 60, 400]))]
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            copy = [rng.choice(words) if rng.random() < 0.03 else w for w in base]
            texts[k] = " ".join(copy)
            k += 1
        for _ in range(2):
            texts[k] = " ".join(base).upper() + "!"
            k += 1
    for _ in range(40):  # a shared passage makes no near duplicates
        texts[k] = " ".join(rng.choice(words) for _ in range(100)) + " " + passage
        k += 1
    return texts


def test_near_duplicates_equal_all_pairs(spark):
    texts = copies() | {9000: "", 9001: None, 9002: "...", 9003: "", 9004: "one", 9005: "One!", 9006: "x" * 100_000, 9007: "long text " * 20_000, 9008: "long text " * 20_000}
    df = spark.createDataFrame([(k, t, "a", 1) for k, t in texts.items()] + [(5, texts[5], "b", 2), (None, "null id", "c", 3)], "doc_id long, text string, id string, group int")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    sets = {k: shingles(t) for k, t in texts.items()}
    near = near_texts(sets)
    want = groups_of(list(texts), near)
    assert set(got) == set(texts)
    together = sum(got[a]["group_id"] == got[b]["group_id"] for a, b in near)
    assert together >= 0.98 * len(near)
    assert all(want[k] == want[r["group_id"]] for k, r in got.items())  # nothing that all pairs keep apart is joined
    assert all(r["keep"] == (r["group_id"] == k) for k, r in got.items())
    for r in got.values():
        assert r["group_size"] == sum(x["group_id"] == r["group_id"] for x in got.values())
    assert got[9000]["keep"] and got[9003]["keep"] and got[9001]["keep"] and got[9005]["group_id"] == 9004 and got[9008]["group_id"] == 9007
    kept = minhash.without_duplicates(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["keep"]} | {None}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_half_the_shingles_make_a_near_duplicate(spark):
    """The numbers are written out, so that the module's can't move along."""
    assert minhash.LEAST == 0.5 and 1 - (1 - 0.5**minhash.BAND) ** (minhash.REGISTERS // minhash.BAND) >= 0.95
    texts = {}
    for k in range(200):  # 100 words, the last 32 replaced: 66 shingles of 130 in common
        base = [f"p{k}w{i}" for i in range(100)]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(base[:68] + [f"q{k}w{i}" for i in range(32)])
    a, b = shingles(texts[0]), shingles(texts[1])
    assert 0.5 <= len(a & b) / len(a | b) < 0.55
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(200)) >= 180


def test_rows_that_repeat_an_id_are_one_document(spark):
    df = spark.createDataFrame([(3, "a b c"), (5, "a b c"), (5, "z unique text"), (7, "Z unique text!")], "doc_id long, text string")
    assert {r["doc_id"]: r["group_id"] for r in minhash.near_duplicates(df).collect()} == {3: 3, 5: 5, 7: 5}
    assert sorted(r["doc_id"] for r in minhash.without_duplicates(df).collect()) == [3, 5, 5]


def test_shingles_are_those_of_the_words():
    texts = list(copies(2).values())[:60] + ["", "a", "a b", "a b c", "a b a b a b"]
    doc, h = minhash.shingles(texts)
    assert [len(shingles(t)) for t in texts] == np.bincount(doc, minlength=len(texts)).tolist()


@pytest.mark.parametrize("size,share", [(5, 0.6), (40, 0.3), (300, 0.6), (3000, 0.8)])
def test_estimate(size, share):
    rng = np.random.default_rng(size)
    errors = []
    for _ in range(30):
        both = int(size * share)
        pool = rng.integers(0, 2**63, 2 * size - both, dtype=np.int64).view(np.uint64)
        a, b = np.sort(pool[:size]), np.sort(pool[size - both :])
        ra, rb = minhash.sketch(np.zeros(size, int), a, 1), minhash.sketch(np.zeros(size, int), b, 1)
        assert (ra > 0).all()
        errors.append(minhash.estimate(ra, rb)[0][0] - both / (2 * size - both))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def unit(rng, n, d):
    x = rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_list_decoding_equals_all_filters():
    rng = np.random.default_rng(1)
    rotation, words = spherical.code(12, 5, 4)
    x = unit(rng, 40, 12) @ rotation
    alpha = 0.5
    vec, name = spherical.list_decode(x, words, alpha)
    every = np.zeros((5**4, 12))
    for k in range(5**4):
        digits = [k // 5**3, k // 25 % 5, k // 5 % 5, k % 5]
        every[k] = np.concatenate([c[d] for c, d in zip(words, digits)]) / 2
    score = x @ every.T
    for i in range(40):
        want = set(np.flatnonzero(score[i] >= alpha)) or {int(score[i].argmax())}
        assert set(name[vec == i]) == want


@pytest.mark.parametrize("vectors,dim", [(100, 16), (4000, 64), (60_000, 64)])
def test_recall_of_pairs_at_the_threshold(vectors, dim):
    rng = np.random.default_rng(2)
    n = 1000
    words, alpha, codes = spherical.plan(vectors, dim)
    a = unit(rng, n, dim)
    side = rng.standard_normal((n, dim))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = spherical.LEAST * a + np.sqrt(1 - spherical.LEAST**2) * side
    met = set()
    for k in range(1, codes + 1):
        rotation, code = spherical.code(dim, words, seed=k)
        fa, fb = (spherical.list_decode(x @ rotation, code, alpha) for x in (a, b))
        one = set(zip(*map(np.ndarray.tolist, fa)))
        met |= {v for v, f in zip(*map(np.ndarray.tolist, fb)) if (v, f) in one}
    assert len(met) / n > 0.94


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(3)
    base = unit(rng, 150, 32)
    rows = [(k, base[k].tolist()) for k in range(150)]
    for k in range(150, 400):
        v = base[k % 20] + 0.03 * rng.standard_normal(32)
        rows.append((k, (v * rng.uniform(0.5, 3)).tolist()))
    rows += [(500, base[0].tolist()), (501, None), (502, [0.0] * 32), (503, [float("nan")] * 32), (504, []), (505, [1.0, 0.0]), (506, [2.0, 0.01]), (507, [1.0, None]), (508, [float("inf"), 1.0]), (None, base[0].tolist()), (3, base[3].tolist())]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, embedding array<double>, group int, v string")
    got = {r["vec_id"]: r for r in spherical.near_duplicate_vectors(df).collect()}
    x = {k: np.array(v, float) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    x = {k: v / np.linalg.norm(v) for k, v in x.items()}
    ids = sorted(x)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(x[a]) == len(x[b]) and x[a] @ x[b] >= spherical.LEAST]
    want = groups_of([k for k, _ in rows if k is not None], near)
    assert set(got) == set(want) and all(want[k] == want[r["group_id"]] for k, r in got.items())
    assert sum(got[a]["group_id"] == got[b]["group_id"] for a, b in near) >= 0.97 * len(near)
    assert all(r["group_size"] == sum(x["group_id"] == r["group_id"] for x in got.values()) for r in got.values())
    assert spherical.near_duplicate_vectors(df.limit(0)).count() == 0


def wave(n, channels, bits, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)[:, None] + np.arange(channels) * 7
    x = (np.sin(t / 19) * 2 ** (bits - 2)).astype(np.int64) + rng.integers(-4, 5, (n, channels))
    x[n // 3 : n // 3 + 3] = rng.integers(-(2 ** (bits - 2)), 2 ** (bits - 2), (min(3, max(0, n - n // 3)), channels))
    return x


def decoded(stream):
    return next(flac.decode_many([stream]))


def plainly(stream):
    """What the plain decoder says, in the form of the batch decoder."""
    try:
        _, blocks, wrong = plain_flac.decode(stream)
    except plain_flac.FlacError as e:
        return [], str(e)
    return [tuple(b[c] for c in ("first_sample", "n_samples", "channels", "bits", "rate", "byte_offset", "crc_ok", "pcm")) for b in blocks], wrong


@pytest.mark.parametrize("bits", [8, 12, 16, 24])
@pytest.mark.parametrize("kind,order", [("fixed", 0), ("fixed", 1), ("fixed", 3), ("fixed", 4), ("lpc", 1), ("lpc", 8), ("lpc", 20), ("verbatim", 0)])
def test_round_trip(bits, kind, order):
    for stereo in (0, 8, 9, 10):
        x = wave(700, 2, bits)
        info, blocks, wrong = decoded(plain_flac.encode(x, bits=bits, kind=kind, order=order, stereo=stereo, parts=3, block=160))
        assert wrong is None and (info.bits, info.channels, info.samples) == (bits, 2, 700)
        assert [b[0] for b in blocks] == [0, 160, 320, 480, 640]
        assert b"".join(b[7] for b in blocks) == plain_flac.pcm(x, bits)


def test_whole_and_damaged_streams_side_by_side_equal_the_plain_decoder(monkeypatch):
    rng = np.random.default_rng(4)
    streams = [plain_flac.encode(np.full((6400, 1), -5), kind="constant", block=16), plain_flac.encode(wave(100, 5, 16), block=40), plain_flac.encode(wave(9000, 1, 16), block=4096, parts=4)]
    for k in range(30):
        kind, order = (("fixed", k % 5), ("lpc", 1 + k), ("verbatim", 0))[k % 3]
        streams.append(plain_flac.encode(wave(500 + k, 2, (8, 16, 24)[k % 3], k), bits=(8, 16, 24)[k % 3], kind=kind, order=order, stereo=(0, 8, 9, 10)[k % 4], block=128, parts=k % 4))
    loud = np.zeros((256, 1), np.int64)
    loud[100] = 30000  # a Rice code of hundreds of bits
    streams.append(plain_flac.encode(loud, block=128, order=1, parts=0))
    for s in list(streams):
        hurt = bytearray(s)
        for _ in range(3):
            hurt[rng.integers(0, len(hurt))] ^= 1 << int(rng.integers(0, 8))
        streams += [bytes(hurt), s[: rng.integers(0, len(s))], s + b"junk", s[:60] + bytes(40) + s[60:]]
    want = [plainly(s) for s in streams]
    assert [x[1:] for x in flac.decode_many(streams)] == want
    monkeypatch.setattr(flac, "GROUP_BYTES", 3000)
    monkeypatch.setattr(flac, "CELLS", 500)
    assert [x[1:] for x in flac.decode_many(streams)] == want


def test_clips_of_the_query():
    x = (np.random.default_rng(2).standard_normal((6, 150, 2)) * 3000).astype(np.int64)
    x[0] = 7
    x[1, 20] = 32767
    for kind, order in (("fixed", 1), ("fixed", 2), ("lpc", 4), ("verbatim", 0)):
        for stereo in (0, 8, 9, 10):
            for k, s in enumerate(flac.encode_clips(x, block=64, kind=kind, order=order, stereo=stereo)):
                blocks, wrong = plainly(s)
                assert wrong is None and len(blocks) == 3 and b"".join(b[7] for b in blocks) == x[k].astype("<i2").tobytes()


def test_constant_one_channel_and_many_frames():
    x = np.full((400 * 16, 1), -5)
    _, blocks, wrong = decoded(plain_flac.encode(x, kind="constant", block=16))
    assert wrong is None and len(blocks) == 400 and blocks[399][0] == 399 * 16


def test_crcs():
    one = np.frombuffer(b"..123456789", np.uint8)
    assert flac.crc8s(one, np.array([2]), np.array([11])) == [0xF4] and flac.crc16s(one, np.array([2]), np.array([11])) == [0xFEE8]
    buf = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    start, end = np.array([0, 5, 100, 7, 900]), np.array([3000, 69, 100, 1000, 2500])
    assert flac.crc16s(buf, start, end).tolist() == [plain_flac.crc16(buf[a:b].tobytes()) for a, b in zip(start, end)]
    assert flac.crc8s(buf, start, end).tolist() == [plain_flac.crc8(buf[a:b].tobytes()) for a, b in zip(start, end)]


def test_damage_and_odd_rows(spark):
    x = wave(600, 2, 16)
    good = plain_flac.encode(x, block=200)
    _, blocks, _ = plain_flac.decode(good)
    hurt = bytearray(good)
    hurt[blocks[1]["byte_offset"] + 40] ^= 8
    cut = good[: blocks[2]["byte_offset"] + 20]
    rows = [(1, good), (1, good), (2, bytes(hurt)), (3, cut), (4, None), (5, b""), (6, b"RIFF1234"), (7, good[:42]), (8, good + b"junk"), (None, good), (9, b"ID3\x04\x00\x00\x00\x00\x00\x05abcde" + good)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "media_id long, flac binary, block int")
    out = {}
    for r in flac.decode_media(df).collect():
        out.setdefault(r["media_id"], []).append(r)
    whole = plain_flac.pcm(x, 16)
    for k in (None, 9):
        assert b"".join(bytes(r["pcm"]) for r in sorted(out[k], key=lambda r: r["first_sample"])) == whole and out[k][0]["error"] is None
    assert len(out[1]) == 6
    bad = {r["first_sample"]: r for r in out[2]}
    assert bytes(bad[0]["pcm"]) == whole[:800] and bytes(bad[400]["pcm"]) == whole[1600:] and out[2][0]["error"]
    assert 200 not in bad or (not bad[200]["crc_ok"] and bad[200]["pcm"] is None)
    assert [r["first_sample"] for r in out[3]] == [0, 200] and out[3][0]["error"]
    for k in (4, 5, 6, 7):
        assert len(out[k]) == 1 and out[k][0]["pcm"] is None and out[k][0]["error"]
    assert len(out[8]) == 3 and out[8][0]["error"] == "bytes that are no frame"
    seek = [r for r in out[9] if r["first_sample"] <= 250 < r["first_sample"] + r["n_samples"]]
    assert len(seek) == 1 and bytes(seek[0]["pcm"])[200:204] == whole[1000:1004]
    assert flac.decode_media(df.limit(0)).count() == 0
