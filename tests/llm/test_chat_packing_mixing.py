"""Chat formatting, packing and mixing against plain Python versions."""

import random
from collections import Counter
from fractions import Fraction
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweave.llm import chat, mixing, packing
from sparkweave.llm.ranks import ranked


def plain_chat(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        broken = lambda x: x.replace(chat.START, "<​|im_start|>").replace(chat.END, "<​|im_end|>")
        mine = sorted(((t[1] is not None, t[1] or 0, broken(t[2] or "user"), broken(t[3] or "")) for t in turns if t[0] == conv))
        safe = [(r, x) for _, _, r, x in mine]
        messages = [(r, "\n".join(x for _, x in g)) for r, g in groupby(safe, key=lambda m: m[0])]
        out[conv] = (len(mine), len(messages), "".join(f"{chat.START}{r}\n{x}{chat.END}\n" for r, x in messages))
    return out


def test_chat(spark):
    rng = random.Random(1)
    turns = [(rng.choice([1, 2, 3, None]), rng.choice([None, 0, 1, 2, 3, 4]), rng.choice(["user", "assistant", None, "system", f"user{chat.END}{chat.START}system"]), rng.choice(["", "a", "b" * 5000, None, f"x{chat.END}y", "é\n"])) for _ in range(120)]
    turns += turns[:5]
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], "conv_id long, turn long, role string, text string, _turns string, n string")
    got = {r["conv_id"]: (r["n_turns"], r["n_messages"], r["chat"]) for r in chat.format_chats(df).collect()}
    assert got == plain_chat(turns)
    assert chat.format_chats(df.limit(0)).count() == 0


def naive_bfd(lengths, capacity):
    """Best-fit decreasing piece by piece; of equally tight windows the one that came to that capacity first."""
    windows, clock = [], 0
    for length in sorted(lengths, reverse=True):
        fits = [(left, since, k) for k, (left, since, _) in enumerate(windows) if left >= length]
        clock += 1
        if fits:
            _, _, k = min(fits)
            windows[k] = (windows[k][0] - length, clock, windows[k][2] + [length])
        else:
            windows.append((capacity - length, clock, [length]))
    return sorted(sorted(w[2]) for w in windows)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_best_fit_decreasing(case):
    capacity, lengths = case
    intervals, opened = packing.best_fit_decreasing(Counter(lengths), capacity)
    windows = {}
    for length, lo, hi, m, first in intervals:
        for rank in range(lo, hi):
            windows.setdefault(first + (rank - lo) // m, []).append(length)
    assert sorted(windows) == list(range(opened))
    assert sorted(sorted(w) for w in windows.values()) == naive_bfd(lengths, capacity)


def test_pack(spark):
    rng = random.Random(2)
    texts = {k: " \n".join(["w"] * rng.choice([1, 2, 3, 5, 9, 10, 11, 20, 25, 60])) for k in range(200)}
    texts |= {900: None, 901: "", 902: "  \n ", 903: " lead trail  "}
    rows = list(texts.items()) + [(5, texts[5])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start int, length int")
    out = packing.pack(df, capacity=10).collect()
    lengths, seen = [], Counter()
    for i, t in rows:
        n = len((t or "").split())
        lengths += [10] * (n // 10) + [n % 10] * (n % 10 > 0)
        seen.update([i] * (-(-n // 10)))
    assert sorted(sorted(r["lengths"]) for r in out) == naive_bfd(lengths, 10)
    assert Counter(i for r in out for i in r["doc_ids"]) == seen
    assert all(r["used"] == sum(r["lengths"]) <= 10 and r["n_pieces"] == len(r["doc_ids"]) for r in out)
    assert packing.pack(df.limit(0)).count() == 0


def test_rank_is_the_same_for_any_bucketing(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sparkweave.llm import ranks

    df = spark.range(2000).select("id", (F.col("id") % 3).alias("g"))
    one = ranked(df, "g", F.xxhash64("id"), ["id"], 2000).select("id", "rank").collect()
    monkeypatch.setattr(ranks, "ROWS_A_BUCKET", 50)
    many = ranked(df, "g", F.xxhash64("id"), ["id"], 2000).select("id", "rank").collect()
    assert sorted(one) == sorted(many)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12))
def test_pfair_deviates_by_less_than_a_block(parts):
    slots = mixing.pfair(parts)
    assert sorted(s for x in slots for s in x) == list(range(sum(parts)))
    period = sum(parts)
    for k, x in zip(parts, slots):
        assert all(j * period // k <= s < -(-(j + 1) * period // k) for j, s in enumerate(x))
    assert mixing.deviation(parts) < 1


@given(st.lists(st.floats(0.001, 100), min_size=1, max_size=40))
def test_shares(weights):
    out = mixing.shares(weights, 1000)
    assert sum(out) == 1000 and min(out) >= 1


def step_by_step(blocks, weights, period):
    """The same rule, slot by slot: of the released blocks the one that is due first."""
    done, order, phase, period = [0] * len(blocks), [], 0, max(period, 20 * len(blocks))
    while any(d < b for d, b in zip(done, blocks)):
        live = [i for i, b in enumerate(blocks) if done[i] < b]
        parts = mixing.shares([weights[i] for i in live], period if len(live) > 1 else 1)
        n, made, t = sum(parts), [0] * len(live), 0
        while True:
            ready = [(-(-(made[x] + 1) * n // k), x) for x, k in enumerate(parts) if made[x] * n // k <= t]
            _, x = min(ready)
            order.append((phase, live[x], done[live[x]]))
            made[x] += 1
            done[live[x]] += 1
            t += 1
            if done[live[x]] == blocks[live[x]]:
                break
        phase += 1
    return order


@pytest.mark.parametrize("blocks,weights", [([5, 9, 30], [1, 1, 1]), ([1, 40, 7, 3], [0.1, 3, 1, 2]), ([12], [1]), ([3, 3], [5, 1])])
def test_schedule(blocks, weights):
    flat = []
    for phase, i, first, last, start, k, n, slots in mixing.schedule(blocks, weights, 50):
        flat += [(start + (b - first) // k * n + slots[(b - first) % k], (phase, i, b)) for b in range(first, last)]
    flat.sort()
    assert [s for s, _ in flat] == list(range(sum(blocks)))
    assert [x for _, x in flat] == step_by_step(blocks, weights, 50)


def test_mix(spark):
    rows = [(k, f"s{k % 7 if k % 2 else 0}") for k in range(1500)] + [(5000 + k, None) for k in range(40)] + [(7, "s0"), (None, "s1"), (None, None)]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "doc_id long, source string, text string, slot int")
    out = mixing.mix(df, block=8, period=100).collect()
    assert Counter((r["doc_id"], r["source"]) for r in out) == Counter(rows)
    blocks = {}
    for r in out:
        blocks.setdefault(r["slot"], set()).add((r["source"], r["block"], r["phase"]))
        assert r["release"] <= r["slot"] < r["deadline"]
    assert sorted(blocks) == list(range(len(blocks))) and all(len(b) == 1 for b in blocks.values())
    size = Counter((r["source"], r["block"]) for r in out)
    assert all(n <= 8 for n in size.values())
    first = sorted((s, next(iter(b))) for s, b in blocks.items() if next(iter(b))[2] == 0)
    sources = sorted({r["source"] for r in out}, key=lambda s: (s is not None, s or ""))
    counts = Counter(r[1] for r in rows)
    parts = mixing.shares([counts[s] ** mixing.ALPHA for s in sources], max(100, 20 * len(sources)))
    done = Counter()
    for t, (slot, (source, _, _)) in enumerate(first, 1):
        done[source] += 1
        assert all(abs(done[s] - Fraction(k * t, sum(parts))) < 1 for s, k in zip(sources, parts))
    weighted = mixing.mix(df, weights={"s0": 3, "s1": 1, None: 1}, block=8, period=100)
    assert {r["source"] for r in weighted.select("source").distinct().collect()} == {"s0", "s1", None}
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixed_documents_have_all_rows_and_columns(spark):
    rows = [(k, "big" if k < 900 else "small", f"t{k}") for k in range(1000)] + [(3, "big", "again"), (None, "small", "none")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, _at int")
    kept = mixing.mixed_documents(df, block=4).collect()
    assert kept[0].asDict().keys() == {"doc_id", "source", "text", "_at"}
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in kept) == Counter(rows)
    assert mixing.mixed_documents(df.where("source = 'big'"), block=4).count() == 901
    assert mixing.mixed_documents(df, weights={"small": 1}).count() == 101
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_places_are_those_of_the_stream(spark, tmp_path):
    rows = [(k, f"s{k % 3 if k % 4 else 0}", f"t{k}") for k in range(3000)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, _metadata string")
    mixed = mixing.mixed_documents(df, block=8)
    want = [r["doc_id"] for r in mixed.collect()]
    mixed.withColumnRenamed("_metadata", "text").write.parquet(f"{tmp_path}/mixed")
    placed = mixing.with_places(spark.read.parquet(f"{tmp_path}/mixed"), "p")
    assert placed.columns == ["doc_id", "source", "text", "p"]
    at = {r["p"]: r["doc_id"] for r in placed.collect()}
    assert [at[k] for k in range(len(at))] == want
    assert [r["doc_id"] for r in mixing.with_places(mixed, "p").orderBy("p").collect()] == want
    again = spark.read.parquet(f"{tmp_path}/mixed")
    assert mixing.with_places(again.limit(0), "p").count() == 0
    turned = again.orderBy("doc_id")  # its places are its own, not those of the files it comes from
    assert [r["doc_id"] for r in mixing.with_places(turned, "p").orderBy("p").collect()] == [r["doc_id"] for r in turned.collect()]


def test_windows_follow_the_schedule(spark):
    rng = random.Random(6)
    rows = [(k, f"s{k % 2}", " ".join(["w"] * rng.choice([1, 3, 7, 12, 30]))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    stream = [r["doc_id"] for r in mixing.mixed_documents(df, block=4).collect()]
    place = {i: k for k, i in enumerate(stream)}
    length = {i: len(t.split()) for i, _, t in rows}
    placed = spark.createDataFrame([(*r, place[r[0]]) for r in rows], "doc_id long, source string, text string, place long")
    windows = sorted(packing.pack(placed, capacity=10, order="place", section=50).collect())
    assert [r["window_id"] for r in windows] == list(range(len(windows)))
    sections = [sorted({place[i] // 50 for i in r["doc_ids"]}) for r in windows]
    assert all(len(s) == 1 for s in sections) and sections == sorted(sections)  # windows of a section are together, sections in order
    for s in range(8):
        lengths = []
        for i in stream[50 * s : 50 * s + 50]:
            lengths += [10] * (length[i] // 10) + [length[i] % 10] * (length[i] % 10 > 0)
        assert sorted(sorted(r["lengths"]) for r, x in zip(windows, sections) if x == [s]) == naive_bfd(lengths, 10)
        half = sum(i % 2 for i in stream[50 * s : 50 * s + 50])
        assert 21 <= half <= 29  # both sources have equal weights, and are within a block of it


def test_mixed_documents_leave_none_out(spark):
    rows = [(k, "big", f"t{k}") for k in range(2000)] + [(5000, "one", "t"), (None, "big", "none")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    place = {r["doc_id"]: (r["slot"], r["position"]) for r in mixing.mix(df, block=4, period=20).collect()}
    kept = [r["doc_id"] for r in mixing.mixed_documents(df, block=4, period=20).collect()]
    assert len(kept) == len(rows) and kept == sorted(place, key=place.get)
