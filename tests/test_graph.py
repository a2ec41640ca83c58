"""Graph loops: the distributed ones, the ones in one process and plain versions agree."""

import random

import pytest

from sparkweave.graph import loops
from sparkweave.operators import analyze


def edges_of(seed, n=60, m=70):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def plain_reach(seeds, pairs):
    seen = set(seeds)
    while True:
        new = {v for u, v in pairs if u in seen} - seen
        if not new:
            return seen
        seen |= new


def plain_components(ids, pairs):
    label = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for u, v in pairs:
            low = min(label[u], label[v])
            for x in (u, v):
                if label[x] != low:
                    label[x], moved = low, True
    return label


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("most", [0, 10**6])
def test_loops(spark, seed, most):
    pairs = edges_of(seed)
    df = spark.createDataFrame(pairs, "u long, v long")
    ids = spark.range(60)
    assert {r["id"] for r in loops.reach(spark.createDataFrame([(1,), (5,), (5,), (None,)], "id long"), df, most).collect()} == plain_reach({1, 5}, pairs)
    assert {r["id"]: r["component"] for r in loops.components(ids, df, most).collect()} == plain_components(range(60), pairs)
    reach = {i: plain_reach({i}, pairs) for i in range(60)}
    rings = {i: min(j for j in range(60) if j in reach[i] and i in reach[j]) for i in range(60) if any(j != i and j in reach[i] and i in reach[j] for j in range(60))}
    assert {r["id"]: r["component"] for r in loops.strong_components(df, most).collect()} == rings
    assert loops.reach(ids.limit(0), df, most).count() == 0
    assert loops.strong_components(df.limit(0), most).count() == 0


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """10,000 vertices in a row, and a circle of as many, which edge by edge would take as many rounds."""
    rounds = []
    real = loops.written
    monkeypatch.setattr(loops, "written", lambda df, name: rounds.append(name) or real(df, name))
    n = 10_000
    row = spark.range(n - 1).selectExpr("id as u", "id + 1 as v")
    assert loops.reach(spark.createDataFrame([(3,)], "id long"), row, 0).count() == n - 3
    assert rounds.count("front") <= 30
    rounds.clear()
    tails = spark.range(n).selectExpr(f"id + {n} as u", f"case when id = {n - 1} then {n} else id + {n} + 1 end as v").union(row).union(spark.createDataFrame([(n - 1, n)], "u long, v long")).union(spark.range(500).selectExpr(f"if(id = 0, {n}, id + {2 * n}) as u", f"id + {2 * n} + 1 as v"))
    found = loops.strong_components(tails, 0)
    assert (found.count(), found.select("component").distinct().collect()[0][0]) == (n, n)
    assert len(rounds) <= 200


def graph(spark, nodes, edges, entries):
    """Nodes ``id: (type, file, parent, special, public)``."""
    n = [(i, f"n{i}", f"mod.n{i}", *v) for i, v in nodes.items()]
    return (
        spark.createDataFrame(n, "id long, name string, qualified_name string, node_type string, file_id long, parent long, is_special boolean, is_public boolean"),
        spark.createDataFrame([(u, v, t, 1, line) for u, v, t, line in edges], "source_id long, target_id long, edge_type string, file_id long, line int"),
        spark.createDataFrame(entries, "file_id long, node_id long, no_propagate boolean"),
    )


def fn(file=1, parent=0, kind="function", special=False, public=False):
    return (kind, file, parent, special, public)


def split_of(spark, nodes, edges, entries, includes=None):
    n, e, x = graph(spark, nodes, edges, entries)
    c = analyze.find_components(n, e, x, includes)
    out = {}
    for r in c.members.collect():
        out.setdefault((r["component"], r["is_dead"]), set()).add(r["id"])
    return {(frozenset(v), dead) for (_, dead), v in out.items()}


def test_chain_and_separate_chains(spark):
    nodes = {i: fn() for i in (1, 2, 3, 4)}
    got = split_of(spark, nodes, [(1, 2, "call", 1), (3, 4, "call", 1)], [(1, 1, False)])
    assert got == {(frozenset({1, 2}), False), (frozenset({3, 4}), True)}


def test_calls_go_both_ways_inside_a_component_and_reads_do_not(spark):
    nodes = {1: fn(), 2: fn(), 3: fn(), 4: fn()}
    got = split_of(spark, nodes, [(1, 2, "call", 1), (3, 2, "call", 2), (4, 2, "read", 3)], [(1, 1, False)])
    assert got == {(frozenset({1, 2, 3}), False), (frozenset({4}), True)}


def test_special_members_variables_and_owners(spark):
    nodes = {1: fn(), 2: fn(kind="class"), 3: fn(kind="method", parent=2, special=True), 4: fn(kind="method", parent=2), 5: fn(kind="field", parent=2), 6: fn(kind="field", parent=4)}
    got = split_of(spark, nodes, [(1, 2, "call", 1), (3, 5, "write", 1), (4, 6, "write", 1)], [(9, 1, False)])
    assert got == {(frozenset({1, 2, 3, 5}), False), (frozenset({4, 6}), True)}


def test_files_of_tests_are_alive_and_keep_nothing_alive(spark):
    nodes = {1: fn(file=1), 2: fn(file=2), 3: fn(file=3)}
    got = split_of(spark, nodes, [(1, 2, "call", 1), (3, 2, "read", 0)], [(1, 0, True)])
    assert got == {(frozenset({1}), False), (frozenset({2}), True), (frozenset({3}), True)} or (frozenset({2, 3}), True) in got


def test_a_file_entry_makes_the_whole_file_live(spark):
    nodes = {1: fn(), 2: fn(), 3: fn(file=2)}
    got = split_of(spark, nodes, [(1, 3, "call", 1)], [(1, 0, False)])
    assert got == {(frozenset({1, 3}), False), (frozenset({2}), False)}


def test_inheritance_draws_dead_parts_to_the_largest_live_one(spark):
    nodes = {i: fn(kind="class") for i in range(1, 7)}
    edges = [(1, 2, "call", 1), (4, 3, "inherit", 1), (3, 2, "inherit", 1), (5, 6, "write", 1)]
    got = split_of(spark, nodes, edges, [(1, 1, False)])
    assert got == {(frozenset({1, 2, 3, 4}), False), (frozenset({5, 6}), True)}


def test_module_level_uses(spark):
    includes = spark.createDataFrame([(1, 2)], "file_id long, included long")
    nodes = {1: fn(file=1), 2: fn(file=1, kind="variable"), 3: fn(file=2, kind="macro"), 4: fn(file=2, kind="macro"), 5: fn(file=3, kind="macro"), 6: fn(file=3, kind="variable")}
    edges = [(0, 2, "read", 0), (0, 3, "read", 7), (0, 4, "read", 0), (0, 5, "read", 7), (0, 6, "read", 9)]
    got = split_of(spark, nodes, edges, [(1, 1, False)], includes)
    live = {next(iter(c)) for c, dead in got if not dead}
    assert live == {1, 2, 3}


def test_public_names_live_with_their_file(spark):
    nodes = {1: fn(), 2: fn(kind="variable", public=True)}
    assert split_of(spark, nodes, [], [(1, 1, False)]) == {(frozenset({1, 2}), False)}
    nodes[3] = fn(file=2, kind="variable", public=True)
    assert (frozenset({3}), True) in split_of(spark, nodes, [], [(1, 1, False)])


def test_partial_types_share_life(spark):
    nodes = {1: fn(), 2: fn(kind="class"), 3: fn(kind="class"), 4: fn(kind="class")}
    got = split_of(spark, nodes, [(1, 2, "call", 1), (2, 4, "part_of", 1), (3, 4, "part_of", 1)], [(1, 1, False)])
    assert got == {(frozenset({1, 2, 3, 4}), False)}


def test_large_components_are_hashed_in_ranges(spark, monkeypatch):
    import hashlib

    from sparkweave.operators import stats

    nodes = spark.range(1, 200).selectExpr("id", "if(id % 3 = 0, 'variable', 'function') as node_type")
    members = spark.range(1, 200).selectExpr("id", "if(id % 10 = 0, 10L, 1L) as component", "false as is_dead")
    monkeypatch.setattr(stats, "LISTED", 50)
    monkeypatch.setattr(stats, "RANGE", 32)
    rows = {r["component"]: r for r in stats.component_stats(nodes, members).collect()}
    tens, others = [k for k in range(1, 200) if k % 10 == 0], [k for k in range(1, 200) if k % 10]
    assert rows[10]["root_node_ids"] == tens and rows[10]["component_hash"] == hashlib.sha256(str(tens).encode()).hexdigest()
    digests = "".join(hashlib.sha256(str([k for k in others if k // 32 == r]).encode()).hexdigest() for r in range(7))
    assert rows[1]["component_hash"] == hashlib.sha256(digests.encode()).hexdigest() and rows[1]["root_node_ids"] == [k for k in others if k < 32]
    assert rows[1]["node_count"] + rows[1]["variable_count"] == len(others)
