"""Aliases and roles followed to their end, against plain walks."""

import random

import pytest

from redactory.operators.chains import reachable, resolve_aliases


def walked(links):
    """(scope, alias) -> canonical, hops, looped."""
    out = {}
    for scope, alias in links:
        at, seen = alias, []
        while (scope, at) in links and at not in seen:
            seen.append(at)
            at = links[scope, at]
        looped = at in seen
        out[scope, alias] = (at, seen.index(at) if looped else len(seen), looped)
    return out


def test_long_chains_and_loops(spark):
    links = {("chain", f"n{i}"): f"n{i + 1}" for i in range(1000)}
    links |= {("loop", f"n{i}"): f"n{(i + 1) % 1000}" for i in range(1000)}
    links |= {("way in", f"n{i}"): f"n{i + 1}" for i in range(600)} | {("way in", "n600"): "n300"}
    links |= {("self", "a"): "a", ("self", "b"): "a", ("one", "x"): "y"}
    rng = random.Random(2)
    links |= {("mixed", f"m{i}"): f"m{rng.randrange(260)}" for i in range(200)}
    rows = [(s, a, c) for (s, a), c in links.items()] + [("one", None, "z"), ("one", "q", None)]
    got = resolve_aliases(spark.createDataFrame(rows, "scope string, alias string, canonical string"), ("scope",)).collect()
    assert {(r.scope, r.alias): (r.canonical, r.hops, r.looped) for r in got} == walked(links)
    assert len(got) == len(links)


def test_without_scope_and_empty(spark):
    none = spark.createDataFrame([], "alias string, canonical string")
    assert resolve_aliases(none).collect() == []
    got = resolve_aliases(spark.createDataFrame([("a", "b"), ("b", "c")], none.schema)).collect()
    assert sorted((r.alias, r.canonical, r.hops) for r in got) == [("a", "c", 2), ("b", "c", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_roles(spark, seed):
    rng = random.Random(seed)
    links = [(rng.choice("ab"), f"m{rng.randrange(30)}", f"m{rng.randrange(30)}") for _ in range(45)] + [("a", "m0", "m1"), ("a", "m1", "m0"), ("a", None, "x")]
    want = {}
    for scope in "ab":
        to = {}
        for s, m, r in links:
            if s == scope and m is not None:
                to.setdefault(m, set()).add(r)
        for m in to:
            seen, front, hops = {}, {m}, 0
            while front:
                hops += 1
                front = {r for x in front for r in to.get(x, ())} - seen.keys()
                seen |= dict.fromkeys(front, hops)
            want |= {(scope, m, r): h for r, h in seen.items()}
    got = reachable(spark.createDataFrame(links, "scope string, member string, role string"), ("scope",)).collect()
    assert {(r.scope, r.member, r.role): r.hops for r in got} == want
    assert len(got) == len(want)
