"""Prefix nodes of conversations against plain Python, and the double arrays alone."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from odd_rows import shared  # noqa: F401

from growthgrain.llm import tries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, block int, path string, shard int, n int"


def rebuilt(rows):
    """The turns (role, text) of every conversation, spliced; order of equal turns is free."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(turns, key=lambda t: t[0])] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    return made


def brute(rows):
    members = defaultdict(list)
    paths = rebuilt(rows)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    found = []
    for node, own in members.items():
        under = [m for m in members if m[: len(node)] == node]
        children = [m for m in under if len(m) == len(node) + 1]
        leaves = [m for m in under if not any(len(o) == len(m) + 1 and o[: len(m)] == m for o in under)]
        ends = sorted(c for c in own if len(paths[c]) == len(node))
        found.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children), len(leaves),
            sum((len(members[m]) - 1) * len(m[-1][1]) for m in under if m),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(found, key=str)


def result(spark, rows, **options):
    turns = spark.createDataFrame([(*r, 1, "p", 2, 3) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, tries.prefix_nodes(turns, **options).collect()), key=str)


def random_rows(seed, n, words, longest):
    chance = random.Random(seed)
    rows = []
    for c in chance.sample(range(450), n):
        base = chance.choice([None, 7, 9])
        for t in range(chance.randint(1, longest)):
            text = f"same {t}" if base and t < base else chance.choice(words)
            rows.append((c, t, chance.choice(["user", None]) if not base else "user", text))
    chance.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [1 << 18, 6])
@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_are_those_of_plain_python(spark, seed, shard_turns):
    rows = random_rows(seed, 60, ["yes", "no", "", None, "größer 梦"], 5 + 6 * seed)
    assert result(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_a_hot_beginning_is_cut_where_it_branches(spark):
    rows = [(c, t, "user", "hello" if t < 30 else f"{c} {t}") for c in range(1, 50) for t in range(32)]
    turns = spark.createDataFrame([(*r, 1, "p", 2, 3) for r in rows], SCHEMA)
    cuts = tries.sharded(tries.sequences(tries.rebuilt(turns)), 20).select("cut", "shard").collect()
    assert {r.cut for r in cuts} <= set(range(26, 32))  # they lose 0 to 5 turns
    assert len({r.shard for r in cuts}) > 5
    assert result(spark, rows, shard_turns=20) == brute(rows)


def test_snapshots_that_begin_each_other(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 25) for t in range(c)]
    assert result(spark, rows, shard_turns=40, least_turns=40) == brute(rows)


def test_copies_are_one_sequence_and_their_digest_goes_in_blocks(spark, monkeypatch):
    rows = [(c, 0, "user", "the same") for c in range(5000) if zlib.crc32(str(c).encode()) % 6 == 0]
    turns = spark.createDataFrame([(*r, 1, "p", 2, 3) for r in rows], SCHEMA).repartition(4)
    found = tries.sequences(tries.rebuilt(turns)).collect()
    ids = ",".join(str(r[0]) for r in rows)
    assert [(r.n, r.ends_sha256) for r in found] == [(len(rows), hashlib.sha256(ids.encode()).hexdigest())]


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "in no conversation"),
        (1, None, None, None),
        (1, 0, "user", "x" * 300_000),
        (2, 0, "", ""),
        (250, 5, "user", "after the turns it takes from 200, which is not there"),
    ]
    assert result(spark, rows) == brute(rows)
    long = [(100, t, "user", str(t)) for t in range(400)] + [(101, t, "user", str(t)) for t in range(400)]
    assert result(spark, long) == brute(long)
    twice = [(300, 0, "user", "hi")] * 3 + [(300, 1, "user", "ho")] * 2
    assert result(spark, twice) == brute(twice)


def test_no_conversations_give_no_nodes(spark):
    assert result(spark, []) == []
    assert result(spark, [(None, 1, "user", "hi")]) == []


def test_double_array_holds_every_node_once():
    chance = np.random.default_rng(5)
    sizes = -np.sort(-chance.integers(0, 9, 3000))
    code = np.minimum(chance.zipf(1.3, sizes.sum()), 4000).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    shape = tries.Shape(code, starts, sizes)
    trie = tries.DoubleArray(shape)
    assert len(np.unique(trie.slot)) == len(shape)
    at = np.zeros(1, np.int64)
    wanted = {tuple(code[s : s + d]) for s, n in zip(starts, sizes) for d in range(n + 1)}
    assert len(shape) == len(wanted)
    for path in list(wanted)[:500]:
        at = np.zeros(1, np.int64)
        for c in path:
            at = trie.step(at, shape.number[[c]])
        assert at[0] >= 0
        for c in range(1, 50):
            assert (trie.step(at, shape.number[[c]])[0] >= 0) == ((*path, c) in wanted)
