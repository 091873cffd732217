"""The trie against a plain one made of dicts."""

import hashlib
import math
import random
import zlib

import pytest

from flowlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, owner string, x int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talks(rows):
    out = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def rebuilt(own):
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        out[conv] = own.get(conv - int(math.fmod(conv, 100)), [])[:h] + turns[h:]
    return out


def plain(paths):
    nodes = {}
    for conv in sorted(paths):
        for depth in range(len(paths[conv]) + 1):
            nodes.setdefault(tuple(paths[conv][:depth]), []).append(conv)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        size = lambda p: len(p[-1][1]) if p else 0
        children = lambda p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p]
        ends = ",".join(str(m) for m in members if len(paths[m]) == len(path))
        out.append(
            (
                members[0], len(path), nodes[path[:-1]][0] if path else None, len(members), len(children(path)),
                sum(not children(p) for p in below), sum((len(nodes[p]) - 1) * size(p) for p in below), hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r[c] for c in COLUMNS) for r in df.collect()], key=str)


def drawn(seed):
    draw = random.Random(seed)
    rows = [
        (c, draw.choice([None, 0, 1, 2, 3, 4, 5, 6, 7]), draw.choice(["user", "assistant", None]), draw.choice(["hello", "", None, "né", "why?"]))
        for c in [*range(0, 12), *range(100, 104), 205, 207, 301, 302, -3, 10_000_000_000]
        for _ in range(draw.randint(1, 9))
    ]
    rows += [(None, 0, "user", "nobody"), rows[0], rows[0]]
    rows += [(c, t, "user", "copied") for c in range(400, 430) for t in range(7)]
    return rows


@pytest.mark.parametrize(("seed", "span"), [(1, 1024), (2, 2)])
def test_against_plain_version(spark, monkeypatch, seed, span):
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rows = drawn(seed)
    df = spark.createDataFrame([(*r, 1, "o", 2) for r in rows], SCHEMA).repartition(3)
    own = talks(rows)
    assert result(prefix_trie.prefix_trie(df)) == plain(own)
    turns = prefix_trie.ordered_turns(df)
    assert sorted((r.conv_id, r.depth, r.size) for r in turns.collect()) == sorted((c, k + 1, len(t[1])) for c, ts in own.items() for k, t in enumerate(ts))
    assert result(prefix_trie.trie(*prefix_trie.rebuilt(turns))) == plain(rebuilt(own))


def test_turnless(spark):
    """A conversation whose turns are all replaced by those of an absent one is at the root only."""
    conv = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    df = spark.createDataFrame([(conv, 0, "user", "a"), (conv, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    found = result(prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(df))))
    assert found == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


def test_long_conversation_over_partitions(spark):
    """Turns of one conversation that lie in several partitions are numbered through."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).selectExpr("7L as conv_id", "id as turn", "'user' as role", "cast(id as string) as text").repartition(4)
        turns = prefix_trie.ordered_turns(df)
        assert sorted(r.depth for r in turns.collect()) == list(range(1, 5001))
        nodes = prefix_trie.prefix_trie(df)
        assert sorted((r.depth, r.n_children, r.saved_tokens) for r in nodes.collect()) == [(d, int(d < 5000), 0) for d in range(5001)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
