"""The trie of prefixes against a plain reading."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from loomframe.llm import prefix_trie as P
from loomframe.llm.common import read
from tests.llm.helpers import SF

ROWS = "conv_id long, turn long, role string, text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for *_, role, text in sorted(v)] for c, v in convs.items()}
    members, children, again = defaultdict(list), defaultdict(list), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        again[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(again[c]) + 1):
            members[again[c][:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, leaves, saved = set(), {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(WORDS.findall(node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if len(again[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def agrees(spark, made, **sizes):
    got = P.trie(spark.createDataFrame(made, ROWS), **sizes).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plain_trie(made)
    return got


@pytest.mark.parametrize("seed, size, rows", [(0, 2, 5), (1, 3, 7), (2, 1, 11), (3, 128, 6)])
def test_any_cut_into_blocks_and_ranges(spark, seed, size, rows):
    """Many copies and shared beginnings, null and repeated turns, null roles, conversations without turns, negative ids."""
    rnd, made = random.Random(seed), [(None, t, "u", "a") for t in range(5)]
    for c in range(-5, 60):
        for t in range(rnd.choice([0, 1, 2, 3, 5, 9, 12])):
            turn = None if rnd.random() < 0.05 else t if rnd.random() < 0.9 else 0
            made.append((c, turn, rnd.choice(["u", "u", None]), rnd.choice(["a", "a", "a b", None] if t < 6 else ["a"])))
    agrees(spark, made, size=size, rows=rows)


def test_long_conversations_that_part_late(spark):
    made = [(c, t, "u", f"w{t} x" if t < 300 - c or c % 2 else "other") for c in range(0, 60, 20) for t in range(300)]
    made += [(c, t, "u", f"w{t} x") for c in (100, 120) for t in range(256)]
    agrees(spark, made)


def test_one_group_of_copies_over_many_ranges(spark):
    got = agrees(spark, [(20 * c, t, "u", "same") for c in range(400) for t in range(3)], rows=9)
    assert len(got) == 4 and {r.n_convs for r in got} == {400}


def test_no_rows_one_turn_and_only_borrowed_turns(spark):
    agrees(spark, [])
    agrees(spark, [(None, 0, "u", "x")])
    agrees(spark, [(41, 0, "u", "x")])
    agrees(spark, [(c, 0, "u", "x") for c in range(1, 20)])
    agrees(spark, [(c, 0, "u", "very long " * 200_000) for c in (0, 1, 2)])


def test_whole_table_and_extra_columns(spark):
    table = read(spark, SF, "conversations")
    from pyspark.sql import functions as F

    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    clash = table.withColumns({c: F.lit("x") for c in ("c", "p", "part", "words", "id", "up", "kind", "total")})
    got = P.trie(clash.repartition(5)).collect()
    assert {tuple(r) for r in got} == plain_trie(rows) and len(got) == len(plain_trie(rows))
