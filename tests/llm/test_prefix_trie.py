"""The prefix trie and its tree contraction against plain recursion."""

import collections
import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from clausewise.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for c, s in made.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[:d - 1]].add(s[:d])
    sums = {}
    for s in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        leaves, saved = 0 if kids[s] else 1, (len(members[s]) - 1) * words
        sums[s] = (leaves + sum(sums[k][0] for k in kids[s]), saved + sum(sums[k][1] for k in kids[s]))
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), *sums[s],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if made[c] == s))).encode()).hexdigest())
                   for s, m in members.items()), key=str)


def test_trie_equals_recursion_with_odd_rows(spark):
    draw = random.Random(3)
    ids = [None, -7, -20, -27, 0, 1, 2, 3, 20, 21, 22, 40, 41, 45, *range(100, 135)]
    rows = [(draw.choice(ids), draw.choice([None, 0, 1, 2, 3]), draw.choice(["u", "a", None]), draw.choice(["x", "y y", None, "", "z\t z"])) for _ in range(300)]
    rows += [(7 + 20 * i, j, "u", "one long chain") for i in range(3) for j in range(40 + i)]  # compressed
    rows += [(c, 0, "system", "hello there") for c in range(200, 260)]                          # a hot turn and its ends
    rows += [(300, 0, "u", "w " * 40_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("extra") for c in ("c", "d", "_scan", "a", "words")}).repartition(3)
    got = sorted(map(tuple, prefix_trie.trie(df).collect()), key=str)
    assert got == brute(rows)
    assert prefix_trie.trie(df.limit(0)).collect() == []


def test_subtree_totals_of_any_forest(spark):
    draw = random.Random(8)
    up = {0: None, 1: None}
    for v in range(2, 120):
        up[v] = v - 1 if draw.random() < 0.7 else draw.randrange(v)  # long chains with branches
    weight = {v: draw.randint(-3, 9) for v in up}
    total = dict(weight)
    for v in sorted(up, reverse=True):
        if up[v] is not None:
            total[up[v]] += total[v]
    depth = {}
    for v, p in up.items():
        depth[v] = 0 if p is None else depth[p] + 1
    tree = spark.createDataFrame([(v, -v, p, None if p is None else -p, depth[v], weight[v], 1) for v, p in up.items()],
                                 "a bigint, b bigint, pa bigint, pb bigint, depth bigint, w bigint, one bigint")
    got = {r.a: r.w for r in prefix_trie.subtree_totals(tree, ["w", "one"]).collect()}
    assert got == total
