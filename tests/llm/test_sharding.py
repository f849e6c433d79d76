import random
import zlib
from collections import defaultdict

from pyspark.sql import Row

from lockstep.llm import sharding

SCHEMA = "doc_id long, text string, shard int, bytes string"


def test_differencing_beats_greedy():
    rng = random.Random(2)
    for k in (2, 3, 16):
        weights = [rng.randrange(1, 10_000) for _ in range(400)]
        sums, greedy = [0] * k, [0] * k
        for w, s in zip(weights, sharding.assign(weights, k), strict=True):
            sums[s] += w
        for w in sorted(weights, reverse=True):
            greedy[greedy.index(min(greedy))] += w
        assert sum(sums) == sum(weights)
        assert max(sums) - min(sums) <= max(greedy) - min(greedy)
    assert sharding.assign([], 4) == [] and sharding.assign([5], 4) == [0]


def plain_differencing(weights, k):
    """By the definition: lists of (sum, members) per slot; the two with the largest spread are combined again and again."""
    parts = [(w, i, [(w, [i])] + [(0, [])] * (k - 1)) for i, w in enumerate(weights)]
    count = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p[0], p[1]))
        a, b = parts.pop(0)[2], parts.pop(0)[2]
        new = sorted(((x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b), strict=True)), key=lambda s: -s[0])
        new = [(s - new[-1][0], m) for s, m in new]
        parts.append((new[0][0], count, new))
        count += 1
    return sorted(sorted(m) for _, m in parts[0][2])


def test_differencing_by_definition():
    rng = random.Random(5)
    for k in (2, 5, 16):
        weights = [rng.randrange(1, 40) for _ in range(150)]
        got = [[] for _ in range(k)]
        for i, s in enumerate(sharding.assign(weights, k)):
            got[s].append(i)
        assert sorted(got) == plain_differencing(weights, k)


def check(rows, got, shards):
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    slots, by_text = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        by_text[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    assert all(len(s) == 1 for s in by_text.values())


def test_groups_slots_and_balance(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_PER_TASK", 200)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 400))) for _ in range(500)]
    texts += [None, None, "", "hot"] + ["hot"] * 300 + ["x" * 3000]
    rows = [Row(doc_id=i if i % 50 else None, text=t, shard=1, bytes="b") for i, t in enumerate(texts)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 16).collect()
    check(rows, got, 16)
    sums = defaultdict(int)
    for r in got:
        sums[r.shard] += r.size
    assert max(sums.values()) - min(sums.values()) < 0.1 * sum(sums.values()) / 16


def test_empty_and_single(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [Row(doc_id=3, text=None, shard=0, bytes="")]
    got = sharding.shard_by_bytes(spark.createDataFrame(one, SCHEMA)).collect()
    check(one, got, 16)
