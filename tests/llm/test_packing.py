import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from lockstep.llm import packing
from lockstep.llm.token_files import default_tokenizer

SCHEMA = "doc_id long, text string, length string, rank int, ids string"


def check_plan(histogram, capacity):
    """Every piece once, every sequence of patterns exactly full or a power of two, the chain without gaps."""
    plan = packing.planned(histogram, capacity)
    ranks, sequences, chain = defaultdict(list), defaultdict(list), []
    for length, first, until, sequence, per, at in plan.runs:
        ranks[length] += range(first, until)
        for j in range(until - first):
            if per:
                sequences[sequence + j // per].append((at + j % per * length, length))
            else:
                chain.append((at + j * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    assert set(sequences) == set(range(plan.chain))
    for parts in [*sequences.values(), chain]:
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert parts is chain or end == capacity or (end < capacity and end & (end - 1) == 0)
    return plan


@pytest.mark.parametrize("capacity", [16, 64, 512])
def test_plans(capacity):
    rng = random.Random(capacity)
    for _ in range(12):
        check_plan(Counter(rng.choice([rng.randrange(1, capacity + 1), rng.randrange(1, capacity // 4)]) for _ in range(rng.randrange(1, 600))), capacity)
    for histogram in ({}, {1: 1}, {capacity: 5}, {capacity - 1: 40}, {capacity // 2: 3}, {1: 5000}, {3: 100, capacity - 3: 50}):
        check_plan(histogram, capacity)


def test_patterns_take_most_of_a_large_table():
    rng = np.random.default_rng(0)
    lengths, counts = np.unique((rng.lognormal(6, 1.2, 200_000) % 4095 + 1).astype(int), return_counts=True)
    plan = packing.planned(dict(zip(lengths.tolist(), counts.tolist(), strict=True)))
    assert plan.by_patterns > 0.8 * (lengths @ counts) / 4096
    assert sum((r[2] - r[1]) * r[0] for r in plan.runs if r[4] == 0) < 0.01 * (lengths @ counts)


def best_patterns(sizes, capacity):
    """All of them, by recursion."""
    if not sizes:
        return [()]
    return [(*rest, n) for n in range(capacity // sizes[-1] + 1) for rest in best_patterns(sizes[:-1], capacity - n * sizes[-1])]


def test_linear_program_by_duality():
    """The value equals the least one: no pattern of all is worth more than it costs at the prices that explain the value."""
    rng = random.Random(1)
    for _ in range(8):
        sizes = np.array(sorted(rng.sample(range(3, 20), 4)))
        counts = np.array([rng.randrange(1, 30) for _ in sizes], dtype=float)
        found = packing.patterns_of(sizes, counts, 24)
        assert np.allclose(sum(often * pieces for often, _, pieces in found), counts)
        assert all(total == pieces @ sizes <= 24 for _, total, pieces in found)
        columns = np.array([p for p in best_patterns(sizes.tolist(), 24) if any(p)])
        costs = np.array([packing.cost(int(c @ sizes), 24) for c in columns])
        value = sum(often * packing.cost(total, 24) for often, total, _ in found)
        basis = np.array([pieces for _, _, pieces in found])
        prices = np.linalg.lstsq(basis.astype(float), np.array([packing.cost(t, 24) for _, t, _ in found]), rcond=None)[0]
        gap = max(1, (columns @ prices / costs).max()) - 1
        least = counts @ sizes / 24
        assert value <= least * 1.002 or len(found) < len(sizes) or gap <= 0.005


def test_pricing_by_recursion():
    rng = random.Random(4)
    for _ in range(10):
        sizes = np.array(sorted(rng.sample(range(1, 12), 3)))
        prices = np.array([rng.random() for _ in sizes])
        best, _ = packing.price(sizes, prices, 20)
        want = np.full(21, -np.inf)
        for pattern in best_patterns(sizes.tolist(), 20):
            s = int(np.array(pattern) @ sizes)
            want[s] = max(want[s], np.array(pattern) @ prices)
        assert np.allclose(best, want)


def documents():
    rng = random.Random(2)
    words = ["tokens", "of", "invented", "prose", "Ünï", "12", "don't", "x", ",", "日本"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 300, 2000]))) for _ in range(150)]
    texts += [None, "", "same text", *["same text"] * 40, " ".join(["long"] * 9000)]
    return [Row(doc_id=i if i % 40 else None, text=t, length="x", rank=1, ids="y") for i, t in enumerate(texts)] + [Row(doc_id=7, text="again", length="", rank=0, ids="")] * 2


def test_pieces_and_sequences(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "BUCKETS", 3)
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = packing.op11_cutting_stock_packing(spark, str(tmp_path))
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    got = found.collect()
    library = Tokenizer.from_file(default_tokenizer())
    ids = [[*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in rows]
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    names = Counter(r.doc_id for r in rows)
    for r, x in zip(rows, ids, strict=True):
        mine = by_doc[r.doc_id]
        assert all(n == len(x) or names[r.doc_id] > 1 for *_, n in mine)
        if names[r.doc_id] == 1:
            end = 0
            for start, length, found_crc, _ in sorted(mine):
                assert start == end and found_crc == crc(x[start : start + length])
                end += length
            assert end == len(x)
    assert sum(r.length for r in got) == sum(map(len, ids))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    waste = 0
    for parts in sequences.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= 4096
        waste += packing.padded(end, 4096) - end
    assert waste < 4096
    whole = {r.sequence_id: r for r in packing.sequences(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert sum(r.n_tokens for r in whole.values()) == sum(map(len, ids))
    assert all(len(r.ids) == 4 * packing.padded(r.n_tokens, 4096) for r in whole.values())
    held = Counter(i for r in whole.values() for i in np.frombuffer(r.ids, "<u4")[: r.n_tokens].tolist())
    assert held == Counter(i for x in ids for i in x)


def test_chain_cuts_at_sequence_ends(spark):
    rows = spark.createDataFrame([Row(uid=i, doc_id=i, start=0, length=3000, ids=np.arange(3000, dtype="<u4").tobytes()) for i in range(30)], "uid long, doc_id long, start long, length long, ids binary")
    plan = packing.plan_of(rows)
    got = packing.placed(rows, plan).collect()
    assert plan.cut == [3000] and len(got) > 30
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == list(range(r.start, r.start + r.length)) and r.whole == 3000
    ends = Counter()
    for r in got:
        ends[r.sequence_id] += r.length
    assert sorted(ends.values())[1:] == [4096] * (len(ends) - 1) and sum(ends.values()) == 90_000


def test_empty(spark):
    assert packing.sequences(spark.createDataFrame([], SCHEMA)).count() == 0
