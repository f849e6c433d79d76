import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from lockstep.llm import simhash
from lockstep.llm.simhash import EXACT, SIMILAR, Scheme

SCHEMA = "doc_id long, text string, node string, k0 int"


def brute_print(text, k=3, seed=42):
    words = [w for w in "".join(c if c not in " \t\n\r\x0b\x0c" else " " for c in (text or "")).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    """prints: list of (id, fingerprint); id -> smallest id reachable."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(prints):
        if d is not None and (least[find(i)] is None or d < least[find(i)]):
            least[find(i)] = d
    return [(d, least[find(i)]) for i, (d, _) in enumerate(prints)]


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    docs = []
    for _ in range(n):
        if docs and rng.random() < 0.6:
            words = rng.choice(docs).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(["X", "yy", "Zzz"])
            docs.append(" ".join(words))
        else:
            docs.append(" ".join(rng.choice("alpha Beta gämma delta eps zeta".split()) + str(rng.randrange(50)) for _ in range(rng.randrange(30, 200))))
    return [*docs, None, "", " \t\n", "one", "One", "two words", "é" * 5000]


def rows_of(docs):
    return [Row(doc_id=i if i != 7 else None, text=t, node="x", k0=1) for i, t in enumerate(docs)]


@pytest.mark.parametrize("limit", [simhash.RUN_LIMIT, 2])
def test_against_brute_force(spark, limit):
    docs = rows_of(corpus())
    got = simhash.classes(spark.createDataFrame(docs, SCHEMA), EXACT, limit).collect()
    prints = [(r.doc_id, brute_print(r.text)) for r in docs]
    assert sorted(((r.doc_id, r.f0 % (1 << 64)) for r in got), key=str) == sorted(prints, key=str)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(brute_components(prints, 3), key=str)


def test_chain_of_links(spark):
    """Neighbours differ by two bits, so that a component reaches further than any link."""
    prints = [0]
    for i in range(30):
        prints.append(prints[-1] ^ (0b11 << (2 * i)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p, i, p) for i, p in enumerate(signed)], "f0 long, least long, node long")
    roots = simhash.components(simhash.links(frame, EXACT)).collect()
    assert len(roots) == 31 and len({r.root for r in roots}) == 1


def test_every_distance_is_found(spark):
    rng = random.Random(5)
    pairs = []
    for d in range(6):
        for _ in range(20):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), d):
                b ^= 1 << bit
            pairs.append((a, b, d))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = spark.createDataFrame(sorted({(signed(x), signed(x)) for a, b, _ in pairs for x in (a, b)}), "f0 long, node long")
    got = {frozenset((r.a, r.b)) for r in simhash.links(frame, EXACT).collect()}
    for a, b, d in pairs:
        if d:
            assert (frozenset((signed(a), signed(b))) in got) == (d <= 3)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.classes(empty).count() == 0
    assert simhash.keep_first(empty).columns == empty.columns


def test_keep_first_drops_near_copies_only(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(40)]
    near = []
    for t in texts[:10]:
        words = t.split(" ")
        words[rng.randrange(400)] = "changed"
        near.append(" ".join(words))
    rows = [Row(doc_id=i, text=t, node="x", k0=1) for i, t in enumerate(texts + near)] + [Row(doc_id=None, text=texts[20], node="y", k0=2)]
    kept = simhash.keep_first(spark.createDataFrame(rows, SCHEMA), SIMILAR)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    assert kept.columns == ["doc_id", "text", "node", "k0"]


def test_sketches_are_exact_for_short_texts_and_close_for_long_ones():
    rng = np.random.default_rng(1)
    close = [simhash.close_sketches(j) for j in np.arange(0.01, 1.0, 0.01)]
    for n, error in ((30, 0.06), (3000, 0.09)):
        for _ in range(20):
            shared, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, n // 8, n // 9))
            one, two = (simhash.sketch(np.concatenate([shared, x])) for x in (a, b))
            got = sum(bool(c(one.view(np.uint64), two[None].view(np.uint64))[0]) for c in close) / 100
            assert abs(got - n / (n + n // 8 + n // 9)) < error
    none = np.full((1, simhash.BINS), simhash.EMPTY, dtype=np.uint16)
    assert simhash.close_sketches(0.8)(none[0].view(np.uint64), none.view(np.uint64))[0]


def test_groups_of_near_copies_by_similarity(spark):
    """A large family whose members are 0.9 alike, one of pairs that are 0.6 alike."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(9000)}" for _ in range(300)]
    rows, n = [], 0
    for _ in range(150):
        words = list(base)
        words[rng.randrange(300)] = f"x{n}"
        rows.append(Row(doc_id=n, text=" ".join(words), node="f", k0=0))
        n += 1
    apart = []
    for _ in range(20):
        words = [f"w{rng.randrange(9000)}" for _ in range(200)]
        for _ in range(2):
            rows.append(Row(doc_id=n, text=" ".join(words), node="p", k0=0))
            apart.append(n)
            n += 1
            for k in range(5, 200, 20):
                words[k] = f"y{n}"
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, SCHEMA), SIMILAR).collect()}
    assert kept == {0, *apart}


def test_repeated_lines_do_not_decide(spark):
    """One line that fills two texts does not make them alike; one added to a text often leaves it nearly the same."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    line, rows = words(9), []
    for _ in range(10):
        rows.append(" ".join(words(60) + line * 80))
    for _ in range(10):
        rows.append(" ".join(words(200)))
    rows += [f"{t} {' '.join(line * 60)}" for t in rows[10:]]
    frame = spark.createDataFrame([Row(doc_id=i, text=t, node="r", k0=0) for i, t in enumerate(rows)], SCHEMA)
    assert sorted(r.doc_id for r in simhash.keep_first(frame, SIMILAR).collect()) == list(range(20))


def test_links_are_exact(spark):
    """Pairs at and a little above 0.8 are linked, those a little below are not."""
    rng, rows, want = random.Random(12), [], []
    for i in range(120):
        words = [f"w{rng.randrange(99999)}" for _ in range(184)]  # 180 shingles
        changed = list(words)
        for k in range(4 if i % 2 else 5):  # five shingles each: 160 of 200 are common, or 155 of 205
            changed[20 + 30 * k] = "x"
        rows += [" ".join(words), " ".join(changed)]
        want += [2 * i] if i % 2 else [2 * i, 2 * i + 1]
    frame = spark.createDataFrame([Row(doc_id=i, text=t, node="e", k0=0) for i, t in enumerate(rows)], SCHEMA)
    assert sorted(r.doc_id for r in simhash.keep_first(frame, SIMILAR).collect()) == want


def test_scheme_is_complete():
    for scheme in (EXACT, Scheme(3, 1, 3, ((0, 0, 32), (0, 32, 32)), 1)):
        assert sum(scheme.radius + 1 for _ in scheme.segments) > scheme.distance


def test_links_of_several_schemes_are_one_graph(spark):
    """The pipeline takes the links of op8's index and the similar texts together: 0 and 2 have one fingerprint, 1 and 2 are
    similar, 0 and 1 neither."""
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    line, own, alone = words(9), words(60), words(60)
    texts = [" ".join(alone + line * 200), " ".join(own), " ".join(own + line * 200), " ".join(words(80))]
    prints = [brute_print(t) for t in texts]
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3
    assert near(0, 2) and not near(0, 1) and not near(1, 2)
    frame = spark.createDataFrame([Row(doc_id=i, text=t, node="s", k0=0) for i, t in enumerate(texts)], SCHEMA)
    kept = lambda docs: sorted(r.doc_id for r in docs.collect())
    assert kept(simhash.keep_first(frame, SIMILAR)) == [0, 1, 3]
    assert kept(simhash.keep_first(frame, EXACT)) == [0, 1, 3]
    assert kept(simhash.keep_first(frame, EXACT, SIMILAR)) == [0, 3]
    assert kept(corpus_pipeline.near_copies(spark, frame, "")) == [0, 3]
