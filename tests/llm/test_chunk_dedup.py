import random

import numpy as np
from pyspark.sql import Row

from lockstep.llm import chunk_dedup
from lockstep.llm.chunk_dedup import GEAR, MAX_CHUNK, MIN_CHUNK, cuts, gear

SCHEMA = "doc_id long, text string, uid string, run int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def test_gear_is_the_rolling_hash():
    data = np.frombuffer(words(random.Random(1), 300).encode(), dtype=np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(GEAR[b])) % (1 << 32)
        want.append(h)
    assert gear(data).tolist() == want


def test_cuts_cover_and_resist_shifts():
    rng = random.Random(2)
    text = words(rng, 2000).encode()
    ends = cuts(text)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(text) and max(sizes) <= MAX_CHUNK and min(sizes[:-1]) >= MIN_CHUNK
    assert all(text[:e].decode() is not None for e in ends)
    shifted = b"some inserted words " + text
    pieces = lambda d: {d[a:b] for a, b in zip([0, *cuts(d)], cuts(d))}
    assert len(pieces(text) & pieces(shifted)) > 0.9 * len(ends)
    assert cuts(b"") == [] and cuts("é".encode() * 2000)[-1] == 4000


def brute_force(docs, min_words):
    """Same definition, chunk by chunk."""
    chunks = []
    for u, d in enumerate(docs):
        data = (d.text or "").encode()
        ends = cuts(data)
        chunks.append([(a, data[a:b]) for a, b in zip([0, *ends], ends)])
    holders = {}
    for u, c in enumerate(chunks):
        for _, piece in c:
            holders.setdefault(piece, set()).add(u)
    out = []
    for u, c in enumerate(chunks):
        run = []
        for a, piece in [*c, (None, None)]:
            if piece is not None and len(holders[piece]) > 1:
                run.append((a, piece))
                continue
            n = sum(len(p.split()) for _, p in run)
            if run and n >= min_words:
                ids = [docs[h].doc_id for _, p in run for h in holders[p] if docs[h].doc_id is not None]
                out.append((docs[u].doc_id, run[0][0], sum(len(p) for _, p in run), n, len(run), min(ids, default=None)))
            run = []
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    passage = [words(rng, 70) for _ in range(3)]
    texts = []
    for i in range(60):
        parts = [words(rng, rng.randrange(5, 120))]
        if i % 3 == 0:
            parts += [passage[i % 9 // 3], words(rng, 30)]
        texts.append(" ".join(parts))
    texts += [texts[5], texts[5], None, "", "short", "x" * 20_000, words(rng, 20_000)]
    docs = [Row(doc_id=i if i != 9 else None, text=t, uid="u", run=1) for i, t in enumerate(texts)]
    got = chunk_dedup.passages(spark.createDataFrame(docs, SCHEMA)).collect()
    want = brute_force(docs, chunk_dedup.MIN_WORDS)
    assert sorted(((r.doc_id, r.start, r.n_bytes, r.n_words, r.n_chunks, r.first_doc_id) for r in got), key=str) == want
    found = {r.doc_id for r in got}
    assert found >= {i for i in range(0, 60, 3) if i != 9} | {5, 60, 61}
    assert not found & {i for i in range(60) if i % 3 and i != 5}


def test_removal_keeps_one_copy(spark):
    rng = random.Random(4)
    passage = words(rng, 80)
    docs = [Row(doc_id=i, text=f"{words(rng, 40)} {passage} {words(rng, 40)}", uid="u", run=1) for i in range(4)]
    got = {r.doc_id: r.text for r in chunk_dedup.without_repeats(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got[0] == docs[0].text
    assert all(len(got[i]) < len(docs[i].text) - 300 for i in (1, 2, 3))
    assert chunk_dedup.passages(spark.createDataFrame([], SCHEMA)).count() == 0


def common_words(a, b):
    """Of the longest run of chunks of text a that text b has too."""
    pieces = [[d[x:y] for x, y in zip([0, *cuts(d)], cuts(d))] for d in (a.encode(), b.encode())]
    best = run = 0
    for p in pieces[0]:
        run = run + chunk_dedup.word_count(p) if p in set(pieces[1]) else 0
        best = max(best, run)
    return best


def test_passages_of_51_words_are_found():
    rng = random.Random(6)
    for make, join in ((words, " "), (lambda rng, n: "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(2 * n)), "")):
        for _ in range(400):
            passage = make(rng, 51)
            one, two = (join.join([make(rng, rng.randrange(1, 60)), passage, make(rng, rng.randrange(1, 60))]) for _ in range(2))
            assert common_words(one, two) >= chunk_dedup.MIN_WORDS
    blob = "".join(rng.choice("abcdefgh") for _ in range(1000))
    assert len(set(cuts(blob.encode())) & {e - 7 for e in cuts(b"shifted" + blob.encode())}) > 20


def test_side_by_side_passages_stay_with_their_first_holders(spark):
    rng = random.Random(8)
    one, both, two = words(rng, 80), words(rng, 60), words(rng, 80)  # what both share makes one run of the two
    texts = {1: f"{words(rng, 30)} {both} {two} {words(rng, 30)}", 5: f"{words(rng, 30)} {one} {both} {two} {words(rng, 30)}", 9: f"{words(rng, 30)} {one} {both} {words(rng, 30)}"}
    frame = spark.createDataFrame([Row(doc_id=i, text=t, uid="u", run=1) for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: r.text for r in chunk_dedup.without_repeats(frame).collect()}
    assert got[1] == texts[1]
    assert one[:300] in got[5] and two[100:200] not in got[5]
    assert one[100:200] not in got[9]
