import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import Row

from lockstep.llm import pieces

SCHEMA = "doc_id long, text string, ids string"
ALPHABET = "aabcdeéß ▁\n\t  𝔘x1290<>/s日本語"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def texts(n=400):
    rng = random.Random(1)
    some = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    words = "The internationalization of unbelievable counterexamples, reconsidered: antidisestablishmentarianism!".split()
    some += [" ".join(rng.choice(words) for _ in range(30)) for _ in range(20)]
    return [*some, "x" * 5000, " " * 300, "aaaaaaa", "  a", "éé\n\n x", "", "</s><unk>", "a"]


def test_ids_are_the_library_s(library):
    model = pieces.Pieces(pieces.default_model())
    for text, got, want in zip(texts(), model.encode(texts()), library.encode(texts()), strict=True):
        assert got.tolist() == want, text
        assert model.decode(got.tolist()) == text.replace(pieces.MARK, " ")


def test_allowed_transitions_by_the_merges():
    model = pieces.Pieces(pieces.default_model())
    rng = random.Random(2)
    names = [p for p in model.ids if len(p) < 5 and p.strip(pieces.MARK)]
    for _ in range(3000):
        a, b = rng.choice(names), rng.choice(names)
        assert model._fits(model.ids[a], model.ids[b]) == (model.merged(a + b) == [a, b])


def test_memo_generations_change_nothing(monkeypatch, library):
    monkeypatch.setattr(pieces, "MEMO", 5)
    model = pieces.Pieces(pieces.default_model())
    for t in texts(60):
        assert model.encode([t])[0].tolist() == library.encode(t)


def test_query(spark, library):
    rows = [Row(doc_id=i if i else None, text=t, ids="x") for i, t in enumerate([None, *texts(50)])]
    got = pieces.encoded(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {r.doc_id: library.encode(r.text or "") for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == want[r.doc_id] and r.n_ids == len(r.ids) and r.round_trip
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    assert pieces.encoded(spark.createDataFrame([], SCHEMA)).count() == 0
