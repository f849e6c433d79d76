import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from lockstep.llm import language

SCHEMA = "doc_id long, text string, lang string, p string, row int"
SYLLABLES = {"aa": ["the", "ing", "ou", "sh"], "bb": ["ein", "sch", "ü", "keit"], "cc": ["ção", "que", "ez", "ll"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(1)
    rows = [Row(doc_id=i, text=text(rng, lang, rng.randrange(5, 200)), lang=lang, p="x", row=1) for i, lang in enumerate(sorted(SYLLABLES) * 60)]
    return [*rows, Row(doc_id=None, text=None, lang="aa", p=None, row=None), Row(doc_id=901, text="", lang=None, p="", row=0), Row(doc_id=902, text="123 !!", lang="bb", p="", row=0)]


def test_held_out_accuracy_and_cases(spark):
    rows = corpus()
    got = language.predictions(spark.createDataFrame(rows, SCHEMA)).collect()
    truth = {r.doc_id: r.lang for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (None, 901, 902))
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_mixture_proportions():
    rng = random.Random(2)
    names, model = language.fit({k: [text(rng, k, 2000)] for k in SYLLABLES})
    mixed = " ".join([text(rng, "aa", 300), text(rng, "bb", 100)])
    main, share, size = language.infer([language.word_scores(mixed, model), language.word_scores(text(rng, "cc", 50), model), np.empty((0, 3), np.float32)], 3)
    assert [names[m] if m >= 0 else None for m in main] == ["aa", "cc", None]
    assert share[0] == pytest.approx(0.75, abs=0.05) and list(size) == [2, 1, 0]


def plain_inference(scores):
    """Main language, its proportion and the size of the set of one text by loops: EM over all languages, then over the
    one, two, ... most likely ones until the penalised likelihood falls."""
    n, k = len(scores), len(scores[0])
    rel = [[math.exp(max(x - max(row), -50)) for x in row] for row in scores]

    def em(allowed):
        w = [1 / len(allowed) if j in allowed else 0.0 for j in range(k)]
        for _ in range(language.ROUNDS):
            new = [0.0] * k
            for row in rel:
                total = sum(a * b for a, b in zip(row, w))
                for j in range(k):
                    new[j] += row[j] * w[j] / total
            w = [x / n for x in new]
        return w, sum(math.log(sum(a * b for a, b in zip(row, w))) for row in rel)

    weights, _ = em(range(k))
    order = sorted(range(k), key=lambda j: -weights[j])
    best, top, size = -math.inf, None, 0
    for m in range(1, k + 1):
        part, likelihood = em(order[:m])
        likelihood -= language.PENALTY / 2 * (m - 1) * math.log(n)
        if likelihood <= best:
            break
        best, top, size = likelihood, max(range(k), key=lambda j: part[j]), m
    return top, weights[top], size


def test_against_plain_loops():
    rng = random.Random(4)
    more = SYLLABLES | {"dd": ["zr", "ksa", "vy"], "ee": ["oio", "uu", "wa"]}
    names, model = language.fit({k: [" ".join("".join(rng.choice(more[k]) for _ in range(3)) for _ in range(800))] for k in more})
    made = lambda k, n: " ".join("".join(rng.choice(more[k]) for _ in range(3)) for _ in range(n))
    texts = [made(rng.choice(list(more)), rng.randrange(1, 30)) for _ in range(12)] + [" ".join(made(k, 40) for k in more), " ".join(made(k, 25) for k in ("aa", "dd", "ee")), "x"]
    words = [language.word_scores(x, model) for x in texts]
    main, share, size = language.infer(words, len(names))
    for i, w in enumerate(words):
        top, part, k = plain_inference(w.astype(float).tolist())
        assert (int(main[i]), int(size[i])) == (top, k) and abs(share[i] - part) < 1e-6
    assert size[12] == 5 and size[13] == 3


def test_pieces_change_nothing(monkeypatch):
    rng = random.Random(3)
    names, model = language.fit({k: [text(rng, k, 500)] for k in SYLLABLES})
    long = text(rng, "bb", 3000)
    whole = language.word_scores(long, model)
    monkeypatch.setattr(language, "PIECE", 100)
    assert np.allclose(whole, language.word_scores(long, model))
    assert len(whole) == 3000


def test_filter_and_empty(spark):
    frame = spark.createDataFrame(corpus(), SCHEMA)
    kept = language.keep_identified(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(180))
    empty = spark.createDataFrame([], SCHEMA)
    assert language.predictions(empty).count() == 0
    unlabelled = spark.createDataFrame([Row(doc_id=1, text="the", lang=None, p="", row=1)], SCHEMA)
    assert [tuple(r) for r in language.predictions(unlabelled).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert [r.doc_id for r in language.keep_identified(unlabelled.union(spark.createDataFrame([Row(doc_id=2, text="12", lang=None, p="", row=1)], SCHEMA))).collect()] == [1]
