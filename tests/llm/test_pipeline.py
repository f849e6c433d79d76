import random

import corpus_pipeline
import sentencepiece
from pyspark.sql import Row

from lockstep.llm import pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha int, p string"
SYLLABLES = {"aa": ["the", "ing", "ou", "sh", "er"], "bb": ["ein", "sch", "ü", "keit", "ge"]}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(2, 6))) for _ in range(n))


def brute_force(rows, items):
    """The documents that stay, stage by stage, by plain comparisons."""
    rows = [r for r in rows if r.text and any(c.isalpha() for c in r.text)]
    last = {}
    for r in rows:
        key = r.text.lower()
        if key not in last or r.doc_id > last[key].doc_id:
            last[key] = r
    rows = list(last.values())
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    sets = {r.doc_id: shingles(r.text) for r in rows}
    group = {r.doc_id: r.doc_id for r in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and near(sets[a], sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    rows = [r for r in rows if group[r.doc_id] == r.doc_id]
    return [r for r in rows if not any(i.lower().strip(".") in r.text.lower() for i in items)]


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    texts = [words(rng, "aa" if i % 2 else "bb", rng.randrange(150, 300)) for i in range(40)]
    items = [words(rng, "aa", 25) for _ in range(3)]
    texts += [texts[3], texts[3].upper(), texts[4], f"{texts[5]} {items[0]} {texts[6]}", None, "", "12 34", "short"]
    near = texts[10].split(" ")
    near[7] = "changed"
    texts += [" ".join(near), texts[11] + " tail", "tail " + texts[11]]
    rows = [Row(doc_id=i, text=t, lang="aa" if i % 2 else "bb", source="s", n_chars=len(t or ""), sha=1, p="x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([Row(item_id=i, text=t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = {r.doc_id: library.encode(r.text) for r in brute_force(rows, items)}
    assert len(want) == 41
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "sha", "p"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
