import hashlib
import random
from collections import defaultdict

from pyspark.sql import Row

from lockstep.llm import exact_dedup

SCHEMA = "doc_id long, text string, sha string, possible int, row string"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rows():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbBéÉ ") for _ in range(rng.randrange(0, 5))) for _ in range(600)] + [None, "", "É", "é", "hot"] + ["hot"] * 300 + ["HOT", "x" * 100_000]
    out = [Row(doc_id=i, text=t, sha="s", possible=1, row="r") for i, t in enumerate(texts)]
    return [*out, Row(doc_id=None, text="hot", sha="s", possible=1, row="r"), Row(doc_id=None, text="only null", sha="s", possible=1, row="r")]


def norm(t):
    return (t or "").translate(str.maketrans(UP, LOW))


def brute_force(rows):
    by = defaultdict(list)
    for r in rows:
        by[norm(r.text)].append(r.doc_id)
    out = []
    for t, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_classes(spark):
    got = exact_dedup.classes(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_force(rows())


def test_full_filter_is_still_exact(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows: 64)
    got = exact_dedup.classes(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_force(rows())


def test_unique_rows_pass_straight_through(spark):
    frame = spark.range(5000).selectExpr("sha2(cast(id as string), 256) AS sha").union(spark.sql("SELECT 'twice' AS sha FROM range(2)"))
    bits = exact_dedup.filter_bits(5002)
    flagged = exact_dedup.with_possible(frame, exact_dedup.repeat_filter(frame, bits), bits)
    assert flagged.where("sha = 'twice' AND possible").count() == 2
    assert flagged.where("possible").count() < 250


def test_keep_last(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    kept = exact_dedup.keep_last(frame)
    assert kept.columns == frame.columns
    want = sorted({(keep, sha) for _, keep, _, _, sha in brute_force(rows())}, key=str)
    assert sorted(((r.doc_id, hashlib.sha256(norm(r.text).encode()).hexdigest()) for r in kept.collect()), key=str) == want
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.classes(empty).count() == 0 and exact_dedup.keep_last(empty).count() == 0


def test_slices_give_the_same(spark, monkeypatch):
    frame = spark.createDataFrame(rows(), SCHEMA)
    whole, kept = sorted(map(tuple, exact_dedup.classes(frame).collect()), key=str), sorted(map(tuple, exact_dedup.keep_last(frame).collect()), key=str)
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 16 * (len(rows()) // 3))
    assert sorted(map(tuple, exact_dedup.classes(frame).collect()), key=str) == whole
    sliced = exact_dedup.keep_last(frame)
    assert sliced.columns == frame.columns and sorted(map(tuple, sliced.collect()), key=str) == kept
