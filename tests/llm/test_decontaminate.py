import random
import re

import pytest
from pyspark.sql import Row

from lockstep.llm import decontaminate
from lockstep.llm.decontaminate import WINDOW, classify

DOCS = "doc_id long, text string, row string, mark int"
BENCH = "item_id long, text string, extra int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(n))


QUESTION = "a farmer sells 12 baskets of apples for 30 dollars and later Maria buys 12 baskets from the old market near Oslo for 45 dollars in total"
OTHER = "a farmer sells 7 baskets of apples for 80 euros and later Kevin buys 7 baskets from the old market near Lima for 99 euros in total"
BROKEN = "a farmer sells 7 baskets of apples for 80 euros and later Kevin buys 9 baskets from the old market near Kevin for 80 miles in total"


def frames(spark):
    rng = random.Random(1)
    items = [QUESTION] + [words(rng, rng.randrange(12, 40)) + "." for _ in range(20)]
    docs, want = [], set()
    for i in range(60):
        parts = [words(rng, rng.randrange(5, 80)).capitalize() + "."]
        if i % 3 == 0:
            k = rng.randrange(1, 21)
            parts += [items[k], words(rng, 10)]
            want.add((i, k))
        docs.append(" ".join(parts))
    texts = [*docs, f"Look: {OTHER}.", f"so {words(rng, 9)} {QUESTION} {QUESTION}", f"here {BROKEN}", None, "", "x" * 50_000, " ".join(items[1].split()[: len(items[1].split()) // 2])]
    want |= {(60, 0), (61, 0)}
    d = spark.createDataFrame([Row(doc_id=i, text=t, row="r", mark=1) for i, t in enumerate(texts)], DOCS)
    b = spark.createDataFrame([Row(item_id=i, text=t, extra=1) for i, t in enumerate(items)] + [Row(item_id=50, text=None, extra=1), Row(item_id=51, text="too short", extra=1)], BENCH)
    return d, b, want


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, -1])
def test_planted_items_and_templates(spark, limit):
    docs, bench, want = frames(spark)
    got = decontaminate.leaks(docs, bench, limit=limit).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {r.doc_id: r.same_values for r in got if r.item_id == 0} == {60: False, 61: True}


def canonical(text):
    """Template tokens by plain rules, apart from the operator's: (token, value) with value for placeholders only."""
    out, start = [], True
    for raw in text.split():
        word = raw.strip(".,:?!")
        if re.fullmatch(r"\d+", word):
            out.append(("NUM", word))
        elif word in ("dollars", "euros", "miles") and out and out[-1][0] == "NUM":
            out.append(("UNIT", word))
        elif word[:1].isupper() and not start:
            out.append(("NAME", word.lower()))
        else:
            out.append((word.lower(), None))
        start = raw[-1] in ".:?!"
    return out


def brute_force(text, item):
    """Best coverage of item in text over all shifts, by windows with equal tokens whose slots are consistent."""
    a, b = canonical(text), canonical(item)
    covered = set()
    for shift in range(-len(b), len(a)):
        same = [p for p in range(len(b) - WINDOW + 1) if all(0 <= p + k + shift < len(a) and a[p + k + shift][0] == b[p + k][0] for k in range(WINDOW))]
        same = [p for p in same if 2 * sum(b[p + k][1] is not None for k in range(WINDOW)) <= WINDOW]
        places = {p + k for p in same for k in range(WINDOW)}
        pairs = {(b[p][1], a[p + shift][1]) for p in places if b[p][1] is not None}
        if len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs):
            covered |= places
    return len(covered) / max(1, len(b))


def test_against_brute_force(spark):
    docs, bench, _ = frames(spark)
    items = [r for r in bench.collect() if r.text and len(r.text.split()) >= WINDOW]
    want = {(d.doc_id, b.item_id): round(c, 6) for d in docs.collect() for b in items if d.text and (c := brute_force(d.text, b.text)) >= decontaminate.COVER}
    assert (60, 0) in want
    assert {(r.doc_id, r.item_id): r.coverage for r in decontaminate.leaks(docs, bench).collect()} == want


def found(spark, texts, items):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, row="r", mark=1) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([Row(item_id=i, text=t, extra=1) for i, t in enumerate(items)], BENCH)
    return {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}


def test_times_are_whole_values(spark):
    item = "the train to the coast leaves at 10:30 from here and at 11:30 from the old harbour gate"
    good, bad = item.replace("10:30", "8:15").replace("11:30", "9:15"), item.replace("10:30", "8:15").replace("11:30", "8:15")
    assert found(spark, [good, bad, item], [item]) == {(0, 0), (2, 0)}


def test_names_of_several_words(spark):
    item = "yesterday the painter Anna Smith gave her friend Bob a small picture of the quiet lake"
    assert found(spark, ["so " + item.replace("Anna Smith", "Kevin").replace("Bob", "Mary Ann Jones")], [item]) == {(0, 0)}


def test_items_dense_in_values_and_short_ones(spark):
    dense = ["Sort the numbers 12, 7, 19, 3, 25, 8, 14 and 2 in ascending order.", "Which of Paris, London, Berlin, Rome, Madrid and Lisbon is the northernmost capital?", "12 + 7 = 19, 4 x 5 = 20, 8 - 3 = ?"]
    short = ["extraordinary thermodynamics", "too short", "这是一个关于长江和黄河的问题"]
    texts = [f"We ask them here. {d} And so on." for d in dense] + ["all about extraordinary thermodynamics here", "this is too short here", "Too short.", "前言这是一个关于长江和黄河的问题结束"]
    assert found(spark, texts, dense + short) == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 4), (6, 5)}


def test_names_at_sentence_starts_and_number_words(spark):
    anna = "Anna has 5 apples. Anna buys 3 more apples. How many apples does Anna have now?"
    tom = "Tom has 7 apples. Tom buys 4 more apples. How many apples does Tom have now?"
    mixed = "Tom has 7 apples. Kim buys 4 more apples. How many apples does Lee have now?"
    balls = "there are three red balls in the big box and four green balls in the small bag on the shelf"
    other = balls.replace("four", "nine").replace("three", "five")
    chance = balls.replace("four", "three")
    texts = [f"So we ask. {tom}", anna, mixed, f"well {other} here", chance, "How many apples does anyone buy now? Tom has more."]
    assert found(spark, texts, [anna, balls]) == {(0, 0), (1, 0), (3, 1)}


def test_second_reading_never_takes_matches_away(spark):
    """Another word at a sentence start, which as a name would disagree, leaves the first reading's windows."""
    item = "Which of these is the oldest town by the river bank today? Which one has the longest stone bridge over the water here?"
    near = item.replace("Which of", "What of")
    assert found(spark, [f"so: {near}"], [item]) == {(0, 0)}


def test_null_and_repeated_ids(spark):
    docs, bench, _ = frames(spark)
    rows = [Row(doc_id=None, text=f"x {QUESTION}", row="r", mark=1)] * 2 + [Row(doc_id=4, text=f"y {QUESTION}", row="r", mark=1), Row(doc_id=4, text="clean words only", row="r", mark=1)]
    frame = spark.createDataFrame(rows, DOCS)
    assert sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench).collect()), key=str) == [(4, 0), (None, 0)]
    assert [r.text for r in decontaminate.without_leaks(frame, bench).collect()] == ["clean words only"]


def test_filter_keeps_clean_rows_and_columns(spark):
    docs, bench, want = frames(spark)
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(67)) - {d for d, _ in want}
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_classify():
    assert classify("12,5%.")[1] & decontaminate.NUMERIC
    assert classify("Maria")[1] == decontaminate.CAPITAL
    assert classify("miles")[1] == decontaminate.UNIT
    assert classify("...")[0] == ""
