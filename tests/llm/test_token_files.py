import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from lockstep.llm import range_coder, token_files
from lockstep.llm.common import new_path

SCHEMA = "doc_id long, text string, start string"


@pytest.mark.parametrize("vocabulary", [1, 2, 1000, 49408])
def test_coder_round_trip(vocabulary):
    rng = np.random.default_rng(vocabulary)
    blocks = [rng.integers(0, vocabulary, n) for n in (0, 1, 700, 3)] + [np.minimum(rng.geometric(0.1, 900) - 1, vocabulary - 1), np.zeros(500, int), np.arange(400) % vocabulary]
    payloads = range_coder.encode(blocks, vocabulary)
    for a, b in zip(blocks, range_coder.decode(payloads, [len(b) for b in blocks], vocabulary), strict=True):
        assert (a == b).all()
    alone = range_coder.decode([payloads[4]], [900], vocabulary)[0]
    assert (alone == blocks[4]).all()
    assert range_coder.encode([], 5) == [] and range_coder.decode([], [], 5) == []


def test_contexts_compress():
    rng = np.random.default_rng(1)
    cycle = rng.integers(0, 5000, 300)
    block = np.tile(cycle, 20)
    plain = rng.integers(0, 5000, 6000)
    sizes = [len(p) for p in range_coder.encode([block, plain], 5000)]
    assert sizes[0] * 5 < sizes[1]


def test_files_find_damage():
    docs = [(3, np.arange(50, dtype=np.uint32)), (None, np.empty(0, np.uint32)), (9, np.full(3000, 7, np.uint32))]
    f = io.BytesIO()
    assert token_files.write_file(f, iter(docs)) == (3, 3050)
    raw = f.getvalue()
    got = list(token_files.read_file(io.BytesIO(raw), len(raw)))
    assert [d for d, _ in got] == [3, None, 9] and all((a == b).all() for (_, a), (_, b) in zip(docs, got, strict=True))
    found = 0
    for at in range(len(raw)):
        bad = bytearray(raw)
        bad[at] ^= 0x10
        try:
            again = list(token_files.read_file(io.BytesIO(bytes(bad)), len(raw)))
        except ValueError:
            found += 1
            continue
        # nothing but the last bits of a block, which do not say more, can change unseen
        assert [d for d, _ in again] == [3, None, 9] and all((a == b).all() for (_, a), (_, b) in zip(docs, again, strict=True))
    assert found > 0.95 * len(raw)
    for size in (0, 3, len(raw) // 2, len(raw) - 1):
        with pytest.raises(ValueError):
            list(token_files.read_file(io.BytesIO(raw[:size]), size))


def test_groups_beyond_an_alphabet(monkeypatch):
    monkeypatch.setattr(range_coder, "ALPHABET", 100)
    ids = [(k, np.array(x, dtype=np.uint32)) for k, x in enumerate((range(700), [4_000_000_000, 5, 4_000_000_000], [], [7] * 50))]
    f = io.BytesIO()
    token_files.write_file(f, iter(ids))
    got = list(token_files.read_file(io.BytesIO(f.getvalue()), len(f.getvalue())))
    assert all(a == b and (x == y).all() for (a, x), (b, y) in zip(ids, got, strict=True))


def test_the_last_groups_are_alike(monkeypatch):
    """A small last group would have few blocks to run in step."""
    sizes, group = [], token_files.group_bytes
    monkeypatch.setattr(range_coder, "LANES", 4)
    monkeypatch.setattr(token_files, "group_bytes", lambda ids: sizes.append(len(ids)) or group(ids))
    for n, want in ((20, [10_000] * 2), (16, [16_000]), (45, [16_384, 16_384, 12_232]), (24, [12_000] * 2)):
        sizes.clear()
        docs, f = [(i, np.arange(i, i + 1000, dtype=np.uint32)) for i in range(n)], io.BytesIO()
        token_files.write_file(f, iter(docs))
        got = list(token_files.read_file(io.BytesIO(f.getvalue()), len(f.getvalue())))
        assert all(a == b and (x == y).all() for (a, x), (b, y) in zip(docs, got, strict=True))
        assert sizes == want


def test_steps_write_into_the_same_buffers():
    """The steps write into buffers: one object for each, however many steps there are."""
    model = range_coder._Model(3, 10, 4, False)
    slots = model.slots(np.zeros(3, np.int64), np.zeros(3, np.int64), np.empty((2, 3), np.int64))
    buffers = model.got, model.p, model.diff, model.starts, model.gaps, model.decision
    for _ in range(3):
        model.predict(slots)
        model.compare(np.array([8, 16, 0], np.int32))
        model.decision[:] = 2
        model.at4[:] = model.by4 + 2
        model.learn(np.array([8, 16, 0], np.int32))
    assert all(a is b for a, b in zip(buffers, (model.got, model.p, model.diff, model.starts, model.gaps, model.decision), strict=True))
    assert (model.tables.take(slots) >> 3 == [1, 2, 0]).all()


def test_plain_texts_are_found():
    some = [*texts(), "a\x00", "\ud800", "𝔘", "ɏ", "ɐ", "€", "\u2100", "tab\tnew\nline"]
    assert token_files.plain(some).tolist() == [token_files.PLAIN.fullmatch(t) is not None for t in some]
    assert token_files.plain([]).tolist() == []


def texts():
    rng = random.Random(1)
    some = ["".join(rng.choice("aB é'sstÉ12½,.\n…ſ日İΣς \x1c²") for _ in range(rng.randrange(0, 80))) for _ in range(300)]
    return [*some, "It's we'll DON'T Ünïcode, naïve — 12½…", "école", "word " * 20_000, "", "<|endoftext|>"]


def test_ids_are_the_library_s():
    library = Tokenizer.from_file(token_files.default_tokenizer())
    for text, got in zip(texts(), token_files.Tokens(token_files.default_tokenizer()).encode(texts()), strict=True):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_frequent_words_are_not_forgotten(monkeypatch):
    monkeypatch.setattr(token_files, "LEXICON", 1000)
    rng, tokens, learned = random.Random(3), token_files.Tokens(token_files.default_tokenizer()), []
    words = list({"".join(rng.choices("abcdefgh", k=9)): None for _ in range(1050)})
    a, b, c = words[:100], words[100:900], words[900:]
    learn = tokens._learn
    monkeypatch.setattr(tokens, "_learn", lambda some: learned.append(list(some)) or learn(some))
    for some in (a, a + b, c, a):
        text = " ".join(some)
        assert tokens.encode([text])[0].tolist() == tokens.library.encode(text, add_special_tokens=False).ids
    assert [len(x) for x in learned] == [len(a), len(b), len(c), 0]


def test_words_of_one_hash(monkeypatch):
    monkeypatch.setattr(token_files, "hash_array", lambda words, categorize: np.array([len(w) % 3 for w in words], dtype=np.uint64))
    tokens = token_files.Tokens(token_files.default_tokenizer())
    for _ in (1, 2):
        for text in ("one two three, four five. six, seven", "two one, seven 12 it's ten. über four"):
            assert tokens.encode([text])[0].tolist() == tokens.library.encode(text, add_special_tokens=False).ids


def test_write_and_read(spark, monkeypatch):
    library = Tokenizer.from_file(token_files.default_tokenizer())
    rows = [Row(doc_id=(i * 37) % 401, text=t, start="s") for i, t in enumerate([None, *texts()])]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    folder = new_path(spark, "test-ids")
    got = sorted(token_files.read(token_files.write(frame, folder), folder).collect())
    start, want = 0, []
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_null_and_repeated_ids(spark):
    """Nulls come first, and each row is a document of its own."""
    rows = [Row(doc_id=d, text=t, start=None) for d, t in ((5, "b"), (None, "a a"), (5, "b"), (None, None), (5, "c c c"), (2, ""))]
    folder = new_path(spark, "test-ids")
    got = token_files.read(token_files.write(spark.createDataFrame(rows, SCHEMA).repartition(2), folder), folder).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("2", 1), ("5", 2), ("5", 2), ("5", 4), ("None", 1), ("None", 3)]
    ends = [0]
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == ends[-1] and (r.doc_id is None) == (len(ends) <= 2)
        ends.append(r.start + r.n_tokens)


def test_files_of_lost_attempts_are_not_read(spark):
    folder = new_path(spark, "test-ids")
    manifest = token_files.write(spark.createDataFrame([Row(doc_id=1, text="one", start="")], SCHEMA), folder)
    system, root = token_files._open(folder)
    with system.open_output_stream(f"{root}/part-00000-lost.ids") as f:
        f.write(b"half a file")
    assert [r.n_tokens for r in token_files.read(manifest, folder).collect()] == [2]


def test_empty(spark):
    folder = new_path(spark, "test-ids")
    empty = spark.createDataFrame([], SCHEMA)
    assert token_files.read(token_files.write(empty, folder), folder).count() == 0
