"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers (in digits or words), units (behind a number) and names (capitalised, not at the start
of a sentence; several in a row are one name) become typed placeholders that keep their value as a slot; all others are
lower-cased and stripped of punctuation.  Characters of scripts that set no spaces are tokens of their own.  A capitalised
word at the start of a sentence is read twice, as a word and as a name: in a document any of them, in an item those that are
a name elsewhere in it or do not occur in lower case.  Windows of the second reading come beside those of the first, and
count unless their slots disagree.  Windows of WINDOW tokens are
hash-joined between documents and benchmark items; a window that is more than half placeholders says too little as a
template and is taken with its values.  Matches on one diagonal (document place less item place) must agree on their
slots: a value of the item stands for the same value of the document everywhere, and the other way round, so that a
question with other numbers or names is found and a chance mixture is not.  A document holds an item if matched windows
cover at least COVER of the item's tokens.

An item of fewer than WINDOW tokens is one window, with its values.  If it has fewer than SHORT characters, it is found
only in a document that has no other tokens, since anywhere else it cannot be told from chance.

Scale.  A document is read once and yields only windows that the benchmark has; the vocabulary and window hashes of
the benchmark go to the tasks if its windows take at most BROADCAST_BYTES, else all windows of all documents are joined
by hash.  Groups are a document and an item, each bounded by the item's length.

Cases.  Items without id are not looked for.  Null texts have no tokens.  Rows that share doc_id and text are one
document; null doc_ids are allowed.  Empty tables, documents or benchmark, give empty results.  Other columns are kept by
`without_leaks` and ignored by `leaks`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, slices, stored, table, unpacked

WINDOW = 5
COVER = 0.8
SHORT = 16
BROADCAST_BYTES = 32 << 20
MEMO = 300_000  # words that a task remembers, and those of one text more

NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
GLUED = re.compile(r"([+-]?\d[\d.,]*)([a-zµ°]{1,4})")
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds "
    "ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours "
    "day days week weeks month months year years euro euros dollar dollars cent cents percent kmh mph kw kwh w v a hz khz mhz ghz kb mb gb tb "
    "degree degrees c f k mol pa kpa bar j kj cal kcal".split()
)
NUMBER_WORDS = frozenset(
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
STRIP = ".,;:!?\"'()[]{}<>«»„“”‘’…*#%$&-–—_/\\"
WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
END = (".", "!", "?", ":", ";", ".\"", "!\"", "?\"")

#: What a word is, whatever stands around it: the token's hash (0: not of the benchmark) and these flags.
CAPITAL, STOP, NUMERIC, UNIT, EMPTY, UNKNOWN = 1, 2, 4, 8, 16, 32


def token_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 1) | 1


NUM_T, UNIT_T, NAME_T = (np.uint64(token_hash(t)) for t in ("<num>", "<unit>", "<name>"))


def classify(word: str) -> tuple[str, int]:
    """(bare lower-case form, flags) of a word between white space."""
    stop = STOP if word.endswith(END) else 0
    bare = word.strip(STRIP)
    if not bare:
        return "", stop
    if bare[0].isdigit() or bare[0] in "+-":
        if NUMBER.fullmatch(bare) or GLUED.fullmatch(bare):
            return bare.lower(), stop | NUMERIC
    low = bare.lower()
    if low in NUMBER_WORDS:
        return low, stop | NUMERIC
    flags = stop | (UNIT if low in UNITS else 0)
    if bare[0].isupper() and (len(bare) == 1 or not bare.isupper()):
        flags |= CAPITAL
    return low, flags


class Templates:
    """Turns texts into token hashes.  vocabulary: the only words that matter, or None for all."""

    def __init__(self, vocabulary: frozenset[str] | None = None):
        self.vocabulary = vocabulary
        self.rows: dict[str, int] = {}  # of the words that were seen; those outside of the vocabulary share rows by flags
        self.shared: dict[int, int] = {}
        self.used, self.hashes, self.flags = 0, np.zeros(1024, dtype=np.uint64), np.zeros(1024, dtype=np.uint8)

    def _row(self, h: int, flags: int) -> int:
        row, self.used = self.used, self.used + 1
        if row == len(self.flags):
            self.hashes, self.flags = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.flags))
        self.hashes[row], self.flags[row] = h, flags
        return row

    def _look(self, word: str) -> int:
        if word.islower() and word.isalpha():
            low, flags = word, NUMERIC if word in NUMBER_WORDS else UNIT if word in UNITS else 0
        else:
            low, flags = classify(word)
            flags |= 0 if low else EMPTY
        if self.vocabulary is None or low in self.vocabulary:
            row = self._row(token_hash(low) if low else 0, flags)
        else:
            flags |= UNKNOWN
            row = self.shared.get(flags)
            if row is None:
                row = self.shared[flags] = self._row(0, flags)
        self.rows[word] = row
        return row

    def _known(self, words: list[str]) -> np.ndarray:
        """The rows of words; all others may be forgotten before.  Each different word is looked up once."""
        if len(self.rows) > MEMO:
            self.rows.clear()
            self.shared.clear()
            self.used = 0
        found = pa.array(words, pa.string()).dictionary_encode()
        different = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = list(map(self.rows.get, different))
        if None in rows:
            rows = [self._look(w) if r is None else r for r, w in zip(rows, different, strict=True)]
        return np.array(rows, dtype=np.int64)[found.indices.to_numpy()] if rows else np.empty(0, np.int64)

    def read(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """The words of each text, and their rows, for `tokens`."""
        split = [(WIDE.sub(r" \g<0> ", t) if not t.isascii() and WIDE.search(t) else t).split() for t in texts]
        rows = self._known(list(chain.from_iterable(split)))
        ends = list(accumulate(map(len, split), initial=0))
        return [(words, rows[a:b]) for words, a, b in zip(split, ends, ends[1:], strict=False)]

    def tokens(self, words: list[str], rows: np.ndarray, item: bool = False) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words, template hashes, hashes with their values, whether each is a placeholder, whether each could be a name at
        the start of a sentence); hashes are 0 for what the vocabulary lacks.  Words without letters or digits are left
        out."""
        if not words:
            return [], np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, bool)
        h, flags = self.hashes[rows], self.flags[rows]
        kept = flags & EMPTY == 0
        ends = np.concatenate(([True], (flags[:-1] & STOP) > 0))
        if not kept.all():
            at = np.flatnonzero(kept)
            # a stop anywhere since the last kept word starts a sentence
            since = np.cumsum(ends)
            ends = np.diff(np.concatenate(([0], since[at]))) > 0
            h, flags, words = h[at], flags[at], [words[i] for i in at]
        number = flags & NUMERIC > 0
        unit = (flags & UNIT > 0) & np.concatenate(([False], number[:-1]))[: len(number)]
        name = (flags & CAPITAL > 0) & ~ends & ~unit & ~number
        slot = number | unit | name
        start = (flags & CAPITAL > 0) & ends & ~unit & ~number
        start[:-1] &= ~name[1:]  # the first of several words would make one token of them
        if item and start.any():
            start &= np.isin(h, h[name]) | ~np.isin(h, h[flags & CAPITAL == 0])
        again = name[1:] & name[:-1]
        if again.any():  # names of several words
            starts = np.flatnonzero(np.concatenate(([True], ~again)))
            stops = np.append(starts[1:], len(words)).tolist()
            for a, b in zip(starts.tolist(), stops, strict=True):
                if b - a > 1:
                    words[a] = " ".join(w.strip(STRIP) for w in words[a:b])
                    h[a] = 0 if not h[a:b].all() else np.bitwise_xor.reduce(h[a:b] * np.arange(1, 2 * (b - a), 2, dtype=np.uint64))
            words, h, slot, number, unit, name, start = [words[i] for i in starts], h[starts], slot[starts], number[starts], unit[starts], name[starts], start[starts]
        return words, np.where(number, NUM_T, np.where(unit, UNIT_T, np.where(name, NAME_T, h))), h, slot, start

    def windows(self, words: list[str], rows: np.ndarray, sizes: tuple[int, ...] = (WINDOW,), item: bool = False) -> tuple[list[str], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(words, placeholder flags in either reading, places, sizes, readings, window hashes, tokens): of windows of known
        tokens.  sizes: the lengths of windows; those below WINDOW are taken with their values."""
        words, h, own, slot, start = self.tokens(words, rows, item)
        second = slot | start
        places, lengths, readings, values = [], [], [], []

        def add(at: np.ndarray, size: int, reading: int, plain: np.ndarray, template: np.ndarray) -> None:
            value = np.where(plain, np.uint64(0), np.uint64(size))
            for i in range(size):
                value = (value ^ np.where(plain, template[at + i], own[at + i])) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
            places.append(at)
            lengths.append(np.full(len(at), size))
            readings.append(np.full(len(at), reading, dtype=bool))
            values.append(value)

        for size in sizes:
            if len(h) < size:
                continue
            total = lambda x: (c := np.concatenate(([0], np.cumsum(x))))[size:] - c[:-size]  # noqa: B023, E731
            as_template = (total(slot) * 2 <= size) & (size == WINDOW)
            at = np.flatnonzero(np.where(as_template, total(h == 0), total(own == 0)) == 0)
            add(at, size, 0, as_template[at], h)
            if size == WINDOW and start.any():
                names = np.where(start, NAME_T, h)
                at = np.flatnonzero((total(start) > 0) & (total(names == 0) == 0) & (total(second) * 2 <= size))
                if len(at):
                    add(at, size, 1, np.ones(len(at), dtype=bool), names)
        if not places:
            return words, [slot, second], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.uint64), len(h)
        return words, [slot, second], *(np.concatenate(x) for x in (places, lengths, readings, values)), len(h)


def _values(words: list[str], slot: np.ndarray, at: int, size: int) -> list[str]:
    return [words[at + i].strip(STRIP).lower() for i in np.flatnonzero(slot[at : at + size]).tolist()]


COLUMNS = "place int, size int, second boolean, window long, slots array<string>, tokens int, chars int"


def _window_rows(known: np.ndarray | None, vocabulary: frozenset[str] | None, sizes: tuple[int, ...] | None, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(vocabulary)
        for batch in slices(batches):
            rows, places, lengths, seconds, hashes, slots, counts, chars = [], [], [], [], [], [], [], []
            for i, text in enumerate(templates.read([t or "" for t in batch.column("text").to_pylist()])):
                if sizes is None:  # an item: windows, or itself
                    n = len(templates.tokens(*text)[0])
                    words, slot, at, length, reading, value, n = templates.windows(*text, (min(n, WINDOW),) if n else (), True)
                else:
                    words, slot, at, length, reading, value, n = templates.windows(*text, sizes)
                if known is not None and len(value):
                    hit = known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value
                    at, length, reading, value = at[hit], length[hit], reading[hit], value[hit]
                rows += [i] * len(at)
                places += at.tolist()
                lengths += length.tolist()
                seconds += reading.tolist()
                hashes.append(value)
                slots += [_values(words, slot[r], p, k) for p, k, r in zip(at.tolist(), length.tolist(), reading.tolist(), strict=True)]
                counts += [n] * len(at)
                if sizes is None:
                    chars += [sum(len(w.strip(STRIP)) for w in words)] * len(at)
            value = np.concatenate(hashes).view(np.int64) if hashes else np.empty(0, np.int64)
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keep]
            ints = [pa.array(x, pa.int32()) for x in (places, lengths, counts, chars or [0] * len(rows))]
            yield pa.RecordBatch.from_arrays([*kept, ints[0], ints[1], pa.array(seconds, pa.bool_()), pa.array(value), pa.array(slots, pa.list_(pa.string())), ints[2], ints[3]], [*keep, "place", "size", "second", "window", "slots", "tokens", "chars"])

    return run


def windows(rows: DataFrame, keep: list[str], known: np.ndarray | None = None, vocabulary: frozenset[str] | None = None, sizes: tuple[int, ...] | None = None) -> DataFrame:
    """The windows of each text: of benchmark items where sizes is None, else of documents."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), COLUMNS])
    return rows.select(*keep, "text").mapInArrow(_window_rows(known, vocabulary, sizes, keep), schema)


def _vocabulary(benchmark: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = {low for t in batch.column("text") for w in WIDE.sub(r" \g<0> ", t.as_py() or "").split() if (low := classify(w)[0])}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["token"])

    return benchmark.select("text").mapInArrow(run, "token string").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, extra: tuple[str, ...] = (), limit: int = BROADCAST_BYTES) -> DataFrame:
    """A row for each document and item it holds: doc_id, (extra), item_id, coverage, n_windows, same_values (whether
    all slots have the item's own values)."""
    items = stored(windows(benchmark.where("item_id is not null"), ["item_id"]), "bench-windows")
    weight = F.lit(60) + F.aggregate("slots", F.lit(0), lambda n, v: n + F.octet_length(v) + 16)
    about = items.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("bytes"), F.collect_set("size").alias("sizes")).head()  # sizes: WINDOW at most
    sizes = tuple(sorted(about.sizes, reverse=True)) or (WINDOW,)
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    if about.bytes <= limit:
        known = np.unique(np.array([r[0] for r in items.select("window").distinct().collect()], dtype=np.int64).view(np.uint64))
        if not len(known):
            known = np.zeros(1, np.uint64)
        words = frozenset(r[0] for r in _vocabulary(benchmark).collect())  # those of the windows, which take less than the limit
        found = windows(rows, ["doc_id", "mark"], known, words, sizes)
        side = F.broadcast(items)
    else:
        found, side = windows(rows, ["doc_id", "mark"], sizes=sizes), items
    side = side.select("item_id", F.col("place").alias("item_place"), F.col("second").alias("item_second"), "window", "size", F.col("slots").alias("item_slots"), F.col("tokens").alias("item_tokens"), F.col("chars").alias("item_chars"))
    match = found.drop("chars").join(side, ["window", "size"]).where(F.size("slots") == F.size("item_slots"))
    match = match.where((F.col("item_tokens") >= WINDOW) | (F.col("item_chars") >= SHORT) | (F.col("tokens") == F.col("item_tokens")))
    pair = F.zip_with("slots", "item_slots", lambda d, i: F.struct(i.alias("i"), d.alias("d")))
    first = ~F.col("second") & ~F.col("item_second")
    gather = lambda x, when=None: F.collect_set(x if when is None else F.when(when, x))
    at, of = F.struct("item_place", "size"), lambda pairs: F.array_distinct(F.flatten(pairs))
    lines = match.groupBy("doc_id", "mark", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal")).agg(
        gather(at).alias("places"), of(gather(pair)).alias("pairs"), gather(at, first).alias("first_places"), of(gather(pair, first)).alias("first_pairs"), F.max("item_tokens").alias("tokens")
    )
    one = lambda pairs, side: F.size(F.array_distinct(F.transform(pairs, lambda p: p[side]))) == F.size(pairs)
    agree = lambda pairs: one(pairs, "i") & one(pairs, "d")
    both = agree("pairs")  # else the first reading alone
    lines = lines.where(both | (agree("first_pairs") & (F.size("first_places") > 0)))
    lines = lines.select("doc_id", "mark", "item_id", "tokens", *[F.when(both, F.col(c)).otherwise(F.col(f"first_{c}")).alias(c) for c in ("places", "pairs")])
    held = lines.groupBy("doc_id", "mark", "item_id").agg(
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"), F.max("tokens").alias("tokens"), F.min(F.forall("pairs", lambda p: p["i"] == p["d"])).alias("same_values")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["item_place"], p["item_place"] + p["size"] - 1)))))
    held = held.select("doc_id", "mark", "item_id", F.round(covered / F.col("tokens"), 6).alias("coverage"), F.size("places").alias("n_windows"), "same_values")
    return held.where(F.col("coverage") >= COVER).select("doc_id", *extra, "item_id", "coverage", "n_windows", "same_values")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs that hold no benchmark item; all columns."""
    bad = stored(leaks(docs, benchmark, ("mark",)).select("doc_id", "mark").distinct(), "leaks")
    rows = packed(docs).select("row", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("text_mark"))
    return unpacked(rows.join(bad, rows["id"].eqNullSafe(bad["doc_id"]) & (rows["text_mark"] == bad["mark"]), "left_anti").select("row"))


def op1_template_leaks(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
