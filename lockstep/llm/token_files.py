"""Token-id files: whole texts as ids in ascending doc_id order, range-coded in checksummed blocks.

File: magic, then groups, then a footer.  A group holds the sorted distinct ids of its blocks (its alphabet), the id
count, payload size and CRC-32 of ids of each block, and the payloads of `range_coder`.  Any block can be decoded with
its group's alphabet alone.  The footer has the documents (doc_id, ids), and its own size and CRC-32 are the last bytes.

Writing: rows are range-partitioned and sorted by doc_id; each task tokenises its texts and writes one file under a name
of its own attempt in the shared folder.  The manifest, a table that Spark commits, names the files of the attempts that
count; no file is renamed, and what lost attempts leave is read by nobody and goes with the folder.  Memory is bounded by
one and a half groups (of range_coder.LANES blocks), TEXTS texts or TEXT_BYTES of them, and 16 bytes a document of the task for the footer.
Reading: a task a file, a group at a time; damage of any kind is a ValueError.

Tokenising is the library's.  Texts of plain Latin characters, where lower-casing and splitting are beyond doubt the
same and that hold no special token, are split here at white space, and only what is new of their parts goes to the
library, many at once (the end of a word shows in its last id); all other texts go to it whole.

Cases.  Null and empty texts are the end id alone.  Null doc_ids come first, repeated ones in any order.  Empty tables
write no file and give empty results.  Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import range_coder
from .common import new_path, slices, stored, table

MAGIC = b"LKSTID3\n"
END_ID = 1
TEXTS, TEXT_BYTES = 2000, 6 << 20  # that are tokenised at once: the more, the fewer times a word is looked up
LEXICON = 1_500_000  # words that a worker remembers, at some 45 bytes
#: The tokenizer file's own split pattern, as it reads on PLAIN texts; what it leaves out is white space.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
SPLIT_ENDS = re.compile(SPLIT.pattern + "| ")  # of parts that each end with a space
#: Latin letters, digits, punctuation; not the superscripts and fractions, which `re` takes for letters.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞€]*+")
_IS_PLAIN = np.array([PLAIN.fullmatch(chr(c)) is not None for c in range(0x2100)])


def plain(texts: list[str]) -> np.ndarray:
    """Whether each text has PLAIN characters alone."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    bad = np.flatnonzero(~_IS_PLAIN.take(codes, mode="clip"))  # the last entry is none of them
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    out = np.ones(len(texts), dtype=bool)
    out[np.searchsorted(ends, bad, side="right")] = False
    return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Lexicon:
    """Words and their ids in arrays, found by a hash of the word and then compared.  Where two words have one hash, the later
    one is not found, and is learned again."""

    def __init__(self, kind: np.dtype):
        self.words = pa.array([], pa.string())
        self.ids, self.starts = np.empty(0, kind), np.zeros(1, np.int32)  # row i: ids[starts[i]:starts[i + 1]]
        self.used, self.turn = np.empty(0, np.int32), 0  # the turn in which a row was last asked for
        self.hashes, self.rows = np.empty(0, np.uint64), np.empty(0, np.int32)  # by rising hash

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: pa.StringArray) -> np.ndarray:
        """The rows of words, -1 for those that are not known."""
        out = np.full(len(words), -1, dtype=np.int64)
        if len(self) and len(words):
            hashes = hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
            order = np.argsort(hashes)
            at = np.minimum(np.searchsorted(self.hashes, hashes[order]), len(self) - 1)
            hit = self.hashes[at] == hashes[order]
            place, rows = order[hit], self.rows[at[hit]]
            same = pc.equal(self.words.take(pa.array(rows)), words.take(pa.array(place))).to_numpy(zero_copy_only=False)
            out[place[same]] = rows[same]
            self.used[rows[same]] = self.turn
        return out

    def add(self, words: pa.StringArray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New words, their ids one after the other, and how many each has; returns their rows."""
        rows = np.arange(len(self), len(self) + len(words))
        if len(words):
            self.starts = np.concatenate([self.starts, (self.starts[-1] + np.cumsum(sizes)).astype(np.int32)])
            self.ids, self.words = np.concatenate([self.ids, ids.astype(self.ids.dtype)]), pa.concat_arrays([self.words, words])
            self.used = np.concatenate([self.used, np.full(len(words), self.turn, np.int32)])
            hashes = hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
            order = np.argsort(hashes)
            at = np.searchsorted(self.hashes, hashes[order], side="right")
            self.hashes, self.rows = np.insert(self.hashes, at, hashes[order]), np.insert(self.rows, at, rows[order])
        return rows

    def ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows one after the other, and how many each has."""
        starts = self.starts[rows]
        sizes = (self.starts[rows + 1] - starts).astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((starts - ends + sizes).astype(np.int32), sizes)
        at += np.arange(total, dtype=np.int32)
        return self.ids[at], sizes

    def forget(self, most: int) -> None:
        """Keeps `most` words, those that were asked for last."""
        if len(self) > most:
            kept = np.sort(np.argsort(-self.used, kind="stable")[:most])
            used, turn, words, (ids, sizes) = self.used[kept], self.turn, self.words.take(pa.array(kept)), self.ids_of(kept)
            self.__init__(self.ids.dtype)
            self.add(words, ids, sizes)
            self.used, self.turn = used, turn


class Tokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.library.model)  # the merges alone, for words that are split and normalised already
        self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.added = [str(t).lower() for t in self.library.get_added_tokens_decoder().values()]
        words = self.library.get_vocab()
        self.size = max(words.values(), default=0) + 1
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.lexicon = Lexicon(self.kind)
        probe = "It's a Test, naïve-ÉCOLE 12 don't_x…"
        self.splits = self._same_bytes() and [w for w in SPLIT.findall(probe.lower())] == [
            unicodedata.normalize("NFC", probe.lower())[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(probe.lower())
        ]

    def _same_bytes(self) -> bool:
        """Whether the library's pre-tokenizer shows words of ASCII letters, digits and punctuation as they are."""
        plain = "".join(map(chr, range(0x21, 0x7F)))
        return "".join(w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)) == plain

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (each one match of SPLIT; those of ASCII come first), one after the other, and how many each has:
        many words in one call where each one's last id, and no other, is one that ends a word."""
        found, sizes, ascii_ = [], [], sum(map(str.isascii, words))
        for at in chain(range(0, ascii_, 128), range(ascii_, len(words), 128)):
            tokenizer, end = (self.pieces, ascii_) if at < ascii_ else (self.library, len(words))
            group = words[at : min(at + 128, end)]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                found.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                each = [np.array(e.ids, dtype=self.kind) for e in self.library.encode_batch_fast(group, add_special_tokens=False)]
                found += each
                sizes.append(np.array([len(x) for x in each]))
        return np.concatenate([np.empty(0, self.kind), *found]), np.concatenate([np.empty(0, np.int64), *sizes])

    def _rows(self, parts: pa.StringArray) -> np.ndarray:
        """The lexicon's rows of distinct parts of texts; what is new is learned."""
        lexicon = self.lexicon
        lexicon.turn += 1
        if len(lexicon) > LEXICON:
            lexicon.forget(LEXICON // 2)
        rows = lexicon.find(parts)
        new = np.flatnonzero(rows < 0)
        fresh = parts.take(pa.array(new))
        whole = np.fromiter(map(str.isalpha, fresh.to_pylist()), bool, len(new))
        fresh, new = pa.concat_arrays([fresh.filter(pa.array(whole)), fresh.filter(pa.array(~whole))]), np.concatenate([new[whole], new[~whole]])
        alone = int(whole.sum())  # they come first
        # one list of strings for all: as many lists as parts would keep the garbage collector busy
        found = pa.array(SPLIT_ENDS.findall("".join([p + " " for p in fresh[alone:].to_pylist()])), pa.string())
        end = pc.equal(found, " ").to_numpy(zero_copy_only=False)
        counts = np.concatenate([np.ones(alone, np.int64), np.diff(np.flatnonzero(end), prepend=-1) - 1])
        words = pa.concat_arrays([fresh[:alone], found.filter(pa.array(~end))]).dictionary_encode()
        known = lexicon.find(words.dictionary)
        missing = np.flatnonzero(known < 0)
        unknown = words.dictionary.take(pa.array(missing)).to_pylist()
        order = np.argsort([not w.isascii() for w in unknown], kind="stable")  # as _learn wants them
        missing, unknown = missing[order], [unknown[i] for i in order]
        known[missing] = lexicon.add(pa.array(unknown, pa.string()), *self._learn(unknown))
        word = known[words.indices.to_numpy()]
        one = counts == 1
        begin = np.cumsum(counts) - counts
        rows[new[one]] = word[begin[one]]
        if not one.all():
            ids, sizes = lexicon.ids_of(word[np.repeat(~one, counts)])
            ends, cuts = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(counts[~one])])
            rows[new[~one]] = lexicon.add(fresh.filter(pa.array(~one)), ids, np.diff(ends[cuts]))
        return rows

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of lower-cased texts of PLAIN characters."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        parts = split.flatten().dictionary_encode()
        ids, sizes = self.lexicon.ids_of(self._rows(parts.dictionary)[parts.indices.to_numpy()])
        ids = ids.astype(np.uint32)
        ends = np.zeros(len(sizes) + 1, dtype=np.int64)
        np.cumsum(sizes, out=ends[1:])
        cuts = ends[split.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        lower = [t.lower() for t in texts]
        some = np.flatnonzero(plain(texts)).tolist() if self.splits else []
        for a in self.added:
            some = [i for i in some if a not in lower[i]]
        some = [i for i in some if unicodedata.is_normalized("NFC", texts[i])]
        for i, ids in zip(some, self._plain([lower[i] for i in some]), strict=True):
            out[i] = ids
        seen = set(some)
        rest = [i for i in range(len(texts)) if i not in seen]
        for i, e in zip(rest, self.library.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype=np.uint32)
        return out


@lru_cache(maxsize=2)
def loaded(path: str) -> Tokens:
    return Tokens(path)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _packed(data: bytes) -> bytes:
    data = zlib.compress(data, 6)
    return struct.pack("<II", len(data), zlib.crc32(data)) + data


def _unpacked(f) -> bytes:
    size, crc = struct.unpack("<II", f.read(8))
    data = f.read(size)
    if zlib.crc32(data) != crc:
        raise ValueError("damaged section")
    return zlib.decompress(data)


SPREAD = 1000  # times as many numbers as ids: then they are sorted instead of counted


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and each id's place among them."""
    times = np.bincount(ids)
    alphabet = np.flatnonzero(times)
    place = np.zeros(len(times), dtype=np.uint32)
    place[alphabet] = np.arange(len(alphabet))
    return alphabet, place[ids]


def group_bytes(ids: np.ndarray) -> bytes:
    """One group of at most LANES x BLOCK ids, or several if they have more distinct ids than an alphabet can.  A short group
    has shorter blocks, so that it has many of them still."""
    length = max(2048, min(range_coder.BLOCK, -(-len(ids) // range_coder.LANES)))
    alphabet, dense = np.unique(ids, return_inverse=True) if ids.max() > SPREAD * len(ids) else _places(ids)
    if len(alphabet) > range_coder.ALPHABET:
        return group_bytes(ids[: len(ids) // 2]) + group_bytes(ids[len(ids) // 2 :])
    blocks = [dense[a : a + length] for a in range(0, len(ids), length)]
    payloads = range_coder.encode(blocks, len(alphabet))
    table = [(len(b), len(p), zlib.crc32(ids[a : a + length].astype("<u4", copy=False))) for a, b, p in zip(range(0, len(ids), length), blocks, payloads, strict=True)]
    head = alphabet.astype("<u4").tobytes() + np.array(table, dtype="<u4").tobytes()
    return struct.pack("<III", 1, len(alphabet), len(blocks)) + _packed(head) + b"".join(payloads)


def read_group(f) -> np.ndarray | None:
    """The ids of the next group, checked; None at the footer."""
    kind, letters, blocks = struct.unpack("<III", f.read(12))
    if kind != 1:
        return None
    head = np.frombuffer(_unpacked(f), dtype="<u4")
    alphabet, rows = head[:letters], head[letters:].reshape(blocks, 3).tolist()
    payloads = [f.read(size) for _, size, _ in rows]
    found = range_coder.decode(payloads, [n for n, _, _ in rows], letters)
    for ids, (_, _, crc) in zip(found, rows, strict=True):
        ids[:] = alphabet[ids]
        if zlib.crc32(ids.astype("<u4", copy=False)) != crc:
            raise ValueError("damaged block")
    return np.concatenate(found)


def write_file(f, docs: Iterator[tuple[int | None, np.ndarray]]) -> tuple[int, int]:
    """Writes the documents' ids; returns (documents, ids)."""
    f.write(MAGIC)
    limit = range_coder.LANES * range_coder.BLOCK // 2
    most = limit + limit // 2
    names, sizes, flags, held, n = array("q"), array("q"), bytearray(), [], 0

    def flush(all_: bool) -> None:
        nonlocal held, n
        ids = np.concatenate(held) if held else np.empty(0, np.uint32)
        at = 0
        while len(ids) - at >= most:
            f.write(group_bytes(ids[at : at + limit]))
            at += limit
        if all_ and at < len(ids):  # one group, or two alike: a small one has few lanes, which costs more time an id
            size = -(-(len(ids) - at) // (1 + (len(ids) - at > limit)))
            while at < len(ids):
                f.write(group_bytes(ids[at : at + size]))
                at += size
        held = [ids[at:]] if at < len(ids) else []
        n = sum(map(len, held))

    for name, ids in docs:
        names.append(name or 0)
        sizes.append(len(ids))
        flags.append(name is None)
        held.append(ids)
        n += len(ids)
        if n >= most:
            flush(False)
    flush(True)
    footer = _packed(np.array([names, sizes], dtype="<i8").tobytes() + bytes(flags))
    f.write(struct.pack("<III", 2, len(names), 0) + footer + struct.pack("<I", len(footer) + 12))
    return len(names), sum(sizes)


def read_file(f, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) in the file's order."""
    try:
        yield from _read_file(f, size)
    except (struct.error, zlib.error, IndexError, ValueError, TypeError, OverflowError, MemoryError, OSError) as e:
        raise ValueError("damaged token-id file") from e


def _read_file(f, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    f.seek(size - 4)
    f.seek(size - 4 - struct.unpack("<I", f.read(4))[0])
    _, n, _ = struct.unpack("<III", f.read(12))
    footer = _unpacked(f)
    names, sizes = np.frombuffer(footer[: 16 * n], dtype="<i8").reshape(2, n).tolist() if n else ([], [])
    flags = footer[16 * n :]
    f.seek(0)
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id file")
    held, at = np.empty(0, np.uint32), 0
    for name, count, none in zip(names, sizes, flags, strict=True):
        while len(held) - at < count:
            more = read_group(f)
            held, at = np.concatenate([held[at:], more]), 0
        yield (None if none else name), held[at : at + count]
        at += count


def _writer(folder: str, tokenizer: str):
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        tokens = loaded(tokenizer)
        for batch in slices(batches, TEXTS, TEXT_BYTES):
            ids = tokens.encode([t or "" for t in batch.column("text").to_pylist()])
            for name, some in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                yield name, np.append(some, np.uint32(END_ID))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{part:05d}-{uuid.uuid4().hex}.ids"
        with system.open_output_stream(f"{root}/{name}") as f:
            docs, ids = write_file(f, documents(chain([first], batches)))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([ids], pa.int64())], ["part", "name", "docs", "ids"])

    return run


def write(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Writes a file a part into the folder; returns part, name, docs, ids of each.  doc_ids must be integers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(1, rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return stored(ordered.mapInArrow(_writer(folder, tokenizer or default_tokenizer()), "part long, name string, docs long, ids long"), "token-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the files."""
    spark = manifest.sparkSession
    files, total = [], 0
    for name, n in manifest.orderBy("part").select("name", "ids").collect():  # a row a file
        files.append((name, total))
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for i in (i for b in batches for i in b.column(0).to_pylist()):
            (name, start), rows = files[i], []
            with system.open_input_file(f"{root}/{name}") as f:
                for name, ids in read_file(f, f.size()):
                    rows.append((name, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False))))
                    start += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_range_coded_ids(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-ids")
    return read(write(table(spark, sf_dir, "documents"), folder), folder)
