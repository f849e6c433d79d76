"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The library's byte-fallback BPE model is used as it is (identity normalisation, a dummy prefix, no white space removed).
A text is cut into marked words: `▁` and what follows up to the next mark; no piece spans two of them.  The distinct
words of a batch that are not yet known are sorted, which is a depth-first walk through their trie, and encoded by a
forward pass over prefixes: each prefix keeps the piece that ends its best segmentation, and a word starts from the
states of the prefix that it shares with the word before.  A BPE model has no path scores that add up; here the
transition from piece a to piece b is allowed if merging a+b on its own gives a, b again, and forbidden otherwise.  A
sequence of pieces is the merge result exactly if all its transitions are allowed, so that the one allowed path is what
the library returns (tests compare them).  Words with several marks (runs of spaces) go through the merges directly.

Bounds.  Known words are kept per worker, MEMO bytes in each of two generations; a batch is at most common.ROWS texts, or one long one.  No shuffle is needed.

Cases.  Null and empty texts have no ids.  Characters outside the vocabulary become byte pieces.  A text's own `▁` is
taken as a space, as the library does, so that decoding gives the space back.  Repeated rows are rows like any other,
empty tables give empty results, other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, slices, table

MARK = "▁"
MEMO = 25 << 20  # bytes
TRANSITIONS = 200_000
WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
UNKNOWN = -1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids, self.scores, self.bytes = {}, {}, {}
        self.table: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            raw = b""
            if model.is_byte(i):
                raw = bytes([int(piece[3:-1], 16)])
                self.bytes[raw[0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                raw = piece.encode()
            self.table.append(raw)
        order = sorted((p for p in self.ids if len(p) > 1 and p.strip(MARK)), key=self.scores.__getitem__, reverse=True)
        self.names = {i: p for p, i in self.ids.items()}
        self.rank = {self.ids[p]: r for r, p in enumerate(order)}  # when merges make a piece; single characters are there from the start
        self.longest = max(map(len, order))
        self.halves: dict[int, tuple[int, int]] = {}
        self.allowed: dict[int, bool] = {}
        self.memo = Memo(MEMO)

    def merged(self, word: str, whole: bool = True) -> list[str]:
        """The merges themselves: the best-scored pair first, the leftmost of equal ones.  whole: the last may make
        the word itself."""
        symbols = list(word)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int, j: int) -> None:
            if i < 0 or j >= len(symbols):
                return
            s = self.scores.get(symbols[i] + symbols[j])
            if s is not None and (whole or len(symbols[i] + symbols[j]) < len(symbols)):
                heapq.heappush(heap, (-s, i, symbols[i], symbols[j]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, ""
            after[i] = after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s]

    def _half(self, piece: int) -> tuple[int, int]:
        """The two pieces whose merge makes this one."""
        found = self.halves.get(piece)
        if found is None:
            a, b = self.merged(self.names[piece], whole=False)
            found = self.halves[piece] = (self.ids[a], self.ids[b])
        return found

    def _fits(self, a: int, b: int) -> bool:
        """Whether the merges of a+b leave a, b.  Backwards in time: whichever of the two was made last is taken apart
        again; at no time may the pieces at the border have had a merge that came before the later one's making."""
        key = a << 20 | b
        found = self.allowed.get(key)
        if found is not None:
            return found
        if len(self.allowed) > TRANSITIONS:
            self.allowed.clear()
        ids, names, rank = self.ids, self.names, self.rank
        until = 1 << 30
        while True:
            both = ids.get(names[a] + names[b])
            if both is not None and rank.get(both, until) < until:
                found = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                found = True
                break
            if ra > rb:  # of equal merges the left one is first
                until, a = ra, self._half(a)[1]
            else:
                until, b = rb + 1, self._half(b)[0]
        self.allowed[key] = found
        return found

    def _ids_of(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out.extend(self.bytes[b] for b in p.encode("utf-8", "surrogatepass"))
        return array("i", out).tobytes()

    def learn(self, words: set[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of the words: one walk through the trie of the sorted words."""
        get, longest, fits, allowed = self.ids.get, self.longest, self._fits, self.allowed
        starts, ends = [0], [UNKNOWN]  # of the final piece of the prefix of j characters: where it starts, its id
        previous = ""
        for word in sorted(words):
            if word[:2] == MARK * 2 or word == "\n":
                yield word, self._ids_of(self.merged(word))
                continue
            shared = 0
            for a, b in zip(previous, word):
                if a != b:
                    break
                shared += 1
            del starts[shared + 1 :], ends[shared + 1 :]
            for j in range(shared + 1, len(word) + 1):
                for i in range(j - 1, j - longest - 1 if j > longest else -1, -1):
                    piece = get(word[i:j], UNKNOWN)
                    if piece < 0 and i < j - 1:
                        continue
                    before = ends[i]
                    if before < 0 or piece < 0 or (ok := allowed.get(before << 20 | piece)) or (ok is None and fits(before, piece)):
                        starts.append(i)
                        ends.append(piece)
                        break
            out, j = [], len(word)
            while j:
                piece, i = ends[j], starts[j]
                if piece >= 0:
                    out.append(piece)
                else:
                    out.extend(self.bytes[x] for x in word[i:j].encode("utf-8", "surrogatepass")[::-1])
                j = i
            yield word, array("i", out[::-1]).tobytes()
            previous = word

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.memo.turn()
        self.memo.put(self.learn(self.memo.missing(set(chain.from_iterable(cut)))))
        look = self.memo.new.__getitem__
        return [np.frombuffer(b"".join(map(look, words)), np.int32) for words in cut]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return raw[1:] if raw[:1] == " " else raw


@lru_cache(maxsize=2)
def loaded(path: str) -> Pieces:
    """One model a worker process; what it has learned stays for the next task."""
    return Pieces(path)


def encoded(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_ids, ids_crc32 (ids as little-endian unsigned 32-bit integers), n_chars of the
    decoded text, round_trip (whether decoding gives the text back, `▁` taken as a space), ids."""
    path = model_file or default_model()
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            ids = pieces.encode(texts)
            decoded = [pieces.decode(i.tolist()) for i in ids]
            ends = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                    pa.array([len(d) for d in decoded], pa.int64()),
                    pa.array([d == (t or "").replace(MARK, " ") for d, t in zip(decoded, texts, strict=True)], pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                ["doc_id", "n_ids", "ids_crc32", "n_chars", "round_trip", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_ids long, ids_crc32 long, n_chars long, round_trip boolean, ids array<int>")


def op9_piece_viterbi(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
