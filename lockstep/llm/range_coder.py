"""An adaptive context-mixing range coder for token ids, run over many blocks in step.

Blocks are independent: each starts with an empty model and can be decoded alone.  An id is coded in one or two parts:

1. Two tables give the ids last seen behind the one before (order 1) and the two ids before (order 2), each with a
   confidence 0..7.  Whether order 1 is right, else order 2, else neither is one three-way decision.  Each order has
   adaptive probabilities for it by confidence; their mixture, with a weight that follows whichever predicted better,
   drives the coder.
2. If neither is right, the id is coded by order 0: an id that the block has had takes the places that it has in the
   sorted ids so far, others are equally likely.  The ids are sorted anew at fixed places (`REFRESH`), so that finding
   an id is a look-up.

All arithmetic is on integers, so that decoding does not depend on the machine; the one quotient that is taken of floats
is of whole numbers below 2^48, whose integer part is exact.  The range has 48 bits and moves 16 at a
time; carries stay in the words put out (which may exceed 16 bits) and are settled at the end.  NumPy runs a step for all
blocks of a batch at once, into buffers that are made once; a batch has at most LANES blocks, fewer where the alphabet is large (CELLS).
"""

from __future__ import annotations

import numpy as np

BLOCK = 8192  # ids a block, at most
LANES = 2048  # blocks of a group
CELLS = 1 << 24  # blocks x ids of the alphabet in one batch
AHEAD = 16  # steps whose places are looked up at once when encoding
SEEN = 6  # an id that was seen weighs 2^SEEN for each time, one that was not 1
SLOTS1, SLOTS2 = 11, 12  # bits
TOP, KEPT = 1 << 48, 32  # the range is at most TOP and at least 2^KEPT before a step
ALPHABET = 1 << 20  # ids at most, so that each of them always has a part of the range
REFRESH = frozenset([16, 64, 256, 1024, 2048, 4096, 6144])
CHANCE = 12  # bits
RATE, HIT = 5, 126  # p -= p / 2^RATE, and the one that was right gains HIT: two chances are 4094 of 4096 at most
_FIELD = 0xFFFF
_PART = (_FIELD >> RATE) << 16 | _FIELD >> RATE  # of two chances in one word
# By confidence, and 8 more if the table was wrong: what of its entry stays, and what is added.
_STAYS = np.array([-1] * 8 + [0] * 2 + [-1] * 6, dtype=np.int32)
_ADDED = np.array([1] * 7 + [0] + [1] * 2 + [-(c + 1 >> 1) for c in range(2, 8)], dtype=np.int32)
# By decision: order 1 is right, else order 2 is, else neither.
_GAIN = np.array([HIT, HIT << 16, 0], dtype=np.int32)
_MISS = np.array([0, 0, -1], dtype=np.int64)


def _const(value: int, kind=np.int64) -> np.ndarray:
    return np.array(value, dtype=kind)  # a Python number would be converted at each use


_I3, _I4, _I5, _I7, _I8, _I20, _PARTS, _LOW = (_const(x, np.int32) for x in (3, 4, RATE, 7, 8, 20, _PART, _FIELD))
_U4, _U20, _ULOW = (_const(x, np.uint32) for x in (4, 20, _FIELD))
_W2, _WMIN, _WMAX = _const(2, np.int32), _const(4, np.int16), _const(60, np.int16)
_QSEEN, _QFIRST, _QTIMES, _Q3 = (_const(x) for x in (SEEN, 16 - SEEN, 0xFFFF << SEEN, 3))
_Q1, _Q12, _Q16, _Q32, _Q63, _QKEPT, _QHIGH, _Q0 = (_const(x) for x in (1, CHANCE, 16, KEPT, 63, 1 << KEPT, -(1 << KEPT), 0))


class _Model:
    """What all lanes have learned.  Tables go by slot, then by lane: the slots in frequent use lie together.  The steps write
    into buffers, which `narrow` makes."""

    def __init__(self, lanes: int, vocabulary: int, longest: int, encodes: bool):
        self.vocabulary, self.lanes = vocabulary, lanes
        self.small = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        self.ids = np.zeros((longest, lanes), dtype=self.small)
        stride = 1 << (lanes - 1).bit_length()  # a power of two, so that multiples of it can be combined bit by bit
        self.tables = np.zeros(stride * ((1 << SLOTS1) + (1 << SLOTS2)), dtype=np.int32)  # id * 8 + confidence: order 1, order 2
        start = (1 << CHANCE) // 3
        # chances that order 1 is right (low half) and that order 2 is and order 1 is not: as either order's confidence tells
        self.chances = np.full(lanes << 5, start << 16 | start, dtype=np.int32)
        # order 0: by id (to encode) first place << 16 | times; by place (to decode) the same with the id << 35
        self.encodes = encodes
        self.see(0)
        self.places = np.zeros(lanes * vocabulary, dtype=np.int32) if encodes else None
        self.sorted = np.empty(0, dtype=np.int64)
        self.weight = np.full(lanes, 32, dtype=np.int16)
        ids = np.arange(vocabulary, dtype=np.int64)
        self.hash1 = ((ids * 40503 >> 3) & ((1 << SLOTS1) - 1)) * stride
        self.hash2, self.hash3 = (((ids * x >> 11) & ((1 << SLOTS2) - 1)) * stride for x in (2654435761, 2246822519))
        self.second = stride << SLOTS1
        self.narrow(lanes)

    def narrow(self, n: int) -> None:
        """Only the first n lanes go on."""
        rows = np.arange(n)
        self.n, self.rows, self.by4 = n, rows, rows * 4
        self.rows2 = rows + self.second
        self.contexts = np.stack([rows << 4, (rows + self.lanes) << 4]).astype(np.int32)
        self.weight = self.weight[:n].copy()
        # entries of the tables, their confidences, contexts, chances and what differs from the real id: order 1, order 2
        self.got, self.conf, self.ctx32, self.p, self.diff, self.wrong, self.two, self.case32 = np.empty((8, 2, n), dtype=np.int32)
        self.ctx, self.case = np.empty((2, 2, n), dtype=np.int64)
        self.t, self.mixed, self.w, self.gain = np.empty((4, n), dtype=np.int32)
        self.size1, self.size2 = np.empty((2, n), dtype=np.uint32)
        self.t16 = np.empty(n, dtype=np.int16)
        # by lane and decision: where it starts, of 2^CHANCE; how much likelier order 2 thinks it than order 1 does
        self.starts = np.zeros((n, 4), dtype=np.int64)
        self.starts[:, 3] = 1 << CHANCE
        self.gaps = np.zeros((n, 4), dtype="<i2")
        self.gap = self.gaps.view("<i4")[:, 0]
        self.all_starts = self.starts.reshape(-1)
        self.ends = self.all_starts[1:]
        self.decision, self.at4, self.other = np.empty((3, n), dtype=np.int64)
        self.found = np.empty((5, n), dtype=np.int64)

    def refresh(self, t: int) -> None:
        """Sorts what each lane has had in t steps."""
        self.see(t)
        ids = np.sort(np.ascontiguousarray(self.ids[:t, : self.n].T), axis=1, kind="stable")
        new = np.ones(ids.shape, dtype=bool)
        np.not_equal(ids[:, 1:], ids[:, :-1], out=new[:, 1:])
        at = np.flatnonzero(new)
        ids = ids.reshape(-1)[at].astype(np.int64)
        times, lane = np.diff(np.append(at, self.n * t)), at // t
        found = (at - lane * t) << 16 | times
        if self.encodes:
            self.places[ids * self.lanes + lane] = found
        else:
            self.sorted = np.repeat(ids << 35 | found, times)

    def see(self, t: int) -> None:
        self.seen, self.known = t, _const(t << SEEN)
        self.total = _const((t << SEEN) + self.vocabulary)
        self.most, self.last_place = _const((t << SEEN) + self.vocabulary - 1), _const(max(0, t - 1))

    def span(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order 0: start and size, of total, of an id (int64) in each lane."""
        got = self.places.take(ids * self.lanes + self.rows, mode="clip").astype(np.int64)
        size = got & 0xFFFF
        got >>= 16
        got <<= SEEN
        size <<= SEEN
        new = np.flatnonzero(size.reshape(-1) == 0)
        got.reshape(-1)[new], size.reshape(-1)[new] = ids.reshape(-1)[new] + (self.seen << SEEN), 1
        return got, size

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order 0: eight times the id whose span holds the value, its start and size."""
        if not self.seen:
            return value << 3, value, np.ones_like(value)
        old, more, ids, start, size = self.found
        np.subtract(value, self.known, more)
        np.right_shift(more, _Q63, old)  # -1 where the id was seen
        np.maximum(more, _Q0, more)
        np.right_shift(value, _QSEEN, ids)
        np.minimum(ids, self.last_place, ids)
        np.add(ids, self.firsts, ids)
        self.sorted.take(ids, None, start, "clip")
        np.bitwise_and(start, old, size)
        np.right_shift(size, _Q32, ids)
        np.right_shift(size, _QFIRST, start)
        np.left_shift(size, _QSEEN, size)
        np.bitwise_and(size, _QTIMES, size)
        np.bitwise_and(start, _QTIMES, start)
        np.add(old, _Q1, old)  # 1 where it was not: then it has one place behind all others
        np.add(size, old, size)
        np.multiply(old, self.known, old)
        np.add(old, more, old)
        np.add(start, old, start)
        np.left_shift(more, _Q3, more)
        np.add(ids, more, ids)
        return ids, start, size

    def slots(self, last: np.ndarray, last2: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Places in the tables of order 1 and 2: the last axis but one of out."""
        one, two = out[..., 0, :], out[..., 1, :]
        if out.ndim == 2:
            self.hash1.take(last, None, one, "clip")
            self.hash2.take(last, None, two, "clip")
            self.hash3.take(last2, None, self.other, "clip")
            np.bitwise_xor(two, self.other, two)
        else:
            one[:] = self.hash1.take(last, mode="clip")
            np.bitwise_xor(self.hash2.take(last, mode="clip"), self.hash3.take(last2, mode="clip"), two)
        np.add(one, self.rows, one)
        np.add(two, self.rows2, two)
        return out

    def predict(self, slots: np.ndarray) -> None:
        """Mixes the chances of the decision: to `starts`."""
        self.at = slots
        got, t, p, w = self.got, self.t, self.p, self.w
        self.tables.take(slots, None, got, "clip")
        np.bitwise_xor(got[0], got[1], t)
        np.minimum(t, _I8, t)
        np.bitwise_and(t, _I8, t)  # 8 where they name two ids
        np.bitwise_and(got, _I7, self.conf)
        np.add(self.conf, t, self.ctx32)
        np.add(self.ctx32, self.contexts, self.ctx32)
        np.copyto(self.ctx, self.ctx32)
        self.chances.take(self.ctx, None, p, "clip")
        np.subtract(p[1], p[0], self.gap)
        np.copyto(w, self.weight)
        np.right_shift(w, _W2, w)
        np.multiply(w, self.gap, w)
        np.left_shift(p[0], _I4, self.mixed)
        np.add(self.mixed, w, self.mixed)
        mixed = self.mixed.view(np.uint32)
        np.right_shift(mixed, _U20, self.size2)
        np.bitwise_and(mixed, _ULOW, self.size1)
        np.right_shift(self.size1, _U4, self.size1)
        np.copyto(self.starts[:, 1], self.size1)
        np.add(self.size1, self.size2, self.size2)
        np.copyto(self.starts[:, 2], self.size2)

    def compare(self, ids8: np.ndarray) -> None:
        """What the tables say against eight times the real ids (int32)."""
        np.bitwise_xor(self.got, ids8, self.diff)
        np.minimum(self.diff, _I8, self.wrong)
        np.bitwise_and(self.wrong, _I8, self.wrong)

    def learn(self, ids8: np.ndarray) -> None:
        """After `compare` and once `decision` and `at4` are there."""
        # the weight follows the order that gave the decision the greater chance
        np.add(self.gaps[:, 0], self.gaps[:, 1], self.t16)
        np.negative(self.t16, self.gaps[:, 2])
        self.gaps.reshape(-1).take(self.at4, None, self.t16, "clip")
        np.sign(self.t16, self.t16)
        w = self.weight
        np.add(w, self.t16, w)
        np.minimum(w, _WMAX, w)
        np.maximum(w, _WMIN, w)
        p, two = self.p, self.two
        _GAIN.take(self.decision, None, self.gain, "clip")
        np.right_shift(p, _I5, two)
        np.bitwise_and(two, _PARTS, two)
        np.subtract(p, two, p)
        np.add(p, self.gain, p)
        self.chances[self.ctx.reshape(-1)] = p.reshape(-1)
        # right: more confidence, up to 7; wrong: half of it, and a new id where it was 0 or 1
        np.add(self.conf, self.wrong, self.case32)
        np.copyto(self.case, self.case32)
        entry = self.diff
        _STAYS.take(self.case, None, two, "clip")
        np.bitwise_and(entry, two, entry)
        _ADDED.take(self.case, None, two, "clip")
        np.add(entry, two, entry)
        np.bitwise_xor(entry, ids8, entry)
        self.tables[self.at.reshape(-1)] = entry.reshape(-1)


def _batches(sizes: list[int], vocabulary: int) -> list[list[int]]:
    """Numbers of the blocks, the longest first, in batches."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    lanes = max(64, min(LANES, CELLS // max(1, vocabulary)))
    return [order[a : a + lanes] for a in range(0, len(order), lanes)]


def _steps(lengths: np.ndarray, model: _Model):
    """The steps, with the lanes narrowed and order 0 refreshed where it is time."""
    n = len(lengths)
    for t in range(int(lengths[0])):
        while lengths[n - 1] <= t:
            n -= 1
        if n < model.n:
            model.narrow(n)
            model.firsts = model.rows * model.seen
        if t in REFRESH:
            model.refresh(t)
            model.firsts = model.rows * t
        yield t, n


def encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """The payload of each block (at most BLOCK ids below `vocabulary` each)."""
    if vocabulary > ALPHABET:
        raise ValueError(f"{vocabulary} ids; an alphabet has {ALPHABET} at most")
    payloads: list[bytes] = [b""] * len(blocks)
    for batch in _batches([len(b) for b in blocks], vocabulary):
        for i, data in zip(batch, _encode([blocks[i] for i in batch], vocabulary), strict=True):
            payloads[i] = data
    return payloads


def _encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    lengths = np.array([len(b) for b in blocks])
    if not lengths[0]:
        return [b""] * len(blocks)
    lanes = len(blocks)
    model = _Model(lanes, vocabulary, int(lengths[0]), True)
    by_lane = np.zeros((lanes, len(model.ids)), dtype=model.small)
    for lane, b in enumerate(blocks):
        by_lane[lane, : len(b)] = b
    model.ids[:] = by_lane.T
    low, span = np.zeros(lanes, dtype=np.int64), np.full(lanes, TOP, dtype=np.int64)
    room = (int(lengths[0]) * 5 // 8 | 31) + 17
    out = np.zeros((lanes, room), dtype=np.int32)
    words = out.reshape(-1)
    at = begins = np.arange(lanes) * room  # where each lane's next word goes
    at = at.copy()
    r, a, b, m = np.empty((4, lanes), dtype=np.int64)
    word = np.empty(lanes, dtype=np.int32)
    begin, ahead = 0, 0
    for t, n in _steps(lengths, model):
        if n < len(low):
            _finish(words, low[n:], at[n:])
            low, span, at, word = low[:n], span[:n], at[:n], word[:n]
            r, a, b, m = np.empty((4, n), dtype=np.int64)
            ahead = t
        if t >= ahead or t in REFRESH:  # what depends on the ids alone, for some steps at once
            begin, ahead = t, min(t + AHEAD, len(model.ids))
            before = np.zeros((ahead - begin + 2, n), dtype=np.int64)
            before[max(0, 2 - begin) :] = model.ids[max(0, begin - 2) : ahead, :n]
            ids = before[2:]
            ids8 = ids.astype(np.int32) << 3
            starts, sizes = model.span(ids)
            total = model.total
            sizes -= total
            slots = model.slots(before[1:-1], before[:-2], np.empty((ahead - begin, 2, n), dtype=np.int64))
        k = t - begin
        real = ids8[k]
        model.predict(slots[k])
        model.compare(real)
        wrong, d, c, at4 = model.wrong, model.t, model.decision, model.at4
        np.bitwise_and(wrong[0], wrong[1], d)
        np.add(d, wrong[0], d)
        np.right_shift(d, _I3, d)  # 0, 1, 2: order 1 is right, order 2 is, neither
        np.copyto(c, d)
        np.add(model.by4, c, at4)
        np.right_shift(span, _Q12, r)
        model.all_starts.take(at4, None, a, "clip")
        model.ends.take(at4, None, b, "clip")
        np.subtract(b, a, b)
        np.multiply(a, r, a)
        np.add(low, a, low)
        np.multiply(r, b, r)
        np.floor_divide(r, total, r)
        _MISS.take(c, None, m, "clip")
        np.bitwise_and(starts[k], m, a)
        np.multiply(a, r, a)
        np.add(low, a, low)
        np.bitwise_and(sizes[k], m, a)
        np.add(a, total, a)  # all of it where an order is right
        np.multiply(r, a, span)
        np.subtract(span, _QKEPT, m)
        np.right_shift(m, _Q63, m)  # -1 where the range is short
        np.right_shift(low, _Q32, a)
        np.copyto(word, a, casting="unsafe")
        words[at] = word  # stays only where the place moves on
        np.subtract(at, m, at)
        np.bitwise_and(m, _QHIGH, a)
        np.bitwise_and(a, low, a)
        np.bitwise_xor(low, a, low)
        np.bitwise_and(m, _Q16, a)
        np.left_shift(low, a, low)
        np.left_shift(span, a, span)
        rest = (span < _QKEPT).nonzero()[0]
        while len(rest):
            words[at[rest]] = low[rest] >> KEPT
            at[rest] += 1
            low[rest] = (low[rest] & (1 << KEPT) - 1) << 16
            span[rest] <<= 16
            rest = rest[span[rest] < 1 << KEPT]
        if t % 4 == 0 and (at - begins[:n]).max() >= room - 16:
            out = np.concatenate([out, np.zeros((lanes, room // 2), dtype=np.int32)], axis=1)
            at += np.arange(n) * (out.shape[1] - room)
            room, words = out.shape[1], out.reshape(-1)
            begins = np.arange(lanes) * room
        model.learn(real)
    _finish(words, low, at)
    while len(more := np.flatnonzero(words >> 16)):  # carries
        carry = words[more] >> 16
        words[more] &= 0xFFFF
        words[more - 1] += carry
    out = out.astype("<u2")
    return [out[lane, :used].tobytes() for lane, used in enumerate(_lengths(out).tolist())]


def _finish(words: np.ndarray, low: np.ndarray, at: np.ndarray) -> None:
    """Puts out what is left of each lane's low end."""
    words[at], words[at + 1], words[at + 2] = low >> 32, low >> 16 & 0xFFFF, low & 0xFFFF


def _lengths(words: np.ndarray) -> np.ndarray:
    """Words of each lane up to its last one that is not zero; the decoder reads zeros behind the end."""
    some = words != 0
    return np.where(some.any(1), words.shape[1] - np.argmax(some[:, ::-1], axis=1), 0)


def decode(payloads: list[bytes], counts: list[int], vocabulary: int) -> list[np.ndarray]:
    found: list[np.ndarray] = [np.empty(0, np.uint32)] * len(payloads)
    for batch in _batches(counts, vocabulary):
        for i, ids in zip(batch, _decode([payloads[i] for i in batch], [counts[i] for i in batch], vocabulary), strict=True):
            found[i] = ids
    return found


def _decode(payloads: list[bytes], counts: list[int], vocabulary: int) -> list[np.ndarray]:
    lengths = np.array(counts)
    if not lengths[0]:
        return [np.empty(0, np.uint32)] * len(payloads)
    lanes = len(payloads)
    words = np.zeros((lanes, max(len(p) // 2 for p in payloads) + 8), dtype=np.uint16)
    for lane, p in enumerate(payloads):
        words[lane, : len(p) // 2] = np.frombuffer(p, dtype="<u2")
    ends = (np.arange(lanes) + 1) * words.shape[1] - 1  # where there are zeros
    at = ends - (words.shape[1] - 1)
    words = words.reshape(-1)
    model = _Model(lanes, vocabulary, int(lengths[0]), False)
    code = words[at].astype(np.int64) << 32 | words[at + 1].astype(np.int64) << 16 | words[at + 2]
    at += 3
    span = np.full(lanes, TOP, dtype=np.int64)
    real, before = np.zeros((2, lanes), dtype=np.int64)
    n = 0
    for t, n in _steps(lengths, model):
        if not t or n < len(code):
            code, span, at, real, before = code[:n].copy(), span[:n].copy(), at[:n].copy(), real[:n], before[:n]
            r, a, b, m, value = np.empty((5, n), dtype=np.int64)
            quotient, some, slots, ends = np.empty(n), np.empty(n, dtype=np.uint16), np.empty((2, n), dtype=np.int64), ends[:n]
            past1, past2 = np.empty((2, n), dtype=bool)
            ids4, ids8 = np.zeros((n, 4), dtype=np.int32), np.empty(n, dtype=np.int32)
            all_ids = ids4.reshape(-1)
        model.predict(model.slots(real, before, slots))
        c, at4, d = model.decision, model.at4, model.t
        total = model.total
        np.right_shift(span, _Q12, r)
        np.multiply(r, model.starts[:, 1], a)
        np.greater_equal(code, a, past1)
        np.multiply(r, model.starts[:, 2], a)
        np.greater_equal(code, a, past2)
        np.add(past1.view(np.int8), past2.view(np.int8), past1.view(np.int8))
        np.copyto(c, past1.view(np.int8))
        np.add(model.by4, c, at4)
        model.all_starts.take(at4, None, a, "clip")
        model.ends.take(at4, None, b, "clip")
        np.subtract(b, a, b)
        np.multiply(a, r, a)
        np.subtract(code, a, code)
        np.multiply(r, b, r)
        np.floor_divide(r, total, r)
        np.divide(code, r, quotient)  # of whole numbers below 2^48: what is before the point is exact
        np.copyto(value, quotient, casting="unsafe")
        np.minimum(value, model.most, value)
        np.maximum(value, _Q0, value)
        found, start, size = model.find(value)
        np.subtract(model.got[0], model.conf[0], ids4[:, 0])
        np.subtract(model.got[1], model.conf[1], ids4[:, 1])
        np.copyto(ids4[:, 2], found, casting="unsafe")
        all_ids.take(at4, None, ids8, "clip")
        _MISS.take(c, None, m, "clip")
        np.bitwise_and(start, m, a)
        np.multiply(a, r, a)
        np.subtract(code, a, code)
        np.subtract(size, total, a)
        np.bitwise_and(a, m, a)
        np.add(a, total, a)
        np.multiply(r, a, span)
        np.subtract(span, _QKEPT, m)
        np.right_shift(m, _Q63, m)  # -1 where the range is short
        words.take(at, None, some, "clip")
        np.copyto(b, some)
        np.bitwise_and(b, m, b)
        np.subtract(at, m, at)
        np.minimum(at, ends, at)
        np.bitwise_and(m, _Q16, a)
        np.left_shift(code, a, code)
        np.bitwise_or(code, b, code)
        np.left_shift(span, a, span)
        rest = (span < _QKEPT).nonzero()[0]
        while len(rest):
            code[rest] = code[rest] << 16 | words[at[rest]]
            at[rest] = np.minimum(at[rest] + 1, ends[rest])
            span[rest] <<= 16
            rest = rest[span[rest] < 1 << KEPT]
        before, real = real, before
        np.right_shift(ids8, _I3, d)
        np.copyto(real, d)
        model.ids[t, :n] = d
        model.compare(ids8)
        model.learn(ids8)
    ids = np.ascontiguousarray(model.ids.T)
    return [ids[lane, :count].astype(np.uint32) for lane, count in enumerate(counts)]
