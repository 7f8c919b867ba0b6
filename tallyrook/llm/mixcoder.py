"""Adaptive context-mixing range coder for token ids.

A segment is coded in blocks of a fixed number of ids.  Every block starts from
a fresh adaptive model and a fresh coder and has its own checksum, so a damaged
block costs its own ids only.  The blocks of a segment run as lanes side by
side, one id of each per step, so a step is a few array operations.

Predictions.  Order 0: the segment's ids by falling frequency.  Order 1: for
each id, the ids that follow it more than once, by falling frequency.  Order 2:
for a hash of the last two ids, the id that follows most often, with a
confidence.  These tables stand at the head of the segment.

What a block adapts is the odds between them.  An event says where the next id
is: it is the guess of order 2; or it has a rank of class c among the followers
of the last id (2 ** (c + 1) ranks from 2 * (2**c - 1)), and c + 1 bits say
which; or it is named by its order-0 rank.  Event counts are kept overall, by
the last event, and by the confidence of order 2; the mixture is their sum, and
what a count adds in a context is the context's weight, which grows while the
context predicts better than the mixture.  Events are arithmetically coded by
the mixture; the bits inside a class are even and stored as they are.

All numbers are whole, held in floats where these are exact, so an encoder and
a decoder on different machines agree.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

BLOCK = 2048
EVENTS = 16
_GUESS, _ESCAPE = 0, EVENTS - 1
_CLASSES = EVENTS - 2
_RANKS = 2 * ((1 << _CLASSES) - 1)
_ROWS = EVENTS + 16  # contexts of a lane, beside the one for all
_SLOTS = 1 << 16
#: Distinct ids that a segment may have; one with more is cut in two.
DISTINCT = 65_535
#: How often a context of order 2 must be seen, and confidences' least shares.
_SEEN, _SHARES = 12, (0.2, 0.45, 0.75)
_WEIGHTS, _LEAST, _MOST = (2, 6, 8), 1, 12
#: Ids of a block up to which the counts of two contexts, added, have 16 bits.
_MOST_IDS = 0xFFFF // (2 * _MOST)
_FLOOR = float(1 << 32)
_TOP = float(1 << 48)
_LOW32, _S16, _S32 = np.uint64(0xFFFFFFFF), np.uint64(16), np.uint64(32)
_SUM = np.tril(np.ones((EVENTS, EVENTS), np.float32))
_SUM_ROWS = np.ascontiguousarray(_SUM.T)
_ONES = np.ones(EVENTS, np.float32)
#: Of the last event, its part of the context by confidence.
_GROUP = (np.arange(EVENTS) + 3) // 5
_FIRST = np.array([0, *[2 * ((1 << c) - 1) for c in range(_CLASSES)], 0], np.int32)
#: By rank among the followers, the event of its class; at the end that of rank -1.
_EVENT_OF = np.append(np.repeat(np.arange(1, _CLASSES + 1), 1 << np.arange(1, _CLASSES + 1)), _ESCAPE).astype(np.int8)


@dataclass
class Tables:
    ids: np.ndarray  # by order-0 rank; all else speaks of these ranks
    begin: np.ndarray  # of an id's followers
    follow: np.ndarray
    guess: np.ndarray  # by slot of the last two ids: id + (confidence << 16)

    @property
    def bits(self) -> np.ndarray:
        """Bits inside each event."""
        return np.array([0, *range(1, _CLASSES + 1), max(1, (len(self.ids) - 1).bit_length())], np.int32)


def _slot(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return ((last * 40503 + before * 25717) ^ (before >> 5)) & (_SLOTS - 1)


def _previous(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last id and the one before, 0 at a block's start."""
    last, before = np.zeros(rows.shape, np.uint32), np.zeros(rows.shape, np.uint32)
    last[:, 1:], before[:, 2:] = rows[:, :-1], rows[:, :-2]
    return last, before


def _tables(rows: np.ndarray, ids: np.ndarray) -> tuple[Tables, Callable[[np.ndarray], np.ndarray]]:
    """The tables, and what gives the ranks of ids among the followers of the
    last ones, by last * len(ids) + id; -1 where they aren't listed."""
    n = np.uint32(len(ids))
    last, before = _previous(rows)
    pairs, count = np.unique(last * n + rows, return_counts=True)
    listed = count > 1
    pairs, count = pairs[listed].astype(np.int64), count[listed]
    order = np.lexsort((pairs, -count, pairs // n))
    pairs = pairs[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(pairs // n, minlength=n))]).astype(np.int64)
    rank = np.arange(len(pairs)) - begin[pairs // n]
    rank[rank >= _RANKS] = -1
    rank = rank.astype(np.int16)
    if len(ids) ** 2 <= 1 << 24:
        table = np.full(len(ids) ** 2, -1, np.int16)
        table[pairs] = rank
        ranks = table.take
    else:
        by = np.argsort(pairs)
        sorted_ = np.append(pairs[by], -1).astype(np.uint32)  # so that no place is beyond the end

        def ranks(cells: np.ndarray) -> np.ndarray:
            at = np.searchsorted(sorted_[:-1], cells)
            return np.where((sorted_[at] == cells) & (at < len(by)), np.append(rank[by], -1)[at], -1)

    slots, count = np.unique(_slot(before, last) * n + rows, return_counts=True)
    del last, before
    slot = slots // n
    first = np.flatnonzero(np.diff(slot, prepend=slot[0] + np.uint32(1)))
    total, most = np.add.reduceat(count, first), np.maximum.reduceat(count, first)
    run = np.repeat(np.arange(len(first)), np.diff(first, append=len(slot)))
    top = np.flatnonzero(count == most[run])
    top = top[np.unique(run[top], return_index=True)[1]]
    sure = np.where(total >= _SEEN, np.searchsorted(_SHARES, most / total, "right"), 0)
    guess = np.zeros(_SLOTS, np.uint32)
    guess[slot[first]] = np.where(sure > 0, slots[top] % n + (sure << 16), 0)
    return Tables(ids, begin, (pairs % n).astype(np.uint16), guess), ranks


class Model:
    """Event counts of all lanes.  The counts overall are read in every step and
    stand apart, one lane after another.  Those of the two contexts are gathered
    and are narrow, also added: no block has more than _MOST_IDS ids."""

    def __init__(self, lanes: int):
        self.rows = np.arange(lanes) * EVENTS
        self.overall = np.ones((lanes, EVENTS), np.float32)
        self.counts = np.zeros((lanes * _ROWS, EVENTS), np.uint16)
        self.base = np.stack([np.arange(lanes) * _ROWS, np.arange(lanes) * _ROWS + EVENTS])
        self.at = self.base.copy()
        self.seen = np.empty((2, lanes, EVENTS), np.uint16)
        self.both = np.empty((lanes, EVENTS), np.uint16)
        self.f = np.empty((lanes, EVENTS), np.float32)
        self.weight = np.repeat(np.array(_WEIGHTS, np.float32)[:, None], lanes, axis=1)
        self.narrow = self.weight[1:].astype(np.uint16)
        self.last = np.zeros(lanes, np.int64)  # last event
        self.steps = 0

    def mix(self, context: np.ndarray) -> np.ndarray:
        """The mixed event weights (lane, event).  context: 4 * the confidence
        of order 2 + the last event's group."""
        np.add(self.base[0], self.last, out=self.at[0])
        np.add(self.base[1], context, out=self.at[1])
        self.counts.take(self.at, axis=0, out=self.seen, mode="clip")  # never out of bounds; other modes copy
        np.add(self.seen[0], self.seen[1], out=self.both)
        return np.add(self.overall, self.both, out=self.f)

    def update(self, event: np.ndarray, place: np.ndarray, own: np.ndarray, total: np.ndarray) -> None:
        """place: of the event in `f`; own: its mixed weight, total: of all."""
        self.at *= EVENTS
        self.at += event
        flat, overall = self.counts.reshape(-1), self.overall.reshape(-1)
        got, got_overall = flat.take(self.at, mode="clip"), overall.take(place)
        if self.steps % 16 == 0:
            better = np.stack([got_overall, *got]).astype(np.float32) * total > own * np.stack([self.overall @ _ONES, *(self.seen.astype(np.float32) @ _ONES)])
            self.weight += np.where(better, np.float32(1), np.float32(-1))
            np.clip(self.weight, _LEAST, _MOST, out=self.weight)
            self.narrow = self.weight[1:].astype(np.uint16)
        self.steps += 1
        got += self.narrow
        got_overall += self.weight[0]
        flat[self.at], overall[place] = got, got_overall
        self.last = event


def _packed(values: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each lane's values (lane, step) one after another in 16-bit words of
    their bits, the lanes one after another; how many words each lane has."""
    used = (bits.sum(1) + 15) // 16
    flat_bits, flat = bits.reshape(-1).astype(np.int64), values.reshape(-1).astype(np.int64)
    inside = np.cumsum(bits, axis=1, dtype=np.int64) - bits
    start = (inside + 16 * (np.cumsum(used) - used)[:, None]).reshape(-1)
    word, shift = start >> 4, 32 - (start & 15) - flat_bits
    wide = flat << shift  # two words from `word` on
    n = int(used.sum()) + 1
    out = np.bincount(word, wide >> 16, minlength=n)[:n].astype(np.int64)
    out[1:] += np.bincount(word, wide & 0xFFFF, minlength=n)[: n - 1].astype(np.int64)
    return out[:-1].astype("<u2"), used


def _coded(event: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arithmetic coding of events (step, lane): 16-bit words of all lanes one
    after another, and how many each lane has."""
    n, lanes = event.shape
    model = Model(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _TOP)
    words, at = np.zeros((n // 3 + 64, lanes), np.uint32), np.zeros(lanes, np.int64)

    def grown() -> None:
        nonlocal words
        if at.max(initial=0) + 8 >= len(words):
            words = np.concatenate([words, np.zeros_like(words)])

    context = sure << np.int8(2)
    context[1:] += _GROUP.astype(np.int8).take(event[:-1])
    for t in range(n):
        e = event[t].astype(np.int64)
        f = model.mix(context[t])
        sums = f @ _SUM_ROWS
        total, place = sums[:, EVENTS - 1], model.rows + e
        own = f.reshape(-1).take(place)
        unit = span / total
        np.floor(unit, out=unit)
        low += ((sums.reshape(-1).take(place) - own) * unit).astype(np.uint64)
        np.multiply(own, unit, out=span)
        if t % 4 == 0:
            grown()
        m = np.flatnonzero(span < _FLOOR)
        while len(m):
            k, x, rest = at.take(m), low.take(m), span.take(m) * 65536.0
            words[k, m] = x >> _S32
            at[m] = k + 1
            low[m] = (x & _LOW32) << _S16
            span[m] = rest
            m = m[rest < _FLOOR]
        model.update(e, place, own, total)
    for _ in range(3):
        grown()
        words[at, np.arange(lanes)] = low >> _S32
        at += 1
        low = (low & _LOW32) << _S16
    words = words[: at.max()]
    for j in range(len(words) - 1, 0, -1):  # carries
        words[j - 1] += words[j] >> 16
        words[j] &= 0xFFFF
    words[0] &= 0xFFFF
    used = np.arange(len(words))[None, :] < at[:, None]
    return words.T[used].astype("<u2"), at


@np.errstate(over="ignore")  # in damaged blocks
def _decoded(words: np.ndarray, used: np.ndarray, raw: np.ndarray, raw_used: np.ndarray, n: int, t: Tables) -> np.ndarray:
    """Order-0 ranks (lane, step)."""
    lanes = len(used)
    flat = np.concatenate([words, np.zeros(4, "<u2")]).astype(np.float64)
    at = np.cumsum(used) - used
    wide = np.concatenate([raw, np.zeros(2, "<u2")]).astype(np.int64)
    wide = (wide[:-1] << 16) | wide[1:]
    place = 16 * (np.cumsum(raw_used) - raw_used)
    model = Model(lanes)
    code, span = np.zeros(lanes), np.full(lanes, _TOP)
    for _ in range(3):
        code = code * 65536.0 + flat.take(at, mode="clip")
        at += 1
    bits, first = t.bits.astype(np.int64), _FIRST.astype(np.int64)
    unused = 32 - bits
    follow = t.follow if len(t.follow) else np.zeros(1, np.uint16)
    begin, top = t.begin, len(t.ids) - 1
    guess = t.guess.astype(np.int32)
    guess += 3 * (guess >> 16 << 16)  # 4 * the confidence
    lane = np.arange(lanes)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    out = np.zeros((n, lanes), np.uint16)
    for step in range(n):
        g = guess.take(_slot(before, last))
        f = model.mix((g >> 16) + _GROUP.take(model.last))
        sums = _SUM @ f.T  # (event, lane)
        total = sums[EVENTS - 1]
        unit = span / total
        np.floor(unit, out=unit)
        # whole numbers below 2**48 divide without reaching the next whole number; sums are
        # below 2**24, so that rounding a larger quotient changes no comparison
        value = np.floor(code / unit).astype(np.float32)
        below = sums[:-1] <= value
        event = np.add.reduce(below.view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)
        spot = model.rows + event
        own = f.reshape(-1).take(spot)
        code -= (sums.reshape(-1).take(event * lanes + lane) - own) * unit
        np.multiply(own, unit, out=span)
        m = np.flatnonzero(span < _FLOOR)
        while len(m):
            k, rest = at.take(m), span.take(m) * 65536.0
            span[m] = rest
            code[m] = code.take(m) * 65536.0 + flat.take(k, mode="clip")
            at[m] = k + 1
            m = m[rest < _FLOOR]
        size = bits.take(event)
        inside = wide.take(place >> 4, mode="clip") << (place & 15)
        inside &= 0xFFFFFFFF
        inside >>= unused.take(event)
        place += size
        x = follow.take(begin.take(last) + first.take(event) + inside, mode="clip").astype(np.int64)
        np.copyto(x, g & 0xFFFF, where=event == _GUESS)
        m = np.flatnonzero(event == _ESCAPE)
        x[m] = np.minimum(inside.take(m), top)
        out[step] = x
        model.update(event, spot, own, total)
        before, last = last, x
    return out.T


def _section(*arrays: np.ndarray) -> bytes:
    body = zlib.compress(b"".join(a.tobytes() for a in arrays), 6)
    return struct.pack("<II", len(body), zlib.crc32(body)) + body


def encode(ids: np.ndarray) -> bytes:
    """One segment: the number of ids, ids a block, blocks, distinct ids,
    listed followers and guesses; the tables; each block's checksum and sizes;
    the blocks' events; the blocks' inner bits."""
    ids = np.asarray(ids, np.int64)
    n = len(ids)
    if n and (ids.min() < 0 or ids.max() >= 1 << 32):
        raise ValueError("ids must be at least 0 and below 2**32")
    if n == 0:
        return struct.pack("<4sI", b"TRM2", 0)
    if ids.max() < 1 << 22:
        seen = np.bincount(ids)
        used_ids = np.flatnonzero(seen)
        count = seen[used_ids]
    else:
        used_ids, count = np.unique(ids, return_counts=True)
    if len(used_ids) > DISTINCT:  # more than ranks have bits for: two segments
        a, b = encode(ids[: n // 2]), encode(ids[n // 2 :])
        return struct.pack("<4sII", b"TRMB", n, len(a)) + a + b
    used_ids = used_ids[np.lexsort((used_ids, -count))]
    if ids.max() < 1 << 22:
        dense_of = np.zeros(int(ids.max()) + 1, np.int32)
        dense_of[used_ids] = np.arange(len(used_ids))
        dense = dense_of[ids]
    else:
        by = np.argsort(used_ids)
        dense = by[np.searchsorted(used_ids[by], ids)].astype(np.int32)
    size = min(BLOCK, n)
    blocks = -(-n // size)
    rows = np.zeros(blocks * size, np.uint32)
    rows[:n] = dense
    rows = rows.reshape(blocks, size)
    t, rank_of = _tables(rows, used_ids)
    event, sure = np.empty((size, blocks), np.int8), np.empty((size, blocks), np.int8)
    raws, raw_used = [], []
    for k in range(0, blocks, 64):
        x = rows[k : k + 64]
        last, before = _previous(x)
        g = t.guess.take(_slot(before, last))
        ranks = rank_of(last * np.uint32(len(used_ids)) + x)
        e = _EVENT_OF.take(ranks, mode="wrap")
        e[(g >= 1 << 16) & ((g & np.uint32(0xFFFF)) == x)] = _GUESS
        inside = ranks - _FIRST.take(e)
        np.copyto(inside, x.view(np.int32), where=e == _ESCAPE)
        inside[e == _GUESS] = 0
        raw, n_raw = _packed(inside, t.bits.take(e))
        raws.append(raw)
        raw_used.append(n_raw)
        event[:, k : k + 64], sure[:, k : k + 64] = e.T, (g >> np.uint32(16)).T
    raw, raw_used = np.concatenate(raws), np.concatenate(raw_used)
    words, used = _coded(event, sure)
    sums = np.array([zlib.crc32(r.astype("<u2").tobytes()) for r in rows], "<u4")
    places = np.flatnonzero(t.guess)
    head = struct.pack("<4sIIIIII", b"TRM2", n, size, blocks, len(used_ids), len(t.follow), len(places))
    tables = _section(used_ids.astype("<u4"), np.diff(t.begin).astype("<u2"), t.follow.astype("<u2"), places.astype("<u2"), t.guess[places].astype("<u4"))
    return b"".join([head, tables, _section(sums, used.astype("<u4"), raw_used.astype("<u4")), words.tobytes(), raw.tobytes()])


def decode_blocks(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a segment, and which of them stand in sound blocks.  Damage
    to the tables raises ValueError."""
    magic, n = struct.unpack_from("<4sI", body)
    if magic == b"TRMB":
        (k,) = struct.unpack_from("<I", body, 8)
        a, b = decode_blocks(body[12 : 12 + k]), decode_blocks(body[12 + k :])
        return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    if magic != b"TRM2":
        raise ValueError("not a segment")
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    size, blocks, distinct, n_follow, n_guess = struct.unpack_from("<IIIII", body, 8)
    if size > _MOST_IDS:
        raise ValueError("the blocks of a segment are too large")
    at, sections = 28, []
    for _ in range(2):
        length, crc = struct.unpack_from("<II", body, at)
        part = body[at + 8 : at + 8 + length]
        if zlib.crc32(part) != crc:
            raise ValueError("the tables of a segment are damaged")
        sections.append(zlib.decompress(part))
        at += 8 + length
    tables, sizes = sections
    ids = np.frombuffer(tables, "<u4", distinct)
    follows = np.frombuffer(tables, "<u2", distinct, 4 * distinct).astype(np.int64)
    follow = np.frombuffer(tables, "<u2", n_follow, 6 * distinct)
    places = np.frombuffer(tables, "<u2", n_guess, 6 * distinct + 2 * n_follow)
    guess = np.zeros(_SLOTS, np.uint32)
    guess[places] = np.frombuffer(tables, "<u4", n_guess, 6 * distinct + 2 * n_follow + 2 * n_guess)
    t = Tables(ids, np.concatenate([[0], np.cumsum(follows)]).astype(np.int64), follow, guess)
    sums, used, raw_used = np.frombuffer(sizes, "<u4").reshape(3, blocks)
    used, raw_used = used.astype(np.int64), raw_used.astype(np.int64)
    if len(body) != at + 2 * int(used.sum() + raw_used.sum()):
        raise ValueError("a segment is cut short")
    words = np.frombuffer(body, "<u2", int(used.sum()), at)
    raw = np.frombuffer(body, "<u2", int(raw_used.sum()), at + 2 * len(words))
    rows = np.ascontiguousarray(_decoded(words, used, raw, raw_used, size, t))
    good = np.array([zlib.crc32(r.astype("<u2").tobytes()) for r in rows], np.uint32) == sums
    return ids[np.minimum(rows.reshape(-1)[:n], distinct - 1)], np.repeat(good, size)[:n]


def decode(body: bytes) -> np.ndarray:
    """The ids of a segment; a damaged block raises ValueError."""
    ids, good = decode_blocks(body)
    if not good.all():
        raise ValueError("damaged block")
    return ids
