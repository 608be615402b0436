"""An adaptive context-mixing range coder of token ids, over many blocks at once.

Every block is coded on its own: its model starts empty, so a block can be read
without any other. An id is predicted three times. Order 2 is the id that followed the
last two ids before, order 1 the one that followed the last id; each comes with how
often it was right of late, as one of four degrees of confidence. Order 0 knows how frequent the
ids of the block are; an id that is new to it is an escape, its upper byte under the frequencies
of the upper bytes met so far. The three are mixed by the evidence: for each pair of confidences,
how often order 2 was right, and how often order 1 was where order 2 was not, gives their
shares of the range, and order 0 has the rest. A range coder with 48 bits and 16-bit digits codes the id.

The model learns after 16, 64, 256, 512, 1024, 1536, 2048 and 3072 ids of a block: what it learned is the
same for all ids up to the next time, so that the encoder looks them all up at once, and the decoder has a table
from places in the range to ids. Blocks lie side by side in numpy arrays and advance together.

All numbers of the coder are whole and below 2**53, in doubles where they are multiplied or divided: every such
operation is exact or correctly rounded, so that every machine computes the same.
"""

from __future__ import annotations

import numpy as np

#: Ids of a block (the most that a block may have, too), and blocks that are coded side by side (about 65 kB of model each, 25 kB of ids).
BLOCK_IDS, LANES = 4096, 2048
_SLOT_BITS = 12  # of the order-1 and order-2 predictions; contexts may share a slot, which costs bits only
_SLOTS = 1 << _SLOT_BITS
_TOTAL = 1 << 20  # parts of the range
_PLACES = 4096  # parts of order 0's share, which is a multiple of it
_LEAST = 16 * _PLACES  # its share at least, so that an id has 2**-16 of the range and one digit makes room again
_UPPER_PLACES = 1024  # parts of an escape's range that upper bytes have
_ESCAPE_TOTAL = _UPPER_PLACES << 8
_FRESH = 1 << 16  # stands for an id that is new
_FULL, _LOW, _DIGIT = float(1 << 48), float(1 << 32), 65536.0
_LOOK = 256  # steps between two looks at the room for digits
_AHEAD = 4  # steps that the encoder looks up at once
_SLICE = 1 << 16  # elements of a step of learning, which stay in the cache
_PRIOR = np.array([0, 0.2, 0.5, 0.8])  # how often a prediction of each confidence is right, as long as nothing is known

_IDS = np.arange(1 << 16)
_MIX1 = _IDS * 40503 >> 4 & _SLOTS - 1  # the slot that an id gives to order 1
_MIX2 = _IDS * 51197 >> 7 & _SLOTS - 1  # and what it adds to that of the next id for order 2
#: The next confidence by (confidence, right): a wrong prediction of confidence 0 or 1 gives way to the id that came, with confidence 1.
_NEXT = np.array([1, 1, 1, 2, 1, 3, 2, 3], np.int32)


def _times(steps: int) -> list[int]:
    """When the model learns: numbers of ids."""
    return [t for t in (16, 64, 256, 512, 1024, 1536, 2048, 3072) if t < steps]


class _Model:
    """What n blocks know. Entries of order 1 are id * 16 + confidence * 4, of order 2 id * 16 + confidence."""

    def __init__(self, n: int):
        self.n = n
        self.slot0 = np.arange(n) * _SLOTS
        self.pair0 = np.arange(n) * 16
        self.order1, self.order2 = np.zeros(n * _SLOTS, np.int32), np.zeros(n * _SLOTS, np.int32)
        self.seen = np.zeros((n, 16, 3))  # by both confidences: neither right, order 1 only, order 2
        self._mix()
        self.known = np.zeros(n, np.int64)  # ids of order 0, and how many there were the time before
        self.at = 0

    def _mix(self) -> None:
        """Shares of order 2, and of both, for each pair of confidences."""
        sure1, sure2 = np.repeat(_PRIOR, 4), np.tile(_PRIOR, 4)
        first2, first1 = 4 * sure2, 4 * sure1 * (1 - sure2)
        n = self.seen[:, :, 0] + self.seen[:, :, 1] + self.seen[:, :, 2] + 4.25
        shares = _TOTAL - _LEAST
        two = (self.seen[:, :, 2] + first2) / n * shares * (sure2 > 0)
        both = (self.seen[:, :, 1] + first1) / n * shares * (sure1 > 0) + two
        self.shares = np.floor(both * (1 / _PLACES)) * _PLACES
        self.share2 = np.where(sure1 > 0, np.floor(two * (self.shares / np.maximum(both, 1))), self.shares * (sure2 > 0)).reshape(-1)
        self.shares = self.shares.reshape(-1)

    def learn(self, slot1, slot2, old1, old2, ids) -> None:
        """The ids that came in the steps (rows) since the last time, with the slots of their contexts and what these predicted."""
        n = self.n
        seen = np.zeros(n * 64, np.int64)
        rows = max(1, _SLICE // n)
        for lo in range(0, len(ids), rows):
            a, b, now = old1[lo : lo + rows], old2[lo : lo + rows], ids[lo : lo + rows]
            both = (a | b) & 15
            right1, right2 = (a >> 4) == now, (b >> 4) == now
            case = both * 4 + np.where(right2, 2, right1)
            case += self.pair0 * 4
            seen += np.bincount(case.reshape(-1), minlength=n * 64)
            for table, slot, old, right, sure, shift in ((self.order1, slot1, a, right1, both >> 2, 2), (self.order2, slot2, b, right2, both & 3, 0)):
                stays = right | (sure > 1)
                new = np.where(stays, old & -16, now << 4)
                new |= _NEXT.take(sure * 2 + right) << shift
                table[slot[lo : lo + rows].reshape(-1)] = new.reshape(-1)  # of the same slot, the last stays
        self.seen = self.seen * 0.75 + seen.reshape(n, 16, 4)[:, :, :3]
        self._mix()

    def frequencies(self, lane, ids, count, at: int):
        """(places, first place) of each id of order 0, listed by lane and id; sets first places of the escapes, and those of upper bytes.

        ``at`` ids have come. Every id has a place at least, the escape half of what is left at most.
        """
        n = self.n
        known = np.bincount(lane, minlength=n)
        left = _PLACES - known
        self.escape = 1 + left * (known - self.known) // (2 * (at - self.at))
        self.known, self.at = known, at
        places = 1 + count * (left - self.escape)[lane] // at
        first = np.cumsum(places) - places
        before = np.r_[0, np.cumsum(known)]
        upto = np.r_[first, places.sum()][before]
        first -= upto[:-1][lane]
        self.escape = _PLACES - np.diff(upto)  # all that the ids leave
        self._upper(np.bincount(lane * 256 + (ids >> 8), minlength=n * 256))
        return places, first

    def _upper(self, known: np.ndarray) -> None:
        """First places of the upper bytes of new ids in each lane, and the end."""
        much = np.cumsum(known.reshape(self.n, 256) * 8 + 1, axis=1)
        self.upper = np.zeros((self.n, 257), np.int32)
        self.upper[:, 1:] = np.arange(1, 257) + much * (_UPPER_PLACES - 256) // much[:, -1:]

    def nothing(self) -> None:
        self.escape = np.full(self.n, _PLACES)
        self._upper(np.zeros(self.n * 256, np.int64))


def _slots(ids: np.ndarray, lo: int, hi: int, slot0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the contexts of the ids of these steps, ids by (step, lane)."""
    slot1, slot2 = np.zeros((2, hi - lo, ids.shape[1]), np.int64)
    first, second = max(lo, 1), max(lo, 2)
    slot1[first - lo :] = _MIX1.take(ids[first - 1 : hi - 1])
    slot2[:] = slot1
    if second < hi:
        slot2[second - lo :] ^= _MIX2.take(ids[second - 2 : hi - 2])
    slot1 += slot0
    slot2 += slot0
    return slot1, slot2


class _Digits:
    """The range coder's state of n blocks while they are written."""

    def __init__(self, n: int, steps: int):
        self.low, self.width = np.zeros(n), np.full(n, _FULL - 1)
        self.n, self.room = n, steps + 5 * _LOOK + 4
        self.out = np.zeros(n * self.room, np.uint32)
        self.base = np.arange(n) * self.room
        self.at = self.base.copy()

    def widen(self) -> None:
        if int((self.at - self.base).max()) + 5 * _LOOK + 4 > self.room:
            wider = self.room + 2 * _LOOK * 5
            self.out = np.pad(self.out.reshape(self.n, self.room), ((0, 0), (0, wider - self.room))).reshape(-1)
            self.at += np.arange(self.n) * (wider - self.room)
            self.base, self.room = np.arange(self.n) * wider, wider

    def put(self, lanes, begin, size, total: int) -> None:
        """The part of the range from begin, for the lanes, a slice or numbers."""
        part = np.floor(self.width[lanes] * (1.0 / total))
        self.low[lanes] += part * begin
        part *= size
        self.width[lanes] = part
        small = (part < _LOW).nonzero()[0]
        if not isinstance(lanes, slice):
            small = lanes[small]
        while len(small):  # a new id may need two digits
            low, at = self.low[small], self.at[small]
            digit = np.floor(low * (1 / _LOW))
            self.out[at] = digit  # may hold a carry, which is passed on at the end
            self.at[small] = at + 1
            self.low[small] = (low - digit * _LOW) * _DIGIT
            self.width[small] *= _DIGIT
            if isinstance(lanes, slice):
                break
            small = small[self.width[small] < _LOW]

    def done(self) -> list[bytes]:
        for _ in range(3):
            digit = np.floor(self.low * (1 / _LOW))
            self.out[self.at] = digit
            self.at += 1
            self.low = (self.low - digit * _LOW) * _DIGIT
        digits, used = self.out.reshape(self.n, -1), self.at - self.base
        carry = np.zeros(self.n, np.uint32)
        columns = np.ascontiguousarray(digits[:, : int(used.max())].T)
        for i in range(len(columns) - 1, -1, -1):
            columns[i] += carry
            carry = columns[i] >> 16
        written = np.ascontiguousarray(columns.T).astype(">u2")  # without the carries
        return [written[i, : used[i]].tobytes() for i in range(self.n)]


def encode_blocks(ids: np.ndarray, block: int = BLOCK_IDS) -> list[bytes]:
    """The ids (below 2**16) in blocks of so many, the last with what is left, each as bytes of its own."""
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 16):
        raise ValueError("the coder takes ids from 0 to 65535")
    if not 0 < block <= BLOCK_IDS:
        raise ValueError(f"a block has 1 to {BLOCK_IDS} ids")
    if not len(ids):
        return []
    n = -(-len(ids) // block)
    steps = min(block, len(ids))
    last = len(ids) - (n - 1) * block
    by_step, code = np.zeros((2, steps, n), np.int32)
    kinds, lane_of, known = [], [], 0
    for lane in range(0, n, 256):  # a number for each id of each lane, ascending
        part = np.zeros((min(256, n - lane), steps), np.int32)
        got = ids[lane * block : (lane + 256) * block]
        part.reshape(-1)[: len(got)] = got
        by_step[:, lane : lane + 256] = part.T
        order = part << 12 | np.arange(steps, dtype=np.int32)
        order.sort(axis=1)
        value = order >> 12
        new = np.ones(value.shape, bool)
        np.not_equal(value[:, 1:], value[:, :-1], out=new[:, 1:])
        order &= 4095
        order += np.arange(len(part), dtype=np.int32)[:, None] * steps
        numbers = np.empty(part.size, np.int32)
        numbers[order.reshape(-1)] = np.cumsum(new.reshape(-1), dtype=np.int32) + (known - 1)
        code[:, lane : lane + 256] = numbers.reshape(part.shape).T
        kinds.append(value[new])
        lane_of.append(lane + new.nonzero()[0])
        known += len(kinds[-1])
    kinds, lane_of = np.concatenate(kinds), np.concatenate(lane_of)
    model, digits = _Model(n), _Digits(n, steps)
    model.nothing()
    count = np.zeros(known, np.int64)
    packed = np.full(known, _FRESH << 10 | _PLACES, np.int32)  # first place and places of an id, or of the escape
    times = [0, *_times(steps), steps]
    for lo, hi in zip(times[:-1], times[1:], strict=True):
        slot1, slot2 = _slots(by_step, lo, hi, model.slot0)
        old1, old2 = np.empty((2, hi - lo, n), np.int32)
        model.order1.take(slot1, out=old1, mode="clip")
        model.order2.take(slot2, out=old2, mode="clip")
        for t in range(lo, hi):
            if t % _LOOK == 0:
                digits.widen()
            row = (t - lo) % _AHEAD
            if row == 0:
                now, a, b = (x.reshape(-1) for x in (by_step[t : min(t + _AHEAD, hi)], old1[t - lo : t - lo + _AHEAD], old2[t - lo : t - lo + _AHEAD]))
                both = a | b
                both &= 15
                pair = (both.reshape(-1, n) + model.pair0).reshape(-1)
                both = model.shares.take(pair)
                what = packed.take(code[t : min(t + _AHEAD, hi)].astype(np.int64)).reshape(-1)
                each = both * (-1.0 / _PLACES)
                each += _TOTAL // _PLACES
                begin = (what >> 13 & 4095).astype(float)
                begin *= each
                begin += both
                size = (what & 8191).astype(float)
                size *= each
                now16 = now << 4
                hit = (a ^ now16) < 16
                hit |= (b ^ now16) < 16
                hit = hit.nonzero()[0]
                if len(hit):
                    two, all_, here = model.share2.take(pair[hit]), both[hit], now[hit]
                    is2 = (b[hit] >> 4 == here) & (two > 0)
                    is1 = (a[hit] >> 4 == here) & (all_ > two) & ~is2
                    begin[hit] = np.where(is2, 0, np.where(is1, two, begin[hit]))
                    size[hit] = np.where(is2, two, np.where(is1, all_ - two, size[hit]))
                new = what >= _FRESH << 10
                now, begin, size, new = (x.reshape(-1, n) for x in (now, begin, size, new))
            k = n if t < last else n - 1
            digits.put(slice(0, k), begin[row, :k], size[row, :k], _TOTAL)
            fresh = new[row, :k].nonzero()[0]
            if len(fresh):
                up = now[row, fresh]
                down = up & 255
                up >>= 8
                start, end = model.upper[fresh, up], model.upper[fresh, up + 1]
                digits.put(fresh, (start * 256 + down * (end - start)).astype(float), (end - start).astype(float), _ESCAPE_TOTAL)
        if hi < steps:
            model.learn(slot1, slot2, old1, old2, by_step[lo:hi])
            count += np.bincount(code[lo:hi].reshape(-1), minlength=known)
            there = np.flatnonzero(count)
            got, at = model.frequencies(lane_of[there], kinds[there], count[there], hi)
            packed = (_FRESH << 10 | _PLACES - model.escape << 13 | model.escape).astype(np.int32)[lane_of]
            packed[there] = at << 13 | got
    return digits.done()


@np.errstate(all="ignore")  # bytes that no encoder wrote may lead to any number
def decode_blocks(blocks: list[bytes], lengths) -> list[np.ndarray]:
    """The ids of each block; lengths says how many it has. Bytes that no encoder wrote give other ids or few, never an error."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -int(lengths[i]))
    sizes = np.array([int(lengths[i]) for i in order], np.int64)
    n = len(order)
    steps = int(sizes[0])
    most = max(len(b) // 2 for b in blocks) + 4
    digits = np.zeros((n, most), np.float32)
    for j, i in enumerate(order):
        got = np.frombuffer(blocks[i][: len(blocks[i]) // 2 * 2], ">u2")
        digits[j, : len(got)] = got
    digits = digits.reshape(-1)
    digits -= 32767.5  # value is what is read and a half, so that no quotient is near a whole number
    last = np.arange(1, n + 1) * most - 1
    at = np.arange(n) * most
    value, width = np.full(n, 0.5), np.full(n, _FULL - 1)
    for _ in range(3):
        value = value * _DIGIT + digits[at]
        at += 1
    model = _Model(n)
    model.nothing()
    ids, by_lane = np.zeros((steps, n), np.int32), np.zeros((n, steps), np.int32)
    longest = max(np.diff([0, *_times(steps), steps]))
    slot1, slot2 = np.tile(model.slot0, (2, longest, 1))  # blocks that have ended stay in their own slots
    old1, old2 = np.zeros((2, longest, n), np.int32)
    before = np.zeros(n, np.int64)  # what the last id but one adds
    lane0, upper0 = np.arange(n) * _PLACES, np.arange(n) * _UPPER_PLACES

    def upper():
        return np.repeat(np.tile(np.arange(256, dtype=np.uint8), n), np.diff(model.upper).reshape(-1))

    # for each place the id, its first place and its places; before anything is known all places are the escape's
    packed, uppers = np.full(n * _PLACES, _FRESH << 25 | _PLACES), upper()

    def taken(lanes, part, begin, size):
        value[lanes] -= part * begin
        part *= size
        width[lanes] = part
        small = (part < _LOW).nonzero()[0]
        if not isinstance(lanes, slice):
            small = lanes[small]
        for _ in range(1 if isinstance(lanes, slice) else 2):
            where = at[small]
            value[small] = value[small] * _DIGIT + digits[where]
            at[small] = np.minimum(where + 1, last[small])
            width[small] *= _DIGIT
            small = small[width[small] < _LOW] if not isinstance(lanes, slice) else small

    k, times = n, [0, *_times(steps), steps]
    for lo, hi in zip(times[:-1], times[1:], strict=True):
        for t in range(lo, hi):
            while sizes[k - 1] <= t:
                k -= 1
            one, two_ = slot1[t - lo, :k], slot2[t - lo, :k]
            if t:
                _MIX1.take(now[:k], out=one, mode="clip")
                np.bitwise_xor(one, before[:k], out=two_)
                _MIX2.take(now[:k], out=before[:k], mode="clip")
                one += model.slot0[:k]
                two_ += model.slot0[:k]
            else:
                one[:] = two_[:] = model.slot0[:k]
            a = model.order1.take(one, out=old1[t - lo, :k], mode="clip")
            b = model.order2.take(two_, out=old2[t - lo, :k], mode="clip")
            both = a | b
            both &= 15
            pair = both + model.pair0[:k]
            both = model.shares.take(pair)
            part = width[:k] * (1.0 / _TOTAL)
            np.floor(part, out=part)
            seen = value[:k] / part
            hit = (seen < both).nonzero()[0]
            seen_hit = seen[hit]
            each = both * (-1.0 / _PLACES)
            each += _TOTAL // _PLACES
            seen -= both
            seen /= each
            place = seen.astype(np.int64)
            place += lane0[:k]
            what = packed.take(place, mode="clip")  # of hits, any
            now = what >> 25
            begin = (what >> 13 & 4095).astype(float)
            begin *= each
            begin += both
            size = (what & 8191).astype(float)
            size *= each
            if len(hit):
                two = model.share2.take(pair[hit])
                is2 = seen_hit < two
                begin[hit] = np.where(is2, 0, two)
                size[hit] = np.where(is2, two, both[hit] - two)
                now[hit] = np.where(is2, b[hit], a[hit]) >> 4
            taken(slice(0, k), part, begin, size)
            fresh = (now == _FRESH).nonzero()[0]
            if len(fresh):
                part = np.floor(width[fresh] * (1.0 / _ESCAPE_TOTAL))
                seen = np.minimum(value[fresh] / part, _ESCAPE_TOTAL - 1).astype(np.int64)
                up = uppers.take((seen >> 8) + upper0[fresh], mode="clip").astype(np.int64)
                begin, size = model.upper[fresh, up], model.upper[fresh, up + 1]
                size -= begin
                down = np.minimum((seen - begin * 256) // size, 255)
                now[fresh] = up << 8 | down & 255
                taken(fresh, part, (begin * 256 + down * size).astype(float), size.astype(float))
            ids[t, :k] = now
        if hi < steps:
            model.learn(slot1[: hi - lo], slot2[: hi - lo], old1[: hi - lo], old2[: hi - lo], ids[lo:hi])
            by_lane[:, lo:hi] = ids[lo:hi].T
            came = np.sort(by_lane[:, :hi], axis=1)
            new = np.ones((n, hi), bool)
            np.not_equal(came[:, 1:], came[:, :-1], out=new[:, 1:])
            where = np.flatnonzero(new)
            lane, got = where // hi, came.reshape(-1)[where]
            places, start = model.frequencies(lane, got, np.diff(np.r_[where, n * hi]), hi)
            # the ids of each lane, and then its escape
            what, size = np.empty(len(got) + n, np.int64), np.empty(len(got) + n, np.int64)
            to, escape = np.arange(len(got)) + lane, np.cumsum(model.known) + np.arange(n)
            what[to], size[to] = got.astype(np.int64) << 25 | start << 13 | places, places
            what[escape], size[escape] = _FRESH << 25 | _PLACES - model.escape << 13 | model.escape, model.escape
            packed, uppers = np.repeat(what, size), upper()
        else:
            by_lane[:, lo:] = ids[lo:].T
    by_lane = by_lane.astype(np.uint16)
    done: list = [None] * n
    for j, i in enumerate(order):
        done[i] = by_lane[j, : sizes[j]]
    return done
