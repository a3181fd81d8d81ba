"""An adaptive context-mixing range coder for token ids, over many blocks at once.

Three predictors say what the next id may be: order 2 names the id that last followed the same two ids, order 1 the one that last
followed the same id, and order 0 counts ids in classes of neighbouring ids, whose members share by a table in the segment's head; that table
also says where a block's counts start. All counts go up with what comes, and the classes' shares follow them every few ids. The orders' predictions are mixed with weights
that each block learns, apart for how often orders 1 and 2 were right of late and whether they name the same id: a weight grows as its order is the highest that names what
came. The id is coded by its part of the mix, that of the highest order that names it, in a 64-bit range without carries: a range of less than 32 bits moves on by 32, and one that lies across a
border then is cut down to end at it. So an id takes one step and moves a range on once at most.

Every block is coded for itself: its counts, predictors and weights start afresh, so blocks are read in any order. Numpy works on one id of each
block (a lane) at a time. All steps are single IEEE or integer operations per lane, so the reader repeats the writer's
numbers on any machine.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Contexts of an order that a block tells apart, as a power of two.
SLOT_BITS = 8
#: Classes of order 0 at most. Their shares sum to 2^CLASS_BITS, those of a class's members to 2^MEMBER_BITS, and the weights of a mix to 2^WEIGHT_BITS.
CLASSES, CLASS_BITS, MEMBER_BITS, WEIGHT_BITS = 96, 10, 12, 9
#: What a block's counts of all classes sum to at its start; an id counts one more.
START = 1024
#: Ids of a block after which the shares of the classes follow their counts.
PERIOD = 32
#: A weight moves by 1/2^RATE of what it is off.
RATE = 5
#: What orders 2 and 1 weigh at a block's start, by how often they were right of late; order 1's is a part of what order 2 leaves.
FIRST2, FIRST1 = (0, 0.25, 0.5, 0.75), (0, 0.15, 0.4, 0.6)

_SLOTS, _SHIFT = 1 << SLOT_BITS, np.uint32(32 - SLOT_BITS)
SHARE_BITS = CLASS_BITS + MEMBER_BITS
_WHOLE, _MEMBERS = np.uint32(1 << WEIGHT_BITS), 1 << MEMBER_BITS
#: Stands for no id; ids are smaller.
NONE = 0xFFFF
_TOTAL_BITS, _MOST = np.uint64(SHARE_BITS + WEIGHT_BITS), np.uint64((1 << SHARE_BITS + WEIGHT_BITS) - 1)
_K1, _K2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_BOTTOM, _32, _U1, _U5 = (np.uint64(x) for x in ((1 << 32) - 1, 32, 1, 5))
_0, _1, _2, _3, _5, _12, _16, _24, _LOW, _SHARE, _MEMBER, _MASK12, _RATE = (np.uint32(x) for x in (0, 1, 2, 3, 5, 12, 16, 24, 0xFFFF, SHARE_BITS, MEMBER_BITS, 0xFFF, RATE))
#: Weights are of 2^16. Orders 2 and 1 have at least one unit of 2^WEIGHT_BITS each, and so has order 0.
_SPREAD = np.uint32((1 << WEIGHT_BITS) - 3)
#: A pair of weights loses a part of each; what named the id gains as much as a full weight loses.
_MOVES, _MOVE2, _MOVE1 = (np.uint32(x * (0xFFFF >> RATE)) for x in (0x10001, 0x10000, 1))
#: The weights of orders 2 and 1 at a block's start, by how often each was right (0: it names none; 1: not since it was named; 2, 3: once, more often) and whether both name the same id.
_FIRST = np.array([(FIRST2[a], 0 if same else (1 - FIRST2[a]) * FIRST1[b]) for a in range(4) for b in range(4) for same in range(2)])
_FIRST = (_FIRST * 65000).astype(np.uint32) @ np.array([1 << 16, 1], np.uint32)


def _shared(counts: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers in about the proportion of the counts, at least one each, that sum to ``total``."""
    shares = 1 + counts * (total - len(counts)) // max(1, int(counts.sum()))
    shares[shares.argmax()] += total - shares.sum()
    return shares


class Prior:
    """What a segment's head says of its ids: which occur, their classes, the classes' counts at a block's start, and shares within classes."""

    def __init__(self, present: np.ndarray, counts: np.ndarray):
        """``counts`` are of the ids ``present``, which ascend; any numbers of about their proportion, at least one."""
        self.present, self.counts = present.astype(np.int64), counts.astype(np.int64)
        # a class ends where it would get too heavy or too large
        heavy = np.cumsum(self.counts) * (CLASSES // 2) // max(1, int(self.counts.sum()))
        cut = np.ones(len(present), bool)
        cut[1:] = heavy[1:] != heavy[:-1]
        large = np.zeros(len(present), bool)
        if cut.sum() < CLASSES:  # the rest of the classes go to the largest
            spare = CLASSES - int(cut.sum())
            large[:: max(1, -(-len(present) // spare))] = True
        cut |= large
        first = np.flatnonzero(cut)
        sizes = np.diff(np.append(first, len(present)))
        if len(sizes) and sizes.max() > _MEMBERS // 2:
            raise ValueError("too many different ids")
        self.size = len(first)
        self.start = _shared(np.add.reduceat(self.counts, first), START) if self.size else np.zeros(0, np.int64)
        self.ahead = np.concatenate([[0], np.cumsum(self.start)])
        self.first = np.append(first, len(present))
        member = np.concatenate([np.zeros(0, np.int64), *[_shared(self.counts[i:j], _MEMBERS) for i, j in zip(self.first[:-1], self.first[1:])]])
        ends = np.cumsum(member)  # over all classes
        self.members = np.repeat(self.present, member).astype(np.uint16)  # the id of each unit of each class
        top = int(present[-1]) + 1 if len(present) else 1
        group = np.repeat(np.arange(self.size), sizes)
        self.parts = np.zeros(top, np.uint32)  # of an id: its class, the shares of the members before it, and its own less one
        self.parts[self.present] = (group << 24) | (ends - member - (group << MEMBER_BITS) << 12) | (member - 1)

    @classmethod
    def of(cls, ids: np.ndarray) -> Prior:
        counts = np.bincount(ids, minlength=1)
        present = np.flatnonzero(counts)
        return cls(present, np.minimum(counts[present], 0xFFFFFFFF))

    def pack(self) -> bytes:
        table = np.stack([np.diff(self.present, prepend=0), self.counts]).astype("<u4")
        return zlib.compress(table.tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Prior:
        gaps, counts = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1).astype(np.int64)
        return cls(np.cumsum(gaps), counts)


class _Model:
    """The adaptive part, for all lanes: shares and counts of classes, named ids by slot with how often they were right, and weights."""

    def __init__(self, lanes: int, prior: Prior):
        self.prior, self.lanes, self.lane = prior, lanes, np.arange(lanes)
        self.base, self.set_base = (self.lane * n for n in (_SLOTS, len(_FIRST)))
        self.counts = np.repeat(prior.start.astype(np.int64)[:, None], lanes, axis=1)  # a column for each lane
        self.begins = np.zeros((prior.size + 1, lanes), np.int16)  # where the classes' shares begin
        self.flat, self.came, self.total = self.begins.reshape(-1), [], START
        self.named = [np.full(lanes * _SLOTS, NONE << 2, np.uint32) for _ in range(2)]  # order 2, order 1: the id and, below it, how often it was right
        self.weights = np.tile(_FIRST, lanes)  # order 2's and, below it, order 1's; the rest is order 0's
        self.one, self.two = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)  # hashes of the last id and the one before
        self.below = np.empty((max(0, prior.size - 1), lanes), bool)
        self.share_out()

    def share_out(self) -> None:
        """Shares of the classes from their counts so far; each has at least one unit."""
        if self.came:
            self.counts += np.bincount(np.concatenate(self.came), minlength=self.counts.size).reshape(self.counts.shape)
            self.came = []
        ahead, scale = np.zeros(self.lanes, np.int64), (1 << CLASS_BITS) - self.prior.size
        for k in range(self.prior.size):
            ahead += self.counts[k]
            self.begins[k + 1] = ahead * scale // self.total + (k + 1)

    def predict(self, m: int) -> None:
        """Sets what orders 2 and 1 name, and the whole-number weights: ``two`` is order 2's, ``both`` that of orders 2 and 1, ``rest`` order 0's."""
        one = self.one[:m]
        self.slot1 = (one >> _SHIFT) + self.base[:m]
        self.slot2 = ((one ^ (self.two[:m] >> _5)) * _K2 >> _SHIFT) + self.base[:m]
        self.name2, self.name1 = self.named[0].take(self.slot2), self.named[1].take(self.slot1)
        self.id2, self.id1 = self.name2 >> _2, self.name1 >> _2
        state = ((self.name2 & _3) << _3) + ((self.name1 & _3) << _1)
        state += self.id2 == self.id1
        self.set = state + self.set_base[:m]
        self.weight = self.weights.take(self.set)
        self.two_q = ((self.weight >> _16) * _SPREAD >> _16) + _1
        self.both_q = ((self.weight & _LOW) * _SPREAD >> _16) + _1
        self.both_q += self.two_q
        self.rest_q = _WHOLE - self.both_q

    def interval(self, own: np.ndarray, by2: np.ndarray, by1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the share of each lane's id begins, and how wide it is: that of the highest order that names it, or else its part of order 0's."""
        part = self.prior.parts.take(own)
        place = (part >> _24) * np.uint32(self.lanes) + self.lane[: len(own)]
        self.came.append(place)
        class_begin = self.flat.take(place).astype(np.uint32)
        class_width = self.flat.take(place + self.lanes).astype(np.uint32) - class_begin
        width = self.rest_q * class_width
        begin = (self.both_q << _SHARE) + self.rest_q * (class_begin << _MEMBER) + width * (part >> _12 & _MASK12)
        width *= (part & _MASK12) + _1
        two, both = self.two_q << _SHARE, self.both_q << _SHARE
        begin = np.where(by2, _0, np.where(by1, two, begin))
        width = np.where(by2, two, np.where(by1, both - two, width))
        return begin.astype(np.uint64), width.astype(np.uint64)

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id in whose share of the mix each number falls, and whether order 2 or order 1 names it."""
        m, weight = len(v), v >> _SHARE
        by2 = weight < self.two_q
        by1 = (weight < self.both_q) & ~by2
        x = np.maximum(v, self.both_q << _SHARE) - (self.both_q << _SHARE)
        x = (x / self.rest_q).astype(np.int32)  # doubles hold these numbers exactly, and their quotients' whole parts
        below = self.below[:, :m]
        np.less_equal(self.begins[1:-1, :m], (x >> MEMBER_BITS).astype(np.int16), out=below)
        group = np.add.reduce(below.view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)
        at = group * self.lanes + self.lane[:m]
        begin = self.flat.take(at)
        x -= begin.astype(np.int32) << MEMBER_BITS
        x = (x / (self.flat.take(at + self.lanes) - begin)).astype(np.int64)
        own = self.prior.members.take((group << MEMBER_BITS) + np.minimum(x, _MEMBERS - 1)).astype(np.uint32)
        return np.where(by2, self.id2, np.where(by1, self.id1, own)), by2, by1

    def learn(self, own: np.ndarray, by2: np.ndarray, by1: np.ndarray) -> None:
        """Takes in what came; call after :meth:`interval`."""
        m = len(own)
        self.total += 1
        hit2 = by2.astype(np.uint32)
        self.weights[self.set] = self.weight - (self.weight >> _RATE & _MOVES) + hit2 * _MOVE2 + by1.astype(np.uint32) * _MOVE1
        name = own << _2
        self.named[0][self.slot2] = name + np.where(by2, np.minimum((self.name2 & _3) + _1, _3), _1)
        self.named[1][self.slot1] = name + np.where(self.id1 == own, np.minimum((self.name1 & _3) + _1, _3), _1)
        self.two[:m] = self.one[:m]
        self.one[:m] = (own + _1) * _K1
        if self.total % PERIOD == 0:
            self.share_out()


def _cut(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes, as 0 or 1, that move on by 32 bits: ranges of up to 32 bits. Such ranges are cut short if they lie across a border."""
    short = span <= _BOTTOM
    np.minimum(span, (~low & _BOTTOM) + _U1, out=span, where=short)
    return short.astype(np.uint64)


def encode(blocks: list[np.ndarray], prior: Prior) -> list[bytes]:
    """The payload of each block of ids. The blocks must not get longer along the list, and their ids must be in ``prior``."""
    if not blocks:
        return []
    sizes = np.array([len(b) for b in blocks])
    lanes, longest = len(blocks), int(sizes[0])
    ids = np.zeros((longest, lanes), np.uint16)
    for i, b in enumerate(blocks):
        ids[: len(b), i] = b
    model, low, span = _Model(lanes, prior), np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    room = longest + 2  # an id takes less than 32 bits, so a word at most
    out, at = np.zeros(lanes * room, "<u4"), np.arange(lanes) * room
    for t in range(longest):
        m = int(np.searchsorted(-sizes, -t))  # lanes that still have ids
        own, lows, spans = ids[t, :m].astype(np.uint32), low[:m], span[:m]
        model.predict(m)
        by2 = model.id2 == own
        by1 = (model.id1 == own) & ~by2
        begin, width = model.interval(own, by2, by1)
        spans >>= _TOTAL_BITS
        lows += spans * begin
        spans *= width
        model.learn(own, by2, by1)
        out[at[:m]] = lows >> _32  # written over unless it is settled
        settled = _cut(lows, spans)
        at[:m] += settled.view(np.int64)
        settled <<= _U5
        lows <<= settled
        spans <<= settled
    out[at] = (low + _BOTTOM) >> _32  # a range has more than 32 bits, so some number in it ends with that many zeros
    return [out[i * room : at[i] + 1].tobytes() for i in range(lanes)]


def decode(payloads: list[bytes], sizes: list[int], prior: Prior) -> list[np.ndarray]:
    """The ids of each block; the blocks must not get longer along the list."""
    if not payloads:
        return []
    sizes, lanes, longest = np.array(sizes), len(payloads), int(sizes[0])
    room = max(longest, max(len(p) for p in payloads) // 4) + 3
    data = np.zeros((lanes, room), "<u4")
    for i, p in enumerate(payloads):
        data[i, : len(p) // 4] = np.frombuffer(p[: len(p) // 4 * 4], "<u4")
    model, low, span = _Model(lanes, prior), np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    code, data, at = (data[:, 0].astype(np.uint64) << _32) | data[:, 1], data.reshape(-1), np.arange(lanes) * room + 2
    ids = np.zeros((longest, lanes), np.uint16)
    for t in range(longest):
        m = int(np.searchsorted(-sizes, -t))
        lows, spans, codes = low[:m], span[:m], code[:m]
        model.predict(m)
        spans >>= _TOTAL_BITS
        own, by2, by1 = model.find(np.minimum((codes - lows) // spans, _MOST).astype(np.uint32))
        begin, width = model.interval(own, by2, by1)
        lows += spans * begin
        spans *= width
        model.learn(own, by2, by1)
        settled = _cut(lows, spans)
        word = data.take(at[:m]) * settled
        at[:m] += settled.view(np.int64)
        settled <<= _U5
        lows <<= settled
        spans <<= settled
        codes <<= settled
        codes |= word
        ids[t, :m] = own
    return [ids[:n, i].astype(np.uint32) for i, n in enumerate(sizes)]
