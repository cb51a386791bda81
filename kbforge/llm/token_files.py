"""Operator 3, token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

Three orders predict the next id. Order 2 and order 1 name the id that their context (the two ids before, the id before) has
taught them, with a confidence; order 0 gives every id a chance by counts. The chance that order 2 is right, and then order 1, is
mixed from the file's own frequency of it in situations that are alike (confidences, agreement, the ids' frequencies) and an adaptive
estimate of the block: their logits are weighted, and estimates and weights learn after every STRETCH ids. What neither names is
coded by order 0: adaptive counts over CLASSES classes that begin at the file's own frequencies (an id of its own for each frequent
one, classes of like mass for the others, in which the file's counts decide), made chances anew as a block goes on. All chances drive
a range coder of 48 bits. A block of BLOCK ids starts with fresh counts, estimates, contexts and weights, so any block can be decoded
by itself with the file's tables. Whole numbers throughout (also where they stand in doubles): any machine decodes what another one wrote.
All blocks of a file are coded side by side, one vector lane each.

A file is: header, directory of (doc_id, number of ids), table of ids with their counts, table of what came in each situation, then blocks, each with its id count,
payload length and CRC-32. Files come in ascending doc_id order and hold up to FILE_IDS ids, a document never being split
across files. Ids may have up to 32 bits.

Null or empty text: the end id alone. Rows that share a doc_id follow one another, each with its own entry; ties between
them go by its hash. A null doc_id comes first. Other columns are ignored; an empty table gives no file and an empty table.
"""

from __future__ import annotations

import decimal
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbforge.llm import fast_ids, kernel
from kbforge.llm.scratch import written

BLOCK, FILE_IDS, END_ID = 2048, 1 << 22, 0
#: Slots of a context table; classes of order 0, most of them for one id each, and how many of them are searched at a time.
SLOTS, CLASSES, SINGLE, RUN = 1024, 512, 480, 8
#: Confidences and frequency steps of both guesses, and whether they are the same; groups of them; steps between which weights and estimates learn.
SITUATIONS, GROUPS, STRETCH = 512, 32, 32
#: Weight of the file's frequencies when a block begins, and of each id that comes.
PRIOR, COUNT = 4096, 12
MAGIC = b"KBTF0003"
_HEAD = struct.Struct("<8sIIQII")  # magic, documents, blocks, ids, bytes of the table of ids, bytes of what came in each situation
_BLOCK_HEAD = struct.Struct("<III")  # ids, payload words, CRC-32 of the ids
_TOP, _ONE = 1 << 32, 1 << 16
_FOUR = np.uint64(0x0001000100010001)
_NULL = -(1 << 63)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Logit of a chance of 2**12, 256 to the natural unit, and the chance of 2**16 for a logit; in decimal arithmetic, so that every machine has the same."""
    ctx = decimal.Context(prec=30)
    number = lambda x: int(x.to_integral_value())
    logit = [number(256 * ctx.ln(ctx.divide(decimal.Decimal(2 * c + 1), decimal.Decimal(2 * (4096 - c) - 1)))) for c in range(4096)]
    chance = [number(ctx.divide(decimal.Decimal(_ONE), 1 + ctx.exp(ctx.divide(decimal.Decimal(-x), decimal.Decimal(256))))) for x in range(-2047, 2048)]
    return np.array(logit, np.int32), np.clip(np.array(chance, np.int32), 64, _ONE - 64)


_LOGIT, _CHANCE = _tables()
#: Share of 2**16 by which an estimate moves for so many tries.
_PACE = (_ONE // (np.arange(STRETCH + 1) + 12)).astype(np.int32)


def _neutral() -> np.ndarray:
    """Counts of what came in each situation, where a file has none of its own."""
    return np.tile(np.array([2, 1, 4]), (SITUATIONS, 1))


class _Guesses:
    """What order 2 and order 1 (row 0 and 1) of every lane have been taught. Symbols are ids by falling frequency."""

    def __init__(self, lanes: int, counts: np.ndarray):
        # a slot holds 16 * symbol + 4 * step of the symbol's frequency + confidence; symbol -1: nothing yet
        self.known = np.full(2 * lanes * SLOTS, -16, np.int32)
        self.base = np.arange(2 * lanes).reshape(2, lanes) * SLOTS
        step = np.minimum(np.frexp(np.arange(len(counts)) / 16.0)[1].clip(0) // 3, 3)
        self.taught = (np.arange(len(counts)) * 16 + step * 4 + 1).astype(np.int32)
        self.mixed = np.zeros((2, lanes), np.int64)
        self.last = np.zeros(lanes, np.int64)
        self.at, self.held, self.symbols = np.empty_like(self.base), np.empty((2, lanes), np.int32), np.empty((2, lanes), np.int32)
        self.right, self.step, self.change = np.empty((2, lanes), bool), np.empty((2, lanes), np.int32), np.empty((2, lanes), np.int32)

    def look(self) -> np.ndarray:
        """Situation of each lane, after which `symbols` has the two guesses."""
        at = np.right_shift(self.mixed, 5, out=self.at)
        at &= SLOTS - 1
        at += self.base
        self.known.take(at, mode="clip", out=self.held)
        np.right_shift(self.held, 4, out=self.symbols)
        two, one = np.bitwise_and(self.held, 15, out=self.step)
        one <<= 4
        one += two
        two[:] = self.symbols[0] == self.symbols[1]
        two <<= 8
        one += two
        return one

    def learn(self, now: np.ndarray, right: np.ndarray) -> None:
        """right: which guesses are what came."""
        step, change = self.step, self.change
        np.bitwise_and(self.held, 3, out=step)
        change[:] = right
        change <<= 2
        step += change
        _STEP.take(step, mode="clip", out=change)
        kept = self.held
        kept += change
        # confidence below 2 and wrong: taught anew
        np.less(step, 2, out=self.right)
        np.subtract(self.taught.take(now, mode="clip"), kept, out=change)
        change *= self.right
        kept += change
        self.known[self.at] = kept
        p = self.mixed[1]
        np.add(now, 1, out=p)
        np.multiply(p, 40503, out=self.mixed[0])
        self.mixed[0] += self.last
        np.multiply(p, 60493, out=self.last)
        p *= 40503


#: Change of a slot by confidence, where its guess was wrong and where it was right.
_STEP = np.array([0, 0, -1, -1, 1, 1, 1, 0], np.int32)


class _Mix:
    """Chances that order 2 is right (row 0), and order 1 if it isn't (row 1), by groups of situations that are alike in the file. The logits
    of two estimates are weighted: the file's for the group, and the lane's own, which adapts. The lane's weights are learned."""

    def __init__(self, lanes: int, seen: np.ndarray):
        def chances(n: np.ndarray) -> np.ndarray:  # of 2**16
            yes, no = n[:, :2], np.stack([n[:, 1] + n[:, 2], n[:, 2]], axis=1)
            return ((32 * yes + 8) * (_ONE - 1) // (32 * (yes + no) + 40)).T

        two, one = _LOGIT[chances(seen) >> 4]
        same = np.arange(SITUATIONS) > 255
        self.group = np.clip(two + 1024 >> 8, 0, 7) * 4 + np.where(same, 0, np.clip((one + 512) // 384, 0, 2) + 1)
        pooled = np.zeros((GROUPS, 3), np.int64)
        np.add.at(pooled, self.group, seen)
        first = chances(pooled).astype(np.int32)
        self.file = _LOGIT[first >> 4][:, :, None]
        self.own = np.repeat(first[:, :, None], lanes, axis=2)
        self.weights = np.full((2, 2, 1, lanes), _ONE // 2, np.int32)
        self.apart = (np.arange(GROUPS) % 4 > 0).astype(np.int32)[:, None]
        self.lanes = lanes
        #: of 2**16, for a group and lane: 0, order 2 is right, it or order 1 is, 2**16
        self.edges = np.zeros((4, GROUPS, lanes), np.int32)
        self.edges[3] = _ONE

    def settle(self) -> None:
        self.logits = _LOGIT.take(self.own >> 4, mode="clip")
        mixed = self.weights[0] * self.file
        mixed += self.weights[1] * self.logits
        mixed >>= 16
        mixed += 2047
        self.chance = _CHANCE.take(mixed, mode="clip")
        a, b = self.chance
        b = (_ONE - a) * (b >> 1) >> 15
        np.maximum(b, 1, out=b)  # never empty: it may come
        b *= self.apart
        self.edges[1], self.edges[2] = a, a + b

    def learn(self, came: np.ndarray) -> None:
        """came: (event * GROUPS + group) * lanes + lane for all that came since."""
        n = np.bincount(came.ravel(), minlength=3 * GROUPS * self.lanes).astype(np.int32).reshape(3, GROUPS, self.lanes)
        yes, rest = n[:2], n[1] + n[2]
        tries = np.stack([n[0] + rest, rest * self.apart])
        miss = (yes << 16) - tries * self.chance >> 6
        self.weights[0, :, 0] += (miss * self.file >> 10).sum(1, dtype=np.int32)
        self.weights[1, :, 0] += (miss * self.logits >> 10).sum(1, dtype=np.int32)
        np.clip(self.weights, 0, 2 * _ONE, out=self.weights)
        miss = (yes << 16) - tries * self.own >> 6
        miss *= _PACE.take(tries, mode="clip")
        miss >>= 10
        self.own += miss
        np.clip(self.own, 0, _ONE - 1, out=self.own)


class _Classes:
    """Order 0: classes of symbols, the lanes' counts of them, and what a file's counts say within a class."""

    def __init__(self, lanes: int, counts: np.ndarray):
        total = int(counts.sum())
        rest = counts[SINGLE:]
        mass = np.cumsum(rest) - rest
        of = np.concatenate([np.arange(min(SINGLE, len(counts))), SINGLE + mass * (CLASSES - SINGLE) // max(int(rest.sum()), 1)])
        inside = np.bincount(of, counts, CLASSES).astype(np.int64)
        self.of, self.size, self.last = of.astype(np.int16), inside, inside - 1
        self.below = np.cumsum(inside) - inside  # counts of all classes before
        self.begin = np.cumsum(counts) - counts - self.below[of]
        members = np.bincount(of, minlength=CLASSES)
        self.many, self.first = members > 1, (np.cumsum(members) - members).astype(np.int32)
        self.has = np.cumsum(members > 0, dtype=np.int32)
        prior = np.where(inside > 0, np.maximum(1, inside * PRIOR // total), 0)
        self.lanes, self.held = lanes, np.tile(prior.astype(np.int32), (lanes, 1))
        self.lane_index = np.arange(lanes)
        self.lane, self.coarse_lane = self.lane_index * (CLASSES + 1), self.lane_index * (CLASSES // RUN**2)
        self.stops = np.zeros((lanes, CLASSES + 1), np.int32)
        self.after = self.stops.ravel()[1:]  # where each class ends

    def settle(self) -> None:
        """Makes chances of 2**16 of the counts so far."""
        upto = np.cumsum(self.held, axis=1, dtype=np.int32)
        share = np.multiply(upto, float(_ONE - int(self.has[-1])))
        share /= upto[:, -1:]
        self.stops[:, 1:] = share  # below 2**53, so that the quotient's whole part is exact
        self.stops[:, 1:] += self.has

    def add(self, classes: np.ndarray, lengths: np.ndarray) -> None:
        """Counts a stretch of classes, one row a lane, of which lengths[i] count."""
        at = classes + (np.arange(self.lanes) * CLASSES)[:, None]
        if int(lengths.min()) < at.shape[1]:
            at = at[np.arange(at.shape[1]) < lengths[:, None]]
        self.held += COUNT * np.bincount(at.ravel(), minlength=self.held.size).reshape(self.held.shape)

    def index(self) -> None:
        """For find(): the last values of classes, of runs of RUN classes, and of RUN such runs."""
        ends = (self.stops[:, 1:] - 1).astype(np.uint16)
        self.fine = ends.reshape(-1, RUN)
        self.middle = np.ascontiguousarray(ends[:, RUN - 1 :: RUN]).reshape(-1, RUN)
        self.coarse = np.ascontiguousarray(ends[:, RUN * RUN - 1 :: RUN * RUN].T)

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, start and stop at a value of each lane."""
        value = value.astype(np.uint16)
        wanted = np.empty((self.lanes, RUN // 4), np.uint64)
        wanted[:] = (value * _FOUR)[:, None]
        wanted = wanted.view(np.uint16)
        at = self.coarse_lane + np.add.reduce((self.coarse < value).view(np.int8), axis=0, dtype=np.int8)
        for ends in (self.middle, self.fine):
            before = ends.take(at, axis=0, mode="clip") < wanted
            at *= RUN
            at += np.bitwise_count(before.view(np.uint64)).ravel()
        c = at & (CLASSES - 1)
        at += self.lane_index
        return c, self.stops.ravel().take(at, mode="clip"), self.after.take(at, mode="clip")


def _stretches(width: int) -> list[tuple[int, int]]:
    """Steps between which the counts of order 0 are made chances anew: STRETCH, then twice as far each time, 256 at most."""
    cuts = [0]
    while cuts[-1] < width:
        cuts.append(min(width, min(max(STRETCH, 2 * cuts[-1]), cuts[-1] + 256)))
    return list(zip(cuts, cuts[1:]))


def _walk(blocks: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every step and lane: the situation, and what comes (0: order 2 is right, 1: order 1 is, 2: neither); how often each did in each situation."""
    columns = np.ascontiguousarray(blocks.T)
    width, lanes = columns.shape
    guesses = _Guesses(lanes, counts)
    situations, events = np.empty((width, lanes), np.int16), np.empty((width, lanes), np.int8)
    right = np.empty((2, lanes), bool)
    two, one = right.view(np.int8)
    for t in range(width):
        situations[t] = guesses.look()
        np.equal(guesses.symbols, columns[t], out=right)
        event = events[t]
        np.add(two, two, out=event)
        np.maximum(event, one, out=event)
        np.subtract(2, event, out=event)
        guesses.learn(columns[t], right)
    seen = np.zeros(SITUATIONS * 3, np.int64)
    for t in range(0, width, STRETCH):
        at = situations[t : t + STRETCH] * np.int64(3) + events[t : t + STRETCH]
        if t + STRETCH > int(lengths[-1]):
            at = at[np.arange(t, min(t + STRETCH, width))[:, None] < lengths]
        seen += np.bincount(at.ravel(), minlength=len(seen))
    return situations, events, seen.reshape(-1, 3)


def encode_blocks(blocks: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Rows of symbols, of which the first lengths[i] count, longest rows first, to payloads. counts: of all symbols in the file."""
    return _encoded(blocks, lengths, counts, *_walk(blocks, lengths, counts)[:2], _neutral())


def _encoded(blocks: np.ndarray, lengths: np.ndarray, counts: np.ndarray, situations: np.ndarray, events: np.ndarray, seen: np.ndarray) -> list[bytes]:
    lanes, width = blocks.shape
    out = np.zeros((3 * width + 16) * lanes, np.uint32)
    lane = np.arange(lanes)
    at = lane.copy()  # where a lane's next word goes; words of all lanes lie side by side
    # what is put out may grow by a carry later on, which bit 16 of the next word shows
    low, size = np.zeros(lanes, np.int64), np.full(lanes, (1 << 48) - 1)
    part, step = np.empty_like(low), np.empty_like(low)
    mix, classes = _Mix(lanes, seen), _Classes(lanes, counts)

    def settle(own: np.ndarray) -> None:
        """Puts out what is decided; afterwards a range is 2**32 at least."""
        while len(own):
            l, place, s = low.take(own), at.take(own), size.take(own)
            s <<= 16
            out[place] = l >> 32
            place += lanes
            at[own] = place
            l &= 0xFFFFFFFF
            l <<= 16
            low[own], size[own] = l, s
            own = own[s < _TOP]

    for first, last in _stretches(width):
        classes.settle()
        stops = classes.stops.ravel()
        of = classes.of.take(blocks[:, first:last])
        place = of + classes.lane[:, None]
        begins = stops.take(place, mode="clip")
        breadths = classes.after.take(place, mode="clip") - begins
        columns, of_columns, begins, breadths, many_columns = (np.ascontiguousarray(x.T) for x in (blocks[:, first:last], of, begins, breadths, classes.many.take(of)))
        for a in range(first, last, STRETCH):
            b = min(a + STRETCH, last)
            mix.settle()
            now, event = slice(a - first, b - first), events[a:b]
            c, starts, wides, many = of_columns[now], begins[now], breadths[now], many_columns[now]
            neither = event == 2
            if ended := b > int(lengths[-1]):
                valid = np.arange(a, b)[:, None] < lengths
                neither &= valid
            starts *= neither
            wides = (wides - _ONE) * neither + _ONE
            many &= neither
            group = mix.group.take(situations[a:b]) * lanes + lane
            came = event * np.int64(GROUPS * lanes) + group
            edges = mix.edges.ravel()
            start = edges.take(came, mode="clip")
            wide = edges.take(came + GROUPS * lanes, mode="clip") - start
            if ended:
                start *= valid
                wide = (wide - _ONE) * valid + _ONE
            for t in range(b - a):
                for x, y in ((start[t], wide[t]), (starts[t], wides[t])):
                    np.right_shift(size, 16, out=part)
                    np.multiply(part, x, out=step)
                    np.add(low, step, out=low)
                    np.multiply(part, y, out=size)
                settle(np.flatnonzero(size < _TOP))
                more = np.flatnonzero(many[t])
                if len(more):
                    s = columns[a - first + t].take(more)
                    left = (size.take(more) / classes.size.take(c[t].take(more))).astype(np.int64)
                    low[more] += left * classes.begin.take(s)
                    left *= counts.take(s)
                    size[more] = left
                    settle(more[left < _TOP])
            mix.learn(came[valid] if ended else came)
        classes.add(of, lengths - first)
    for _ in range(3):
        out[at] = low >> 32
        low = (low & 0xFFFFFFFF) << 16
        at += lanes
    used = at // lanes
    words = np.ascontiguousarray(out.reshape(-1, lanes)[: int(used.max())].T)
    carry = words >> 16
    while carry.any():
        words &= 0xFFFF
        words[:, :-1] += carry[:, 1:]
        carry = words >> 16
    words = words.astype("<u2")
    return [row[:n].tobytes() for row, n in zip(words, used)]


def decode_blocks(payloads: list[bytes], lengths: np.ndarray, counts: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """The rows that encode_blocks was given."""
    lanes, width = len(payloads), int(lengths.max(initial=0))
    words = np.zeros((lanes, max(len(p) for p in payloads) // 2 + 8), np.uint16)
    for row, p in zip(words, payloads):
        row[: len(p) // 2] = np.frombuffer(p, "<u2")
    # whole numbers below 2**53: products and differences are exact, and so are quotients' whole parts
    code = words[:, 0] * 2.0**32 + words[:, 1] * 2.0**16 + words[:, 2]
    at = np.arange(lanes) * words.shape[1] + 3  # a lane that has ended goes on with whatever comes, which nobody reads
    words = words.ravel()
    size = np.full(lanes, 2.0**48 - 1)
    guesses, mix, classes = _Guesses(lanes, counts), _Mix(lanes, _neutral() if seen is None else seen), _Classes(lanes, counts)
    which = np.repeat(np.arange(len(counts), dtype=np.int32), counts)  # symbol of each of the file's ids, in the order of symbols
    lane = np.arange(lanes)
    out = np.zeros((width, lanes), np.int32)
    part, step, value = np.empty_like(code), np.empty_like(code), np.empty(lanes, np.int32)
    right = np.empty((2, lanes), bool)
    two, one = right
    came = np.empty((STRETCH, lanes), np.int64)

    def settle(own: np.ndarray) -> None:
        while len(own):
            place, s, c = at.take(own), size.take(own), code.take(own)
            c *= 2.0**16
            c += words.take(place, mode="clip")
            place += 1
            s *= 2.0**16
            code[own], at[own], size[own] = c, place, s
            own = own[s < _TOP]

    def seek() -> None:
        """Value at which the code lies, of 2**16."""
        np.multiply(size, 2.0**-16, out=part)
        np.floor(part, out=part)
        np.divide(code, part, out=step)
        np.minimum(step, _ONE - 1, out=step)
        value[:] = step

    def cut(start: np.ndarray, wide: np.ndarray) -> None:
        np.multiply(part, start.astype(np.float64), out=step)
        np.subtract(code, step, out=code)
        np.multiply(part, wide.astype(np.float64), out=size)

    for first, last in _stretches(width):
        classes.settle()
        classes.index()
        for a in range(first, last, STRETCH):
            b = min(a + STRETCH, last)
            mix.settle()
            ones, boths = mix.edges[1].ravel(), mix.edges[2].ravel()
            for t in range(a, b):
                place = mix.group.take(guesses.look(), mode="clip")
                place *= lanes
                place += lane
                seek()
                one, both = ones.take(place, mode="clip"), boths.take(place, mode="clip")
                past, not_two = value >= both, value >= one
                event, gone = not_two.view(np.int8) + past.view(np.int8), past.astype(np.int32)
                event = event.astype(np.int64)
                event *= GROUPS * lanes
                np.add(place, event, out=came[t - a])
                # of an event: 0 to one, one to both, both to 2**16
                stop = _ONE - both
                both -= one
                stop *= gone
                gone *= both
                later = not_two.astype(np.int32)
                start = one * later
                start += gone
                later *= both
                stop += later
                stop += one
                stop -= start
                cut(start, stop)
                seek()
                c, start, stop = classes.find(value)
                stop -= start
                start *= past
                stop -= _ONE
                stop *= past
                stop += _ONE
                cut(start, stop)
                settle(np.flatnonzero(size < _TOP))
                now = out[t]
                a2, a1 = guesses.symbols
                np.subtract(a1, a2, out=now)
                now *= not_two
                now += a2
                fresh = classes.first.take(c, mode="clip")
                fresh -= now
                fresh *= past
                now += fresh
                more = np.flatnonzero(classes.many.take(c, mode="clip") & past)
                if len(more):
                    own = c.take(more)
                    left = size.take(more)
                    left /= classes.size.take(own)
                    np.floor(left, out=left)
                    within = (code.take(more) / left).astype(np.int64)
                    np.minimum(within, classes.last.take(own), out=within)
                    within += classes.below.take(own)
                    s = which.take(within, mode="clip")
                    now[more] = s
                    of_more = left * classes.begin.take(s)
                    code[more] -= of_more
                    left *= counts.take(s)
                    size[more] = left
                    settle(more[left < _TOP])
                np.equal(guesses.symbols, now, out=right)
                guesses.learn(now, right)
            mix.learn(came[: b - a])
        classes.add(np.ascontiguousarray(classes.of.take(out[first:last]).T), np.full(lanes, last - first))
    return np.ascontiguousarray(out.T)


def write_file(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """Documents as (doc_id, ids) to a file's bytes."""
    ids = np.concatenate([x for _, x in docs]).astype(np.uint32)
    if int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        names, which = np.flatnonzero(counts).astype(np.uint32), ids
        symbol, counts = np.zeros(len(counts), np.int32), counts[names]
        order = np.argsort(-counts, kind="stable")
        symbol[names[order]] = np.arange(len(order))
    else:
        names, which, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        symbol = np.empty(len(order), np.int32)
        symbol[order] = np.arange(len(order))
    n = -(-len(ids) // BLOCK)
    lengths = np.minimum(BLOCK, len(ids) - np.arange(n) * BLOCK)
    rows = np.zeros(n * BLOCK, np.int32)
    symbol.take(which, out=rows[: len(ids)], mode="clip")
    rows = rows.reshape(n, BLOCK)[:, : int(lengths.max())]
    *walk, seen = _walk(rows, lengths, counts[order])
    payloads = _encoded(rows, lengths, counts[order], *walk, seen)
    table = zlib.compress(names[order].astype("<u4").tobytes() + counts[order].astype("<u4").tobytes())
    came = zlib.compress(seen.astype("<u4").tobytes())
    out = [_HEAD.pack(MAGIC, len(docs), n, len(ids), len(table), len(came)), np.array([_NULL if d is None else d for d, _ in docs], "<i8").tobytes(), np.array([len(x) for _, x in docs], "<u4").tobytes(), table, came]
    for k, p in enumerate(payloads):
        own = ids[k * BLOCK : k * BLOCK + lengths[k]].astype("<u4").tobytes()
        out += (_BLOCK_HEAD.pack(int(lengths[k]), len(p) // 2, zlib.crc32(own)), p)
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


def read_file(data: bytes) -> list[tuple[int | None, np.ndarray]]:
    """The documents of a file; ValueError if a checksum fails."""
    if len(data) < _HEAD.size + 4 or data[:8] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a token file, or damaged")
    _, n_docs, n, total, table_size, came_size = _HEAD.unpack_from(data)
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    sizes = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs)
    at += 12 * n_docs
    names, counts = np.frombuffer(zlib.decompress(data[at : at + table_size]), "<u4").reshape(2, -1)
    at += table_size
    seen = np.frombuffer(zlib.decompress(data[at : at + came_size]), "<u4").reshape(-1, 3).astype(np.int64)
    at += came_size
    lengths, payloads, sums = [], [], []
    for _ in range(n):
        m, words, crc = _BLOCK_HEAD.unpack_from(data, at)
        at += _BLOCK_HEAD.size
        lengths.append(m)
        payloads.append(data[at : at + 2 * words])
        sums.append(crc)
        at += 2 * words
    rows = decode_blocks(payloads, np.array(lengths), counts.astype(np.int64), seen)
    ids = names[np.concatenate([row[:m] for row, m in zip(rows, lengths)])]
    for k, (m, crc) in enumerate(zip(lengths, sums)):
        if zlib.crc32(ids[k * BLOCK : k * BLOCK + m].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
    if len(ids) != total:
        raise ValueError("ids are missing")
    cut = np.cumsum([0, *sizes.tolist()])
    return [(None if d == _NULL else int(d), ids[a:b]) for d, a, b in zip(doc_ids, cut, cut[1:])]


def token_files(docs: DataFrame, tokenizer_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Rows (part, file, before, n_ids, content): complete files; (part, file) ascending is doc_id ascending. before counts the ids of the part's files before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.keep_freed()
        reader = fast_ids.reader(tokenizer_path, pattern)
        part, file, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        end = np.array([END_ID], reader.dtype)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "file": file, "before": before, "n_ids": size, "content": write_file(held)}], _FILE)

        for batch in batches:
            for lo, hi, flat, ends in reader.slices(batch.column(1)):
                for doc, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                    if held and size + b - a + 1 > FILE_IDS:
                        yield done()
                        file, before, held, size = file + 1, before + size, [], 0
                    held.append((doc, np.concatenate([flat[a:b], end])))
                    size += b - a + 1
        if held:
            yield done()
        held = []
        kernel.release()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one doc_id, or one row, may stand there very often: its copies are dealt on by the text's hash, then as they come
    order = ["doc_id", "_h", "_tie"]
    rows = docs.select("doc_id", F.col(text).alias("text")).withColumns({"_h": F.xxhash64("text"), "_tie": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return ordered.mapInArrow(run, "part int, file int, before bigint, n_ids bigint, content binary")


_FILE = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("content", pa.binary())])


def read_back(files: DataFrame) -> DataFrame:
    """Files to rows (doc_id, start, n_tokens, ids_crc32); start counts the ids of all files and documents before."""
    # one row a part, so a task can add them up and every task may hold them
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    begin = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.keep_freed()
        for batch in batches:
            for k in range(batch.num_rows):
                docs = read_file(batch.column("content")[k].as_py())
                n = np.array([len(x) for _, x in docs], np.int64)
                start = batch.column("start")[k].as_py() + np.cumsum(n) - n
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for _, x in docs]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array(start), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        kernel.release()

    placed = files.join(F.broadcast(begin), "part").select((F.col("begin") + F.col("before")).alias("start"), "content")
    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return read_back(written(token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), "token-files"))
