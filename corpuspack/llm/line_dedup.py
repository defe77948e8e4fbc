"""Duplicate and nearly equal lines: an edit join on the rarest stretches of each line.

Two different lines are linked if their edit distance is at most t, one edit per
``chars_per_edit`` code points of the longer one (and at most ``edits``, if given).

t edits leave t + 1 pieces of a line, so two linked lines have a stretch in common that is as long
as their length over t + 1. All stretches of q code points (grams) stand in one order, rare ones
first by a sample of the corpus. Of every stretch of that length a line has a row for the first gram
in this order: in a stretch in common it is the same gram, so every link shares one, for any t. Grams
that lie too far apart in the two lines, in lines too different in length, or beside characters that
differ too soon for a stretch in common are no candidates, and of the grams of a stretch in common only
the first one gives the pair. The others are verified by bit-parallel edit distance, beyond ``BAND``
edits by how far the table's diagonals get, of many pairs at a time.

Lines are taken in ``BANDS`` bands by their length, one after the other, each with the lines a
little longer that its own may be linked with; a band's rows go when its pairs are written.

Grams are compared inside tasks: a bucket of grams is sorted and its lines paired there, so only
pairs that may be linked become rows. A gram that by the sample occurs more than ``BLOCK`` times is
cut into blocks of lines, and two blocks at a time meet in a place of their own.

Equal lines are one class first (128-bit hashes), so copies are never paired. Pairs name lines by
``ID_BITS`` of them; lines with the same bits are candidates of each other. A class stands at
its first occurrence. A line is kept if it is the first of its class and no earlier class is
linked with it.

Lines are the texts' parts between line feeds that have a word. Defined results: null or empty
text has no line; lines without a word are left out; lines shorter than ``chars_per_edit`` only
equal their copies; null ids come first, repeated rows with one doc_id are told apart by nothing
and count as copies; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.llm import common
from corpuspack.session import materialize

CHARS_PER_EDIT = 20
#: Code points of a gram, as long as lines of any length hold enough that don't overlap.
GRAM = 9
#: Longest stretch that grams are chosen in, a rarity (1/16 bits) that no gram exceeds, and steps of it that count as one.
LONGEST_RUN, RAREST, RARITY_STEP = 64, 4095, 64
#: Bits of a gram's hash by which grams are counted, and code points of the sample they are counted in.
COUNTED_BITS, SAMPLE_CHARS = 20, 8_000_000
#: Rows (a line's gram each) that a task holds before it gives them out, and of a bucket.
HELD_ROWS, BUCKET_ROWS = 1 << 18, 1 << 20
#: Lines that a place is meant to hold at most, and how often the mean class of grams a class must
#: occur to be dealt in blocks.
BLOCK, ABOVE_MEAN = 1 << 14, 16
#: Pairs of rows that are compared at once.
COMPARED = 1 << 18
#: Largest length and place that a row tells from larger ones.
FAR = (1 << 16) - 1
#: Sides of up to this many ids of 8 bytes (16 MB) are broadcast after they were counted.
BROADCAST_IDS = 2_000_000
#: Bands of lines by their length, of about as many code points each.
BANDS = 3
#: Session's setting by which Spark drops shuffled files at a query's end.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Edits that a band of 64 bits has room for, pairs whose bands are moved on together, and letters told apart there.
BAND, BANDED_PAIRS, LETTERS = 62, 2000, 254
#: Most edits up to which the diagonals of many pairs are moved on together, and diagonals held for that.
REACHING, STATES = 256, 1 << 16
#: Bytes of text and pairs that are verified at once.
VERIFIED, VERIFIED_PAIRS = 8 << 20, 8000
#: Bytes of text taken at once, so that its arrays stay in the processor's cache.
SLICE = 1 << 19
#: Lines that a task remembers to have given out.
SEEN = 500_000

_MULTIPLIER = 0x2545F4914F6CDD1D
_BACK = pow(_MULTIPLIER, -1, 1 << 64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(which: str, n: int) -> np.ndarray:
    if len(_POWERS[which]) < n:
        grown = np.full(max(n, 1 << 16), np.uint64(_MULTIPLIER if which == "up" else _BACK))
        grown[0] = 1
        _POWERS[which] = np.multiply.accumulate(grown)
    return _POWERS[which][:n]


_COMMON = {k: common.mix((np.arange(1 << 14, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k))
           for k in (1, 2)}


def _values(points: np.ndarray, which: int) -> np.ndarray:
    """A random-looking number for each code point, of two independent kinds."""
    out = _COMMON[which].take(points, mode="clip")
    rare = np.flatnonzero(points >= len(_COMMON[which]))
    out[rare] = common.mix((points[rare].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * which))
    return out


def _space(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13))


class Lines:
    """The lines with a word of some texts as code points, with sums that hash any stretch."""

    def __init__(self, texts: list[str | None]):
        texts = texts or [None]
        whole = "\n".join(t or "" for t in texts) + "\n"
        self.points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        end = np.flatnonzero(self.points == 10)
        start = np.concatenate(([0], end[:-1] + 1))
        per_text = np.array([(t or "").count("\n") + 1 for t in texts], np.int64)
        self.text = np.repeat(np.arange(len(texts)), per_text)
        self.number = np.arange(len(start)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        full = ~_space(self.points[start])  # an empty line begins with its line feed
        for k in np.flatnonzero(~full & (end > start)).tolist():
            full[k] = not _space(self.points[start[k]:end[k]]).all()
        self.start, self.end, self.text, self.number = start[full], end[full], self.text[full], self.number[full]
        self.value = _values(self.points, 1)
        self.low = self.value.astype(np.uint16)
        self.sums = self._sums(self.value)

    def _sums(self, value: np.ndarray) -> np.ndarray:
        out = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * _powers("up", len(value)), out=out[1:])
        return out

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return common.mix((self.sums[end] - self.sums[start]) * _powers("down", len(self.points))[start])

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each line."""
        first = self.hash(self.start, self.end)
        other = self._sums(_values(self.points, 2))
        second = common.mix((other[self.end] - other[self.start]) * _powers("down", len(self.points))[self.start])
        return first, second + (self.end - self.start).astype(np.uint64)

    def strings(self) -> list[str]:
        raw = self.points.tobytes()
        return [raw[4 * a:4 * b].decode("utf-32-le") for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]

    def grams(self, size: int) -> np.ndarray:
        """Hash of the ``size`` code points from each place on."""
        n = max(0, len(self.points) - size + 1)
        return common.mix((self.sums[size:size + n] - self.sums[:n]) * _powers("down", len(self.points))[:n])


def allowed(chars: np.ndarray, edits: int | None, chars_per_edit: int) -> np.ndarray:
    """Edits between two lines of which the longer one has ``chars`` code points."""
    t = chars // chars_per_edit
    return t if edits is None else np.minimum(t, edits)


def gram_size(chars_per_edit: int) -> int:
    """Code points of a gram: a line that can have t edits holds t + 1 grams that don't overlap."""
    if chars_per_edit < 3:
        raise ValueError("chars_per_edit must be 3 at least")
    return max(1, min(GRAM, (chars_per_edit - 1) // 2))


def common_run(chars: np.ndarray, edits: int | None, chars_per_edit: int) -> np.ndarray:
    """Code points that a line has in one piece in common with any line linked with it, at least:
    t edits leave t + 1 pieces; 0 if no other line can be linked."""

    def run(longer):
        t = allowed(longer, edits, chars_per_edit)
        return np.where(t > 0, longer // (t + 1), np.iinfo(np.int64).max)

    next_ = (chars // chars_per_edit + 1) * chars_per_edit  # the longer line's length, where it allows an edit more
    least = np.minimum(run(chars), np.where(next_ <= chars * chars_per_edit // (chars_per_edit - 1), run(next_), np.iinfo(np.int64).max))
    return np.where(least < np.iinfo(np.int64).max, least, 0)


def sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """Least (or largest) of each n values in a row."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x, have = least(x[:len(x) - step], x[step:]), have + step
    return x


def chosen_grams(lines: Lines, rows: np.ndarray, order: np.ndarray, size: int, edits: int | None, chars_per_edit: int
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first grams by ``order`` (above 0) within each stretch of a line of ``rows``
    that is as long as what linked lines have in common, and each one's line.

    Of two lines the one with the shorter stretch has all that the other one has of a longer one.
    """
    run = np.minimum(common_run((lines.end - lines.start)[rows], edits, chars_per_edit), LONGEST_RUN)
    places, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in np.unique(run[run > 0]).tolist():
        some, n = rows[run == r], r - size + 1
        count = lines.end[some] - lines.start[some] - size + 1
        some, count = some[count >= n], count[count >= n]
        first = np.cumsum(count) - count
        at = np.arange(count.sum()) + np.repeat(lines.start[some] - first, count)
        here = order[at]
        least = sliding(here, n, np.minimum)
        for k in range(1, n):  # no stretch goes over a line's end
            least[(first + count - k)[:-1]] = 0
        padded = np.zeros(len(here) + n - 1, here.dtype)
        padded[n - 1:n - 1 + len(least)] = least
        taken = np.flatnonzero(sliding(padded, n, np.maximum) == here)
        places.append(at[taken])
        of.append(some[np.searchsorted(first, taken, "right") - 1])
    return np.concatenate(places), np.concatenate(of)


def bit_distance(a: np.ndarray, b: np.ndarray, edits: int) -> int:
    """Edit distance of two rows of code points, edits + 1 if above ``edits``: what is equal at
    both ends is cut off, then a column of the table is a pair of numbers of len(a) bits."""
    if abs(len(a) - len(b)) > edits:
        return edits + 1
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    first = int(other[0]) if len(other) else n
    a, b, n = a[first:], b[first:], n - first
    other = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
    last = int(other[0]) if len(other) else n
    a, b = a[:len(a) - last].tolist(), b[:len(b) - last].tolist()
    if not a or not b:
        return min(len(a) + len(b), edits + 1)
    places: dict[int, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole, top, score, left = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a), len(b)
    up, down = whole, 0
    for c in b:
        equal = places.get(c, 0)
        across = (((equal & up) + up) ^ up) | equal
        more, less = down | (whole & ~(across | up)), up & across
        left -= 1
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        if score - left > edits:
            return edits + 1
        more, less = (more << 1) | 1, less << 1
        steep = equal | down
        up, down = (less | ~(steep | more)) & whole, more & steep & whole
    return score


def in_common(a: str, b: str, i: int, j: int) -> int:
    """Number of characters that a from i on and b from j on begin with alike."""
    n = min(len(a) - i, len(b) - j)
    if n <= 0 or a[i] != b[j]:
        return 0
    k, step = 1, 8
    while k < n:
        step = min(step, n - k)
        if a[i + k:i + k + step] != b[j + k:j + k + step]:
            break
        k, step = k + step, 2 * step
    else:
        return n
    while step > 1:  # they differ within the next ``step``
        half = step // 2
        if a[i + k:i + k + half] == b[j + k:j + k + half]:
            k, step = k + half, step - half
        else:
            step = half
    return k


def distance(a: str, b: str, edits: int) -> int:
    """Edit distance of two texts, edits + 1 if above ``edits``: for 0, 1, ... edits how far in a each
    diagonal of the table gets; by ``bit_distance`` once that takes longer."""
    off = len(b) - len(a)
    if abs(off) > edits:
        return edits + 1
    first = in_common(a, b, 0, 0)
    if first == len(a) == len(b):
        return 0
    none, left = -1 << 62, 2 * (len(a) - first) + 64
    reached, low = [first], 0  # of the diagonals (place in b less place in a) from low on
    for e in range(1, edits + 1):
        from_, until = max(-e, off - edits + e), min(e, off + edits - e)
        padded, now = [none, none, *reached, none, none], []  # from_ is low - 1 at least, until one more than before at most
        for k in range(from_, until + 1):
            at = k - low + 2
            i = max(padded[at] + 1, padded[at - 1], padded[at + 1] + 1)
            if i >= 0:
                i = min(i, len(a), len(b) - k)
                i += in_common(a, b, i, i + k)
                if k == off and i == len(a):
                    return e
            now.append(i)
        reached, low, left = now, from_, left - len(now)
        if left < 0:
            points = [np.frombuffer(x[first:].encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b)]
            return bit_distance(*points, edits)
    return edits + 1


def banded(code: np.ndarray, kinds: int, at_a: np.ndarray, at_b: np.ndarray, n: np.ndarray, m: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Edit distances of pairs with 1 to ``BAND`` edits at most (fewer than a has characters), some
    more if above: a diagonal band of 64 bits, of all pairs a column at a time, that goes on below a's end.
    It ends as far off as a way to the last cell can go. The texts are the n (m, rising) numbers below
    ``kinds`` from at_a (at_b) on."""
    u, one = np.uint64, np.uint64(1)
    ahead, width = (edits + n - m) // 2, int(m.max())
    rows, columns = np.full((len(n), width + 192), kinds, code.dtype), np.zeros((len(n), width + 64), code.dtype)
    for table, at, size, shift in ((rows, at_a, n, 63 - ahead), (columns, at_b, m, np.zeros(len(n), np.int64))):
        room = np.minimum(size, table.shape[1] - shift)
        for k, (first, many, to) in enumerate(zip(at.tolist(), room.tolist(), shift.tolist(), strict=True)):
            table[k, to:to + many] = code[first:first + many]
    up, down = ~u(0) << (63 - ahead).astype(u), np.zeros(len(n), u)
    score, below = ahead, ahead + m - n  # at the band's last row, and how far that one is below a's end at the last column
    most, done, pair, bits = edits + below, edits + 1, np.arange(len(n)), one << np.arange(64, dtype=u)

    def places(first: int) -> np.ndarray:
        """Where in 64 of a's places each number is, a bit for each place: of all pairs number by number."""
        out = np.zeros((kinds + 1) * len(pair), u)
        at = rows[pair, first:first + 64].astype(np.int32) * np.int32(len(pair)) + np.arange(len(pair), dtype=np.int32)[:, None]
        np.add.at(out, at.ravel(), np.broadcast_to(bits, at.shape).ravel())
        return out

    here = places(0)
    for block in range(0, width, 64):
        left = (score <= most) & (block < m)
        if not left.all():
            here = here.reshape(kinds + 1, -1)[:, left].ravel()
            up, down, score, below, most, pair, m = (x[left] for x in (up, down, score, below, most, pair, m))
            if not len(pair):
                return done
        ahead = places(block + 64)
        column = columns[pair, block:block + 64].T.astype(np.int32) * np.int32(len(pair)) + np.arange(len(pair), dtype=np.int32)
        ends = np.searchsorted(m, np.arange(block, block + 66))
        for i in range(block, min(width, block + 64)):
            at, shift = column[i - block], u(i - block)
            equal = here.take(at) >> shift
            if i > block:
                equal |= ahead.take(at) << (u(64) - shift)
            steep = equal & up
            steep += up
            steep ^= up
            steep |= equal
            steep |= down
            more = ~(steep | up)
            more |= down
            less = steep & up
            score = score + ((steep >> u(63)) ^ one).view(np.int64)
            steep >>= one
            up = steep | more
            np.invert(up, out=up)
            up |= less
            down = steep & more
            if ends[i - block + 1] < ends[i - block + 2]:
                k = slice(*ends[i - block + 1:i - block + 3])
                beyond = ((one << below[k].astype(u)) - one) << (63 - below[k]).astype(u)
                done[pair[k]] = score[k] - np.bitwise_count(up[k] & beyond) + np.bitwise_count(down[k] & beyond)
        here = ahead
    return done


def words_from(points: np.ndarray, at: np.ndarray, size: np.ndarray, pad: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The eight bytes from each character of some texts on, ``pad`` behind a text's end, and where each text begins."""
    width, per = np.dtype(kind).itemsize, 8 // np.dtype(kind).itemsize
    start = np.cumsum(size + per) - size - per
    table = np.full(int((size + per).sum()) + per, pad, kind)
    for first, many, to in zip(at.tolist(), size.tolist(), start.tolist(), strict=True):
        table[to:to + many] = points[first:first + many]
    return np.lib.stride_tricks.as_strided(table.view(np.uint8), (len(table) - per + 1, 8), (width, 1)).copy().view("<u8").ravel(), start


def reaching(points: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, n: np.ndarray, m: np.ndarray, edits: np.ndarray, kind: type) -> np.ndarray:
    """Edit distances of pairs, one more than ``edits`` if above: for 0, 1, ... edits how far in a each
    diagonal of the table gets, of all pairs at a time. ``kind`` holds every character and two more."""
    per, top, one = 8 // np.dtype(kind).itemsize, np.iinfo(kind).max, np.uint64(1)
    (words_a, at_a), (words_b, at_b) = words_from(points, at_a, n, top, kind), words_from(points, at_b, m, top - 1, kind)
    done, pair = edits + 1, np.arange(len(n))
    low, high, none = -((edits - m + n) // 2), (edits + m - n) // 2, -(1 << 30)  # diagonals that a way with so many edits touches
    diagonal = low[:, None] + np.arange(int((high - low).max()) + 1)
    most = np.where(diagonal > high[:, None], none, np.minimum(n[:, None], m[:, None] - diagonal)).astype(np.int32)
    at_b, goal, start = at_b[:, None] + diagonal, m - n - low, -low
    width = diagonal.shape[1]
    reached = np.full((len(n), width + 2), none, np.int32)
    for e in range(int(edits.max()) + 1):
        from_, until = max(0, int(start.min()) - e), min(width, int(start.max()) + e + 1)
        if e:
            now = np.maximum(reached[:, from_ + 1:until + 1], reached[:, from_ + 2:until + 2]) + np.int32(1)
            now = np.minimum(np.maximum(now, reached[:, from_:until]), most[:, from_:until])
        else:
            now = np.full((len(pair), until - from_), none, np.int32)
            now[np.arange(len(pair)), start - from_] = 0
        flat = now.ravel()
        live = np.flatnonzero(flat >= 0)
        i = flat[live].astype(np.int64)
        x, y, on = at_a[live // (until - from_)] + i, at_b[:, from_:until].ravel()[live] + i, np.arange(len(live))
        while len(on):
            other = words_a[x] ^ words_b[y]
            i[on] += np.bitwise_count((other & (~other + one)) - one) // (64 // per)
            going = np.flatnonzero(other == 0)
            on, x, y = on[going], x[going] + per, y[going] + per
        flat[live] = i
        reached[:, from_ + 1:until + 1] = now
        ended = reached[np.arange(len(pair)), goal + 1] >= n
        done[pair[ended]] = e
        left = ~ended & (edits > e)
        if not left.all():
            pair, n, edits, most, at_a, at_b, reached, goal, start = (
                v[left] for v in (pair, n, edits, most, at_a, at_b, reached, goal, start))
            if not len(pair):
                break
    return done


def unlike(points: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """By how much the numbers of characters of 64 kinds differ, an edit changes two at most."""
    sides = ([np.bincount(points[x:x + many] & 63, minlength=64) for x, many in zip(at.tolist(), size.tolist(), strict=True)]
             for at, size in ((at_a, n), (at_b, m)))
    left, right = (np.array(side).reshape(-1, 64) for side in sides)
    return np.abs(left - right).sum(axis=1)


def edit_distance(a: list, b: list, edits: int | np.ndarray) -> np.ndarray:
    """Edit distances of the pairs (a[k], b[k]) of texts or code points, edits + 1 if above ``edits`` (of each pair)."""
    most = np.broadcast_to(edits, len(a)).astype(np.int64)
    texts = [x if isinstance(x, str) else x.tobytes().decode("utf-32-le", "surrogatepass") for x in (*a, *b)]
    size = np.array([len(x) for x in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.cumsum(size) - size
    (n, m), (at_a, at_b) = size.reshape(2, -1), at.reshape(2, -1)
    out = most + 1
    to_do = np.abs(n - m) <= most
    some = np.flatnonzero(to_do & (most >= 4) & (most <= BAND) & (most < n))
    some = some[np.argsort(m[some])]
    if len(some):
        held = np.zeros(int(points.max()) + 1, bool)
        held[points] = True
        kinds, whole = int(held.sum()), held.sum() <= LETTERS
        number = (np.cumsum(held) - 1 if whole else np.arange(len(held)) % LETTERS).astype(np.uint8)
        code = number[points]
        while len(some):
            k, some = np.split(some, [BANDED_PAIRS])
            out[k] = np.minimum(banded(code, min(kinds, LETTERS), at_a[k], at_b[k], n[k], m[k], most[k]), most[k] + 1)
            to_do[k] = False if whole else out[k] <= most[k]  # too small where letters were taken for others
    k = np.flatnonzero(to_do & (most > BAND))
    to_do[k] = unlike(points, at_a[k], at_b[k], n[k], m[k]) <= 2 * most[k]
    few = np.flatnonzero(to_do & (most <= REACHING))
    few = few[np.argsort(most[few], kind="stable")]
    largest = np.array([points[x:x + k].max(initial=0) for side in ((at_a, n), (at_b, m)) for x, k in zip(*(v[few].tolist() for v in side), strict=True)])
    largest = largest.reshape(2, -1).max(axis=0)
    for kind, above, until in ((np.uint8, -1, 0xFD), (np.uint16, 0xFD, 0xFFFD), (np.uint32, 0xFFFD, 0x10FFFF)):
        some = few[(largest > above) & (largest <= until)]
        while len(some):
            states = (most[some] + 1) * np.arange(1, len(some) + 1)
            k, some = np.split(some, [max(1, int(np.searchsorted(states, STATES, "right")))])
            out[k] = reaching(points, at_a[k], at_b[k], n[k], m[k], most[k], kind)
    for k in np.flatnonzero(to_do & (most > REACHING)).tolist():
        out[k] = distance(texts[k], texts[len(a) + k], int(most[k]))
    return out


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, line (number in its text), key, key2, chars of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=SLICE):
            lines = Lines(batch.column(1).to_pylist())
            first, second = lines.keys()
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(lines.text)), pa.array(lines.number, pa.int64()),
                pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array((lines.end - lines.start).astype(np.int32))],
                names=["doc_id", "line", "key", "key2", "chars"])

    return rows_of(docs).mapInArrow(run, "doc_id long, line long, key long, key2 long, chars int")


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def trigrams(lines: Lines) -> np.ndarray:
    """Number of the three characters from each place on, each one of 64 classes."""
    kind = (lines.low & np.uint16(63)).astype(np.int32)
    return (kind[:-2] << 12) | (kind[1:-1] << 6) | kind[2:]


def gram_order(docs: DataFrame, chars: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Counted in a sample of bounded size: the share of all grams that each class of grams (by
    bits of their hash) has; how much rarer (1/16 bits) a third character makes a gram; how rare a
    gram of a class that is met often can be at most; and the lengths of lines that bands begin at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=SLICE):
            lines = Lines(batch.column(1).to_pylist())
            counted = (lines.grams(size) >> np.uint64(64 - COUNTED_BITS), trigrams(lines), np.minimum(lines.end - lines.start, FAR))
            made = [np.unique(x, return_counts=True) for x in counted]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<u4").tobytes()]) for pair in made for x in pair],
                                             names=names)

    names = ["held", "n", "held3", "n3", "chars", "lines"]
    total, three, of_length = (np.zeros(n, np.int64) for n in (1 << COUNTED_BITS, 1 << 18, FAR + 1))
    sample = rows_of(docs).sample(min(1.0, SAMPLE_CHARS / max(1, chars)), 17)
    for row in sample.mapInArrow(run, ", ".join(f"{n} binary" for n in names)).collect():
        for table, held, n in ((total, "held", "n"), (three, "held3", "n3"), (of_length, "chars", "lines")):
            table[np.frombuffer(row[held], "<u4")] += np.frombuffer(row[n], "<u4")
    share = (total + 0.5) / (total + 0.5).sum()
    three = three.reshape(-1, 64)
    rarer = 16 * (np.log2(three.sum(axis=1, keepdims=True) + 1.0) - np.log2(three + 0.5))
    often = share > 4 / len(share)
    most = np.where(often, np.clip(np.rint(-16 * np.log2(share)), 0, RAREST), RAREST)
    weight = np.cumsum(of_length * np.arange(FAR + 1))
    bands = np.searchsorted(weight, weight[-1] * np.arange(1, BANDS) // BANDS, "right").clip(0, FAR).tolist()
    return (share.astype(np.float32), np.clip(np.rint(rarer), 0, 400).astype(np.int16).ravel(), most.astype(np.int16),
            [0, *bands, 1 << 62])


def gram_ranks(lines: Lines, gram: np.ndarray, size: int, rarer: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Place of the grams in the order, from 1: rare ones first, in steps, then by their hash."""
    rare = most[(gram >> np.uint64(64 - COUNTED_BITS)).astype(np.int32)].astype(np.int32)
    if size > 2 and len(gram):
        sums = np.zeros(len(lines.points) - 1, np.int32)
        np.cumsum(rarer[trigrams(lines)], out=sums[1:], dtype=np.int32)
        rare = np.minimum(rare, sums[size - 2:size - 2 + len(gram)] - sums[:len(gram)])
    rank = (RAREST - rare) // RARITY_STEP
    return (rank.astype(np.uint32) << np.uint32(20) | (gram >> np.uint64(8)).astype(np.uint32) & np.uint32((1 << 20) - 1)) + np.uint32(1)


def block_counts(width: np.ndarray, chars: int) -> np.ndarray:
    """Blocks that each class of grams is dealt in, by its share of all ``chars`` grams."""
    bound = max(BLOCK, ABOVE_MEAN * chars / len(width))
    return np.ceil(np.maximum(1, width.astype(np.float64) * chars / bound)).astype(np.int32)


def in_blocks(gram: np.ndarray, key: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each gram of a line, and the gram's number: one of several blocks has a place with
    each of the blocks."""
    of = np.repeat(np.arange(len(gram)), blocks)
    if len(of) == len(gram):
        return common.mix(gram), of
    other = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = (key[of] % blocks[of].astype(np.uint64)).astype(np.int64)
    x, y = np.minimum(own, other), np.maximum(own, other)
    return common.mix(gram[of] + (x * blocks[of] + y).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), of


#: A line's gram: hash within its bucket, line (``ID_BITS`` of its key), code points of the line, first place, how
#: far off the last one is, and in the last one's low half two bits of each of the characters around the first one, in
#: its high half a hash of all from the line's chosen gram before on (0 if there is none, or several places).
FIELDS = (("place", "<u4"), ("key", "<u4"), ("chars", "<u2"), ("first", "<u2"), ("wide", "<u2"), ("around", "<u8"))
#: Low bits of a line's key by which pairs name it; lines that have them in common are told apart by their texts.
ID_BITS = 32
#: Characters before (and after) a gram that a row tells of, and how many of them 16 bits of difference leave alike.
AROUND = 8
_ALIKE = np.array([((x & -x).bit_length() - 1) // 2 if x else AROUND for x in range(1 << 16)], np.int8)


def lines_of(column: pa.Array, least: int, below: int, chars_per_edit: int) -> list[str]:
    """The lines of ``least`` code points or more that are shorter than ``below``, or can be linked with one that is."""
    lines = pc.split_pattern(column.cast(pa.large_string()).fill_null(""), "\n").flatten()
    length = pc.utf8_length(lines).to_numpy()
    return lines.filter(pa.array((length >= least) & (length - length // chars_per_edit < below))).to_pylist()


def around(lines: Lines, at: np.ndarray, size: int) -> np.ndarray:
    """Two bits of each of the characters around the grams, nearest ones lowest: after them in the low 16 bits."""
    beyond = np.zeros(AROUND, np.uint16)
    after = before = np.concatenate((beyond, lines.low >> np.uint16(6) & np.uint16(3), beyond))
    for k in (1, 2, 4):
        after = after[:-k] | after[k:] << np.uint16(2 * k)
        before = before[k:] | before[:-k] << np.uint16(2 * k)
    return before[at].astype(np.uint64) << np.uint64(16) | after[at + size + AROUND]


def held_rows(lines: Lines, at: np.ndarray, line: np.ndarray, gram: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """first, last, line, gram and what is around it of the grams at ``at`` (a line's ones in order), each gram of a line once."""
    before = np.zeros(len(at), np.uint64)
    then = np.flatnonzero(line[1:] == line[:-1]) + 1
    before[then] = lines.hash(at[then - 1], at[then] + size) | np.uint64(1 << 32)
    near_by = around(lines, at, size) | before >> np.uint64(32) << np.uint64(32)
    tag = gram ^ line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    in_order = np.sort(tag)
    again = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    if not len(again):
        return at, at, line, gram, near_by
    twice = np.isin(tag, again)
    once = np.flatnonzero(~twice)
    twice = np.flatnonzero(twice)
    twice = twice[np.lexsort((at[twice], gram[twice], line[twice]))]
    edge = np.flatnonzero(np.r_[True, (line[twice][1:] != line[twice][:-1]) | (gram[twice][1:] != gram[twice][:-1]), True])
    first, last = twice[edge[:-1]], twice[edge[1:] - 1]
    near_by[first[first != last]] &= np.uint64((1 << 32) - 1)
    k = np.concatenate((once, first))
    return at[k], at[np.concatenate((once, last))], line[k], gram[k], near_by[k]


def gram_rows(docs: DataFrame, order, chars: int, buckets: int, least: int, below: int, edits: int | None, chars_per_edit: int
              ) -> DataFrame:
    """bucket and data (rows of FIELDS, field by field) of the chosen grams of a band's lines. A task
    gives a line's rows again only if it has met very many others since."""
    size = gram_size(chars_per_edit)

    def given_out(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        bucket, *fields = (np.concatenate(x) for x in zip(*held, strict=True))
        by_bucket = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        bucket, fields = bucket[by_bucket], [f[by_bucket] for f in fields]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        data = [b"".join(f[a:b].tobytes() for f in fields) for a, b in zip(edge, edge[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]], pa.int32()), pa.array(data, pa.binary())],
                                         names=["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, rarer, most = order.value
        blocks = block_counts(share, chars)
        seen: set[int] = set()
        held: list[list[np.ndarray]] = []
        for batch in common.slices(batches, limit=SLICE):
            lines = Lines(lines_of(batch.column(1), least, below, chars_per_edit))
            key = lines.hash(lines.start, lines.end)
            rows = np.unique(key, return_index=True)[1]
            rows = np.sort(rows[np.array([k not in seen for k in key[rows].tolist()], bool)])
            if len(seen) > SEEN:
                seen.clear()
            seen.update(key[rows].tolist())
            gram = lines.grams(size)
            at, line = chosen_grams(lines, rows, gram_ranks(lines, gram, size, rarer, most), size, edits, chars_per_edit)
            if len(at):
                first, last, line, gram, near_by = held_rows(lines, at, line, gram[at], size)
                many = blocks[(gram >> np.uint64(64 - COUNTED_BITS)).astype(np.int32)]
                gram, of = in_blocks(gram, key[line], many)
                if len(of) > len(line):
                    first, last, line, near_by = first[of], last[of], line[of], near_by[of]
                fields = [gram & np.uint64((1 << 32) - 1), key[line] & np.uint64((1 << ID_BITS) - 1), lines.end[line] - lines.start[line],
                          first - lines.start[line], last - first, near_by]
                held.append([((gram >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), *(
                    (np.minimum(x, FAR) if kind == "<u2" else x).astype(kind) for x, (_, kind) in zip(fields, FIELDS, strict=True))])
            if sum(len(h[0]) for h in held) > HELD_ROWS:
                yield from given_out(held)
                held = []
        if held:
            yield from given_out(held)

    return rows_of(docs).mapInArrow(run, "bucket int, data binary")


def pairs_within(data: list[bytes], below: int, edits: int | None, chars_per_edit: int) -> Iterator[np.ndarray]:
    """Pairs of lines (two rows of keys, smaller ones first), one of them shorter than ``below``, that
    share a gram of a bucket at places that t edits can move it between.

    Two lines that have all from the chosen gram before on in common share that gram too, at places as
    far apart and in the same stretch, so only the first such gram gives the pair.
    """
    width = sum(np.dtype(kind).itemsize for _, kind in FIELDS)
    place, key, chars, first, wide, near_by = (
        np.concatenate(x) for x in zip(*(_fields(d, len(d) // width) for d in data), strict=True))
    by_length = place.astype(np.uint64) << np.uint64(16) | chars
    by_place = np.argsort(by_length)
    by_length, key, first, wide, near_by = (x[by_place] for x in (by_length, key, first, wide, near_by))
    chars = (by_length & np.uint64(FAR)).astype(np.int64)
    single, last, first = wide == 0, first.astype(np.int64) + wide, first.astype(np.int64)
    t = allowed(chars, edits, chars_per_edit)
    beside = chars // (t + 1) - gram_size(chars_per_edit)  # characters alike beside a gram that two lines have in common
    longest = np.minimum(chars * chars_per_edit // (chars_per_edit - 1) + 1, FAR)  # that may be linked with the line, or a little more
    until = np.searchsorted(by_length, by_length - chars.astype(np.uint64) + longest.astype(np.uint64), "right")
    others = np.where(chars < below, until - np.arange(len(until)) - 1, 0)
    rows = np.flatnonzero(others)
    total = np.cumsum(others[rows])
    begin = 0
    while begin < len(rows):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] - others[rows[begin]] + COMPARED, "right")))
        some = rows[begin:end]
        x = np.repeat(some, others[some])
        y = np.arange(len(x)) - np.repeat(np.cumsum(others[some]) - others[some] - some - 1, others[some])
        begin = end
        differ = near_by[x] ^ near_by[y]
        before, after = _ALIKE[differ >> np.uint64(16) & np.uint64(0xFFFF)], _ALIKE[differ & np.uint64(0xFFFF)]
        plain = single[x] & single[y] & (chars[y] < FAR)
        anew = (differ >> np.uint64(16) != 0) | (near_by[x] >> np.uint64(32) == 0)  # all that is told of what is before
        good = np.flatnonzero((anew & ((before == AROUND) | (after == AROUND) | (before + after >= beside[y]))) | ~plain)
        x, y, plain = x[good], y[good], plain[good]
        move, longer = first[y] - first[x], chars[y] - chars[x]
        apart = np.maximum(0, np.maximum(first[y] - last[x], first[x] - last[y]))
        needed = np.where(single[x] & single[y], np.abs(move) + np.abs(longer - move), apart)
        fits = ((needed <= t[y]) | (chars[y] >= FAR)) & (longer <= t[y]) & (key[x] != key[y])
        yield np.sort(np.stack((key[x[fits]], key[y[fits]])), axis=0)


def _fields(data: bytes, n: int) -> Iterator[np.ndarray]:
    at = 0
    for _, kind in FIELDS:
        yield np.frombuffer(data, kind, n, at)
        at += n * np.dtype(kind).itemsize


def candidates(grams: DataFrame, parts: int, below: int, edits: int | None, chars_per_edit: int) -> DataFrame:
    """pair: the ids of the pairs that share a gram, the smaller one in the high bits; some of them repeated."""

    def found(data: list[bytes]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for a, b in pairs_within(data, below, edits, chars_per_edit):
            held.append(a.astype(np.uint64) << np.uint64(ID_BITS) | b)
            if sum(len(p) for p in held) > HELD_ROWS:
                held = [np.unique(np.concatenate(held))]
                if len(held[0]) > HELD_ROWS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64))], names=["pair"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)).view(np.int64))], names=["pair"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and held:
                    yield from found(held)
                    held = []
                bucket = b
                held.append(data)
        if held:
            yield from found(held)
        common.release()

    return grams.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "pair long")


def line_texts(docs: DataFrame) -> DataFrame:
    """key, key2 and text of the lines of ``docs`` (text, lines) that have the number and keys of one of ``lines``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text=0, limit=SLICE):
            held = pc.split_pattern(batch.column(0).cast(pa.large_string()).fill_null(""), "\n")
            number, *keys = (x.to_numpy() for x in pc.list_flatten(batch.column(1)).flatten())
            text = pc.list_parent_indices(batch.column(1)).to_numpy()
            there = number < pc.list_value_length(held).to_numpy()[text]  # not so in another text with the same doc_id
            at = held.offsets.to_numpy()[text[there]] - held.offsets[0].as_py() + number[there]
            texts = held.flatten().take(pa.array(at))
            lines = Lines(texts.to_pylist())
            wanted = [k[there][lines.text] for k in keys]
            first, second = (k.view(np.int64) for k in lines.keys())
            same = (first == wanted[0]) & (second == wanted[1])
            yield pa.RecordBatch.from_arrays([pa.array(first[same]), pa.array(second[same]),
                                              texts.take(pa.array(lines.text[same])).cast(pa.string())], names=["key", "key2", "text"])

    return docs.mapInArrow(run, "key long, key2 long, text string")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``materialize``; the files that were shuffled for it go as soon as the table is written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANED, None)
    conf.set(CLEANED, "true")
    try:
        return materialize(df, name)
    finally:
        conf.unset(CLEANED) if before is None else conf.set(CLEANED, before)


def verified(pairs: DataFrame, edits: int | None, chars_per_edit: int) -> DataFrame:
    """The pairs (a, a2, b, b2, text_a, text_b) whose distance is small enough, with it."""

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        pairs = pa.Table.from_batches(held)
        texts = [pairs.column(c).to_pylist() for c in (4, 5)]
        longest = np.array([max(len(x), len(y)) for x, y in zip(*texts, strict=True)], np.int64)
        most = allowed(longest, edits, chars_per_edit)
        distance = edit_distance(*texts, most)
        good = pa.array(distance <= most)
        return pa.RecordBatch.from_arrays([*(pairs.column(c).filter(good).combine_chunks() for c in range(4)), pa.array(distance).filter(good)],
                                          names=["a", "a2", "b", "b2", "edits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in common.slices(batches, text=4, limit=VERIFIED):
            held.append(batch)
            if sum(b.num_rows for b in held) >= VERIFIED_PAIRS or sum(b.get_total_buffer_size() for b in held) > VERIFIED:
                yield close(held)
                held = []
        if held:
            yield close(held)

    return pairs.mapInArrow(run, "a long, a2 long, b long, b2 long, edits long")


def line_id(key: str) -> Column:
    """What pairs name a line by."""
    return F.col(key).bitwiseAND((1 << ID_BITS) - 1)


def links(docs: DataFrame, classes: DataFrame, chars: int, edits: int | None = None, chars_per_edit: int = CHARS_PER_EDIT
          ) -> tuple[DataFrame, DataFrame]:
    """a, a2, b, b2 (keys of two different lines), edits: each link once, a written table; and key, key2, first
    of all lines in it and some more. ``chars``: of all lines."""
    spark = docs.sparkSession
    *order, bands = gram_order(docs, chars, gram_size(chars_per_edit))
    order = spark.sparkContext.broadcast(order)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-chars // (4 * BANDS * BUCKET_ROWS)))  # a line has a row for 4 code points or more
    twice = classes.groupBy(line_id("key").alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(twice.select((F.shiftleft("id", ID_BITS) + F.col("id")).alias("pair")), "line-shared")
    for least, below in zip(bands, bands[1:], strict=False):
        grams = gram_rows(docs, order, chars, buckets, least, below, edits, chars_per_edit)
        found = candidates(grams, min(buckets, max(parts, buckets // 4)), below, edits, chars_per_edit)
        shared = shared.union(stored(found.distinct(), "line-shared"))  # a pair is of the shorter line's band
    shared = shared.select(F.shiftrightunsigned("pair", ID_BITS).alias("a"), line_id("pair").alias("b"))
    some = shared.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = stored(classes.withColumn("id", line_id("key")).join(some, "id").select("key", "key2", "first"), "line-keys")
    n_wanted = wanted.count()
    holders = stored(wanted.groupBy(F.col("first.doc_id").alias("doc_id")).agg(
        F.collect_list(F.struct("first.line", "key", "key2")).alias("lines")), "line-holders")
    holders = F.broadcast(holders) if 3 * n_wanted <= BROADCAST_IDS else holders  # three numbers each
    texts = stored(line_texts(rows_of(docs).alias("d").join(holders.alias("h"), F.expr("d.doc_id <=> h.doc_id")).select("text", "lines")),
                   "line-texts")
    if texts.count() > n_wanted:  # texts with one doc_id
        texts = stored(texts.dropDuplicates(["key", "key2"]), "line-texts")
    side = {c: texts.select(line_id("key").alias(c), F.col("key").alias(f"{c}1"), F.col("key2").alias(f"{c}2"), F.col("text").alias(f"text_{c}"))
            for c in "ab"}
    joined = shared.join(side["a"], "a").join(side["b"], "b").where("a <> b or a1 < b1 or (a1 = b1 and a2 < b2)").select(
        F.col("a1").alias("a"), "a2", F.col("b1").alias("b"), "b2", "text_a", "text_b")
    return stored(verified(joined, edits, chars_per_edit).dropDuplicates(["a", "a2", "b", "b2"]), "line-links"), wanted


def line_classes(docs: DataFrame, edits: int | None = None, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """doc_id, line, class_doc and class_line (the first occurrence of the same line), copies,
    n_links (different lines linked with it), kept for each line of docs (doc_id, text)."""
    common.small_batches(docs.sparkSession)
    every = stored(occurrences(docs), "lines")
    where = F.struct("doc_id", "line")
    classes = every.groupBy("key", "key2").agg(F.min(where).alias("first"), F.count("*").alias("copies"))
    classes = stored(classes, "line-classes")
    chars = every.agg(F.sum("chars")).first()[0] or 0
    found, several = links(docs, classes, chars, edits, chars_per_edit)
    both = found.select("a", "a2", "b", "b2").union(found.select("b", "b2", "a", "a2"))
    other = several.select(F.col("key").alias("b"), F.col("key2").alias("b2"), F.col("first").alias("other"))
    linked = stored(both.join(other, ["b", "b2"]).groupBy(F.col("a").alias("key"), F.col("a2").alias("key2")).agg(
        F.count("*").alias("n_links"), F.min("other").alias("other")), "line-linked")
    linked = F.broadcast(linked) if 5 * linked.count() <= BROADCAST_IDS else linked  # five numbers each
    judged = classes.join(linked, ["key", "key2"], "left").select(
        "key", "key2", "first", "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("other").isNull() | (F.col("first") < F.col("other"))).alias("leads"))
    return every.join(judged, ["key", "key2"]).select(
        "doc_id", "line", F.col("first.doc_id").alias("class_doc"), F.col("first.line").alias("class_line"), "copies", "n_links",
        (F.col("leads") & (F.col("first.line") == F.col("line")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"))
