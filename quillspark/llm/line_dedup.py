"""Fuzzy line dedup: keys of normalised lines, verified by edit similarity.

Lines are normalised (lower case, numbers as 0, everything but letters and marks as one
space) and equal ones are one line. Two lines are linked when their edit similarity is at
least 0.9. A SimHash does not find these: one word changed in 200 letters already turns a
tenth of its bits, and no block of so few equal bits is selective. The join keys are
instead parts of the line that an edit leaves whole:

- of every line: bands of ROWS min-hashes of its short character grams, so that edits
  scattered over the line leave many of them equal, and of lines with many repeated grams
  also of the numbered grams. A band needs several equal min-hashes, since lines that
  merely quote one passage share some of them;
- of lines under GAP characters also a prefix with a suffix around one stretch of edits:
  any one stretch of up to a tenth of the line is found.

Keys travel as packed numbers and meet in parts, so that a key costs 8 bytes of storage, 14
of shuffle and no row. Lines of a small bucket are paired there. Pairs that share a band by
chance grow with the square of the lines, so they are ruled out before any text moves: by
their lengths, which are a part of a line's hash, and by where the grams of the band lie in
both lines, which a few edits move but a little. Letter counts rule out most of the other
pairs that are no links. What is left is compared in batches. Of each connected group the
first occurrence stays.
"""

from __future__ import annotations

import math
import unicodedata
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .groups import block_links, settle
from .shingles import Hasher, mix, worker
from .util import counted, cut, drop, fresh, stored, table

ROWS = 4  # min-hashes of a band
GAP = 72  # characters; lines below it differ in keys
SHORT = (4, 16)  # letters of a gram and bands of lines under GAP and of their longest partners
LONG = (6, 24)  # the same of lines from GAP on
CHUNK = 1 << 17  # characters at a time
SIMILAR = 0.9
SYNC = 8
SEGMENT = 1 << 20  # keys packed at once
PARTS = 1 << 12  # parts of the keys
WAVE = 1 << 12  # pairs of a large bucket compared at once
LANES, CELLS = 512, 1 << 19  # pairs side by side at most, and their letters
FEW = 16  # fewer pairs are compared one by one
FAR = 60_000  # more edits than counted
SMALL = 16  # lines of a bucket that are all paired at once; larger ones are settled
CHAINED = 1024  # lines of a bucket that is taken apart where no two may be linked
SPOTS = 15  # stretches of a line, which tell where a gram lies; SPOTS itself: not told
SIZES = 1023  # the bits of a line's hash that hold the class of its length
STEP = math.log(1.016)  # between the classes
APART = int(math.log(1 / SIMILAR) / STEP) + 1  # classes between linked lines at most
SHORTEST = 16  # normalised characters; shorter lines are linked with equal ones only


def _signs() -> np.ndarray:
    """What each code point becomes: letters and marks stay, numbers are 0, the rest is a space."""
    if (kept := worker().get("signs")) is not None:
        return kept
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    out = np.array([i if k in "LM" else 48 if k == "N" else 32 for i, k in enumerate(kinds)], np.uint32)
    out[10] = 10
    worker()["signs"] = out
    return out


def _codes(text: str) -> np.ndarray:
    return _signs()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]


def _letters() -> np.ndarray:
    """A random number for each code point."""
    if (kept := worker().get("letters")) is None:
        kept = worker()["letters"] = mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0xD1342543DE82EF95))
    return kept


def _grams(letters: np.ndarray, width: int) -> np.ndarray:
    """A 32-bit hash of the `width` letters from each place on."""
    n = len(letters) - width + 1
    out = letters[:n].copy()
    for i in range(1, width):
        out *= np.uint32(0x9E3779B1)
        out += letters[i : n + i]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    out *= np.uint32(0xC2B2AE35)
    return out ^ out >> np.uint32(16)


def normalised(text: str) -> str:
    """Each line of a text for itself."""
    return "\n".join(" ".join(x.split()) for x in _codes(text).tobytes().decode("utf-32-le").split("\n"))


def _classes() -> list[int]:
    """Lengths where a new class of shorter lines begins."""
    out = [SHORTEST]
    while out[-1] < GAP:
        out.append(max(out[-1] + 1, out[-1] * 17 // 16))
    return out


def _gaps(n: int) -> list[tuple[int, int, int]]:
    """(prefix, suffix, name of the class) of a line of n characters.

    A pair is keyed by the class of its shorter line, so a line has the keys of each class
    that a shorter partner can be in. In a class from `low` up, k edits at most are allowed; a
    stretch of edits that begins at x leaves the step of the prefixes before x whole, and
    behind it what the longest stretch and the step leave.
    """
    starts, out = _classes(), []
    for low, high in zip(starts, starts[1:], strict=False):
        if low <= n and high - 1 >= -(-n * 9 // 10):
            k, step = int((high - 1) / SIMILAR) // 10, max(1, low // 8)
            whole = low - k - step
            out += [(p, whole - p, low) for p in sorted({*range(0, whole, step), whole})]
    return out


def _all_gaps() -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """For each length the number and the first place of its gaps; and all gaps: prefix,
    suffix, and a number that names prefix and class."""
    if (kept := worker().get("gaps")) is None:
        plans = [_gaps(n) for n in range(GAP * 10 // 9 + 2)]
        count = np.array([len(x) for x in plans])
        before, behind, name = np.array([g for x in plans for g in x], np.int64).T
        kept = worker()["gaps"] = count, np.cumsum(count) - count, (before, behind, mix((before * 256 + name).astype(np.uint64)))
    return kept


_TIMES = mix(np.arange(1, ROWS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def _least(grams: np.ndarray, spot: np.ndarray, line: np.ndarray, lines: int, bands: int) -> np.ndarray:
    """For each band, row and line the least gram in an order of its own: how far it lies
    behind a starting point, in the low four bits its spot. A row's bands share the numbers of
    the grams and start at points that are spread evenly over them."""
    starts = np.array([-(-(band << 24) // bands) << 8 for band in range(bands)], np.uint32)[:, None]
    out, none = np.empty((bands, ROWS, lines), np.uint32), np.uint32(0xFFFFFFFF)
    for row, m in enumerate(_TIMES):
        order = grams * m & np.uint32(~SPOTS & 0xFFFFFFFF) | spot
        least = np.full((bands, lines), none)
        np.minimum.at(least.ravel(), ((order >> np.uint32(8)) * np.uint32(bands) >> np.uint32(24)) * lines + line, order)
        # Where no gram lies between two points, the first one behind the next point counts.
        least = np.minimum.accumulate(least[::-1])[::-1]
        out[:, row] = np.where(least == none, least[0], least) - starts
    return out


def _bands(least: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each line and band, and the spots of its grams."""
    out = np.arange(len(least), dtype=np.uint64)[:, None] + np.uint64(salt)
    spots = np.zeros(out.shape, np.uint16)
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ (least[:, k] >> np.uint32(4)).astype(np.uint64))
        spots = spots | (least[:, k] & np.uint32(SPOTS)).astype(np.uint16) << np.uint16(4 * k)
    return out.T, spots.T


def _numbered(grams: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The grams mixed with how often the line had them before."""
    order = np.lexsort((grams, line))
    g, at = grams[order], np.arange(len(grams))
    new = np.flatnonzero(np.diff(g, prepend=~g[:1]) | np.diff(line[order], prepend=-1).astype(bool))
    out = np.empty_like(grams)
    out[order] = mix(g.astype(np.uint64) << np.uint64(32) | (at - np.repeat(new, np.diff(np.append(new, len(g))))).astype(np.uint64)).astype(np.uint32)
    return out


def line_facts(texts: list[str], hasher: Hasher, known: set[int] | None = None) -> tuple[np.ndarray, ...]:
    """(text, place in the text, hash) of the lines that hold a letter or number, and (of,
    key): the join keys of line `of`, for the first of equal lines, in order of lines; not of
    the hashes in `known`, which takes up the others. The low bits of a hash are the class of
    the line's length."""
    return line_keys(texts, hasher, known)[:5]


def line_keys(texts: list[str], hasher: Hasher, known: set[int] | None = None) -> tuple[np.ndarray, ...]:
    """line_facts(), and of each key the spots of its grams, four bits each."""
    counts = np.array([t.count("\n") + 1 for t in texts])
    raw = _codes("\n".join(texts))
    letter = raw > 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    of_word = np.cumsum(raw == 10, dtype=np.int32)[start]  # the line of each word
    first = np.flatnonzero(np.diff(of_word, prepend=-1))
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none.astype(np.uint16)
    later = np.ones(len(start), bool)
    later[first] = False
    letter[start[later] - 1] = True  # one space before each further word
    place_of = np.cumsum(letter) - 1
    a, z = place_of[start[first]], place_of[end[np.append(first[1:], len(start)) - 1] - 1] + 1
    codes, size = raw[letter], z - a
    hasher.powers(len(codes) + 1)
    letters = _letters()[codes]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * hasher.up[: len(codes)])))
    h = mix(mix((total[z] - total[a]) * hasher.down[a]) ^ size.astype(np.uint64))
    h = h & np.uint64(~SIZES & (1 << 64) - 1) | np.minimum(np.log(size) / STEP, SIZES).astype(np.uint64)
    line = of_word[first]
    text = np.repeat(np.arange(len(texts)), counts)[line]
    place = line - np.concatenate(([0], np.cumsum(counts)[:-1]))[text]
    owners, keys, spots = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]

    def add(of, found, at):
        owners.append(np.repeat(of, found.shape[1]))
        keys.append(found.ravel())
        spots.append(at.ravel())

    names, once = np.unique(h, return_index=True)
    if known is not None:
        once = once[[x not in known for x in names.tolist()]]
        known.update(names.tolist())
    of = np.sort(once[(size[once] >= SHORTEST) & (size[once] * SIMILAR < GAP)])
    if len(of):
        held, first_gap, (before, behind, name) = _all_gaps()
        n = held[size[of]]
        row = np.repeat(np.arange(len(of)), n)
        at = np.arange(n.sum()) + np.repeat(first_gap[size[of]] - np.cumsum(n) + n, n)
        left, right = a[of][row], z[of][row]
        head = mix((total[left + before[at]] - total[left]) * hasher.down[left])
        tail = mix((total[right] - total[right - behind[at]]) * hasher.down[right - behind[at]])
        owners.append(of[row])
        keys.append(mix(mix(head + name[at]) ^ tail))
        spots.append(np.full(len(row), 0xFFFF, np.uint16))
    low = letters.astype(np.uint32)
    for (width, bands), found, salt in ((SHORT, of, 1 << 22), (LONG, np.sort(once[size[once] >= GAP]), 1 << 20)):
        if not len(found):
            continue
        n = size[found] - width + 1
        grams = _grams(np.concatenate([low[x:y] for x, y in zip(a[found].tolist(), z[found].tolist(), strict=True)]), width)
        inner = np.repeat(np.arange(len(found)), n)
        part = np.arange(len(inner)) - np.repeat(np.cumsum(n) - n, n)
        grams = grams[np.arange(len(inner)) + inner * (width - 1)]
        spot = (part * np.repeat((SPOTS * (1 - 1e-6) / n).astype(np.float32), n)).astype(np.uint32)
        least = _least(grams, spot, inner, len(found), bands)
        add(found, *_bands(least, salt))
        distinct = bands * ROWS / np.maximum(least.sum((0, 1), dtype=np.float64) / 2.0**32, 1e-12)
        often = np.flatnonzero(distinct < 0.6 * n)
        if len(often):
            line = np.repeat(np.arange(len(often)), n[often])
            more = _numbered(grams[np.isin(inner, often)], line)
            add(found[often], *_bands(_least(more, np.uint32(SPOTS), line, len(often), bands), salt << 1))
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return text, place, h.view(np.int64), owner[order], key[order].view(np.int64), np.concatenate(spots)[order]


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half - 1
    return low


def edits(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, or any number above `most` where it is above that.

    Bit-parallel over the part where the texts differ. A way of at most `most` edits that is
    i - j off the diagonal after j letters has spent `spent` edits and needs the difference
    of the lengths from there, so |i - j| <= |difference| + most - spent, and the distance
    on the diagonal is at most that plus `spent`: where it is more, the loop ends.
    """
    n = _common(a, b)
    a, b = a[n:], b[n:]
    n = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    over = len(a) + len(b) if most is None else most + abs(len(a) - len(b))
    for j, ch in enumerate(b):
        if j % 8 == 0 and over < j <= len(a):
            above = (1 << j) - 1
            if j + (up & above).bit_count() - (down & above).bit_count() > over:
                return len(a) + len(b)
        eq = at.get(ch, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(right & last) - bool(left & last)
        right, left = right << 1 | 1, left << 1
        up, down = full & (left | ~(diagonal | right)), right & diagonal & full
    return score


def few_edits(a: str, b: str, most: int) -> bool:
    """Whether one way that is easy to find has at most `most` edits: equal letters are
    passed, and at others both texts go on to where the next SYNC letters are equal."""
    i = j = 0
    while most >= 0:
        n = _common(a[i:], b[j:])
        i, j = i + n, j + n
        rest = max(len(a) - i, len(b) - j)
        if rest <= most:
            return True
        for skip in range(min(most, len(a) - i - SYNC) + 1):
            to = b.find(a[i + skip : i + skip + SYNC], j, j + most + SYNC)
            if to >= 0:
                most -= max(skip, to - j)
                i, j = i + skip, to
                break
        else:
            return False
    return False


def _most(n: int) -> int:
    """Edits between two linked lines, the longer one of n characters, at most."""
    return int((1 - SIMILAR) * n + 1e-9)


def similar(a: str, b: str) -> bool:
    longest = max(len(a), len(b))
    most = _most(longest)
    return min(len(a), len(b)) >= SIMILAR * longest and (few_edits(a, b, most) or edits(a, b, most) <= most)


def _side_by_side(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """Which pairs (a, b), a not the shorter, have at most `most` edits.

    Diagonal after diagonal of equal i + j, all pairs at once. A way of at most `most` edits
    keeps i - j within (difference of the lengths +- most) / 2; other cells are left out. Pairs
    without a way that is left go as soon as they are half of those that are counted.
    """
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    low, high = int(((n - m - most) // 2).min()), int(((n - m + most + 1) // 2).max())
    long, short = int(n.max()), int(m.max())
    a, b = np.full((long, len(n)), 0x110000, np.uint32), np.full((short, len(n)), 0x110001, np.uint32)
    for k, (x, y) in enumerate(pairs):
        a[: n[k], k] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        b[short - m[k] :, k] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32)[::-1]
    last, now, left = (np.full((long + 3, len(n)), FAR, np.uint16) for _ in range(3))
    out, of = np.zeros(len(n), bool), np.arange(len(n))
    ends: dict[int, list[int]] = {}
    for k, s in enumerate((n + m).tolist()):
        ends.setdefault(s, []).append(k)
    for s in range(int((n + m).max()) + 1):
        begin, end = max(0, s - short, (s + low + 1) // 2), min(long, s, (s + high) // 2)
        new, i, j = left, max(begin, 1), min(end, s - 1) + 1
        # Row i + 2 of an array is i letters of a; the rows before `begin` are of earlier diagonals.
        new[max(begin - 1, 0) : begin + 2] = FAR
        if i < j:
            step = new[i + 2 : j + 2]
            np.not_equal(a[i - 1 : j - 1], b[short - s + i : short - s + j], out=step, casting="unsafe")
            step += last[i + 1 : j + 1]
            np.minimum(step, np.minimum(now[i + 1 : j + 1], now[i + 2 : j + 2]) + np.uint16(1), out=step)
        if begin == 0:
            new[2] = s
        if end == s:
            new[s + 2] = s
        if s in ends:
            here = {k: at for at, k in enumerate(of.tolist())}
            for k in ends[s]:
                if k in here:
                    out[k] = new[n[k] + 2, here[k]] <= most[k]
        last, now, left = now, new, last
        if s % 32 == 31:
            alive = (np.minimum(now[begin + 2 : end + 3].min(0), last[begin + 1 : end + 3].min(0)) <= most[of]) & (n[of] + m[of] > s)
            if not alive.any():
                break
            if 2 * alive.sum() < len(of):
                of, a, b, last, now, left = of[alive], *(np.ascontiguousarray(x[:, alive]) for x in (a, b, last, now, left))
    return out


def least_edits(pairs: list[tuple[str, str]]) -> np.ndarray:
    """So many edits at least, by the counts of three letters in a row in 1,024 classes: an
    edit takes three away and adds three at most."""
    n = len(pairs)
    codes = np.frombuffer("\n".join([p[k] for k in (0, 1) for p in pairs]).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < 3:
        return np.zeros(n, np.int64)
    end = codes == 10
    of = np.cumsum(end)
    gram = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA6B) + codes[2:] * np.uint32(0xC2B2AE35)
    whole = (of[:-2] == of[2:]) & ~end[:-2]
    counts = np.bincount(((of[:-2] << 10) + (gram >> np.uint32(22)))[whole], minlength=n << 11).reshape(2, n, 1024)
    apart = counts[0] - counts[1]
    return -(-np.maximum(np.maximum(apart, 0).sum(1), np.maximum(-apart, 0).sum(1)) // 3)


def all_similar(a: list[str], b: list[str], easy: bool = True) -> np.ndarray:
    """similar() of each pair; easy: try few_edits() first."""
    out, rest, pairs, most = np.zeros(len(a), bool), [], [], []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if len(x) < len(y):
            x, y = y, x
        top = _most(len(x))
        if len(y) < SIMILAR * len(x):
            continue
        if easy and few_edits(x, y, top):
            out[k] = True
            continue
        n = _common(x, y)
        x, y = x[n:], y[n:]
        n = _common(x[::-1], y[::-1])
        x, y = x[: len(x) - n], y[: len(y) - n]
        if len(x) + len(y) <= top:
            out[k] = True
        elif y:
            rest.append(k)
            pairs.append((x, y))
            most.append(top)
        else:
            out[k] = len(x) <= top
    if not rest:
        return out
    most = np.array(most)
    may = np.concatenate([least_edits(pairs[i : i + LANES]) for i in range(0, len(pairs), LANES)]) <= most
    rest, most, pairs = np.array(rest)[may], most[may], list(compress(pairs, may))
    n = np.array([len(x) for x, _ in pairs])
    order = np.lexsort((n - np.array([len(y) for _, y in pairs]), (np.log(n) * 8).astype(int)))
    at = 0
    while at < len(order):
        lanes = max(1, min(LANES, CELLS // int(n[order[at : at + LANES]].max())))
        some = order[at : at + lanes]
        at += lanes
        if len(some) < FEW or n[some].max() > FAR // 4:
            out[rest[some]] = [edits(*pairs[k], int(most[k])) <= most[k] for k in some]
        else:
            out[rest[some]] = _side_by_side([pairs[k] for k in some], most[some])
    return out


def letter_counts(text: str) -> bytes:
    """How often the text has the letters of each of 64 classes, at most 255."""
    return np.minimum(np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) % 64, minlength=64), 255).astype(np.uint8).tobytes()


def all_counts(lines: list[str]) -> list[bytes]:
    """letter_counts() of each line."""
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le"), np.uint32)
    end = codes == 10
    cell = (np.cumsum(end) * 64 + codes % 64)[~end]
    counts = np.minimum(np.bincount(cell, minlength=64 * len(lines)), 255).astype(np.uint8).tobytes()
    return [counts[at : at + 64] for at in range(0, len(counts), 64)]


def _bags(counts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(counts), np.uint8).reshape(-1, 64)


def within(n: tuple[np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """False where lengths or letter counts alone show that two texts are not similar: what
    one has more of, and what it has less of, are each at most the number of edits."""
    most = np.maximum(*n)
    apart = counts[0].astype(np.int32) - counts[1]
    least = np.maximum(np.maximum(apart, 0).sum(-1), np.maximum(-apart, 0).sum(-1))
    return (np.minimum(*n) >= SIMILAR * most) & (least <= (1 - SIMILAR) * most + 1e-9)


#: Names a row beside its id: rows of one id may differ.
def _told(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))


def occurrences(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, th (hash of the text), at (place of the line), h; of the lines that hold a
    letter or number. Further rows, without these, hold the join keys of many lines: the
    hashes of the lines, how many keys each has, and of each key its part, 32 bits and the
    spots of its grams. An equal line of the same task has its keys once."""
    kind = docs.schema[id_col].dataType.simpleString()
    packs = ["lines", "sizes", "parts", "keys", "spots"]

    def run(batches):
        hasher, known, packed, many = Hasher(), set(), [], 0

        def pack():
            lines, sizes, keys, spots = (np.concatenate(x) for x in zip(*packed, strict=True))
            keys = keys.view(np.uint64)
            cells = (lines, sizes.astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint16) % np.uint16(PARTS), keys.astype(np.uint32), spots)
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), *(pa.array([x.tobytes()], pa.binary()) for x in cells)], ["doc_id", "th", "at", "h", *packs])

        for batch in batches:
            types = [batch.column(0).type, pa.int64(), pa.int32(), pa.int64()]
            texts, held, size = batch.column(2), [], 0
            if len(known) > SEGMENT:
                known.clear()
            for i in range(batch.num_rows):
                held.append(texts[i].as_py() or "")
                size += len(held[-1])
                if size >= CHUNK or i + 1 == batch.num_rows:
                    at, place, h, owner, key, spots = line_keys(held, hasher, known)
                    rows = pa.array(at + (i + 1 - len(held)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place.astype(np.int32)), pa.array(h), *[pa.nulls(len(h), pa.binary())] * len(packs)], ["doc_id", "th", "at", "h", *packs])
                    if len(key):
                        own = np.bincount(owner, minlength=len(h))
                        packed.append((h[own > 0], own[own > 0], key, spots))
                        many += len(key)
                    if many >= SEGMENT:
                        yield pack()
                        packed, many = [], 0
                    held, size = [], 0
        if packed:
            yield pack()

    return _told(docs, id_col, text).mapInArrow(run, f"doc_id {kind}, th long, at int, h long, lines binary, sizes binary, parts binary, keys binary, spots binary")


def near(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """False where lines of hashes x and y, that have the grams of a common key at the spots u
    and v, are not linked by these grams.

    If edits before a gram move it by s, and the lengths differ by d, there are at least
    |s| + |d - s| edits. So the distance of the gram from the middle of its line changes by half
    of the edits at most; a spot and a class of lengths add what they round off.
    """
    length = np.exp((np.arange(SIZES + 1) + 0.5) * STEP).astype(np.float32)
    middle = ((np.arange(SPOTS + 1) + 0.5) / SPOTS - 0.5).astype(np.float32)
    p, q = x & SIZES, y & SIZES
    a, b = length[p], length[q]
    wide = ((1 - SIMILAR) / 2 + 1 / SPOTS + 0.01) * np.maximum(a, b) + 2
    ok = np.abs(p - q) <= APART
    for k in range(0, 4 * ROWS, 4):
        i, j = u >> k & SPOTS, v >> k & SPOTS
        ok &= (i == SPOTS) | (j == SPOTS) | (p == SIZES) | (np.abs(middle[i] * a - middle[j] * b) <= wide)
    return ok


def _chains(line: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """A number for each line of a bucket; those that may be linked have the same."""
    may, label = near(line[:, None], line, spots[:, None], spots), np.arange(len(line))
    while True:
        new = np.where(may, label, len(line)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def met(part: int, key: np.ndarray, line: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the keys of one part: (a, b) of the lines that share a bucket of at most SMALL and
    may be linked, see near(); and (key, line, hub) of the larger buckets."""
    order = np.argsort(key)
    key, line, spots = key[order], line[order], spots[order]
    same = np.concatenate(([False], key[1:] == key[:-1], [False]))
    same = same[1:] | same[:-1]
    key, line, spots = key[same], line[same], spots[same]
    order = np.lexsort((line, key))
    key, line, spots = key[order].astype(np.int64) | part << 32, line[order], spots[order]
    new = np.ones(len(key), bool)  # equal lines of several tasks meet here and are one again
    new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    key, line, spots = key[new], line[new], spots[new]

    def bounds():
        first = np.flatnonzero(np.concatenate((np.ones(len(key[:1]), bool), key[1:] != key[:-1])))
        return first, np.diff(np.append(first, len(key)))

    first, size = bounds()
    some = (size > SMALL) & (size <= CHAINED)
    for at, n in zip(first[some].tolist(), size[some].tolist(), strict=True):
        key[at : at + n] |= _chains(line[at : at + n], spots[at : at + n]) << 44
        order = at + np.argsort(key[at : at + n], kind="stable")
        key[at : at + n], line[at : at + n], spots[at : at + n] = key[order], line[order], spots[order]
    first, size = bounds()
    a, b = [first[:0]], [first[:0]]
    for n in range(2, SMALL + 1):
        at, (i, j) = first[size == n][:, None], np.triu_indices(n, 1)
        a.append((at + i).ravel())
        b.append((at + j).ravel())
    a, b = np.concatenate(a), np.concatenate(b)
    like = np.abs((line[a] & SIZES) - (line[b] & SIZES)) <= APART
    a, b = a[like], b[like]
    like = near(line[a], line[b], spots[a], spots[b])
    a, b = line[a[like]], line[b[like]]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    large = np.repeat(size > SMALL, size)
    return a[new], b[new], key[large], line[large], np.repeat(line[first], size)[large]


def buckets(seen: DataFrame) -> DataFrame:
    """(key, a, b) of the keys that several lines have: without a key the pairs of small
    buckets, with it the lines b of a large one and its hub a, the smallest of them.

    The keys are dealt by their part. 32 bits and the part tell keys apart: two that fall
    together make pairs that are no links.
    """

    def deal(batches):
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                lines, sizes, part, key, spots = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, (np.int64, np.uint32, np.uint16, np.uint32, np.uint16), strict=True))
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(PARTS + 1))
                columns = key[order], np.repeat(lines, sizes)[order], spots[order]
                some = np.flatnonzero(np.diff(ends))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array([x[ends[p] : ends[p + 1]].tobytes() for p in some], pa.binary()) for x in columns)], ["part", "keys", "lines", "spots"])

    def meet(batches):
        def found():
            a, b, key, line, hub = met(now, *(np.concatenate(x) for x in zip(*held, strict=True)))
            keys = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(key)])
            return pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate((a, hub))), pa.array(np.concatenate((b, line)))], ["key", "a", "b"])

        now, held = None, []
        for batch in batches:
            for part, *cells in zip(*batch.columns, strict=True):
                if held and part.as_py() != now:
                    yield found()
                    held = []
                now = part.as_py()
                held.append(tuple(np.frombuffer(x.as_buffer(), t) for x, t in zip(cells, (np.uint32, np.int64, np.uint16), strict=True)))
        if held:
            yield found()

    dealt = seen.where("keys is not null").select("lines", "sizes", "parts", "keys", "spots").mapInArrow(deal, "part long, keys binary, lines binary, spots binary")
    return cut(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "key long, a long, b long"), "buckets")


def line_groups(docs: DataFrame, seen: DataFrame, shared: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(h, first): for each normalised line that occurs again, exactly or nearly, its hash
    and the first occurrence (doc_id, th, at) of its group. seen: occurrences() of docs;
    shared: buckets() of them."""
    distinct = cut(seen.groupBy("h").agg(F.min(F.struct("doc_id", "th", "at")).alias("first"), F.count(F.lit(1)).alias("n")), "lines")
    texts: list[DataFrame] = []

    def plain(batches):
        before = None
        for batch in batches:
            ids, lines = [], []
            for d, t, line, ask in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (d, t) != before:  # the join has put repeated rows together
                    parts = line.split("\n")
                    ids += [a["h"] for a in ask]
                    lines += [parts[a["at"]] for a in ask]
                before = d, t
            norm = normalised("\n".join(lines)).split("\n") if lines else []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(all_counts(norm), pa.binary()), pa.array(norm, pa.string())], ["id", "counts", "norm"])

    def check(pairs):
        if not texts:  # of the lines that have any neighbour
            ids = shared.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            places = distinct.join(ids, F.col("h") == F.col("id"), "left_semi").groupBy(F.col("first.doc_id").alias("d"), F.col("first.th").alias("t")).agg(F.collect_list(F.struct(F.col("first.at").alias("at"), "h")).alias("ask"))
            held = _told(docs, id_col, text).join(places.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
            texts.append(cut(held.select("doc_id", "th", "text", "ask").mapInArrow(plain, "id long, counts binary, norm string"), "texts"))
        elif len(texts) == 1:  # only lines of large buckets are drawn
            texts.append(cut(texts[0].join(large.select("id").distinct(), "id", "left_semi"), "texts"))
        told = lambda x: texts[-1].select(F.col("id").alias(x), F.col("counts").alias(f"counts_{x}"), F.col("norm").alias(f"norm_{x}"))

        def run(batches):
            for batch in filter(len, batches):
                norm = [batch.column(i).to_pylist() for i in (4, 5)]
                may = np.flatnonzero(within(tuple(np.array(list(map(len, x))) for x in norm), (_bags(batch.column(2).to_pylist()), _bags(batch.column(3).to_pylist()))))
                ok = may[all_similar(*([x[k] for k in may] for x in norm))]
                yield batch.select([0, 1]).take(pa.array(ok))

        size = lambda x: F.col(x).bitwiseAND(F.lit(SIZES))
        like = pairs.where(F.abs(size("a") - size("b")) <= APART)
        return like.join(told("a"), "a").join(told("b"), "b").select("a", "b", "counts_a", "counts_b", "norm_a", "norm_b").mapInArrow(run, "a long, b long")

    def compare(c, keys, counts, norm):
        c = np.unique(np.array(c), return_inverse=True)[1]
        common = np.bincount(c).argmax()  # two rows of the largest component need no test
        size, bags = np.array(list(map(len, norm))), _bags(counts)
        bucket, own = keys[0][0], np.array([bool(k[1]) for k in keys])
        own_keys = [frozenset(k[2:]) for k in keys]
        lead, at = c == common, np.arange(len(c))
        held: list[tuple[int, int]] = []

        def linked():
            may = [(i, j) for i, j in held if c[i] != c[j]]
            held.clear()
            for (i, j), ok in zip(may, agreed(*([(norm[p[k]],) for p in may] for k in (0, 1))), strict=True):
                if ok and c[i] != c[j]:
                    c[c == c[i]] = c[j]
                    yield i, j

        alone = np.flatnonzero(~lead)
        some = max(1, WAVE // len(c))
        for begin in range(0, len(alone), some):
            i = alone[begin : begin + some, None]
            i, to = np.nonzero((lead | (at > i)) & (c != c[i]) & (own | own[i]))
            i = alone[begin + i]
            ok = within((size[to], size[i]), (bags[to], bags[i]))
            # A pair is compared in the first of the buckets that it shares.
            held += [(i, j) for i, j in zip(i[ok].tolist(), to[ok].tolist(), strict=True) if min(own_keys[i] & own_keys[j]) == bucket]
            if len(held) >= WAVE:
                yield from linked()
        yield from held

    def agreed(x, y):
        return all_similar([r[-1] for r in x], [r[-1] for r in y], easy=False)

    def rest(members):
        # Lengths of a link differ by APART classes at most, so by one step of as many and one:
        # two steps meet in the group of the upper one, whose own lines come first in their keys.
        step = F.floor(F.col("id").bitwiseAND(F.lit(SIZES)) / (APART + 1))
        classed = members.withColumn("step", F.explode(F.array(step, step + 1)))
        return block_links(classed.select(F.xxhash64("key", "step").alias("key"), "id", "c", F.concat(F.array(F.col("key"), (F.col("step") == step).cast("long")), "keys").alias("keys")), texts[-1], ["counts", "norm"], compare, agreed)

    large = shared.where("key is not null").select("key", F.col("b").alias("id"), F.col("a").alias("hub"))
    label = settle(large, check, rest, shared.where("key is null").select("a", "b"), clustered=False)
    grouped = distinct.join(label, F.col("h") == F.col("id"), "left").select("h", "first", "n", F.coalesce("component_id", "h").alias("g"))
    total = grouped.groupBy("g").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("g", "first")
    found = cut(grouped.select("h", "g").join(total, "g").select("h", "first"), "groups")
    drop(distinct, shared, *texts)
    return found


@stored
def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, gone): the places of the lines of each row that are not the first of
    their group; th is xxhash64 of the text. Rows without any are absent.

    Null and empty texts have no lines, and lines without a letter or number take no part.
    Of lines under SHORTEST normalised characters only equal ones are one group. The order
    is that of (doc_id, th, place), a null id first; rows that repeat id and text are one
    row and keep the same lines. Other columns are ignored.

    Scale: a line is a hash and 24 keys of 8 bytes, a short one about 40 keys, and of 14 bytes
    while they meet; texts move once, and only lines that share a key and may be linked, see
    near(), are stored. Buckets of more than SMALL lines are settled as groups.py says.
    """
    keyed = cut(occurrences(docs, id_col, text), "occurrences")
    seen, shared = cut(keyed.where("keys is null").select("doc_id", "th", "at", "h"), "places"), buckets(keyed)
    drop(keyed)
    found = seen.join(line_groups(docs, seen, shared, id_col, text), "h")
    own = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.th") == F.col("th")) & (F.col("first.at") == F.col("at"))
    return found.where(~own).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def _joined(docs: DataFrame, id_col: str, text: str, gone: str) -> DataFrame:
    """docs with the array `gone`, null where no line goes."""
    d, t = fresh(docs, "id"), fresh(docs, "th")
    places = repeated_lines(docs, id_col, text).select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("gone").alias(gone))
    return docs.join(places, F.col(id_col).eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(t)), "left").drop(d, t)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (places of the removed lines, comma-joined)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    places = repeated_lines(docs).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "gone")
    out = docs.select("doc_id", F.xxhash64("text").alias("th"), n.alias("n_lines")).join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those left without any word go.

    Null texts and texts that lose no line stay as they are, blank ones included. See
    repeated_lines for ties, repeated rows and null ids. All columns of docs are kept.
    """
    gone = fresh(docs, "gone")
    rest = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNotNull(), F.array_join(rest, "\n")).otherwise(F.col("text"))
    new = _joined(docs, "doc_id", "text", gone).withColumn("text", text).where(F.col(gone).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return counted(new, docs)
