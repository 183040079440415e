"""Benchmark passages in documents: CGK walks, bit-sampling hashes, gapped seeds, and exact verification by edit distance.

Texts are compared in lower case with single blanks between words. The CGK embedding walks over a string: at each step it
writes out the character under the pointer and advances by a random bit that depends on step and character, so that strings at a small edit
distance get outputs at a small Hamming distance. A window starts at every word of every document, and at every word of an
item. Each window is walked ``WALKS`` times with different bits; ``TABLES`` hashes of ``SAMPLED`` outputs of a walk's
``STEPS`` are compared with those of the items. An item of n words has about n windows with 8 hashes each, any of which may
find it. Only outputs that a hash samples need to be walked, so a walk ends there, after about 20 bytes. That takes a
nearly clean stretch of the item, which edits spread evenly do not leave.

Gapped seeds find those: ``GRAM`` letters, one letter, ``GRAM`` letters of an item at any place, met by the same letters of a text with
none, one or two letters between, so that a seed spans an edit of any kind. Edits at every fifth letter leave a seed around each.
An item of n letters is a candidate where n / ``LETTERS_A_HIT`` seeds meet on about one diagonal, far fewer than are left at the full
distance, whether edits are spread evenly or at random.

Whatever is found is verified over the whole item: the least edit distance of the item to any part of the text around the
place, by bit-parallel dynamic programming, is at most ``1 - SIMILARITY`` of the item's length. The places of a slice of texts are
verified side by side. Items over ``TOGETHER_LETTERS`` are verified place by place, unless too few of their grams of three and four letters are there.

Items are broadcast in blocks of bounded size; a larger benchmark takes more passes over the documents.
Items of less than ``SURE_LETTERS`` are too short for as many seeds, and are looked for in every text exactly: of as many parts as
edits are allowed and one more, one is met unchanged, and the verification reads the text around each.

Defined results: null, empty and blank texts and items hold and match nothing; an item that occurs several times in a
text is one row with its least distance; rows of the benchmark with equal id and text are one item. Repeated
documents give repeated rows, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archidex.llm.common import text_udf, worker_state

SIMILARITY = 0.8
WALKS = 2
TABLES = 4
STEPS = 40
SAMPLED = 20
SEED = 7
BLOCK_BYTES = 4 << 20
FILTER_BITS = 18
GRAM = 4
GAPS = (0, 1, 2)  # letters of a text in the place of an item's one: one was deleted, replaced, or another inserted
LETTERS_A_HIT = 20
SURE_LETTERS = 50
SEED_BITS = 20
SURE_GRAMS = (4, 3)  # letters of the grams whose number shows that an item can't be near a place
STRETCH = 1 << 18  # letters whose seeds are counted at once
WINDOWS_AT_ONCE = 16_384  # so that a step's arrays stay in a core's cache
TOGETHER_LETTERS = 4096  # longer items are verified place by place
WORDS_AT_ONCE = 8192  # 64 letters of an item each
MASK_WORDS = 1 << 22
FOUND = "array<struct<item:int,distance:int>>"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


@dataclass(frozen=True, eq=False)
class Walk:
    """Random bits by step and byte, and which steps each of the walk's hashes samples."""

    bits: np.ndarray
    samples: tuple[frozenset[int], ...]


def walks() -> list[Walk]:
    random = np.random.default_rng(SEED)
    made = []
    for _ in range(WALKS):
        bits = random.integers(0, 2, size=(STEPS, 256)).astype(np.uint8)
        bits[:, 0] = 0  # a text's end mark holds the walk
        made.append(Walk(bits, tuple(frozenset(random.choice(STEPS, SAMPLED, replace=False).tolist()) for _ in range(TABLES))))
    return made


def window_hashes(buffer: np.ndarray, starts: np.ndarray, made: list[Walk]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each hash: its number, its value at each window's start, and where the walk stood at its last step."""
    factor = np.uint64(0x9E3779B97F4A7C15)
    letter = np.empty(len(starts), dtype=np.uint8)
    bit = np.empty(len(starts), dtype=np.uint8)
    for number, walk in enumerate(made):
        at = starts.astype(np.int64)
        values = [np.full(len(starts), number * TABLES + t + 1, dtype=np.uint64) for t in range(TABLES)]
        for step in range(STEPS):
            np.take(buffer, at, out=letter, mode="clip")
            for t, sampled in enumerate(walk.samples):
                if step in sampled:
                    values[t] += letter
                    values[t] *= factor
            np.take(walk.bits[step], letter, out=bit, mode="clip")
            at += bit
        for t, value in enumerate(values):
            value ^= value >> np.uint64(29)
            yield number * TABLES + t, value * factor, at


def word_starts(buffer: np.ndarray) -> np.ndarray:
    """Places of a word's first byte; texts are ended by zero bytes."""
    gap = (buffer == 32) | (buffer == 0)
    return np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))


def least_distance(item: str, text: str, most: int) -> int | None:
    """The least edit distance of the item to any part of the text, if at most ``most``."""
    if item in text:
        return 0
    size, masks = len(item), {}
    for place, letter in enumerate(item):
        masks[letter] = masks.get(letter, 0) | 1 << place
    full, top = (1 << size) - 1, 1 << size - 1
    # Bits of up and down say where the column of the distance table rises and falls by one.
    up, down, score = full, 0, size
    best, reach, known = score, most + len(text), masks.get
    for letter in text:
        same = known(letter, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rises = down | ~(diagonal | up) & full
        falls = up & diagonal
        if rises & top:
            score += 1
        elif falls & top:
            score -= 1
        rises = rises << 1 & full  # the first row is zero: a match may begin anywhere
        falls = falls << 1 & full
        up = falls | ~(diagonal | rises) & full
        down = rises & diagonal
        if score < best:
            best = score
        reach -= 1
        if score > reach:  # it falls by one a letter at most
            break
    return best if best <= most else None


class Together:
    """Places of many items, verified side by side: ``least_distance`` with a row of each item's words of 64 bits in one array.

    Longer places are cut with as much overlap as a part within ``most`` edits may take, so none is lost.
    """

    def __init__(self, codes: np.ndarray, items: list[np.ndarray], most: np.ndarray):
        self.codes, self.items, self.most = codes, items, most
        self.sizes = np.array([len(t) for t in items], dtype=np.int64)

    def distances(self, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For every place, given by its item and letters, the least distance, or one over ``most`` if none is at most that."""
        out = self.most[item] + 1
        reach = self.sizes[item] + self.most[item]
        pieces = np.maximum(1, -(-(end - begin - reach) // (2 * reach)))
        place = np.repeat(np.arange(len(item)), pieces)
        part = np.arange(len(place)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = begin[place] + part * 2 * reach[place]
        end = np.minimum(begin + 3 * reach[place], end[place])
        order = np.argsort(item[place], kind="stable")
        words = -(-self.sizes[item[place[order]]] // 64)
        letters = np.unique(np.concatenate([np.empty(0, np.uint32), *(self.items[n] for n in np.unique(item).tolist())]))
        group = np.cumsum(words) // max(1, min(WORDS_AT_ONCE, MASK_WORDS // (len(letters) + 1)))
        for some in np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else ():
            some = some[np.argsort(begin[some] - end[some], kind="stable")]  # the longest first, so that those not ended are a prefix
            np.minimum.at(out, place[some], self._batch(item[place[some]], begin[some], end[some] - begin[some], letters))
        return out

    def _masks(self, items: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each item has each letter, by item, letter and word, and where each item's masks begin; no item has the last letter."""
        words = -(-self.sizes[items] // 64)
        ends = np.cumsum(words * (len(letters) + 1))
        first = ends - words * (len(letters) + 1)
        at = np.concatenate([np.arange(self.sizes[n]) for n in items.tolist()])
        letter = np.searchsorted(letters, np.concatenate([self.items[n] for n in items.tolist()]))
        owner = np.repeat(np.arange(len(items)), self.sizes[items])
        masks = np.zeros(ends[-1], dtype=np.uint64)
        np.bitwise_or.at(masks, first[owner] + letter * words[owner] + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        return masks, first

    def _batch(self, item: np.ndarray, begin: np.ndarray, length: np.ndarray, letters: np.ndarray) -> np.ndarray:
        one, high = np.uint64(1), np.uint64(63)
        kinds, row = np.unique(item, return_inverse=True)
        masks, first = self._masks(kinds, letters)
        size = self.sizes[item]
        words = -(-size // 64)
        ends = np.cumsum(words)
        owner = np.repeat(np.arange(len(item)), words)
        mask_at = first[row[owner]] + np.arange(ends[-1]) - (ends - words)[owner]
        inner = np.ones(ends[-1], dtype=np.uint64)  # whether a word continues the one before
        inner[ends - words] = 0
        top = ((size - 1) & 63).astype(np.uint64)
        table = np.full(int(letters[-1]) + 2, len(letters), dtype=np.int64)
        table[letters] = np.arange(len(letters))
        up, down = np.full(ends[-1], ~np.uint64(0)), np.zeros(ends[-1], dtype=np.uint64)
        score, best = size.copy(), size.copy()
        open_at = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        for step, count in enumerate(open_at.tolist()):
            n = int(ends[count - 1])
            if len(up) > n:
                up, down = up[:n], down[:n]
            letter = np.take(table, np.take(self.codes, begin[:count] + step), mode="clip") * words[:count]
            same = np.take(masks, mask_at[:n] + np.take(letter, owner[:n]))
            total = same & up
            carry = total + up
            over = (carry < total).view(np.uint8)
            total = carry
            while over[:-1].any():  # into the next word, seldom through it
                more = over[:-1] * inner[1:n]
                total[1:] += more
                over = np.concatenate([[np.uint8(0)], (total[1:] < more).view(np.uint8)])
            total ^= up
            total |= same
            total |= down  # where the diagonal does not rise
            rises = total | up
            np.invert(rises, out=rises)
            rises |= down
            falls = up & total
            last = ends[:count] - 1
            score[:count] += (rises[last] >> top[:count] & one).view(np.int64)
            score[:count] -= (falls[last] >> top[:count] & one).view(np.int64)
            np.minimum(best[:count], score[:count], out=best[:count])
            for bits in (rises, falls):  # the first row is zero: a match may begin anywhere
                out = bits[:-1] >> high
                out &= inner[1:n]
                bits <<= one
                bits[1:] |= out
            down = rises & total
            rises |= total
            np.invert(rises, out=rises)
            rises |= falls
            up = rises
        return best


def grams_of(text: str, size: int) -> list[str]:
    return [text[k : k + size] for k in range(len(text) - size + 1)]


def may_be_near(grams: dict[int, list[str]], text: str, most: int) -> bool:
    """False only if no part of the text is within ``most`` edits of the item with these grams by their length.

    An edit changes at most as many of the item's grams as a gram has letters; all others are in the text.
    """
    for size, of_item in grams.items():
        least = len(of_item) - size * most
        if least > 0 and sum(map(set(grams_of(text, size)).__contains__, of_item)) < least:
            return False
    return True


def least_anywhere(item: str, text: str, most: int) -> int | None:
    """As ``least_distance``, with fewer letters read: of ``most + 1`` parts of the item one is met unchanged."""
    if item in text:
        return 0
    size, spans = len(item), []
    cuts = [size * k // (most + 1) for k in range(most + 2)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        at = text.find(item[a:b])
        while at >= 0:
            spans.append((max(0, at - a - most), at - a + size + most))
            at = text.find(item[a:b], at + 1)
    joined: list[list[int]] = []
    for begin, end in sorted(set(spans)):
        if joined and begin <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([begin, end])
    found = (least_distance(item, text[begin:end], most) for begin, end in joined)
    return min((d for d in found if d is not None), default=None)


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` letters from each place on."""
    size = max(len(codes) - GRAM + 1, 0)
    value = codes[:size].copy()
    for k in range(1, GRAM):
        value *= np.uint32(0x9E3779B1)
        value += codes[k : size + k]
    value *= np.uint32(0x85EBCA77)
    value ^= value >> np.uint32(15)
    return value


def seed_hashes(grams: np.ndarray, gap: int) -> np.ndarray:
    """A hash of two grams with ``gap`` letters between from each place on."""
    size = max(len(grams) - GRAM - gap, 0)
    value = grams[:size] * np.uint32(0xC2B2AE3D)
    value += grams[GRAM + gap : GRAM + gap + size]
    value *= np.uint32(0x27D4EB2F)
    value ^= value >> np.uint32(13)
    return value


class Seeds:
    """Gapped seeds of the items with the given numbers."""

    def __init__(self, items: list[str], numbers: list[int]):
        self.count = len(items)
        sizes = np.array([len(t) for t in items], dtype=np.int64)
        self.least = np.maximum(2, sizes // LETTERS_A_HIT)
        self.band = 2 * (sizes * (1 - SIMILARITY)).astype(np.int64) + 2
        self.overlap = int(2 * max((sizes[n] for n in numbers), default=0)) + 16
        values = [seed_hashes(gram_hashes(letters(items[n])), 1) for n in numbers]
        value = np.concatenate([np.empty(0, np.uint32), *values])
        order = np.argsort(value, kind="stable")
        self.value = value[order]
        self.owner = np.repeat(np.array(numbers, dtype=np.int64), [len(v) for v in values])[order]
        self.offset = np.concatenate([np.empty(0, np.int64), *(np.arange(len(v)) for v in values)])[order]
        filled = np.bincount(self.value >> np.uint32(32 - SEED_BITS), minlength=1 << SEED_BITS)
        self.starts = np.concatenate([[0], np.cumsum(filled)]).astype(np.int32)
        self.seen = filled > 0

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the text and number of the seed for every seed met."""
        places, seeds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a in range(0, len(codes), WINDOWS_AT_ONCE):
            # As many grams as the widest seed from the last place needs, and one place more for each narrower gap.
            grams = gram_hashes(codes[a : a + WINDOWS_AT_ONCE + 2 * GRAM + max(GAPS) - 1])
            for gap in GAPS:
                value = seed_hashes(grams, gap)[:WINDOWS_AT_ONCE]
                top = value >> np.uint32(32 - SEED_BITS)
                maybe = np.flatnonzero(np.take(self.seen, top))
                first = self.starts[top[maybe]].astype(np.int64)
                many = self.starts[top[maybe] + 1] - first
                ends = np.cumsum(many)
                if not len(ends):
                    continue
                seed = np.arange(ends[-1]) + np.repeat(first - ends + many, many)
                place = np.repeat(maybe, many)
                same = self.value[seed] == value[place]
                places.append(place[same] + a)
                seeds.append(seed[same])
        return np.concatenate(places), np.concatenate(seeds)

    def near(self, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item, and about where in all texts' letters the item would begin. ``begins``: the texts' first letters."""
        found = [np.empty((3, 0), np.int64)]
        stretch = max(STRETCH, 4 * self.overlap)
        for a in range(0, len(codes) if len(self.value) else 0, stretch - self.overlap):
            place, seed = self.hits(codes[a : a + stretch])
            place += a
            text = np.searchsorted(begins, place, side="right") - 1
            key, diagonal = text * self.count + self.owner[seed], place - self.offset[seed]
            order = np.lexsort((diagonal, key))
            key, diagonal = key[order], diagonal[order]
            item = key % self.count
            last = np.arange(len(key)) + self.least[item] - 1
            inside = np.flatnonzero(last < len(key))
            last = last[inside]
            enough = (key[last] == key[inside]) & (diagonal[last] - diagonal[inside] <= self.band[item[inside]])
            key, diagonal = key[inside[enough]], diagonal[inside[enough]]  # in order, so equal ones are neighbours
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (diagonal[1:] != diagonal[:-1])])[: len(key)]
            found.append(np.stack([key[new] // self.count, key[new] % self.count, diagonal[new]]))
        return tuple(np.concatenate(found, axis=1))


class Letters:
    """Texts, each ended by a zero, as letters and as bytes, and places of one in the other."""

    def __init__(self, texts: list[str]):
        joined = "\0".join([*texts, ""])
        self.codes = letters(joined)
        self.buffer = np.frombuffer(joined.encode(), dtype=np.uint8)
        self.begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.later = np.flatnonzero(self.buffer & 0xC0 == 0x80)  # bytes that continue a letter
        self.of_letter = self.later - np.arange(len(self.later)) - 1
        self.byte_begins = self.byte_of(self.begins)

    def byte_of(self, letter: np.ndarray) -> np.ndarray:
        return letter + np.searchsorted(self.of_letter, letter)

    def whole(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The letters that lie wholly within the bytes."""
        cut = self.buffer[np.minimum(end, len(self.buffer) - 1)] & 0xC0 == 0x80
        return begin - np.searchsorted(self.later, begin), end - np.searchsorted(self.later, end) - cut


class Index:
    """Hashes of all windows, and the seeds, of a block of items."""

    def __init__(self, items: list[str]):
        self.items = [normal(t) for t in items]
        self.allowed = [int((1 - SIMILARITY) * len(t) + 1e-9) for t in self.items]
        self.codes = [letters(t) for t in self.items]
        self.most = np.array(self.allowed, dtype=np.int64)
        self.letter_sizes = np.array([len(t) for t in self.items], dtype=np.int64)
        self.byte_sizes = np.array([len(t.encode()) for t in self.items], dtype=np.int64)
        self.walks = walks()
        self.short = [n for n, t in enumerate(self.items) if 0 < len(t) < SURE_LETTERS]
        self.seeds = Seeds(self.items, [n for n, t in enumerate(self.items) if len(t) >= SURE_LETTERS])
        hashes: list[list[np.ndarray]] = [[] for _ in range(WALKS * TABLES)]
        owners: list[list[np.ndarray]] = [[] for _ in range(WALKS * TABLES)]
        for number, item in enumerate(self.items):
            if len(item) < SURE_LETTERS:
                continue
            data = item.encode()
            buffer = np.frombuffer(data + b"\0", dtype=np.uint8)
            starts = word_starts(buffer)
            for k, value, end in window_hashes(buffer, starts, self.walks):
                inside = end < len(data)  # else the item's end has stopped the walk
                hashes[k].append(value[inside])
                owners[k].append(np.stack([np.full(inside.sum(), number), starts[inside]]))
        self.tables = []
        for values, owner in zip(hashes, owners, strict=True):
            value = np.concatenate([np.empty(0, np.uint64), *values])
            order = np.argsort(value, kind="stable")
            seen = np.zeros(1 << FILTER_BITS, dtype=bool)
            seen[value >> np.uint64(64 - FILTER_BITS)] = True
            self.tables.append((value[order], np.concatenate([np.empty((2, 0), np.int64), *owner], axis=1)[:, order], seen))

    def candidates(self, shown: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item, and where in the text's bytes the item would begin, in the order of all three."""
        starts = word_starts(shown.buffer)
        found = [np.empty((3, 0), np.int64)]
        for some in np.split(starts, range(WINDOWS_AT_ONCE, len(starts), WINDOWS_AT_ONCE)):
            for k, value, _ in window_hashes(shown.buffer, some, self.walks):
                known, owner, seen = self.tables[k]
                maybe = np.flatnonzero(seen[(value >> np.uint64(64 - FILTER_BITS)).view(np.int64)])
                if not len(maybe):
                    continue
                low = np.searchsorted(known, value[maybe], side="left")
                many = np.searchsorted(known, value[maybe], side="right") - low
                if not many.any():
                    continue
                ends = np.cumsum(many)
                item, offset = owner[:, np.arange(ends[-1]) + np.repeat(low - ends + many, many)]
                place = np.repeat(some[maybe], many)
                text = np.searchsorted(shown.byte_begins, place, side="right") - 1
                found.append(np.stack([text, item, place - shown.byte_begins[text] - offset]))
        text, item, begin = self.seeds.near(shown.codes, shown.begins)
        before = np.where(begin <= shown.begins[text], begin - shown.begins[text], shown.byte_of(begin) - shown.byte_begins[text])
        found.append(np.stack([text, item, before]))
        text, item, begin = np.concatenate(found, axis=1)
        order = np.lexsort((begin, item, text))
        return text[order], item[order], begin[order]

    def verified(self, text: str, item: int, begins: list[int]) -> int | None:
        """The item's least distance near any of the places, read as bytes of the text."""
        data, size, allowed = text.encode(), len(self.items[item].encode()), self.allowed[item]
        slack = 2 * allowed + 16  # in bytes, whatever the alphabet
        spans: list[list[int]] = []
        for begin in sorted(set(begins)):
            a, b = max(0, begin - slack), begin + size + slack
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        texts = (data[a:b].decode("utf-8", "ignore") for a, b in spans)
        grams = {size: grams_of(self.items[item], size) for size in SURE_GRAMS}
        near = (least_distance(self.items[item], t, allowed) for t in texts if may_be_near(grams, t, allowed))
        return min((d for d in near if d is not None), default=None)

    def verified_together(self, shown: Letters, text: np.ndarray, item: np.ndarray, begin: np.ndarray) -> dict[tuple[int, int], int]:
        """As ``verified`` for many texts and items, ordered by text, item and place: distances of those found."""
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])])[: len(text)]
        slack = 2 * self.most[item] + 16
        a, b = np.maximum(begin - slack, 0), begin + self.byte_sizes[item] + slack
        new[1:] |= a[1:] > b[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(text))[: len(first)] - 1
        text, item = text[first], item[first]
        base, end = shown.byte_begins[text], shown.byte_begins[text + 1] - 1
        a, b = shown.whole(base + a[first], np.minimum(base + b[last], end))
        distance = Together(shown.codes, self.codes, self.most).distances(item, a, b)
        out: dict[tuple[int, int], int] = {}
        for k in np.flatnonzero(distance <= self.most[item]).tolist():
            key = int(text[k]), int(item[k])
            out[key] = min(int(distance[k]), out.get(key, int(distance[k])))
        return out

    def search(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Numbers and distances of the items found in each text."""
        texts = [normal(t) for t in texts]
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        shown = Letters(texts)
        text, item, begin = self.candidates(shown)
        long = self.letter_sizes[item] > TOGETHER_LETTERS
        found = self.verified_together(shown, text[~long], item[~long], begin[~long])
        places: dict[tuple[int, int], list[int]] = {}
        for t, i, place in zip(text[long].tolist(), item[long].tolist(), begin[long].tolist(), strict=True):
            places.setdefault((t, i), []).append(place)
        for (t, i), begins in places.items():
            distance = self.verified(texts[t], i, begins)
            if distance is not None:
                found[t, i] = distance
        for (t, i), distance in sorted(found.items()):
            out[t].append((i, distance))
        for item in self.short:
            for text, whole in enumerate(texts):
                distance = least_anywhere(self.items[item], whole, self.allowed[item])
                if distance is not None and whole:
                    out[text].append((item, distance))
        return out


def item_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the items in blocks of about ``BLOCK_BYTES``."""
    items = benchmark.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).orderBy("id", "text").collect()
        yield [r["id"] for r in rows], [r["text"] for r in rows]


def passages(docs: DataFrame, items: list[str], text: str = "text") -> Column:
    """The items found in the text column: an array of (number, distance)."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(items))

    def search(texts: list[str]) -> pa.Array:
        items = shared.value
        index = worker_state(("passages", items), lambda: Index(list(items)))
        found = [[{"item": i, "distance": d} for i, d in hits] for hits in index.search(texts)]
        return pa.array(found, pa.list_(pa.struct([("item", pa.int32()), ("distance", pa.int32())])))

    return text_udf(search, FOUND)(F.col(text))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, item_id, distance and item_chars of every benchmark item in every document. No shuffle."""
    out = None
    for ids, items in item_blocks(benchmark):
        rows = [(number, i, len(normal(t))) for number, (i, t) in enumerate(zip(ids, items, strict=True))]
        # As many rows as the block has items, which its size bounds.
        named = F.broadcast(docs.sparkSession.createDataFrame(rows, "item int, item_id long, item_chars long"))
        hits = docs.select(F.col(key).alias("key"), F.explode(passages(docs, items, text)).alias("hit")).select("key", "hit.*")
        part = hits.join(named, "item").select(F.col("key").alias(key), "item_id", "distance", "item_chars")
        out = part if out is None else out.unionAll(part)
    return out
