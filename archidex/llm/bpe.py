"""Byte-level BPE: an exact encoder by backtracking over longest matches, and a decoder by an offset table.

A sequence of tokens is the BPE result of its bytes exactly if each token is the result of its own bytes
and each neighbouring pair is the result of the pair's bytes. So the encoder takes the longest token that an
Aho-Corasick automaton finds at a position, keeps it if it is compatible with the token before it, tries the next
shorter token if not, and goes back one token when none is left. Every prefix has one result only, so a position
from which nothing fits is never tried again and the time is linear in the text.

Defined results: a null text is the empty text, with no tokens; null ids decode to the empty text; ids outside the
vocabulary are left out by the decoder, and bytes that are not UTF-8 become U+FFFD. Rows are independent: repeated
rows and null document ids pass through, other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from archidex.llm.common import gather, sliced, texts_of, worker_state

CACHED_WORDS = 300_000
CACHED_PAIRS = 500_000

# The published pre-token pattern of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Characters whose class is the same in every Unicode version since the tokenizer's own.
# Texts with others are split by the tokenizer library's splitter, which has its Unicode tables.
STABLE = re.compile(r"[\x00-՗ -₎₠-ꟍ가-힣]*\Z")


def byte_alphabet() -> dict[str, int]:
    """The vocabulary file's character for each byte: itself if printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes by id, merged id by pair of ids, and the special tokens' ids by their text."""

    pieces: tuple[bytes, ...]
    merges: dict[tuple[int, int], int] = field(hash=False, compare=False)
    specials: dict[str, int] = field(hash=False, compare=False)


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file (JSON, byte-level BPE). Its size is fixed, so it may be broadcast."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_alphabet()
    ids = spec["model"]["vocab"]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pieces: list[bytes] = [b""] * (1 + max([*ids.values(), *specials.values()]))
    for text, i in ids.items():
        pieces[i] = bytes(letters[c] for c in text)
    for text, i in specials.items():
        pieces[i] = text.encode()
    merges = {}
    for rule in spec["model"]["merges"]:
        left, right = rule.split(" ") if isinstance(rule, str) else rule
        merges[ids[left], ids[right]] = ids[left + right]
    return Vocabulary(tuple(pieces), merges, specials)


class Encoder(dict):
    """Packed ids by pre-token: a bounded memory of what was encoded before."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        special = set(vocabulary.specials.values())
        self.ids = {p: i for i, p in enumerate(vocabulary.pieces) if i not in special}
        # Merges are applied in the order of the merged token's place among the merges.
        self.order = {pair: k for k, pair in enumerate(vocabulary.merges)}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece.decode("latin-1"), (i, len(piece)))
        self.automaton.make_automaton()
        self.compatible_pairs: dict[tuple[int, int], bool] = {}
        self.shorter_tokens: dict[int, int] = {}
        self.whole = regex.compile(PATTERN)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        names = sorted(vocabulary.specials, key=len, reverse=True)
        self.split_specials = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else lambda t: [t]

    def merged(self, data: bytes) -> list[int]:
        """The ids of a few bytes by the definition: merge the first rule that applies until none does."""
        ids = [self.ids[bytes([b])] for b in data]
        while len(ids) > 1:
            pairs = list(zip(ids[:-1], ids[1:], strict=True))
            best = min(pairs, key=lambda p: self.order.get(p, len(self.order)))
            if best not in self.order:
                break
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == best:
                    out.append(self.vocabulary.merges[best])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes together encode to these two tokens. ``left`` -1: the token alone."""
        known = self.compatible_pairs.get((left, right))
        if known is None:
            if len(self.compatible_pairs) >= CACHED_PAIRS:
                self.compatible_pairs.clear()
            before = [left] if left >= 0 else []
            tokens = [*before, right]
            known = self.merged(b"".join(self.vocabulary.pieces[t] for t in tokens)) == tokens
            self.compatible_pairs[left, right] = known
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if there is none."""
        known = self.shorter_tokens.get(token)
        if known is None:
            piece = self.vocabulary.pieces[token]
            found = (self.ids[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids)
            known = self.shorter_tokens[token] = next(found, -1)
        return known

    def encode_word(self, data: bytes) -> list[int]:
        size, pieces = len(data), self.vocabulary.pieces
        longest = [-1] * (size + 1)
        for end, (token, length) in self.automaton.iter(data.decode("latin-1")):
            longest[end - length + 1] = token  # ends only grow, so the last is the longest
        path: list[int] = []
        dead = bytearray(size + 1)
        at, token = 0, longest[0]
        while at < size:
            before = path[-1] if path else -1
            while token >= 0 and (
                dead[at + len(pieces[token])]
                or not self.compatible(-1, token)
                or (before >= 0 and not self.compatible(before, token))
            ):
                token = self.shorter(token)
            if token >= 0:
                path.append(token)
                at += len(pieces[token])
                token = longest[at]
            else:
                dead[at] = 1
                token = path.pop()
                at -= len(pieces[token])
                token = self.shorter(token)
        return path

    def __missing__(self, word: str) -> bytes:
        packed = array("i", self.encode_word(word.encode())).tobytes()
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = packed
        return packed

    def pre_tokens(self, text: str) -> list[str]:
        if STABLE.match(text):
            return self.whole.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """The text's ids, packed as 32-bit integers. Special tokens' strings become their ids."""
        if not any(name in text for name in self.vocabulary.specials):
            return b"".join(map(self.__getitem__, self.pre_tokens(text)))
        out = []
        for part in self.split_specials(text):
            if part in self.vocabulary.specials:
                out.append(array("i", [self.vocabulary.specials[part]]).tobytes())
            else:
                out.extend(map(self.__getitem__, self.pre_tokens(part)))
        return b"".join(out)


class Decoder:
    """All tokens' bytes in one block, and each token's place in it."""

    def __init__(self, vocabulary: Vocabulary):
        self.sizes = np.array([len(p) for p in vocabulary.pieces], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(vocabulary.pieces), dtype=np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ``ids[offsets[i]:offsets[i + 1]]``."""
        known = (ids >= 0) & (ids < len(self.sizes))
        ids = np.where(known, ids, 0)
        sizes = np.where(known, self.sizes[ids], 0)
        data = gather(self.blob, self.starts[ids], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def worker_codec(vocabulary: Vocabulary) -> tuple[Encoder, Decoder]:
    """This process's encoder and decoder, built once."""
    return worker_state(vocabulary, lambda: (Encoder(vocabulary), Decoder(vocabulary)))


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key and ``ids`` (array of int). No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = worker_codec(shared.value)
        for part in sliced(batches, "text"):
            packed = [encoder.encode(t) for t in texts_of(part, "text")]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
            ids = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([part.column("key"), ids], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    pairs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return pairs.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per document: its key, its ``ids`` and their text as ``decoded``. No shuffle."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = worker_codec(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                lists = part.column("ids")
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                values = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                texts = pa.array(decoder.decode(values, offsets), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("key"), lists, texts], ["key", "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    pairs = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return pairs.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)
