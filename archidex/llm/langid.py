"""Language identification by unigram piece models that sum over all segmentations.

Each language has a probability for every piece of one fixed public vocabulary. The likelihood of a word, with the mark
``▁`` before it, is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over
its words. The language with the highest likelihood is predicted, its posterior under equal priors is the score.

The probabilities come from expectation maximisation over the words of a bounded sample: of each language the
``SAMPLE_DOCUMENTS`` labelled documents that come first by a hash of their id, among those of at most ``SAMPLE_CHARS``
characters. Predictions read the text alone. Distinct words are scored once for each slice and kept in a bounded memory.

Defined results: a null text, or one without a letter, is ``und`` with score 0; equal likelihoods go to the first
language in order; words over ``CHUNK`` characters are scored chunk by chunk; a character outside the vocabulary is an
unknown piece. Without labelled documents every text is ``und``. Repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archidex.llm.common import text_udf, worker_state
from archidex.llm.token_counts import WORD_MARK

SAMPLE_DOCUMENTS = 300
SAMPLE_CHARS = 20_000
ROUNDS = 3
SMOOTHING = 0.01
UNKNOWN_SHARE = 1e-7
CHUNK = 32
CACHED_WORDS = 300_000
UNDECIDED = "und"
SCHEMA = "lang_pred string, score double"

_LETTER = re.compile(r"[^\W\d_]")


class PieceTrie:
    """The vocabulary as a trie in sorted arrays, so that many places are looked up at once."""

    def __init__(self, pieces: tuple[str, ...]):
        nodes = {"": 0}
        for piece in pieces:
            for end in range(1, len(piece) + 1):
                nodes.setdefault(piece[:end], len(nodes))
        steps = sorted((nodes[prefix[:-1]] << 21 | ord(prefix[-1]), node) for prefix, node in nodes.items() if prefix)
        self.keys = np.array([key for key, _ in steps] or [-1], dtype=np.int64)
        self.children = np.array([node for _, node in steps] or [0], dtype=np.int64)
        self.piece = np.full(len(nodes), -1, dtype=np.int64)  # of the node's prefix, if it is one
        self.piece[[nodes[p] for p in pieces]] = range(len(pieces))
        self.unknown = len(pieces)
        at_root = (self.keys >= 0) & (self.keys < 1 << 21)
        self.roots = np.zeros(int(self.keys[at_root].max(initial=0)) + 2, dtype=np.int64)  # children of the root by letter; 0: none
        self.roots[self.keys[at_root]] = self.children[at_root]

    def begin(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``step`` from the root."""
        children = np.take(self.roots, letters, mode="clip")
        has = children > 0
        return has, children[has]

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a child by their letter, and those children."""
        wanted = nodes << 21 | letters
        found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        has = self.keys[found] == wanted
        return has, self.children[found[has]]


class Lattice:
    """All pieces at all places of a list of distinct chunks, ready for sums over segmentations."""

    def __init__(self, trie: PieceTrie, chunks: list[str]):
        letters = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        self.sizes = np.array([len(c) for c in chunks], dtype=np.int64)
        stops = np.cumsum(self.sizes)
        word = np.repeat(np.arange(len(chunks)), self.sizes)
        first, stop = (stops - self.sizes)[word], stops[word]
        at, node = np.arange(len(letters)), np.zeros(len(letters), dtype=np.int64)
        found, length = [], 0
        while len(at):
            has, children = trie.step(node, letters[at + length]) if length else trie.begin(letters)
            length += 1
            if length == 1:  # a single character always counts, if only as the unknown piece
                piece = np.full(len(at), trie.unknown)
                piece[has] = np.where(trie.piece[children] >= 0, trie.piece[children], trie.unknown)
                found.append((at, at + 1, piece))
                at, node = at[has], children
            else:
                at, node = at[has], children
                whole = trie.piece[node] >= 0
                found.append((at[whole], at[whole] + length, trie.piece[node[whole]]))
            more = at + length < stop[at]
            at, node = at[more], node[more]
        none = np.empty(0, dtype=np.int64)
        starts, ends, self.pieces = (np.concatenate([none, *x]) for x in (zip(*found, strict=True) if found else ([], [], [])))
        self.words = word[starts]
        self.starts, self.ends = starts - first[starts], ends - first[starts]

    def _sums(self, weights: np.ndarray, source: np.ndarray, target: np.ndarray, order: range) -> np.ndarray:
        """Sum of weight products of all ways from the first place of ``order`` to each place, per word and language."""
        reach = np.zeros((len(self.sizes), int(self.sizes.max(initial=0)) + 1, weights.shape[1]))
        first = np.zeros(len(self.sizes), dtype=np.int64) if order.step > 0 else self.sizes
        reach[np.arange(len(self.sizes)), first] = 1.0
        # Keys of two bytes or less are sorted by radix.
        by_target = np.lexsort((self.words.astype(np.min_scalar_type(len(self.sizes))), target.astype(np.min_scalar_type(reach.shape[1]))))
        bounds = np.searchsorted(target[by_target], np.arange(reach.shape[1] + 1))
        flat, row, pieces = reach.reshape(-1, weights.shape[1]), self.words[by_target] * reach.shape[1], self.pieces[by_target]
        goal, row = row + target[by_target], row + source[by_target]
        for place in order:
            a, b = bounds[place : place + 2]
            if a < b:
                steps = np.take(flat, row[a:b], axis=0) * np.take(weights, pieces[a:b], axis=0)
                goals = goal[a:b]
                firsts = np.flatnonzero(np.concatenate([[True], goals[1:] != goals[:-1]]))
                flat[goals[firsts]] += np.add.reduceat(steps, firsts, axis=0)
        return reach

    def forward(self, weights: np.ndarray) -> np.ndarray:
        return self._sums(weights, self.starts, self.ends, range(1, int(self.sizes.max(initial=0)) + 1))

    def likelihoods(self, weights: np.ndarray) -> np.ndarray:
        """Probability of each chunk in each language."""
        return self.forward(weights)[np.arange(len(self.sizes)), self.sizes]

    def expected(self, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, for one language, when each chunk occurs ``counts`` times."""
        ahead = self.forward(weights)
        behind = self._sums(weights, self.ends, self.starts, range(int(self.sizes.max(initial=0)) - 1, -1, -1))
        total = ahead[np.arange(len(self.sizes)), self.sizes, 0]
        used = ahead[self.words, self.starts, 0] * weights[self.pieces, 0] * behind[self.words, self.ends, 0]
        return np.bincount(self.pieces, used / total[self.words] * counts[self.words], minlength=len(weights))


def chunks_of(word: str) -> list[str]:
    marked = WORD_MARK + word
    return [marked[a : a + CHUNK] for a in range(0, len(marked), CHUNK)]


def words_of(text: str) -> list[str]:
    return text.lower().split()


@dataclass(frozen=True, eq=False)
class LanguageModel:
    pieces: tuple[str, ...]
    languages: tuple[str, ...]
    weights: np.ndarray  # piece (the last one unknown) by language
    name: str


def train(sample: dict[str, Counter], pieces: tuple[str, ...]) -> LanguageModel:
    """A model from each language's word counts."""
    trie, columns = PieceTrie(pieces), []
    languages = tuple(sorted(sample))
    for language in languages:
        counted: Counter = Counter()
        for word, n in sample[language].items():
            for chunk in chunks_of(word):
                counted[chunk] += n
        lattice = Lattice(trie, list(counted))
        counts = np.array(list(counted.values()), dtype=float)
        weights = np.full((len(pieces) + 1, 1), 1.0 / (len(pieces) + 1))
        for _ in range(ROUNDS):
            used = lattice.expected(weights, counts) + SMOOTHING
            weights = (used / used.sum())[:, None]
            weights[-1] = UNKNOWN_SHARE
        columns.append(weights)
    stacked = np.hstack(columns) if columns else np.zeros((len(pieces) + 1, 0))
    return LanguageModel(pieces, languages, stacked, f"{hash(stacked.tobytes())}")


def fit(labelled: DataFrame, pieces: tuple[str, ...], key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model from a bounded sample of the labelled documents; rows without text or language teach nothing."""
    known = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = known.where(F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    # The rank filter also holds within each task before the shuffle, so one very common language is no hot key.
    chosen = known.select("key", "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE_DOCUMENTS)
    texts = known.join(F.broadcast(chosen.select("key", "lang").distinct()), ["key", "lang"], "left_semi")
    sample: dict[str, Counter] = {}
    for row in texts.dropDuplicates(["key", "lang"]).toLocalIterator():
        sample.setdefault(row["lang"], Counter()).update(words_of(row["text"]))
    return train(sample, pieces)


class Scorer:
    """Log-likelihoods of words in all languages, kept for words seen before."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.trie = PieceTrie(model.pieces)
        self.places: dict[str, int] = {}
        self.known = np.empty((0, len(model.languages)))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Distinct words' log-likelihoods, summed over their chunks. Words of like length share a lattice."""
        scores = np.empty((len(words), len(self.model.languages)))
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        at = 0
        while at < len(order):
            longest = min(CHUNK, 8 + len(words[order[at]]))
            stop = at
            while stop < len(order) and stop - at < 20_000 and len(words[order[stop]]) < longest:
                stop += 1
            part = order[at : max(stop, at + 1)]
            pieces = [chunks_of(words[k]) for k in part]
            logs = np.log(Lattice(self.trie, [c for p in pieces for c in p]).likelihoods(self.model.weights))
            firsts = np.cumsum([0, *(len(p) for p in pieces[:-1])])
            scores[part] = np.add.reduceat(logs, firsts, axis=0)
            at += len(part)
        return scores

    def text_scores(self, texts: list[str]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        new = list({w for words in split for w in words if w not in self.places})
        if len(self.places) + len(new) > CACHED_WORDS and self.places:
            self.places, self.known = {}, self.known[:0]
            new = list({w for words in split for w in words})
        if new:
            self.places.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.known = np.concatenate([self.known, self.word_scores(new)])
        out = np.zeros((len(texts), len(self.model.languages)))
        for k, words in enumerate(split):
            if words:
                out[k] = self.known[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))].sum(axis=0)
        return out

    def predict(self, texts: list[str]) -> pa.Array:
        languages = self.model.languages
        if not languages:
            names, shares = [UNDECIDED] * len(texts), np.zeros(len(texts))
        else:
            scores = self.text_scores(texts)
            best = scores.argmax(axis=1)
            shares = 1.0 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
            lettered = np.array([_LETTER.search(t) is not None for t in texts], dtype=bool)
            names = [languages[b] if x else UNDECIDED for b, x in zip(best.tolist(), lettered.tolist(), strict=True)]
            shares = np.where(lettered, shares, 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["lang_pred", "score"])


def predicted(model: LanguageModel, texts: DataFrame, text: str = "text") -> Column:
    """A struct of ``lang_pred`` and ``score`` for the text column. The model's size is fixed by the vocabulary."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def predict(values: list[str]) -> pa.Array:
        model = shared.value
        return worker_state(("language", model.name), lambda: Scorer(model)).predict(values)

    return text_udf(predict, SCHEMA, release=True)(F.col(text))
