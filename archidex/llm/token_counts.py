"""Token counts by a unigram model over a fixed vocabulary, with work shared along a trie of pre-tokens.

A text is cut at white space; each word, with the mark ``▁`` before it, is segmented into vocabulary pieces so that the
sum of the pieces' scores is highest (ties: fewer pieces). The distinct words of a slice form a trie, visited in sorted
order. The best score and piece count that end at a trie node depend on its prefix only, so they are computed once
per shared prefix, from the pieces that an Aho-Corasick automaton finds to end there; the count at a word's end is kept
for all its occurrences, also across slices.

A piece's score is the logarithm of its probability, given by the caller; ``unigram.fit`` fits it to the corpus itself. The counts
are those of this unigram model over the vocabulary's pieces, not of the merges its file may define for another kind of
tokenizer. A character outside the vocabulary counts as its UTF-8 bytes, each a piece scored below all others.

Defined results: null and empty texts have no words and no tokens. Rows are independent; repeated rows and null ids
pass through, other columns are not read. A word of any length takes time in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from math import inf

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archidex.llm.common import sliced, texts_of, worker_state

CACHED_WORDS = 400_000
CACHED_LENGTH = 64
WORD_MARK = "▁"


@lru_cache(maxsize=4)
def load_pieces(path: str) -> tuple[str, ...]:
    """The vocabulary's ordinary pieces in order. Their number is fixed, so they may be broadcast."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return tuple(model.id_to_piece(i) for i in plain)


class PieceEnds:
    """An Aho-Corasick automaton over the pieces: which of them end at a letter.

    A state is the longest piece's beginning that the text read so far ends with. ``steps``: the next state by letter, ``fall``: the
    next shorter such beginning, ``pieces``: lengths and scores of all pieces that end here.
    """

    def __init__(self, scores: dict[str, float]):
        self.steps: list[dict[str, int]] = [{}]
        self.fall = [0]
        self.pieces: list[tuple[tuple[int, float], ...]] = [()]
        own: dict[int, tuple[int, float]] = {}
        for piece, score in scores.items():
            state = 0
            for letter in piece:
                after = self.steps[state].get(letter)
                if after is None:
                    after = self.steps[state][letter] = len(self.steps)
                    self.steps.append({})
                state = after
            own[state] = (len(piece), score)
        self.fall = [0] * len(self.steps)
        self.pieces = [()] * len(self.steps)
        level = [0]
        while level:  # shorter beginnings first
            below = []
            for state in level:
                for letter, after in self.steps[state].items():
                    if state:
                        self.fall[after] = self.next(self.fall[state], letter)
                    shorter = self.pieces[self.fall[after]]
                    self.pieces[after] = (own[after], *shorter) if after in own else shorter
                    below.append(after)
            level = below

    def next(self, state: int, letter: str) -> int:
        after = self.steps[state].get(letter)
        while after is None and state:
            state = self.fall[state]
            after = self.steps[state].get(letter)
        return after or 0


class WordCounts(dict):
    """Pieces of a word's best segmentation, by word: a bounded memory."""

    def __init__(self, pieces: tuple[str, ...], scores: Sequence[float]):
        super().__init__()
        self.scores = dict(zip(pieces, map(float, scores), strict=True))
        self.byte_score = min(self.scores.values()) - 1
        self.ends = PieceEnds(self.scores)

    def visit(self, words: Iterable[str]) -> Iterator[tuple[str, int]]:
        """Counts of distinct words, visiting their trie depth first: sorted words share all nodes of a common prefix."""
        known, pieces, steps, fall = self.scores, self.ends.pieces, self.ends.steps, self.ends.fall
        # At each node of the path from the root: the automaton's state, the best score, and with how few pieces.
        words = sorted(words)
        room = max(map(len, words), default=0) + len(WORD_MARK) + 1
        states, best, count = [0] * room, [0.0] * room, [0] * room
        path = ""
        for word in words:
            marked = WORD_MARK + word
            shared, most = 0, min(len(path), len(marked))
            while shared < most and path[shared] == marked[shared]:
                shared += 1
            state = states[shared]
            for end, letter in enumerate(marked[shared:], shared + 1):
                after = steps[state].get(letter)
                while after is None and state:
                    state = fall[state]
                    after = steps[state].get(letter)
                state = after or 0
                top, few = -inf, 0
                for size, score in pieces[state]:
                    found = best[end - size] + score
                    if found > top:
                        top, few = found, count[end - size] + 1
                    elif found == top and count[end - size] < few:
                        few = count[end - size] + 1
                if letter not in known:
                    size = len(letter.encode())
                    found, many = best[end - 1] + size * self.byte_score, count[end - 1] + size
                    if found > top or found == top and many < few:
                        top, few = found, many
                states[end], best[end], count[end] = state, top, few
            path = marked
            yield word, count[len(marked)]

    def count_texts(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Words and pieces of each text."""
        sizes, sums, missed = [], [], []
        for words in map(str.split, texts):
            known = list(map(self.get, words))  # None: not known yet; no word has no pieces
            unknown = [w for w, n in zip(words, known, strict=True) if n is None] if None in known else []
            sizes.append(len(words))
            sums.append(sum(filter(None, known)))
            missed.append(unknown)
        here = dict(self.visit(set().union(*missed)))
        short = {w: n for w, n in here.items() if len(w) <= CACHED_LENGTH}
        if len(self) + len(short) > CACHED_WORDS:  # the words of these texts stay, frequent ones among them
            kept = {w: self[w] for text in texts for w in text.split() if w in self}
            self.clear()
            self.update(kept)
        self.update(short)
        return sizes, [n + sum(map(here.__getitem__, words)) for n, words in zip(sums, missed, strict=True)]


def token_counts(
    docs: DataFrame, pieces: tuple[str, ...], scores: Sequence[float], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: key, ``n_words`` and ``n_tokens``. No shuffle."""
    model = (pieces, tuple(map(float, scores)))
    shared, name = docs.sparkSession.sparkContext.broadcast(model), hash(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = worker_state(("token_counts", name), lambda: WordCounts(*shared.value))
        for part in sliced(batches, "text"):
            words, tokens = counts.count_texts(texts_of(part, "text"))
            columns = [part.column("key"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    pairs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return pairs.mapInArrow(run, f"key {kind}, n_words long, n_tokens long").withColumnRenamed("key", key)
