from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from archidex.llm import bpe, langid, lm, token_counts, unigram
from archidex.llm.queries_tokens import op3_lm, op5_bpe, op7_langid, op8_token_counts, training_part

SF = "/root/testdata/sf0.001"
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = [
    None, "", " ", "\n\n  \t", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "it's WE'LL 'S", "x" * 5000, " " * 700,
    "日本語 と ౜ ௵ 🤦🏽‍♂️", "\x00\x1c\x85   end", "Ｆｕｌｌ ①②", "12 345,678.9\r\n- é", "the the the", "the the the",
]


def frame(spark, texts, first=0):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i + first, t, "k", [1], "b", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, ids array<int>, block string, score double")


def texts_of(sf, spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(BPE_FILE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE_FILE)


def test_encoder_equals_the_library(vocabulary, library):
    rng = random.Random(5)
    alphabets = ["ethanousrigl ", "ab ", "'sdmtlvre ", "".join(map(chr, range(32, 127))), "äéñß€漢字́ \n", "0123456789 .,"]
    texts = [t or "" for t in ODD_TEXTS]
    texts += ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(120))) for _ in range(1500)]
    encoder = bpe.Encoder(vocabulary)
    for text in texts:
        ids = np.frombuffer(encoder.encode(text), dtype=np.int32).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text


def test_compatibility_is_that_of_plain_merging(vocabulary):
    """Backtracking gives what merging pair after pair gives, for every string over a small alphabet."""
    encoder = bpe.Encoder(vocabulary)
    for size in range(1, 6):
        for letters in itertools.product(b"thein", repeat=size):
            assert encoder.encode_word(bytes(letters)) == encoder.merged(bytes(letters))


def test_bpe_round_trip_of_odd_texts(spark, vocabulary, library):
    docs = frame(spark, ODD_TEXTS).repartition(3)
    coded = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    rows = {r.doc_id: r for r in coded.collect()}
    assert coded.columns == ["doc_id", "ids", "decoded"] and len(rows) == len(ODD_TEXTS)
    for i, text in enumerate(ODD_TEXTS):
        assert rows[i].ids == library.encode(text or "", add_special_tokens=False).ids
        assert rows[i].decoded == (text or "")
    assert bpe.decode(bpe.encode(docs.limit(0), vocabulary), vocabulary).count() == 0


def test_decoder_of_unusual_ids(spark, vocabulary, library):
    lists = [None, [], [vocabulary.specials["<|endoftext|>"]], [10**6, -1, 64], [None, 65], [187, 100]]
    rows = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    got = [r.decoded for r in bpe.decode(rows, vocabulary).orderBy("doc_id").collect()]
    known = library.decode([187, 100], skip_special_tokens=False)
    assert got == ["", "", "<|endoftext|>", library.decode([64]), library.decode([65]), known]


def test_bpe_query_over_the_whole_table(spark, library):
    got = {r.doc_id: r for r in op5_bpe(spark, SF).collect()}
    docs = texts_of(SF, spark)
    assert len(got) == len(docs)
    for i, text in docs:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


# -- token counts ---------------------------------------------------------------------

PIECES = ("▁", "a", "b", "ab", "▁a", "ba", "bab", "▁abab", "c")


def every_segmentation(text, counts):
    if not text:
        yield 0.0, 0
        return
    for end in range(1, len(text) + 1):
        head = text[:end]
        if head in counts.scores:
            own = (counts.scores[head], 1)
        elif end == 1:
            size = len(head.encode())
            own = (size * counts.byte_score, size)
        else:
            continue
        for score, pieces in every_segmentation(text[end:], counts):
            yield own[0] + score, own[1] + pieces


SCORES = [math.log(x) for x in (0.1, 0.2, 0.15, 0.12, 0.11, 0.1, 0.05, 0.12, 0.05)]


def test_trie_counts_equal_all_segmentations():
    counts = token_counts.WordCounts(PIECES, SCORES)
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abcé", repeat=n)]
    for word, n in counts.visit(words):
        best = max(every_segmentation("▁" + word, counts), key=lambda s: (round(s[0], 9), -s[1]))
        assert n == best[1], word


def test_token_counts_of_odd_texts(spark):
    texts = ["abab c", None, "", " \n", "z" * 3000 + " ab", "ab " * 2000, "abab c"]
    rows = token_counts.token_counts(frame(spark, texts), PIECES, SCORES).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_tokens) for r in rows] == [(2, 3), (0, 0), (0, 0), (0, 0), (2, 3003), (2000, 4000), (2, 3)]
    assert token_counts.token_counts(frame(spark, []), PIECES, SCORES).count() == 0
    assert len(set(unigram.fit(frame(spark, [None, "", " "]), PIECES))) == 1


def test_pieces_that_end_at_each_letter():
    rng = random.Random(6)
    for _ in range(50):
        pieces = {"".join(rng.choice("abé▁") for _ in range(rng.randrange(1, 6))): -rng.random() for _ in range(20)}
        ends, state, text = token_counts.PieceEnds(pieces), 0, "".join(rng.choice("aabbé▁x") for _ in range(60))
        for end, letter in enumerate(text, 1):
            state = ends.next(state, letter)
            want = [(n, pieces[text[end - n : end]]) for n in range(min(end, 5), 0, -1) if text[end - n : end] in pieces]
            assert list(ends.pieces[state]) == want


def test_words_of_long_pieces_equal_the_plain_table():
    rng = random.Random(7)
    pieces = tuple({"".join(rng.choice("abcd▁") for _ in range(rng.randrange(1, 9))) for _ in range(150)} - {"d"})
    counts = token_counts.WordCounts(pieces, [-rng.choice([1.0, 2.0, 2.5, 3.0]) for _ in pieces])  # sums without rounding, many ties
    words = {"".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 40))) for _ in range(500)} | {"a" * 3000}
    for word, n in counts.visit(words):
        text, best = "▁" + word, [(0.0, 0)]
        for end in range(1, len(text) + 1):
            steps = [(best[a][0] + counts.scores[text[a:end]], best[a][1] - 1) for a in range(max(0, end - 8), end) if text[a:end] in counts.scores]
            if text[end - 1] not in counts.scores:
                size = len(text[end - 1].encode())
                steps.append((best[end - 1][0] + size * counts.byte_score, best[end - 1][1] - size))
            best.append(max(steps))
        assert n == -best[-1][1], word


def test_a_full_memory_keeps_the_words_of_the_present_texts(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED_WORDS", 4)
    counts, visited = token_counts.WordCounts(PIECES, SCORES), []
    visit = counts.visit
    monkeypatch.setattr(counts, "visit", lambda words: visit(visited.extend(words) or words))
    assert counts.count_texts(["a b", "c a"]) == ([2, 2], [3, 3])
    assert counts.count_texts(["a ab ba a", "", "b"]) == ([4, 0, 1], [6, 0, 2])
    assert sorted(visited) == ["a", "ab", "b", "ba", "c"] and set(counts) == {"a", "b", "ab", "ba"}


def test_first_letters_by_table():
    for pieces in (PIECES, (), ("a", "\U0001f600b")):
        trie, letters = langid.PieceTrie(pieces), np.array([0, *map(ord, "abcz▁é\U0001f600\U0010ffff")])
        has, children = trie.begin(letters)
        want = trie.step(np.zeros(len(letters), dtype=np.int64), letters)
        assert has.tolist() == want[0].tolist() and children.tolist() == want[1].tolist()


def plain_fit(texts, pieces, rounds):
    """Expectation maximisation word by word; words over 32 letters, mark included, in pieces of 32."""
    counted = Counter()
    for text in texts:
        for word in (text or "").split():
            marked = "▁" + word
            counted.update(marked[a : a + 32] for a in range(0, len(marked), 32))
    known, longest = set(pieces), max(map(len, pieces))
    share = dict.fromkeys(pieces, 1 / (len(pieces) + 1))
    unknown = 1 / (len(pieces) + 1)
    for _ in range(rounds):
        used, used_unknown = Counter(), 0.0
        for chunk, n in counted.items():
            size = len(chunk)
            arcs = [
                (a, b, chunk[a:b]) for a in range(size) for b in range(a + 1, min(size, a + longest) + 1)
                if chunk[a:b] in known or b == a + 1
            ]
            ahead, behind = [1.0] + [0.0] * size, [0.0] * size + [1.0]
            for a, b, piece in sorted(arcs, key=lambda x: x[1]):
                ahead[b] += ahead[a] * share.get(piece, unknown)
            for a, b, piece in sorted(arcs, key=lambda x: -x[0]):
                behind[a] += behind[b] * share.get(piece, unknown)
            for a, b, piece in arcs:
                part = ahead[a] * share.get(piece, unknown) * behind[b] / ahead[size] * n
                if piece in known:
                    used[piece] += part
                else:
                    used_unknown += part
        total = sum(used.values()) + used_unknown
        share = {p: max(used[p] / total, 1e-9) for p in pieces}
        unknown = 1e-7
    return {p: math.log(x) for p, x in share.items()}


def test_fitted_probabilities(spark):
    texts = ["abab ab c", None, "ba bab é" * 3, "ab " * 50, "x" * 70, "abab ab c"]
    got = unigram.fit(frame(spark, texts).repartition(3), PIECES)
    plain = plain_fit(texts, PIECES, unigram.ROUNDS)
    assert np.allclose(got, [plain[p] for p in PIECES], rtol=1e-3)
    assert list(got) == list(unigram.fit(frame(spark, texts).repartition(7), PIECES))


def test_token_counts_query(spark):
    """Scores, segmentation and counts by a plain version of all of it."""
    pieces = token_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in op8_token_counts(spark, SF).collect()}
    docs = texts_of(SF, spark)
    scores = plain_fit([t for _, t in docs], pieces, unigram.ROUNDS)
    of_byte, longest = min(scores.values()) - 1, max(map(len, pieces))

    def plain(word):
        text = "▁" + word
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            steps = [
                (best[s][0] + scores[text[s:end]], best[s][1] - 1)
                for s in range(max(0, end - longest), end) if text[s:end] in scores
            ]
            if text[end - 1] not in scores:
                size = len(text[end - 1].encode())
                steps.append((best[end - 1][0] + size * of_byte, best[end - 1][1] - size))
            best.append(max(steps))
        return -best[-1][1]

    memory: dict[str, int] = {}
    exact = 0
    for i, text in docs:
        words = (text or "").split()
        for w in words:
            memory.setdefault(w, plain(w) if w not in memory else 0)
        n = sum(memory[w] for w in words)
        # Shares are added in grains of 2**-16, so a word whose two best segmentations are as good as equal may differ.
        assert got[i][0] == len(words) and abs(got[i][1] - n) <= max(2, n // 200)
        exact += got[i][1] == n
    assert exact >= 0.9 * len(docs)


# -- language identification ----------------------------------------------------------


def test_likelihood_sums_all_segmentations():
    trie = langid.PieceTrie(PIECES)
    rng = np.random.default_rng(2)
    weights = rng.random((len(PIECES) + 1, 2)) / 20
    numbers = {p: n for n, p in enumerate(PIECES)}

    def total(text):
        if not text:
            return np.ones(2)
        out = np.zeros(2)
        for end in range(1, len(text) + 1):
            if text[:end] in numbers:
                out += weights[numbers[text[:end]]] * total(text[end:])
            elif end == 1:
                out += weights[-1] * total(text[1:])
        return out

    chunks = ["▁abab", "▁b", "é", "▁ababab", "ccé▁"]
    lattice = langid.Lattice(trie, chunks)
    assert np.allclose(lattice.likelihoods(weights), [total(c) for c in chunks], rtol=1e-12)
    # Expected uses of the pieces weigh each segmentation by its share: check by a small change of each weight.
    counts = np.arange(1.0, len(chunks) + 1)
    expected = lattice.expected(weights[:, :1], counts)
    for piece in range(len(weights)):
        step = weights[:, :1].copy()
        step[piece] *= 1 + 1e-6
        change = np.log(lattice.likelihoods(step)[:, 0]) - np.log(lattice.likelihoods(weights[:, :1])[:, 0])
        assert math.isclose((change * counts).sum() / 1e-6, expected[piece], rel_tol=1e-3, abs_tol=1e-4)


def test_language_of_odd_texts(spark):
    pieces = token_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = langid.train({"en": Counter("the house of the dog is not red".split()), "de": Counter("das haus von dem hund ist nicht rot".split())}, pieces)
    texts = ["the dog", "der hund", None, "", "12 + 34 = 46 !?", "the " * 3000, "hund" * 400, "the dog"]
    docs = frame(spark, texts).withColumn("lang_pred", F.lit("xx"))
    rows = docs.select("doc_id", langid.predicted(model, docs).alias("f")).select("doc_id", "f.*").orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == ["en", "de", "und", "und", "und", "en", "de", "en"]
    assert all(0 <= r.score <= 1 for r in rows) and [r.score for r in rows[2:5]] == [0, 0, 0] and rows[0].score == rows[7].score
    nothing = langid.fit(frame(spark, []).withColumn("lang", F.lit("en")), pieces)
    empty = docs.select(langid.predicted(nothing, docs).alias("f")).select("f.*").collect()
    assert {(r.lang_pred, r.score) for r in empty} == {("und", 0.0)}


def test_languages_of_held_out_documents(spark):
    got = {r.doc_id: r for r in op7_langid(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(got[d.doc_id].held_out for d in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.99 * len(held)


# -- language model ---------------------------------------------------------------------


def brute_force_scores(docs, taught):
    tokens = {i: [*(t or "").encode().lower().split(), b"</s>"] for i, t in docs}
    words, pairs, before = Counter(), Counter(), Counter()
    for i in tokens:
        if taught(i):
            words.update(tokens[i])
            for h, w in zip([b"<s>", *tokens[i]], tokens[i], strict=False):
                pairs[h, w] += 1
                before[h] += 1
    n, v = sum(words.values()), len(words)
    p = lambda w: (words[w] + 0.5) / (n + 0.5 * (v + 1))
    out = {}
    for i, own in tokens.items():
        score = sum(
            math.log10((pairs[h, w] + lm.MASS * p(w)) / (before[h] + lm.MASS)) for h, w in zip([b"<s>", *own], own, strict=False)
        )
        out[i] = (not taught(i), len(own), sum(words[w] > 0 for w in own), n, sum(math.log10(p(w)) for w in own), score)
    return out


def check_scores(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        held_out, n_tokens, n_known, n, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, n_tokens, n_known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


@pytest.mark.parametrize("block_bytes", [2_000, 100_000, 8 << 20])
def test_model_scores_equal_brute_force_whatever_the_blocks(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block_bytes)
    docs = texts_of(SF, spark)
    if block_bytes == 2_000:
        docs = docs[:40]
        given = spark.createDataFrame(docs, "doc_id long, text string")
        scored = lm.scores(given, training_part(F.col("doc_id"), 5, 1))
        rows = scored.withColumn("held_out", ~F.col("taught")).collect()
    else:
        rows = op3_lm(spark, SF).collect()
    check_scores(rows, brute_force_scores(docs, lambda i: zlib.crc32(str(i).encode()) % 5 != 1))
    held = [r for r in rows if r.held_out]
    if block_bytes > 2_000:
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_is_a_distribution():
    """From any state, the known words' probabilities and the unknown one's add up to one."""
    words = np.array([3, 1, 4, 2])  # word 3 stands for the begin, which is no word
    heads, tails, pairs = np.array([3, 0, 0, 2, 2]), np.array([0, 1, 2, 2, 0]), np.array([2, 1, 2, 1, 3])
    n, v = 8, 3
    model = lm.Automaton(words, pairs, heads, tails, n, v, lm.MASS)
    unknown = 0.5 / (n + 0.5 * (v + 1))
    for state, following in ((0, 3), (2, 4), (3, 2)):
        known = sum(10 ** model.score(state, [w]) for w in range(3))
        assert math.isclose(known + 10 ** model.fail[state] * unknown * (1 if following else 0) , 1.0, rel_tol=0.08)


def test_model_of_odd_documents(spark):
    texts = ["A b", None, "", "a\x0bB\x1cc É", "word " * 5000, "A b"]
    rows = frame(spark, texts)
    scored = lm.scores(rows, F.col("doc_id") != 5).withColumn("held_out", ~F.col("taught")).collect()
    check_scores(scored, brute_force_scores(list(enumerate(texts)), lambda i: i != 5))
    nameless = rows.withColumn("doc_id", F.lit(None).cast("long"))
    assert lm.scores(nameless, training_part(F.col("doc_id"), 5, 1)).where("doc_id is null").count() == 6
    assert lm.scores(rows.limit(0), F.lit(True)).count() == 0
    untaught = lm.scores(rows, F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known) for r in untaught} == {(0, 0)} and all(r.base_score == 0 for r in untaught)
