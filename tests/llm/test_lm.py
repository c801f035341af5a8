import math
import random
import zlib
from collections import Counter

import pytest
from precolens.llm import lm


def split(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def is_held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


class Brute:
    """The model by its definition: probabilities by recursion over contexts."""

    def __init__(self, texts):
        self.words = Counter(w for t in texts for w in [*split(t), "</>"])
        self.n = sum(self.words.values())
        self.after = {}
        for t in texts:
            line = ["<>", "<>", *split(t), "</>"]
            for i in range(2, len(line)):
                for k in (1, 2):
                    self.after.setdefault(tuple(line[i - k : i]), Counter())[line[i]] += 1

    def base(self, w):
        return (self.words[w] + 0.1) / (self.n + 0.1 * (len(self.words) + 1))

    def p(self, w, history):
        if not history:
            return self.base(w)
        after = self.after.get(history)
        lower = self.p(w, history[1:])
        if after is None:
            return lower
        return (max(after[w] - 0.5, 0) + 0.5 * len(after) * lower) / after.total()

    def score(self, text):
        line = ["<>", "<>", *split(text), "</>"]
        return sum(math.log10(self.p(line[i], tuple(line[i - 2 : i]))) for i in range(2, len(line)))


HELD = [i for i in range(100, 400) if is_held_out(i)]


def corpus(seed, n=120):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(12)):
            words += rng.choice([["The", "cat", "sat"], ["the", "dog"], ["a", "cat"], [f"rare{rng.randrange(60)}"], ["On", "the"]])
        out.append(rng.choice(" \n\t").join(words))
    return out


def expected(rows):
    brute = Brute([t for i, t in rows if not is_held_out(i)])
    want = []
    for i, t in rows:
        line = [*split(t), "</>"]
        base = sum(math.log10(brute.base(w)) for w in line)
        want.append((i, is_held_out(i), len(line), sum(w in brute.words for w in line), brute.n, base, brute.score(t)))
    return sorted(want, key=lambda r: (r[0] is None, r[0], r[2]))


def check(df, rows, share=lm.WORD_SHARE, sizes=None):
    got = lm.score(df, lm.held_out(df.doc_id), word_share=share, sizes=sizes or lm.Sizes()).collect()
    got = sorted((tuple(r) for r in got), key=lambda r: (r[0] is None, r[0], r[2]))
    want = expected(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


EDGES = [(500, None), (501, ""), (502, "É the\x1ccat unseen " * 3), (None, "the dog"), (3, "again"), (503, "the cat sat on " * 5_000)]


# Few words with numbers, all; contexts in one shard, spread; batches of some texts; pieces.
@pytest.mark.parametrize(
    "share, hot, batch, piece",
    [(0.004, 2.0, 1 << 19, 1 << 18), (0.0, 0.0, 200, 7), (0.004, 0.002, 60, 1), (2.0, 0.0, 500, 2), (0.02, 0.01, 1_000, 100)],
)
def test_scores_against_the_definition(spark, docs, share, hot, batch, piece):
    rows = list(enumerate(corpus(1))) + (EDGES if piece > 50 else [*EDGES[:-1], (503, "the cat sat on " * 20)])
    df = docs(rows).selectExpr("*", "1 as word", "2 as score", "3 as ROW").repartition(4)
    check(df, rows, share, lm.Sizes(hot, batch, piece, 1_000, 8))


def test_probabilities_of_every_state_add_up_to_one():
    texts = corpus(9)
    brute = Brute(texts)
    unknown = brute.base("never seen")
    for history in [(), *brute.after]:
        total = sum(brute.p(w, history) for w in brute.words) + brute.p("never seen", history)
        assert total == pytest.approx(1, abs=1e-9) and unknown > 0


def test_a_walk_by_hand(docs):
    """One training text "a b": every arc and failure arc of a short walk, worked out."""
    smoothing = 3 + 0.1 * 4
    one, unknown = 1.1 / smoothing, 0.1 / smoothing
    two = 0.5 + 0.5 * one  # an arc of a word's state: its discounted share and what its discount leaves to the unigram
    three = 0.5 + 0.5 * two
    got = {r.doc_id: r.score for r in lm.train_and_score(docs([(1, "a b"), (HELD[0], "a c"), (HELD[1], "b")])).collect()}
    assert got[1] == pytest.approx(3 * math.log10(three))
    # "c" falls twice from "<> a" and ends in the empty state.
    assert got[HELD[0]] == pytest.approx(math.log10(three) + 2 * math.log10(0.5) + math.log10(unknown) + math.log10(one))
    # "b" falls twice from the start; its state has an arc to the end.
    assert got[HELD[1]] == pytest.approx(2 * math.log10(0.5) + math.log10(one) + math.log10(two))


def test_held_out_documents_become_likelier(spark, folder):
    got = lm.train_and_score(spark.read.parquet(f"{folder}/documents.parquet")).where("held_out").collect()
    assert len(got) > 50
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty_tables_and_no_training_rows(spark, docs):
    assert lm.train_and_score(docs([])).count() == 0
    ids = [i for i in range(200) if is_held_out(i)]
    got = lm.train_and_score(docs([(ids[0], "a b"), (ids[1], None)])).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 0, 0), (3, 0, 0)]


def test_every_ngram_counts_at_any_size(docs):
    """One text has words and n-grams that occur once among far more tokens than 2^17."""
    rows = [(1, "a b c"), (2, "q r s"), *((i, "the cat sat on the mat " * 500) for i in range(3, 103))]
    brute = Brute([t for i, t in rows if not is_held_out(i)])
    assert brute.n > 2**18 and not is_held_out(1) and brute.after["a", "b"]["c"] == 1
    got = {r.doc_id: r.score for r in lm.train_and_score(docs(rows)).where("doc_id < 3").collect()}
    assert got == {i: pytest.approx(brute.score(t), rel=1e-9) for i, t in rows[:2]}


def test_long_words_are_never_sent_to_all(docs):
    long = "x" * 3_000_000
    rows = [(1, f"a {long} b"), (2, f"{long} {long}"), (4, "a b")]
    words = lm.vocabulary(lm.word_counts(docs(rows).select("text")))
    assert b"a" in words.words and max(len(w) for w in words.words if isinstance(w, bytes)) <= lm.LONGEST
    assert sum(isinstance(w, int) for w in words.words) == 1  # by its hash
    check(docs(rows), rows)


def test_texts_are_cut_between_words(monkeypatch):
    text = ("Ab c\n\n" * 50 + "d" * 40 + " e").encode()
    for limit in (1, 3, 10, 1_000):
        monkeypatch.setattr(lm, "CUT_BYTES", limit)
        assert [w for words in lm.tokens(text) for w in words] == text.lower().split()


def test_a_hot_context_is_spread_over_shards(docs):
    """All texts begin alike, and many different words follow the same two."""
    rows = [(i, " ".join(f"the cat w{(i * 37 + j) % 1500}" for j in range(60))) for i in range(300)]
    check(docs(rows), rows, 1e-5)
