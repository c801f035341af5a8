import math
import random
import re
from collections import Counter

import numpy as np
from precolens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [Counter(brute_terms(t)) for _, t in docs]
    n, length = sum(1 for b in bags if b), sum(b.total() for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), bag in zip(docs, bags, strict=True):
            m = 25 + (75 * bag.total() * n) // length if length else 0
            parts = (
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t in brute_terms(text)
                if t in bag
            )
            scores.append((-sum(parts), doc is None, doc))
        ranked = sorted((s for s in scores if s[0] < 0), key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, i, doc, -score) for i, (score, _, doc) in enumerate(ranked[:k], 1)]
    return out


EDGES = [None, "", " \n.;", "É é É", "a\x00b a_b a-b", "x", "x x", "Straße x", "x " * 50_000, "w" * 100_000]


def rows(docs, items, spark, **kwargs):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as rank", "2 as score", "3 as n", "4 as bag")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 as doc_id", "6 as item")
    return sorted((tuple(r) for r in lexical.rank(d, i, **kwargs).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_ranks_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["ÀB", "漢字"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = EDGES + [prose(rng.randint(1, 40)) for _ in range(150)]
    docs = list(enumerate(texts, 7)) + [(500 + i, texts[20]) for i in range(40)] + [(9, "x"), (9, "x"), (None, "x w1"), (None, texts[20])]
    rng.shuffle(docs)
    items = list(enumerate([None, "", "...", "unknownterm", "x", "X x w1 w1", texts[20], texts[20], "É", "a b", *(prose(8) for _ in range(10))]))
    want = brute(docs, items)
    assert rows(docs, items, spark) == want and len(want) > 100
    assert rows(docs, items, spark, block_bytes=60) == want
    assert rows(docs, items, spark, k=3) == brute(docs, items, 3)


def test_no_documents_and_no_items(spark):
    assert rows([], [(1, "a")], spark) == rows([(1, None), (2, ".")], [(1, "a")], spark) == []
    assert rows([(1, "a")], [], spark) == rows([(1, "a")], [(1, None)], spark) == []
    assert rows([(1, "a")], [(1, "a")], spark) == brute([(1, "a")], [(1, "a")])


def test_scores_beyond_doubles_are_added_as_integers():
    block = lexical.Block(["a " * 3 + "b", "b"])
    bags = [lexical._bag(Counter({0: 70_000, 1: 2})), lexical._bag(Counter({1: 300}))]
    block.weighed(np.array([7, 11]))
    some = block.scores(bags, np.array([25, 400]))
    block.exact = False
    assert (block.scores(bags, np.array([25, 400])) == some).all()
    block.weighed(np.array([1 << 40, 1]))
    assert not block.exact


def test_a_class_of_many_documents_is_cut_before_the_shuffle(spark):
    bags = spark.createDataFrame([(i, 5, bytearray(b"x")) for i in range(50)], "doc_id long, n long, bag binary")
    found = lexical._classes(bags, 50, 250, 10).collect()
    assert [r.doc_id for r in found] == [list(range(10))]
