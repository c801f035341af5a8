import random
import zlib

import numpy as np
import pytest
from precolens.llm import classifier, queries
from precolens.llm.common import table

EDGES = [None, "", " \n ", "ein", "ein ein ein", "a\x00b ** é漢", "wort " * 60_000, "x" * 100_000]


def brute_vectors(texts):
    """The table by loops over words and their neighbours."""
    place, sign = classifier.index_vectors()
    words = classifier.Words()
    sums = np.zeros((classifier.BUCKETS, classifier.WIDTH), np.int64)
    places = np.zeros(classifier.BUCKETS, np.int64)
    for text in texts:
        x = words.numbers((text or "").encode()).tolist()
        for i, w in enumerate(x):
            places[w] += 1
            for away in (-2, -1, 1, 2):
                if 0 <= i + away < len(x):
                    for p, s in zip(place[x[i + away]].tolist(), sign[x[i + away]].tolist(), strict=True):
                        sums[w, (p + away) % classifier.WIDTH] += s
    return sums, places


def test_vectors_against_loops(spark, docs):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab cd, ef gh! ij *** kl".split()) for _ in range(rng.randrange(40))) for _ in range(60)] + EDGES[:6]
    sums, places = brute_vectors(texts)
    got = classifier.word_vectors(docs(enumerate(texts)).repartition(5))
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
    want = unit(sums.astype(float))
    want = unit(want - (places[:, None] * want).sum(axis=0) / places.sum()) * (places > 0)[:, None]
    assert np.abs(got - want).max() < 1e-5 and (places > 0).sum() > 10


def test_words_are_marked_where_they_repeat():
    w = classifier.Words()
    a, b, c = (w.numbers(t)[0] for t in (b"ab", b"cd", b"**"))
    assert w.numbers(b"ab cd ab**\tab").tolist() == [a, b, a, 0, c, a, 0]
    assert w.numbers(None).tolist() == w.numbers(b" ").tolist() == []
    assert 0 not in {a, b, c}


def test_rows_keep_columns_and_edges_have_scores(spark, docs):
    rows = docs([*enumerate(EDGES), (None, "ein"), (3, "ein")]).selectExpr("*", "1 as pooled", "2 as quality_score")
    vectors = classifier.word_vectors(rows)
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    network = classifier.train(rows, labels, vectors)
    got = classifier.score(rows, network, vectors).collect()
    assert len(got) == len(EDGES) + 2 and got[0].__fields__ == ["doc_id", "text", "pooled", "quality_score", "quality_score_"]
    assert all(0 <= r.quality_score_ <= 1 for r in got)
    assert len({r.quality_score_ for r in got if not (r.text or "").strip(" ")}) == 1
    none = docs([])
    assert classifier.score(none, classifier.train(none, labels, classifier.word_vectors(none)), vectors).count() == 0


def test_one_kind_of_label_or_none_gives_the_share():
    x = np.ones((6, classifier.WIDTH))
    assert classifier.fit(x[:0], np.zeros(0)).probability(x) == pytest.approx(0.5)
    assert classifier.fit(x, np.ones(6)).probability(x) == pytest.approx(7 / 8)


def test_temperature_makes_margins_honest():
    rng = np.random.default_rng(3)
    margin = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-margin))).astype(float)
    assert classifier._temperature(margin * 3, y) == pytest.approx(3, rel=0.1)
    assert classifier._temperature(margin[:0], y[:0]) == 1


def test_held_out_labels_are_told_apart(spark, folder):
    folder = folder.replace("sf0.01", "sf0.1")
    got = {r.doc_id: r for r in queries.op13_classifier(spark, folder).collect()}
    assert len(got) == table(spark, folder, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(got[r.doc_id].score, r.quality) for r in table(spark, folder, "labels").collect() if got[r.doc_id].held_out]
    score, y = (np.array(c) for c in zip(*held, strict=True))
    assert ((score >= 0.7) == y).mean() > 0.97
    assert (score[y == 1] >= 0.7).mean() > 0.98 and (score[y == 0] >= 0.7).mean() < 0.1
    assert abs(score.mean() - y.mean()) < 0.02
