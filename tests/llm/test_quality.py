import random
import re

import numpy as np
from precolens.llm import quality

SPACE = "\x20\t\n\x0b\x0c\r"
EDGES = [None, "", " \n ", "a", "a b c a b c", "x\nx\nx\n\n \n \n", "é|ß #% é|ß", "w " * 60_000, "z" * 200_000, "a\x1cb c\xa0d"]


def brute(text):
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    lines, dups = set(), 0
    for line in text.split("\n"):
        if re.search(f"[^{SPACE}]", line):
            dups += line in lines
            lines.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered))


def test_counts_against_brute_force():
    rng = random.Random(1)
    texts = EDGES + ["".join(rng.choice("ab \n|é") for _ in range(rng.randrange(200))) for _ in range(200)]
    for t in texts:
        assert quality.statistics((t or "").encode())[0] == brute(t)


def test_triples_of_many_distinct_words():
    ids = np.array([0, 1, 2, 3, 0, 1, 2, 9])
    assert quality._repeated(ids, 10) == quality._repeated(ids, 2_000_000) == 6


def test_scores_never_rise_along_a_falling_feature():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality.FEATURES)))
    y = ((x[:, 2] + 0.3 * rng.random(600) < 0.6) | (x[:, 0] > 0.9)).astype(float)
    trees = quality.fit(x, y)
    assert ((trees.probability(x) >= 0.5) == y).mean() > 0.95
    for f, direction in enumerate(quality.FEATURES.values()):
        if direction:
            line = np.repeat(x[:50], 21, axis=0)
            line[:, f] = np.tile(np.linspace(0, 1, 21), 50)
            steps = np.diff(trees.probability(line).reshape(50, 21), axis=1)
            assert (steps * direction >= -1e-12).all()


def test_one_kind_of_label_or_none_keeps_by_share():
    none = np.zeros((0, len(quality.FEATURES)))
    some = np.zeros((5, len(quality.FEATURES)))
    assert quality.fit(none, np.zeros(0)).probability(some).min() > 0.5
    assert quality.fit(some, np.ones(5)).probability(some).min() > 0.5
    assert quality.fit(some, np.zeros(5)).probability(some).max() < 0.5


def test_judge_keeps_rows_and_columns(spark, docs):
    rows = docs(list(enumerate(EDGES)) + [(None, "a b"), (0, None)]).selectExpr("*", "1 as quality_rules", "'x' as n_words")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    found = quality.judge(rows, quality.train(rows, labels))
    assert found.columns == ["doc_id", "text", "quality_rules", "n_words", "quality_rules_"]
    got = found.collect()
    assert len(got) == len(EDGES) + 2
    for r in got:
        assert tuple(r.quality_rules_[:5]) == brute(r.text)
        n, repeated = r.quality_rules_.n_words, r.quality_rules_.n_repeat_words
        assert r.quality_rules_.base_failed == (n < 50 or 100 * repeated > 50 * n)
    assert quality.keep_good(docs([]), labels).count() == 0


def test_held_out_documents(spark, folder):
    """Trained on half of the labelled documents, the rules hold on the other half."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    trees = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rest = quality.judge(docs.join(labels.where("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id"), trees)
    got = rest.selectExpr("quality", "quality_rules.probability >= 0.5 as good").collect()
    assert sum(r.quality == r.good for r in got) >= 0.97 * len(got)
    clean = [r.good for r in got if r.quality == 1]
    assert sum(clean) >= 0.99 * len(clean)


def test_sample_is_taken_of_labels_with_documents(spark, docs, monkeypatch):
    """Labels without documents take no place, and an id that many rows share doesn't exceed the sample."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(sorted(y.tolist())))
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    quality.train(docs([(7, "a b"), (8, "c d")]), labels, sample_rows=5)
    quality.train(docs([(7, f"a b {i % 3}") for i in range(40)]), labels, sample_rows=5)
    assert seen == [[0.0, 1.0], [1.0] * 5]
