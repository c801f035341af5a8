import random

import pytest
from precolens.llm import repeats

SIZE = repeats.WINDOW


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, size=SIZE):
    """(doc_id, n_words, n_removed, kept) of every row."""
    first = {}
    texts = [(i, split(t or "")) for i, t in rows]
    for i, words in texts:
        if i is not None:
            for k in range(len(words) - size + 1):
                key = tuple(words[k : k + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in texts:
        gone = set()
        if i is not None:
            for k in range(len(words) - size + 1):
                if first[tuple(words[k : k + size])] < i:
                    gone.update(range(k, k + size))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def found(df, **given):
    got = repeats.remove_repeats(df, **given)
    return sorted(((r[0], *r[-1]) for r in got.collect()), key=str)


EDGES = [None, "", " \n ", "one two", "x" * 100_000, "a\x1cb\xa0c " * 20, "same " * 5_000, "é ß 漢 " * 3_000]


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(10, 60))] for _ in range(8)]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randint(1, 60)] if rng.random() < 0.5 else p
        rows.append((rng.choice("  \n\t")).join(words))
    return rows


@pytest.mark.parametrize("batch_bytes", [1, 3_000, repeats.BATCH_BYTES])
def test_against_brute_force(spark, docs, monkeypatch, batch_bytes):
    monkeypatch.setattr(repeats, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(repeats, "SHARDS", 16)
    texts = corpus(batch_bytes, 60)
    rows = list(zip(random.Random(1).sample(range(-50, 500), 60), texts, strict=True))
    rows += [(1000 + i, t) for i, t in enumerate(EDGES)] + [(2000 + i, t) for i, t in enumerate(EDGES)]
    rows += [rows[0], rows[0], (None, texts[0]), (None, texts[0]), (rows[1][0], texts[2])]
    assert found(docs(rows).repartition(5)) == sorted(brute(rows), key=str)


def test_small_windows_and_many_automata(spark, docs, monkeypatch):
    monkeypatch.setattr(repeats, "PASSAGE_WINDOWS", 3)
    monkeypatch.setattr(repeats, "AUTOMATON_WORDS", 20)
    monkeypatch.setattr(repeats, "SHARDS", 3)
    rows = [(i, " ".join(random.Random(i % 3).choice("ab cd ef".split()) for _ in range(12 + i))) for i in range(12)]
    assert found(docs(rows), window=5) == sorted(brute(rows, 5), key=str)
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs(rows), window=4)


def test_rows_columns_and_empty_tables(spark, docs):
    rows = docs([(2, "a " * 20), (1, "a " * 20)]).selectExpr("*", "7 as repeats", "'k' as Batch")
    got = repeats.remove_repeats(rows)
    assert got.columns == ["doc_id", "text", "repeats", "Batch", "repeats_"]
    assert sorted((r.doc_id, r.repeats, r.Batch, r.repeats_.n_removed) for r in got.collect()) == [(1, 7, "k", 0), (2, 7, "k", 20)]
    assert repeats.remove_repeats(docs([])).count() == 0
    kept = repeats.without_repeats(docs([(1, " x  y\n"), (2, "a " * 20), (3, "b\n" + "a " * 20), (4, None)]))
    assert sorted(map(tuple, kept.collect())) == [(1, " x  y\n"), (2, "a " * 20), (3, "b"), (4, None)]
