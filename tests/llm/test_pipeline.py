import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import test_quality
import test_repeats
import test_simhash
from precolens.llm import packing, quality
from tokenizers import Tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table():
    rng = random.Random(4)
    vocabulary = [f"wort{i}" for i in range(900)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = prose(70)
    texts = []
    for i in range(50):
        words = prose(rng.randint(55, 200))
        texts.append(" ".join(words[:30] + passage * (i % 4 == 0) + words[30:]))
    texts += texts[:8] + [texts[9] + " ende"] + [" | ".join(prose(80)) for _ in range(20)]
    texts += [None, "", "kurz", "gleich " * 300, "ß" * 50_000]
    return [(i, t, "de", None, None if t is None else len(t)) for i, t in enumerate(texts)]


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(" | " not in (t or ""))) for i, t, *_ in rows if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))

    features = {i: quality.statistics((t or "").encode())[1] for i, t, *_ in rows}
    trees = quality.fit(np.array([features[i] for i, _ in labels]), np.array([q for _, q in labels], float))
    good = []
    for i, t, *_ in rows:
        n, _, _, _, repeated = test_quality.brute(t)
        if n >= 50 and 2 * repeated <= n and trees.probability(np.array([features[i]]))[0] >= 0.5:
            good.append((i, t))
    prints = {i: test_simhash.brute_fingerprint(t) for i, t in good}
    first = test_simhash.brute_components(prints)
    single = [(i, t) for i, t in good if first[i] == i]
    texts = {}
    for (i, t), (_, _, removed, kept) in zip(single, test_repeats.brute(single), strict=True):
        texts[i] = kept if removed else t
    assert 30 < len(texts) < len(good) < 60 and any(texts[i] != t for i, t in single)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert {r.doc_id: r.doc_tokens for r in got} == want
    assert Counter(r.doc_id for r in got) == {i: -(-n // packing.CAPACITY) for i, n in want.items()}
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= packing.CAPACITY and sum(filled.values()) == sum(want.values())


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    spark.createDataFrame(table(), COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "substring_dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_extra_columns_go_along(spark, tmp_path):
    rows = spark.createDataFrame(table(), COLUMNS).selectExpr("*", "1 as quality_rules", "2 as repeats", "3 as fp", "4 as component_id")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, rows, str(tmp_path))
        assert found.columns == rows.columns
        assert {tuple(r)[-4:] for r in found.collect()} == {(1, 2, 3, 4)}
