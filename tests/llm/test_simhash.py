import random

import xxhash
from precolens.llm import simhash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    """doc_id -> smallest doc_id reachable."""
    label = dict(zip(prints, prints, strict=True))
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= radius and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


EDGES = [None, "", " \n\t ", "One", "one  two", "A B C", "a b c d", "É é x\x1cy z", "word " * 40_000, "x" * 100_000]


def test_documents_against_brute_force(spark, docs):
    rng = random.Random(1)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn".split()) for _ in range(60)) for _ in range(12)]
    texts = EDGES + base + [b.replace("ab", "xy", 1) for b in base] + [base[0]] * 30
    rows = list(enumerate(texts, 5))
    got = simhash.near_duplicates(docs(rows).selectExpr("*", "1 as fp", "2 as FIRST")).collect()
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == brute_components(prints)


def test_chains_of_close_fingerprints(spark):
    rng = random.Random(2)
    prints, chain = {}, 0
    for i in range(120):
        chain ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        prints[1000 - i] = chain if i % 40 else rng.getrandbits(64)
    rows = spark.createDataFrame([(simhash._signed(p),) for p in set(prints.values())], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(rows)).collect()}
    label = brute_components(prints)
    mine = {i: found.get(simhash._signed(p), simhash._signed(p)) for i, p in prints.items()}
    assert len({(label[i], mine[i]) for i in prints}) == len(set(label.values())) == len(set(mine.values()))


def test_repeated_rows_null_ids_and_empty_tables(spark, docs):
    got = simhash.near_duplicates(docs([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "other words here")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 3), (3, 3), (3, 3)]
    assert simhash.near_duplicates(docs([])).count() == 0


def test_keep_first_keeps_one_row_of_each_group(spark, docs):
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "q r s t u"), (None, "a b c d"), (3, "q r s t u"), (3, "q r s t u")]
    rows += [(None, "v w x y z"), (None, "v w x y z"), (None, None), (8, ""), (None, "k l m n o"), (1, "e f g h i")]
    got = simhash.keep_first(docs(rows).selectExpr("*", "7 as component_id", "8 as _FP")).collect()
    want = [(1, "a b c d"), (1, "e f g h i"), (3, "q r s t u"), (8, ""), (None, "k l m n o"), (None, "v w x y z")]
    assert sorted((tuple(r) for r in got), key=str) == sorted(((*w, 7, 8) for w in want), key=str)
    assert simhash.keep_first(docs([])).count() == 0
