import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from precolens.llm import alignment
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY_A, LIBRARY_B = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
LIBRARY_A.encode_special_tokens = True
NAMES = {i: t for t, i in LIBRARY_A.get_vocab().items()}
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PRINTED)}
EDGES = [
    None, "", " ", "  ", "a", " a", "a ", "a  b   c", "\n a\n b ", "x▁y z", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "a\x00b c", "tab\t x",
    "é é 漢字 😀 　 \xa0 q", "Wort, wort; it's I'll", "w" * 20_000, "wort und " * 9_000, "퟿ \U0010ffff",
]


def brute(text):
    """(groups, links) of a text from the libraries' own tokens."""
    if not text:
        return [], []
    a = LIBRARY_A.encode(" " + text, add_special_tokens=False).ids
    b = LIBRARY_B.encode(text)
    spell_a = [bytes(BYTES[c] for c in NAMES[i]) for i in a]
    pieces = [(LIBRARY_B.is_byte(i), LIBRARY_B.id_to_piece(i)) for i in b]
    spell_b = [bytes.fromhex(p[3:5]) if raw else p.replace("▁", " ").encode() for raw, p in pieces]
    if not b"".join(spell_a) == b"".join(spell_b) == (" " + text).encode():
        return [], []
    at_a, at_b = (np.concatenate([[0], np.cumsum([len(s) for s in spell])]).tolist() for spell in (spell_a, spell_b))
    cuts = sorted(set(at_a) & set(at_b))
    groups = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        one = [[str(i) for i, s in zip(ids, at, strict=False) if low <= s < high] for ids, at in ((a, at_a), (b, at_b))]
        groups.append("|".join(",".join(side) for side in one))
    links, first = [], 0
    for i, x in enumerate(a):
        while at_b[first + 1] <= at_a[i]:
            first += 1
        j = first
        while j < len(b) and at_b[j] < at_a[i + 1]:
            links.append((x, b[j]))
            j += 1
    return groups, links, len(a), len(b)


def expected(rows):
    found = [(i, *(brute(t) or ())) for i, t in rows]
    counts = Counter(pair for _, _, links, *_ in found for pair in links)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for i, groups, links, *sizes in found:
        best = sum(counts[p] == highest[p[1]] for p in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, *(sizes or (0, 0)), len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return out


def test_documents_against_the_libraries(spark, docs, folder, monkeypatch):
    rng = random.Random(4)
    texts = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").limit(150).collect()
    rows = [*enumerate(EDGES, 10_000), *((r.doc_id, r.text) for r in texts), (5, "one more"), (None, "the end"), (None, None)]
    rows += [(20_000 + i, "hot words hot words") for i in range(300)]
    rng.shuffle(rows)
    want = sorted(expected(rows), key=str)
    frame = docs(rows).selectExpr("*", "1 as n_a", "2 as BATCH", "3 as part").repartition(6)
    assert sorted((tuple(r) for r in alignment.align(frame, A, B).collect()), key=str) == want
    # Many small batches, in several groups, give the same counts.
    monkeypatch.setattr(alignment, "GROUP", 2)
    assert sorted((tuple(r) for r in alignment.align(frame.repartition(23), A, B).collect()), key=str) == want


def test_no_rows(spark, docs):
    assert alignment.align(docs([]), A, B).count() == 0
    assert [tuple(r) for r in alignment.align(docs([(1, None)]), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


ALIGNER = alignment.Aligner(A, B)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'é1\xa0<|▁"), st.characters(exclude_categories=["Cs"]))))
def test_any_text_as_the_libraries_cut_it(text):
    (found,) = ALIGNER.documents([text])
    groups, links, *_ = brute(text)
    pairs = [p for e in found for p in np.frombuffer(e[4], np.uint64).tolist()]
    assert "".join(e[0] for e in found) == "".join(f"{g};" for g in groups)
    assert sum(e[3] for e in found) == len(groups)
    assert pairs == [b * ALIGNER.size_a + a for a, b in links]


def test_runs_merge_to_counts():
    rng = np.random.default_rng(5)
    batches = [(rng.integers(0, 900, 4000).astype(np.uint64), np.sort(rng.integers(0, 50, 4000))) for _ in range(7)]
    runs = [dict(alignment._runs(pairs, docs, 10)) for pairs, docs in batches]
    found = {p: n for part in range(alignment.PARTS) for p, n in alignment.merged(r[part] for r in runs if part in r)}
    assert found == Counter(int(p) for pairs, _ in batches for p in pairs)
