import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from precolens.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS, LIBRARY = packing.WordIds(PATH), []
EDGES = [
    None, "", " \n\t", "Hello  WORLD's", "a\x1cb\x85c\xa0d e f", "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>",
    "<|endof text|>", "é ́e Å İI ΑΣ Σ", "漢字 かな 😀👍🏽", "\x00�", "it's we're I'LL", "w" * 50_000, "ab cd " * 9_000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_pieces_hold_every_id_once_and_sequences_have_no_gaps(spark, docs, tokenizer):
    rng = random.Random(1)
    rows = list(enumerate(EDGES)) + [(i, "ab " * rng.randrange(3000)) for i in range(100, 160)] + [(None, "q"), (3, "q")]
    given = docs(rows).repartition(5).selectExpr("*", "1 as length", "2 as PART")
    got = packing.pack(given, PATH, keep_ids=True).cache()
    ids = Counter((i, tuple(whole(tokenizer, t))) for i, t in rows)
    found, used = got.collect(), {}
    assert {r.doc_id for r in found} == {i for i, _ in rows}
    for r in found:
        piece = np.frombuffer(r.ids, "<u4")
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(piece) == r.length
        assert any(
            i == r.doc_id and len(t) == r.doc_tokens and list(t[r.start : r.start + r.length]) == piece.tolist() for i, t in ids
        )
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in found) == sum(len(t) * n for (_, t), n in ids.items())
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert sum(spans[-1]) <= packing.CAPACITY
    assert sorted(used) == list(range(len(used)))
    for r in packing.sequences(got).collect():
        parts = sorted((p.offset, p.ids) for p in found if p.sequence_id == r.sequence_id)
        assert bytes(r.ids) == b"".join(bytes(b) for _, b in parts) and len(r.ids) == 4 * r.length
    got.unpersist()


def naive(lengths, capacity):
    """Worst fit, one piece at a time, longest first."""
    space = []
    for n in sorted(lengths, reverse=True):
        best = max(range(len(space)), key=lambda i: space[i], default=None)
        if best is None or space[best] < n:
            space.append(capacity - n)
        else:
            space[best] -= n
    return sorted(space)


def test_patterns_equal_one_by_one_packing():
    rng = random.Random(2)
    for capacity in (1, 7, 16, 100):
        for _ in range(40):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(200))]
            patterns = packing.shortest_pack_first(Counter(lengths), capacity)
            assert sorted(capacity - sum(n * k for n, k in c) for p, c in patterns for _ in range(p)) == naive(lengths, capacity)
            held = Counter()
            for packs, content in patterns:
                for n, times in content:
                    held[n] += packs * times
            assert held == Counter(lengths)
            assert len(patterns) <= 3 * capacity


def test_places_fill_every_pattern():
    histogram = {5: 7, 3: 20, 1: 1000}
    places = packing.Places(packing.shortest_pack_first(histogram, 16))
    taken = Counter()
    for length, n in histogram.items():
        sequence, offset = places.find(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            taken.update((s, o + k) for k in range(length))
    assert max(taken.values()) == 1 and max(o for _, o in taken) < 16 and taken.total() == 35 + 60 + 1000


def test_little_padding_on_documents(spark, folder):
    rows = packing.pack(spark.read.parquet(f"{folder}/documents.parquet"), PATH).groupBy("sequence_id").sum("length").collect()
    filled = [r[1] for r in rows]
    assert sum(packing.CAPACITY - n for n in filled) < 0.01 * sum(filled)


def test_empty_table(spark, docs):
    assert packing.pack(docs([]), PATH).count() == 0


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \nabC'é1.,!ÅßΣσİß́"), st.characters(exclude_categories=["Cs"]))))
def test_any_text_as_the_library_does(text):
    library = Tokenizer.from_file(PATH) if not LIBRARY else LIBRARY[0]
    LIBRARY[:] = [library]
    found = WORDS.encode_all([text.encode()])[0]
    assert np.frombuffer(found, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_letter_as_the_library_does(tokenizer):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    for at in range(0, len(letters), 5000):
        text = " ".join(f"a{c}, {c}b" for c in letters[at : at + 5000])
        assert np.frombuffer(WORDS.encode_all([text.encode()])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts():
    """One that keeps case and white space: nothing of the short way would be right."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.cuts_words(PATH) and not packing.cuts_words(path)
    library, texts = Tokenizer.from_file(path), ["Hello  WORLD's\n", "", None, "É ab, cd  ", "漢字 <|endoftext|> x"]
    found = packing.WordIds(path).encode_all([t and t.encode() for t in texts])
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == want


def test_changed_settings_get_whole_texts(tmp_path):
    """The same file but for one setting."""
    given = json.loads(open(PATH, encoding="utf-8").read())
    given["normalizer"]["normalizers"].pop()  # keeps case
    (path := tmp_path / "keeps_case.json").write_text(json.dumps(given), "utf-8")
    assert not packing.cuts_words(str(path))
    found = packing.WordIds(str(path)).encode_all([b"Ab cd, EF"])[0]
    assert np.frombuffer(found, "<u4").tolist() == Tokenizer.from_file(str(path)).encode("Ab cd, EF", add_special_tokens=False).ids


def test_texts_together_are_looked_up_by_distinct_words(monkeypatch):
    words, asked = packing.WordIds(PATH), []
    for cache in (words.words, words.parts):
        monkeypatch.setattr(cache, "get", lambda keys, get=cache.get: asked.extend(keys) or get(keys))
    texts = ["The cat, the dog.", "CAT? dog dog!! x1 x1 é", "the"] * 50
    found = words.encode_all([t.encode() for t in texts])
    library = Tokenizer.from_file(PATH)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(map(str, asked)) == sorted(map(str, ["the", "cat", "dog", b"x1", "é", "é".encode()]))


def test_many_texts_together_as_each_alone(tokenizer):
    texts = [t and t.encode() for t in EDGES] + [b"", None, b"  ", b"\n.\n", b"... a", b"a\xff b\xe6\xbc c,", b"\xe6\xbc. B!", b"a\x1fb \x0b\x0cc"]
    together = WORDS.encode_all(texts)
    for text, found in zip(texts, together, strict=True):
        want = tokenizer.encode((text or b"").decode("utf-8", "replace"), add_special_tokens=False).ids
        assert np.frombuffer(found, "<u4").tolist() == want and WORDS.encode_all([text]) == [found]
    assert WORDS.encode_all([]) == []
