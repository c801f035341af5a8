import hashlib
import random
from array import array

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from precolens.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, PATTERN)
EDGES = [
    None, "", " ", "   ", "\n", "a  b", "a   b", "a\n \nb", " \n b \n", "\0 a \0", "it's  I'LL 12 345", "<|endoftext|> x",
    "漢字 かな 😀👍🏽", "é \xa0 　 x  y", "w" * 20_000, "ab" * 30_000, "!" * 5_000, "word " * 20_000,
]


def ids(text):
    return array("I", ENCODER.encode_all([text])[0]).tolist()


def test_edges_as_the_library_does():
    for text in EDGES:
        assert ids(text) == LIBRARY.encode_ordinary(text or "")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\0ab'sé1\xa0 "), st.characters(exclude_categories=["Cs"]))))
def test_any_text_as_the_library_does(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_every_character_is_classed_as_the_library_does():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 4096):
        text = "a".join(c + " " for c in chars[at : at + 4096])
        assert ids(text) == LIBRARY.encode_ordinary(text)


def quadratic(ranks, word):
    """Merge the leftmost pair of the lowest rank until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_ranks_in_any_order_merge_as_one_by_one():
    rng = random.Random(1)
    for _ in range(200):
        tokens = {bytes([b]) for b in range(256)}
        for _ in range(30):
            tokens.add(bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))))
        order = sorted(tokens)
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        encoder = bpe.Encoder(ranks, PATTERN)
        for _ in range(10):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
            assert encoder.merge(word) == quadratic(ranks, word)
            assert not encoder.queue.outer and not any(encoder.queue.inner)


def test_vocabulary_without_a_free_byte():
    ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 97]): 256 + b for b in range(245, 256)} | {b"ab": 600}
    encoder = bpe.Encoder(ranks, r"\S+|\s+")
    assert encoder.separator is None
    assert array("I", encoder.encode_all(["cab ab"])[0]).tolist() == [99, 600, 32, 600]


def test_rows_round_trip_with_clashing_columns(spark, docs):
    rows = docs(list(enumerate(EDGES)) + [(None, "x"), (1, "again")]).selectExpr("*", "5 as ids", "'q' as decoded")
    coded = bpe.decode(bpe.encode(rows, PATH, PATTERN), PATH, "ids_")
    assert coded.columns == ["doc_id", "text", "ids", "decoded", "ids_", "decoded_"]
    got = coded.collect()
    assert len(got) == len(EDGES) + 2 and all(bytes(r.decoded_).decode() == (r.text or "") for r in got)
    row = bpe.digests(coded.where("doc_id = 10"), ids_col="ids_", decoded_col="decoded_").first()
    want = LIBRARY.encode_ordinary(EDGES[10])
    assert row.n_tokens == len(want) and row.ids_sha256 == hashlib.sha256(array("I", want).tobytes()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(EDGES[10].encode()).hexdigest()
    assert bpe.encode(docs([]), PATH, PATTERN).count() == 0


def test_unknown_ids_are_an_error(spark):
    rows = spark.sql("select X'FFFFFF7F' as ids")
    with pytest.raises(Exception, match="KeyError"):
        bpe.decode(rows, PATH).collect()


def test_groups_keep_matches_whole():
    cut = regex.compile(PATTERN)
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\tab1'! ") for _ in range(rng.randrange(14)))
        assert [m for g in bpe.groups(text, cut) for m in cut.findall(g)] == cut.findall(text)
