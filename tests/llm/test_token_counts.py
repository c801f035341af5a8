import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from precolens.llm import token_counts
from precolens.llm.token_counts import Counts
from tokenizers import Tokenizer

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
LIBRARY = Tokenizer.from_file(PATH)
EDGES = [
    None, "", " ", "a   b", " a \n \n b", "<|endoftext|>", "x <|endoftext|>  y<|endoftext|>\n z", "a\t <|endoftext|> ", "<|endoftext|> <|endoftext|>",
    "\0 \0", "é 漢字 😀", "w" * 30_000, "word, " * 20_000,
]


def test_rows_as_the_library_counts(spark, docs):
    rows = docs(list(enumerate(EDGES)) + [(None, "q"), (3, "q")]).selectExpr("*", "1 as tokens")
    got = token_counts.count_tokens(rows, PATH, PATTERN, limit=100).collect()
    assert len(got) == len(EDGES) + 2
    for r in got:
        n = len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids)
        assert tuple(r.tokens_) == (len((r.text or "").encode()), n, n > 100)
    assert token_counts.count_tokens(docs([]), PATH, PATTERN).count() == 0


def counts():
    import numpy as np

    return Counts(PATH, " the\0,\0 a".encode(), np.array([1, 1, 1], np.uint16).tobytes())


SHARED, CUT = counts(), regex.compile(PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'é1\xa0<|"), st.characters(exclude_categories=["Cs"]))), st.booleans())
def test_any_text_as_the_library_counts(text, special):
    text = text[: len(text) // 2] + "<|endoftext|>" * special + text[len(text) // 2 :]
    want = len(LIBRARY.encode(text, add_special_tokens=False).ids)
    assert SHARED.totals([None, text, text + text[:0], ""], CUT) == [0, want, want, 0]


def test_whole_table_as_the_library_counts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = token_counts.count_tokens(docs, PATH, PATTERN).select("text", "tokens.n_tokens").collect()
    sample = got[::7]
    assert [r.n_tokens for r in sample] == [len(e.ids) for e in LIBRARY.encode_batch([r.text for r in sample], add_special_tokens=False)]


def test_frequent_groups_are_few_and_frequent(spark, docs):
    found = token_counts.frequent_groups(docs([(i, f"the the of w{i}") for i in range(200)]), PATTERN)
    assert found[:3] == [" the", " of", "the"] or set(found[:3]) == {" the", "the", " of"}
    assert len(found) <= token_counts.FREQUENT
