from tokenizers import Tokenizer
from vacantia.llm import token_counts

from .conftest import rows_of

ODD = ["", " ", "  ", "a  b", "a \n b", "<|endoftext|><|endoftext|>", "x<|endoftext|> y", "\x1c a b", "it's  don't'll", "a　b ², ½", "\n\n", "​ 𝒳", "tab\there \t x", "'s 'S", "é×÷ß"]


def test_counts_are_the_librarys(spark, docs):
    tok = Tokenizer.from_file(token_counts.tokenizer_path())
    some = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string"))
    texts = [(r.doc_id, r.text or "") for r in some.collect()]
    want = sorted(((d, len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for d, t in texts), key=repr)
    assert rows_of(token_counts.token_counts(some)) == want
    assert rows_of(token_counts.token_counts(some, block_bytes=300)) == want


def test_plain_pattern_equals_the_library():
    pre = token_counts.pre_tokens(token_counts.tokenizer_path())
    for text in [*ODD, "Plain text, with 12 numbers; it's fine.\nÉtion  ß x"]:
        assert pre.split(text) == [text[a:b] for _, (a, b) in pre.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_empty_and_clashing(docs, empty, clashing):
    assert token_counts.token_counts(empty).count() == 0
    assert rows_of(token_counts.token_counts(clashing)) == rows_of(token_counts.token_counts(docs))


def test_query_repeats_reorders_and_limit(spark, tmp_path):
    """The registered query: the limit, a third of equal rows, a long text; the same whatever the order of rows."""
    from vacantia.llm import queries

    tok = Tokenizer.from_file(token_counts.tokenizer_path())
    rows = [(k, "again and again " * 5 if k % 3 == 0 else f"text{k} " * k) for k in range(90)] + [(90, "ab1 " * 60_000), (91, "x" * 5000), (92, "w " * 1024), (93, None)]
    want = sorted((d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows)
    assert {over for *_, over in want} == {True, False}
    for n, some in enumerate((rows, rows[::-1])):
        spark.createDataFrame(some, "doc_id long, text string").repartition(1 + 2 * n).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        assert sorted(map(tuple, queries.op3_token_counts(spark, f"{tmp_path}/{n}").collect())) == want
    assert rows_of(token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), buckets=5000)) == sorted((w[:3] for w in want), key=repr)
