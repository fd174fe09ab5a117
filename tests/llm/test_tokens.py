import hashlib

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from llmdata import awkward_rows, prose
from tokenizers import Tokenizer

from ruleweave.llm import bpe as B
from ruleweave.llm import tokencounts as T

VOCABULARY = P.path("word_bpe_49k.json")
_V = B.Vocabulary(VOCABULARY)
_T = Tokenizer.from_file(VOCABULARY)


def test_length_report_equals_brute_force(spark):
    rows = awkward_rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows + rows[-1:]], "doc_id long, text string, n_tokens string")
    counted = T.token_counts(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    import base64

    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(len(enc.encode_ordinary(t or "")) for _, t in rows + rows[-1:])
    assert sorted(r.n_tokens for r in counted.collect()) == want
    report = T.length_report(counted)
    got = {r.n_tokens: r for r in report.collect()}
    assert sorted(got) == sorted(set(want))
    for limit, r in got.items():
        over = [x for x in want if x > limit]
        assert (r.n_docs, r.docs_upto, r.docs_over) == (want.count(limit), len(want) - len(over), len(over))
        assert (r.tokens_over, r.total_tokens, r.truncated_tokens) == (sum(over), sum(want), sum(min(x, limit) for x in want))
        assert abs(r.quantile - (len(want) - len(over)) / len(want)) < 1e-12
    limits = spark.createDataFrame([(7,), (7,), (100,), (10**6,)], "context long")
    for r in T.at_limits(report, limits).collect():
        assert r.truncated_tokens == sum(min(x, r.context) for x in want)
    assert T.length_report(counted.limit(0)).count() == 0


def test_every_limit_gets_its_row(spark):
    lengths = [5, 5, 9, 1023, 1024, 3000, 9000]
    df = spark.createDataFrame([(x,) for x in lengths], "n_tokens long")
    asked = [0, 4, 5, 8, 1023, 1500, 2048, 2999, 3000, 10**6]
    limits = spark.createDataFrame([(x,) for x in [*asked, 4, None]], "context long")
    for have, table in ((lengths, df), ([], df.limit(0))):
        got = T.at_limits(T.length_report(table), limits).collect()
        assert sorted(r.context for r in got) == asked
        for r in got:
            over = [x for x in have if x > r.context]
            assert (r.docs_upto, r.tokens_upto) == (len(have) - len(over), sum(have) - sum(over))
            assert (r.docs_over, r.tokens_over) == (len(over), sum(over))
            assert r.truncated_tokens == sum(min(x, r.context) for x in have)


def test_lexicon_is_exact_and_shares_suffixes():
    words = sorted({w.strip(".") for w in prose(3, 400).split()} | {"walking", "talking", "walked", "talked", "caf\u00e9"})
    entries = {w.encode(): _V.merge(w.encode()) for w in words}
    blob = B.compile_lexicon(entries)
    import tempfile
    with tempfile.NamedTemporaryFile() as f:
        f.write(blob)
        f.flush()
        lex = B.Lexicon(f.name)
        assert len(lex) == len(words)
        for w, ids in entries.items():
            assert lex.get(w) == ids
        for w in (b"", b"walk", b"zzz", b"walkingg"):
            assert lex.get(w) is None
    assert len(B.compile_lexicon({b"walking": [1], b"talking": [1]})) < 2 * len(B.compile_lexicon({b"walking": [1]}))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abc'stdlrev \u00e9\u03a3<|>endofx1\u00b2\u0345", max_size=60)))
def test_encoding_equals_the_library(text):
    ids, decoded = B.Encoder(_V, _Nothing()).encode(text)
    want = _T.encode(text, add_special_tokens=False).ids
    assert ids == " ".join(map(str, want))
    assert decoded == _T.decode(want, skip_special_tokens=False) == B.decode(want, _V)


class _Nothing:
    def numbers(self, words):
        import numpy as np
        return np.full(len(words), -1)


def test_long_words_merge_alike():
    for w in (b"a" * 3000, b"abcab" * 700, bytes(range(97, 123)) * 20):
        assert _V.merge(w) == _T.encode(w.decode(), add_special_tokens=False).ids


def test_bpe_operator(spark):
    rows = awkward_rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows + rows[-1:]], "doc_id long, text string, ids string")
    lexicon = B.build_lexicon(df, VOCABULARY, k=30)
    got = B.bpe_encode(df, VOCABULARY, lexicon).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        ids = _T.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(_T.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    empty = df.limit(0)
    assert B.bpe_encode(empty, VOCABULARY, B.build_lexicon(empty, VOCABULARY)).count() == 0
