"""op12 against the library on whole texts, against merging by hand, and on texts that the library alone can't take."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bytepairs

RANKS = bytepairs.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
CODER = bytepairs.Coder(public_tokenizers.PATTERN, RANKS)
WHOLE = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def merged_by_hand(text):
    """Matches of the pattern, each merged pair by pair, the least rank first, from the left."""
    out = []
    for match in regex.findall(public_tokenizers.PATTERN, text):
        parts = [bytes([b]) for b in match.encode()]
        while True:
            ranked = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [RANKS[p] for p in parts]
    return out


LETTERS = list("abzXYZ019  \n\t.,;:!?'()-_«»äßèЖя漢字仮カー〇々、。  　\x1c\x85́😀") + ["'s", "'ll", "  ", "\n\n", " ", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(LETTERS), max_size=120), st.integers(1, 40))
def test_parts_change_nothing(pieces, size):
    text = "".join(pieces)
    cut = list(bytepairs.parts(text, size))
    assert "".join(p for p, _ in cut) == text
    assert [i for p, _ in cut for i in WHOLE.encode_ordinary(p)] == WHOLE.encode_ordinary(text) == merged_by_hand(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "x", "Ж.", "漢", "1'"]), st.sampled_from([" ", "\n", "\t ", " ", " \n"]), st.integers(0, 30)), max_size=6), st.sampled_from(["", "y", "."]))
def test_runs_of_white_space_change_nothing(runs, end):
    text = "".join(a + b * n for a, b, n in runs) + end
    short = bytepairs._LONG_RUN
    try:
        bytepairs._LONG_RUN, bytepairs.RUN = regex.compile(f"[{bytepairs._SPACES}]{{5,}}"), 4
        assert CODER.encode(text, 3) == WHOLE.encode_ordinary(text)
    finally:
        bytepairs._LONG_RUN, bytepairs.RUN = short, 10000


def test_texts_that_the_library_alone_refuses():
    blanks = " " * 1_500_000
    with pytest.raises(BaseException):  # noqa: B017, PT011  its own kind of panic
        WHOLE.encode_ordinary(blanks + "x")
    for text in (blanks, blanks + "x", "x" + blanks + "\ny", "\n \t" * 500_000 + "end"):
        ids = CODER.encode(text)
        assert CODER.decode(ids).decode() == text
    assert CODER.encode("a" + " " * 20000 + "b") == WHOLE.encode_ordinary("a" + " " * 20000 + "b")


def test_query_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    long = " ".join("".join(rng.choice(list("abcdefg漢字.,0123"), int(rng.integers(1, 12)))) for _ in range(60000))
    texts = [None, "", "plain text", "<|endoftext|> 'll", "漢字" * 50000, long, long, "a" * 300000, " \n" * 40000 + "z"]
    rows = [(i, t, "en", "s", 1, 7, "ids") for i, t in enumerate(texts)] + [(None, "no id", "en", "s", 1, 7, "ids"), (2, "plain text", "en", "s", 1, 7, "ids")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, raw int, ids string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = WHOLE.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = [tuple(r) for r in bytepairs.op12_bytepairs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    coder = public_tokenizers.PATTERN, RANKS
    coded = bytepairs.encode_documents(docs, *coder)
    assert coded.columns == ["doc_id", "lang", "source", "n_chars", "raw", "ids"]
    back = bytepairs.decode_documents(coded, *coder).collect()
    assert {(r.doc_id, bytes(r.raw).decode()) for r in back} == {(i, t or "") for i, t, *_ in rows}
    assert bytepairs.encode_documents(docs.limit(0), *coder).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert bytes(bytepairs.decode_documents(bytepairs.encode_documents(broken, *coder), *coder).first().raw).decode() == "a�b"
    nothing = spark.sql("SELECT cast(null AS array<int>) AS ids")
    assert bytepairs.decode_documents(nothing, *coder).first().raw is None
