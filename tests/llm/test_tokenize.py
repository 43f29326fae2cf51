import base64
import os
import random
from pathlib import Path

import pytest

from tallyline.llm import tokenize as M

pytestmark = pytest.mark.skipif(not os.path.isfile(f"{M.TOKENIZERS}/{M.VOCABULARY}"), reason="needs the vocabulary files")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CASES = [None, "", " ", "\n\n", "don't we'll I'D x'rex ''s 's", "a  b\n c\t\td  ", "<|endoftext|>", "naïve ½ ² ٣ 中文 🎉👩‍💼", "\x00a", "a" * 5000, "ab'" * 700, "é" * 300 + " " * 200 + "x"]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(M.TOKENIZERS, M.VOCABULARY).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_reference(reference):
    rng = random.Random(1)
    letters = "aé1٣ '\n\t  s t're'vell'mdD.,-!😀中ſ̀​\x00\x85²"
    texts = CASES + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    encoder = M.Encoder.load()
    got = encoder.encode_batch(texts)
    assert got == [reference.encode_ordinary(t or "") for t in texts]
    assert [encoder.decode(x) for x in got] == [t or "" for t in texts]


def test_other_vocabulary(reference):
    tiktoken = pytest.importorskip("tiktoken")
    name = "byte_bpe_multi_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(M.TOKENIZERS, name).read_bytes().splitlines())}
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t or "" for t in CASES if not t or "a" * 100 not in t]
    assert M.Encoder.load(name=name).encode_batch(texts) == [other.encode_ordinary(t) for t in texts]


def test_scan_is_the_loop():
    import numpy as np

    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 10, 5000).astype(np.uint8)
    state, want = M.CLOSED, []
    for s in symbols:
        want.append(state)
        state = M.GO[s, state]
    assert M.states_before(symbols).tolist() == want


def test_columns(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in M.encode(df, ["doc_id"]).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(CASES)}
    for r in M.encode_with_offsets(df, ["doc_id"]).collect():
        text = (CASES[r.doc_id] or "").encode()
        tokens = [reference.decode_single_token_bytes(t) for t in r.ids]
        assert [text[o : o + len(t)] for o, t in zip(r.offsets, tokens)] == tokens
    assert {r.doc_id: r.n_tokens for r in M.count_tokens(df, ["doc_id"]).collect()} == {k: len(v) for k, v in got.items()}
    assert M.encode(df.limit(0), ["doc_id"]).isEmpty()
