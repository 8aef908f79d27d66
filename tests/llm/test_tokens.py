import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings, strategies as st

from placelens.llm import queries, sentencepiece_bpe as S, token_counts as C
from tests.llm.helpers import documents, odd_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = S.read_model(PATH)
ENCODER, MERGER, LIBRARY = S.Encoder(MODEL), C.Merger(MODEL), sentencepiece.SentencePieceProcessor(model_file=PATH)
ALPHABET = st.sampled_from([" ", "  ", "a", "b", "the", "▁", "\n", "\r", "\t", "é", "漢", "😀", "\0", ".", "ing", "th", "e", "r", '"', ";", "/*", "aa", "ss", " " * 17])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), st.lists(ALPHABET, max_size=60).map("".join)))
def test_same_as_the_library(text):
    ids = np.frombuffer(ENCODER.encode(text), np.int32).tolist()
    assert ids == LIBRARY.encode(text)
    assert S.decode_ids(ENCODER.vocabulary, ids) == LIBRARY.decode(ids)
    assert MERGER.count_texts([text]) == [len(ids)]


def test_long_runs():
    for text in ("a" * 3000, " " * 4000 + "1", "aAbB0" * 900, "ab" * 5000):
        ids = np.frombuffer(ENCODER.encode(text), np.int32).tolist()
        assert ids == LIBRARY.encode(text)
        assert MERGER.count_texts([text]) == [len(ids)]


def test_unbroken_texts_stay_cheap():
    rnd = random.Random(3)
    texts = {
        "letters": "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80_000)), "base64": base64.b64encode(rnd.randbytes(60_000)).decode(), "cjk": "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(40_000)),
        "common letters": "".join(rnd.choice("etaoinshrdlu") for _ in range(40_000)), "one letter": "a" * 200_000, "repeats": "theand" * 20_000,
    }
    for kind, text in texts.items():
        began = time.perf_counter()
        assert MERGER.count_texts([text]) == [len(LIBRARY.encode(text))], kind
        assert time.perf_counter() - began < 5, kind  # plain rounds over all places took 85 s


def test_query_hashes(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in rows:
        ids = LIBRARY.encode(r.text or "")
        want[r.doc_id] = (len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids) if ids else ""))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op2_sentencepiece(spark, sf).collect()}
    assert got == want
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8_token_counts(spark, sf).collect()}
    assert counts == {r.doc_id: (len((r.text or "").encode()), want[r.doc_id][0], want[r.doc_id][0] > 4096) for r in rows}


def test_decoding_any_ids():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        ids = rnd.integers(3, 32000, 15).tolist()
        assert S.decode_ids(ENCODER.vocabulary, ids) == LIBRARY.decode(ids)


def test_tables(spark):
    docs = documents(spark, odd_rows())
    want = sorted(((i, LIBRARY.encode(t or "")) for i, t in odd_rows()), key=repr)
    coded = S.decode(S.encode(docs, MODEL), MODEL).collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in coded), key=repr) == want
    assert sorted((r.decoded for r in coded)) == sorted(LIBRARY.decode(i) if i else "" for _, i in want)
    counts = C.with_limit(C.count_tokens(docs, MODEL), 1000).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.over_limit) for r in counts), key=repr) == sorted(((i, len(x), len(x) > 1000) for i, x in want), key=repr)
    assert S.encode(docs.limit(0), MODEL).count() == C.count_tokens(docs.limit(0), MODEL).count() == 0
