"""Power-of-two decomposition against the tokenizers library."""

import zlib

import numpy as np
import pytest

from pagelens.llm import decomposition, tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("capacity", [2048, 64, 1])
def test_pieces_are_the_binary_digits(corpus, library, capacity):
    got = decomposition.decompose(corpus, capacity=capacity).collect()
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    rows = corpus.select("doc_id", "text").collect()
    want: dict = {}
    for r in rows:
        ids, at = np.array(library(r.text), "<u4"), 0
        sizes = [capacity] * (len(ids) // capacity) + [1 << b for b in range(capacity.bit_length() - 2, -1, -1) if len(ids) % capacity >> b & 1]
        for n in sizes:
            want.setdefault(r.doc_id, []).append((at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), 0))
            at += n
        assert at == len(ids)
    assert {d: sorted((r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in own) for d, own in by_doc.items()} == {d: sorted(x) for d, x in want.items()}
    assert len({r.sequence_id for r in got}) == len(got) and {len(x) for x in want.values()} != {1}
    for r in got:
        assert r.sequence_id >> 56 == r.length.bit_length() - 1


def test_sequences_stay_the_same_when_run_again(corpus):
    first, again = (sorted(map(str, decomposition.decompose(corpus, capacity=64).collect())) for _ in range(2))
    assert first == again


def test_buckets_hold_all_ids(spark, corpus, library, tmp_path):
    decomposition.write_buckets(corpus, f"{tmp_path}/buckets", capacity=256)
    got: dict = {}
    for r in spark.read.parquet(f"{tmp_path}/buckets").orderBy("start").collect():
        assert len(r.ids) == r.length
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got[98] == library(corpus.where("doc_id = 98").first().text) and got[92] == got[93] == [1]


def test_decomposition_of_nothing(empty):
    assert decomposition.decompose(empty).count() == 0
    with pytest.raises(ValueError):
        decomposition.decompose(empty, capacity=48)
