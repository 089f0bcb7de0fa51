from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenframe.llm import packing, token_output, tokens
from tests.llm.conftest import ODD

HF = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = [t for _, t, *_ in ODD] + ["it's we'll they'd 'something", "a  b   c\n\n d\t", "<|endoftext|> in a text", "½ ² 三 ١٢٣ ǅ", "!!'s x" * 50, "  　x"]


def ids(text):
    return HF.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_tokenizers_file(text):
    assert tokens.document_ids(text).tolist() == ids(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    assert tokens.document_ids(text).tolist() == ids(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 256), max_size=120), st.integers(256, 1024))
def test_windows_hold_everything_once_within_capacity(sizes, capacity):
    found = packing.windows_within(sizes, capacity)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= capacity for w in found)


def test_differencing_balances():
    sizes = np.random.default_rng(0).integers(1, 257, 900).tolist()
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 100)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 0.02 * max(sums)
    assert packing.windows_within([600, 600, 600], 1024) and len(packing.windows_within([600, 600, 600], 1024)) == 3


def test_packed_pieces_give_the_documents_back(make):
    rows = [*ODD, *((50 + i, "some words here " * (i * 37 % 400)) for i in range(60))]
    found = packing.pack(make(rows), block=4).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in ((i, t) for i, t, *_ in rows if i is not None and i != 1):
        whole, at = ids(t), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(whole)) and np.frombuffer(r.ids, "<u4").tolist() == whole[at : at + r.length]
            at += r.length
        assert at == len(whole)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(make([])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_decreasing_against_a_plain_search(sizes):
    rows, free = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [f for f in free if f >= sizes[i]]
        if fits:
            k = free.index(min(fits))
        else:
            k = len(rows)
            rows.append([])
            free.append(64)
        rows[k].append(i)
        free[k] -= sizes[i]
    found = token_output.best_fit_decreasing(sizes, 64)
    assert sorted(i for r in found for i in r) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= 64 for r in found)
    assert sorted(sum(sizes[i] for i in r) for r in found) == sorted(sum(sizes[i] for i in r) for r in rows)


def test_matrices_round_trip(make, spark, tmp_path):
    rows = [*ODD, *((50 + i, "some words here " * (i * 37 % 400)) for i in range(60))]
    blocks = token_output.matrices(make(rows), width=256, block_tokens=5000)
    token_output.write(blocks, f"{tmp_path}/blocks")
    stored = spark.read.parquet(f"{tmp_path}/blocks")
    back = defaultdict(list)
    for r in token_output.read_segments(stored).collect():
        back[r.doc_id].append((r.start, list(r.ids)))
    for i, t in ((i, t) for i, t, *_ in rows if i is not None and i != 1):
        assert sum((x for _, x in sorted(back[i])), []) == ids(t)
    for b in stored.collect():
        cu, firsts = np.frombuffer(b.cu_seqlens, "<i8"), np.frombuffer(b.row_segments, "<i8")
        positions = np.frombuffer(b.positions, "<u2").reshape(b.n_rows, b.width)
        for r in range(b.n_rows):
            want = np.concatenate([np.arange(n) for n in np.diff(cu)[firsts[r] : firsts[r + 1]]])
            assert len(want) <= b.width and (positions[r, : len(want)] == want).all()
    assert token_output.matrices(make([])).count() == 0
