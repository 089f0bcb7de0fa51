import numpy as np
import pyarrow as pa
import pytest

from lumenframe.llm import repeats
from tests.llm.conftest import ODD


def slow(rows, length):
    """rows in document order: (id, bytes) -> removed runs."""
    seen, out = set(), []
    for _, data in rows:
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist())))
    return out


@pytest.mark.parametrize("alphabet", [2, 3, 200])
def test_suffix_array_and_common_prefixes(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in (0, 1, 2, 9, 700):
        data = rng.integers(0, alphabet, n).astype(np.uint8)
        b = data.tobytes()
        order, rank = repeats.suffix_array(data)
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:]) and (rank[order] == np.arange(n)).all()
        for i, lcp in enumerate(repeats.common_prefixes(data, order).tolist()):
            x, y = (b[order[i] :], b[order[i - 1] :]) if i else (b"", b"")
            assert lcp == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 400}, {"shard_bytes": 300, "hot_bytes": 600}, {"shard_bytes": 300, "hot_bytes": 250}, {"shard_bytes": 500, "every": 1, "least": 1}, {"shard_bytes": 300, "hot_bytes": 1000, "every": 1, "least": 3}])
def test_removed_runs_match_brute_force(make, how):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    common = [word(180), word(120), word(99), word(60)]
    rows = [(i, word(rng.integers(0, 80)) + "".join(common[k] + word(rng.integers(0, 40)) for k in rng.integers(0, 4, rng.integers(0, 5)))) for i in range(40)]
    rows += [(100, "ab" * 400), (101, "x" + "ab" * 200), (102, None), (103, "")]
    expected = slow([(i, (t or "").encode()) for i, t in sorted(rows)], 100)
    rng.shuffle(rows)
    found = {r.doc_id: r for r in repeats.remove_repeats(make([tuple(r) if r[1] is not None else (r[0], None) for r in [(int(i), t) for i, t in rows]]), **how).collect()}
    for (i, t), spans in zip(sorted(rows, key=lambda r: int(r[0])), expected):
        r, data = found[int(i)], (t or "").encode()
        assert [(s.begin, s.end) for s in r.spans] == spans and r.n_bytes == len(data)
        keep = np.ones(len(data), bool)
        for a, b in spans:
            keep[a:b] = False
        assert bytes(r.kept) == np.frombuffer(data, np.uint8)[keep].tobytes()


def test_odd_rows(make):
    found = repeats.remove_repeats(make(ODD)).collect()
    assert len(found) == len(ODD)
    long = next(r for r in found if r.doc_id == 6)
    assert [(s.begin, s.end) for s in long.spans] == [(5, 150_000)]
    same = [(r.doc_id, len(r.spans)) for r in found if r.doc_id == 1]
    assert same == [(1, 0)] * 3
    assert repeats.remove_repeats(make([])).count() == 0


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 300, "hot_bytes": 100}, {"every": 1, "least": 2}])
def test_repeated_rows_are_one_document(make, how):
    """Rows of one id and text over `length` bytes: none repeats the other, and each is reported alike."""
    rng = np.random.default_rng(3)
    own = ["".join(rng.choice(list("abcdé "), 150)) for _ in range(4)]
    rows = [(1, own[0]), (1, own[0]), (1, own[0]), (2, own[1] + own[0]), (2, own[1] + own[0]), (3, own[2] + own[1] + own[3]), (4, own[3] * 2)]
    alone = sorted(set(rows))
    expected = dict(zip(alone, slow([(i, t.encode()) for i, t in alone], 100)))
    found = repeats.remove_repeats(make(rows), **how).collect()
    assert expected[rows[0]] == [] and any(expected.values())
    want = sorted((i, expected[i, t]) for i, t in rows)
    assert sorted((r.doc_id, [(s.begin, s.end) for s in r.spans]) for r in found) == want


def test_a_run_longer_than_a_packed_span():
    """A shard reports every byte of a repeated run of over 65,535."""
    text = np.random.default_rng(5).integers(1, 256, 140_000).astype(np.uint8).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([7, 7]), pa.array([1, 2]), pa.array([0, 30]), pa.array([text, text])], ["key", "ord", "begin", "t"])
    spans = [s for b in repeats._shards(100, 1 << 20, 1 << 22)(iter([batch])) for o, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()) if o == 2]
    assert repeats.merged(np.array(spans)) == [(30, 140_030)]


@pytest.mark.parametrize("shard, hot", [(400, 10**9), (400, 900), (1 << 18, 1 << 22)])
def test_a_key_over_several_shards(shard, hot):
    """Windows that a hot key leaves are found by their own hash; together nothing is lost."""
    rng = np.random.default_rng(7)
    texts = [rng.integers(97, 99, rng.integers(100, 160)).astype(np.uint8).tobytes() for _ in range(30)]
    texts += [texts[k][:100] + b"zz" for k in (1, 5, 9)] + [texts[3]] * 2
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])], ["key", "ord", "begin", "t"])
    rows = [(7, i, 0, t) for i, t in enumerate(texts)] + [(8, 50, 0, b"other " * 20 + texts[0][:90])]
    spans, rest = {}, []
    for turn in range(2):
        for b in repeats._shards(100, shard, hot)(iter([batch(rows[:20]), batch(rows[20:])] if not turn else [batch(sorted(rest))] if rest else [])):
            for k, o, s, t in zip(*(b.column(i).to_pylist() for i in range(4))):
                if t is None:
                    spans.setdefault(o, []).append(s)
                else:
                    assert turn == 0
                    rest.append((k, o, s >> 16, t))
    assert bool(rest) == (hot == 900)
    expected = slow(list(enumerate(texts)), 100)
    assert [repeats.merged(np.array(spans.get(i, []), np.int64)) for i in range(len(texts))] == expected


def test_periodic_texts_send_few_rows():
    """A periodic text's repeats unite in the batch; a megabyte gives fewer than a thousand rows, and all but a period and 100 bytes goes."""
    text = b"ab" * 500_000
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text[:70_000]])], ["ord", "t"])
    out = list(repeats._anchor_rows(100)(iter([batch])))
    assert sum(b.num_rows for b in out) < 1000
    spans = {1: [], 2: []}
    for b in out:
        for kind, ident, span in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()):
            if kind == 1:
                spans[ident].append(span)
    gone = repeats.merged(np.array(spans[1]))
    assert gone[-1][1] > len(text) - 200 and sum(b - a for a, b in gone) > 0.99 * len(text)
    assert repeats.merged(np.array(spans[2])) == [(0, 70_000)]
