import re

import numpy as np
import xxhash

from lumenframe.llm import components, simhash
from tests.llm.conftest import ODD


def slow_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def slow_components(values, radius):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def test_documents_match_brute_force(make):
    base = " ".join(f"w{i * i % 97}" for i in range(300))
    rows = [*ODD, *((100 + i, base.replace("w9 ", f"v{i} ", 1)) for i in range(12)), (50, base.upper())]
    found = simhash.near_duplicates(make(rows)).collect()
    prints = [slow_fingerprint(t) for _, t, *_ in rows]
    label = slow_components(prints, 4)
    least = {}
    for (i, *_), c in zip(rows, label):
        least[c] = min(x for x in (least.get(c), i) if x is not None) if (least.get(c), i) != (None, None) else None
    expected = sorted(repr((i, f"{p:016x}", least[c])) for (i, *_), p, c in zip(rows, prints, label))
    assert sorted(repr(tuple(r)) for r in found) == expected


def test_every_plan_finds_every_link(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    values = set(map(int, centres))
    for c in centres[:30]:
        for _ in range(8):
            values.add(int(c) ^ sum({1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)}))
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v, v) for v in signed], "node bigint, f0 bigint")
    label = slow_components(values, 4)
    n, both = simhash.bit_counts(nodes)
    assert n == len(values)
    parts = simhash.correlated_parts(n, both, 4)
    assert sorted(i for p in parts for i in p) == list(range(64))
    unequal = [(p, [[], *([i] for i in p)] if k == 0 else [[]]) for k, p in enumerate(parts)]  # thresholds 1, 0, 0, 0
    for plan in (simhash.probe_plan(n, both, 4), unequal):
        for block in (4096, 3):
            root = {r.node: r.root for r in components.connected(simhash.link(nodes, plan, 4, block=block)).collect()}
            groups = {}
            for v, c in zip(signed, label):
                groups.setdefault(c, set()).add(root.get(v, v))
            assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_thresholds_sum_as_they_must():
    both = np.full((64, 64), 250.0) + np.eye(64) * 250
    for m in (2, 3, 4, 5, 7):
        parts = simhash.correlated_parts(1000, both, m)
        _, chosen = simhash.thresholds(1000, both, parts, 4)
        assert not chosen or sum(chosen) == 4 - m + 1


def test_similar_texts_meet_and_others_do_not(make):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 5000, 300)) for _ in range(20)]
    close = [" ".join(w if i != 150 else "changed" for i, w in enumerate(t.split())) for t in texts]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(close)]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(make(rows)).collect()}
    assert found == {i: i % 100 for i, _ in rows}


def test_no_edges_and_empty_tables(make, spark):
    assert components.connected(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u bigint, v bigint")
    assert {r.root for r in components.connected(chain).collect()} == {0}
    assert simhash.near_duplicates(make([])).count() == 0 and simhash.similar_documents(make([])).count() == 0


def slow_similar(rows, words=5):
    """Components by links of Jaccard >= 0.8 over word shingles, all pairs compared; the pairs."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    label, pairs = list(range(len(rows))), []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                pairs.append((i, j))
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (i, _), c in zip(rows, label):
        least[c] = min(i, least.get(c, i))
    return {i: least[c] for (i, _), c in zip(rows, label)}, pairs


def test_similar_documents_are_those_of_brute_force(make):
    """Pairs on both sides of 0.8, one common passage, one group larger than a block."""
    rng = np.random.default_rng(6)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for k in range(40):
        text = [f"t{x}" for x in rng.integers(0, 9000, 244)] + (passage if k % 2 else [])
        rows.append((k, " ".join(text)))
        for copy, edits in enumerate(rng.integers(1, 10, 3)):
            changed = list(text)
            for x in range(edits):
                changed[10 + x * 24] = f"c{k}_{copy}_{x}"
            rows.append((1000 + k * 10 + copy, " ".join(changed)))
    group = [f"g{x}" for x in rng.integers(0, 9000, 100)]
    rows += [(5000 + i, " ".join([*group[:50], f"own{i}", *group[50:]])) for i in range(70)]
    expected, pairs = slow_similar(rows)
    assert len(pairs) > 2000
    for block in (4096, 30):
        assert {r.doc_id: r.component_id for r in simhash.similar_documents(make(rows), block=block).collect()} == expected


def written(monkeypatch):
    """What similar_documents() writes: (name, plan, rows)."""
    seen, write = [], simhash.materialize

    def spy(df, name):
        made = write(df, name)
        seen.append((name, df._jdf.queryExecution().toString(), made.count()))
        return made

    monkeypatch.setattr(simhash, "materialize", spy)
    return seen


def test_pairs_that_their_places_rule_out_are_no_candidates(make, monkeypatch):
    """Twenty own shingles of 146 stand first in each text: no pair of the group reaches 0.8 (126 of 166), whatever its sketches say."""
    words = [f"w{i}" for i in range(150)]
    rows = [(k, " ".join(f"own{k}_{i}" if i in (20, 50, 80, 110) else w for i, w in enumerate(words))) for k in range(60)]
    seen = written(monkeypatch)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(make(rows)).collect()} == {k: k for k in range(60)}
    assert [n for name, _, n in seen if name == "candidates"][1:] == [0, 0, 0]


def test_whole_sets_are_not_sent_to_python(make, monkeypatch):
    base = " ".join(f"w{i}" for i in range(120))
    seen = written(monkeypatch)
    found = simhash.similar_documents(make([(1, base), (2, base + " tail"), (3, "another text")])).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 3}
    assert {"shingles", "candidates", "links", "buckets"} <= {name for name, _, _ in seen}
    assert not [name for name, plan, _ in seen if re.search(r"MapInArrow \w+\([^)]*shingles", plan)]


def test_a_worker_keeps_no_memory_of_a_pass():
    """Arrow's pool keeps what a pass over whole texts took until it is told to give it back."""
    import pyarrow as pa

    from lumenframe.llm.common import released

    given = []

    def run(batches):
        for batch in batches:
            yield batch

    class Pool:
        def release_unused(self):
            given.append(True)

    batches, pool = [pa.RecordBatch.from_pydict({"a": [1, 2]})] * 2, pa.default_memory_pool
    try:
        pa.default_memory_pool = Pool
        assert list(released(run)(iter(batches))) == batches and given == [True]
    finally:
        pa.default_memory_pool = pool
