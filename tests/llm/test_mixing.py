import hashlib
from collections import defaultdict

import duckdb
import pytest

from lumenframe.llm import mixing
from tests.llm.conftest import ODD


def fill(nodes, budget):
    """Water-filling by hand: nodes name -> (weight, capacity)."""
    out, left, open_ = {}, budget, dict(nodes)
    while open_:
        w = sum(x[0] for x in open_.values())
        full = {k: c for k, (a, c) in open_.items() if c * w <= left * a}
        if not full:
            return out | {k: left * a // w for k, (a, _) in open_.items()}
        k = min(full, key=lambda k: (nodes[k][1] / nodes[k][0], k))
        out[k] = full[k]
        left -= full[k]
        del open_[k]
    return out


def test_against_brute_force(make, spark):
    rows = [(i, "x" * (7 * i % 50 + 1), ("en", "de", None)[i % 3], f"src{i % 7 if i % 2 else 0}") for i in range(400)]
    targets = mixing.Targets()
    tokens = lambda t: max(1, (len(t.encode()) + 3) // 4)
    for share, epochs in (((3, 5), 4), ((9, 10), 1), ((2, 1), 3)):
        leaf = defaultdict(list)
        for i, t, a, s in rows:
            leaf[f"group{int(s[3:]) % 4}", a or "", s].append((i, tokens(t)))
        size = {k: sum(n for _, n in v) for k, v in leaf.items()}
        cap = {k: v * epochs for k, v in size.items()}
        doms = {d: (targets.domains.get(d, 1), sum(c for k, c in cap.items() if k[0] == d)) for d in {k[0] for k in leaf}}
        budget = min(sum(size.values()) * share[0] // share[1], sum(cap.values()))
        expected = {}
        for d, b in fill(doms, budget).items():
            langs = {a: (targets.languages.get(a, 1), sum(c for k, c in cap.items() if k[:2] == (d, a))) for a in {k[1] for k in leaf if k[0] == d}}
            for a, b2 in fill(langs, b).items():
                for s, b3 in fill({k[2]: (1, cap[k]) for k in leaf if k[:2] == (d, a)}, b2).items():
                    k = (d, a, s)
                    whole, rest = divmod(b3, size[k])
                    for i, n in sorted(leaf[k], key=lambda x: hashlib.md5(f"17:{whole}:{x[0]}".encode()).hexdigest()):
                        rest -= n
                        taken = whole + (rest >= 0)
                        if taken:
                            expected[i] = (taken, b3)
        found = {r.row.doc_id: (r.copies, r.budget) for r in mixing.mix(make(rows), targets, share, epochs).collect()}
        assert found == expected
        assert sum(n for i, t, *_ in rows for n in [tokens(t) * expected.get(i, (0,))[0]]) <= budget


def test_odd_rows_and_columns(make):
    docs = make(ODD)
    mixed = mixing.mixed_rows(docs, share=(1, 1), max_epochs=1)
    assert mixed.columns == docs.columns and mixed.count() == len(ODD)
    assert mixing.mixed_rows(docs, share=(2, 1), max_epochs=2).count() == 2 * len(ODD)
    assert mixing.mix(make([])).count() == 0
