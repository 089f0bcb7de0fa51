import hashlib
from collections import defaultdict

from lumenframe.llm import exact_dedup
from tests.llm.conftest import ODD


def test_groups_match_brute_force(make):
    for keep in ("max", "min"):
        found = exact_dedup.exact_groups(make(ODD), keep).collect()
        groups = defaultdict(list)
        for i, t, *_ in ODD:
            groups[t or ""].append(i)
        expected = sorted(
            repr((i, k, len(groups[t or ""]), i == k, hashlib.sha256((t or "").encode()).hexdigest()))
            for i, t, *_ in ODD
            for k in [{"max": max, "min": min}[keep]([x for x in groups[t or ""] if x is not None], default=None)]
        )
        assert sorted(repr(tuple(r)) for r in found) == expected


def test_one_row_of_each_text_stays_with_its_columns(make):
    docs = make(ODD)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema or kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({t or "" for _, t, *_ in ODD})
    by_text = {r.text or "": r for r in rows}
    assert by_text[ODD[0][1]].doc_id == 9_000_000_000
    assert by_text[""].doc_id == 3 and by_text[""].text == ""
    assert all(r.h == "x" and r.spans == 2 for r in rows)


def test_empty_table(make):
    assert exact_dedup.exact_groups(make([])).count() == 0 and exact_dedup.deduplicate(make([])).count() == 0
