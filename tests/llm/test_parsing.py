import hashlib

import numpy as np

from lumenframe.llm import parsing
from tests.llm.conftest import ODD


def names_at(text, level):
    return {int(n) for n, _ in zip(*list(parsing.hierarchy([text], level))[-1])}


def test_equal_substrings_share_interior_names_at_any_offset():
    rng = np.random.default_rng(0)
    letters = np.array(list("abcdefgh é"))
    inner = "".join(rng.choice(letters, 4000))
    for level, share in ((1, 0.98), (2, 0.97), (3, 0.93), (4, 0.85)):
        base = names_at(inner, level)
        for head in (1, 2, 3, 7, 50):
            moved = names_at("".join(rng.choice(letters, head)) + inner + "zz", level)
            assert len(base & moved) >= share * len(base)


def test_phrases_are_short_and_cover_runs():
    texts = ["a" * 5000, "ab" * 3000, "".join(np.random.default_rng(1).choice(list("xyz"), 5000))]
    sizes = [np.bincount(o, minlength=3) for _, o in parsing.hierarchy(texts, 3)]
    assert all(sizes[k][2] * 2 >= 5000 / 8 ** (k + 1) for k in range(3))
    assert sizes[0][0] == 1


def test_equal_texts_and_batches_do_not_matter():
    texts = ["", "a", "same text here", "x" * 100_000, "same text here", "other"]
    all_at_once = parsing.in_blocks(texts)
    one_by_one = np.concatenate([parsing.in_blocks([t]) for t in texts])
    assert (all_at_once == one_by_one).all() and (all_at_once[2] == all_at_once[4]).all()
    assert (parsing.from_text(parsing.to_text(all_at_once)) == all_at_once).all()
    assert parsing.likeness(all_at_once[:1], all_at_once[:1])[0] == 1.0


def test_likeness_follows_overlap():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    text = " ".join(rng.choice(words, 2000))
    other = " ".join(rng.choice(words, 2000))
    scores = [parsing.likeness(*parsing.in_blocks([text, text[: int(len(text) * (1 - f))] + other[: int(len(text) * f)]])[:, None])[0] for f in (0, 0.1, 0.33, 0.66, 1)]
    assert scores[0] == 1 and scores == sorted(scores, reverse=True) and scores[1] > 0.65 and scores[4] < 0.1


def expected(rows):
    """Brute force for rows with distinct ids: doc_id -> (n, sha of the edited text)."""
    order = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), edited)
    return out


def test_edited_texts_match_brute_force(make):
    rng = np.random.default_rng(3)
    rows = [(int(i), "".join(rng.choice(list("abc é🙂"), int(n)))) for i, n in zip(rng.permutation(500)[:120], rng.integers(0, 90, 120))] + [(999, None)]
    for ranges in (1, 7, 300):
        found = parsing.edited_fingerprints(make(rows), ranges=ranges).collect()
        want = expected(rows)
        assert len(found) == len(rows)
        for r in found:
            n, sha, edited = want[r.doc_id]
            assert (r.n_chars, r.edited_sha256) == (n, sha)
            assert r.edited_fingerprint == parsing.to_text(parsing.in_blocks([edited]))[0]
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_odd_rows(make):
    found = parsing.edited_fingerprints(make(ODD), ranges=3).collect()
    assert sorted(repr(r.doc_id) for r in found) == sorted(repr(i) for i, *_ in ODD)
    single = parsing.edited_fingerprints(make([(4, "abcdef")])).collect()
    assert single[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert parsing.edited_fingerprints(make([])).count() == 0
    assert parsing.edited_fingerprints(make([(None, "abc"), (None, None)])).count() == 2
