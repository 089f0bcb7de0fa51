from collections import defaultdict

import corpus_pipeline
from lumenframe.llm import exact_dedup, toxicity
from lumenframe.llm.common import DOCUMENT_COLUMNS, table
from tests.llm.conftest import ODD


def word_sets(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def components(sets):
    """Brute force: every pair that shares a shingle, linked at a Jaccard of 0.8; the smallest id reachable."""
    by, label = defaultdict(list), {i: i for i in sets}
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i] or {()}:
            for j in by[s]:
                shared[j] += 1
            by[s].append(i)
        for j, both in shared.items():
            if not sets[i] and not sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                for k in label if a != b else ():
                    if label[k] in (a, b):
                        label[k] = min(a, b)
    return label


def test_each_stage_on_what_the_one_before_kept(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == list(DOCUMENT_COLUMNS)
        found = docs.collect()
        assert all(r == rows[r.doc_id] for r in found)
        kept[name] = {r.doc_id for r in found}
    names = list(kept)
    assert all(kept[b] <= kept[a] for a, b in zip(names, names[1:]))
    scorer = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    assert kept["toxicity"] == {i for i, r in rows.items() if scorer(r.text) < 0.5}
    last = {}
    for i in kept["toxicity"]:
        last[rows[i].text] = max(i, last.get(rows[i].text, -1))
    assert kept["exact dedup"] == set(last.values())
    sets = {i: word_sets(rows[i].text) for i in kept["exact dedup"]}
    assert kept["SimHash near-dedup"] == {least for i, least in components(sets).items() if i == least}
    pieces = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert set(tokens) == kept["mixing"] and all(tokens[p.doc_id] == p.doc_tokens for p in pieces)


def test_run_and_odd_tables(spark, make, tmp_path):
    for k, rows in enumerate((ODD, [])):
        d = f"{tmp_path}/{k}"
        make(rows).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        out = corpus_pipeline.run(spark, d)
        assert (out.count() > 0) == bool(rows)
    assert exact_dedup.deduplicate(make(ODD)).count() == 7


def test_near_copies_of_a_repeated_id(spark, make):
    """One id with two texts: only the near copy goes. Rows without an id go after those with one."""
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(1, base), (2, base + " tail"), (2, "quite another text " * 9), (None, base + " other end"), (None, "a text of its own")]
    left = {(r.doc_id, r.text) for r in corpus_pipeline.near(spark, make(rows), None).collect()}
    assert left == {rows[0], rows[2], rows[4]}


def test_near_recall_on_supplied_documents(spark):
    """Every pair of 0.8 or more in the documents of sf0.1 is linked, and nothing else goes."""
    docs = exact_dedup.deduplicate(table(spark, "/root/testdata/sf0.1", "documents"), keep="max").where("lang in ('es', 'fr')")
    expected = components({r.doc_id: word_sets(r.text) for r in docs.collect()})
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, None).collect()} == {i for i, least in expected.items() if i == least}
