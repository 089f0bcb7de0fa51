import zlib

import numpy as np
import pytest

from lumenframe.llm import toxicity
from lumenframe.llm.common import table
from lumenframe.llm.queries import op9_toxicity
from tests.llm.conftest import ODD


def _voters(rng, y, wrong):
    n = len(y)
    vote = lambda hit, false: np.where(y, rng.random(n) < hit, rng.random(n) < false).astype(int)
    weak = vote(0.4, 0.3)
    fires = np.stack([vote(0.8, 0.02), vote(0.7, 0.03), vote(0.6, 0.01), weak, weak, weak], axis=1)
    fires = np.concatenate([fires, (fires[:, :3].sum(axis=1) == 0).astype(int)[:, None]], axis=1)
    given = np.where(rng.random(n) < wrong, ~y, y).astype(int)
    given[n // 2 :] = -1
    return fires, given


def test_label_model_finds_good_voters_and_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.3
    fires, given = _voters(rng, y, 0.05)
    model = toxicity.fit_label_model(fires, given)
    assert model.weight[3] < 0.6 < model.weight[0]
    assert model.gain[0] > model.gain[3] and model.gain[6] < -1
    unlabelled = given < 0
    assert ((model.posterior(fires, given) > 0.5) == y)[unlabelled].mean() > 0.93


def test_voters_overturn_wrong_labels():
    """A tenth of the given labels is wrong; the model finds their accuracy and puts most of them right."""
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.3
    fires, given = _voters(rng, y, 0.1)
    model = toxicity.fit_label_model(fires, given)
    assert abs(1 / (1 + np.exp(-model.label)) - 0.9) < 0.03
    q = model.posterior(fires, given) > 0.5
    wrong, right = (given >= 0) & (given != y), (given >= 0) & (given == y)
    assert (q == y)[wrong].mean() > 0.75 and (q == y)[right].mean() > 0.95


def test_features_and_matcher_agree():
    text = ("scum " * 3 + "grumbling words of many kinds, and so on; " * 4 + "once").lower()
    counts, n = toxicity.counts_of(text)
    found = toxicity.features(counts, n)
    assert {"scum", "1*scum", "2*scum", "^scu", "once"} <= set(found) and "2*once" not in found
    vocab = sorted(found) + ["never", "1*never", "^nev"]
    assert sorted(vocab[i] for i in toxicity.Matcher(vocab, most=2)(text)) == sorted(found)


@pytest.fixture(scope="module")
def labelled(spark, make):
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(600):
        words = [f"w{x}" for x in rng.integers(0, 300, 60)]
        bad = i % 6 == 0
        if bad:
            for k in range(4):
                words[int(rng.integers(0, 60))] = str(rng.choice(["idiot", "worthless", "scum", "grumblex" + str(rng.integers(0, 3))]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad), "note"))
    return make(rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int, text string"), {m[0]: m[2] for m in marks}


def test_held_out_documents(labelled):
    docs, labels, truth = labelled
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == 600
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {r.doc_id for r in held} == {r.doc_id for r in found if r.held_out}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_held_out_labels_are_never_learned(labelled):
    docs, labels, _ = labelled
    from pyspark.sql import functions as F

    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, wrong)
    assert a.weights == b.weights and a.bias == b.bias


def test_odd_rows_and_missing_labels(make, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    found = toxicity.toxicity(make(ODD), none).collect()
    assert len(found) == len(ODD) and all(r.predicted == 0 for r in found)
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (3, 0, 0), (3, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(make(ODD), odd).count() == len(ODD)
    assert toxicity.toxicity(make([]), none).count() == 0


def test_repeated_and_long_rows(make, spark):
    """An id given many times counts once; a very long text is scored whole."""
    rows = [(i, ("idiot scum here " if i % 3 == 0 else "a calm text here ") + f"w{i % 7}") for i in range(90)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id bigint, quality int, toxic int")
    often = make(rows + rows[:1] * 300)
    assert toxicity._sampled(often, labels, 50, 50, "doc_id", "text").count() <= 100
    scorer = toxicity.train(often, labels)
    assert scorer.weights == toxicity.train(make(rows), labels).weights
    found = toxicity.toxicity(make(rows + rows + [(500, "calm words here " * 200_000)]), labels).collect()
    assert len(found) == 181 and len({(r.doc_id, r.score) for r in found}) == 91
    assert next(r for r in found if r.doc_id == 500).predicted == 0


def test_supplied_labels(spark):
    """Held-out recall and precision of at least 0.9 at sf0.1."""
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = [r for r in op9_toxicity.query(spark, sf).where("held_out").collect() if r.doc_id in truth]
    right = sum(r.predicted and truth[r.doc_id] for r in rows)
    assert right >= 0.9 * sum(truth[r.doc_id] for r in rows) and right >= 0.9 * sum(r.predicted for r in rows)
