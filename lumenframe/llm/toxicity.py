"""Toxicity by weak supervision.

1. Features are words and word beginnings: whether a text has one, and whether it has it at a rate
   of RATES or more. Document counts by label over the labelled sample give the vocabulary: the
   terms that stand out most, for and against.
2. Many voters look at each sampled document, labelled or not: word lists, patterns, each strongly
   one-sided vocabulary term, the absence of all of them, and - where there is one - the given label.
3. A generative label model is fitted by expectation maximisation: how often each voter fires in
   either class, and how accurate the given labels are, are estimated from the agreements of all
   voters over all sampled documents; the voters' residual correlations within a class discount
   those that repeat each other. A voter that doesn't fire says nothing; that none fires is a vote
   against. Nothing is fixed in
   favour of the given labels but a weak prior (PRIOR: as if 20 labels had been seen, 19 of them
   right), so voters that agree overturn a wrong one. Every sampled document gets a posterior.
4. A logistic regression on the vocabulary learns those posteriors and scores every document.

Only rows with crc32(doc_id) mod 5 <> 0 are learned from: at most `sample` labelled ids and
`unlabelled` others, those of least hash. The sampled ids are the only thing broadcast, so its
size is bounded by these parameters; an id given several times counts once, with its smallest text.
The vocabulary is at most `terms` entries. Scoring is one pass without a shuffle.

Defined cases: a null or empty text gets the score of a text without any term. Null ids count as
the text '' (held out, never learned from). Labels given twice: toxic if either says so; null
labels are ignored. Without any label of either class every score is the share of toxic ones (0
without labels). Very long texts are counted whole, in memory of their different words. Repeated
rows get equal scores; an empty table gives no rows; other columns, whatever their names, are
ignored. Labels, lang, source and ids are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumenframe.llm.common import materialize, released, ship_package

# Insults and threats, by family.
LEXICONS = {
    "stupidity": "dumb dumbass fool foolish idiot idiotic idiots imbecile moron moronic morons stupid stupidity",
    "worth": "garbage loser losers pathetic trash useless worthless",
    "disgust": "creep disgusting filth filthy gross nasty repulsive scum vermin vile",
    "mockery": "clown clowns coward freak jerk joke liar pig rat weirdo",
    "profanity": "ass asshole bastard bitch bullshit crap damn fuck fucking shit",
    "threat": "beat burn destroy die hang hurt kill punch shoot",
    "hate": "despise hate hated hateful inferior subhuman",
}
# Patterns over the lower-cased text.
PATTERNS = {
    "you_are": r"\byou(?:'re| are)? (?:such )?an? \w+",
    "go_away": r"\b(?:shut up|get lost|go away|drop dead)\b",
    "shouting": r"!!",
    "wish_harm": r"\b(?:hope|deserve)\w* (?:you|to) \w+",
}
WORD = re.compile(r"[^\W\d_]+")
_SETS = {k: frozenset(v.split()) for k, v in LEXICONS.items()}
_PATTERNS = {k: re.compile(v) for k, v in PATTERNS.items()}


def held_out(ident: Column) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 5 == 0


PREFIXES = (3, 4, 5, 6, 7, 8)
#: A term is a feature of its own again from these shares of a text's words (the second from two occurrences).
RATES = (1 / 250, 1 / 60)


def names_of(word: str) -> list[str]:
    """The word itself, and its beginnings marked ^."""
    n = len(word)
    found = [word] if n > 2 else []
    return found + ["^" + word[:k] for k in PREFIXES if k < n] if n > 3 else found


def counts_of(lowered: str) -> tuple[Counter, int]:
    """How often each term occurs, and the number of words."""
    words, counts = Counter(WORD.findall(lowered)), Counter()
    for w, n in words.items():
        for name in names_of(w):
            counts[name] += n
    return counts, words.total()


def features(counts, words: int) -> list[str]:
    """Terms, and terms marked with the rates that they reach."""
    low, high = RATES[0] * words, max(2, RATES[1] * words)
    out = list(counts)
    out += ["1*" + t for t, n in counts.items() if n >= low]
    out += ["2*" + t for t, n in counts.items() if n >= high]
    return out


def list_votes(lowered: str, words) -> list[int]:
    """1 where a word list or pattern fires, else 0 (no vote)."""
    return [int(any(w in words for w in s)) for s in _SETS.values()] + [int(bool(p.search(lowered))) for p in _PATTERNS.values()]


#: Pseudo-counts of right and wrong given labels.
PRIOR = (19.0, 1.0)


@dataclass
class LabelModel:
    """prior: share of toxic documents. gain: log odds that a voter adds where it fires; weight: what its correlations leave of that. label: log odds that a given label adds, from its accuracy."""

    prior: float
    gain: np.ndarray
    weight: np.ndarray
    label: float

    def posterior(self, fires: np.ndarray, given: np.ndarray) -> np.ndarray:
        """fires: rows by voters, 0 or 1. given: 0, 1, or -1 without a label."""
        z = np.log(self.prior / (1 - self.prior)) + fires @ (self.gain * self.weight)
        z = z + np.where(given == 1, self.label, np.where(given == 0, -self.label, 0.0))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(fires: np.ndarray, given: np.ndarray, rounds: int = 30) -> LabelModel:
    """fires: rows by voters, 0 or 1. given: 0, 1, or -1 without a label. Starts from the given labels alone."""
    fires, known = fires.astype(np.float64), given >= 0
    q, rows = np.where(given == 1, PRIOR[0] / sum(PRIOR), PRIOR[1] / sum(PRIOR)), known
    model = None
    for _ in range(rounds):
        f, p = fires[rows], q[rows]
        n1, n0 = p.sum(), (1 - p).sum()
        on1, on0 = (p @ f + 0.5) / (n1 + 1), ((1 - p) @ f + 0.5) / (n0 + 1)
        corr = np.zeros((f.shape[1], f.shape[1]))
        for w, mean in ((p, on1), (1 - p, on0)):
            z = (f - mean) / np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
            corr += np.clip((z * w[:, None]).T @ z / max(w.sum(), 1.0), -1, 1) * w.sum() / len(p)
        np.fill_diagonal(corr, 0)
        y, ql = given[known], q[known]
        right = (ql * y + (1 - ql) * (1 - y)).sum() + PRIOR[0]
        wrong = len(y) + sum(PRIOR) - right
        model = LabelModel(float(np.clip(p.mean(), 1e-4, 1 - 1e-4)), np.log(on1 / on0), 1 / (1 + np.clip(corr - 0.05, 0, 1).sum(axis=1)), float(np.log(right / wrong)))
        q, rows = model.posterior(fires, given), np.ones(len(given), bool)
    return model


def fit_linear(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int, decay: float = 1e-4, rounds: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels by Adam over all rows; (rows, cols): where the 0/1 features are 1."""
    w, m, v = np.zeros(width + 1), 0.0, 0.0
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(y)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], len(y)) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.r_[np.bincount(cols, e[rows], width) + decay * w[:-1], e.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _sampled(docs: DataFrame, labels: DataFrame, sample: int, unlabelled: int, id_col: str, text_col: str) -> DataFrame:
    """text and y (-1 without a label) of the sampled ids; a written table of at most sample + unlabelled rows."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    ids = F.col(id_col)
    others = (
        docs.where(ids.isNotNull() & ~held_out(ids)).select(ids.alias("doc_id")).distinct()
        .join(known.select("doc_id").distinct(), "doc_id", "left_anti")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled).select("doc_id", F.lit(-1).alias("y"))
    )
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = known.unionByName(others)
    rows = docs.where(ids.isNotNull()).select(ids.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    once = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return materialize(once.select("text", "y"), "sampled")


def vocabulary(sampled: DataFrame, terms: int, support: int = 5) -> tuple[list[tuple[str, float, float]], int, int]:
    """(term, toxic documents with it, others with it), the most telling first; documents of either class."""

    def run(batches):
        counts = (Counter(), Counter())
        rows = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[y].update(features(*counts_of(text.as_py().lower())))
                rows[y] += 1
        names = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array([*names, ""]), pa.array([*(counts[1][t] for t in names), rows[1]]), pa.array([*(counts[0][t] for t in names), rows[0]])], ["term", "pos", "neg"])

    sums = sampled.where("y >= 0").mapInArrow(run, "term string, pos bigint, neg bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = sums.where("term = ''").collect()
    pos, neg = (totals[0]["pos"], totals[0]["neg"]) if totals else (0, 0)
    if not pos or not neg:
        return [], pos, neg
    p1, p0 = (F.col("pos") + 0.5) / (pos + 1), (F.col("neg") + 0.5) / (neg + 1)
    z = (p1 - p0) / F.sqrt(p1 * (1 - p1) / pos + p0 * (1 - p0) / neg)
    top = sums.where(f"term <> '' and pos + neg >= {support}").withColumn("z", z).orderBy(F.abs("z").desc(), "term").limit(terms)
    return [(r["term"], r["pos"], r["neg"]) for r in top.collect()], pos, neg


class Matcher:
    """Places in a list of features of those that a text has. Words are looked up once and remembered, up to `most` of them."""

    def __init__(self, vocab: list[str], most: int = 200_000):
        self.levels: dict[str, list[int]] = {}
        for i, feature in enumerate(vocab):
            level, name = (int(feature[0]), feature[2:]) if feature[1:2] == "*" else (0, feature)
            self.levels.setdefault(name, [-1, -1, -1])[level] = i
        self.names, self.place = list(self.levels.values()), {t: i for i, t in enumerate(self.levels)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.most = most

    def __call__(self, lowered: str) -> list[int]:
        words, counts, known, place = Counter(WORD.findall(lowered)), {}, self.known, self.place
        for w, n in words.items():
            at = known.get(w)
            if at is None:
                if len(known) >= self.most:
                    known.clear()
                at = known[w] = tuple(place[t] for t in names_of(w) if t in place)
            for i in at:
                counts[i] = counts.get(i, 0) + n
        total = words.total()
        low, high = RATES[0] * total, max(2, RATES[1] * total)
        out = []
        for i, n in counts.items():
            a, b, c = self.names[i]
            if a >= 0:
                out.append(a)
            if b >= 0 and n >= low:
                out.append(b)
            if c >= 0 and n >= high:
                out.append(c)
        return out


class Scorer:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._at = None

    def __getstate__(self):
        return (self.weights, self.bias)

    def __setstate__(self, state):
        self.__init__(*state)

    def __call__(self, text: str | None) -> float:
        if self._at is None:
            self._at, self._w = Matcher(list(self.weights)), list(self.weights.values())
        w = self._w
        z = self.bias + sum([w[i] for i in sorted(self._at((text or "").lower()))])
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def _unlike(at: np.ndarray, cols: np.ndarray, candidates: np.ndarray, n: int, width: int, most: int, alike: float = 0.8) -> np.ndarray:
    """rows by voters: the candidates in turn, without those that fire on nearly the same rows as one before."""
    place = np.full(width, -1)
    place[candidates] = np.arange(len(candidates))
    hit = place[cols] >= 0
    fires = np.zeros((len(candidates), n), np.float32)
    fires[place[cols[hit]], at[hit]] = 1
    kept: list[int] = []
    for i in range(len(candidates)):
        both, size = fires[kept] @ fires[i], fires[i].sum()
        if len(kept) < most and size and not (both > alike * (fires[kept].sum(axis=1) + size - both)).any():
            kept.append(i)
    return fires[kept].T.astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, sample: int = 12000, unlabelled: int = 4000, terms: int = 4000, voters: int = 64, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    ship_package(docs.sparkSession)
    sampled = _sampled(docs, labels, sample, unlabelled, id_col, text_col)
    vocab, pos, neg = vocabulary(sampled, terms)
    if not vocab:
        share = pos / (pos + neg) if pos + neg else 0.0
        return Scorer({}, float(np.log(share / (1 - share))) if 0 < share < 1 else 30.0 if share else -30.0)
    names = [t for t, _, _ in vocab]

    def run(batches):
        match = Matcher(names)
        for batch in batches:
            hit, votes = [], []
            for text in batch.column(0):
                lowered = text.as_py().lower()
                hit.append(sorted(match(lowered)))
                votes.append(list_votes(lowered, set(WORD.findall(lowered))))
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.int8())), batch.column(1)], ["hit", "votes", "y"])

    rows = sampled.mapInArrow(run, "hit array<int>, votes array<tinyint>, y int").toPandas()
    rows = rows.iloc[np.lexsort((rows["hit"].map(lambda h: (len(h), *h)).map(hash), rows["y"]))]  # the order of rows must not matter
    y = rows["y"].to_numpy().astype(np.int64)
    at = np.repeat(np.arange(len(rows)), rows["hit"].map(len).to_numpy())
    cols = np.concatenate(rows["hit"].to_list()).astype(np.int64)
    sided = np.array([i for i, (_, a, b) in enumerate(vocab) if (a + 0.5) / (pos + 1) > 60 * (b + 0.5) / (neg + 1)][: 8 * voters], np.int64)
    mined = _unlike(at, cols, sided, len(rows), len(vocab), voters)
    lists = np.stack(rows["votes"].to_list()).astype(np.int64)
    votes = np.concatenate([lists, mined, (mined.sum(axis=1) == 0).astype(np.int64)[:, None]], axis=1)
    model = fit_label_model(votes, y)
    w, bias = fit_linear(at, cols, model.posterior(votes, y), len(vocab))
    return Scorer({t: float(w[i]) for i, t in enumerate(names) if w[i]}, bias)


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", out: str = "__score") -> DataFrame:
    """docs with the score appended; one pass, no shuffle."""
    ship_package(docs.sparkSession)
    width = len(docs.columns)
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])

    def run(batches):
        for batch in batches:
            values = [scorer(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), pa.array(values, pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(released(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scorer = train(docs, labels, id_col=id_col, text_col=text_col, **how)
    scored = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), scorer)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
