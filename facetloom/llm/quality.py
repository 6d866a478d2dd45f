"""Quality classifier from weak labels.

Overlapping heuristic labellers vote bad, good or not at all on each document;
a table of known labels, where there is one, settles the class of its documents
and so anchors the labellers' accuracies.
Expectation-maximisation over the counts of vote patterns, taken over all documents,
estimates how each labeller votes on good and on bad documents, and so how
likely each pattern is bad. These posteriors are the targets of a linear scorer
over hashed features, fitted on at most ``TRAIN_ROWS`` documents (a hash sample of
all, and those with known labels for half of the rows at most); the scorer then
judges every document. Two such tasks, junk and abuse, decide together: a document is kept if neither rejects it.

Texts are read whole. A null or empty text votes like a text without words and
is kept unless the scorer learned otherwise. A label of a repeated id is the
largest one; a null id has no label. Repeated rows get equal scores; no
documents give no rows; without any vote for a class its prior stays small and
nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import arrow_map, free_name, row_type, store
from facetloom.llm.rules import Measures

FEATURES = 1 << 17
TRAIN_ROWS = 20_000
REJECT_AT = 0.6
STEP, SPARSE, EPOCHS = 0.5, 3.0, 12  # few of many words matter
BAD, GOOD, ABSTAIN = 1, 0, 2
SURE = 0.01  # chance that a known label is wrong
WORTH = 10  # known labels that weigh as much as a pattern's posterior

#: Insults that the abuse labellers count.
INSULTS = frozenset({
    "clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless",
})
EDGES = ".,;:!?\"'()[]*#$%&|<>…"


class Document(Measures):
    """Measures of a text and its folded words."""

    def __init__(self, text: str | None) -> None:
        super().__init__(text)
        self.folded = [w.strip(EDGES) for w in self.text.lower().split()]
        self.kinds = set(self.folded)
        rude = self.kinds & INSULTS
        self.n_insults = sum(w in rude for w in self.folded) if rude else 0


def banded(value: Callable[[Document], float], bad: float, good: float) -> Callable[[Document], int]:
    """Votes bad above ``bad``, good up to ``good``, and nothing between."""

    def vote(d: Document) -> int:
        x = value(d)
        return BAD if x > bad else GOOD if x <= good else ABSTAIN

    return vote


def per_word(count: str) -> Callable[[Document], float]:
    return lambda d: getattr(d, count) / max(1, d.n_words)


TASKS: dict[str, dict[str, Callable[[Document], int]]] = {
    "junk": {
        "symbols": banded(per_word("n_symbols"), 0.2, 0.02),
        "shouting": banded(per_word("n_upper"), 0.3, 0.1),
        "marks": banded(per_word("n_marked"), 0.2, 0.02),
        "repeats": banded(lambda d: d.n_repeat_words / d.n_words if d.n_words >= 30 else 0.0, 0.3, 0.1),
        "lines": banded(lambda d: d.n_dup_lines / len(d.lines) if len(d.lines) >= 8 else 0.0, 0.4, 0.2),
        "one_word": banded(lambda d: d.top_share if d.n_words >= 30 else 0.0, 0.2, 0.1),
    },
    "abuse": {
        # No word of a short English list is no sign of a polite text: they abstain.
        "any": lambda d: BAD if d.n_insults else ABSTAIN,
        "many": lambda d: BAD if d.n_insults >= 3 else ABSTAIN,
        "dense": lambda d: BAD if d.n_insults * 200 > max(1, d.n_words) else ABSTAIN,
    },
}
#: The column of known labels for a task, and the value that means bad.
KNOWN = {"junk": ("quality", 0), "abuse": ("toxic", 1)}


def feature_ids(d: Document) -> np.ndarray:
    """Hashed features: words, beginnings of words, measures in steps; the last is always on."""
    kinds = d.kinds
    names = kinds | {"5" + w[:5] for w in kinds if len(w) > 5}
    n = max(1, d.n_words)
    for name, share in (
        ("symbols", d.n_symbols / n), ("upper", d.n_upper / n), ("marks", d.n_marked / n),
        ("repeats", d.n_repeat_words / n if d.n_words >= 30 else 0.0), ("top", d.top_share if d.n_words >= 30 else 0.0),
        ("lines", d.n_dup_lines / len(d.lines) if len(d.lines) >= 8 else 0.0), ("insults", 20 * d.n_insults / n),
    ):
        # Every step reached is a feature, so weights add up along the scale.
        names |= {f"{name} {k}" for k in range(int(min(share, 1.0) * 20))}
    names |= {f"insults {k}" for k in range(100, 100 + min(d.n_insults, 3))}
    ids = np.unique(np.fromiter((crc32(x.encode()) for x in names), np.int64, len(names)) % FEATURES)
    return np.append(ids, FEATURES).astype(np.int32)


def votes(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, one pattern string per task, take, ids) of every document (doc_id, text).

    One pass over the texts: those that a scorer may learn from, at most about ``rows``, hand
    over their features (``ids``) with their votes. ``take`` says why: ``known`` for a sample of
    the documents with known labels, half of ``rows`` at most, ``other`` for a hash sample of all.
    """
    labellers = {task: list(fs.values()) for task, fs in TASKS.items()}
    steps = 1 << 30
    chosen = lambda share: F.pmod(F.xxhash64(F.lit("training"), "doc_id"), F.lit(steps)) < int(min(1.0, share) * steps)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    n_known, n = known.count(), docs.count()
    of_known = min(n_known, rows // 2)
    # A sample of known size: rows / 2 ids.
    few = known.where(chosen(of_known / max(1, n_known))).withColumn("labelled", F.lit(True))
    take = F.when(F.col("labelled"), "known").when(chosen((rows - of_known) / max(1, n - n_known)), "other")
    marked = docs.join(F.broadcast(few), "doc_id", "left").select("doc_id", "text", take.alias("take"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = [Document(t) for t in batch.column(1).to_pylist()]
                columns = [pa.array(["".join(str(f(d)) for f in fs) for d in found], pa.string()) for fs in labellers.values()]
                ids = [feature_ids(d) if x else None for d, x in zip(found, batch.column(2).to_pylist(), strict=True)]
                columns += [batch.column(2), pa.array(ids, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *labellers, "take", "ids"])

    return marked.transform(arrow_map, run, ", ".join(["doc_id long", *(f"{t} string" for t in labellers), "take string, ids array<int>"]))


def with_known(voted: DataFrame, labels: DataFrame) -> DataFrame:
    """Known labels appended to the patterns, as one more labeller."""
    one = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *[F.max(c).cast("int").alias(c) for c, _ in KNOWN.values()]
    ).where("doc_id is not null")
    both = voted.join(one, "doc_id", "left")
    for task, (column, bad) in KNOWN.items():
        vote = F.when(F.col(column).isNull(), str(ABSTAIN)).when(F.col(column) == bad, str(BAD)).otherwise(str(GOOD))
        both = both.withColumn(task, F.concat(task, vote))
    return both


def expectation_maximisation(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of bad for each vote pattern, and P(vote | class) per labeller.

    The last vote of a pattern is the known label: where there is one, it is the
    class. The number of patterns depends on the labellers only: three to their
    number at most.
    """
    names = sorted(patterns)
    if not names:
        return {}, np.zeros((0, 2, 3))
    counts = np.array([patterns[p] for p in names], float)
    grid = np.array([[int(c) for c in p] for p in names])
    known, grid = grid[:, -1], grid[:, :-1]
    one_hot = np.stack([grid == v for v in range(3)], axis=2).astype(float)  # pattern, labeller, vote

    def settled(chance: np.ndarray) -> np.ndarray:
        return np.where(known == BAD, 1 - SURE, np.where(known == GOOD, SURE, chance))

    # To start with, a document is bad as far as its votes say so.
    said = (grid == BAD).sum(1)
    bad = settled(np.clip(said / np.maximum(1, np.minimum(2, (grid != ABSTAIN).sum(1))), SURE, 1 - SURE))
    rates = np.zeros((grid.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - bad), counts * bad])  # class, pattern
        prior = (weight.sum(1) + 1) / (counts.sum() + 2)
        rates = np.einsum("cp,plv->lcv", weight, one_hot) + 0.1
        rates /= rates.sum(2, keepdims=True)
        log = np.log(prior)[:, None] + np.einsum("plv,lcv->cp", one_hot, np.log(rates))
        now = settled(1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50))))
        if np.abs(now - bad).max() < 1e-6:
            break
        bad = now
    return dict(zip(names, now.tolist(), strict=True)), rates


def posteriors(voted: DataFrame) -> dict[str, dict[str, float]]:
    """Posterior of bad by task and pattern, from pattern counts over all documents.

    Labellers are not independent, so where documents of a pattern have known labels,
    these correct it; the posterior counts as ``WORTH`` of them.
    """
    found = {}
    for task in TASKS:
        counted = {r[0]: r[1] for r in voted.groupBy(task).count().collect()}
        found[task], _ = expectation_maximisation(counted)
        for pattern in [p for p in found[task] if p[-1] == str(ABSTAIN)]:
            bad, good = (counted.get(pattern[:-1] + str(v), 0) for v in (BAD, GOOD))
            found[task][pattern] = (bad + WORTH * found[task][pattern]) / (bad + good + WORTH)
    return found


def training_rows(voted: DataFrame) -> DataFrame:
    """(ids, patterns) of the documents to learn from, one row per id.

    Of documents with known labels only their own sample counts.
    """
    known = " or ".join(f"right({t}, 1) <> '{ABSTAIN}'" for t in TASKS)
    return voted.where(f"take = 'known' or take = 'other' and not ({known})").dropDuplicates(["doc_id"]).select("ids", *TASKS)


def follow_the_leader(rows: list[np.ndarray], chances: np.ndarray, shares: np.ndarray | None = None) -> np.ndarray:
    """Sparse logistic weights of hashed features, learned row by row against soft targets.

    A row's gradient counts by its share, whole if there are no shares.

    Follow the regularised leader: a feature's weight stays zero until its
    gradients add up to more than ``SPARSE``, so rare words do not count. The
    last weight is the intercept.
    """
    z, n = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)

    def weight(total, seen):
        return np.where(np.abs(total) <= SPARSE, 0.0, (np.sign(total) * SPARSE - total) * STEP / (1 + np.sqrt(seen)))

    shares = np.ones(len(rows)) if shares is None else shares
    for _ in range(EPOCHS):
        for ids, chance, share in zip(rows, chances, shares, strict=True):
            total, seen = z[ids], n[ids]
            w = weight(total, seen)
            slope = share * (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - chance)
            z[ids] = total + slope - (np.sqrt(seen + slope * slope) - np.sqrt(seen)) / STEP * w
            n[ids] = seen + slope * slope
    return weight(z, n)


def learned_weights(rows: list[np.ndarray], chances: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Weights learned from all ``rows``.

    Labellers see few kinds of bad documents, so where labels of both classes are
    known, a scorer of those documents is one more labeller of the others: its
    log-odds, less those of its prior, are added to the ones of the votes. The
    others then count by how sure they are, and together no more than the known.
    """
    shares = None
    if known.any() and not known.all() and np.ptp(chances[known]) > 0:
        first = follow_the_leader([r for r, k in zip(rows, known, strict=True) if k], chances[known])
        odds = lambda p: np.log(p / (1 - p))
        said = np.array([first[r].sum() for r, k in zip(rows, known, strict=True) if not k])
        voted = odds(np.clip(chances[~known], 1e-6, 1 - 1e-6))
        chances = chances.copy()
        chances[~known] = 1 / (1 + np.exp(-np.clip(voted + said - odds(chances[known].mean()), -50, 50)))
        shares = np.ones(len(rows))
        shares[~known] = (2 * chances[~known] - 1) ** 2 * min(1.0, known.sum() / (~known).sum())
    return follow_the_leader(rows, chances, shares)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Weights of each task's scorer, the intercept last."""
    voted = store(with_known(store(votes(docs, labels, rows), "own-votes"), labels), "votes")
    bad = posteriors(voted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = [batch.column(k + 1).to_pylist() for k in range(len(TASKS))]
            chances = [pa.array([bad[task].get(p, 0.0) for p in own], pa.float64()) for task, own in zip(TASKS, patterns, strict=True)]
            settled = [pa.array([p[-1] != str(ABSTAIN) for p in own], pa.bool_()) for own in patterns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *chances, *settled], ["ids", *TASKS, *(f"{t}_known" for t in TASKS)])

    shape = ", ".join(["ids array<int>", *(f"{t} double" for t in TASKS), *(f"{t}_known boolean" for t in TASKS)])
    sample = training_rows(voted).transform(arrow_map, run, shape)
    # One task learns each scorer, from a number of rows that is bounded whatever the corpus.
    each = store(sample, "training-rows").select("ids", F.explode(F.create_map(
        *[x for t in TASKS for x in (F.lit(t), F.struct(F.col(t).alias("chance"), F.col(f"{t}_known").alias("known")))]
    )).alias("task", "row")).select("ids", "task", "row.*")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort([crc32(i.tobytes()) for i in frame.ids], kind="stable")  # the same on every run
        weights = learned_weights(
            [frame.ids.iloc[k] for k in order], frame.chance.to_numpy()[order], frame.known.to_numpy()[order]
        )
        at = np.flatnonzero(weights)
        return pd.DataFrame({"task": frame.task.iloc[0], "feature": at.astype(np.int32), "weight": weights[at]})

    learned = each.groupBy("task").applyInPandas(learn, "task string, feature int, weight double")
    fitted = {task: np.zeros(FEATURES + 1) for task in TASKS}
    for task, feature, weight in learned.collect():  # at most FEATURES + 1 for each task
        fitted[task][feature] = weight
    for weights in fitted.values():
        if not weights.any():  # nothing to learn from: reject nothing
            weights[FEATURES] = -10.0
    return fitted


def classify(
    docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, reject_at: float = REJECT_AT, into: str = "verdict"
) -> DataFrame:
    """``docs`` (any columns, doc_id and text among them) with a struct ``into``: chance per task, kept."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fitted = fit(plain, labels, rows)
    data = docs.drop(into)
    names = data.columns
    at = names.index("text")
    weights = data.sparkSession.sparkContext.broadcast(fitted)  # FEATURES numbers per task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = weights.value
        kind = pa.struct([*((t, pa.float64()) for t in models), ("kept", pa.bool_())])
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                out = []
                for text in batch.column(at).to_pylist():
                    ids = feature_ids(Document(text))
                    chance = {t: float(1 / (1 + np.exp(-np.clip(w[ids].sum(), -50, 50)))) for t, w in models.items()}
                    out.append(chance | {"kept": all(p < reject_at for p in chance.values())})
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*names, into])

    fields = ",".join(f"{t}:double" for t in TASKS)
    return data.transform(arrow_map, run, f"{row_type(data)}, `{into}` struct<{fields},kept:boolean>")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those the classifier rejects."""
    into = free_name(docs.columns, "verdict")
    return classify(docs, labels, into=into).where(f"{into}.kept").select(*docs.columns)
