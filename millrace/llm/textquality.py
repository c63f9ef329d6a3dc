"""Running prose or not: boosted trees on text statistics, trained on weak labels, calibrated on a hand-checked holdout.

The weak labels come from labelers that look at other things than the trees do (textstats.weak_vote), and may
abstain. `examples.csv` holds the statistics of 400 weakly labelled documents that every training set starts with,
so that a table of any size, even an empty one, is judged in the same way. `holdout.csv` holds the statistics of
212 documents whose beginning, middle and end were read and which were then labelled by hand, 60 doubtful ones on
purpose among them; none of them is ever trained on. One half of it calibrates the probabilities, the other half
measures them (`report`).
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.gbt import Boosted, platt
from millrace.llm.textstats import STATS, statistics
from millrace.session import Scratch, text_batches

#: Documents of the table in the training sample, about; at most twice as many are ever collected.
TRAIN_DOCS = 4000
#: What the trees see: every statistic but the one that a labeler uses.
FEATURES = tuple(s for s in STATS if s != "prose_share")
#: Bins of probability in which the calibration error is measured.
CALIBRATION_BINS = 5


@cache
def labelled(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, statistics, labels: 1 not prose) of a file of labelled documents beside this module."""
    with open(Path(__file__).with_name(name), encoding="utf-8", newline="") as f:
        rows = list(csv.DictReader(f))
    return (np.array([int(r["doc_id"]) for r in rows]), np.array([[float(r[s]) for s in STATS] for r in rows]), np.array([int(r["label"]) for r in rows]))


def _columns(x: np.ndarray) -> np.ndarray:
    return x[:, [STATS.index(s) for s in FEATURES]]


class ProseModel:
    """The fitted model: probability that a text is not prose. rows, votes: statistics and weak labels of the table's sample."""

    def __init__(self, rows: np.ndarray, votes: np.ndarray):
        _, ex, ey = labelled("examples.csv")
        x, y = np.concatenate([ex, rows]), np.concatenate([ey, (votes < 0).astype(int)])
        self.model = Boosted(trees=150, depth=4).fit(_columns(x), y.astype(float))
        _, hx, hy = labelled("holdout.csv")
        self.a, self.b = platt(self._raw(hx[::2]), hy[::2])

    def _raw(self, x: np.ndarray) -> np.ndarray:
        return self.model.score(_columns(x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """1 for texts without a word or sign."""
        p = 1 / (1 + np.exp(-np.clip(self.a * self._raw(x) + self.b, -40, 40)))
        return np.where(x[:, 0] == 0, 1.0, p)

    def report(self) -> dict[str, float]:
        """On the half of the holdout that is not used to calibrate: errors, mean squared error, calibration error (mean distance
        of probability and share of junk per bin, weighted by documents); and the errors of the best single cut of any one feature."""
        _, x, y = (v[1::2] for v in labelled("holdout.csv"))
        p = self.probability(x)
        at = np.minimum((p * CALIBRATION_BINS).astype(int), CALIBRATION_BINS - 1)
        gap = sum(abs(p[at == k].mean() - y[at == k].mean()) * (at == k).sum() for k in range(CALIBRATION_BINS) if (at == k).any()) / len(y)
        return {"documents": len(y), "errors": int(((p >= 0.5) != y).sum()), "squared_error": float(((p - y) ** 2).mean()), "calibration_error": float(gap),
                "errors_of_best_cut": min(self._best_cut(v, y) for v in _columns(x).T)}

    @staticmethod
    def _best_cut(v: np.ndarray, y: np.ndarray) -> int:
        """Fewest errors of a cut in either direction, chosen in hindsight on the same documents."""
        return min(int(min(((v > c) != y).sum(), ((v <= c) != y).sum())) for c in np.unique(v))


def train(stats: DataFrame) -> ProseModel:
    """Fits on the voted sample without the documents of the holdout; repeated rows count once."""
    held, x, _ = labelled("holdout.csv")
    known = [f"{i}:{int(c)}" for i, c in zip(held, x[:, 0])]
    rows = stats.filter("vote <> 0 AND chars > 0").filter(~F.concat_ws(":", "doc_id", F.col("chars").cast("bigint")).isin(known))
    rows = rows.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", *STATS).limit(2 * TRAIN_DOCS).select(*STATS, "vote").toPandas()
    return ProseModel(rows[list(STATS)].to_numpy(dtype="float64").reshape(-1, len(STATS)), rows["vote"].to_numpy(dtype="int64"))


def scored(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, STATS..., not_prose): statistics and calibrated probability of every document.

    Null, empty and blank texts have all-zero statistics and probability 1. Texts are read once;
    the statistics are written, and model and scores work on them. The sample to train on is chosen by
    a digest of doc_id; its bound (TRAIN_DOCS) does not depend on the table.
    """
    scratch = scratch or Scratch(documents.sparkSession, "textquality")
    share = max(1, documents.count() // TRAIN_DOCS)
    with text_batches(documents.sparkSession):
        stats = scratch.write(statistics(documents, F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(share)) == 0), "stats")
    model = train(stats)
    schema = ", ".join(["doc_id bigint", *(f"{s} double" for s in STATS), "not_prose double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["not_prose"] = model.probability(rows[list(STATS)].to_numpy(dtype="float64"))
            yield rows

    return stats.drop("vote").mapInPandas(run, schema)
