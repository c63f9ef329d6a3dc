import os
import random
import sys

import numpy as np
from conftest import rows

from millrace.llm.gbt import Boosted, platt

sys.path.insert(0, os.path.dirname(__file__))
from texts import JUNK, PROSE

from millrace.llm.textquality import FEATURES, ProseModel, labelled, scored
from millrace.llm.textstats import STATS, body_of, text_stats, weak_vote

DOCS = "doc_id bigint, text string, chars string, not_prose string"


def test_statistics_of_a_small_text():
    s = dict(zip(STATS, text_stats("The map is continuous. It has two zeros.\n\nA & B & C")))
    assert s["words"] == 13 and s["punctuated_lines"] == 0.5 and s["cells_per_line"] == 1.0 and 0.5 < s["prose_share"] <= 1
    assert text_stats(None) == text_stats("") == text_stats(" \n\t") == (0.0,) * len(STATS)


def test_body():
    assert body_of("\\documentclass{a}\n\\begin{document}\nText.") == "\nText."
    refs = "\\begin{thebibliography}{9}\n\\bibitem{a} X."
    assert body_of("It is the case that we are here.\nThis is the end of the text.\n" + refs).strip().endswith("text.")
    assert body_of(refs) == refs


def test_very_long_texts():
    for t in ("a" * 300_000, "$" * 100_001, "\\begin{align}" * 5000, "It is of the size that we have. " * 20_000):
        assert len(text_stats(t)) == len(STATS)


def test_boosting_learns_and_platt_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(3000) < 0.05)).astype(float)
    m = Boosted(trees=80, feature_share=1.0).fit(x[:2000], y[:2000])
    s = m.score(x[2000:])
    assert ((s > 0) == (y[2000:] > 0)).mean() > 0.88
    a, b = platt(s, y[2000:])
    p = 1 / (1 + np.exp(-(a * s + b)))
    assert abs(p.mean() - y[2000:].mean()) < 0.02
    a, b = platt(np.array([-5.0] * 10 + [6.0] * 10), np.array([0] * 10 + [1] * 10))  # separable
    assert 0 < a < 10 and abs(b) < 5


def test_prose_in_languages_without_word_lists():
    texts = [
        "Meting bleek moeilijk omdat sensoren steeds opnieuw uitvielen. Daarom herhaalden onderzoekers iedere proef meerdere keren. Uiteindelijk klopten resultaten redelijk goed met eerdere voorspellingen.",
        "Pomiary powtarzano wielokrotnie, ponieważ czujniki często zawodziły. Ostatecznie wyniki zgadzały się dobrze z wcześniejszymi przewidywaniami. Błędy pozostały niewielkie podczas całego doświadczenia.",
        "Мы повторили измерения несколько раз, потому что датчики часто выходили из строя. Результаты хорошо согласуются с прежними предсказаниями. Ошибка оставалась небольшой.",
        "我们重复了几次测量，因为传感器经常失效。结果与之前的预测非常吻合。误差在整个实验过程中都很小。",
    ]
    at = STATS.index("prose_share")
    assert all(text_stats(t)[at] > 0.7 for t in texts)
    assert all(text_stats(t)[at] < 0.3 for t in JUNK)


def sentences(rng, n):
    s = ["the", "a"]
    o = ["kernel", "surface", "ratio", "wave", "mesh"]
    return "\n".join(f"It is known that {rng.choice(s)} {rng.choice(o)} of the {rng.choice(o)} is not {i} times larger than we have in {rng.choice(o)}." for i in range(n))


def test_held_out_accuracy(frame):
    rng = random.Random(2)
    prose = [(i, sentences(rng, rng.randrange(3, 30)), "", "") for i in range(150)]
    junk = [(1000 + i, "\n".join(f"row{j} & {rng.random():.3f} & {rng.randrange(99)} \\\\" for j in range(rng.randrange(10, 40))), "", "") for i in range(80)]
    hand = [(5000 + i, t, "", "") for i, t in enumerate(PROSE)] + [(6000 + i, t, "", "") for i, t in enumerate(JUNK)]
    edge = [(7000, None, "", ""), (7001, "", "", ""), (7002, "%\n", "", "")]
    got = dict(rows(scored(frame(prose + junk + hand + edge, DOCS)), "doc_id", "not_prose"))
    for i, p in got.items():
        assert (p >= 0.5) == (1000 <= i < 5000 or i >= 6000), (i, p)


def test_tiny_and_empty_tables(frame):
    assert scored(frame([], DOCS)).count() == 0
    got = dict(rows(scored(frame([(1, PROSE[0], "", ""), (2, JUNK[0], "", ""), (2, JUNK[0], "", "")], DOCS)).dropDuplicates(), "doc_id", "not_prose"))
    assert got[1] < 0.5 <= got[2]


def none():
    return np.zeros((0, len(STATS))), np.zeros(0, dtype=np.int64)


def test_labelers_abstain_and_are_no_features():
    votes = lambda texts: [weak_vote(t, text_stats(t)) for t in texts]
    assert -1 not in votes(PROSE) and 1 not in votes(JUNK) and sum(votes(PROSE)) >= 0.7 * len(PROSE) and -sum(votes(JUNK)) >= 0.7 * len(JUNK)
    assert votes([None, "", " \n"]) == [0, 0, 0] and "prose_share" not in FEATURES


def test_model_beats_every_single_feature_on_the_holdout():
    ids, x, y = labelled("holdout.csv")
    assert len(set(ids)) == len(ids) >= 200 and not set(ids) & set(labelled("examples.csv")[0]) and x.shape[1] == len(STATS)
    r = ProseModel(*none()).report()  # as on an empty table
    assert r["errors"] <= 2 < r["errors_of_best_cut"] and r["calibration_error"] < 0.05 and r["squared_error"] < 0.02
