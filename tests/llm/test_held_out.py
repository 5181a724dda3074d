"""The quality classifier's folds, windows and thresholds against brute force and fresh text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from classtilt.llm import kneser_ney
from tests.llm.test_operators import brute_kneser_ney

WORDS = ["aba", "abba", "cada", "bra", "dab", "bad", "cab", "acda", "rabba", "daca"]


def sentences(rng, n, words):
    return [" ".join(rng.choice(words, int(rng.integers(6, 30)))) for _ in range(n)]


def test_folds_and_windows_by_hand(spark):
    """Scores of every text under the model of the other folds, the worst window, and thresholds, recomputed in Python."""

    rng = np.random.default_rng(1)
    texts = sentences(rng, 12, WORDS)
    texts += [texts[0], texts[0], "zz", "", "long " * 4000, None]
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1.0), (None, texts[2], "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity double")
    trusted = spark.createDataFrame([(i,) for i in range(9)] + [(2,), (None,)], "doc_id long")
    got = kneser_ney.quality_classifier(docs, trusted, 0.8, 3, 4, 3, 5).collect()
    folds = {r.text: r.fold for r in docs.select("text", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(3)).alias("fold")).collect()}
    seen = [(i, t, f) for i, t, *_ in rows if i is not None and i < 9 for f in [folds[t]]]
    models = {f: brute_kneser_ney([t.encode() for _, t, g in seen if g != f], 3) for f in range(3)}

    def scores(text):
        data, p = b"\xff\xff" + text.encode(), models[folds[text]]
        known = {}
        logs = [known.setdefault(g, np.log(p(g))) for k in range(len(data) - 2) for g in [data[k : k + 3]]]
        if not logs:
            return 1.0, 1.0
        wide = min(5, len(logs))
        worst = min(sum(logs[k : k + wide]) for k in range(len(logs) - wide + 1)) / wide
        return np.exp(-np.mean(logs)), np.exp(-worst)

    assert len(got) == len(rows) and len({folds[t] for _, t, _ in seen}) == 3
    want = {(i, len((t or "").encode())): scores(t or "") for i, t, *_ in rows}
    for r in got:
        assert (r.perplexity, r.window_perplexity) == pytest.approx(want[r.doc_id, r.n_bytes], rel=1e-9)
        assert r.kept == (r.perplexity <= r.threshold and r.window_perplexity <= r.window_threshold)
    for score, limit in (("perplexity", "threshold"), ("window_perplexity", "window_threshold")):
        known = sorted(r[score] for r in got if r.doc_id is not None and r.doc_id < 9)
        assert {r[limit] for r in got} == {known[int(np.ceil(0.9 * len(known))) - 1]}
    assert len({r.perplexity for r in got if r.doc_id in (0, 12, 13)}) == 1  # copies share a fold


def test_fresh_text_is_kept(spark):
    """Fresh documents of a frequent and of a rare language are rejected about as often as the quantile says; bad passages go."""

    rng = np.random.default_rng(5)
    rows = []
    for lang, known, letters in (("a", 400, "abcdef"), ("b", 60, "ghijkl")):
        words = ["".join(rng.choice(list(letters), int(rng.integers(2, 6)))) for _ in range(40)]
        fresh = sentences(rng, 300, words)
        spoilt = [t + " " + "".join(rng.choice(list("mnopqrstuvwxyz"), 40)) + " " + t for t in sentences(rng, 50, words)]
        rows += [(lang, kind, t) for kind, part in (("known", sentences(rng, known, words)), ("fresh", fresh), ("spoilt", spoilt)) for t in part]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, kind string, text string")
    judged = kneser_ney.quality_classifier(docs, docs.filter("kind = 'known'").select("doc_id"), 0.95).join(docs.select("doc_id", "kind"), "doc_id")
    kept = {(r.lang, r.kind): r.share for r in judged.groupBy("lang", "kind").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept["a", "fresh"] > 0.9 and kept["b", "fresh"] > 0.85
    assert kept["a", "spoilt"] < 0.1 and kept["b", "spoilt"] < 0.1
