"""The pipeline's near-copy stage against brute force over whole shingle sets."""

import random

import pytest

import corpus_pipeline
from classtilt.llm import near_copies, surrogates
from tests.llm.test_operators import DOCS, ODD, normal

SF = "/root/testdata/sf0.001"


def brute_sets(text, width=5):
    words = [w.encode().lower() for w in normal(text).split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_kept(rows, percent=80):
    """Ids that stay of (id, text), ids being distinct."""
    sets, parent = [brute_sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return set(least.values())


@pytest.mark.parametrize("tile", [2048, 3])
def test_near_copies(spark, tile):
    draw, rows = random.Random(3), list(enumerate(ODD))
    for _ in range(6):
        words = [f"w{draw.randrange(400)}" for _ in range(60)]
        for changed in range(8):  # 1 change in the middle leaves 51 of 61 shingles, 2 leave 46 of 66
            copy = list(words)
            for at in draw.sample(range(60), changed % 4):
                copy[at] = f"n{draw.randrange(10**6)}"
            rows.append((len(rows), "  ".join(copy).upper() if changed == 5 else " ".join(copy)))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    kept = near_copies.drop_near_copies(docs, tile=tile, text_tile=tile)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(brute_kept(rows))


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (7, text), (7, text), (7, text + " end"), (None, "other"), (None, "other"), (9, None), (8, " ")]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 7), (False, 8), (True, 0)]
    assert near_copies.drop_near_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_stages_after_exact_copies(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
    assert len(kept[2]) < len(kept[1])  # 3 of 64 bits of 3-word SimHash dropped none of these
    assert {r.doc_id for r in kept[2]} == brute_kept([(r.doc_id, r.text) for r in kept[1]])
    old = {r.doc_id: r.text for r in kept[2]}
    assert {r.doc_id for r in kept[3]} == {r.doc_id for r in kept[4]} == set(old)
    for r in kept[3]:
        private = {e for _, _, _, e in surrogates.entities(old[r.doc_id])}
        assert not private & {e for _, _, _, e in surrogates.entities(r.text)}
        assert (r.text == old[r.doc_id]) == (not private)
