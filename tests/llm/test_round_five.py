"""Work that one n-gram costs the quality classifier; the SimHash step of near copies."""

import random

import pytest
from pyspark.sql import functions as F

from classtilt.llm import kneser_ney, near_copies, simhash
from classtilt.llm.components import components

SF = "/root/testdata/sf0.001"


def shuffled_records(spark, run):
    """Records that all stages of ``run()`` have written to shuffles."""

    context = spark.sparkContext
    store, doubles = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0)

    def written():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, doubles, context._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    run()
    return sum(n for key, n in written().items() if key not in before)


def test_models_share_their_ngrams(spark):
    """An n-gram is dealt a few times, and not once for each fold's model and each order of n-grams."""

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - 3)), lambda i: F.substring("text", i, 4))
    distinct = docs.select("lang", F.explode(grams).alias("gram")).distinct().count()
    trusted = docs.filter("doc_id % 2 = 0").select("doc_id")
    assert shuffled_records(spark, lambda: kneser_ney.quality_classifier(docs, trusted).collect()) < 15 * distinct


@pytest.mark.parametrize("tile", [2048, 3])
def test_near_copies_by_simhash(spark, tile):
    """Fingerprints of five-word shingle sets link up to the radius, no pair is lost in buckets or tiles, and equal ones link."""

    draw, texts = random.Random(11), ["", "a", "a b c"]
    for _ in range(8):
        words = [f"w{draw.randrange(300)}" for _ in range(80)]
        for changed in range(6):
            copy = list(words)
            for at in draw.sample(range(80), changed):
                copy[at] = f"n{draw.randrange(10**6)}"
            texts.append(" ".join(copy))
    prints = [simhash.of_hashes(near_copies.shingles(t.encode(), 5)) for t in texts]
    prints += [prints[5], prints[5], prints[9] ^ 0b1111111, prints[9] ^ (0b1111111 << 40)]
    want = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= near_copies.RADIUS:
                    want[i] = want[j] = min(want[i], want[j])
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, fp long")
    got = {r.node: r.root for r in components(near_copies.print_links(nodes, tile)).collect()}
    assert [got.get(i, i) for i in range(len(prints))] == want and len(set(want)) < len(prints) - 8
