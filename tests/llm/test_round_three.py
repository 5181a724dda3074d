"""Fill-in-middle, collocations, posting lists and surrogates against brute force, and on awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from classtilt.llm import fill_in_middle, phrases, posting_lists, surrogates, wavelet
from tests.llm.test_operators import DOCS, ODD, odd  # noqa: F401


def test_wavelet_ranks():
    draw = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        codes = draw.integers(0, 5, n).astype(np.uint8)
        matrix, ends = wavelet.WaveletMatrix(codes), np.arange(n + 1)
        for code in range(5):
            assert matrix.rank(code, ends).tolist() == [int((codes[:e] == code).sum()) for e in ends]


@pytest.mark.parametrize("unit,pattern", [("line", r"[^\n]*\n|[^\n]+"), ("char", r"(?s:.)"), ("word", r"^\s*\S+\s*|\S+\s*")])
def test_units(unit, pattern):
    draw = random.Random(1)
    texts = ["".join(draw.choice("ab \n\té日😀.") for _ in range(draw.randrange(40))) for _ in range(500)] + ["", "\n", "a", "a\n"]
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(d) for d in data])
    starts = ends - [len(d) for d in data]
    units = wavelet.Units(np.frombuffer(b"".join(data), np.uint8), starts, ends, unit)
    split = [re.findall(pattern, t) for t in texts]
    assert units.n.tolist() == [len(s) for s in split]
    after = np.array([draw.randint(0, len(s)) for s in split])
    want = [len("".join(s[:k]).encode()) for s, k in zip(split, after, strict=True)]
    at = units.cut(after)
    assert (at - starts)[units.n > 0].tolist() == [w for w, s in zip(want, split, strict=True) if s]
    assert units.chars(starts, at).tolist() == [len(d[: a - s].decode()) for d, a, s in zip(data, at, starts, strict=True)]


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 1 << 22])
def test_fill_in_middle(odd, chunk):  # noqa: F811
    more = [(i, t, None, None, None) for i, t in enumerate(["<P> in it\nx", "a\n<\nP>", "x\n" * 9, "l1\nl2\r\nl3", "<S"], 1000)]
    docs = odd.select("doc_id", "text", "kept").unionByName(odd.sparkSession.createDataFrame(more, DOCS).select("doc_id", "text", F.lit("1").alias("kept")))
    got = fill_in_middle.fill_in_middle(docs, chunk=chunk).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    want = [(*brute_fim(r.doc_id, r.text), r.text or "") for r in docs.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0
    plain = fill_in_middle.fill_in_middle(docs, fim_percent=0)
    assert {r.form for r in plain.collect()} == {"plain"}


def brute_phrases(rows, least, share=80, top=2000):
    counts, totals = {}, {}
    for lang, text in rows:
        lang = lang or "und"
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] = totals.get(lang, 0) + len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    good = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    most = {}
    for (lang, words), n in good.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, words[i : i + k])
                most[part] = max(most.get(part, 0), n)
    out = []
    for (lang, words), a in good.items():
        if 100 * most.get((lang, words), 0) >= share * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    found, rank = [], {}
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] = rank.get(lang, 0) + 1
        if rank[lang] <= top:
            found.append((lang, rank[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return found


@pytest.mark.parametrize("budget", [100_000, 7])
@pytest.mark.parametrize("least,top", [(3, 2000), (1, 5)])
def test_collocations(spark, budget, least, top):
    draw = random.Random(5)
    words = ["the", "The", "of", "new york", "york", "é", "日本", "a.b", "x;y", "-", "\x1c", "u\u3000v", "ÀB", "(c)"]
    rows = [(i, " ".join(draw.choices(words, [9, 2, 6, 3, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1], k=draw.randrange(60))), draw.choice(["en", "de", None, "und"]), None, None) for i in range(120)]
    rows += [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(ODD)] + [(None, "of the of the of the of the", "xx", None, None)] * 4
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("w1", "n", "slot", "phrase", "rank")})
    got = phrases.collocations(docs, least=least, budget=budget, top=top)
    want = brute_phrases([(r[2], r[1]) for r in rows], least, top=top)
    assert [tuple(r) for r in got.orderBy("lang", "rank").collect()] == want and len(want) >= 15


def test_collocations_of_little(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, None), (2, "one", "en", None, None)], DOCS)).count() == 0


def test_groups_stay_under_the_budget():
    sizes = {i: (i * 37) % 50 + 1 for i in range(500)} | {1000: 90}
    groups, loads = phrases.pack(sizes, 60), {}
    for key, g in groups.items():
        loads.setdefault(g, []).append(sizes[key])
    assert set(groups) == set(sizes) and all(sum(x) <= 60 or x == [90] for x in loads.values())
    assert len(loads) < 1.3 * sum(sizes.values()) / 60


def brute_near(rows, asks, k=10):
    """(query, rank, id, score) over distinct (id, vector) rows of one length, all usable."""
    out = []
    for own, q in {(i, v) for i, v in rows if asks(i)}:
        found = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), i) for i, v in set(rows) if i != own)
        best, seen = [], set()
        for d, i in found:
            if i not in seen:
                best.append((own, len(best) + 1, i, d))
                seen.add(i)
        out += best[:k]
    return sorted(out)


def test_one_list_is_exact(spark):
    draw = random.Random(2)
    rows = [(i, tuple(draw.choice((0.0, 0.5, -1.0, 2.0)) for _ in range(3)) ) for i in range(400)]
    rows = [(i, v) for i, v in rows if any(v)]
    rows += [(1000 + i, (0.5, 0.5, 0.5)) for i in range(60)] + rows[:5]
    bad = [(None, (1.0, 2.0, 3.0)), (2000, None), (2100, (0.0, 0.0, 0.0)), (2200, (1.0, float("nan"), 0.0)), (2300, (float("inf"), 1.0, 0.0)), (2400, (1.0, None, 2.0)), (2500, (1.0, 2.0))]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("v", "ids", "list", "score")})
    got = posting_lists.ann_search(df, F.col("vec_id") % 100 == 0, list_rows=10_000)
    shown = sorted(tuple(r) for r in got.collect())
    want = brute_near(rows, lambda i: i % 100 == 0)
    assert [r[:3] for r in shown] == [r[:3] for r in want] and np.allclose([r[3] for r in shown], [r[3] for r in want], rtol=0, atol=1e-12)


def test_recall(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 32))
    points = np.concatenate([centres[draw.integers(0, 40, 3000)] + 0.3 * draw.normal(size=(3000, 32)), draw.normal(size=(1000, 32))])
    rows = [(i, p) for i, p in enumerate(points.astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = posting_lists.ann_search(df, F.col("vec_id") % 100 == 0, list_rows=64).collect()
    want = brute_near([(i, tuple(p)) for i, p in rows], lambda i: i % 100 == 0)
    hits = {(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in want}
    assert len(got) == len(want) == 400 and len(hits) >= 0.9 * len(want)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<double>")
    asks = F.col("vec_id") % 100 == 0
    assert [tuple(r) for r in posting_lists.ann_search(df, asks).collect()] == [(0, 1, 7, 2**0.5)]
    assert posting_lists.ann_search(df.limit(0), asks).count() == posting_lists.ann_search(df.limit(1), asks).count() == 0


def test_parts_are_balanced_and_the_graph_finds():
    points = np.random.default_rng(4).normal(size=(1000, 8))
    parts = posting_lists.balanced_parts(points, 16)
    assert sorted(np.concatenate(parts).tolist()) == list(range(1000)) and {len(p) for p in parts} <= {62, 63}
    graph = posting_lists.CentroidGraph(np.stack([points[p].mean(axis=0) for p in parts]))
    row, found, _ = graph.near(points[:200], 1.0)
    exact = posting_lists.distances(points[:200], graph.centroids).argmin(axis=1)
    assert (found[np.unique(row, return_index=True)[1]] == exact).mean() >= 0.95


def replaced(texts, key=b"k"):
    spans = [surrogates.entities(t) for t in texts]
    held = {x for s in spans for _, _, k, e in s for x in surrogates.canonical(k, e)}
    known = {f"{k}\t{e}": surrogates.surrogate(key, k, e, g) for k, e, g in sorted(held)}
    return [[surrogates.rendered(k, e, known) for _, _, k, e in s] for s in spans]


def test_surrogates_keep_no_secret():
    for secret in ("סודסוד", "!!**!!", "ẾỆẬẴ", "秘密の鍵", "aB3$xx"):
        for attempt in range(10):
            new = surrogates.surrogate(b"k", "password", secret, attempt=attempt)
            assert secret not in new and len(new) >= len(secret) and new.isascii()
    long = "0a" * 100
    assert surrogates.entities(f"key {long} end")[0][3] == long


def test_surrogates_keep_script_and_validity():
    [(hebrew, latin)] = replaced(["Herr יוסף כהן, Frau Ệp Ẩn"])
    assert all("HEBREW" in surrogates.unicodedata.name(c) for c in hebrew if c != " ") and latin.isascii()
    [(account,)] = replaced(["IBAN DE89 3704 0044 0532 0130 00."])
    assert surrogates._mod97(account.replace(" ", "")) == 1 and account.startswith("DE") and account != "DE89 3704 0044 0532 0130 00"


def test_surrogates_corefer():
    [names, mails, phones] = replaced(
        ["Mr John Smith, Mr Smith, Dr John Smith and John Smith", "Anna.Schmidt@x.org anna.schmidt@x.org", "+49 30 1234567 or +49301234567"]
    )
    assert names[0] == names[2] == names[3] and names[0].split(" ")[1] == names[1]
    assert mails[0] == mails[1]
    assert phones[0].replace(" ", "") == phones[1] and phones[0].startswith("+49 ")


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        surrogates.replace_entities(spark.createDataFrame([], DOCS), "")
