import random

import numpy as np
import pytest
from oracle import connect, same

from tessera.llm import spans as S


def brute(docs):
    grams = {}
    for d, t in docs:
        if d is not None and t:
            for i in range(len(t) - S.SPAN + 1):
                grams.setdefault(t[i : i + S.SPAN], set()).add(d)
    pairs, covered = set(), {}
    for d, t in docs:
        if d is None:
            continue
        mark = [False] * len(t or "")
        for i in range(len(mark) - S.SPAN + 1):
            if len(grams[t[i : i + S.SPAN]]) > 1:
                for k in range(i, i + S.SPAN):
                    mark[k] = True
        covered[d] = sum(mark)
    for ds in grams.values():
        ds = sorted(ds)
        pairs |= {(a, b) for i, a in enumerate(ds) for b in ds[i + 1 :]}
    return pairs, covered


def run(spark, docs):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, anchor int, doc string")
    spans = S.SharedSpans(df, "doc_id", "text")
    pairs = {(r["doc_lo"], r["doc_hi"]) for r in spans.pairs().collect()}
    return pairs, {r["doc"]: r["shared_chars"] for r in S.shared_amount(df, spans=spans).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefgh ijklmnop中文字é😀") for _ in range(n))
    passages = [noise(rng.choice([150, 199, 200, 201, 260, 700])) for _ in range(8)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts.append(noise(rng.randrange(0, 150)))
            p = rng.choice(passages)
            a = rng.randrange(0, 60) if rng.random() < 0.5 else 0
            parts.append(p[a : len(p) - (rng.randrange(0, 60) if rng.random() < 0.5 else 0)])
        docs.append((d * 3 + 1, "".join(parts)))
    docs += [(1000, docs[0][1]), (1001, docs[0][1]), (2000, passages[5] * 2), (2001, "ab" * 300), (2002, "x" + "ab" * 200), (2003, "z" * 250), (2004, "z" * 199), (2005, "y" + "z" * 220)]
    rng.shuffle(docs)
    assert run(spark, docs) == brute(docs)


def test_same_deviation_from_the_reference(spark):
    """Two documents share with each other what their reference lacks."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    core, tail = noise(130), noise(120)
    docs = [(1, noise(50) + core + noise(300)), (2, noise(60) + core + tail + noise(40)), (3, noise(10) + core + tail + noise(70)), (4, noise(90) + core + noise(90))]
    got = run(spark, docs)
    assert got == brute(docs) and (2, 3) in got[0]


def test_boilerplate_of_many_documents(spark, monkeypatch):
    """A passage in every document, cut differently in some: classes hold the pairs, and what is dealt is whole."""
    monkeypatch.setattr(S, "MOST_PIECES", 7)
    monkeypatch.setattr("tessera.runtime.HOT_ROWS", 5)
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = noise(420)
    docs = [(i, noise(30) + passage + noise(30)) for i in range(40)] + [(100 + i, noise(20) + passage[i * 30 :][: 230 + 10 * i] + noise(25)) for i in range(6)] + [(200, noise(20) + passage[:210]), (201, noise(20) + passage[205:])]
    pairs, covered = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {}
    spans = S.SharedSpans(df, "doc_id", "text")
    rows = S.shared_classes(df, spans=spans).collect()
    assert {(r["doc_lo"], r["doc_hi"]) for r in spans.pairs().collect()} == pairs
    assert {r["doc"]: r["shared_chars"] for r in S.shared_amount(df, spans=spans).collect()} == covered
    for r in spans.classes().collect():
        sets.setdefault(r["class"], set()).add(r["doc"])
    assert {(a, b) for own in sets.values() for a in own for b in own if a < b} == pairs
    assert sorted((min(own), d, len(own) - 1) for own in sets.values() for d in own) == sorted((r["class"], r["doc"], r["links"]) for r in rows)
    left = {r["doc"]: r["text"] for r in S.without_shared(df, spans=spans).collect()}
    assert all(len(left[d]) == len(t) - covered[d] for d, t in docs)


def test_queries_equal_their_sql(spark, small):
    duck = connect(small)
    for name, sql in S.SQL.items():
        same(getattr(S, name)(spark, small), duck, sql)


def test_edges(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(60_000))
    docs = [(1, None), (None, long), (2, ""), (3, "short"), (4, long), (5, "q" * 30 + long[100:50_000]), (3, "short"), (6, "r" * 199)]
    pairs, covered = run(spark, docs)
    assert pairs == {(4, 5)} and covered[5] == 49_900 and covered[4] == 49_900 and covered[1] == covered[2] == covered[3] == covered[6] == 0
    assert run(spark, []) == (set(), {})
    assert run(spark, [(7, long[:300]), (7, long[:300])])[0] == set()  # one document twice


def test_automaton():
    rng = random.Random(3)
    reference = ["".join(rng.choice("ab") for _ in range(60)), "".join(rng.choice("abc") for _ in range(40))]
    text = "".join(rng.choice("abc") for _ in range(80))
    got = S.SuffixAutomaton(reference).matching_statistics(text)
    for end, n in enumerate(got):
        assert n == max(k for k in range(end + 2) if any(text[end + 1 - k : end + 1] in r for r in reference))


def test_every_window_holds_an_anchor(monkeypatch):
    monkeypatch.setattr(S, "_CHUNK", 1000)  # long texts go in pieces
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd") for _ in range(n)) for n in (0, 199, 200, 999, 5000)]
    hasher = S.Hasher()
    text, place, h = S.anchors_of(hasher, texts)
    for k, t in enumerate(texts):
        at = set(place[text == k].tolist())
        for i in range(len(t) - S.SPAN + 1):
            assert at & set(range(i, i + S.SPAN - S.ANCHOR + 1))
    again = S.anchors_of(hasher, [texts[4][1234:]])
    inner = {int(x) for x, p in zip(again[2], again[1])}
    assert inner <= {int(x) for x in h[text == 4]} and np.all(np.diff(again[1]) > 0)
