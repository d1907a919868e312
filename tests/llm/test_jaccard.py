"""The n-gram Jaccard join against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from nasty import DOCUMENTS_DDL, documents, nasty

from stridelog.llm import jaccard
from stridelog.llm.components import components
from stridelog.llm.trie import linked_groups


def joined(n, links):
    label = list(range(n))
    for a, b in links:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    return label


def brute(rows, n, percent):
    """(doc_id, set size, component) of rows (doc_id, text)."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    links = [
        (i, j)
        for i, j in combinations(range(len(rows)), 2)
        if rows[i][0] is not None and rows[j][0] is not None
        and ((sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])) or (sets[i] and sets[j] and rows[i][0] == rows[j][0]))
    ]
    label = joined(len(rows), links)
    least = {}
    for (doc_id, _), g in zip(rows, label, strict=True):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    return sorted((str(i), len(s), str(least.get(g) if i is not None else None)) for (i, _), s, g in zip(rows, sets, label, strict=True))


def rows_of(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def edited_documents():
    """Groups of near copies around the limit, a passage that all share, and a large group."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(60)]
    rows = []
    for group in range(30):
        text = [rnd.choice(words) for _ in range(rnd.choice((2, 3, 9, 20, 60, 200)))]
        for _ in range(rnd.choice((1, 2, 5))):
            copy = list(text)
            for _ in range(rnd.choice((0, 1, 2, 3, 6))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append(copy + passage * (group % 3 == 0))
    chain = [rnd.choice(words) for _ in range(150)]
    for _ in range(40):
        chain = list(chain)
        chain[rnd.randrange(len(chain))] = rnd.choice(words)
        rows.append(chain)
    rnd.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 60)])
@pytest.mark.parametrize("chunk", [512, 3])
def test_join_against_brute_force(spark, monkeypatch, n, percent, chunk):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", chunk)
    rows = edited_documents()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).cache()
    assert rows_of(jaccard.jaccard_classes(df, n, percent)) == brute(rows, n, percent)


def test_join_of_documents_and_hard_rows(spark):
    for docs in (documents(spark), nasty(spark)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert rows_of(jaccard.jaccard_classes(docs, 3, 90)) == brute(rows, 3, 90)
    assert jaccard.jaccard_classes(spark.createDataFrame([], DOCUMENTS_DDL)).count() == 0


def test_one_of_each(spark):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (1, "A b c d e f g"), (2, "h i j k l m"), (None, "a b c d e f g"), (4, None), (5, ""), (6, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS node", "2 AS id")
    assert sorted(str(r.doc_id) for r in jaccard.one_of_each(df).collect()) == ["1", "2", "4", "5", "6", "None"]


def test_one_of_each_tells_rows_by_text(spark):
    """A third of all rows under one doc_id: only near copies go, the other texts of the id stay."""
    rnd = random.Random(9)
    base = [[f"t{i}w{rnd.randrange(1000)}" for _ in range(60)] for i in range(12)]
    near = [[*b[:59], "changed"] for b in base]
    rows = [(i, " ".join(b), "x") for i, b in enumerate(base)] + [(99, " ".join(b), "x") for b in near[:6]]
    clean = [(99, " ".join(f"c{i}w{k}" for k in range(40)), "x") for i in range(5)]
    close = [(98, " ".join([*(f"d{k}" for k in range(59)), end]), "x") for end in ("one", "two", "three")]
    repeated = [(97, "only this one text here", s) for s in "cab"]
    rows += clean + close + repeated
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = [sorted(map(tuple, jaccard.one_of_each(d).collect())) for d in (docs, docs.repartition(2))]
    assert got[0] == got[1]
    left = [r for r in got[0] if r[0] == 98]
    assert len(left) == 1 and left[0] in close
    assert [r for r in got[0] if r[0] != 98] == sorted([*rows[:12], *clean, (97, "only this one text here", "a")])


def test_trie_against_all_pairs():
    random_ = np.random.default_rng(3)
    for percent in (50, 80, 90):
        base = [np.sort(random_.choice(500, size, replace=False)) for size in (1, 5, 12, 40, 90)]
        sets = [np.zeros(0, np.int64)]
        for b in base:
            for _ in range(12):
                drop = random_.random(len(b)) > random_.choice([0, 0.05, 0.1, 0.2])
                sets.append(np.unique(np.concatenate([b[drop], random_.integers(0, 500, random_.integers(0, 4))])))
        plain = [set(s.tolist()) for s in sets]
        links = [(i, j) for i, j in combinations(range(len(sets)), 2) if plain[i] and plain[j] and 100 * len(plain[i] & plain[j]) >= percent * len(plain[i] | plain[j])]
        got = linked_groups(sets, percent).tolist()
        want = joined(len(sets), links)
        assert [got.index(g) for g in got] == [want.index(g) for g in want]


def test_signatures_lose_no_pair():
    """Any two linked sets agree on a signature, also where segments are empty."""
    random_ = np.random.default_rng(4)
    for percent in (60, 80, 90):
        for _ in range(300):
            size = int(random_.integers(2, 120))
            a = np.unique(random_.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            most = jaccard.apart(2 * len(a), percent)
            gone = int(random_.integers(0, most + 1))
            b = np.unique(np.concatenate([a[gone // 2 :], random_.integers(0, 1 << 63, gone - gone // 2).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and len(a) != both:
                (left, need_a), (right, need_b) = jaccard.signatures(a, percent), jaccard.signatures(b, percent)
                common = np.intersect1d(left, right) & np.uint64(1)
                sides = [int((common == side).sum()) for side in (0, 1)]
                # Both sets pass on the level of the smaller one.
                assert any(c and need_a[k] and need_b[k] and c >= max(need_a[k], need_b[k]) for k, c in enumerate(sides))


def test_signatures_of_sizes_that_differ_by_the_full_ratio(spark):
    """One set inside the other, as large as a link allows, at every size."""
    random_ = np.random.default_rng(8)
    for percent in (34, 50, 60, 66, 67, 80, 90):
        for size in range(1, 160):
            b = np.unique(random_.integers(0, 1 << 63, size * 100 // percent).astype(np.uint64))
            a = b[np.sort(random_.permutation(len(b))[:size])]
            if len(a) < len(b):
                (left, need_a), (right, need_b) = jaccard.signatures(a, percent), jaccard.signatures(b, percent)
                common = np.intersect1d(left, right) & np.uint64(1)
                sides = [int((common == side).sum()) for side in (0, 1)]
                assert any(c and need_a[k] and need_b[k] and c >= max(need_a[k], need_b[k]) for k, c in enumerate(sides)), (percent, size)
    rows = []
    for i, (small, large) in enumerate([(11, 18), (3, 5), (30, 50), (60, 100), (7, 11)]):
        words = [f"g{i}w{k}" for k in range(large + 1)]
        rows += [(2 * i, " ".join(words[: small + 1])), (2 * i + 1, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(jaccard.jaccard_classes(docs, 2, 60)) == brute(rows, 2, 60)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(7, 3), (9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 3 for i in (3, 7, *range(200, 300))}}
