"""Alignment, hard negatives and MinHash against brute force."""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from nasty import DOCUMENTS_DDL, LONG, documents, nasty, nasty_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stridelog.llm import alignment, minhash, negatives
from stridelog.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.01"

# alignment -------------------------------------------------------------------------------------


def brute_alignment(rows):
    """Whole texts encoded in one piece, every token pair compared by its bytes."""
    a = Tokenizer.from_file(alignment.BYTE_TOKENIZER)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_TOKENIZER)
    letters = alignment._byte_letters()
    out, holds = [], Counter()

    def ends(parts):
        at, found = 0, []
        for p in parts:
            found.append((at, at + len(p)))
            at += len(p)
        return found

    for doc_id, text in rows:
        links, groups, ids_a, ids_b = [], [], [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            pieces = [b.id_to_piece(i) for i in ids_b]
            bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) and b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                spans_a, spans_b = ends(bytes_a), ends(bytes_b)
                cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
                parts = [([], []) for _ in cuts]
                for side, (ids, spans) in enumerate(((ids_a, spans_a), (ids_b, spans_b))):
                    for i, span in zip(ids, spans, strict=True):
                        parts[bisect.bisect_right(cuts, span[0])][side].append((i, span))
                for part_a, part_b in parts:
                    groups.append(",".join(str(i) for i, _ in part_a) + "|" + ",".join(str(i) for i, _ in part_b))
                    links += [(i, j) for i, s in part_a for j, t in part_b if s[0] < t[1] and t[0] < s[1]]
            else:
                ids_a, ids_b = [], []
        holds.update(set(links))
        out.append((doc_id, ids_a, ids_b, groups, links))
    highest = defaultdict(int)
    for (i, _), n in holds.items():
        highest[i] = max(highest[i], n)
    report = [
        (d, len(x), len(y), len(g), len(li), sum(holds[p] == highest[p[0]] for p in li), sum(holds[p] for p in li), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, x, y, g, li in out
    ]
    times = Counter(p for *_, li in out for p in li)
    return report, {p: (n, times[p], n == highest[p[0]]) for p, n in holds.items()}


HARD = [
    (1, None), (2, ""), (3, " "), (4, "a "), (5, "a  "), (6, "  two  blanks \n lines\n\n end\n"), (7, "<|endoftext|> <s> </s> <unk> <0x41>"), (8, "a▁b"), (9, " x　 y\t z"),
    (10, "😀 été ｆｕｌｌ é 中文没有空格 \x00\x1c z"), (11, "same"), (11, "same"), (None, "same words"), (12, LONG), (13, "x" * 3000), (14, "\n"), (15, "don't 12345 'll  's"),
]


def test_alignment_of_hard_texts(spark):
    docs = spark.createDataFrame([(i, t, "p", "q") for i, t in HARD], "doc_id bigint, text string, pair string, block string")
    report, pairs = alignment.aligned(docs.repartition(3))
    want, want_pairs = brute_alignment(HARD)
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, report.collect()), key=key) == sorted(want, key=key)
    assert {(r.a, r.b): (r.n_documents, r.n_links, r.best) for r in pairs.collect()} == want_pairs


def test_alignment_of_documents(spark):
    docs = documents(spark, MIDDLE)
    want, _ = brute_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = [tuple(r) for r in QUERIES["op11_pair_bitmaps"](spark, MIDDLE).collect()]
    assert sorted(got) == sorted(want)


def test_alignment_many_blocks(spark, monkeypatch):
    docs = documents(spark).limit(60).cache()
    monkeypatch.setattr(alignment, "sized", lambda narrow: narrow)  # as with very many pairs
    docs = docs.repartition(5)
    want, _ = brute_alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, alignment.alignment_report(docs).collect())) == sorted(want)


def test_alignment_bad_bytes_and_empty(spark):
    bad = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61ff62') AS STRING) AS text UNION ALL SELECT 2L, 'fine'")
    found = {r.doc_id: r for r in alignment.alignment_report(bad).collect()}
    assert found[1].n_a == 0 and found[1].groups_sha256 == "" and found[2].n_a == 1
    assert alignment.alignment_report(spark.createDataFrame([], DOCUMENTS_DDL)).count() == 0
    assert alignment.alignment_report(nasty(spark)).count() == len(nasty_rows())


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    pairs, docs = [], []
    for pair, share in ((3, 0.9), (4, 0.001), (9, 0.3), (10, 0.0)):
        own = np.unique(np.append(np.flatnonzero(rng.random(60000) < share), 59999 if pair == 10 else 5))
        pairs.append(np.full(len(own), pair))
        docs.append(own)
    names, counts, plain, data = alignment.bitmaps(np.concatenate(pairs), np.concatenate(docs))
    assert names.tolist() == [3, 4, 9, 10] and plain.tolist() == [True, False, True, False]
    assert (alignment.places(plain, counts, data) == np.concatenate(docs)).all()
    assert (alignment.places(plain[1:3], counts[1:3], data.slice(1, 2)) == np.concatenate(docs[1:3])).all()


# hard negatives --------------------------------------------------------------------------------


def brute_negatives(rows, step=50, positives=5, negatives_=3):
    """rows: (id, label, vector), all of them valid."""
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    anchors = {}
    for i, label, v in rows:
        if i % step == 0 and (i not in anchors or (label, v) < anchors[i]):
            anchors[i] = (label, v)
    out = []
    for i, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for j, other, w in rows if len(w) == len(v))
        near = [(j, -s) for s, j, other in scored if other == label and j != i][:positives]
        for j, p in near:
            hard = [(k, -s) for s, k, other in scored if other != label and 50 * p <= -100 * s <= 95 * p][:negatives_]
            out += [(i, j, rank, k, p, n) for rank, (k, n) in enumerate(hard, 1)]
    return sorted(out)


def test_negatives_of_embeddings(spark):
    rows = spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()
    valid = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows if r.label is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    want = brute_negatives(valid)
    assert want and sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, MIDDLE).collect())) == want


@pytest.mark.parametrize("held", [7, 4096])
def test_negatives_of_hard_rows(spark, monkeypatch, held):
    monkeypatch.setattr(negatives, "HELD", held)
    rng = random.Random(3)
    few = [[0.0, 0.0, 0.0], [1.0, 0.5, -0.25], [0.9, 0.5, 0.0], [2.0, 1.0, 1.0], [1e30, 1.0, 0.0]]
    valid = [(rng.randrange(0, 120), rng.randrange(0, 3), rng.choice(few) if rng.random() < 0.7 else [rng.uniform(-1, 1) for _ in range(3)]) for _ in range(150)]
    valid = [r for r in valid if max(r[2]) < 1e9]
    valid += [(k, 1, [0.5, 0.5]) for k in (50, 51, 52)] + [(53, 2, [0.4, 0.5]), (-50, 1, [1.0, 1.0]), (-7, 0, [0.9, 0.9])]
    ddl = "vec_id bigint, embedding array<float>, label int, unit string, role string"
    bad = [(50, None, 1, "", ""), (100, [1.0, None, 0.0], 1, "", ""), (150, [float("nan"), 1.0, 1.0], 1, "", ""), (151, [float("inf"), 1.0, 1.0], 1, "", ""), (152, [1.0, 1.0, 1.0], None, "", ""), (None, [1.0, 1.0, 1.0], 1, "", "")]
    table = spark.createDataFrame([(i, [float(x) for x in v], label, "", "") for i, label, v in valid] + bad, ddl).repartition(3)
    got = sorted(map(tuple, negatives.hard_negatives(table, F.col("vec_id") % 10 == 0).collect()))
    assert got == brute_negatives(valid, 10)
    assert negatives.hard_negatives(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_products_are_exact():
    a = np.floor(np.array([[3.0, -2.0], [2.0**40 + 1, 1.0], [1e300, 1.0]]))
    b = np.array([[5.0, 7.0], [2.0**21 + 1, 3.0]])
    got = negatives.products(a, b)
    assert got.tolist() == [[1, 3 * (2**21 + 1) - 6], [5 * (2**40 + 1) + 7, (2**40 + 1) * (2**21 + 1) + 3], [negatives.TOP, negatives.TOP]]


def test_keys_sort_like_numbers():
    rng = random.Random(1)
    rows = [(rng.choice([-5, 0, 9]), rng.choice([-(2**62), -1, 0, 1, 2**62]), rng.random() < 0.5, rng.choice([-3, 0, 8])) for _ in range(200)]
    keys = sorted(negatives.packed(*r) for r in rows)
    assert [negatives.unpacked(k) for k in keys] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))


# MinHash ---------------------------------------------------------------------------------------


def brute_classes(rows, n=3, percent=85):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())

    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    able = [i for i, s in enumerate(sets) if s and rows[i][0] is not None]
    holders = defaultdict(list)
    for i in able:
        for s in sets[i]:
            holders[s].append(i)
    for i in able:
        for j, common in Counter(j for s in sets[i] for j in holders[s] if j < i).items():
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                part[root(i)] = root(j)
        for j in able:
            if rows[j][0] == rows[i][0]:
                part[root(i)] = root(j)
    least = {}
    for i in able:
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = least[root(i)] if i in set(able) else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id is None or component == doc_id))
    return sorted(out, key=lambda r: (r[0] is None, r))


def told(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in frame.collect()), key=lambda r: (r[0] is None, r))


def test_minhash_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, MIDDLE).select("doc_id", "text").collect()]
    assert told(QUERIES["op13_minhash_stars"](spark, MIDDLE)) == brute_classes(rows)


def group_of_copies(size, seed=4):
    """Edited copies of one text, many pairs around the threshold, and of copies of copies."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    rows = []
    for i in range(size):
        words = list(base if i < size // 2 or not rows else rows[rng.randrange(len(rows))][1].split())
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("piece", [5, 512])
def test_minhash_rest_of_stars(spark, monkeypatch, piece):
    """A large group of near copies, where stars alone miss links."""
    monkeypatch.setattr(minhash, "PIECE", piece)
    monkeypatch.setattr(minhash, "STREAM", 30)
    rows = group_of_copies(150)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert told(minhash.minhash_classes(docs, n=3, percent=85)) == brute_classes(rows)


def test_minhash_of_hard_rows(spark):
    rows = [(i, t) for i, t, *_ in nasty_rows()] + [(20, LONG + "end"), (21, "same TEXT twice"), (None, "same text twice")]
    ddl = "doc_id bigint, text string, node string, mark string, size string, part string"
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], ddl)
    assert told(minhash.minhash_classes(docs, n=3, percent=85)) == brute_classes(rows)
    kept = minhash.without_near_copies(docs, n=3, percent=85)
    assert kept.columns == docs.columns
    want = Counter((i, t) for (i, t), r in zip(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), brute_classes(rows), strict=True) if r[3])
    assert sum(want.values()) == kept.count()
    empty = spark.createDataFrame([], DOCUMENTS_DDL)
    assert minhash.minhash_classes(empty).count() == minhash.without_near_copies(empty).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_recall_at_the_threshold(percent):
    """Pairs at the threshold, of any size, share a band."""
    rng = np.random.default_rng(7)
    missed = 0
    for size in (7, 9, 20, 60, 300):
        apart = size * (100 - percent) // 100
        for _ in range(1000):
            union = rng.integers(0, 2**63, size).astype(np.uint64)
            cut = int(rng.integers(0, apart + 1))
            a, b = union[: size - cut], union[apart - cut :]
            missed += not (minhash.bands(a, percent) == minhash.bands(b, percent)).any()
    assert missed <= 1
