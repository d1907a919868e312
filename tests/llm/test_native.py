"""Chat windows, license scan, secret scan and mixing against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from nasty import DOCUMENTS_DDL, documents, nasty, nasty_rows

from stridelog.llm import chat, licenses, mixing, secrets
from stridelog.llm.queries import QUERIES

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(params=["nasty", "documents"])
def docs(request, spark):
    return {"nasty": nasty, "documents": documents}[request.param](spark)


def both(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.collect()]


# chat ------------------------------------------------------------------------------------------

TURNS = [
    (1, 0, "system", "be kind # always"), *((1, t, ("user", "assistant")[t % 2 == 0], f"turn {t} " + "w " * (t * 7 % 90)) for t in range(1, 300)),
    (2, 1, "assistant", "</turn>\n### assistant: \\b\\l\\h"), (2, 0, "user", "\\"), (2, 5, "assistant", "x" * 9),
    (None, 1, "user", "no conversation"), (3, None, None, None), (3, None, "assistant", "ties"), (3, None, "assistant", "ties"),
    (4, 0, "user: ", ": < #\\c"), (4, 1, "system", "late"), (5, 0, "system", ""), (5, 1, "assistant", "w " * 5000), (5, 2, "assistant", "end"),
]


def expected_chat(rows):
    told = defaultdict(list)
    for conv, turn, role, text in rows:
        told[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in told.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        learn = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha(said), len(learn), sha(learn))
    return out


def test_chat_reads_back_whole(spark):
    df = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS window", "1 AS tokens")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_report(df).collect()}
    assert got == expected_chat(TURNS)


def test_chat_windows_keep_budget_and_history(spark):
    df = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")
    for w in chat.chat_windows(df, budget=256, history=64).where("conv_id = 1").collect():
        words = len(WORD.findall(w.text)) + w.text.count(chat.CLOSE)
        assert words <= 256 and w.n_repeated <= 5
        assert w.text.startswith("### system: be kind \\h always</turn>\n")
        assert (w.n_repeated > 0) == (w.window > 0)


def test_chat_query_has_the_hard_conversation(spark):
    rows = {r.conv_id: r for r in QUERIES["op1_chat_windows"](spark, "/root/testdata/sf0.001").collect()}
    text = r"\### Assistant: </turn> ok"
    assert (rows[-7].turns_sha256, rows[-7].loss_sha256) == (sha(f"user\n{text}\nassistant\n{text}\n"), sha(text))
    told = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected_chat(told)
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in rows.items() if k != -7} == want


def test_chat_of_nothing(spark):
    assert chat.chat_report(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# licenses --------------------------------------------------------------------------------------

PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def expected_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(A_Z))
    places = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def test_license_base(docs):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_report(docs).collect())
    assert got == Counter((i, *expected_license(t)) for i, t, _ in both(docs))


def test_license_with_changed_words(spark):
    text = "x y Licensed under the Apache License Version 2.0 (the License) you may not use. Permission is hereby freely granted, free of charge, to any one obtaining a copy of this software and its associated documentation files"
    df = spark.createDataFrame([(1, text), (2, "licensed under some other license")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in licenses.license_report(df).collect()}
    assert rows[1].labels == "apache,apache-2.0,mit-grant" and rows[1].score == 1.0
    assert rows[2].labels == "" and rows[2].score == 0.0


def in_order(words, template, start, reach=8):
    """The longest common sequence, by the plain table, of words that stand beside the same word."""

    def same(i, j):
        if not start <= i - j <= start + reach or not 0 <= i < len(words) or words[i] != template[j]:
            return False
        before = i > 0 and j > 0 and words[i - 1] == template[j - 1]
        return before or (i + 1 < len(words) and j + 1 < len(template) and words[i + 1] == template[j + 1])

    best = [0] * (len(template) + 1)
    for i in range(start, start + len(template) + reach + 1):
        new = best[:]
        for j in range(len(template)):
            new[j + 1] = max(best[j + 1], new[j], best[j] + 1 if same(i, j) else 0)
        best = new
    return best[-1]


def expected_notices(text, reach=8, least=0.7):
    """Labels of the notices, by trying every place of the text."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(A_Z))
    out = {}
    for notice in licenses.NOTICES:
        t = notice.words.split()
        pairs = defaultdict(set)
        for i, pair in enumerate(zip(words, words[1:])):
            for j in range(len(t) - 1):
                if pair == (t[j], t[j + 1]):
                    pairs[i - j].add(j)
        for d in pairs:
            if len(set().union(*(pairs.get(d + k, ()) for k in range(reach + 1)))) >= least * (len(t) - 1):
                cover = in_order(words, t, d, reach) / len(t)
                if cover >= least:
                    out[notice.label] = max(out.get(notice.label, 0), cover)
    return out


def test_license_spans_are_in_order(spark):
    """Every edit of a notice against the plain search: words moved, put in, left out, backwards, repeated."""
    random, texts = __import__("random").Random(5), []
    for notice in licenses.NOTICES:
        words = notice.words.split()
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
        texts += [" ".join(reversed(pairs)), " x y ".join(pairs), " x y z ".join(words), notice.words, f"{notice.words} {notice.words}"]
        texts += [f"{' '.join(words[k:])} {' '.join(words[:k])}" for k in range(1, len(words), 3)]
        for _ in range(30):
            edited = words[:]
            for _ in range(random.randint(1, 6)):
                at = random.randrange(len(edited))
                edited[at : at + random.randint(0, 1)] = random.choice([[], ["new"], ["new", "words", "here"], [random.choice(words)]])
            texts.append("a b " * random.randint(0, 3) + " ".join(edited))
    texts.append(" ".join(random.choice(licenses.NOTICES[3].words.split()) for _ in range(20_000)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: {s.label: s.cover for s in reversed(sorted(r.spans, key=lambda s: -s.cover)) if not s.exact} for r in licenses.license_spans(df).collect()}
    assert {i: pytest.approx(expected_notices(t)) for i, t in enumerate(texts)} == rows
    by_nc = [i for i, t in enumerate(texts) if t.startswith("4 0 nc 4 by nc") or "under x y under cc" in t]
    assert len(by_nc) == 2 and not any("cc-by-nc-4.0" in rows[i] for i in by_nc)


def test_license_templates_fit_a_long(spark):
    with pytest.raises(ValueError):
        licenses.license_spans(nasty(spark), (licenses.Template("long", "w " * 63),))


# secrets ---------------------------------------------------------------------------------------


def expected_secrets(text):
    found = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = Counter(f[2] for f in found)
    return (kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_secret_base(spark, folder):
    docs = documents(spark, f"/root/testdata/{folder}")
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.secret_report(docs).collect())
    assert got == Counter((i, *expected_secrets(t)) for i, t, _ in both(docs))


def test_secret_nasty_and_ownership(spark):
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.secret_report(nasty(spark)).collect())
    assert got == Counter((r[0], *expected_secrets(r[1] or "")) for r in nasty_rows())
    rows = [(i, "password=abcdefgh1 x", f"s{i % 4}") for i in range(8)] + [(8, "password=only-mine", "s1"), (9, "password=only-mine", "s1"), (9, "password=only-mine", "s1"), (10, "clean", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    live = {r.doc_id: (r.n_live, r.n_example) for r in secrets.scan(df).collect()}
    assert live == {**{i: (0, 1) for i in range(8)}, 8: (1, 0), 9: (1, 0), 10: (0, 0)}
    assert sorted(r.doc_id for r in secrets.without_live_secrets(df).collect()) == [*range(8), 10]


def test_secret_copied_within_one_source(spark):
    """500 documents of one source hold the same value: an example. 99 copies are not many enough."""
    rows = [(i, "x password=example-of-the-manual", "hot") for i in range(500)] + [(1000 + i, "token=ours-and-live", "hot") for i in range(99)]
    rows += [(2000, "password=example-of-the-manual token=ours-and-live secret=mine-alone-7", "b"), (2000, "password=example-of-the-manual", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {(r.doc_id, len(r.spans)): (r.n_live, r.n_example, r.most_docs, r.most_owners) for r in secrets.scan(df).collect()}
    assert found[3, 1] == (0, 1, 501, 2) and found[1003, 1] == (0, 1, 100, 2)
    assert found[2000, 3] == (1, 2, 501, 2) and found[2000, 1] == (0, 1, 501, 2)
    alone = {r.doc_id: r.n_live for r in secrets.scan(df.where("doc_id != 2000")).collect()}
    assert alone[3] == 0 and alone[1003] == 1
    assert secrets.without_live_secrets(df).count() == 500 + 99 + 1


# mixing ----------------------------------------------------------------------------------------


def expected_targets(rows, weights=(3, 1, 2)):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += share * weight[s]
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return sizes, target


def test_mix(docs):
    sizes, target = expected_targets(both(docs))
    rows = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(WORD.findall(t))) for i, t, _ in both(docs))
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9)
        assert 0 <= r.times <= 2
        taken[r.source] += r.times * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * largest[s] + 1
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_mix_brute_order(spark):
    """The queue itself: serve by finish time until the budget is used."""
    docs = documents(spark)
    place = {r.doc_id: r.p for r in docs.selectExpr("doc_id", "xxhash64(7, doc_id, xxhash64(coalesce(text, ''))) AS p").collect()}
    sizes, target = expected_targets(both(docs))
    by = defaultdict(list)
    for i, text, source in both(docs):
        by[source].append((place[i], i, len(WORD.findall(text))))
    queue = []
    for source, items in by.items():
        at = 0
        for k in range(2):
            for p, i, n in sorted(items):
                at += n
                queue.append((at / target[source], source, p, i, k, n))
    left, want = sum(target.values()), Counter()
    for _, _, _, i, _, n in sorted(queue):
        left -= n
        if left < 0:
            break
        want[i] += n > 0
    assert {r.doc_id: r.times for r in mixing.mix(docs).collect()} == {i: want[i] for i in place}


@pytest.mark.parametrize("query", [licenses.license_report, secrets.secret_report, mixing.mixed_report])
def test_empty_tables(spark, query):
    assert query(spark.createDataFrame([], DOCUMENTS_DDL)).count() == 0
