"""Quality rules: repetition counts, and divergence from what texts of a language look like.

A reference per language is counted over the whole corpus: how its characters fall into classes, and
how often its common words (those with at least `common` of all words, hence at most 1 / common) occur.
A text is held against the reference whose common words it uses most. It is dropped if the
Jensen-Shannon divergence of its classes or of its common words is beyond a limit. Short texts
scatter, so the limits grow as the text gets shorter, and very short ones are not judged.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelog.llm.batches import mixed, slices, texts

#: Classes of bytes; a character beyond ASCII counts by its first byte.
REST, BLANK, LINE, LOWER, UPPER, DIGIT, STOP, SIGN, ASCII, FAR = range(10)
_CLASS = np.full(256, ASCII, np.uint8)
_CLASS[128:192], _CLASS[192:] = REST, FAR
for _bytes, _kind in (
    (b" \t\x0b\x0c\r", BLANK), (b"\n", LINE), (b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER),
    (b"0123456789", DIGIT), (b".,;:!?'\"()-", STOP), (b"#*$%&|<>", SIGN),
):
    _CLASS[list(_bytes)] = _kind
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    few_words: int = 20
    repeated: float = 0.3
    #: Texts with fewer words are not held against a reference.
    judged_words: int = 40
    classes: float = 0.045
    words: float = 0.09
    #: Added to the limits on classes and on words, divided by the number of words.
    class_scatter: float = 1.5
    word_scatter: float = 4.0


@dataclass(frozen=True)
class Reference:
    classes: np.ndarray
    words: dict[bytes, int]
    shares: np.ndarray


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=10)


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits, 0 to 1, of two histograms that need not be normed."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)
    return float(parts.sum() / 2)


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows of eight words that occur twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    spread = mixed(ids.astype(np.uint64) + np.uint64(1))
    window = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        window = window * np.uint64(0x100000001B3) + spread[k : k + n]
    _, place, times = np.unique(mixed(window), return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int32)
    starts = np.flatnonzero(times[place] > 1)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def references(documents: DataFrame, common: float = 0.002, most_distinct: int = 400_000) -> dict[str, Reference]:
    """References of all languages named in `lang`, from all their rows. `most_distinct` bounds a task's memory only."""

    def counted(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(10, np.int64))

        def out():
            rows = [(lang, w, None, n) for lang, c in words.items() for w, n in c.items()]
            rows += [(lang, None, i, int(n)) for lang, c in classes.items() for i, n in enumerate(c)]
            words.clear()
            classes.clear()
            kinds = (pa.string(), pa.binary(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["lang", "word", "class", "n"])

        for batch in slices(batches):
            for text, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
                words[lang].update(text.lower().split())
                classes[lang] += class_counts(text)
            if sum(map(len, words.values())) > most_distinct:
                yield out()
        if classes:
            yield out()

    known = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    known = known.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = known.mapInArrow(counted, "lang string, word binary, class int, n long").groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))
    sums = sums.persist()
    # One row for a language.
    totals = sums.where(F.col("word").isNotNull()).groupBy("lang").agg(F.sum("n").alias("total"))
    shares = (
        sums.join(F.broadcast(totals), "lang")
        .where(F.col("word").isNull() | (F.col("n") >= common * F.col("total")))
        .select("lang", "word", "class", "n", "total")
        .collect()
    )
    sums.unpersist()
    out = {}
    for lang in sorted({r.lang for r in shares}):
        classes = np.zeros(10)
        for r in shares:
            if r.lang == lang and r.word is None:
                classes[r["class"]] = r.n
        words = sorted((bytes(r.word), r.n / r.total) for r in shares if r.lang == lang and r.word is not None)
        part = np.array([s for _, s in words])
        out[lang] = Reference(classes, {w: i for i, (w, _) in enumerate(words)}, np.append(part, max(1e-9, 1 - part.sum())))
    return out


def measure(text: bytes, known: dict[str, Reference], limits: Limits) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, two divergences."""
    words = text.split()
    n = len(words)
    classes = class_counts(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeats = repeated_words(ids) if len(number) < n else 0
    failed = n < limits.few_words or repeats > limits.repeated * n
    by_class = by_word = 0.0
    if n >= limits.judged_words and known:
        times = Counter()
        for w, c in zip(number, np.bincount(ids).tolist(), strict=True):
            times[w.lower()] += c
        best = max(known, key=lambda lang: sum(times[w] for w in known[lang].words if w in times))
        ref = known[best]
        found = np.array([times[w] if w in times else 0 for w in ref.words] + [0.0])
        found[-1] = n - found.sum()
        by_class, by_word = divergence(classes[1:], ref.classes[1:]), divergence(found, ref.shares)
    fits = by_class <= limits.classes + limits.class_scatter / max(n, 1) and by_word <= limits.words + limits.word_scatter / max(n, 1)
    kept = not failed and fits
    chars = int(classes[1:].sum() - classes[BLANK] - classes[LINE])
    return n, chars, int(classes[SIGN]), len(lines) - len(set(lines)), repeats, failed, kept, by_class, by_word


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_divergence", "word_divergence"]
TYPES = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.float64()]


def quality_report(documents: DataFrame, limits: Limits = Limits(), known: dict[str, Reference] | None = None) -> DataFrame:
    """doc_id and the measures of each row. A null text has none of anything; other columns are not read.

    `known` defaults to references counted over `documents`; without any (no language named) only the
    counting rules decide.
    """
    known = references(documents) if known is None else known

    def measured(batches):
        for batch in slices(batches):
            rows = [measure(t or b"", known, limits) for t in texts(batch)]
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *NAMES])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in NAMES[:5]) + ", base_failed boolean, kept boolean, class_divergence double, word_divergence double"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measured, schema)
