"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding turns look-alike letters of other scripts into Latin ones, digits and signs used as letters
into letters, and lower-cases. Lexicon entries are whole words, or word beginnings with a star. Their
weights are log odds, learned from labelled training rows; entries named by the caller have a fixed
weight. A match inside an exception phrase does not count. The sum of weights, as it is and by the
length of the text, goes into a logistic score.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from math import exp, log1p

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelog.llm.batches import slices, texts
from stridelog.session import written

# Letters that look like Latin ones (Cyrillic, Greek, full width by rule), and signs used as letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Start of the lexicon, used even without labels; learned weights take precedence.
SEEDS = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting")
SEED_WEIGHT = 3.0
#: Harmless phrases with words of the lexicon.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown")

_FOLD = str.maketrans(LOOKALIKES | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)})
_WORD = re.compile(r"[^\W_]+", re.UNICODE)
#: A word with at least one letter and only letters and signs that can stand for letters.
_MASKED = re.compile(r"(?<![^\W_])(?=[013457@$!]*[a-z])[a-z013457@$!]*[013457@$!][a-z013457@$!]*(?![^\W_])")
_SIGNS = str.maketrans(SIGNS)


def fold(text: str) -> str:
    """Lower case, look-alikes and full-width forms as Latin letters, signs inside words as letters."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    return _MASKED.sub(lambda m: m[0].rstrip("!").translate(_SIGNS) + " " * (len(m[0]) - len(m[0].rstrip("!"))), text)


@dataclass(frozen=True)
class Lexicon:
    """`words`: weight of entries, a star at the end for word beginnings; `fit`: the logistic's coefficients."""

    words: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    fit: tuple[float, float, float] = (-3.0, 1.0, 0.3)
    _made: list = field(default_factory=list, compare=False, repr=False)

    def automaton(self):
        if not self._made:
            a = ahocorasick.Automaton()
            for entry, weight in self.words.items():
                key = entry.rstrip("*")
                old = a.get(key, (len(key), None, None, False))
                a.add_word(key, (len(key), *((old[1], weight) if entry.endswith("*") else (weight, old[2])), old[3]))
            for phrase in self.exceptions:
                folded = fold(phrase)
                old = a.get(folded, (len(folded), None, None, False))
                a.add_word(folded, (*old[:3], True))
            a.make_automaton()
            self._made.append(a)
        return self._made[0]

    def sums(self, text: str) -> tuple[float, int]:
        """Sum of the weights of all matches, and how many matched."""
        folded, hits, excused = fold(text), [], []
        size = len(folded)
        if not len(self.automaton()):
            return 0.0, 0
        for last, (length, whole, begins, excuse) in self.automaton().iter(folded):
            first = last - length + 1
            if first and (folded[first - 1].isalnum()):
                continue
            ends = last + 1 == size or not folded[last + 1].isalnum()
            if excuse and ends:
                excused.append((first, last))
            weight = whole if ends and whole is not None else begins
            if weight is not None:
                hits.append((first, last, weight))
        excused.sort()
        starts, ends = [a for a, _ in excused], list(accumulate((b for _, b in excused), max))
        best: dict[int, float] = {}
        for first, last, weight in hits:
            at = bisect_right(starts, first) - 1
            if at < 0 or ends[at] < last:
                # A word counts once, with its heaviest entry.
                best[first] = max(best.get(first, 0.0), weight)
        return sum(best.values()), len(best)

    def features(self, text: str) -> tuple[float, float]:
        total, _ = self.sums(text)
        return log1p(total), log1p(1000 * total / (text.count(" ") + 50))

    def score(self, text: str) -> float:
        a, (b, c) = self.fit[0], self.fit[1:]
        x, y = self.features(text)
        return 1 / (1 + exp(-max(-40.0, min(40.0, a + b * x + c * y))))


def _entries(text: str, shortest: int, longest: int) -> set[str]:
    """Words of a text, and the beginnings of its longer words."""
    words = {w for w in _WORD.findall(fold(text)) if len(w) <= 40}
    return words | {w[:n] + "*" for w in words for n in range(shortest, longest + 1) if len(w) > n}


def learn(
    documents: DataFrame, labels: DataFrame, max_rows: int = 5000, max_entries: int = 4000,
    least_docs: int = 4, least_weight: float = 2.0, beginnings: tuple[int, int] = (4, 6),
) -> Lexicon:
    """A lexicon from rows whose crc32(doc_id as text) mod 5 is not 0.

    `max_rows` bounds the labels of each class that are used (the first by a hash of the id), and the rows of each
    class that the two weights of the score are fitted on (the first by a hash of id and text), so what comes to
    the driver is bounded however many rows an id has. `max_entries` bounds the lexicon, and words over 40
    letters are no entries. An entry needs `least_docs` toxic texts and log odds of `least_weight`. A row
    with a null id, label or text teaches nothing; of repeated labels and rows each counts. Bytes that are no
    UTF-8 are read as U+FFFD. Without labels or texts the lexicon has its seed words only.
    """
    spark = documents.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic")
    picked = None
    for value in (0, 1):
        one = known.where((F.col("toxic") >= 1) == bool(value)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        picked = one if picked is None else picked.unionByName(one)
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic", F.xxhash64("doc_id", "text").alias("place"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = (Counter(), Counter())
        rows = [0, 0]

        def out():
            keys = list(tallies[0].keys() | tallies[1].keys())
            table = [keys + [""], *([t[k] for k in keys] + [rows[i]] for i, t in enumerate(tallies))]
            for t in tallies:
                t.clear()
            rows[:] = [0, 0]
            return pa.RecordBatch.from_arrays([pa.array(table[0], pa.string()), *(pa.array(t, pa.int64()) for t in table[1:])], ["entry", "clean", "bad"])

        for batch in slices(batches):
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
                tallies[toxic >= 1].update(_entries(text.decode("utf-8", "replace"), *beginnings))
                rows[toxic >= 1] += 1
            if len(tallies[0]) + len(tallies[1]) > 500_000:
                yield out()
        yield out()

    sums = rows.mapInArrow(counted, "entry string, clean long, bad long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    sums = sums.persist()
    total = sums.where("entry = ''").first()
    n_clean, n_bad = (total.clean, total.bad) if total else (0, 0)
    weight = F.ln((F.col("bad") + 0.5) / (n_bad + 1)) - F.ln((F.col("clean") + 0.5) / (n_clean + 1))
    heavy = (
        sums.where(f"entry != '' AND bad >= {least_docs}")
        .select("entry", weight.alias("weight"))
        .where(F.col("weight") >= least_weight)
        .orderBy(F.desc("weight"), "entry")
        .limit(max_entries)
        .collect()
    )
    sums.unpersist()
    words = dict.fromkeys(SEEDS, SEED_WEIGHT) | {r.entry: float(r.weight) for r in heavy}
    lexicon = Lexicon(words)
    return Lexicon(words, fit=_fitted(lexicon, rows, max_rows)) if n_bad and n_clean else lexicon


def _fitted(lexicon: Lexicon, rows: DataFrame, max_rows: int) -> tuple[float, float, float]:
    """Logistic regression on the two features of the first `max_rows` training rows of each class, by Newton steps."""

    def measured(batches):
        for batch in slices(batches):
            pairs = [lexicon.features(t.decode("utf-8", "replace")) for t in texts(batch)]
            x, y = zip(*pairs, strict=True)
            columns = [pa.array(x), pa.array(y), batch.column("toxic").cast(pa.float64()), batch.column("place")]
            yield pa.RecordBatch.from_arrays(columns, ["x", "y", "toxic", "place"])

    # Narrow rows, of which at most 2 x max_rows come to the driver.
    all_ = written(rows.mapInArrow(measured, "x double, y double, toxic double, place long"), "toxicity-features")
    first = [all_.where(c).orderBy("place", "x", "y").limit(max_rows) for c in (F.col("toxic") >= 1, F.col("toxic") < 1)]
    table = np.array([tuple(r) for r in first[0].unionByName(first[1]).drop("place").collect()])
    table = table[np.lexsort(table.T)]
    features, toxic = np.column_stack([np.ones(len(table)), table[:, :2]]), np.minimum(table[:, 2], 1)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        hessian = features.T @ (features * (p * (1 - p))[:, None]) + 1e-3 * np.eye(3)
        w = w + np.linalg.solve(hessian, features.T @ (toxic - p) - 1e-3 * w)
    return tuple(float(v) for v in w)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def toxicity_scores(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score and predicted for each row, by its text alone. A null text scores as an empty one."""

    def scored(batches):
        for batch in slices(batches):
            scores = [lexicon.score((t or b"").decode("utf-8", "replace")) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(scored, "doc_id long, score double")
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def without_toxic(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows whose text scores below 0.5, as they are; the decision is made beside each row, without a join."""
    schema = documents.schema

    def kept(batches):
        for batch in slices(batches):
            fine = [lexicon.score((t or b"").decode("utf-8", "replace")) < 0.5 for t in texts(batch)]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return documents.mapInArrow(kept, schema)


def toxicity_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity_scores(documents, learn(documents, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
