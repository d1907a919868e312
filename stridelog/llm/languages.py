"""Language identification by prediction with partial matching.

Each language has a tree of byte contexts of up to `order` bytes with frozen counts. The code length
of a byte is that of its longest known context; where the context has not seen the byte, an escape is
paid (seen symbols over seen symbols plus counts) and the next shorter context decides, down to an
even chance over all symbols. The language with the shortest code for the whole text is predicted.

As statistics are frozen, code lengths depend on a context and a byte only. They are worked out once
into a table over all contexts of all languages, so scoring a text is two array look-ups per byte.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelog.llm.batches import slices, texts

#: Symbols: a to z (either case), every byte beyond ASCII, and one for all others.
_OTHER = 32
_SYMBOL = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else _OTHER for b in range(256))
_LATIN = re.compile(rb"[A-Za-z]")
#: Most symbols a model tells apart; the rarest beyond share one.
MOST_SYMBOLS = 64


def symbols(text: bytes) -> bytes:
    return text.translate(_SYMBOL)


def has_letter(text: bytes) -> bool:
    return bool(_LATIN.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    order: int
    #: symbol number of each byte
    number: np.ndarray
    n_symbols: int
    #: context number of every string of `order` symbols: that of its longest known ending
    context: np.ndarray
    #: bits[context * n_symbols + symbol] has the code length per language
    bits: np.ndarray

    def lengths(self, batch: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language. A text starts after blanks."""
        lead = bytes([_OTHER]) * self.order
        joined = self.number[np.frombuffer(lead + lead.join(symbols(t) for t in batch), np.uint8)]
        code = np.zeros(len(joined) - self.order, np.int32)
        for back in range(self.order):
            code = code * self.n_symbols + joined[back : back + len(code)]
        bits = self.bits[self.context[code] * self.n_symbols + joined[self.order :]]
        out = np.zeros((len(batch), len(self.languages)))
        at = 0
        for i, t in enumerate(batch):
            out[i] = bits[at : at + len(t)].sum(axis=0, dtype=np.float64)
            at += len(t) + self.order
        return out


def learn(
    documents: DataFrame, order: int = 3, rows_per_language: int = 400, least_count: int = 4, max_rows: int = 2_000_000
) -> Model | None:
    """Context trees from rows with a language whose crc32(doc_id as text) mod 4 is not 2.

    A bounded sample teaches: about `rows_per_language` whole texts of each language, picked by a hash of
    the id. A context needs `least_count` symbols in some language. At most `max_rows` counts come to the
    driver, the most frequent first. None if there is nothing to learn from.
    """
    spark = documents.sparkSession
    train = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # One row for each language.
    sizes = train.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("teach")), F.lit(1 << 30)) / float(1 << 30)
    picked = (
        train.select("doc_id", "text", "lang")
        .join(F.broadcast(sizes), "lang")
        .where(chance * F.col("rows") < rows_per_language)
        .select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    )

    def counted(batches):
        tally: dict[str, Counter] = defaultdict(Counter)

        def out():
            rows = [(lang, gram, n) for lang, c in tally.items() for gram, n in c.items()]
            tally.clear()
            kinds = (pa.string(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["lang", "gram", "n"])

        for batch in slices(batches):
            for text, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
                padded = bytes([_OTHER]) * order + symbols(text)
                tally[lang].update(padded[i : i + order + 1] for i in range(len(text)))
            if sum(map(len, tally.values())) > 300_000:
                yield out()
        if tally:
            yield out()

    sums = picked.mapInArrow(counted, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = sums.orderBy(F.desc("n"), "lang", "gram").limit(max_rows).collect()
    return _model([(r.lang, bytes(r.gram), r.n) for r in rows], order, least_count) if rows else None


def _model(grams: list[tuple[str, bytes, int]], order: int, least: int) -> Model:
    languages = sorted({g[0] for g in grams})
    seen: Counter = Counter()
    for _, gram, n in grams:
        seen[gram[-1]] += n
    seen[_OTHER] += 1
    number = np.zeros(256, np.int32)
    # Number 0 is for the rest: bytes never seen, and the rarest beyond the bound.
    for i, (byte, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: MOST_SYMBOLS - 1]):
        number[byte] = i + 1
    n_symbols = int(number.max()) + 1

    # counts[language][length of context][context] is an array over symbols
    counts = [[defaultdict(lambda: np.zeros(n_symbols)) for _ in range(order + 1)] for _ in languages]
    rank = {lang: i for i, lang in enumerate(languages)}
    for lang, gram, n in grams:
        coded = tuple(number[list(gram)].tolist())
        for length in range(order + 1):
            counts[rank[lang]][length][coded[order - length : order]][coded[-1]] += n

    known = [sorted({c for tree in counts for c, row in tree[length].items() if length == 0 or row.sum() >= least}) for length in range(order + 1)]
    numbers = [{c: 0 for c in known[0]}]
    bits = [np.empty((1, n_symbols, len(languages)), np.float32)]
    for length in range(order + 1):
        if length:
            start = sum(map(len, numbers))
            numbers.append({c: start + i for i, c in enumerate(known[length])})
            bits.append(np.empty((len(known[length]), n_symbols, len(languages)), np.float32))
        for lang, tree in enumerate(counts):
            for i, c in enumerate(known[length]):
                shorter = _place(numbers, c[1:]) if length else None
                below = np.full(n_symbols, np.log2(n_symbols)) if shorter is None else _row(bits, shorter, lang)
                row = tree[length].get(c)
                bits[length][i, :, lang] = below if row is None else _costs(row, below)
    # Every string of symbols, by its longest known ending: shorter endings first, longer ones on top.
    context = np.zeros(n_symbols**order, np.int32).reshape((n_symbols,) * order)
    for length in range(1, order + 1):
        for c, i in numbers[length].items():
            context[(..., *c)] = i
    return Model(languages, order, number, n_symbols, context.reshape(-1), np.concatenate(bits).reshape(-1, len(languages)))


def _place(numbers: list[dict], c: tuple) -> tuple[int, int]:
    """Length and row of the longest known ending of `c`."""
    while c not in numbers[len(c)]:
        c = c[1:]
    return len(c), numbers[len(c)][c] - sum(map(len, numbers[: len(c)]))


def _row(bits: list[np.ndarray], place: tuple[int, int], lang: int) -> np.ndarray:
    return bits[place[0]][place[1], :, lang]


def _costs(row: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Code lengths in a context: seen symbols by count, others by an escape and the shorter context without the seen."""
    seen = row > 0
    kinds, total = seen.sum(), row.sum()
    out = np.empty(len(row))
    out[seen] = np.log2((total + kinds) / row[seen])
    if kinds < len(row):
        left = np.exp2(-below[~seen])
        out[~seen] = np.log2((total + kinds) / kinds) - np.log2(left / left.sum())
    return out


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of each row, by its text alone.

    `und` with score 0 for a null text, one without a letter, or where there is no model. The score
    is the posterior chance of the language under equal priors. Ties go to the language that sorts
    first. Other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def named(batches):
        model = shared.value
        for batch in slices(batches, 1 << 20):
            told, tongue, score = list(texts(batch)), ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            good = [i for i, t in enumerate(told) if model is not None and t and has_letter(t)]
            if good:
                bits = model.lengths([told[i] for i in good])
                best = bits.argmin(axis=1)
                margin = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0)).sum(axis=1)
                for i, b, m in zip(good, best, margin, strict=True):
                    tongue[i], score[i] = model.languages[b], 1 / m
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tongue), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        named, "doc_id long, lang_pred string, score double"
    )


def language_report(documents: DataFrame) -> DataFrame:
    return predict(documents, learn(documents)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
