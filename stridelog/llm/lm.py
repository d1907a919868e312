"""Scoring by a small causal self-attention model over subword ids, trained in numpy.

Word counts of all training texts give the base score. Encoded as subwords the texts also give the counts of all
subword ids and of the pairs of neighbours. Frequent ids have a number each, the others share one. Numbers are put into
classes by the numbers that they stand beside. The model predicts the class of the next subword by masked attention over the
ones before it, starting from the counts of classes after the last one; inside its class a number has its share after the
last one, an id its share of the number. So a subword's probability is P(class | window) x P(number | class, last) x
P(id | number), over the whole vocabulary.

A text is scored in overlapping windows: each begins with some subwords that were scored by the window
before and serve as context, so every subword is scored once. Windows of many texts run as one batch.
"""

from __future__ import annotations

import base64
import ctypes
import glob
import os
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelog.llm.batches import mixed, slices
from stridelog.llm.text import text_of
from stridelog.session import fresh_path, remove, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Counts of words that make up at least one in so many are held by every task, so there are at most so
#: many of them; counts of the rest are joined.
HEAD_WORDS = 2_000_000
#: Numbers of ids (each an embedding), width, classes, new and repeated subwords of a window.
INPUTS, WIDTH, CLASSES, NEW, AGAIN = 2048, 16, 32, 24, 8
SPAN = NEW + AGAIN
#: Weight of seeing nothing, beside those of the numbers that are seen.
SINK = 0.01
#: Subwords of a run of windows that is learned from as a whole.
CHUNK = 64 * NEW
#: Step length of the training, and by how much it is shortened from round to round.
RATE, COOLING = 0.02, 0.9
#: Windows of one step of the training, the least number of steps, and the sums in which weights come to the driver.
BATCH, LEAST_STEPS, PARTS = 256, 1000, 16


def one_thread() -> None:
    """Products of matrices in this process use one thread: a task has one core, while Spark allows each as many as its executor has.

    Arrays of a step are taken from memory that the process keeps: getting its pages anew each time took longer than filling them.
    """
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__) + ".libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
    process = ctypes.CDLL(None)
    if hasattr(process, "mallopt"):
        # M_MMAP_THRESHOLD and M_TRIM_THRESHOLD of glibc: arrays below 4 MB, up to 64 MB of them.
        process.mallopt(-3, 4 << 20)
        process.mallopt(-1, 64 << 20)


class Numbers(dict):
    """A number for each word, in order of first use."""

    def __init__(self) -> None:
        self.names: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        return number


class Subwords:
    """Subword ids of words, each with the blank before it; the words met lately are kept with their numbers.

    `shares` are the base scores of words, where they are wanted.
    """

    def __init__(self, path: str, shares: dict[bytes, float] | None = None) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        # Very long words go in pieces, so their cost stays linear.
        self.encoding = tiktoken.Encoding("words", pat_str=r" ?[^ ]{1,64}| ", mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.opens = np.zeros(self.end, bool)
        for token, rank in ranks.items():
            self.opens[rank] = token.startswith(b" ")
        self.shares = shares or {}
        self._forget()

    def _forget(self) -> None:
        # The empty word stands for the end and has number 0.
        self.numbers = Numbers()
        self.numbers[b""]
        self.flat, self.sizes = np.array([self.end], np.int32), np.ones(1, np.int64)
        self.share = np.array([self.shares.get(b"", np.nan)])

    def numbered(self, words: Iterable[bytes]) -> np.ndarray:
        """The number of each word; `flat`, `starts` and `sizes` give the ids of every number, `share` its base score."""
        if len(self.numbers) > 400_000:
            self._forget()
        told = np.fromiter(map(self.numbers.__getitem__, words), np.int64)
        new = self.numbers.names[len(self.sizes) :]
        if new:
            # All new words in one text: a word begins where an id begins with a blank.
            text = b" " + b" ".join(new)
            ids = np.array(self.encoding.encode_ordinary(text.decode("utf-8", "replace")), np.int32)
            cuts = np.flatnonzero(self.opens[ids])
            self.flat = np.concatenate([self.flat, ids])
            self.sizes = np.concatenate([self.sizes, np.diff(cuts, append=len(ids))])
            self.share = np.concatenate([self.share, np.array([self.shares.get(w, np.nan) for w in new])])
        self.starts = np.cumsum(self.sizes) - self.sizes
        return told

    def pieces(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word; the empty word stands for the end."""
        told = self.numbered(words)
        return [self.flat[s : s + n] for s, n in zip(self.starts[told].tolist(), self.sizes[told].tolist(), strict=True)]

    def sequence(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """The ids of all documents in a row, each with the end id after it, and their lengths.

        Also all words met by number, and the number of each word, the ends included.
        """
        words = self.numbered(chain.from_iterable(chain(d, (b"",)) for d in documents))
        return *self.laid(words, np.array([len(d) + 1 for d in documents])), self.numbers.names, words

    def laid(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all numbers of words in a row, and how many each stretch of words, `lengths` long, has."""
        each = self.sizes[words]
        upto = np.cumsum(each)
        ids = self.flat[np.repeat(self.starts[words] - (upto - each), each) + np.arange(int(each.sum()))]
        return ids, np.diff(np.concatenate([[0], upto[np.cumsum(lengths) - 1]]))


@dataclass
class Model:
    #: the id of the end; number of the embedding of every id, and its log10 share among the ids of that number
    end: int
    number: np.ndarray
    spread: np.ndarray
    #: class of every number, log probability of each class after each number, and log10 probability of
    #: each number in its own class after each number
    kind: np.ndarray
    prior: np.ndarray
    follows: np.ndarray
    weights: dict[str, np.ndarray]

    def each(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each subword after those before it in its document."""
        return self.spread[ids] + self.of_numbers(*led(self.number[ids], lengths, self.number[self.end]))

    def of_numbers(self, flat: np.ndarray, lengths: np.ndarray, at_once: int = 128) -> np.ndarray:
        """log10 probability of each number of the rows of `windows_of`, in order, after those before it."""
        windows, _ = windows_of(flat, lengths)
        found = np.empty((len(windows), NEW), np.float32)
        follows, places = self.follows.reshape(-1), np.arange(at_once * NEW) * CLASSES
        for at in range(0, len(windows), at_once):
            some = windows[at : at + at_once].astype(np.int64)
            wanted = some[:, AGAIN + 1 :].reshape(-1)
            logits = lean(self.weights, self.prior, some[:, :SPAN])
            own = logits.reshape(-1).take(places[: len(wanted)] + self.kind.take(wanted))
            np.exp(logits, out=logits)
            own -= np.log(logits @ _ONES)
            own *= np.float32(np.log10(np.e))
            # Where no number is wanted, any share will do.
            own += follows.take(some[:, AGAIN:SPAN].reshape(-1) * INPUTS + wanted)
            found[at : at + at_once] = own.reshape(-1, NEW)
        # Windows come in the order of the rows.
        return found[windows[:, AGAIN + 1 :] >= 0]

    def logprobs(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each document."""
        return np.add.reduceat(self.each(ids, lengths), np.cumsum(lengths) - lengths, dtype=float)


def led(numbers: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document behind AGAIN places without a number (-1) and the end of the one before, in a row, and the lengths with them."""
    room = lengths + AGAIN + 1
    places, starts = np.cumsum(room) - room, np.cumsum(lengths) - lengths
    flat = np.full(int(room.sum()), -1, np.int16)
    flat[places + AGAIN] = end
    flat[np.arange(len(numbers)) + np.repeat(places + AGAIN + 1 - starts, lengths)] = numbers
    return flat, room


def windows_of(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, SPAN + 1): the numbers that a window sees, then the last one wanted, -1 where there is none; and the row of each.

    Rows are documents or runs of windows, each led by the AGAIN + 1 numbers before it.
    """
    count = -(-(lengths - AGAIN - 1) // NEW)
    room = AGAIN + 1 + count * NEW
    places, starts = np.cumsum(room) - room, np.cumsum(lengths) - lengths
    wide = np.full(int(room.sum()), -1, np.int16)
    wide[np.arange(len(flat)) + np.repeat(places - starts, lengths)] = flat
    first = np.repeat(places, count) + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * NEW
    return np.lib.stride_tricks.sliding_window_view(wide, SPAN + 1)[first], np.repeat(np.arange(len(lengths)), count)


_SEEN = (np.arange(SPAN)[None, :] <= np.arange(NEW)[:, None] + AGAIN).astype(np.float32)
_ONES = np.ones(CLASSES, np.float32)
_CELLS = np.arange(INPUTS * WIDTH).reshape(INPUTS, WIDTH)


def attended(w: dict[str, np.ndarray], inputs: np.ndarray):
    """What queries see, their weights, and each query's number beside the mean of what it sees, (window x NEW, 2 WIDTH).

    A query weighs a number with (1 + q.k / 4)**4, which is close to the exponential function and takes products only. Keys and
    values are the embeddings themselves: a matrix of their own would be multiplied with that of the queries, or with `mix`.
    `SINK` is the weight of seeing nothing.
    """
    n, type_ = len(inputs), w["embed"].dtype.type
    x = w["embed"].take(inputs, axis=0)
    x += w["place"]
    both = np.empty((n * NEW, 2 * WIDTH), type_)
    both[:, :WIDTH].reshape(n, NEW, WIDTH)[:] = x[:, AGAIN:]
    q = (both[:, :WIDTH] @ (w["look"] * type_(0.25 * WIDTH**-0.5))).reshape(n, NEW, WIDTH)
    t = q @ x.transpose(0, 2, 1)
    t += 1
    t *= _SEEN
    # Places without a number are the first or the last of a window.
    short = np.flatnonzero((inputs[:, 0] < 0) | (inputs[:, -1] < 0))
    if len(short):
        t[short] *= (inputs[short] >= 0)[:, None, :]
    return x, both, q, t


def lean(w: dict[str, np.ndarray], prior: np.ndarray, inputs: np.ndarray) -> np.ndarray:
    """Class logits (window x NEW, class) by masked attention, added to those of the counts."""
    x, both, _, t = attended(w, inputs)
    t *= t
    t *= t
    per = 1 / ((t @ np.ones(SPAN, np.float32)).reshape(-1, 1) + np.float32(SINK))
    np.multiply((t @ x).reshape(-1, WIDTH), per, out=both[:, WIDTH:])
    h = both @ np.concatenate([w["own"], w["mix"]])
    h /= np.abs(h) + 1
    logits = h @ w["out"]
    logits += w["bias"]
    # As h is at most 1, so large weights alone could overflow.
    if (np.abs(w["out"]).sum(axis=0) + np.abs(w["bias"])).max() > 60:
        np.clip(logits, -60, 60, out=logits)
    logits += prior.take(inputs[:, AGAIN:].reshape(-1), axis=0)
    return logits


def gradients(w: dict[str, np.ndarray], prior: np.ndarray, inputs: np.ndarray, targets: np.ndarray, kind: np.ndarray):
    """Mean loss in nats and the gradient of each weight."""
    n, inputs, want = len(inputs), inputs.astype(np.int64), targets.reshape(-1).astype(np.int64)
    type_ = w["embed"].dtype.type
    x, both, q, t = attended(w, inputs)
    # The weights, and below them the gradients of what they are the fourth power of, meet keys and values in one product.
    pair, turned = np.empty((n, 2 * NEW, SPAN), type_), np.empty((n, 2 * NEW, WIDTH), type_)
    cubes = t * t
    per = 1 / (np.einsum("nqk,nqk->nq", cubes, cubes).reshape(-1, 1) + type_(SINK))
    shares = cubes.reshape(-1, SPAN) * per
    shares = shares.reshape(n, NEW, SPAN)
    a = np.multiply(cubes, shares, out=pair[:, :NEW])
    t *= shares
    both[:, WIDTH:] = (a @ x).reshape(-1, WIDTH)
    joint = np.concatenate([w["own"], w["mix"]])
    h = both @ joint
    steep = np.abs(h)
    steep += 1
    h /= steep
    p = h @ w["out"]
    p += (prior + w["bias"]).take(inputs[:, AGAIN:].reshape(-1), axis=0)
    # Only large weights could overflow.
    if (np.abs(w["out"]).sum(axis=0) + np.abs(w["bias"])).max() > 60:
        p -= p.max(axis=1, keepdims=True)
    real = want >= 0
    at = np.arange(len(want)) * CLASSES + kind.take(want)
    total = max(int(real.sum()), 1)
    own = p.reshape(-1).take(at)
    np.exp(p, out=p)
    sums = p @ _ONES.astype(type_)
    loss = (np.log(sums) - own)[real].sum() / total
    part = real.astype(type_) / type_(total)
    p *= (part / sums)[:, None]
    p.reshape(-1)[at] -= part
    g = {"out": h.T @ p, "bias": np.ones(len(p), type_) @ p}
    dz = p @ w["out"].T
    steep *= steep
    dz /= steep
    above = both.T @ dz
    g["own"], g["mix"] = above[:WIDTH], above[WIDTH:]
    dboth = dz @ joint.T
    turned[:, :NEW] = dboth[:, WIDTH:].reshape(n, NEW, WIDTH)
    np.multiply(q, 4, out=turned[:, NEW:])
    da = turned[:, :NEW] @ x.transpose(0, 2, 1)
    da.reshape(-1, SPAN)[:] -= np.einsum("ij,ij->i", dboth[:, WIDTH:], both[:, WIDTH:])[:, None]
    dt = np.multiply(da, t, out=pair[:, NEW:])
    dq = (dt @ x).reshape(-1, WIDTH)
    dx = pair.transpose(0, 2, 1) @ turned
    # `q` is a quarter of the query, its power four times as steep.
    scale = type_(WIDTH**-0.5)
    g["look"] = (both[:, :WIDTH].T @ dq) * scale
    late = dq @ (w["look"].T * scale)
    late += dboth[:, :WIDTH]
    dx[:, AGAIN:] += late.reshape(n, NEW, WIDTH)
    g["place"] = (np.ones(n, type_) @ dx.reshape(n, -1)).reshape(SPAN, WIDTH)
    cells = _CELLS.take(inputs.reshape(-1), axis=0).reshape(-1)
    g["embed"] = np.bincount(cells, dx.reshape(-1), INPUTS * WIDTH).reshape(INPUTS, WIDTH).astype(type_)
    return loss, g


def numbered(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding number of each id, and its log10 share among the ids of that number; rarer ids share the last."""
    mass = counts + 0.1
    order = np.lexsort((np.arange(len(mass)), -mass))
    number = np.full(len(mass), INPUTS - 1, np.int16)
    top = order[: INPUTS - 1]
    number[top] = np.arange(len(top))
    return number, np.log10(mass / np.bincount(number, weights=mass, minlength=INPUTS)[number]).astype(np.float32)


def classes(pairs: np.ndarray, seed: int = 11) -> np.ndarray:
    """Class of each number by the numbers it stands beside: k-means over the main directions of its neighbours' shares."""
    mass = pairs.sum(axis=0) + pairs.sum(axis=1) + 0.1
    shares = np.sqrt(np.concatenate([pairs.T, pairs], axis=1) / mass[:, None])
    weight = np.sqrt(mass)[:, None]
    basis = np.random.default_rng(seed).standard_normal((shares.shape[1], CLASSES))
    for _ in range(3):
        basis = np.linalg.qr((shares * weight).T @ ((shares * weight) @ basis))[0]
    points = shares @ basis
    centres = points[np.argsort(-mass, kind="stable")[:CLASSES]]
    for _ in range(20):
        kind = ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        belongs = np.zeros((CLASSES, INPUTS))
        belongs[kind, np.arange(INPUTS)] = weight[:, 0]
        held = belongs.sum(axis=1)[:, None]
        centres = np.where(held > 0, belongs @ points / np.maximum(held, 1e-30), centres)
    return kind


def untrained(counts: np.ndarray, end: int, pairs: np.ndarray, seed: int = 11) -> Model:
    """The counted parts from the counts of all ids and of neighbouring numbers, and random weights."""
    number, spread = numbered(counts)
    mass = np.bincount(number, weights=counts + 0.1, minlength=INPUTS) + 1e-3
    kind = classes(pairs)
    member = np.zeros((INPUTS, CLASSES))
    member[np.arange(INPUTS), kind] = 1
    total = mass @ member
    # Counts after a number, and the shares without it as often as there are different followers.
    of_class, kinds = pairs @ member, (pairs > 0) @ member + 0.1
    after = (pairs + kinds[:, kind] * (mass / total[kind])) / (of_class + kinds)[:, kind]
    often = kinds.sum(axis=1, keepdims=True)
    prior = (of_class + often * total / total.sum()) / (of_class.sum(axis=1, keepdims=True) + often)
    random = np.random.default_rng(seed)

    def made(*shape, scale):
        return (random.standard_normal(shape) * scale).astype(np.float32)

    square = {name: made(WIDTH, WIDTH, scale=WIDTH**-0.5) for name in ("look", "own", "mix")}
    weights = square | {"embed": made(INPUTS, WIDTH, scale=0.5), "place": made(SPAN, WIDTH, scale=0.1), "out": np.zeros((WIDTH, CLASSES), np.float32)}
    weights["bias"] = np.zeros(CLASSES, np.float32)
    # A class without numbers has no chance anywhere.
    prior = np.log(np.maximum(prior, 1e-12))
    return Model(end, number, spread, kind, prior.astype(np.float32), np.log10(after).astype(np.float32), weights)


def train(w: dict[str, np.ndarray], prior: np.ndarray, kind: np.ndarray, windows: np.ndarray, passes: int, rate: float, seed: int) -> float:
    """Adam over all windows, `passes` times in random order; `w` gets the new weights. The loss of windows not yet learned from, added up."""
    random, step, fresh = np.random.default_rng(seed), 0, 0.0
    flat = _packed(w)
    now = _unpacked(flat, w)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    steps = passes * -(-len(windows) // BATCH)
    for turn in range(passes):
        order = random.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            some = windows[order[at : at + BATCH]]
            targets = some[:, AGAIN + 1 :]
            loss, g = gradients(now, prior, some[:, :SPAN], targets, kind)
            if turn == 0:
                fresh += float(loss) * int((targets >= 0).sum())
            step += 1
            pace = rate * min(1.0, step / 20) * (0.5 * (1 + np.cos(np.pi * step / steps)) + 0.02)
            slope = _packed(g)
            first += 0.1 * (slope - first)
            slope *= slope
            second += 0.01 * (slope - second)
            flat -= float(pace / (1 - 0.9**step)) * first / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    w.update(now)
    return fresh


def words_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, A-Z in lower case, as bytes, and how many each text has."""
    # Not cast before: the cast of a slice keeps its first offset, which `ascii_lower` does not expect.
    parts = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text")))
    words = parts.flatten().cast(pa.large_binary())
    # Blanks at either end leave an empty part.
    full = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), np.diff(upto[parts.offsets.to_numpy()])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, c) over all training rows; the empty word stands for the ends."""

    def counted(batches):
        held, rows = [], 0

        def merged():
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        for batch in slices(batches):
            words, lengths = words_of(batch)
            each = words.value_counts()
            held.append(pa.table([each.field(0).cast(pa.binary()), each.field(1)], ["word", "c"]))
            held.append(pa.table([pa.array([b""], pa.binary()), pa.array([len(lengths)], pa.int64())], ["word", "c"]))
            rows += len(each) + 1
            if rows > 1_000_000:
                held[:] = [merged()]
                rows = held[0].num_rows
                if rows > 500_000:
                    yield from held.pop().to_batches()
                    rows = 0
        if held:
            yield from merged().to_batches()

    train_rows = documents.where(~held_out()).select(text_of().alias("text"))
    return train_rows.mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _id_counts(counts: DataFrame, path: str) -> np.ndarray:
    """How often each subword id stands in the training texts; one number for each id of the vocabulary."""

    def spread(batches):
        subwords = Subwords(path)
        tally = np.zeros(subwords.end + 1)
        for batch in batches:
            words = subwords.numbered(batch.column("word").to_numpy(zero_copy_only=False).tolist())
            pieces, sizes = subwords.laid(words, np.ones(len(words), np.int64))
            tally += np.bincount(pieces, weights=np.repeat(batch.column("c").to_numpy(), sizes), minlength=len(tally))
        yield pa.RecordBatch.from_arrays([pa.array([subwords.end]), pa.array([0.0])], ["id", "c"])
        some = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(tally[some])], ["id", "c"])

    rows = counts.mapInArrow(spread, "id long, c double").groupBy("id").agg(F.sum("c").alias("c")).toPandas()
    end = int(rows["id"].max())
    out = np.zeros(end + 1)
    out[rows["id"].to_numpy()] = rows["c"].to_numpy()
    return out


def learn(
    documents: DataFrame, counts: DataFrame, n_words: int, path: str, shard_windows: int = 32_768, rounds: int = 16, least_gain: float | None = None
) -> Model:
    """A model with ids and neighbours counted over all training texts, and attention weights learned from all their windows, in rounds.

    Training texts are cut into runs of CHUNK windows. Each run belongs to one round and one shard by a hash of
    (doc_id, text, run), so neither copies nor long texts stay together, and the result does not depend on
    partitions. In a round each shard goes on from the same weights over its windows; then the weights are averaged
    by the numbers of windows. The number of shards, and so what a round learns from, grows with the corpus.

    Small corpora pass over their windows again until all rounds have LEAST_STEPS steps. With `least_gain` the attention
    learns from a part of the windows: those of a round are new to the model, so their loss before they are learned from is
    a held-out loss, here taken as a part of what the counts alone lose on them, and rounds end when it has twice in a row
    not become less than the least so far by the part `least_gain`.
    """
    ids = _id_counts(counts, path) if n_words else _no_ids(path)
    spark = documents.sparkSession
    table = fresh_path(spark, "lm-runs")
    shards, passes = _shards(ids, shard_windows, rounds)
    _runs(documents, ids, path, rounds, shards).write.partitionBy("round").option("compression", "zstd").parquet(table)
    model = _learned(spark.read.schema("shard int, numbers binary, round int").parquet(table), ids, shards, passes, rounds, least_gain)
    remove(spark, table)
    return model


def _no_ids(path: str) -> np.ndarray:
    with open(path, "rb") as lines:
        return np.zeros(sum(1 for _ in lines) + 1)


def _shards(ids: np.ndarray, shard_windows: int, rounds: int) -> tuple[int, int]:
    """Shards of a round, and how often each passes over its windows."""
    # Windows hold NEW subwords, so there are about this many.
    about = max(1.0, ids.sum() / NEW)
    shards = int(-(-about // (rounds * shard_windows)))
    return shards, int(-(-LEAST_STEPS // max(1.0, about / shards / BATCH)))


def _learned(runs: DataFrame, ids: np.ndarray, shards: int, passes: int, rounds: int, least_gain: float | None) -> Model:
    """The model of stored training runs."""
    if not ids.any():
        return untrained(ids, len(ids) - 1, np.zeros((INPUTS, INPUTS)))
    model = untrained(ids, len(ids) - 1, _pair_counts(runs))
    best, idle = np.inf, 0
    for done in range(rounds):
        trained = _fitted(runs.where(F.col("round") == done), model, shards, passes, done)
        sums = sorted(((r.part, r.n, r.plain, r.loss, np.frombuffer(r.weights)) for r in trained.collect()), key=lambda s: s[0])
        if not sums:
            continue
        mean = sum(s[4] for s in sums) / sum(s[1] for s in sums)
        model.weights = _unpacked(mean.astype(np.float32), model.weights)
        loss = sum(s[3] for s in sums) / sum(s[2] for s in sums)
        if least_gain is not None:
            idle = idle + 1 if loss > best * (1 - least_gain) else 0
            if idle == 2:
                break
        best = min(best, loss)
    return model


def _packed(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].reshape(-1) for k in sorted(weights)])


def _unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    cuts = np.cumsum([like[k].size for k in sorted(like)])[:-1]
    return {k: part.reshape(like[k].shape) for k, part in zip(sorted(like), np.split(flat, cuts), strict=True)}


def _runs(documents: DataFrame, ids: np.ndarray, path: str, rounds: int, shards: int) -> DataFrame:
    """(round, shard, numbers) of the training rows, see `_encoded`."""
    return _encoded(documents.where(~held_out()), ids, path, rounds, shards).select("round", "shard", "numbers")


def _encoded(documents: DataFrame, ids: np.ndarray, path: str, rounds: int, shards: int, shares: dict[bytes, float] | None = None) -> DataFrame:
    """All rows as runs of windows, with what the scores need beside their numbers.

    numbers are those of the run, two bytes each, behind those that the first window sees; -1 is none. Held-out rows have round -1.
    The first run (run 0) of a row also has the number of its tokens, and of those with a share; the sum of their shares; of its ids the shares
    among those of their numbers (score); and its other words with their number of times. Without `shares` only score is set there.
    """
    shared = documents.sparkSession.sparkContext.broadcast((*numbered(ids), len(ids) - 1, shares))

    def dealt(batches):
        number, spread, end, shares = shared.value
        subwords = Subwords(path, shares)
        for batch in slices(batches):
            # Each different word of a batch is looked up once.
            split, n_words = words_of(batch)
            split = split.dictionary_encode()
            names, which = split.dictionary, split.indices.to_numpy()
            known = subwords.numbered(names.to_numpy(zero_copy_only=False).tolist())
            inside = np.repeat(np.arange(len(n_words)), n_words)
            # Number 0 is the end.
            words = np.zeros(len(which) + len(n_words), np.int64)
            words[np.arange(len(which)) + inside] = known[which]
            n_tokens = n_words + 1
            told, lengths = subwords.laid(words, n_tokens)
            flat, room = led(number[told], lengths, number[end])
            places = np.cumsum(room) - room
            count = -(-lengths // CHUNK)
            document = np.repeat(np.arange(len(lengths)), count)
            run = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            first = places[document] + run * CHUNK
            last = np.minimum(first + AGAIN + 1 + CHUNK, (places + room)[document])
            keys = batch.column("row_key").to_numpy().view(np.uint64)
            cell = (mixed(keys[document] + mixed(run.astype(np.uint64))) % np.uint64(rounds * shards)).astype(np.int64)
            held = batch.column("held").to_numpy(zero_copy_only=False)[document]
            blobs = [flat[f:t].tobytes() for f, t in zip(first.tolist(), last.tolist(), strict=True)]

            def once(values):
                # In the first run of each row, 0 in the others.
                return np.where(run == 0, values[document], values.dtype.type(0))

            starts = np.cumsum(n_tokens) - n_tokens
            each = subwords.share[words]
            rare = np.isnan(each)
            # Rare words of each document with their number of times.
            at = np.flatnonzero(np.isnan(subwords.share[known])[which]) if shares else np.zeros(0, np.int64)
            pairs, times = np.unique(inside[at] * len(names) + which[at], return_counts=True)
            others = names.take(pa.array(pairs % max(len(names), 1))).cast(pa.binary())
            others = pa.StructArray.from_arrays([others, pa.array(times, pa.int64())], names=["word", "times"])
            cuts = np.searchsorted(pairs // max(len(names), 1), np.append(document, len(n_words)) + np.append(run > 0, False))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(document)), batch.column("text_key").take(pa.array(document)), pa.array(run, pa.int32()),
                    pa.array(cell // rounds, pa.int32()), pa.array(blobs, pa.binary()), pa.array(once(n_tokens), pa.int64()),
                    pa.array(once(np.add.reduceat((~rare).astype(np.int64), starts)), pa.int64()),
                    pa.array(once(np.add.reduceat(np.where(rare, 0.0, each), starts)), pa.float64()),
                    pa.array(once(np.add.reduceat(spread[told], np.cumsum(lengths) - lengths, dtype=float)), pa.float64()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), others), pa.array(np.where(held, -1, cell % rounds), pa.int32()),
                ],
                ["doc_id", "text_key", "run", "shard", "numbers", "n_tokens", "n_known", "base_score", "score", "tail", "round"],
            )

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of().alias("text"),
        F.xxhash64(text_of()).alias("text_key"),
        F.xxhash64(F.col("doc_id").cast("long"), text_of()).alias("row_key"),
        held_out().alias("held"),
    )
    return rows.mapInArrow(dealt, RUNS)


#: Rows of `_encoded`; they are stored by round.
RUNS = (
    "doc_id long, text_key long, run int, shard int, numbers binary, n_tokens long, n_known long, base_score double, score double, "
    "tail array<struct<word: binary, times: long>>, round int"
)


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all runs in a row, and the length of each."""
    return np.frombuffer(b"".join(blobs), np.int16), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 2


def _pair_counts(runs: DataFrame) -> np.ndarray:
    """How often each number follows each number in the training texts, INPUTS x INPUTS."""

    def counted(batches):
        tally, cells, held = np.zeros(INPUTS * INPUTS, np.int64), [], 0
        for batch in batches:
            flat, lengths = _joined(batch.column("numbers").to_pylist())
            flat = flat.astype(np.int64)
            # Of each run, the places from the last one before its own numbers on; its last has no follower.
            first = np.ones(len(flat), bool)
            starts = np.cumsum(lengths) - lengths
            first[(starts[:, None] + np.arange(AGAIN)).reshape(-1)] = False
            first[starts + lengths - 1] = False
            at = np.flatnonzero(first)
            cells.append(flat[at] * INPUTS + flat[at + 1])
            held += len(at)
            if held > INPUTS * INPUTS:
                tally += np.bincount(np.concatenate(cells), minlength=len(tally))
                cells, held = [], 0
        if held:
            tally += np.bincount(np.concatenate(cells), minlength=len(tally))
        some = np.flatnonzero(tally)
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(tally[part])], ["cell", "c"])

    # At most INPUTS x INPUTS rows.
    rows = runs.select("numbers").mapInArrow(counted, "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(INPUTS * INPUTS)
    out[rows["cell"].to_numpy()] = rows["c"].to_numpy()
    return out.reshape(INPUTS, INPUTS)


def _fitted(runs: DataFrame, model: Model, shards: int, passes: int, done: int) -> DataFrame:
    """(part, n, plain, loss, weights): windows, losses of the counts and first losses of all shards of a part, and the sum of their weights, each times its windows."""
    shared = runs.sparkSession.sparkContext.broadcast((model.weights, model.prior, model.kind))

    def fit(batches):
        one_thread()
        weights, prior, kind = shared.value
        found: dict[int, list[bytes]] = {}
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                found.setdefault(shard, []).append(blob)
        for shard in sorted(found):
            # The order does not depend on the partitions.
            rows = windows_of(*_joined(sorted(found.pop(shard))))[0]
            own = {k: v.copy() for k, v in weights.items()}
            loss = train(own, prior, kind, rows, passes, RATE * COOLING**done, seed=done * 1_000_003 + shard)
            wanted = rows[:, AGAIN + 1 :]
            # What the counts alone lose on the same subwords.
            plain = -float(prior[rows[:, AGAIN:SPAN], kind[wanted]][wanted >= 0].sum(dtype=float))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([plain]), pa.array([loss]),
                    pa.array([(_packed(own).astype(float) * len(rows)).tobytes()], pa.binary()),
                ],
                ["shard", "n", "plain", "loss", "weights"],
            )

    def added(batches):
        n, plain, loss, total, part = 0, 0.0, 0.0, 0.0, None
        for batch in batches:
            for row in batch.to_pylist():
                n, plain, loss = n + row["n"], plain + row["plain"], loss + row["loss"]
                total, part = total + np.frombuffer(row["weights"]), row["shard"] % PARTS
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([plain]), pa.array([loss]), pa.array([total.tobytes()], pa.binary())],
                ["part", "n", "plain", "loss", "weights"],
            )

    each = runs.select("shard", "numbers").repartitionById(shards, F.col("shard"))
    each = each.mapInArrow(fit, "shard int, n long, plain double, loss double, weights binary")
    # The driver gets PARTS sums, whatever the number of shards.
    dealt = each.repartitionById(PARTS, F.col("shard") % PARTS).sortWithinPartitions("shard")
    return dealt.mapInArrow(added, "part int, n long, plain double, loss double, weights binary")


def language_model_scores(
    documents: DataFrame, path: str = TOKENIZER, shard_windows: int = 32_768, rounds: int = 16, least_gain: float | None = None
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    All training rows are counted, of words, subwords and neighbours, and attention learns from all their windows; `shard_windows`
    is what one task learns from in a round, `rounds` how often weights are averaged, `least_gain` ends them early (see `learn`).

    Rows with a null doc_id teach and are not held out; a null text is an empty one, whose only token is
    its end. Rows equal in doc_id and text have equal results. Other columns are not read.
    """
    spark = documents.sparkSession
    counts = written(word_counts(documents), "lm-words")
    # Distinct tokens, all tokens, ends.
    known = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"), F.max(F.when(F.length("word") == 0, F.col("c"))).alias("ends")).first()
    total, distinct, ends = known.n or 0, known.v, known.ends or 0
    floor = np.log10(total + 0.1 * (distinct + 1))
    head = counts.where((F.length("word") > 0) & (F.col("c") * HEAD_WORDS >= total)).toPandas()
    shares = {bytes(w): float(np.log10(c + 0.1) - floor) for w, c in zip(head["word"], head["c"].tolist(), strict=True)}
    shares[b""] = float(np.log10(ends + 0.1) - floor)

    # Every row is encoded once, for the training and for its score.
    ids = _id_counts(counts, path) if total > ends else _no_ids(path)
    shards, passes = _shards(ids, shard_windows, rounds)
    table = fresh_path(spark, "lm-runs")
    _encoded(documents, ids, path, rounds, shards, shares).write.partitionBy("round").option("compression", "zstd").parquet(table)
    runs = spark.read.schema(RUNS).parquet(table)
    shared = spark.sparkContext.broadcast(_learned(runs.where("round >= 0"), ids, shards, passes, rounds, least_gain))

    def scored(batches):
        one_thread()
        model = shared.value
        for batch in slices(batches, 1 << 20):
            flat, lengths = _joined(batch.column("numbers").to_pylist())
            own = lengths - AGAIN - 1
            score = np.add.reduceat(model.of_numbers(flat, lengths), np.cumsum(own) - own, dtype=float) + batch.column("score").to_numpy()
            kept = ["doc_id", "text_key", "run", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], [*kept, "score"])

    kept = "doc_id", "text_key", "run", "numbers", "n_tokens", "n_known", "base_score", "score"
    schema = "doc_id long, text_key long, run int, n_tokens long, n_known long, base_score double, score double"
    every = written(runs.select(*kept).mapInArrow(scored, schema), "lm-scores")
    first = every.where("run = 0")
    # The end stands in training texts only if there are any.
    first = first.withColumn("n_known", F.col("n_known") - F.lit(int(ends == 0)))

    zero = F.lit(0.0)
    tail = runs.where(F.size("tail") > 0).select("doc_id", "text_key", F.explode("tail").alias("rare"))
    tail = tail.select("doc_id", "text_key", "rare.word", "rare.times").join(counts, "word", "left")
    parts = tail.select(
        "doc_id",
        "text_key",
        (F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 0.1) - F.lit(float(floor)))).alias("more"),
        F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("more_known"),
        zero.alias("more_score"),
        F.lit(0).alias("copy"),
    )
    later = every.where("run > 0").select("doc_id", "text_key", zero, F.lit(0).cast("long"), "score", F.lit(0))
    # Rows that are repeated as a whole come together here; each of them has one run 0.
    rows = first.select("doc_id", "text_key", zero, F.lit(0).cast("long"), zero, F.lit(1))
    missing = (
        parts.union(later)
        .union(rows)
        .groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
        .agg(
            F.sum("copy").alias("copies"),
            F.sum("more").alias("more"),
            F.sum("more_known").alias("more_known"),
            F.sum("more_score").alias("more_score"),
        )
        .select("id", "key", *((F.col(c) / F.col("copies")).alias(c) for c in ("more", "more_score")), (F.col("more_known") / F.col("copies")).cast("long").alias("more_known"))
    )
    missing = written(missing, "lm-rest")
    remove(spark, table)
    return first.join(missing, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left").select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
