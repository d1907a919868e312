"""Alignment of two tokenizers by inverted pair bitmaps.

Each text is encoded by a byte-level tokenizer (A) and a piece tokenizer (B). Where both end a token at the same
byte a group ends; an A and a B token whose bytes overlap are linked. How many documents hold a pair of
ids linked is counted with inverted bitmaps:

1. Documents are numbered in blocks. Neither tokenizer joins what a blank after a visible character parts, so
   texts are cut there, and each different stretch is aligned once. The bitmaps of the stretches that
   hold a pair are OR-merged into the pair's bitmap of the block; the times beyond the first are kept in
   bit planes. A bitmap is stored as sorted 16-bit places or, if shorter, as plain bits.
2. A pair's document count is the sum of its bitmaps' popcounts over all blocks; each A id's highest count
   comes from these.
3. The same bitmaps return the scores: a posting gives its document the pair's count as often as the planes say.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelog.llm.batches import slices, texts
from stridelog.llm.text import sized
from stridelog.session import written

BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents in a block at most, and stretches of documents that a task gathers before it writes bitmaps.
BLOCK, GATHERED = 1 << 16, 2_000_000
#: Stretches whose alignment is kept.
KEPT = 300_000
#: A pair is its A id and its B id in one number.
B_BITS = 20
#: Blocks whose scores a task adds up at a time.
OPEN = 16


class Stretches(dict):
    """A number for each stretch of text, in order of first use."""

    def __missing__(self, stretch: str) -> int:
        self[stretch] = number = len(self)
        return number


class Aligner:
    """Both tokenizers and the alignment of the stretches met lately."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        visible = _byte_letters()
        names = [self.a.id_to_token(i) or "" for i in range(1 + max(self.a.get_vocab().values()))]
        self.bytes_a = [bytes(visible[c] for c in token) if all(c in visible for c in token) else token.encode() for token in names]
        ids = range(self.b.get_piece_size())
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        self.lengths = [np.array([len(table[i]) for i in range(len(table))]) for table in (self.bytes_a, self.bytes_b)]
        # Cutting before a blank is only right if no piece has one after another character.
        self.cuts = not any(" " in piece.lstrip(b" ").decode("utf-8", "replace") for piece in self.bytes_b)
        self.clear()

    def clear(self) -> None:
        self.known = Stretches()
        self.done = 0
        #: Per stretch: whether both give its bytes, numbers of A and B tokens, groups and links, the groups as text.
        self.whole, self.sizes, self.groups = array("b"), array("q"), []
        #: The pairs linked in all stretches one after the other, and where a stretch begins.
        self.pairs, self.starts = array("q"), array("q", [0])

    def cut(self, text: str) -> list[str]:
        """The text with a blank before it, cut before every blank after a character that is no white space."""
        parts = text.split(" ") if self.cuts else [text]
        if not any(not p or p[-1].isspace() for p in parts):
            return parts
        out, open_ = [], False
        for part in parts:
            if open_:
                out[-1] += " " + part
            else:
                out.append(part)
            open_ = not part or part[-1].isspace()
        if not out[-1] and len(out) > 1:
            # A blank at the end: alone it would be no piece.
            out[-2:] = [out[-2] + " "]
        return out

    def numbers(self, text: str) -> list[int]:
        return [self.known[s] for s in self.cut(text)]

    def align(self) -> None:
        """Aligns the stretches that are new."""
        new = list(self.known)[self.done :]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            a = [e.ids for e in self.a.encode_batch([" " + s for s in some], add_special_tokens=False)]
            b = self.b.encode(some, num_threads=1)
            wanted = [(" " + s).encode() for s in some]
            joined = [b"".join(chain.from_iterable(map(table.__getitem__, ids) for ids in side)) for table, side in ((self.bytes_a, a), (self.bytes_b, b))]
            whole = [True] * len(some)
            if not joined[0] == joined[1] == b"".join(wanted):
                whole = [b"".join(map(self.bytes_a.__getitem__, x)) == b"".join(map(self.bytes_b.__getitem__, y)) == w for x, y, w in zip(a, b, wanted, strict=True)]
                a, b, wanted = ([x if ok else x[:0] for x, ok in zip(side, whole, strict=True)] for side in (a, b, wanted))
            self.whole.extend(whole)
            self._several(a, b, np.fromiter(map(len, wanted), np.int64, len(wanted)))
        self.done = len(self.known)

    def _several(self, a: list[list[int]], b: list[list[int]], sizes: np.ndarray) -> None:
        """Aligns stretches, told by their ids and numbers of bytes, as if they were one text."""
        counts = [np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b)]
        ids = [np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in zip((a, b), counts, strict=True)]
        ends = [np.cumsum(lengths[i]) for lengths, i in zip(self.lengths, ids, strict=True)]
        last = np.cumsum(sizes)
        # Between two neighbouring ends, of whichever side, lies the overlap of one A and one B token.
        cuts = np.union1d(*ends)
        both = np.intersect1d(*ends, assume_unique=True)
        pairs = ids[0][np.searchsorted(ends[0], cuts)] << B_BITS | ids[1][np.searchsorted(ends[1], cuts)]
        upto = np.searchsorted(cuts, last, "right")
        groups = np.diff(np.searchsorted(both, last, "right"), prepend=0)
        self.sizes.frombytes(np.stack([*counts, groups, np.diff(upto, prepend=0)], axis=1).astype(np.int64).tobytes())
        self.starts.frombytes((upto + self.starts[-1]).astype(np.int64).tobytes())
        self.pairs.frombytes(pairs.tobytes())

        # Written as text: the A ids of a group, then its B ids, each with the sign that follows it.
        group = [np.searchsorted(both, e) for e in ends]
        closes = [np.isin(e, both, assume_unique=True) for e in ends]
        follow = [np.where(closes[0], "|", ","), np.where(closes[1], np.where(np.isin(ends[1], last), "", ";"), ",")]
        signs = np.concatenate(follow).tolist()
        told = list(map(str.__add__, map(str, np.concatenate(ids).tolist()), signs))
        order = np.lexsort((np.repeat([0, 1], [len(g) for g in group]), np.concatenate(group)))
        told = [told[i] for i in order.tolist()]
        at = 0
        for n in (counts[0] + counts[1]).tolist():
            self.groups.append("".join(told[at : at + n]))
            at += n


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: visible bytes for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    """One per Python worker, kept from task to task."""
    return Aligner(byte_path, piece_path)


def or_merged(stretch: np.ndarray, document: np.ndarray, times: np.ndarray, aligner: Aligner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, document, links) by pair and document: the OR of the bitmaps of all stretches with the pair."""
    starts, pairs = np.array(aligner.starts), np.array(aligner.pairs)
    counts = np.diff(starts)[stretch]
    upto = np.cumsum(counts)
    at = np.repeat(starts[stretch] - (upto - counts), counts) + np.arange(int(counts.sum()))
    places = pairs[at] * BLOCK + np.repeat(document, counts)
    links = np.repeat(times, counts)
    order = np.argsort(places, kind="stable")
    places = places[order]
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])) if len(places) else np.zeros(0, np.int64)
    merged = np.add.reduceat(links[order], first) if len(first) else np.zeros(0, np.int64)
    return places[first] // BLOCK, places[first] % BLOCK, merged


def bitmaps(pairs: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """One bitmap for each run of a pair: the pair, its popcount, whether it is plain bits, and the bytes."""
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(pairs)))
    # A plain bitmap reaches to its last document.
    plain_size = documents[np.append(first, len(pairs))[1:] - 1] // 8 + 1 if len(first) else counts
    plain = plain_size < 2 * counts
    sizes = np.where(plain, plain_size, 2 * counts)
    ends = np.cumsum(sizes)
    out = np.empty(int(sizes.sum()), np.uint8)
    out[np.repeat(~plain, sizes)] = documents[np.repeat(~plain, counts)].astype("<u2").view(np.uint8)
    for i in np.flatnonzero(plain).tolist():
        bits = np.zeros(int(sizes[i]) * 8, bool)
        bits[documents[first[i] : first[i] + counts[i]]] = True
        out[ends[i] - sizes[i] : ends[i]] = np.packbits(bits)
    offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
    data = pa.Array.from_buffers(pa.large_binary(), len(first), [None, offsets, pa.py_buffer(out)])
    return pairs[first], counts, plain, data.cast(pa.binary())


def places(plain: np.ndarray, counts: np.ndarray, data: pa.Array) -> np.ndarray:
    """The documents of all bitmaps, one after the other."""
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    ends = np.cumsum(counts)
    out = np.empty(int(counts.sum()), np.int64)
    out[np.repeat(~plain, counts)] = raw[np.repeat(~plain, sizes)].view("<u2")
    for i in np.flatnonzero(plain).tolist():
        bits = raw[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]]
        out[ends[i] - counts[i] : ends[i]] = np.flatnonzero(np.unpackbits(bits))
    return out


COLUMNS = "block long, document int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, plane int, n long, plain boolean, bits binary"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def _postings(documents: DataFrame, byte_name: str, piece_name: str) -> DataFrame:
    """Rows of documents (pair is null) and bitmaps of pairs: plane -1 has the documents, plane k those with bit k of (links - 1)."""

    def rows(length: int, **columns) -> pa.RecordBatch:
        kinds = {"document": pa.int32(), "plane": pa.int32(), "groups_sha256": pa.string(), "plain": pa.bool_(), "bits": pa.binary()}
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(length, kinds.get(c, pa.int64())) for c in NAMES], NAMES)

    def made(batches):
        aligner = _aligner(SparkFiles.get(byte_name), SparkFiles.get(piece_name))
        block, count, gathered = TaskContext.get().partitionId() << 24, 0, []

        def out():
            stretch, document, times = (np.concatenate([g[i] for g in gathered]) for i in range(3))
            pairs, documents_, links = or_merged(stretch, document, times, aligner)
            for plane in range(-1, int(links.max(initial=1) - 1).bit_length()):
                wanted = links > 0 if plane < 0 else (links - 1) >> plane & 1 > 0
                names, popcounts, plain, bits = bitmaps(pairs[wanted], documents_[wanted])
                n = len(names)
                yield rows(n, block=np.full(n, block), pair=names, plane=np.full(n, plane, np.int32), n=popcounts, plain=plain, bits=bits)

        for batch in slices(batches):
            ids = batch.column("doc_id")
            if len(aligner.known) > KEPT or count + batch.num_rows > BLOCK or sum(len(g[0]) for g in gathered) > GATHERED:
                if gathered:
                    yield from out()
                block, count, gathered = block + 1, 0, []
                if len(aligner.known) > KEPT:
                    aligner.clear()
            numbers = []
            for text in texts(batch):
                try:
                    numbers.append(aligner.numbers(text.decode()) if text else [])
                except UnicodeDecodeError:
                    numbers.append([])
            aligner.align()
            whole, sizes = aligner.whole, np.array(aligner.sizes).reshape(-1, 4)
            numbers = [n if all(map(whole.__getitem__, n)) else [] for n in numbers]
            shas = [hashlib.sha256(";".join([aligner.groups[s] for s in n]).encode()).hexdigest() if n else "" for n in numbers]
            lengths = np.array([len(n) for n in numbers])
            document = np.repeat(np.arange(count, count + len(numbers)), lengths)
            stretch = np.fromiter((s for n in numbers for s in n), np.int64, int(lengths.sum()))
            totals = np.zeros((len(numbers), 4), np.int64)
            np.add.at(totals, document - count, sizes[stretch])
            keys, times = np.unique(document * (1 << 32) + stretch, return_counts=True)
            gathered.append((keys & 0xFFFFFFFF, keys >> 32, times))
            n = len(numbers)
            numbered = pa.array(np.arange(count, count + n).astype(np.int32))
            yield rows(n, block=np.full(n, block), document=numbered, doc_id=ids, n_a=totals[:, 0], n_b=totals[:, 1], n_groups=totals[:, 2], n_links=totals[:, 3], groups_sha256=shas)
            count += n
        if gathered:
            yield from out()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(made, COLUMNS)


def aligned(documents: DataFrame, byte_path: str = BYTE_TOKENIZER, piece_path: str = PIECE_TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """Two tables: the documents of `alignment_report`, and the pairs (a, b, n_documents, n_links, best).

    n_documents is how many documents hold the pair linked, n_links how often it is linked, best whether no
    pair with the same A id has more documents.
    """
    for path in (byte_path, piece_path):
        documents.sparkSession.sparkContext.addFile(path)
    stored = written(_postings(documents, os.path.basename(byte_path), os.path.basename(piece_path)), "alignment")
    postings = stored.where("pair IS NOT NULL").select("block", "pair", "plane", "n", "plain", "bits")
    links = F.col("n") * F.expr("shiftleft(1L, greatest(plane, 0))")
    totals = postings.groupBy("pair").agg(F.sum(F.when(F.col("plane") < 0, F.col("n"))).alias("n_documents"), F.sum(links).alias("n_links"))
    totals = written(totals.withColumn("a", F.shiftright("pair", B_BITS)), "alignment-pairs")
    most = totals.groupBy("a").agg(F.max("n_documents").alias("most"))
    scores = written(totals.join(most, "a").withColumn("best", F.col("n_documents") == F.col("most")), "alignment-scores")
    narrow = scores.select("pair", F.col("n_documents").alias("score"), "best")
    hinted = sized(narrow)
    weighed = postings.join(hinted, "pair")
    if hinted is narrow:  # too many to be sent to all tasks
        weighed = weighed.repartition("block").sortWithinPartitions("block")
    returned = weighed.mapInArrow(_returned, "block long, document int, n_best long, count_sum long")
    returned = returned.groupBy("block", "document").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    numbered = stored.where("pair IS NULL").select("block", "document", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    report = numbered.join(returned, ["block", "document"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"
    )
    return report, scores.select("a", F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b"), "n_documents", "n_links", "best")


def _returned(batches):
    """Scores of documents, added up block by block."""
    sums: dict[int, np.ndarray] = {}

    def out():
        for block, (best, score) in sums.items():
            at = np.flatnonzero(score)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(score[at])], ["block", "document", "n_best", "count_sum"]
            )

    for batch in slices(batches):
        block, plane, n, plain, score, best = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "plane", "n", "plain", "score", "best"))
        weight = np.where(plane < 0, 1, 1 << np.maximum(plane, 0).astype(np.int64))
        document = places(plain.astype(bool), n, batch.column("bits"))
        for one in np.unique(block).tolist():
            own = np.repeat(block == one, n)
            if one not in sums:
                if len(sums) >= OPEN:
                    yield from out()
                    sums.clear()
                sums[one] = np.zeros((2, BLOCK), np.int64)
            np.add.at(sums[one][0], document[own], np.repeat(weight * best, n)[own])
            np.add.at(sums[one][1], document[own], np.repeat(weight * score, n)[own])
    yield from out()


def alignment_report(documents: DataFrame, byte_path: str = BYTE_TOKENIZER, piece_path: str = PIECE_TOKENIZER) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    n_best counts the links whose pair has as many documents as any pair of its A id, count_sum adds up the
    documents of all links' pairs. Null and empty texts, texts that a tokenizer does not give back byte
    by byte and texts that are not valid UTF-8 have no tokens: zeros, and an empty groups_sha256. Every
    row counts as a document, repeated rows and rows with a repeated or null doc_id, too. Other columns are not
    read. An empty table gives an empty result.
    The two files are sent from the driver to the executors.
    """
    return aligned(documents, byte_path, piece_path)[0]
