"""Alignment of two tokenizers over the same text: a byte-level one (A) and a piece model (B).

Both encode a space and the text.  Where A and B tokens end at the same byte the
text is cut into groups, and the two tokens that end there are linked.  Cuts are
first looked for in the spans the tokenizers give (character offsets of A, the
spans of B's proto); tokens that hold part of a character, and byte pieces,
carry no usable span and are placed by the lengths of their decoded bytes.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proseloom.llm.packing import _byte_letters
from proseloom.operators.lookup import salted_lookup
from proseloom.session import cut_lineage

#: Stretches between spaces, and characters of them, that a worker remembers; it starts anew when full.
CACHE_STRETCHES = 200_000
CACHE_CHARS = 8_000_000
#: New stretches encoded as one text.
TOGETHER = 500
#: Characters of the texts aligned at once; tokens of new stretches take some hundred times their bytes meanwhile.
SLICE_CHARS = 400_000
#: Id pairs up to which the table of counts is broadcast (about 80 MB); beyond, it is shuffled.
BROADCAST_PAIRS = 2_000_000
_SPACE = "▁"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: White space before a space: cutting there could part what a tokenizer keeps together.
_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")

def _spelled(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.large_binary())


def _taken(words: pa.Array, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the chosen words on end, and where each ends."""
    chosen = words.take(pa.array(index))
    ends = np.frombuffer(chosen.buffers()[1], np.int64, len(index) + 1)[1:] if len(index) else np.empty(0, np.int64)
    data = np.frombuffer(chosen.buffers()[2] or b"", np.uint8)
    return data, ends


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of the given starts and sizes, on end."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))


class SpanAligner:
    """Aligns texts with one pair of vocabularies."""

    def __init__(self, byte_vocab: str, piece_model: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(byte_vocab)
        self._a.encode_special_tokens = True
        self._b = SentencePieceProcessor(model_file=piece_model)
        byte_of = {letter: bytes([b]) for b, letter in _byte_letters().items()}
        tokens = [self._a.id_to_token(i) or "" for i in range(self._a.get_vocab_size())]
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self._byte_piece = np.array([self._b.is_byte(i) for i in range(len(pieces))])
        self._a_bytes = _spelled([b"".join(byte_of.get(c, c.encode()) for c in token) for token in tokens])
        self._b_bytes = _spelled([
            bytes([int(_BYTE_PIECE.fullmatch(p)[1], 16)]) if raw else p.replace(_SPACE, " ").encode()
            for p, raw in zip(pieces, self._byte_piece)
        ])
        self._sizes = [np.array([len(x) for x in w.to_pylist()], np.int64) for w in (self._a_bytes, self._b_bytes)]
        # Decimal ids with what follows them: inside a group, and at its end.
        self._both = _spelled([
            b"%d%s" % (i, end) for count, last in ((len(tokens), b"|"), (len(pieces), b";"))
            for end in (b",", last) for i in range(count)
        ])
        self._lone_space = self._b.piece_to_id(_SPACE)
        #: No piece crosses from another character to a space, so texts may be cut before one.
        self.cuttable = all(_SPACE not in p.lstrip(_SPACE) for p in pieces)
        self._reset()

    def _reset(self):
        self._known: dict[str, int] = {}
        self._held = 0
        self._groups: list[str] = []
        self._counts = np.empty((0, 3), np.int64)
        self._link_ends, self._links = np.zeros(1, np.int64), np.empty(0, np.int64)

    def _encode(self, texts: list[str]):
        """Tokens of A and of B over the texts on end: ids, tokens of each text, ends by span, which ends are sharp.

        Ends of A count characters from the first text on, those of B bytes.  An
        end is sharp if it lies between characters.
        """
        found = self._a.encode_batch(texts, add_special_tokens=False)
        lengths = np.fromiter((len(e.ids) for e in found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.int64, int(lengths.sum()))
        spans = np.fromiter(
            chain.from_iterable(chain.from_iterable(e.offsets for e in found)), np.int64, 2 * len(ids)).reshape(-1, 2)
        base = np.cumsum([0, *map(len, texts)])[:-1]
        ends = spans[:, 1] + np.repeat(base, lengths)
        starts = spans[:, 0] + np.repeat(base, lengths)
        sharp = np.append(starts[1:] >= ends[:-1], True) if len(ids) else np.empty(0, bool)
        a = (ids, lengths, ends, sharp)
        spaced = self._b.encode([t[1:] for t in texts], return_type="proto", num_threads=1)
        made = [[(p.id, p.end + 1) for p in x.pieces] or [(self._lone_space, 1)] for x in spaced]
        lengths = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(
            chain.from_iterable(chain.from_iterable(made)), np.int64, 2 * int(lengths.sum())).reshape(-1, 2)
        base = np.cumsum([0, *[len(t.encode()) for t in texts]])[:-1]
        return a, (flat[:, 0], lengths, flat[:, 1] + np.repeat(base, lengths), ~self._byte_piece[flat[:, 0]])

    def _whole(self, texts: list[str], side: int, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which texts the tokens of one side give back byte for byte."""
        raw = [t.encode() for t in texts]
        want = np.fromiter(map(len, raw), np.int64, len(raw))
        text_of = np.repeat(np.arange(len(texts)), lengths)
        good = np.bincount(text_of, self._sizes[side][ids], len(texts)).astype(np.int64) == want
        data, _ = _taken((self._a_bytes, self._b_bytes)[side], ids[good[text_of]])
        kept = np.flatnonzero(good)
        other = np.frombuffer(b"".join([raw[k] for k in kept]), np.uint8) != data
        wrong = np.bincount(np.repeat(kept, want[kept])[other], minlength=len(texts)) > 0
        return good & ~wrong

    def align(self, texts: list[str]):
        """Where the tokens of texts that start with a space end, and which end together.

        Returns which texts both sides give back whole and, over those on end:
        ids of A and of B, the bytes where they end, and the places in A and in B
        of the tokens that end together.
        """
        (a, a_n, _, _), (b, b_n, _, _) = sides = self._encode(texts)
        whole = self._whole(texts, 0, a, a_n) & self._whole(texts, 1, b, b_n)
        if not whole.all():
            texts = [t for t, good in zip(texts, whole) if good]
            sides = self._encode(texts)
        (a, _, a_ends, a_sharp), (b, _, b_ends, b_sharp) = sides
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        first_bytes = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        a_ends = self._placed(first_bytes[a_ends], a_sharp, self._sizes[0][a])
        b_ends = self._placed(b_ends, b_sharp, self._sizes[1][b])
        _, in_a, in_b = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        return whole, a, b, a_ends, b_ends, in_a, in_b

    @staticmethod
    def _placed(ends: np.ndarray, sharp: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Byte ends of tokens: the span's where it is sharp, else by decoded bytes behind the last sharp one."""
        so_far = np.cumsum(sizes)
        last = np.maximum.accumulate(np.where(sharp, np.arange(len(ends)), -1))
        since = np.where(last < 0, so_far, so_far - so_far[last] + ends[last])
        return np.where(sharp, ends, since)

    def _learn(self, stretches: list[str]) -> np.ndarray:
        """Numbers of new stretches, -1 where bytes get lost; encoded many in one text where they may stand together."""
        number = np.empty(len(stretches), np.int64)
        solid = [k for k, m in enumerate(stretches) if self.cuttable and m and not m[-1].isspace()]
        joined = [solid[i : i + TOGETHER] for i in range(0, len(solid), TOGETHER)]
        joined += [[k] for k in sorted(set(range(len(stretches))) - set(solid))]
        while joined:
            whole, at = self._add([[stretches[k] for k in group] for group in joined])
            kept = [k for group, good in zip(joined, whole) if good for k in group]
            number[kept] = at
            broken = [group for group, good in zip(joined, whole) if not good]
            number[[group[0] for group in broken if len(group) == 1]] = -1
            joined = [[k] for group in broken if len(group) > 1 for k in group]
        return number

    def _add(self, groups: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Which groups of stretches come back whole, each as one text, and the numbers given to their stretches."""
        whole, a, b, a_ends, b_ends, in_a, in_b = self.align([" " + " ".join(g) for g in groups])
        stops = np.cumsum([len(m.encode()) + 1 for g, good in zip(groups, whole) if good for m in g], dtype=np.int64)
        number = len(self._groups) + np.arange(len(stops))
        if not len(stops):
            return whole, number
        a_to, b_to = np.searchsorted(a_ends, stops, "right"), np.searchsorted(b_ends, stops, "right")
        cuts_to = np.searchsorted(a_ends[in_a], stops, "right")
        # Every token's place among both sides: behind the groups before its own.
        cut_a, cut_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        cut_a[in_a], cut_b[in_b] = True, True
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        place_a = np.arange(len(a)) + np.concatenate([[0], in_b + 1])[group_a]
        place_b = np.arange(len(b)) + in_a[group_b] + 1
        n_a, n_b = self._sizes[0].size, self._sizes[1].size
        spelled = np.empty(len(a) + len(b), np.int64)
        spelled[place_a] = a + n_a * cut_a
        spelled[place_b] = b + n_b * cut_b + 2 * n_a
        data, ends = _taken(self._both, spelled)
        told, text_ends = data.tobytes().decode(), ends[a_to + b_to - 1].tolist()
        self._groups += [told[i:j] for i, j in zip([0, *text_ends], text_ends)]
        counts = np.diff(np.stack([a_to, b_to, cuts_to], 1), axis=0, prepend=0)
        self._counts = np.concatenate([self._counts, counts])
        self._link_ends = np.concatenate([self._link_ends, self._link_ends[-1] + cuts_to])
        self._links = np.concatenate([self._links, a[in_a] << 32 | b[in_b]])
        return whole, number

    def _stretches(self, text: str) -> list[str]:
        """The text behind its added space, cut before spaces where both tokenizers start afresh."""
        if not self.cuttable:
            return [text]
        if _RUN.search(" " + text):
            return _CUT.split(text)
        return text.split(" ")

    def batch(self, texts: list[str | None]):
        """Per text (A tokens, B tokens, groups) and its groups spelled; per text and linked id pair, how often."""
        if len(self._groups) > CACHE_STRETCHES or self._held > CACHE_CHARS:
            self._reset()
        cut = [self._stretches(text) if text else [] for text in texts]
        new = list(set(chain.from_iterable(cut)) - self._known.keys())
        if new:
            self._known.update(zip(new, self._learn(new).tolist()))
            self._held += sum(map(len, new))
        numbers = [list(map(self._known.__getitem__, parts)) for parts in cut]
        # Where a stretch loses bytes the text as a whole decides.
        lost = [k for k, at in enumerate(numbers) if -1 in at]
        if lost:
            whole, at = self._add([[texts[k]] for k in lost])
            self._held += sum(len(texts[k]) for k in lost)
            alone = iter(at.tolist())
            for k, good in zip(lost, whole):
                numbers[k] = [next(alone)] if good else []
        told = ["".join([self._groups[k] for k in at])[:-1] for at in numbers]
        lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
        flat = np.fromiter(chain.from_iterable(numbers), np.int64, int(lengths.sum()))
        row, sizes = np.repeat(np.arange(len(texts)), lengths), np.zeros((len(texts), 3), np.int64)
        for k in range(3):
            sizes[:, k] = np.bincount(row, self._counts[flat, k], len(texts)) if len(flat) else 0
        # Each stretch of a text once, then each id pair of a text once.
        cells, times = np.unique(row * (len(self._groups) + 1) + flat, return_counts=True)
        row, flat = np.divmod(cells, len(self._groups) + 1)
        size = self._link_ends[flat + 1] - self._link_ends[flat]
        codes = self._links[_ranges(self._link_ends[flat], size)]
        pairs, pair_no = np.unique(codes, return_inverse=True)
        cells, back = np.unique(np.repeat(row, size) * (len(pairs) + 1) + pair_no, return_inverse=True)
        times = np.bincount(back, np.repeat(times, size)).astype(np.int64)
        row, pair = np.divmod(cells, len(pairs) + 1)
        return sizes, told, row, pairs[pair], times


_ALIGNERS: dict[tuple[str, str], SpanAligner] = {}


def _aligner(byte_vocab: str, piece_model: str) -> SpanAligner:
    """One aligner per worker and pair of files, kept between batches."""
    key = (byte_vocab, piece_model)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = SpanAligner(*key)
    return _ALIGNERS[key]


def _slices(lengths: list[int | None]):
    """Ranges of texts, given by their lengths, of about ``SLICE_CHARS`` characters, one text at least."""
    start, chars = 0, 0
    for at, length in enumerate(lengths):
        chars += length or 0
        if chars > SLICE_CHARS or at - start >= 1024:
            yield start, at + 1
            start, chars = at + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


_LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])


def align(
    docs: DataFrame, byte_vocab: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups, links): both tokenisations of every text and where they meet.

    ``groups`` spells ids like ``a1,a2|b1;a3|b2,b3``.  ``links`` holds each pair of
    ids (a, b) that ends together and how often (n) it does in the text.  A null
    or empty text, and one that either tokenizer does not give back byte for
    byte, has zero counts, an empty ``groups`` and no links.  Every row gives one
    row, in any order; repeated and null ids stay apart; other columns are not
    read.  Long texts are aligned whole.  An empty table gives an empty one.
    """

    def run(batches):
        aligner = _aligner(byte_vocab, piece_model)
        for batch in batches:
            lengths = pc.utf8_length(batch.column(1)).to_pylist()
            for start, end in _slices(lengths):
                sizes, whole, row, pairs, times = aligner.batch(batch.column(1).slice(start, end - start).to_pylist())
                offsets = np.searchsorted(row, np.arange(end - start + 1)).astype(np.int32)
                links = pa.StructArray.from_arrays(
                    [pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)),
                     pa.array(times.astype(np.int32))], fields=list(_LINK))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), *[pa.array(sizes[:, k]) for k in range(3)],
                     pa.array(whole, pa.string()), pa.ListArray.from_arrays(offsets, links)],
                    names=["id", "n_a", "n_b", "n_groups", "groups", "links"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"id {kind}, n_a long, n_b long, n_groups long, groups string, links array<struct<a:int,b:int,n:int>>"
    )
    return made.withColumnRenamed("id", id_col)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links of all texts hold a pair, and whether no other pair of its b holds more.

    One row per pair of ids that occurs; partial sums before the shuffle.  A b
    has as many pairs as A has ids at most, so the window is bounded.
    """
    counts = linked.select(F.inline("links")).groupBy("a", "b").agg(F.sum("n").cast("long").alias("count"))
    most = F.max("count").over(Window.partitionBy("b"))
    return counts.withColumn("best", F.col("count") == most)


def link_sums(linked: DataFrame, row_col: str) -> DataFrame:
    """(row, n_links, n_best, count_sum) for every row with links, by a unique row column.

    ``n_best`` counts the links whose pair no other pair of the same b exceeds
    over the whole table; ``count_sum`` adds up the counts of their pairs.  The
    counts are written once; they are broadcast up to ``BROADCAST_PAIRS`` rows
    and met through salted keys beyond.
    """
    counts = cut_lineage(pair_counts(linked))
    links = linked.select(row_col, F.inline("links"))
    if counts.count() <= BROADCAST_PAIRS:
        met = links.join(F.broadcast(counts), ["a", "b"])
    else:
        met = salted_lookup(links, counts, ["a", "b"], [row_col])
    n = F.col("n").cast("long")
    return met.groupBy(row_col).agg(
        F.sum(n).alias("n_links"), F.sum(F.when(F.col("best"), n).otherwise(0)).alias("n_best"),
        F.sum(n * F.col("count")).alias("count_sum"),
    )
