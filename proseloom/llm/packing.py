"""Best-two-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.session import cut_lineage

END_ID = 1
SEQUENCE = 4096
#: Entries of the word cache of one worker; it starts anew when full.
CACHE_WORDS = 600_000
#: Words of these characters alone fall into runs of letters, single digits and
#: runs of signs, and change only by lower-casing; others go through the tokenizer whole.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-_{-~]+")
_RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """Letter of every byte in byte-level vocabularies: printable ones stand for themselves, others follow 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class WordEncoder:
    """Token ids of whole texts, word by word.

    White space always separates tokens of this vocabulary, so the ids of a
    text are those of its words; each distinct word is encoded once while it
    stays in the cache.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        self._id = [i.to_bytes(4, "little") for i in range(self._tokenizer.get_vocab_size())]
        self._words: dict[str, bytes] = {"": b""}

    def _run(self, run: str) -> bytes:
        spelled = run if run.isascii() else run.encode().decode("latin-1").translate(self._letters)
        ids = b"".join([self._id[t.id] for t in self._model.tokenize(spelled)])
        self._words[run] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            known, runs = self._words, _RUNS.findall(word.lower())
            if len(runs) == 1:
                return known.get(runs[0]) or self._run(runs[0])
            return b"".join([known.get(run) or self._run(run) for run in runs])
        return np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self._words
        found = list(map(known.get, words))
        if None in found:
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                word = words[at]
                ids = known.get(word)
                if ids is None:
                    known[word] = ids = self._word(word)
                found[at] = ids
        ids = b"".join(found)
        if len(known) > CACHE_WORDS:
            self._words = {"": b""}
        return ids


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One encoder per worker and file, kept between batches."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE,
    end_id: int = END_ID,
) -> DataFrame:
    """(id, piece, start, length, ids): every document as token ids with ``end_id`` behind it.

    ``ids`` is binary, little-endian unsigned 32-bit.  Only documents above
    ``length`` tokens are cut, into pieces of that length and a shorter last
    one.  A null text is an empty one and gives the single ``end_id``.
    """
    tail = np.array([end_id], dtype="<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = _encoder(tokenizer).ids
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, texts = [], part.column(1).to_pylist()
                for at, text in enumerate(texts):
                    ids = encode(text or "") + tail
                    for piece, begin in enumerate(range(0, len(ids), 4 * length)):
                        cut = ids[begin : begin + 4 * length]
                        rows.append((at, piece, begin // 4, len(cut) // 4, cut))
                at, piece, begin, size, cuts = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(begin, pa.int64()),
                        pa.array(size, pa.int64()), pa.array(cuts, pa.binary()),
                    ],
                    names=["id", "piece", "start", "length", "ids"],
                )

    made = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids binary"
    )
    return made.withColumnRenamed("id", id_col)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indexes into ``lengths``, none above ``capacity``.

    Each bin takes the largest items that still fit.  Then its smallest item
    gives way to the two waiting items that fill the gap so widened most
    tightly, if that leaves the bin fuller; the item returns to the waiting.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for at in sorted(range(len(lengths)), reverse=True):
        waiting[lengths[at]].append(at)
    sizes = sorted(size for size in range(capacity + 1) if waiting[size])

    def take(size: int) -> int:
        at = waiting[size].pop()
        if not waiting[size]:
            del sizes[bisect_left(sizes, size)]
        return at

    def give(size: int, at: int) -> None:
        if not waiting[size]:
            insort(sizes, size)
        waiting[size].append(at)

    def pair(gap: int, above: int) -> tuple[int, int] | None:
        """Two waiting sizes of the largest sum within ``gap`` and over ``above``."""
        best, chosen, low, high = above, None, 0, len(sizes) - 1
        while low <= high:
            total = sizes[low] + sizes[high]
            if total > gap or (low == high and len(waiting[sizes[low]]) < 2):
                high -= 1
                continue
            if total > best:
                best, chosen = total, (sizes[low], sizes[high])
                if best == gap:
                    break
            low += 1
        return chosen

    bins = []
    while sizes:
        inside, gap = [], capacity
        while sizes and sizes[0] <= gap:
            fit = len(sizes) - 1 if sizes[-1] <= gap else bisect_left(sizes, gap + 1) - 1
            size = sizes[fit]
            inside.append((size, take(size)))
            gap -= size
        if gap and len(inside) > 1 and sizes:
            small, at = inside[-1]
            chosen = pair(gap + small, small)
            if chosen:
                inside[-1:] = [(size, take(size)) for size in chosen]
                give(small, at)
        bins.append([at for _, at in inside])
    return bins


def _pack_group(capacity: int, open_below: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "item"], kind="stable").reset_index(drop=True)
        bins = best_two_fit(items["length"].tolist(), capacity)
        sequence, offset = np.empty(len(items), np.int64), np.empty(len(items), np.int64)
        full = np.empty(len(items), bool)
        size, name = items["length"].to_numpy(), items["item"].to_numpy()
        for inside in bins:
            ends = np.cumsum(size[inside])
            sequence[inside] = name[inside].min()
            offset[inside] = ends - size[inside]
            full[inside] = ends[-1] >= open_below
        return pd.DataFrame({"item": name, "length": size, "sequence_id": sequence, "offset": offset, "full": full})

    return run


def pack(
    items: DataFrame, capacity: int = SEQUENCE, group_rows: int = 20_000, slack: int = 8, rounds: int = 8
) -> DataFrame:
    """(item, sequence_id, offset) for a table of (item long, length long).

    Items are packed in random groups of about ``group_rows``; what lies in
    sequences with more than ``slack`` tokens to spare goes on to another round
    with fewer groups, so that only the last round leaves sequences badly
    filled.  ``item`` must be unique; ``sequence_id`` is the least item of its
    sequence.  No length may exceed ``capacity``; an empty table gives an empty one.
    """
    left, done, count = items.select("item", "length"), [], items.count()
    for turn in range(rounds):
        groups = max(1, ceil(count / group_rows))
        last = groups == 1 or turn == rounds - 1
        grouped = left.withColumn("group", F.pmod(F.xxhash64(F.lit(turn), "item"), F.lit(groups)).cast("int"))
        packed = cut_lineage(
            grouped.groupBy("group").applyInPandas(
                _pack_group(capacity, 0 if last else capacity - slack),
                "item long, length long, sequence_id long, offset long, full boolean",
            )
        )
        done.append(packed.where("full").select("item", "sequence_id", "offset"))
        if last:
            break
        left = packed.where("not full").select("item", "length")
        remaining = left.count()
        if not remaining:
            break
        if remaining > 0.9 * count:
            rounds = turn + 2
        count = remaining
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
