"""Runs of words that repeat with a period, found by block convolution.

A run of period q and at least 4q words holds an aligned block of L words,
L the power of two with L <= q < 2L, that occurs again q words later.  So at every
scale L each block is matched with the window of starts L to 2L - 1 words
behind it: the sum of squared differences of word numbers, by number theoretic
transforms, is zero exactly where the block occurs.  The distance is a candidate
period, which is then extended word by word to both sides.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least length of a run in words, and in periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Primes with a root of unity of order 2^26 at least, and a generator of each.
#: Their product exceeds the largest sum of squares of any text.
PRIMES = ((2281701377, 3), (2013265921, 31), (469762049, 3))
#: Elements transformed at once, and characters of the texts searched at once.
STEP = 1 << 18
SLICE_CHARS = 1_000_000


def _powers(base: int, size: int, p: int) -> np.ndarray:
    """base^0 .. base^(size-1) modulo p, by doubling."""
    out = np.ones(size, np.uint64)
    done, step = 1, base % p
    while done < size:
        more = min(done, size - done)
        out[done : done + more] = out[:more] * np.uint64(step) % np.uint64(p)
        done, step = done + more, step * step % p
    return out


def _transform(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """Transform of every row, in bit-reversed order; ``root`` has the order of the row's size."""
    rows, size = x.shape
    q, half = np.uint64(p), size // 2
    while half:
        twist = _powers(pow(root, size // (2 * half), p), half, p)
        pair = x.reshape(rows, -1, 2, half)
        u, v = pair[:, :, 0], pair[:, :, 1]
        x = np.stack([(u + v) % q, (u + (q - v)) % q * twist % q], 2)
        half //= 2
    return x.reshape(rows, size)


def _restore(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """Inverse of :func:`_transform`."""
    rows, size = x.shape
    q, half, back = np.uint64(p), 1, pow(root, p - 2, p)
    while half < size:
        twist = _powers(pow(back, size // (2 * half), p), half, p)
        pair = x.reshape(rows, -1, 2, half)
        u, v = pair[:, :, 0], pair[:, :, 1] * twist % q
        x = np.stack([(u + v) % q, (u + (q - v)) % q], 2)
        half *= 2
    return x.reshape(rows, size) * np.uint64(pow(size, p - 2, p)) % q


def mismatches(blocks: np.ndarray, windows: np.ndarray, p: int, g: int) -> np.ndarray:
    """Sums of squared differences modulo p of each block of L with its window at offsets 0 to L - 1.

    ``windows`` has rows of 2L - 1 values; all values lie in 0 to p - 1.
    """
    rows, length = blocks.shape
    size, q = 2 * length, np.uint64(p)
    root = pow(g, (p - 1) // size, p)
    turned, wide = np.zeros((rows, size), np.uint64), np.zeros((rows, size), np.uint64)
    turned[:, :length] = blocks[:, ::-1]
    wide[:, :-1] = windows
    crossed = _restore(_transform(turned, p, root) * _transform(wide, p, root) % q, p, root)[:, length - 1 : size - 1]
    own = (blocks.astype(np.uint64) ** np.uint64(2) % q).sum(1, dtype=np.uint64)[:, None] % q
    sums = np.zeros((rows, size), np.uint64)
    np.cumsum(wide[:, :-1] ** np.uint64(2) % q, axis=1, out=sums[:, 1:])
    theirs = (sums[:, length:] - sums[:, :length]) % q
    return (own + theirs + (q - crossed) * np.uint64(2)) % q


def occurrences(blocks: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of every zero sum of squared differences; exact, as enough primes are used."""
    largest = int(max(blocks.max(initial=0), windows.max(initial=0)))
    bound, product, zero = blocks.shape[1] * largest**2, 1, None
    for p, g in PRIMES:
        found = mismatches(blocks, windows, p, g) == 0
        zero = found if zero is None else zero & found
        product *= p
        if product > bound:
            return np.nonzero(zero)
    raise ValueError("texts of over 2^28 words are not supported")


def _prime_divisors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def _agree(x: np.ndarray, y: np.ndarray, back: bool) -> int:
    """How many leading (or, going back, trailing) values of two equally long arrays agree; in growing steps."""
    done, step, size = 0, 64, len(x)
    while done < size:
        to = min(size, done + step)
        part = x[size - to : size - done] != y[size - to : size - done] if back else x[done:to] != y[done:to]
        if part.any():
            return done + int(part[::-1].argmax() if back else part.argmax())
        done, step = to, step * 4
    return size


def find_runs(words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of texts laid on end.

    ``words`` numbers the words of each text from 0; text k lies in
    ``starts[k]:starts[k + 1]``.  Runs have their smallest period, at least
    ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods, and cannot be extended.
    """
    total = len(words)
    sizes = np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = starts[1:][text]
    # Distance to the next occurrence of the same word in the text.
    most = int(words.max(initial=0)) + 1
    order = np.argsort(text * most + words, kind="stable")
    ahead = np.full(total, total + 1, np.int64)
    same = (words[order[1:]] == words[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    ahead[order[:-1][same]] = np.diff(order)[same]
    reach, runs, length, far = np.zeros(total, np.int64), set(), 1, ahead
    while 0 < length * LEAST_PERIODS <= sizes.max(initial=0):
        # A block can only recur within its window if each of its words does, and
        # inside a known run of a smaller period it would only show multiples of that.
        at = np.flatnonzero(far < 2 * length) * length
        at = at[reach[at] < np.minimum(at + 3 * length, end[at])]
        seeds = []
        for some in np.array_split(at, max(1, len(at) * 2 * length // STEP)):
            if len(some):
                blocks = words[some[:, None] + np.arange(length)]
                place = some[:, None] + np.arange(length, 3 * length - 1)
                # Behind the end of a text stands a number that no block holds.
                windows = np.where(place < end[some][:, None], words[np.minimum(place, total - 1)], most)
                row, offset = occurrences(blocks, windows)
                seeds.append(np.stack([length + offset, some[row]]))
        found = []
        if seeds:
            period, place = np.concatenate(seeds, 1)
            turn = np.lexsort((place, period))
            found = zip(period[turn].tolist(), place[turn].tolist())
        seen, until = 0, -1
        for period, place in found:
            if period == seen and place + length <= until:
                continue
            first, last = int(starts[text[place]]), int(end[place])
            back = _agree(words[first:place], words[first + period : place + period], True)
            on = _agree(words[place : last - period], words[place + period : last], False)
            start, stop = place - back, place + period + on
            seen, until = period, stop - period
            if stop - start >= max(LEAST_WORDS, LEAST_PERIODS * period) and (start, stop - start, period) not in runs:
                root = words[start : start + period]
                steps = [period // r for r in _prime_divisors(period)]
                if not any(np.array_equal(root[:-s], root[s:]) for s in steps):
                    runs.add((start, stop - start, period))
                    np.maximum(reach[start:stop], stop, out=reach[start:stop])
        far = far[: len(far) // 2 * 2].reshape(-1, 2).max(1)
        length *= 2
    return sorted(runs, key=lambda run: (run[0], run[2]))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _search(texts: list[str | None]):
    """(runs of each text, each text without its repeats)."""
    split = [(text or "").encode().split() for text in texts]
    numbers = []
    for words in split:
        number = defaultdict(count().__next__)
        numbers.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in numbers], dtype=np.int64)])
    runs = [[] for _ in texts]
    for start, length, period in find_runs(np.concatenate([*numbers, np.empty(0, np.int64)]), starts):
        k = int(np.searchsorted(starts, start, side="right")) - 1
        runs[k].append((start - int(starts[k]), length, period))
    collapsed = []
    for words, found in zip(split, runs):
        if found:
            keep = np.ones(len(words), bool)
            for start, length, period in found:
                keep[start + period : start + length] = False
            words = [words[k] for k in np.flatnonzero(keep).tolist()]
        collapsed.append(b" ".join(words))
    return runs, collapsed


def _slices(texts: list[str | None]):
    """Ranges of texts of about ``SLICE_CHARS`` characters, one text at least."""
    start, chars = 0, 0
    for at, text in enumerate(texts):
        chars += len(text or "")
        if chars > SLICE_CHARS:
            yield start, at + 1
            start, chars = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, collapsed): periodic runs of words of every whole text, and the text without its repeats.

    Words lie between ASCII white space.  ``runs`` holds (start, length, period)
    in words, by start, then period.  ``collapsed`` joins by one space the words
    that no run holds behind its first period.  Null and empty texts and those
    of white space have no runs and an empty ``collapsed``.  Every row gives one
    row, in any order; repeated and null ids stay apart; other columns are not
    read.  An empty table gives an empty one.  Nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in _slices(texts):
                runs, collapsed = _search(texts[start:end])
                offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                flat = np.array([x for found in runs for x in found], np.int64).reshape(-1, 3)
                held = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(offsets, held),
                     pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["id", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )
    return made.withColumnRenamed("id", id_col)
