"""Language of every word, and of whole texts, by a linear-chain conditional random field."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.llm.sample import least_by_hash

#: Letters with the marks that belong to them.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"
#: Feature slots; affixes, n-grams and whole words share them by hash.
SLOTS = 1 << 16
#: Bounds of the sample the field is trained on: documents per language, and
#: the characters a sampled document may have.
SAMPLE_DOCS, SAMPLE_CHARS = 250, 20_000
CHAINS, CHAIN_WORDS, SEGMENT_WORDS = 1_500, 64, (3, 24)
EPOCHS, RATE, DECAY = 30, 0.3, 1e-4
#: Words of one step of the forward-backward pass over blocks.
BLOCK = 32
CACHE_WORDS = 400_000
#: Odd multiplier that spreads n-grams over the slots (the 64-bit FNV prime).
MIX = np.uint64(1099511628211)
BATCH_CHARS = 1_000_000


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of lower-case words, and the place of the word each slot belongs to.

    Every word has a slot for itself, its lexicon entry, and one per n-gram of
    two to four characters between its marked ends; n-grams that hold an end
    are its prefixes and suffixes of up to three letters.
    """
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    whole = [crc32(w.encode("utf-8", "surrogatepass")) % SLOTS for w in words]
    slots, owners = [np.array(whole, dtype=np.int64)], [np.arange(len(words))]
    for n in (2, 3, 4):
        last = len(codes) - n + 1
        mixed = np.full(max(last, 0), n, dtype=np.uint64)
        for i in range(n):
            mixed = (mixed ^ codes[i : i + len(mixed)]) * MIX
        inside = owner[: len(mixed)] == owner[n - 1 :]
        slots.append((mixed[inside] >> np.uint64(40)).astype(np.int64) % SLOTS)
        owners.append(owner[: len(mixed)][inside])
    return np.concatenate(slots), np.concatenate(owners)


def _sums(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``values`` added up by the place each belongs to."""
    return np.stack([np.bincount(at, values[:, c], size) for c in range(values.shape[1])], axis=1)


def forward_backward(potential: np.ndarray, step: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Posterior of every label at every word of many chains that lie end to end.

    ``potential`` is words x labels, ``step`` labels x labels, both positive.
    Chains are cut into blocks whose transfer matrices are multiplied for all
    blocks at once; a second pass over blocks gives the message at each border,
    a third the posteriors inside, so the result is exact.
    """
    labels = potential.shape[1]
    blocks_of = -(-sizes // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks_of)[:-1]])
    total = int(blocks_of.sum())
    chain = np.repeat(np.arange(len(sizes)), blocks_of)
    inside = np.arange(total) - first[chain]
    word_start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    begin = word_start[chain] + inside * BLOCK
    size = np.minimum(BLOCK, sizes[chain] - inside * BLOCK)
    place = np.minimum(begin[:, None] + np.arange(BLOCK), len(potential) - 1)
    live = np.arange(BLOCK) < size[:, None]
    cells = potential[place]

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.reshape(len(x), -1).max(axis=1).reshape((-1,) + (1,) * (x.ndim - 1))

    transfer = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for at in range(BLOCK):
        now = live[:, at]
        if now.any():
            moved = (transfer[now].reshape(-1, labels) @ step).reshape(-1, labels, labels) * cells[now, at][:, None, :]
            transfer[now] = scaled(moved)
    enter, leave = np.empty((total, labels)), np.empty((total, labels))
    message = np.full((len(sizes), labels), 1.0 / labels)
    back = np.ones((len(sizes), labels))
    most = int(blocks_of.max(initial=0))
    order = np.argsort(-blocks_of, kind="stable")
    active = np.searchsorted(-blocks_of[order], -np.arange(most), side="left")
    for at in range(most):
        who = order[: active[at]]
        block = first[who] + at
        enter[block] = message[who]
        message[who] = scaled(np.einsum("nl,nlm->nm", message[who], transfer[block]))
    for at in reversed(range(most)):
        who = order[: active[at]]
        block = first[who] + at
        leave[block] = back[who]
        back[who] = scaled(np.einsum("nlm,nm->nl", transfer[block], back[who]))
    ahead = np.empty((total, BLOCK, labels))
    message = enter
    for at in range(BLOCK):
        message = np.where(live[:, at, None], scaled((message @ step) * cells[:, at]), message)
        ahead[:, at] = message
    posterior = np.empty_like(ahead)
    back = leave
    for at in reversed(range(BLOCK)):
        now = live[:, at, None]
        posterior[:, at] = ahead[:, at] * back
        back = np.where(now, scaled((cells[:, at] * back) @ step.T), back)
    out = posterior[live]
    return out / out.sum(axis=1, keepdims=True)


class Field:
    """A trained field: languages, weight of every slot per language, and transitions."""

    def __init__(self, languages: list[str], weights: np.ndarray, moves: np.ndarray):
        self.languages, self.weights, self.step = languages, weights, np.exp(moves)
        self._index: dict[str, int] = {}
        self._rows = np.empty((0, len(languages)))

    def __getstate__(self):
        return self.languages, self.weights, self.step

    def __setstate__(self, state):
        self.languages, self.weights, self.step = state
        self._index, self._rows = {}, np.empty((0, len(self.languages)))

    def potentials(self, words: list[str]) -> np.ndarray:
        """Emission potentials of the words; those of known words are kept."""
        if len(self._index) > CACHE_WORDS:
            self._index, self._rows = {}, np.empty((0, len(self.languages)))
        at = list(map(self._index.get, words))
        if None in at:
            new = list(dict.fromkeys(w for w, i in zip(words, at) if i is None))
            slots, owner = features(new)
            scores = _sums(self.weights[slots], owner, len(new))
            rows = np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -30, 0))
            self._index.update(zip(new, range(len(self._rows), len(self._rows) + len(new))))
            self._rows = np.concatenate([self._rows, rows])
            at = list(map(self._index.__getitem__, words))
        return self._rows[np.array(at)]

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Posterior of each language at each word of every text."""
        sizes = np.array([len(words) for words in texts])
        full = np.flatnonzero(sizes)
        out = [np.empty((0, len(self.languages)))] * len(texts)
        if len(full):
            potential = self.potentials([word for i in full for word in texts[i]])
            posterior = forward_backward(potential, self.step, sizes[full])
            for i, part in zip(full, np.split(posterior, np.cumsum(sizes[full])[:-1])):
                out[i] = part
        return out


def train(texts: list[str], langs: list[str], seed: int = 0) -> Field:
    """Fit a field to texts of known language.

    Chains are made of short runs of words from texts of different languages,
    so that transitions are learned as well; the likelihood is raised by
    gradient steps with forward-backward expectations.
    """
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    if not languages:
        return Field([], np.zeros((SLOTS, 0)), np.zeros((0, 0)))
    pools = {language: [] for language in languages}
    for text, language in zip(texts, langs):
        words = WORD.findall(text.lower())
        if words:
            pools[language].append(words)
    languages = [language for language in languages if pools[language]]
    if not languages:
        return Field([], np.zeros((SLOTS, 0)), np.zeros((0, 0)))
    chains, targets = [], []
    for _ in range(CHAINS):
        chain, target = [], []
        while len(chain) < CHAIN_WORDS:
            label = int(rng.integers(len(languages)))
            pool = pools[languages[label]]
            words = pool[int(rng.integers(len(pool)))]
            take = int(rng.integers(*SEGMENT_WORDS))
            start = int(rng.integers(max(1, len(words) - take + 1)))
            part = words[start : start + take]
            chain += part
            target += [label] * len(part)
        chains.append(chain[:CHAIN_WORDS])
        targets.append(target[:CHAIN_WORDS])
    vocabulary, index = np.unique(np.array(chains, dtype=object), return_inverse=True)
    index, gold = index.reshape(CHAINS, CHAIN_WORDS), np.array(targets)
    slots, owner = features(vocabulary.tolist())
    count = len(languages)
    weights, moves = np.zeros((SLOTS, count)), np.zeros((count, count))
    seen_w, seen_m = np.full((SLOTS, count), 1e-8), np.full((count, count), 1e-8)
    wanted = np.eye(count)[gold]
    pairs = np.zeros((count, count))
    np.add.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1.0)
    for _ in range(EPOCHS):
        scores = _sums(weights[slots], owner, len(vocabulary))
        cells = np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -30, 0))[index]
        step = np.exp(moves)
        ahead, back = np.empty_like(cells), np.empty_like(cells)
        message = np.full((CHAINS, count), 1.0 / count)
        for at in range(CHAIN_WORDS):
            message = (message @ step) * cells[:, at]
            message /= message.sum(axis=1, keepdims=True)
            ahead[:, at] = message
        message = np.ones((CHAINS, count))
        expected = np.zeros((count, count))
        for at in reversed(range(CHAIN_WORDS)):
            back[:, at] = message
            if at:
                joint = ahead[:, at - 1, :, None] * step * (cells[:, at] * message)[:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            message = (cells[:, at] * message) @ step.T
            message /= message.sum(axis=1, keepdims=True)
        posterior = ahead * back
        posterior /= posterior.sum(axis=2, keepdims=True)
        slope = (wanted - posterior).reshape(-1, count)
        by_word = _sums(slope, index.ravel(), len(vocabulary))
        grad = _sums(by_word[owner], slots, SLOTS) - DECAY * weights
        seen_w += grad**2
        weights += RATE * grad / np.sqrt(seen_w)
        turn = pairs - expected - DECAY * moves
        seen_m += turn**2
        moves += RATE * turn / np.sqrt(seen_m)
    return Field(languages, weights, moves)


def training_sample(labelled: DataFrame, docs_per_language: int = SAMPLE_DOCS, id_col: str | None = None) -> DataFrame:
    """(text, lang): at most so many texts per language, by hash; an id keeps copies of a text apart.

    Texts of up to ``SAMPLE_CHARS`` characters are taken; a language that has
    none is learned from that much of its longer ones.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    fits = F.char_length("text") <= SAMPLE_CHARS
    # One row per language, few by their nature.
    known = F.broadcast(rows.groupBy(F.col("lang").alias("_lang")).agg(F.bool_or(fits).alias("_some")))
    rows = rows.join(known, F.col("lang") == F.col("_lang")).where(fits | ~F.col("_some")).withColumn(
        "text", F.left("text", F.lit(SAMPLE_CHARS)))
    return least_by_hash(rows.select("lang", "text", *([id_col] if id_col else [])), docs_per_language, "lang").select("lang", "text")


def fit(labelled: DataFrame, id_col: str | None = None) -> Field:
    """A field from the bounded sample of rows (text, lang)."""
    rows = sorted((row["lang"], row["text"]) for row in training_sample(labelled, id_col=id_col).collect())
    return train([text for _, text in rows], [lang for lang, _ in rows])


def _groups(texts: list[str | None]):
    """Runs of rows of bounded characters, a long text alone."""
    start = chars = 0
    for at, text in enumerate(texts):
        if at > start and chars + len(text or "") > BATCH_CHARS:
            yield start, at
            start, chars = at, 0
        chars += len(text or "")
    if texts:
        yield start, len(texts)


def predict(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row.

    The language with the largest mean posterior over the words of the whole
    text, ties to the first by name, and that mean.  Texts that are null or
    have no letter give ``und`` and 0; so does a field without languages.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = [], []
            for start, end in _groups(texts):
                words = [WORD.findall((text or "").lower()) for text in texts[start:end]]
                found = field.label(words) if field.languages else [np.empty((0, 0))] * len(words)
                for posterior in found:
                    mean = posterior.mean(axis=0) if posterior.size else None
                    best = int(mean.argmax()) if mean is not None else -1
                    langs.append(field.languages[best] if best >= 0 else UNKNOWN)
                    scores.append(float(min(mean[best], 1.0)) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"]
            )

    made = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return made.withColumnRenamed("id", id_col)


def label_runs(text, field: Field):
    """Runs of one language in a text column: array of (start, end, lang), code points, end exclusive."""

    @F.pandas_udf("array<struct<start:int,end:int,lang:string>>")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = list(WORD.finditer(text or "")) if field.languages else []
            runs: list[dict] = []
            for match, label in zip(found, field.label([[m.group().lower() for m in found]])[0].argmax(axis=1) if found else []):
                lang = field.languages[int(label)]
                if runs and runs[-1]["lang"] == lang:
                    runs[-1]["end"] = match.end()
                else:
                    runs.append({"start": match.start(), "end": match.end(), "lang": lang})
            out.append(runs)
        return pd.Series(out)

    return of(text)
