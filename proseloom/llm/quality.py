"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.llm.sample import least_by_hash

#: Words of a passage; the last one of a text may be shorter.
PASSAGE_WORDS = 64
#: Hashed word shapes beside the surface features.
BUCKETS = 16
#: Bounds of the training sample: documents per label, and characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 1_500, 20_000
HIDDEN, GATE = 12, 8
EPOCHS, RATE, DECAY = 150, 0.04, 1e-4
CACHE_WORDS = 300_000
BATCH_CHARS = 1_000_000
PREDICT_AT = 0.3
_END = ".,;:!?"
WORD_FEATURES = 12 + BUCKETS
#: Word averages, and the passage's own: length, distinct words, repeats of the word before.
FEATURES = WORD_FEATURES + 3


def word_features(word: str) -> list[float]:
    """Surface of one word, and a one-hot hash of its shape."""
    letters = sum(map(str.isalpha, word))
    digits = sum(map(str.isdigit, word))
    ended = word.rstrip(_END)
    signs = sum(not c.isalnum() for c in ended)
    shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word[:1] + word[-3:])
    out = [0.0] * BUCKETS
    out[crc32(shape.encode("utf-8", "surrogatepass")) % BUCKETS] = 1.0
    size = len(word)
    return [
        min(size, 40) / 10, float(size > 25), float(size == 1), letters / size, digits / size, signs / size,
        float(letters > 1 and word.isupper()), float(word[:1].isupper()), float(letters == 0 and digits == 0),
        float(bool(ended) and not ended[-1].isalnum()), float(word[-1] in ".!?"), float(word[-1] == ","), *out,
    ]


class Encoder:
    """Passage features of texts; the words met are kept in a bounded table."""

    def __init__(self):
        self._index: dict[str, int] = {}
        self._rows = np.empty((0, WORD_FEATURES), dtype=np.float32)

    def _at(self, words: list[str]) -> np.ndarray:
        if len(self._index) > CACHE_WORDS:
            self._index, self._rows = {}, np.empty((0, WORD_FEATURES), dtype=np.float32)
        at = list(map(self._index.get, words))
        if None in at:
            new = list(dict.fromkeys(w for w, i in zip(words, at) if i is None))
            self._index.update(zip(new, range(len(self._rows), len(self._rows) + len(new))))
            self._rows = np.concatenate([self._rows, np.array([word_features(w) for w in new], dtype=np.float32)])
            at = list(map(self._index.__getitem__, words))
        return np.array(at, dtype=np.int64)

    def passages(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Features of all passages in order, and the number of passages of each text.

        Passages are runs of PASSAGE_WORDS words; a text without words has one
        passage of zeros, so that every text has a representation.
        """
        words = [(text or "").split() for text in texts]
        sizes = np.array([len(w) for w in words])
        counts = np.maximum(-(-sizes // PASSAGE_WORDS), 1)
        out = np.zeros((int(counts.sum()), FEATURES))
        at = self._at([w for ws in words for w in ws])
        if not len(at):
            return out, counts
        doc = np.repeat(np.arange(len(texts)), sizes)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        passage = (np.cumsum(counts) - counts)[doc] + inside // PASSAGE_WORDS
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        rows, length = passage[starts], np.diff(np.append(starts, len(at)))
        out[rows, :WORD_FEATURES] = np.add.reduceat(self._rows[at], starts, axis=0) / length[:, None]
        out[rows, WORD_FEATURES] = length / PASSAGE_WORDS
        pairs = np.unique((passage << 32) | at)
        distinct = np.bincount(pairs >> 32, minlength=len(out))
        out[rows, WORD_FEATURES + 1] = distinct[rows] / length
        same = np.zeros(len(at))
        same[1:] = (at[1:] == at[:-1]) & (passage[1:] == passage[:-1])
        out[rows, WORD_FEATURES + 2] = np.add.reduceat(same, starts) / length
        return out, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Passages to a hidden layer, gated attention over a text's passages, and a logistic score of their weighted mean."""

    def __init__(self, shift: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray], offset: float):
        self.shift, self.scale, self.weights, self.offset = shift, scale, weights, offset

    def forward(self, features: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((features - self.shift) / self.scale, -8, 8)
        hidden = np.tanh(x @ w["encode"] + w["encode_0"])
        tanh, gate = np.tanh(hidden @ w["see"]), _sigmoid(hidden @ w["gate"])
        energy = (tanh * gate) @ w["attend"]
        starts = np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        raised = np.exp(energy - np.maximum.reduceat(energy, starts)[bag])
        share = raised / np.add.reduceat(raised, starts)[bag]
        pooled = np.add.reduceat(share[:, None] * hidden, starts, axis=0)
        logit = pooled @ w["score"] + w["score_0"][0] + self.offset
        return {"x": x, "hidden": hidden, "tanh": tanh, "gate": gate, "share": share, "bag": bag, "pooled": pooled, "logit": logit}

    def score(self, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text, and the attention each passage got."""
        run = self.forward(features, counts)
        return _sigmoid(run["logit"]), run["share"]

    def slopes(self, run: dict[str, np.ndarray], counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean logistic loss."""
        w, starts, bag = self.weights, np.cumsum(counts) - counts, run["bag"]
        error = (_sigmoid(run["logit"]) - labels) / len(labels)
        pooled = error[:, None] * w["score"]
        share = (run["hidden"] * pooled[bag]).sum(axis=1)
        mean = np.add.reduceat(run["share"] * share, starts)[bag]
        energy = run["share"] * (share - mean)
        mixed = energy[:, None] * w["attend"]
        see, gate = mixed * run["gate"] * (1 - run["tanh"] ** 2), mixed * run["tanh"] * run["gate"] * (1 - run["gate"])
        hidden = run["share"][:, None] * pooled[bag] + see @ w["see"].T + gate @ w["gate"].T
        inner = hidden * (1 - run["hidden"] ** 2)
        return {
            "encode": run["x"].T @ inner, "encode_0": inner.sum(axis=0), "see": run["hidden"].T @ see, "gate": run["hidden"].T @ gate,
            "attend": (run["tanh"] * run["gate"]).T @ energy, "score": run["pooled"].T @ error, "score_0": np.array([error.sum()]),
        }


def train(texts: list[str], labels: list[int], prior: float | None = None, seed: int = 0) -> Attention:
    """Fit the network to labelled texts; ``prior`` is the share of label 1 among all, if the sample's differs.

    Without texts the score is one half everywhere; with one label only, the
    network learns that label.
    """
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = {
        "encode": draw(FEATURES, HIDDEN), "encode_0": np.zeros(HIDDEN), "see": draw(HIDDEN, GATE), "gate": draw(HIDDEN, GATE),
        "attend": draw(GATE), "score": draw(HIDDEN), "score_0": np.zeros(1),
    }
    if not texts:
        weights["score"][:] = 0
        return Attention(np.zeros(FEATURES), np.ones(FEATURES), weights, 0.0)
    features, counts = Encoder().passages(texts)
    model = Attention(features.mean(axis=0), np.maximum(features.std(axis=0), 1e-2), weights, 0.0)
    wanted = np.array(labels, dtype=float)
    first, second = ({name: np.zeros_like(value) for name, value in weights.items()} for _ in range(2))
    for turn in range(1, EPOCHS + 1):
        slopes = model.slopes(model.forward(features, counts), counts, wanted)
        for name, slope in slopes.items():
            slope = slope + DECAY * weights[name]
            first[name] = 0.9 * first[name] + 0.1 * slope
            second[name] = 0.999 * second[name] + 0.001 * slope**2
            weights[name] -= RATE * (first[name] / (1 - 0.9**turn)) / (np.sqrt(second[name] / (1 - 0.999**turn)) + 1e-8)
    here = min(max(wanted.mean(), 1e-3), 1 - 1e-3)
    if prior is not None and 0 < wanted.mean() < 1:
        there = min(max(prior, 1e-3), 1 - 1e-3)
        model.offset = float(np.log(there / (1 - there)) - np.log(here / (1 - here)))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Attention:
    """A network from a bounded sample of ``labels`` (id, label 0 or 1), by hash for each label.

    The share of each label is counted over all rows of ``labels``.  Rows with
    a null id or label are left out, and a repeated id counts once, in ``docs``
    with the text of the least hash.
    """
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    named = named.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    prior = named.agg(F.avg("label")).first()[0]
    chosen = least_by_hash(named, SAMPLE_DOCS, "label")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where(F.coalesce(F.char_length("text"), F.lit(0)) <= SAMPLE_CHARS)
    # At most SAMPLE_DOCS ids per label are broadcast.
    once = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    rows = texts.join(F.broadcast(chosen), "id").groupBy("label", "id").agg(once).collect()
    rows = sorted((r["label"], r["id"], r["text"] or "") for r in rows)
    return train([r[2] for r in rows], [r[0] for r in rows], prior)


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


def score(docs: DataFrame, model: Attention, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``score`` (0 to 1) and ``passages``, the number of passages weighed.

    Only the whole text is read.  Null, empty and blank texts are one empty
    passage.  A column of either name in ``docs`` is replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "passages")]
    whole = docs.select(*[F.col(c) for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields)
    place = kept.index(text_col)

    def run(batches):
        encoder = Encoder()
        for batch in batches:
            texts = batch.column(place).to_pylist()
            scores, sizes = [], []
            for start, end in _groups(texts):
                features, counts = encoder.passages(texts[start:end])
                scores += model.score(features, counts)[0].tolist()
                sizes += counts.tolist()
            arrays = [*batch.columns, pa.array(scores, pa.float64()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "score", "passages"])

    return whole.mapInArrow(run, f"{schema}, score double, passages int")
