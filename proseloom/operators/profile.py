"""Writing profile: narration, distance, senses, emotion, intensity, audience.

Every reading is a function of additive counts, so one set of counts per
document serves single documents and, after a partial-and-final sum, whole
corpora of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.patterns import java
from ..functions.scalar import col, count_each, let, per_1k, ratio, round_half_up, share

_AUDIENCE = [f"aud_{i}" for i in range(len(L.AUDIENCES))]
NARRATION_COUNTS = ["n_narrative", "first", "second", "third", "thought", "past", "present"]
VOICE_COUNTS = [
    "n_words", "filter", "interior", "emotion", "body_cue", "simile", "metaphor",
    *[f"sense_{s}" for s in L.SENSORY], "romance", "sexual", "explicit", "fade", "profanity", "violence",
    "n_spans", "n_paragraphs", *_AUDIENCE,
]

# What each reading needs, for :func:`profile_counts`.
DISTANCE_COUNTS = ["n_words", "filter", "interior"]
SENSORY_COUNTS = ["n_words", *[f"sense_{s}" for s in L.SENSORY]]
EMOTION_COUNTS = ["n_words", "emotion", "body_cue", "interior", "simile", "metaphor"]
INTENSITY_COUNTS = ["romance", "sexual", "explicit", "fade"]
AUDIENCE_COUNTS = ["n_words", *_AUDIENCE]
FINDING_COUNTS = list(dict.fromkeys([*NARRATION_COUNTS, *AUDIENCE_COUNTS, *INTENSITY_COUNTS]))


def without_dialogue(text: Column | str) -> Column:
    """Text with cleanly quoted speech blanked out.

    Quotes are paired first; a pair goes when both marks are of one style and
    the words touch them, the rest stays as it was.
    """
    marked = F.regexp_replace(col(text), r'(["“][^"“”]{1,2000}["”])', "\x01$1\x02")
    inner = java(r"(?:\S|\S[^\u0002]*\S)")
    gone = F.regexp_replace(marked, f'\x01(?:"{inner}"|“{inner}”)\x02', " ")
    return F.regexp_replace(gone, "[\x01\x02]", "")


def profile_counts(
    df: DataFrame, key: Sequence[str], text: str = "text", delimiter: str = L.BLANK_LINE,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Additive signal counts of each document: all of them, or the asked ``columns``.

    The counts come as one sealed row, which readers cannot prune; every count is
    a scan of the text.
    """
    asked = lambda *names: columns is None or any(n in columns for n in names)
    second = [w for w in L.SECOND_PERSON if w not in L.FIRST_PERSON]
    third = [w for w in L.THIRD_PERSON if w not in L.FIRST_PERSON]
    # Each count is a sum of patterns, all of one text in one scan.
    told = {"thought": [L.NARRATED_THOUGHT], "past": [L.PAST_MARKERS], "present": [L.PRESENT_MARKERS]}
    whole = {
        "filter": [L.FILTER_PATTERN], "interior": [L.INTERIORITY], "emotion": [L.EMOTION_WORDS],
        "body_cue": [L.BODY_CUES], "simile": [L.SIMILE], "metaphor": [L.METAPHOR_SIGNALS],
        **{f"sense_{s}": [p] for s, p in L.SENSORY.items()},
        "romance": [L.ROMANCE_SIGNALS], "sexual": [L.SEXUAL_SIGNALS], "explicit": [L.EXPLICIT_SIGNALS], "fade": [L.FADE],
        "profanity": [L.PROFANITY], "violence": [L.VIOLENCE],
        **{name: patterns for name, (_, patterns, _) in zip(_AUDIENCE, L.AUDIENCES)},
    }

    def counted(text: Column, table: dict[str, list[str]], body: Callable[[dict[str, Column]], Column]) -> Column:
        table = {name: patterns for name, patterns in table.items() if asked(name)}
        return count_each(text, {p: p for patterns in table.values() for p in patterns}, lambda c: body(
            {name: reduce(add, [c[p] for p in patterns]) for name, patterns in table.items()}))

    def of_narrative(narr: Column, body: Callable[[dict[str, Column]], Column]) -> Column:
        if not asked(*NARRATION_COUNTS):
            return body({})
        found = lambda words, people: {
            "n_narrative": F.size(words), "first": T.count_in(people, L.FIRST_PERSON),
            "second": T.count_in(people, second), "third": T.count_in(people, third),
        }
        # Other words are passed over once, not list by list.
        people = lambda words: F.filter(words, lambda w: w.isin([*L.FIRST_PERSON, *second, *third]))
        return let(narr, lambda n: let(T.words(n), lambda words: let(people(words), lambda ps: counted(
            n, told, lambda c: body({**found(words, ps), **c})))))

    def row(text: Column) -> Column:
        own = {
            "n_words": lambda: T.word_count(text), "n_spans": lambda: F.size(T.spoken(text)),
            "n_paragraphs": lambda: F.size(T.paragraphs(text, delimiter)),
        }
        every = [*NARRATION_COUNTS, *VOICE_COUNTS]
        return of_narrative(without_dialogue(text), lambda n: counted(text, whole, lambda c: F.struct(*[
            (n | c | {k: f() for k, f in own.items() if k == name})[name].cast("long").alias(name)
            for name in every if asked(name)])))

    return df.select(*key, F.inline(F.array(let(col(text), row))))


def pooled_counts(counts: DataFrame, group: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """Counts of a whole group, and ``more`` columns: plain sums."""
    return counts.groupBy(*group).agg(
        *[F.sum(c).cast("long").alias(c) for c in [*NARRATION_COUNTS, *VOICE_COUNTS, *more] if c in counts.columns]
    )


def narration(counts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Point of view and tense with a confidence each."""
    pronouns = F.greatest(F.col("first") + F.col("second") + F.col("third"), F.lit(1))
    verbs = F.greatest(F.col("past") + F.col("present"), F.lit(1))
    base = counts.select(
        *key,
        ratio(F.col("first"), pronouns).alias("_f"),
        ratio(F.col("second"), pronouns).alias("_s"),
        ratio(F.col("third"), pronouns).alias("_t"),
        ratio(F.col("past"), verbs).alias("_p"),
        ratio(
            F.col("thought"), F.greatest(F.col("n_narrative"), F.lit(1)).cast("double") / F.lit(1000.0)
        ).alias("_inner"),
    )
    close = F.col("_inner") > 1.2
    capped = lambda c, k: F.least(c * F.lit(k), F.lit(1.0))
    pov = (
        F.when(F.col("_f") > 0.35, "first")
        .when(F.col("_s") > 0.3, "second")
        .when((F.col("_t") > 0.5) & close, "third_limited")
        .when(F.col("_t") > 0.5, "third_omniscient")
        .otherwise("mixed")
    )
    pov_confidence = (
        F.when(F.col("_f") > 0.35, capped(F.col("_f"), 1.6))
        .when(F.col("_s") > 0.3, capped(F.col("_s"), 1.6))
        .when(F.col("_t") > 0.5, capped(F.col("_t"), 1.2) * F.when(close, 1.0).otherwise(0.7))
        .otherwise(0.3)
    )
    tense = F.when(F.col("_p") > 0.65, "past").when(F.col("_p") < 0.35, "present").otherwise("mixed")
    out = base.select(*key, pov.alias("pov"), tense.alias("tense"), pov_confidence.alias("pov_confidence"), "_p")
    out = out.withColumn(
        "tense_confidence",
        F.when(F.col("tense") == "mixed", 0.4).otherwise(capped(F.abs(F.col("_p") - 0.5), 2.4)),
    )
    return out.select(
        *key, "pov", "tense", "pov_confidence", "tense_confidence",
        F.concat_ws(", ", pov_label(F.col("pov")), tense_label(F.col("tense"))).alias("label"),
        round_half_up(F.least("pov_confidence", "tense_confidence")).alias("confidence"),
    )


def _labels(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for value, label in table.items():
        out = F.when(c == value, label).otherwise(out)
    return out


def pov_label(c: Column) -> Column:
    return _labels(c, L.POV_LABELS)


def tense_label(c: Column) -> Column:
    return _labels(c, L.TENSE_LABELS)


def distance(counts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Narrative distance from filter verbs against interiority."""
    f, i = F.col("filter"), F.col("interior")
    label = (
        F.when(f > i * F.lit(1.35), "distant").when(i > f * F.lit(1.35), "close").otherwise("middle")
    )
    n = F.col("n_words")
    return counts.select(
        *key, label.alias("distance"), per_1k(f, n).alias("filter_verbs_per_1k"),
        per_1k(i, n).alias("interiority_per_1k"),
    )


def sensory(counts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Seven sense rates per 1,000 words."""
    return counts.select(*key, *[per_1k(F.col(f"sense_{s}"), F.col("n_words")).alias(s) for s in L.SENSORY])


def emotion(counts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Emotion and figurative rates per 1,000 words."""
    n = F.col("n_words")
    rates = {
        "explicit_per_1k": "emotion", "body_cue_per_1k": "body_cue", "thought_per_1k": "interior",
        "similes_per_1k": "simile", "metaphor_per_1k": "metaphor",
    }
    return counts.select(*key, *[per_1k(F.col(c), n).alias(name) for name, c in rates.items()])


def intensity(counts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Content-intensity rung and its confidence."""
    r, s, x = F.col("romance"), F.col("sexual"), F.col("explicit")
    rungs = [
        (x >= 4, "Very explicit", F.least(F.lit(0.98), F.lit(0.65) + x / F.lit(40.0))),
        (x > 0, "Explicit", F.least(F.lit(0.94), F.lit(0.6) + x / F.lit(30.0))),
        (s > 0, "Open door", F.least(F.lit(0.85), F.lit(0.55) + s / F.lit(30.0))),
        ((F.col("fade") > 0) & (r > 0), "Fade to black", F.lit(0.72)),
        (r > 0, "Romantic tension only", F.least(F.lit(0.78), F.lit(0.5) + r / F.lit(40.0))),
    ]
    value, confidence = F.lit("None"), F.lit(0.55)
    for condition, name, score in reversed(rungs):
        value = F.when(condition, name).otherwise(value)
        confidence = F.when(condition, score).otherwise(confidence)
    text = lambda c: c.cast("string")
    evidence = F.array_compact(
        F.array(
            F.concat(text(r), F.lit(" romantic signals")),
            F.concat(text(s), F.lit(" sexual-content signals")),
            F.when(x > 0, F.concat(text(x), F.lit(" explicit anatomy or act signals"))).when(
                (s == 0) & (F.col("fade") > 0) & (r > 0), "fade-to-black transition language"
            ),
        )
    )
    return counts.select(
        *key, value.alias("intimacy"), confidence.alias("intimacy_confidence"), evidence.alias("intimacy_evidence")
    )


def audience(counts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Audience categories with at least two signals, strongest first."""
    candidates = F.array(
        *[
            F.when(
                F.col(name) >= 2,
                F.struct((-F.col(name)).alias("rank"), F.lit(i).alias("i"), F.lit(value).alias("value"),
                         F.lit(evidence).alias("evidence"), F.col(name).alias("n")),
            )
            for i, (name, (value, _, evidence)) in enumerate(zip(_AUDIENCE, L.AUDIENCES))
        ]
    )
    ranked = counts.withColumn("_aud", F.array_sort(F.array_compact(candidates)))
    top = F.get("_aud", 0)["n"].cast("double")
    scale = F.greatest(F.col("n_words").cast("double") / F.lit(1000.0), F.lit(1.0))
    confidence = F.when(F.size("_aud") == 0, F.lit(0.25)).otherwise(
        round_half_up(F.least(F.lit(0.9), F.lit(0.5) + top / scale / F.lit(10.0)))
    )
    return ranked.select(
        *key,
        F.transform("_aud", lambda a: a["value"]).alias("audience"),
        confidence.alias("audience_confidence"),
        F.transform(
            "_aud", lambda a: F.concat(a["evidence"], F.lit(" ("), a["n"].cast("string"), F.lit(" signals)"))
        ).alias("audience_evidence"),
    )


def beat_mix(passages: DataFrame, group: Sequence[str], beat: str = "beat", n_words: str = "n_words") -> DataFrame:
    """Word-weighted share of each beat."""
    sums = passages.groupBy(*group).agg(
        *[F.sum(F.when(F.col(beat) == b, F.col(n_words)).otherwise(0)).cast("long").alias(b) for b in L.BEATS]
    )
    total = F.greatest(sum((F.col(b) for b in L.BEATS[1:]), F.col(L.BEATS[0])), F.lit(1))
    return sums.select(*group, *[share(F.col(b), total).alias(b) for b in L.BEATS])


def writing_profiles(counts: DataFrame, key: Sequence[str]) -> DataFrame:
    """The whole profile as one row per document or group."""
    key = list(key)
    parts = [f(counts, key) for f in (distance, sensory, emotion, intensity, audience)]
    out = narration(counts, key)
    for part in parts:
        out = out.join(part, key)
    return out
