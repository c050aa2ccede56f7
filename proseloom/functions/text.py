"""Text structure as array-valued column expressions.

Each function maps a text column to an array inside the same row, so a document
is structured without leaving its partition: no explode, no shuffle, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .patterns import JAVA_SPACE as SPACE
from .patterns import java
from .scalar import all_matches, array_sum, col, let, offsets_before, replace_all, trim

MARK = "\x01"
_ABBREVIATION = "|".join(L.ABBREVIATIONS)
_QUOTES = L.CLOSING_QUOTES
# Looking ahead for an end mark first spares all other signs the rest.
_SENTENCE_END = (
    rf"((?=[.!?])(?<![.!?])(?:[!?]|(?<!(?<![a-zA-Z])(?i:{_ABBREVIATION}|[a-z]))\.)[.!?]*[{_QUOTES}]*+)"
    rf"(?={SPACE})(?!(?<=[{_QUOTES}]){SPACE}+[a-z])"
)


def words(c: Column | str) -> Column:
    """Lower-cased word tokens; inner apostrophes stay."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(L.WORD), F.lit(0))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(F.lower(col(c)), F.lit(L.WORD)).cast("long")


def has_words(c: Column | str) -> Column:
    return F.lower(col(c)).rlike(L.WORD)


def non_empty(parts: Column) -> Column:
    return F.filter(F.transform(parts, trim), lambda x: x != "")


def sentences(c: Column | str) -> Column:
    """Sentence texts of one paragraph.

    A mark goes in after every run of end punctuation followed by white space,
    but not after an abbreviation or initial, nor between a closing quote and a
    lower-case word (a dialogue tag).  Then split on the marks.
    """
    c = col(c)
    marked = F.regexp_replace(c, _SENTENCE_END, "$1" + MARK)
    # A text with marks of its own: they come out in the same places.
    own = F.regexp_replace(c, rf"([.!?]+[{_QUOTES}]*)(?={SPACE})", "$1" + MARK)
    own = F.regexp_replace(
        own, rf"(?i)((?<![a-z])(?=[a-z]{{1,6}}\.)(?:{_ABBREVIATION}|[a-z])\.[.!?]*[{_QUOTES}]*){MARK}", "$1"
    )
    own = F.regexp_replace(own, rf"([{_QUOTES}]){MARK}(?={SPACE}+[a-z])", "$1")
    return non_empty(F.split(F.when(F.contains(c, F.lit(MARK)), own).otherwise(marked), MARK))


def paragraphs(c: Column | str, delimiter: str = L.BLANK_LINE) -> Column:
    """Trimmed, non-empty paragraph texts."""
    return non_empty(F.split(col(c), java(delimiter)))


def chunks_with_offsets(c: Column | str, delimiter: str = L.BLANK_LINE) -> Column:
    """Paragraphs as ``array<struct<text, char_offset>>`` (code points, 0-based).

    The delimiter stays attached to the chunk before it, so chunk lengths add
    up to offsets in the original text.
    """
    marked = F.regexp_replace(col(c), f"({java(delimiter)})", "$1" + MARK)
    pieces = F.split(marked, MARK)

    def placed(parts: Column) -> Column:
        lead = lambda piece: F.length(piece) - F.length(replace_all(piece, r"^\s+", ""))
        every = F.zip_with(
            parts, offsets_before(F.transform(parts, F.length)),
            lambda piece, at: F.struct(trim(piece).alias("text"), (at + lead(piece)).alias("char_offset")),
        )
        return F.filter(every, lambda x: x["text"] != "")

    return let(pieces, placed)


def spoken(c: Column | str) -> Column:
    """Quoted speech, double quotes only, trimmed and non-empty."""
    return non_empty(all_matches(c, L.SPOKEN, 1))


def is_speech(c: Column | str) -> Column:
    return F.size(spoken(c)) > 0


def dialogue_tags(c: Column | str) -> Column:
    """Tag words: all those after a quote, then all those before one."""
    # A subject begins with a capital or one of a few letters; no other sign starts the list.
    before = all_matches(c, "(?=[A-Zhistwy])" + L.TAG_BEFORE, 1)
    both = F.concat(all_matches(c, L.TAG_AFTER, 1), before)
    return F.transform(both, F.lower)


def ngrams(tokens: Column, n: int = 4) -> Column:
    """Sliding word n-grams in order."""
    grams = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - n),
        lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]),
    )
    return F.when(F.size(tokens) < n, F.array().cast("array<string>")).otherwise(grams)


def recurring_ngrams(tokens: Column, n: int = 4, least: int = 3) -> Column:
    """The n-grams whose words stand in the text ``least`` times or more, with all their repeats, in no order.

    Hashes choose the places, in the upper bits of a number whose lower bits are
    the place; texts are joined for those alone.  A shared hash may add an n-gram that
    stands fewer times, so readers count.
    """
    place = 30
    hashed = lambda x: F.shiftright(x, place)
    marks = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - n),
        lambda i: F.shiftleft(hashed(F.xxhash64(*[F.get(tokens, i + k) for k in range(n)])), place).bitwiseOR(i.cast("long")),
    )

    def grams(s: Column) -> Column:
        runs = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda i: hashed(F.get(s, i)) == hashed(F.get(s, i + (least - 1)))
        )
        found = F.array_distinct(F.flatten(F.transform(runs, lambda i: F.slice(s, i + 1, least))))
        places = F.transform(found, lambda x: x.bitwiseAND(F.lit((1 << place) - 1)).cast("int"))
        return F.transform(places, lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]))

    none = F.array().cast("array<string>")
    return F.when(F.size(tokens) < n, none).otherwise(let(F.sort_array(marks), grams))


def opener(tokens: Column) -> Column:
    """First two words of a sentence."""
    return F.concat_ws(" ", F.slice(tokens, 1, 2))


def lines(c: Column | str) -> Column:
    """Lines split on line feeds; a carriage return stays at the line end."""
    return F.split(col(c), "\n")


def count_in(tokens: Column, targets: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(targets))).cast("long")


def spoken_words(c: Column | str) -> Column:
    # No word crosses from one speech to the next.
    return word_count(F.array_join(all_matches(c, L.SPOKEN, 1), "\n"))


def first_words(tokens: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens, 1, n), " ")


def with_line_offsets(line_array: Column) -> Column:
    """Lines as ``array<struct<line, at>>`` with their start offsets."""

    def offsets(ls: Column) -> Column:
        starts = offsets_before(F.transform(ls, lambda x: F.length(x) + 1))
        return F.arrays_zip(ls.alias("line"), starts.alias("at"))

    return let(line_array, offsets)
