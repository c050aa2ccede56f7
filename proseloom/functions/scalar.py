"""Scalar column expressions shared by every operator (no UDFs)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L
from .patterns import TRIM_CHARS, any_word, java, words_and_phrases


ODD_SPACES = [c for c in TRIM_CHARS if c != " "]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


def rows(values: Column | str) -> Column:
    """Generator input that hides a computed array behind an expression.

    Over a bare attribute the optimizer infers ``size(x) > 0`` below the
    generator and pushes it to the scan, which repeats everything that computes
    the array; an expression is left alone.
    """
    return F.flatten(F.array(col(values)))


def sealed(df: DataFrame, key: Sequence[str], columns: Sequence[Column | str]) -> DataFrame:
    """Final projection whose computed columns are computed once.

    A filter on a computed column is otherwise rewritten in terms of the scan
    columns, level by level, and repeats the work at every level.  Filters on
    ``key`` columns still reach the scan.
    """
    return df.select(*key, F.inline(F.array(F.struct(*[col(c) for c in columns]))))


def trim(c: Column | str) -> Column:
    """Strip every kind of white space, not only blanks.

    Blanks go first; stripping a set of signs walks the whole text, so it is left to
    texts that still begin or end with one of them.
    """

    def rest(x: Column) -> Column:
        edge = F.substring(x, 1, 1).isin(ODD_SPACES) | F.substring(x, -1, 1).isin(ODD_SPACES)
        return F.when(edge, F.btrim(x, F.lit(TRIM_CHARS))).otherwise(x)

    return let(F.trim(col(c)), rest)


def trim_end(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(TRIM_CHARS))


def count_matches(c: Column | str, pattern: str, ignore_case: bool = True, multiline: bool = False) -> Column:
    return F.regexp_count(col(c), F.lit(java(pattern, ignore_case, multiline)))


def count_each(c: Column | str, patterns: dict[str, str], body: Callable[[dict[str, Column]], Column]) -> Column:
    """What ``body`` makes of the counts of each pattern, case ignored: :func:`count_matches` of many lists of words.

    One scan takes the words that any list holds out of the text; lists are counted
    in those.  Phrases are counted in the text if it holds one of them.
    """
    split = {name: words_and_phrases(p) for name, p in patterns.items()}
    lists = tuple((words, stem) for single, words, stem, _, _ in split.values() if single)
    if len(lists) < 2:
        return body({name: count_matches(c, p) for name, p in patterns.items()})

    def count(name: str, text: Column, low: Column, hits: Column) -> Column:
        single, _, _, phrases, texts = split[name]
        counts = [count_matches(hits, single)] if single else []
        if phrases:
            found = count_matches(text, phrases)
            if texts:
                some = reduce(or_, [F.contains(low, F.lit(x)) for x in texts])
                found = F.when(some, found).when(some.isNull(), F.lit(None)).otherwise(0)
            counts.append(found)
        return reduce(add, counts)

    hits = lambda text: F.array_join(F.regexp_extract_all(text, F.lit(any_word(lists)), F.lit(0)), "|")
    return let(col(c), lambda text: let(F.lower(text), lambda low: let(
        hits(text), lambda h: body({name: count(name, text, low, h) for name in patterns}))))


def matches(c: Column | str, pattern: str, ignore_case: bool = True, multiline: bool = False) -> Column:
    return col(c).rlike(java(pattern, ignore_case, multiline))


def any_match(c: Column | str, patterns: Iterable[str], ignore_case: bool = True) -> Column:
    return matches(c, "|".join(f"(?:{p})" for p in patterns), ignore_case)


def all_matches(c: Column | str, pattern: str, group: int = 0, ignore_case: bool = False, multiline: bool = False):
    return F.regexp_extract_all(col(c), F.lit(java(pattern, ignore_case, multiline)), F.lit(group))


def first_match(c: Column | str, pattern: str, group: int = 0, ignore_case: bool = False, multiline: bool = False):
    """First match of ``group`` or the empty string."""
    return F.regexp_extract(col(c), java(pattern, ignore_case, multiline), group)


def replace_all(c: Column | str, pattern: str, repl: str, ignore_case: bool = False, multiline: bool = False):
    return F.regexp_replace(col(c), java(pattern, ignore_case, multiline), repl)


def count_char(c: Column | str, ch: str) -> Column:
    c = col(c)
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def round_half_up(c: Column, digits: int = 2) -> Column:
    """Half-up toward +infinity, in doubles, as script number formatting does."""
    factor = float(10**digits)
    return F.floor(c * F.lit(factor) + F.lit(0.5)).cast("double") / F.lit(factor)


def whole(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("long")


def per_1k(count: Column, words: Column) -> Column:
    """Rate per 1,000 words, two decimals, 0 without words."""
    return F.when(words == 0, F.lit(0.0)).otherwise(
        round_half_up(F.try_divide(count.cast("double"), words.cast("double") / F.lit(1000.0)))
    )


def share(part: Column, total: Column, digits: int = 3) -> Column:
    """Part of a whole, three decimals, 0 for an empty whole."""
    return F.when(total == 0, F.lit(0.0)).otherwise(
        round_half_up(F.try_divide(part.cast("double"), total.cast("double")), digits)
    )


def ratio(part: Column, total: Column) -> Column:
    """Unrounded quotient in doubles, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(0.0))


def array_sum(c: Column | str) -> Column:
    return F.aggregate(col(c), F.lit(0).cast("long"), lambda a, x: a + x)


def array_mean(c: Column | str) -> Column:
    c = col(c)
    return ratio(array_sum(c), F.size(c))


def spread(n: Column, total: Column, squares: Column) -> Column:
    """Population deviation from integer sums, so no float order dependence."""
    n, total, squares = (x.cast("double") for x in (n, total, squares))
    return F.when(n < 2, F.lit(0.0)).otherwise(
        F.sqrt(F.greatest(F.try_divide(n * squares - total * total, n * n), F.lit(0.0)))
    )


def array_spread(c: Column | str) -> Column:
    c = col(c)
    squares = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    return spread(F.size(c), array_sum(c), squares)


def array_percentile(sorted_values: Column, p: float) -> Column:
    """Linear-interpolated percentile of an ascending array; 0 when empty."""

    def pick(index: Column) -> Column:
        low = F.floor(index).cast("int")
        high = F.ceil(index).cast("int")
        a = F.get(sorted_values, low).cast("double")
        b = F.get(sorted_values, high).cast("double")
        return a + (b - a) * (index - low.cast("double"))

    index = (F.size(sorted_values) - 1).cast("double") * F.lit(p)
    return F.when(F.size(sorted_values) == 0, F.lit(0.0)).otherwise(pick(index))


def value_counts(values: Column) -> Column:
    """Distinct values of an array with their counts, in value order.

    One sort and one pass over run boundaries, inside the row: linear in the
    array and free of any shuffle.
    """

    def runs(s: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(positions, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, k: F.struct(
                    F.get(s, p).alias("value"),
                    (F.coalesce(F.get(st, k + 1), F.size(s)) - p).cast("long").alias("n"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<value:string,n:bigint>>")
    # Asked for its size first, a computed array would be computed twice.
    return let(F.sort_array(values), lambda s: F.when(F.size(s) == 0, empty).otherwise(runs(s)))


def number_text(c: Column) -> Column:
    """A double as people write it: no trailing ``.0``."""
    text = c.cast("string")
    return F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(text)


def grouped(c: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(c, 0)


# --- small domain scalars ----------------------------------------------------


def normalise(c: Column | str) -> Column:
    """Lower case, white space runs to one blank, trimmed."""
    return trim(replace_all(F.lower(col(c)), r"\s+", " "))


def mentions(text: Column, phrase: Column) -> Column:
    """Does ``text`` contain ``phrase`` after normalising both; blank never does."""
    return holds(normalise(text), phrase)


def holds(normalised: Column, phrase: Column) -> Column:
    """:func:`mentions` of a text that is normalised already."""
    return F.when(trim(phrase) == "", F.lit(False)).otherwise(F.contains(normalised, normalise(phrase)))


OFFSET_BLOCK = 512


def offsets_before(lengths: Column) -> Column:
    """Sum of all lengths before each one.

    Blocks of the array are summed on their own and then shifted, so a fold
    never copies more than one block: near linear in the array.
    """
    whole = F.size(lengths)
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0)), F.lit(OFFSET_BLOCK)),
        lambda at: F.slice(lengths, at + 1, OFFSET_BLOCK),
    )

    def prefix(values: Column) -> Column:
        sums = F.aggregate(
            values, F.array(F.lit(0)), lambda out, x: F.array_append(out, F.element_at(out, -1) + x)
        )
        return F.slice(sums, 1, F.size(values))

    before = prefix(F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x)))
    return F.flatten(
        F.zip_with(blocks, before, lambda block, start: F.transform(prefix(block), lambda x: x + start))
    )


def ranked_values(values: Column) -> Column:
    """Distinct values of an array, most frequent first, ties by first appearance.

    Sorting with positions keeps it near linear in the array.
    """

    def ranked(s: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["value"] != F.get(s, i - 1)["value"])
        )
        counted = let(
            places,
            lambda st: F.transform(
                st,
                lambda p, k: F.struct(
                    (p - F.coalesce(F.get(st, k + 1), F.size(s))).alias("rank"), F.get(s, p)["at"].alias("at"),
                    F.get(s, p)["value"].alias("value"),
                ),
            ),
        )
        return F.transform(F.sort_array(counted), lambda x: x["value"])

    placed = F.transform(values, lambda v, i: F.struct(v.alias("value"), i.alias("at")))
    return F.when(F.size(values) == 0, F.array().cast("array<string>")).otherwise(let(F.sort_array(placed), ranked))


def day_number(c: Column | str) -> Column:
    """Day number in free text such as ``Day 4, dusk``; null when absent."""
    return first_match(c, L.DAY_NUMBER, 1, ignore_case=True).try_cast("bigint")


def slug(c: Column | str, limit: int = 48, empty: str = "source") -> Column:
    """Lower-case ASCII key for ids."""
    base = replace_all(F.lower(col(c)), r"[^a-z0-9]+", "-")
    base = F.substring(replace_all(base, r"^-|-$", ""), 1, limit)
    return F.when(base == "", F.lit(empty)).otherwise(base)


ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def folder_slug(c: Column | str, limit: int = 64) -> Column:
    """Accent-folding slug for folder names; empty when nothing is left."""
    folded = F.translate(replace_all(F.lower(col(c)), r"[̀-ͯ]", ""), ACCENTED, PLAIN)
    base = replace_all(folded, r"[^a-z0-9]+", "-")
    return F.substring(replace_all(base, r"^-+|-+$", ""), 1, limit)


def file_id(c: Column | str) -> Column:
    """Document id from a share link or a bare id; null when none fits."""
    return F.coalesce(*[F.nullif(first_match(c, p, 1), F.lit("")) for p in L.FILE_ID_PATTERNS])
