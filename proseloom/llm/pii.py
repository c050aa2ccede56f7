"""Personal data: exact base patterns, and boosted trees over wider candidates, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds.  Possessive groups and the starts spelled
#: out match what the plain patterns match, without their quadratic retries.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ORDER = {kind: at for at, kind in enumerate(BASE)}
_BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$"
#: Wide generators beyond the base; their proposals may overlap.
WIDE = {
    "number": r"(?<![0-9A-Za-z+(.-])\(?[0-9][0-9\x20()./-]{5,}[0-9](?![0-9A-Za-z])",
    "coded": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "spelled": r"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{1,63}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[a-z0-9-]{2,63}(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20|\.)\x20?[a-z0-9-]{2,63}){1,4}",
    "colons": r"(?i)(?<![0-9a-z:])(?:[0-9a-f]{1,4}:){4,7}:?[0-9a-f]{1,4}(?![0-9a-z:])",
}
_NATIONAL = r"(?:1[\x20.-])?(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4}"
_SOCIAL = r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"
_ALONE, _OVER = r"(?<![0-9A-Za-z])(?<![0-9][.-])", r"(?![0-9A-Za-z]|[.-][0-9])"
#: Bounded shapes inside what "number" may run over, each proposed beside it.
BOUNDED = {
    "national": rf"{_ALONE}{_NATIONAL}{_OVER}",
    "social": rf"{_ALONE}{_SOCIAL}{_OVER}",
    "grouped": rf"{_ALONE}(?:0[1-9](?:[\x20.-][0-9]{{2}}){{4}}|\(?0[0-9]{{1,4}}\)?(?:[\x20/.-][0-9]{{3,4}}[\x20.-][0-9]{{3,4}}|[\x20/-][0-9]{{5,8}})){_OVER}",
    "run": rf"{_ALONE}(?<!\+)[0-9](?:[.-]?[0-9]){{6,18}}{_OVER}",
}
#: What must occur in a text before a generator is tried; each is implied by its generator.
GUARD = {"national": r"[2-9][0-9]{2}[\x20.-][0-9]{4}", "social": r"[0-9]{3}-[0-9]{2}-", "grouped": r"0[0-9]{1,4}\)?[\x20/.-][0-9]{2}", "run": r"[0-9](?:[.-]?[0-9]){6}",
         "number": r"[0-9][0-9\x20()./-]{5,}[0-9]", "coded": r"[A-Z]{2}[0-9]{2}", "spelled": r"(?i)at[\])\x20]", "colons": r"[0-9a-fA-F]:[0-9a-fA-F]"}
CUE = r"(?i)(?:phone|tel|telefon|t[ée]l[ée]phone|mobile?|call|fax|ssn|social security|iban|account|konto|cuenta|compte|mail|contact|address|adresse)\W{0,3}(?:\w{1,6}\W{1,2})?$"
CONTEXT = 24
BLOCK = 512

Flag = tuple[str, Callable[[Column, Column, Column], Column]]
#: Format and context features of a candidate: (generator, text, what precedes it).
FLAGS: list[Flag] = [
    ("number", lambda g, t, b: g == "number"),
    ("coded", lambda g, t, b: g == "coded"),
    ("spelled", lambda g, t, b: g == "spelled"),
    ("colons", lambda g, t, b: g == "colons"),
    ("cue", lambda g, t, b: b.rlike(CUE)),
    ("national", lambda g, t, b: t.rlike(f"^{_NATIONAL}$")),
    ("bracket", lambda g, t, b: t.rlike(r"^\([0-9]{3}\)")),
    ("social", lambda g, t, b: t.rlike(f"^{_SOCIAL}$")),
    ("dated", lambda g, t, b: t.rlike(r"^(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2})\b")),
    ("plain", lambda g, t, b: t.rlike(r"^[0-9]+$")),
    ("slash", lambda g, t, b: t.contains("/")),
    ("ten", lambda g, t, b: F.char_length(F.regexp_replace(t, "[^0-9]", "")).between(9, 11)),
    ("long", lambda g, t, b: F.char_length(F.regexp_replace(t, "[^0-9]", "")) > 12),
    ("country", lambda g, t, b: t.rlike(r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)[0-9]{2}")),
    ("domain", lambda g, t, b: t.rlike(r"(?i)(?:\.|dot[\])\x20]\x20?)(?:com|net|org|edu|gov|info|io|de|fr|es|uk|eu)$")),
    ("marked", lambda g, t, b: t.rlike(r"(?i)[\[(]at[\])]")),
    ("eight", lambda g, t, b: F.size(F.split(t, ":")) >= 8),
    ("merged", lambda g, t, b: t.rlike(r"[0-9]\.\x20|[0-9]{4}\x20\(")),
]
TREES, RATE = 24, 0.4
#: Share of redactions that should be right, by which the threshold is calibrated.
PRECISION = 0.97
TRAINING_ROWS = 6_000


def _running(lengths: Column) -> Column:
    """Sums of all lengths before each one, in two levels so that long lists stay cheap."""
    whole = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0)), F.lit(BLOCK)), lambda at: F.slice(lengths, at + 1, BLOCK))

    def prefix(values: Column) -> Column:
        empty = F.array(F.lit(0))
        return F.slice(F.reduce(values, empty, lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x))), 1, F.size(values))

    before = prefix(F.transform(blocks, lambda block: F.reduce(block, F.lit(0), lambda a, x: a + x)))
    return F.flatten(F.zip_with(blocks, before, lambda block, start: F.transform(prefix(block), lambda x: x + start)))


def _found(df: DataFrame, text: str, pattern: str, out: str, guard: Column) -> DataFrame:
    """Add ``out``: array of (text, start, end) of the matches of a pattern, in code points."""
    df = df.withColumn(f"{out}_m", F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    gaps = F.split(F.col(text), pattern, -1)
    some = F.size(f"{out}_m") > 0
    df = df.withColumn(f"{out}_g", F.when(some, F.transform(gaps, F.char_length)))
    df = df.withColumn(f"{out}_l", F.when(some, F.transform(f"{out}_m", F.char_length)))
    steps = F.zip_with(F.slice(f"{out}_g", 1, F.size(f"{out}_l")), f"{out}_l", lambda g, m: g + m)
    df = df.withColumn(f"{out}_s", F.when(some, F.zip_with(_running(steps), F.slice(f"{out}_g", 1, F.size(f"{out}_l")), lambda a, g: a + g)))
    spans = F.transform(
        F.arrays_zip(F.col(f"{out}_m").alias("t"), F.col(f"{out}_s").alias("s")),
        lambda x: F.struct(x["t"].alias("text"), x["s"].alias("start"), (x["s"] + F.char_length(x["t"])).alias("end")),
    )
    empty = F.array().cast("array<struct<text:string,start:int,end:int>>")
    return df.withColumn(out, F.when(some, spans).otherwise(empty)).drop(*[f"{out}_{c}" for c in "mgls"])


def _luhn(digits: Column) -> Column:
    turned = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    shares = F.transform(turned, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.reduce(F.filter(shares, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return text.rlike(_BYTE)
    digits = F.regexp_replace(text, "[^0-9]", "")
    count = F.char_length(digits)
    return count.between(9, 15) if kind == "phone" else count.between(12, 19) & _luhn(digits)


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``base``: array of (start, order, end, kind) of the base kinds, by start and then kind."""
    df = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    guards = {"email": F.col("_text").contains("@"), "ip": F.col("_text").rlike(r"[0-9]\.[0-9]"), "card": F.col("_text").rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.col("_text").contains("+")}
    for kind, pattern in BASE.items():
        df = _found(df, "_text", pattern, f"_{kind}", guards[kind])

    def kept(kind: str) -> Column:
        named = lambda x: F.struct(x["start"].alias("start"), F.lit(ORDER[kind]).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"))
        return F.transform(F.filter(f"_{kind}", lambda x: _holds(kind, x["text"])), named)

    parts = [kept(kind) for kind in BASE]
    return df.withColumn("base", F.array_sort(F.concat(*parts))).drop(*[f"_{kind}" for kind in BASE])


class Trees:
    """Gradient-boosted depth-two trees over yes-no features, for the logistic loss."""

    def __init__(self, table: list[tuple[tuple[bool, ...], int, int]]):
        """``table`` holds every combination of features once, with its right and wrong rows."""
        self.trees: list[tuple] = []
        right, wrong = sum(r for _, r, _ in table), sum(w for *_, w in table)
        self.start = log((right + 1) / (wrong + 1))
        scores = [self.start] * len(table)
        width = len(table[0][0]) if table else 0
        for _ in range(TREES if width else 0):
            slopes = []
            for (_, r, w), score in zip(table, scores):
                p = 1 / (1 + exp(-score))
                slopes.append((r - (r + w) * p, (r + w) * p * (1 - p)))
            rows = list(range(len(table)))
            root = self._split(table, slopes, rows, width)
            sides = []
            for yes in (True, False):
                part = [i for i in rows if table[i][0][root] == yes]
                flag = self._split(table, slopes, part, width)
                leaves = [self._leaf(slopes, [i for i in part if table[i][0][flag] == leaf]) for leaf in (True, False)]
                sides.append((flag, *leaves))
            self.trees.append((root, *sides))
            scores = [s + self._value(self.trees[-1], row[0]) for s, row in zip(scores, table)]
        self.threshold = self._calibrate(table, scores)

    @staticmethod
    def _leaf(slopes, rows) -> float:
        return RATE * sum(slopes[i][0] for i in rows) / (sum(slopes[i][1] for i in rows) + 1.0)

    @staticmethod
    def _split(table, slopes, rows, width) -> int:
        def gain(flag: int) -> float:
            total = 0.0
            for side in (True, False):
                part = [i for i in rows if table[i][0][flag] == side]
                total += sum(slopes[i][0] for i in part) ** 2 / (sum(slopes[i][1] for i in part) + 1.0)
            return total

        return max(range(width), key=lambda flag: (gain(flag), -flag))

    @staticmethod
    def _value(tree, flags) -> float:
        root, yes, no = tree
        flag, a, b = yes if flags[root] else no
        return a if flags[flag] else b

    @staticmethod
    def _calibrate(table, scores) -> float:
        """The least score above which the wanted share of candidates is right."""
        best, right, wrong = float("inf"), 0, 0
        for score, (_, r, w) in sorted(zip(scores, table), key=lambda x: -x[0]):
            right, wrong = right + r, wrong + w
            if right >= PRECISION * (right + wrong):
                best = score
        return best - 1e-9

    def score(self, flags: Column) -> Column:
        """The model as an expression over an array of yes-no features."""
        def tree(root, yes, no):
            leaf = lambda side: F.when(flags[side[0]], F.lit(side[1])).otherwise(F.lit(side[2]))
            return F.when(flags[root], leaf(yes)).otherwise(leaf(no))

        total = F.lit(self.start)
        for one in self.trees:
            total = total + tree(*one)
        return total


def _flags(generator: Column, text: Column, before: Column) -> Column:
    return F.array(*[F.coalesce(flag(generator, text, before), F.lit(False)) for _, flag in FLAGS])


def training_rows(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """(generator, text, before, label): formats of personal data and of what resembles them, drawn by hash."""
    at = spark.range(0, rows, 1, 4)
    draw = lambda salt, low, high: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(high - low + 1)) + low).cast("int")
    digit = lambda salt, width: F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**width)).cast("string"), width, "0")
    block = lambda salt: F.format_string("%03d", draw(salt, 200, 999))
    hexes = lambda salt: F.lower(F.hex(draw(salt, 4096, 65535)))
    said = lambda *words: F.element_at(F.array(*map(F.lit, words)), draw("said", 1, len(words)))
    cue, other = said("call me: ", "phone ", "tel. ", "contact: ", "mobile no. ", "fax: "), said("in all ", "on ", "see page ", "item ", "about ", "")
    group = lambda salt: F.concat(F.lpad(hexes(salt), 4, "0"))
    forms = [
        ("number", F.concat(F.lit("("), block(1), F.lit(") "), block(2), F.lit("-"), digit(3, 4)), other, 1),
        ("number", F.concat(block(1), F.lit("-"), block(2), F.lit("-"), digit(3, 4)), F.when(draw(9, 0, 1) == 1, cue).otherwise(other), 1),
        ("number", F.concat(F.lit("0"), digit(1, 2), F.lit(" "), digit(2, 4), F.lit(" "), digit(3, 4)), cue, 1),
        ("number", F.concat(digit(1, 5), digit(2, 5)), cue, 1),
        ("number", F.concat(F.format_string("%03d", draw(1, 100, 665)), F.lit("-"), F.format_string("%02d", draw(2, 1, 99)), F.lit("-"), F.format_string("%04d", draw(3, 1, 9999))), other, 1),
        ("coded", F.concat(said("DE", "FR", "ES", "GB", "NL", "IT"), digit(1, 2), digit(2, 4), digit(3, 4), digit(4, 4), digit(5, 4)), other, 1),
        ("spelled", F.concat(F.lit("user"), digit(1, 2), F.lit(" [at] mail dot "), said("com", "org", "net")), other, 1),
        ("spelled", F.concat(F.lit("user"), digit(1, 2), F.lit(" at mail dot "), said("com", "org", "net")), other, 1),
        ("colons", F.concat_ws(":", *[group(i) for i in range(8)]), other, 1),
        ("number", F.concat(F.format_string("%04d", draw(1, 1900, 2049)), F.lit("-"), F.format_string("%02d", draw(2, 1, 12)), F.lit("-"), F.format_string("%02d", draw(3, 1, 28))), other, 0),
        ("number", F.concat(F.format_string("%02d", draw(1, 1, 28)), F.lit("/"), F.format_string("%02d", draw(2, 1, 12)), F.lit("/"), F.format_string("%04d", draw(3, 1900, 2049))), other, 0),
        ("number", digit(1, 8), other, 0),
        ("number", F.concat(digit(1, 8), digit(2, 8)), other, 0),
        ("number", F.concat(digit(1, 5), digit(2, 5)), other, 0),
        ("number", F.concat(digit(1, 3), F.lit(" "), digit(2, 3), F.lit(" "), digit(3, 3)), other, 0),
        ("number", F.concat(digit(1, 1), F.lit("."), digit(2, 2), F.lit("."), digit(3, 2), F.lit("."), digit(4, 3)), other, 0),
        ("number", F.concat(digit(1, 3), F.lit("-"), digit(2, 1), F.lit("-"), digit(3, 4), F.lit("-"), digit(4, 4)), other, 0),
        ("number", F.concat(block(1), F.lit("-"), block(2), F.lit("-"), digit(3, 4), said(". ", " ("), digit(4, 1)), cue, 0),
        ("number", F.concat(block(1), F.lit("-"), block(2), F.lit("-"), digit(3, 4), F.lit(" "), block(4), F.lit("-"), block(5), F.lit("-"), digit(6, 4)), cue, 0),
        ("coded", F.concat(said("AB", "XR", "QT", "ZZ", "KL", "MN"), digit(1, 2), digit(2, 4), digit(3, 4)), other, 0),
        ("spelled", F.concat(F.lit("look at this.then"), digit(1, 1)), other, 0),
        ("spelled", F.concat(F.lit("arrive at noon.we"), digit(1, 1)), other, 0),
        ("colons", F.concat_ws(":", *[digit(i, 2) for i in range(5)]), other, 0),
    ]
    place = F.pmod(F.col("id"), F.lit(len(forms)))
    pick = lambda n: F.coalesce(*[F.when(place == i, value if isinstance(value := form[n], Column) else F.lit(value)) for i, form in enumerate(forms)])
    return at.select(pick(0).alias("generator"), pick(1).alias("text"), pick(2).alias("before"), pick(3).alias("label"))


def fit(labelled: DataFrame) -> Trees:
    """Trees from labelled candidates (generator, text, before, label).

    Only the counts per combination of yes-no features reach the driver, which
    the generators bound, not the rows.
    """
    flags = _flags(F.col("generator"), F.col("text"), F.col("before"))
    counts = labelled.select(flags.alias("flags"), "label").groupBy("flags").agg(
        F.count_if(F.col("label") == 1).alias("right"), F.count_if(F.col("label") == 0).alias("wrong")
    )
    return Trees(sorted((tuple(row["flags"]), row["right"], row["wrong"]) for row in counts.collect()))


def find(docs: DataFrame, trees: Trees | None = None, text_col: str = "text") -> DataFrame:
    """Add ``base`` and ``spans``: arrays of (start, order, end, kind), in code points with the end exclusive.

    ``base`` holds the base kinds; ``spans`` adds the wider candidates whose
    score reaches the calibrated threshold and that meet no base span; they are
    taken by falling score, and only what is kept removes what it overlaps.  Null and empty texts have
    no spans; other columns are kept, repeated rows too.
    """
    trees = trees or fit(training_rows(docs.sparkSession))
    df = base_spans(docs, text_col)
    for name, pattern in (WIDE | BOUNDED).items():
        df = _found(df, "_text", pattern, f"_{name}", F.col("_text").rlike(GUARD[name]))

    def proposed(name: str) -> Column:
        return F.transform(f"_{name}", lambda x: F.struct(
            F.lit("number" if name in BOUNDED else name).alias("generator"), x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end")))

    parts = [proposed(name) for name in WIDE | BOUNDED]
    apart = lambda c, kept: ~F.exists(kept, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    df = df.withColumn("_wide", F.filter(F.array_distinct(F.concat(*parts)), lambda c: apart(c, F.col("base"))))

    def scored(c: Column) -> Column:
        start = F.greatest(c["start"] - CONTEXT, F.lit(0))
        before = F.substring(F.col("_text"), start + 1, c["start"] - start)
        flags = _flags(c["generator"], c["text"], before)
        kind = F.when(c["generator"] == "spelled", "email").when(c["generator"] == "coded", "iban").when(c["generator"] == "colons", "ip")
        kind = kind.when(flags[7], "ssn").otherwise("phone")
        return F.struct(trees.score(flags).alias("score"), c["start"].alias("start"), c["end"].alias("end"), kind.alias("kind"))

    df = df.withColumn("_scored", F.filter(F.transform("_wide", scored), lambda c: c["score"] >= F.lit(trees.threshold)))
    turns = F.array_sort(F.transform("_scored", lambda c: F.struct(
        (-c["score"]).alias("turn"), c["start"].alias("start"), (-c["end"]).alias("last"), c["end"].alias("end"), c["kind"].alias("kind"))))
    none = F.array().cast("array<struct<turn:double,start:int,last:int,end:int,kind:string>>")
    df = df.withColumn("_kept", F.reduce(turns, none, lambda kept, c: F.when(apart(c, kept), F.concat(kept, F.array(c))).otherwise(kept)))
    order = lambda kind: F.coalesce(*[F.when(kind == k, i) for k, i in ORDER.items()], F.lit(len(ORDER)))
    added = F.transform("_kept", lambda c: F.struct(
        c["start"].alias("start"), order(c["kind"]).alias("order"), c["end"].alias("end"), c["kind"].alias("kind")))
    df = df.withColumn("spans", F.array_sort(F.concat("base", added)))
    return df.drop("_text", "_wide", "_scored", "_kept", *[f"_{name}" for name in WIDE | BOUNDED])


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, trees: Trees | None = None, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in brackets, and ``chars_col`` counted anew.

    Overlapping spans become one mark, named by the first.  Null texts stay null.
    """
    df = find(docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text")), trees)
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        mark = F.array(F.substring(text, state["at"] + 1, x["start"] - state["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        out = F.when(x["start"] >= state["at"], F.concat(state["out"], mark)).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), out.alias("out"))

    done = F.reduce("spans", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.char_length(text))))
    changed, columns = F.size("spans") > 0, []
    clean = df.withColumn("clean", F.when(changed, done).otherwise(text))
    for name in docs.columns:
        value = F.col("row")[name]
        if name == text_col:
            value = F.col("clean")
        elif name == chars_col:
            value = F.when(changed, F.char_length("clean").cast(docs.schema[name].dataType)).otherwise(value)
        columns.append(value.alias(name))
    return clean.select(*columns)
