"""Document-level cleaning: markup, scaffolding and secrets out of the text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.patterns import java
from ..functions.scalar import col, count_matches, matches, replace_all, trim, trim_end


def html_to_markdown(html: Column | str) -> Column:
    """Web page to markdown prose: one rewrite per kind of tag, entities last."""
    c = col(html)
    c = F.regexp_replace(c, r"(?i)<style[\s\S]*?</style>|<script[\s\S]*?</script>", "")
    # Pair each span with its first closing tag in one pass, then let its own
    # attributes decide what it becomes.
    c = F.regexp_replace(c, r"(?i)<span([^>]*)>([\s\S]*?)</span>", "\x01$1\x02$2\x03")
    weight = java(r"font-weight\s*:\s*(?:bold|[7-9]00)", True)
    slant = java(r"font-style\s*:\s*italic", True)
    c = F.regexp_replace(c, rf"\x01[^\x02]*?{weight}[^\x02]*\x02([^\x03]*)\x03", "**$1**")
    c = F.regexp_replace(c, rf"\x01[^\x02]*?{slant}[^\x02]*\x02([^\x03]*)\x03", "*$1*")
    c = F.regexp_replace(c, r"\x01[^\x02]*\x02([^\x03]*)\x03", "$1")
    c = F.regexp_replace(c, java(r"<(strong|b)(?:\s[^>]*)?>", True), "**")
    c = F.regexp_replace(c, r"(?i)</(strong|b)>", "**")
    c = F.regexp_replace(c, java(r"<(em|i)(?:\s[^>]*)?>", True), "*")
    c = F.regexp_replace(c, r"(?i)</(em|i)>", "*")
    for level in range(1, 7):
        heading = java(rf"<h{level}(?:\s[^>]*)?>([\s\S]*?)<\/h{level}>", True)
        c = F.regexp_replace(c, heading, "#" * level + " $1\n\n")
    c = F.regexp_replace(c, java(r"<br\s*\/?>", True), "\n")
    c = F.regexp_replace(c, r"(?i)</(?:p|div|li|tr|table|ul|ol)>", "\n\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    c = trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))
    for entity, plain in L.ENTITIES:
        c = F.regexp_replace(c, java(entity, True), plain)
    return c


def markdown_to_plain(markdown: Column | str) -> Column:
    """Markdown to plain text: heading marks, emphasis and code marks removed."""
    plain = F.transform(F.split(col(markdown), r"\r?\n"), lambda line: replace_all(line, r"^#{1,6}\s+", ""))
    c = F.regexp_replace(F.array_join(plain, "\n"), r"\*\*|\*|`", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.concat(trim_end(c), F.lit("\n"))


def prose(markdown: Column | str) -> Column:
    """Prose only: front matter, fences, headings, quotes, tables and rules dropped."""
    c = F.regexp_replace(col(markdown), r"\A---\n[\s\S]*?\n---\n", "")
    c = F.regexp_replace(c, r"```[\s\S]*?```", "")

    def keep(line: Column) -> Column:
        t = trim(line)
        scaffold = t.startswith("#") | t.startswith(">") | t.startswith("|") | matches(t, r"^[-*_]{3,}$", False)
        return ~scaffold

    c = F.array_join(F.filter(F.split(c, "\n"), keep), "\n")
    return trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def redact(text: Column | str) -> Column:
    """Credential-shaped text replaced, six rewrites in order."""
    c = col(text)
    for _, pattern, ignore_case, replacement in L.REDACTIONS:
        c = replace_all(c, pattern, replacement, ignore_case)
    return c


def redaction_counts(text: Column | str) -> dict[str, Column]:
    """Hits per class, each counted on what the earlier rewrites left."""
    c, out = col(text), {}
    for name, pattern, ignore_case, replacement in L.REDACTIONS:
        out[f"n_{name}"] = count_matches(c, pattern, ignore_case).cast("long")
        c = replace_all(c, pattern, replacement, ignore_case)
    return out


def redact_table(df: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """``(key, text, n_<class>...)`` with the secrets gone and counted."""
    return df.select(*key, redact(text).alias("text"), *[c.alias(n) for n, c in redaction_counts(text).items()])


def redaction_report(df: DataFrame, group: str, text: str = "text") -> DataFrame:
    """Redactions per group and class; counted in the row, summed map side first."""
    names = [f"n_{r[0]}" for r in L.REDACTIONS]
    counted = df.select(group, *[c.alias(n) for n, c in redaction_counts(text).items()])
    return counted.groupBy(group).agg(
        F.count(F.lit(1)).alias("documents"), *[F.sum(n).cast("long").alias(n) for n in names]
    )
