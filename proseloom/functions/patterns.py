"""Spelling of the portable patterns in each engine's regex dialect.

Spark evaluates ``java.util.regex`` on the JVM; the checks run on an RE2 engine.
The two differ in what ``\\b``, ``\\s`` and ``$`` mean, so the lexicon keeps one
spelling with ASCII boundaries, Unicode white space and a strict text end.
"""

from __future__ import annotations

import re
from functools import lru_cache

# White space of the text model: ASCII controls plus the Unicode spaces.
SPACE_SET = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE = f"[{SPACE_SET}]"
# The same signs for Java: a letter is told apart by the table of low signs and one range, not sign by sign.
_HIGH_SPACES = SPACE_SET.partition(r"\x{00A0}")[2]
JAVA_SPACE_SET = SPACE_SET.replace(_HIGH_SPACES, rf"[\x{{1680}}-\x{{FEFF}}&&[{_HIGH_SPACES}]]")
JAVA_SPACE = f"[{JAVA_SPACE_SET}]"
TRIM_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
JAVA_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


PLAIN_WORDS = re.compile(r"\\b\(\?:[a-z0-9 |?():\-]+\)(?:\\w\*)?\\b")


# One item of a plain alternative: a sign or a group, with its quantifier.
ITEM = re.compile(r"(?:\(\?:[a-z0-9 |?\-]*\)|[a-z0-9 \-]|'|\[-? \]|\[ -\])\??")
WORD_LIST = re.compile(r"\\b\(\?:((?:[a-z0-9 |?'\-]|\[-? \]|\[ -\]|\(\?:[a-z0-9 |?\-]*\))+)\)")


def _split(alternatives: str) -> list[str]:
    """Alternatives at the top level."""
    out, depth = [""], 0
    for ch in alternatives:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def _shared(words: list[tuple[str, ...]]) -> str:
    """Alternatives with equal beginnings written once.

    Alternatives that begin with different signs exclude each other, so those
    that begin alike may move together; their own order stays, and nothing moves
    past an alternative that begins with anything but a plain sign.
    """
    out: list[tuple[str, list[tuple[str, ...]]]] = []
    begun: dict[str, int] = {}
    for word in words:
        head = word[0] if word else ""
        if len(head) != 1:
            begun = {}
            out.append(("", [word]))
        elif head in begun:
            out[begun[head]][1].append(word[1:])
        else:
            begun[head] = len(out)
            out.append((head, [word[1:]]))
    parts = []
    for head, rest in out:
        if len(rest) == 1:
            parts.append(head + "".join(rest[0]))
        else:
            parts.append(f"{head}{_shared(rest)}")
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _expand(items: list[str]) -> list[str]:
    """Every text that the items of an alternative stand for."""
    out = [""]
    for item in items:
        body = item[:-1] if item.endswith("?") else item
        if body.startswith("(?:"):
            choices = [x for part in _split(body[3:-1]) for x in _expand(ITEM.findall(part))]
        else:
            choices = list(body[1:-1]) if body.startswith("[") else [body]
        out = [x + y for x in out for y in (choices + [""] if body != item else choices)]
    return out


WORD_OR_STEM = re.compile(WORD_LIST.pattern + r"((?:\\w\*)?)\\b")


@lru_cache(maxsize=None)
def words_and_phrases(pattern: str) -> tuple[str, tuple[str, ...], bool, str, tuple[str, ...]]:
    """A list of words after a boundary in two: its single words, their texts, whether words only begin so; its phrases, their texts.

    Counts of the two add up to that of the list, as no single word stands in a
    phrase; a pattern of another form, or where one does, is all phrase without texts.
    """
    found = WORD_OR_STEM.fullmatch(pattern)
    if not found:
        return "", (), False, pattern, ()
    parts = [(a, _expand(ITEM.findall(a))) for a in _split(found[1])]
    if any("".join(ITEM.findall(a)) != a for a, _ in parts):
        return "", (), False, pattern, ()
    stem = bool(found[2])
    single = [(a, ws) for a, ws in parts if all(re.fullmatch("[a-z0-9]+", w) for w in ws)]
    phrases = [(a, ws) for a, ws in parts if (a, ws) not in single]
    words = tuple(dict.fromkeys(w for _, ws in single for w in ws))
    texts = tuple(dict.fromkeys(w for _, ws in phrases for w in ws))
    inner = {w for text in texts for w in re.split("[^a-z0-9]+", text)}
    if any(w.startswith(words) if stem else w in words for w in inner) or any(w == "" for w in inner):
        return "", (), False, pattern, ()
    rebuilt = lambda some: rf"\b(?:{'|'.join(a for a, _ in some)}){found[2]}\b" if some else ""
    return rebuilt(single), words, stem, rebuilt(phrases), texts


#: First signs tried one after the other at most, in :func:`any_word`.
BRANCHES = 5


@lru_cache(maxsize=None)
def any_word(lists: tuple[tuple[tuple[str, ...], bool], ...]) -> str:
    """Java pattern that matches every whole word that one of the lists (words, whether words only begin so) takes."""
    ends = {False: r"(?!\w)", True: r"\w*+"}
    words = sorted({(*w, ends[stem]) for texts, stem in lists for w in texts})
    heads = sorted({w[0] for w in words})
    some = [heads[i : i + BRANCHES] for i in range(0, len(heads), BRANCHES)]
    parts = [rf"(?=[{''.join(hs)}])(?:{_shared([w for w in words if w[0] in hs])})" for hs in some]
    return rf"(?i)(?=[{''.join(heads)}])(?<!\w)(?:{'|'.join(parts)})"


def _word_list(pattern: str) -> tuple[str, str]:
    """A list of words after a boundary, and the signs its words begin with; or the pattern as it is."""
    found = WORD_LIST.match(pattern)
    if not found:
        return pattern, ""
    words = [tuple(ITEM.findall(w)) for w in _split(found[1])]
    if any("".join(w) != v for w, v in zip(words, _split(found[1]))) or not all(w and w[0].isalnum() for w in words):
        return pattern, ""
    shared = _shared(words)
    shared = shared if shared.startswith("(?:") and len(words) > 1 and len({w[0] for w in words}) > 1 else f"(?:{shared})"
    return rf"\b{shared}{pattern[found.end():]}", "".join(sorted({w[0] for w in words}))


def _boundary(pattern: str, at: int, begins: str = "") -> str:
    """ASCII word boundary; the one-sided form where the neighbour is known."""
    if at == 0:
        # The class spares the list of words for all other signs.
        return rf"(?=[{begins}])(?<!\w)" if begins else r"(?<!\w)(?=\w)"
    if at == len(pattern) - 2 and PLAIN_WORDS.fullmatch(pattern):
        return r"(?!\w)"
    return JAVA_BOUNDARY


@lru_cache(maxsize=None)
def spell(pattern: str, dialect: str = "java", ignore_case: bool = False, multiline: bool = False) -> str:
    """Return ``pattern`` in the dialect ``java`` or ``re2``."""
    out, i, in_class, begins = [], 0, False, ""
    spaces = JAVA_SPACE_SET if dialect == "java" else SPACE_SET
    if dialect == "java":
        pattern, begins = _word_list(pattern)
    while i < len(pattern):
        ch = pattern[i]
        pair = pattern[i : i + 2]
        if ch == "\\":
            i += 2
            if pair == r"\b" and not in_class:
                out.append(_boundary(pattern, i - 2, begins) if dialect == "java" else pair)
            elif pair == r"\s":
                out.append(spaces if in_class else f"[{spaces}]")
            elif pair == r"\S" and not in_class:
                out.append(f"[^{spaces}]")
            elif pair == r"\S":
                out.append(r"\S")
            elif pair == r"\u":
                out.append(r"\x{" + pattern[i : i + 4] + "}")
                i += 4
            elif pair == r"\/":
                out.append("/")
            else:
                out.append(pair)
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        if ch == "$" and not in_class and not multiline:
            out.append(r"\z")
        elif ch == "[" and in_class and pattern[i - 1 : i] and out and out[-1] == "[":
            out.append(r"\[")
        else:
            out.append(ch)
        i += 1
    wide = ignore_case and dialect == "java" and not pattern.isascii()
    flags = ("iu" if wide else "i" if ignore_case else "") + ("m" if multiline else "")
    body = "".join(out).replace(r"[\s\S]", r"(?s:.)").replace(f"[{spaces}\\S]", r"(?s:.)")
    return (f"(?{flags})" if flags else "") + body


def java(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    return spell(pattern, "java", ignore_case, multiline)


def re2(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    return spell(pattern, "re2", ignore_case, multiline)
