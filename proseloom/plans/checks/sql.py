"""SQL fragments for the independent checks (DuckDB dialect).

The checks restate each operator over rows and windows instead of in-row
arrays, with an engine and regex library that share nothing with Spark.
"""

from __future__ import annotations

from ...functions import lexicons as L
from ...functions.patterns import SPACE, TRIM_CHARS, re2

MARK = "\x01"
QUOTES = "\"'”’"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def trim(x: str) -> str:
    return f"trim({x}, {lit(TRIM_CHARS)})"


def rtrim(x: str) -> str:
    return f"rtrim({x}, {lit(TRIM_CHARS)})"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(L.WORD)})"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def rx(pattern: str, ignore_case: bool = True, multiline: bool = False) -> str:
    return lit(re2(pattern, ignore_case, multiline))


def hits(x: str, pattern: str, ignore_case: bool = True, multiline: bool = False) -> str:
    return f"len(regexp_extract_all({x}, {rx(pattern, ignore_case, multiline)}))"


def has(x: str, pattern: str, ignore_case: bool = True, multiline: bool = False) -> str:
    return f"regexp_matches({x}, {rx(pattern, ignore_case, multiline)})"


def first(x: str, pattern: str, group: int = 0, ignore_case: bool = False) -> str:
    return f"regexp_extract({x}, {rx(pattern, ignore_case)}, {group})"


def sub(x: str, pattern: str, repl: str, ignore_case: bool = False) -> str:
    return f"regexp_replace({x}, {rx(pattern, ignore_case)}, {lit(repl)}, 'g')"


def raw_sub(x: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(repl)}, 'g')"


def nonempty(xs: str) -> str:
    return f"list_filter(list_transform({xs}, lambda z: {trim('z')}), lambda z: z <> '')"


def sentences(x: str) -> str:
    abbr = "|".join(L.ABBREVIATIONS)
    a = raw_sub(x, rf"([.!?]+[{QUOTES}]*)({SPACE})", rf"\1{MARK}\2")
    b = raw_sub(a, rf"(?i)(^|[^A-Za-z])({abbr}|[a-z])(\.[.!?]*[{QUOTES}]*){MARK}", r"\1\2\3")
    c = raw_sub(b, rf"([{QUOTES}]){MARK}({SPACE}+[a-z])", r"\1\2")
    return nonempty(f"string_split({c}, chr(1))")


def paragraphs(x: str, delimiter: str = L.BLANK_LINE) -> str:
    return nonempty(f"string_split_regex({x}, {rx(delimiter, False)})")


def spoken(x: str) -> str:
    body = r'["“]([^"“”]{1,1000}[^"“”]{0,1000})["”]'
    return nonempty(f"regexp_extract_all({x}, {lit(body)}, 1)")


def tags(x: str) -> str:
    after = f"regexp_extract_all({x}, {rx(L.TAG_AFTER, False)}, 1)"
    before = f"regexp_extract_all({x}, {rx(L.TAG_BEFORE, False)}, 1)"
    return f"list_transform(list_concat({after}, {before}), lambda z: lower(z))"


def rnd(x: str, digits: int = 2) -> str:
    f = float(10**digits)
    return f"(floor(({x}) * {f} + 0.5) / {f})"


def whole(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


def per1k(n: str, w: str) -> str:
    return f"(CASE WHEN {w} = 0 THEN 0.0 ELSE {rnd(f'CAST({n} AS DOUBLE) / (CAST({w} AS DOUBLE) / 1000.0)')} END)"


def share(a: str, b: str, digits: int = 3) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0 ELSE {rnd(div(a, b), digits)} END)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


# --- derived tables -------------------------------------------------------------

CAST = array(["Anna", "Marcus Vale", "Ilse", "Tobias"])


def _name(i: str) -> str:
    return f"{CAST}[CAST(({i}) % 4 AS INT) + 1]"


def story_text(text: str = "text", doc: str = "doc_id") -> str:
    line, who, other = trim("raw"), _name(f"{doc} + i - 1"), _name(f"{doc} + i")
    para = (
        f"(CASE WHEN (i - 1) % 6 = 0 THEN 'Chapter ' || ((i - 1) // 6) || chr(10) || chr(10) ELSE '' END) || "
        f"(CASE (i - 1) % 5 "
        f"WHEN 1 THEN '\"' || {line} || ',\" ' || {who} || ' said.' "
        f"WHEN 2 THEN {who} || ' whispered, \"' || {line} || '\" They thought about ' || {other} || "
        f"' and it was like a silence.' "
        f"WHEN 3 THEN {line} || ' Later that night ' || {who} || ' ran and grabbed the cold sword; ' || {who} || "
        f"'''s heart didn''t stop.' "
        f"WHEN 4 THEN {line} || chr(10) || chr(10) || '* * *' || chr(10) || chr(10) || 'The room was quiet when ' || "
        f"{who} || ' kissed ' || {other} || ' and they were together.' "
        f"ELSE {line} END)"
    )
    nn = "chr(10) || chr(10) || "
    ending = (
        f"(CASE {doc} % 5 WHEN 1 THEN {nn}'Epilogue' || {nn}'After the war Anna went home and slept for a day.' "
        f"WHEN 2 THEN {nn}'Acknowledgements' || {nn}'To everyone who helped.' "
        f"WHEN 3 THEN {nn}'As an independent author I hope you leave an honest review. Goodbye.' "
        f"WHEN 4 THEN ' They waited and' ELSE {nn}'***' || chr(10) END)"
    )
    body = f"list_transform(string_split({text}, chr(10)), lambda raw, i: {para})"
    return f"(array_to_string({body}, chr(10) || chr(10)) || {ending})"


def stories_cte() -> str:
    return f"stories AS (SELECT source AS book_id, doc_id, {story_text()} AS text FROM documents WHERE text <> '')"


def library_cte() -> str:
    line = trim("x")
    each = lambda body: f"array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {body}), chr(10))"
    who = _name("d.doc_id")
    nl = "chr(10)"
    cast = (f"('Name: ' || {who} || {nl} || 'Protagonist: ' || {who} || ' wants the throne back before winter.' || {nl} "
            f"|| 'Age: 30' || {nl} || {each(f'''{lit('Trait ')} || (i - 1) || ': ' || {line}''')})")
    outline = (f"('Premise: A thief must steal one heart before dawn.' || {nl} || 'Ending: The city burns and ' || {who} "
               f"|| ' walks away.' || {nl} || {each(f'''{lit('- ')} || {line}''')})")
    dates = each(f"'Day ' || i || ': ' || {line}")
    world = (f"('# The world' || {nl} || {nl} || 'Setting: A drowned kingdom called Vell, ruled by a guild.' || {nl} || "
             f"{nl} || {each(f'''CASE WHEN (i - 1) % 3 = 0 THEN '## ' || {line} ELSE {line} END''')})")
    names = array(["Book ", "Draft novel ", "Reference study ", "Chapter file ", "", "Outline plan ", "Timeline ",
                   "World notes "])
    folders = array(["books", "drafts", "misc", "inbox", "characters", "plot", "history", "lore"])
    return f"""library AS (
      SELECT source AS book_id, d.doc_id, d.doc_id AS ord,
        CASE WHEN d.doc_id % 8 = 4 THEN 'Anna Vale'
             ELSE {names}[CAST(d.doc_id % 8 AS INT) + 1] || d.doc_id || '.md' END AS name,
        '/project/' || {folders}[CAST(d.doc_id % 8 AS INT) + 1] || '/' || d.doc_id AS path,
        CASE WHEN d.doc_id % 9 = 0 THEN 'text/plain' ELSE 'text/markdown' END AS mime,
        CASE d.doc_id % 8 WHEN 4 THEN {cast} WHEN 5 THEN {outline} WHEN 6 THEN {dates} WHEN 7 THEN {world}
             ELSE {story_text("text", "d.doc_id")} END AS text,
        CASE d.doc_id % 8 WHEN 0 THEN ['past_book', 'reference_book'] WHEN 1 THEN ['past_book']
             WHEN 2 THEN ['reference_book'] WHEN 3 THEN CAST([] AS VARCHAR[]) WHEN 4 THEN ['characters']
             WHEN 5 THEN ['plot'] WHEN 6 THEN ['timeline'] ELSE ['world'] END AS kinds,
        coalesce(l.quality, 0) = 1 AS voice_confirmed
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.text <> '')"""


def drafts_cte() -> str:
    return ("drafts AS (SELECT conv_id AS book_id, turn + 1 AS chapter, role || ' met Guide. ' || text AS text "
            "FROM conversations)")


def events_cte() -> str:
    return r"""run_events AS (
      SELECT user_id AS run_id, event_id AS seq, ts AS tat,
        CASE event_type WHEN 'view' THEN 'step' WHEN 'purchase' THEN 'system' WHEN 'error' THEN 'error' ELSE 'note' END AS kind,
        CASE event_type
          WHEN 'view' THEN 'Reading chapter-' || k || ' plan outline.md'
          WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'Searching the workspace.' ELSE 'Delegating to the editor' END
          WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'result done: true' ELSE 'token = abc123 validation passed' END
          WHEN 'error' THEN CASE k % 3 WHEN 0 THEN 'Error 429 rate limit' WHEN 1 THEN 'API error 503'
                            ELSE chr(27) || '[31mFailed' || chr(27) || '[0m step' END
          ELSE 'RUN_PROGRESS phase=writing_chapter percent=' || CAST(floor(value) AS BIGINT) || ' chapter=' || (k % 12 + 1)
               || ' detail=Drafting' END AS text,
        CASE WHEN k % 4 <> 0 THEN 's' || (k % 4) END AS session_id,
        CASE k % 4 WHEN 1 THEN 'Editor' WHEN 2 THEN 'Subagent' END AS agent, CAST(k % 4 AS INT) AS depth
      FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""
