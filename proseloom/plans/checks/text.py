"""Checks for structuring, metrics and scoring."""

from __future__ import annotations

from ...functions import lexicons as L
from . import sql as Q


def metric_ctes(source: str, keys: str, text: str = "text", delimiter: str = L.BLANK_LINE) -> str:
    """CTEs ``m_*`` and ``metrics(keys, counts, 24 metrics)`` over ``source``."""
    k = keys
    on = " AND ".join(f"a.{c} = b.{c}" for c in (x.strip() for x in keys.split(",")))
    join = lambda t, alias: f"LEFT JOIN {t} {alias} ON " + on.replace("b.", f"{alias}.").replace("a.", "t.")
    in_list = lambda xs, ws: f"len(list_filter({xs}, lambda z: z IN {Q.listed(ws)}))"
    return f"""
    m_par AS (SELECT {k}, unnest({Q.paragraphs(text, delimiter)}) AS p FROM {source}),
    m_ps AS (SELECT {k}, {Q.n_words('p')} AS pw, {Q.sentences('p')} AS ss FROM m_par),
    m_pstat AS (SELECT {k}, count(*) AS n_par, sum(pw) AS par_words, sum(len(ss)) AS n_sent,
        count(*) FILTER (len(ss) = 1) AS n_single FROM m_ps GROUP BY {k}),
    m_sent AS (SELECT {k}, unnest(ss) AS s FROM m_ps),
    m_len AS (SELECT {k}, n FROM (SELECT {k}, {Q.n_words('s')} AS n FROM m_sent) WHERE n > 0),
    m_sstat AS (SELECT {k}, count(*) AS s_n, sum(n) AS s_sum, sum(n * n) AS s_sq,
        quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90,
        count(*) FILTER (n < 5) AS s_short, count(*) FILTER (n > 30) AS s_long FROM m_len GROUP BY {k}),
    m_span AS (SELECT {k}, count(*) AS n_spans, sum(n) AS n_spoken FROM
        (SELECT {k}, {Q.n_words('s')} AS n FROM (SELECT {k}, unnest({Q.spoken(text)}) AS s FROM {source})) GROUP BY {k}),
    m_text AS (SELECT {k}, {Q.words(text)} AS w, {Q.tags(text)} AS tg, {text} AS tx FROM {source}),
    m_t AS (SELECT {k}, len(w) AS n_words, len(list_distinct(w)) AS n_distinct,
        {in_list('tg', L.PLAIN_TAGS)} AS n_plain, {in_list('tg', L.ORNATE_TAGS)} AS n_ornate,
        {in_list('w', L.ORNATE_TAGS)} AS n_ornw, {Q.hits('tx', L.LY_ADVERB)} AS n_ly,
        {in_list('w', L.FILTER_VERBS)} AS n_filter, {in_list('w', L.ABSTRACT_NOUNS)} AS n_abs,
        {Q.hits('tx', L.SIMILE)} AS n_sim, {Q.hits('tx', L.CONTRACTION)} AS n_con,
        length(tx) - length(replace(tx, ',', '')) AS n_comma, length(tx) - length(replace(tx, '-', '')) AS n_hyphen,
        length(tx) - length(replace(tx, ';', '')) AS n_semi, {Q.hits('tx', L.ELLIPSIS)} AS n_ell FROM m_text),
    m_all AS (SELECT t.*, coalesce(n_par, 0) AS n_par, coalesce(par_words, 0) AS par_words,
        coalesce(n_sent, 0) AS n_sent, coalesce(n_single, 0) AS n_single, coalesce(s_n, 0) AS s_n,
        coalesce(s_sum, 0) AS s_sum, coalesce(s_sq, 0) AS s_sq, coalesce(p10, 0) AS p10, coalesce(p50, 0) AS p50,
        coalesce(p90, 0) AS p90, coalesce(s_short, 0) AS s_short, coalesce(s_long, 0) AS s_long,
        coalesce(n_spans, 0) AS n_spans, coalesce(n_spoken, 0) AS n_spoken
      FROM m_t t {join('m_pstat', 'b')} {join('m_sstat', 'c')} {join('m_span', 'd')}),
    metrics AS (SELECT {k}, {metric_select()} FROM m_all)"""


def spread(n: str, s: str, sq: str) -> str:
    d = lambda x: f"CAST({x} AS DOUBLE)"
    return (f"(CASE WHEN {n} < 2 THEN 0.0 ELSE sqrt(greatest(({d(n)} * {d(sq)} - {d(s)} * {d(s)}) / "
            f"({d(n)} * {d(n)}), 0.0)) END)")


def metric_select() -> str:
    m = {
        "sentence_mean_words": Q.rnd(Q.div("s_sum", "s_n")),
        "sentence_median_words": Q.rnd("p50"),
        "sentence_stdev_words": Q.rnd(spread("s_n", "s_sum", "s_sq")),
        "sentence_p10_words": Q.rnd("p10"),
        "sentence_p90_words": Q.rnd("p90"),
        "sentence_fragment_rate": Q.share("s_short", "s_n"),
        "sentence_long_rate": Q.share("s_long", "s_n"),
        "paragraph_mean_words": Q.rnd(Q.div("par_words", "n_par")),
        "paragraph_mean_sentences": Q.rnd(Q.div("n_sent", "n_par")),
        "paragraph_single_rate": Q.share("n_single", "n_par"),
        "dialogue_word_share": Q.share("n_spoken", "n_words"),
        "dialogue_mean_line_words": Q.rnd(Q.div("n_spoken", "n_spans")),
        "dialogue_plain_tag_share":
            f"(CASE WHEN n_plain + n_ornate = 0 THEN 1.0 ELSE {Q.share('n_plain', '(n_plain + n_ornate)')} END)",
        "dialogue_ornate_per_1k": Q.per1k("n_ornw", "n_words"),
        "texture_ly_adverbs_per_1k": Q.per1k("n_ly", "n_words"),
        "texture_filter_verbs_per_1k": Q.per1k("n_filter", "n_words"),
        "texture_abstract_nouns_per_1k": Q.per1k("n_abs", "n_words"),
        "texture_similes_per_1k": Q.per1k("n_sim", "n_words"),
        "texture_contractions_per_1k": Q.per1k("n_con", "n_words"),
        "texture_commas_per_1k": Q.per1k("n_comma", "n_words"),
        "texture_em_dashes_per_1k": Q.per1k("n_hyphen", "n_words"),
        "texture_semicolons_per_1k": Q.per1k("n_semi", "n_words"),
        "texture_ellipses_per_1k": Q.per1k("n_ell", "n_words"),
        "texture_type_token_ratio": Q.share("n_distinct", "n_words"),
    }
    counts = "CAST(n_words AS BIGINT) AS word_count, CAST(n_sent AS BIGINT) AS sentence_count, " \
             "CAST(n_par AS BIGINT) AS paragraph_count"
    return counts + ", " + ", ".join(f"{m[c]} AS {c}" for c in L.METRIC_COLUMNS)


def pooled_ctes(source: str, group: str, text: str = "text", delimiter: str = L.BLANK_LINE) -> str:
    """CTE ``fingerprints`` of each group, from per-document ``m_*`` CTEs built here."""
    g = group
    return metric_ctes(source, f"{g}, doc_id", text, delimiter) + f""",
    f_len AS (SELECT {g}, count(*) AS s_n, sum(n) AS s_sum, sum(n * n) AS s_sq, quantile_cont(n, 0.1) AS p10,
        quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, count(*) FILTER (n < 5) AS s_short,
        count(*) FILTER (n > 30) AS s_long FROM m_len GROUP BY {g}),
    f_voc AS (SELECT {g}, count(DISTINCT x) AS n_distinct FROM (SELECT {g}, unnest(w) AS x FROM m_text) GROUP BY {g}),
    f_sum AS (SELECT {g}, {', '.join(f'sum({c}) AS {c}' for c in (
        'n_words', 'n_plain', 'n_ornate', 'n_ornw', 'n_ly', 'n_filter', 'n_abs', 'n_sim', 'n_con', 'n_comma',
        'n_hyphen', 'n_semi', 'n_ell', 'n_par', 'par_words', 'n_sent', 'n_single', 'n_spans', 'n_spoken'))}
        FROM m_all GROUP BY {g}),
    f_all AS (SELECT f_sum.*, coalesce(n_distinct, 0) AS n_distinct, coalesce(s_n, 0) AS s_n, coalesce(s_sum, 0) AS s_sum,
        coalesce(s_sq, 0) AS s_sq, coalesce(p10, 0) AS p10, coalesce(p50, 0) AS p50, coalesce(p90, 0) AS p90,
        coalesce(s_short, 0) AS s_short, coalesce(s_long, 0) AS s_long
      FROM f_sum LEFT JOIN f_len USING ({g}) LEFT JOIN f_voc USING ({g})),
    fingerprints AS (SELECT {g}, {metric_select()} FROM f_all)"""


def deviation_ctes(draft: str, author: str, group: str, key: str = "doc_id") -> str:
    """CTE ``dev`` of deviations of ``draft`` rows against ``author`` rows."""
    compared = [m for m in L.METRICS if m[3]]

    def floor_for(metric):
        return next((f for suffix, f in L.DRIFT_FLOORS if metric.endswith(suffix)), L.DRIFT_FLOOR_DEFAULT)

    rows = " UNION ALL ".join(
        f"SELECT d.{key}, {i} AS m_order, {Q.lit(m)} AS metric, {Q.lit(label)} AS label, CAST({w} AS DOUBLE) AS weight, "
        f"CAST({floor_for(m)} AS DOUBLE) AS flo, d.{c} AS draft, a.{c} AS author "
        f"FROM {draft} d JOIN {author} a USING ({group})"
        for i, (m, c, label, _, w) in enumerate(compared)
    )
    rank = "CASE severity WHEN 'blocker' THEN 3 WHEN 'major' THEN 2 ELSE 1 END"
    return f"""
    dev_pairs AS ({rows}),
    dev_drift AS (SELECT *, (draft - author) / greatest(author, flo) AS raw FROM dev_pairs
        WHERE NOT (draft = 0 AND author = 0)),
    dev_kept AS (SELECT *, floor(raw * 100.0 + 0.5) / 100.0 AS drift,
        CASE WHEN abs(raw) * weight >= 1.0 THEN 'blocker' WHEN abs(raw) * weight >= 0.5 THEN 'major' ELSE 'minor' END
          AS severity, CASE WHEN raw > 0 THEN 'above' ELSE 'below' END AS direction
        FROM dev_drift WHERE abs(raw) >= {L.DRIFT_TOLERANCE}),
    dev AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {rank} DESC, abs(drift) DESC, m_order) AS position
        FROM dev_kept)"""


def repetition_ctes(source: str, text: str = "text", delimiter: str = L.BLANK_LINE, key: str = "doc_id") -> str:
    """CTE ``rep`` of findings, with ``step`` telling the check; needs ``m_*``."""
    w = Q.words(text)
    return f"""
    r_tok AS (SELECT {key}, unnest({w}) AS word, generate_subscripts({w}, 1) AS pos FROM {source}),
    r_gram AS (SELECT {key}, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' ||
        lead(word, 3) OVER o AS gram FROM r_tok WINDOW o AS (PARTITION BY {key} ORDER BY pos)),
    r_phrase AS (SELECT {key}, 1 AS step, 'phrase' AS kind, gram AS value, count(*) AS n,
        CASE WHEN count(*) >= 5 THEN 'blocker' ELSE 'major' END AS severity
        FROM r_gram WHERE gram IS NOT NULL GROUP BY {key}, gram HAVING count(*) >= 3),
    r_open AS (SELECT {key}, array_to_string(list_slice({Q.words('s')}, 1, 2), ' ') AS o FROM m_sent),
    r_limit AS (SELECT {key}, greatest(4, ceil(count(*) * CAST(0.06 AS DOUBLE))) AS lim FROM m_sent GROUP BY {key}),
    r_opener AS (SELECT {key}, 2 AS step, 'sentence-opener' AS kind, o AS value, n,
        CASE WHEN n >= lim * 1.75 THEN 'major' ELSE 'minor' END AS severity
        FROM (SELECT {key}, o, count(*) AS n FROM r_open WHERE length(o) >= 3 GROUP BY {key}, o)
        JOIN r_limit USING ({key}) WHERE n >= lim),
    r_par AS (SELECT {key}, count(*) AS n, avg(pw) AS mean, stddev_pop(pw) AS dev FROM m_ps WHERE pw > 0 GROUP BY {key}),
    r_shape AS (SELECT {key}, 3 AS step, 'paragraph-shape' AS kind,
        {Q.whole('mean')} || ' words ±' || {Q.whole('dev')} AS value, n, 'major' AS severity
        FROM r_par WHERE n >= 6 AND mean > 0 AND dev / mean < 0.35),
    r_tag AS (SELECT {key}, 4 AS step, 'dialogue-tag' AS kind, t AS value, count(*) AS n,
        CASE WHEN count(*) >= 6 THEN 'major' ELSE 'minor' END AS severity
        FROM (SELECT {key}, unnest(tg) AS t FROM m_text) WHERE t NOT IN {Q.listed(L.IGNORED_TAGS)}
        GROUP BY {key}, t HAVING count(*) >= 4),
    r_lines AS (SELECT {key}, count(*) AS n, avg(c) AS mean, stddev_pop(c) AS dev FROM
        (SELECT {key}, {Q.n_words('s')} AS c FROM (SELECT {key}, unnest({Q.spoken(text)}) AS s FROM {source}))
        WHERE c > 2 GROUP BY {key}),
    r_line AS (SELECT {key}, 5 AS step, 'paragraph-shape' AS kind, 'dialogue lines ~' || {Q.whole('mean')} || ' words' AS value,
        n, 'major' AS severity FROM r_lines WHERE n >= 8 AND mean > 0 AND dev / mean < 0.4),
    rep AS (SELECT * FROM r_phrase UNION ALL SELECT * FROM r_opener UNION ALL SELECT * FROM r_shape UNION ALL
        SELECT * FROM r_tag UNION ALL SELECT * FROM r_line)"""
