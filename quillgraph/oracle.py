"""Pieces of the SQL that checks the registered queries (DuckDB)."""

from __future__ import annotations

from .functions import lexicon as lex

STOP = ", ".join(f"'{w}'" for w in lex.SEARCH_STOP)
TOPIC_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(lex.TOPIC_STOP))
TECH = "|".join(lex.TECH_ENDINGS)


def fold(t: str) -> str:
    """An expression that folds the word in column or expression `t`, through nested scalar subqueries."""
    steps = [
        """CASE WHEN length(s) > 4 AND ends_with(s, 'ies') THEN left(s, length(s) - 3) || 'y'
                WHEN length(s) > 4 AND regexp_matches(s, '(ch|sh|ss|x|z)es$') THEN left(s, length(s) - 2)
                WHEN length(s) > 3 AND ends_with(s, 's') AND NOT ends_with(s, 'ss') AND NOT ends_with(s, 'us') THEN left(s, length(s) - 1) ELSE s END""",
        "CASE WHEN length(s) > 5 AND ends_with(s, 'ing') THEN left(s, length(s) - 3) WHEN length(s) > 4 AND ends_with(s, 'ed') THEN left(s, length(s) - 2) ELSE s END",
        "CASE WHEN length(s) > 5 AND (ends_with(s, 'tion') OR ends_with(s, 'sion')) THEN left(s, length(s) - 3) ELSE s END",
        "CASE WHEN length(s) > 5 AND ends_with(s, 'ly') THEN left(s, length(s) - 2) ELSE s END",
        "CASE WHEN length(s) > 4 AND ends_with(s, 'e') THEN left(s, length(s) - 1) ELSE s END",
        "CASE WHEN length(s) > 3 AND s[-1] = s[-2] AND s[-1] NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(s, length(s) - 1) ELSE s END",
    ]
    out = f"list_value({t})"
    for step in steps:
        out = f"list_transform({out}, lambda s: {step})"
    return f"({out})[1]"


def tokens(text: str) -> str:
    """A list of a text's search tokens, folded."""
    return f"list_transform(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9_]+'), lambda t: length(t) >= 2 AND t NOT IN ({STOP})), lambda w: {fold('w')})"


def estimate(text: str) -> str:
    return f"CAST(ceil(greatest(len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')) * 1.3, length({text}) / 4)) AS BIGINT)"


CONV = "conv AS (SELECT conv_id AS doc_id, string_agg(role || ': ' || text, E'\\n\\n' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"

#: Notes made from turns by plain rules; the same as queries.base_notes.
NOTES = """notes AS (
  SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS seq, lpad(CAST(turn + 1 AS VARCHAR), 3, '0') AS id,
         list_slice(list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{4,}'))), 1, 4) AS entities,
         list_slice(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) BETWEEN 4 AND 9))), 1, 8) AS topics,
         text AS quote, ((conv_id * 31 + turn * 17) % 101) / 100.0 AS weight,
         CASE (conv_id + turn) % 6 WHEN 0 THEN ['DECISION', 'TECHNICAL'] WHEN 1 THEN ['ORIGIN'] WHEN 2 THEN ['CORE'] WHEN 3 THEN ['PIVOT'] ELSE [] END AS flags,
         CASE (conv_id + turn) % 5 WHEN 0 THEN '2023-0' || (turn % 9 + 1) || '-1' || (turn % 9) WHEN 1 THEN '2023-0' || (turn % 9 + 1) WHEN 2 THEN '2022' END AS resolved_date
  FROM conversations)"""

#: Links between notes that share a topic word; the same as queries.base_links.
LINKS = """links AS (
  SELECT a.doc_id, a.id AS from_id, b.id AS to_id FROM notes a JOIN notes b ON a.doc_id = b.doc_id AND a.seq < b.seq
  WHERE len(list_intersect(a.topics, b.topics)) > 0)"""


def bm25(questions: str, notes: str = "notes") -> str:
    """CTEs down to `scored` (query_id, doc_id, seq, score); questions: query_id, doc_id, token, w, times."""
    return f"""
words AS (SELECT doc_id, seq, {tokens("concat_ws(' ', quote, array_to_string(topics, ' '), array_to_string(entities, ' '))")} AS ws FROM {notes}),
lens AS (SELECT doc_id, seq, len(ws) AS l FROM words),
whole AS (SELECT doc_id, count(*) AS n, avg(l) AS mean FROM lens GROUP BY doc_id),
tf AS (SELECT doc_id, seq, token, count(*) AS tf FROM (SELECT doc_id, seq, unnest(ws) AS token FROM words) GROUP BY ALL),
df AS (SELECT doc_id, token, count(*) AS df FROM tf GROUP BY ALL),
asked AS ({questions}),
scored AS (
  SELECT a.query_id, a.doc_id, tf.seq, sum(a.w * a.times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / CASE WHEN mean > 0 THEN mean ELSE 1 END))) AS score
  FROM asked a JOIN tf ON tf.doc_id = a.doc_id AND tf.token = a.token JOIN df ON df.doc_id = tf.doc_id AND df.token = tf.token
  JOIN lens ON lens.doc_id = tf.doc_id AND lens.seq = tf.seq JOIN whole ON whole.doc_id = tf.doc_id GROUP BY ALL)"""


QUESTIONS = "questions AS (SELECT conv_id AS query_id, conv_id AS doc_id, text FROM conversations WHERE turn = 0)"
OWN = f"own AS (SELECT query_id, doc_id, token, count(*) AS times FROM (SELECT query_id, doc_id, unnest({tokens('text')}) AS token FROM questions) GROUP BY ALL)"


# ---- whole notes of documents with planted sentences


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_in(words) -> str:
    return ", ".join(map(quoted, dict.fromkeys(words)))


def planted(pairs: tuple[tuple[str, str], ...]) -> str:
    """lined (doc_id, p: lines with two sentences put in), session (doc_id, date): the same as queries.planted_corpus."""
    rows = ", ".join(f"({i}, {quoted(a)}, {quoted(b)})" for i, (a, b) in enumerate(pairs))
    return f"""
said(k, one, two) AS (VALUES {rows}),
own AS (SELECT doc_id, string_split(text, E'\\n') AS ls FROM documents),
put AS (SELECT o.doc_id, ls, one, two, CAST(doc_id * 7 % (len(ls) + 1) AS INT) AS a, len(ls) AS n FROM own o JOIN said ON doc_id % {len(pairs)} = k),
put2 AS (SELECT *, CAST(a + doc_id * 5 % (n - a + 1) AS INT) AS b FROM put),
lined AS (SELECT doc_id, list_concat(list_concat(list_concat(ls[1:a], [one]), list_concat(ls[a + 1:b], [two])), ls[b + 1:]) AS p FROM put2),
whole AS (SELECT doc_id, array_to_string(p, E'\\n\\n') AS text FROM lined),
session AS (SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN NULL WHEN 0 THEN 31 ELSE 8 END AS d, CASE doc_id % 3 WHEN 2 THEN NULL WHEN 0 THEN 3 ELSE 5 END AS m, CASE WHEN doc_id % 3 < 2 THEN 2023 END AS y FROM documents)"""


def passages(next_start: str) -> str:
    """chunk (doc_id, seq, s, e, text) of `lined` and `whole`, by a walk over the paragraphs."""
    return f"""
pieces AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM lined),
placed AS (SELECT doc_id, i, piece, coalesce(sum(length(piece) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pl FROM pieces),
paras AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, CAST(pl + length(piece) - length(ltrim(piece, E' \\t')) AS INT) AS s,
         CAST(pl + length(rtrim(piece, E' \\t')) AS INT) AS e FROM placed WHERE trim(piece, E' \\t') <> ''),
walk AS (
  SELECT doc_id, idx, s AS cs, e AS ce, NULL::INT AS os, NULL::INT AS oe FROM paras WHERE idx = 0
  UNION ALL
  SELECT p.doc_id, p.idx, CASE WHEN p.e - w.cs > 800 THEN {next_start} ELSE w.cs END, p.e, CASE WHEN p.e - w.cs > 800 THEN w.cs END, CASE WHEN p.e - w.cs > 800 THEN w.ce END
  FROM walk w JOIN paras p ON p.doc_id = w.doc_id AND p.idx = w.idx + 1 JOIN whole d ON d.doc_id = p.doc_id),
spans AS (SELECT doc_id, os AS s, oe AS e FROM walk WHERE os IS NOT NULL UNION ALL SELECT doc_id, arg_max(cs, idx), arg_max(ce, idx) FROM walk GROUP BY doc_id),
chunk AS MATERIALIZED (
  SELECT s.doc_id, CAST(row_number() OVER (PARTITION BY s.doc_id ORDER BY s.s, s.e) AS INT) AS seq, s.s, s.e, substring(d.text, s.s + 1, s.e - s.s) AS text FROM spans s JOIN whole d USING (doc_id))"""


def _signals() -> str:
    rows = [f"('{kind}', {i}, '{name}', {quoted(p)})" for kind, table in (("flag", lex.FLAGS), ("emotion", lex.EMOTIONS)) for i, (name, ps) in enumerate(table.items()) for p in ps]
    implicit = " OR ".join(f"contains(substring(low, greatest(pl - 50, 0) + 1, least(pl, 50) + {len(p)}), {quoted(p)})" for p in lex.NEGATING_PHRASES)
    return f"""
phrase(kind, ord, name, phrase) AS (VALUES {", ".join(rows)}),
lows AS (SELECT doc_id, seq, lower(text) AS low FROM chunk),
held AS (SELECT l.*, kind, ord, name, phrase, string_split(low, phrase) AS parts FROM lows l, phrase WHERE contains(low, phrase)),
stands AS (SELECT doc_id, seq, low, kind, ord, name, phrase, list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(phrase) AS pl FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM held)),
bound AS (SELECT *, list_slice(regexp_split_to_array(trim(substring(low, CAST(greatest(pl - 50, 0) + 1 AS INT), CAST(least(pl, 50) AS INT)), E' \\n\\t'), '\\s+'), -6, -1) AS tail FROM stands
  WHERE NOT (pl > 0 AND regexp_matches(substring(low, CAST(pl AS INT), 1), '[a-z0-9_]')) AND NOT regexp_matches(substring(low, CAST(pl + length(phrase) + 1 AS INT), 1), '[a-z0-9_]')),
raised AS (SELECT DISTINCT doc_id, seq, kind, ord, name FROM bound
  WHERE len(list_filter(tail, lambda w: regexp_replace(w, '[^a-z'']', '', 'g') IN ({words_in(lex.NEGATORS)}))) = 0 AND NOT ({implicit.replace("greatest(pl - 50, 0) + 1", "CAST(greatest(pl - 50, 0) + 1 AS INT)").replace("least(pl, 50) +", "CAST(least(pl, 50) AS INT) +")})),
signal AS (SELECT doc_id, seq, list(name ORDER BY ord) FILTER (kind = 'flag') AS flags, list(name ORDER BY ord) FILTER (kind = 'emotion') AS emotions FROM raised GROUP BY ALL),
marked AS (SELECT doc_id, seq, len(ws) AS n, len(list_filter(ws, lambda w: regexp_replace(lower(w), '[^a-z'']', '', 'g') IN ({words_in(lex.WEIGHT_WORDS)}))) AS marks FROM (SELECT doc_id, seq, regexp_split_to_array(text, '\\s+') AS ws FROM chunk)),
signals AS (
  SELECT c.doc_id, c.seq, coalesce(flags, []) AS flags, coalesce(emotions, []) AS emotions,
    floor(least(least(len(list_filter(coalesce(flags, []), lambda f: f IN ({words_in(lex.WEIGHT_FLAGS)}))) * 0.35::DOUBLE, 0.9) + least(len(coalesce(emotions, [])) * 0.1::DOUBLE, 0.4) + marks / n * 0.5::DOUBLE, 1.0) * 100 + 0.5) / 100 AS raw_weight
  FROM chunk c JOIN marked USING (doc_id, seq) LEFT JOIN signal USING (doc_id, seq))"""


def _names() -> str:
    she, he = words_in(lex.SHE_NAMES), words_in(lex.HE_NAMES)
    return f"""
raw_name AS (SELECT DISTINCT doc_id, seq, regexp_replace(regexp_replace(unnest(regexp_split_to_array(text, '\\s+')), '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g'), '''s$', '') AS name FROM chunk),
maybe AS (SELECT r.doc_id, r.seq, name, text, regexp_escape(name) AS esc, regexp_escape(lower(name)) AS low FROM raw_name r JOIN chunk USING (doc_id, seq) WHERE length(name) > 1 AND regexp_matches(name, '^[A-Z]') AND name NOT IN ({words_in(lex.NO_NAMES)})),
name AS MATERIALIZED (
  SELECT doc_id, seq, name, strpos(text, name) AS pos, CASE WHEN lower(regexp_extract(name, '^[^\\s_-]*')) IN ({she}) THEN 'she' WHEN lower(regexp_extract(name, '^[^\\s_-]*')) IN ({he}) THEN 'he' END AS g FROM maybe
  WHERE regexp_matches(text, '[a-z0-9,;)]\\s+' || esc || '\\b') OR regexp_matches(text, '(?:^|\\n)\\s*' || esc || '\\s*:')
     OR NOT (regexp_matches(text, '\\b' || low || '\\b') OR (regexp_matches(name, '(ed|ing)$') AND name = name[1] || lower(substring(name, 2))))),
met AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq, pos, name) AS m FROM name),
said_by AS (SELECT doc_id, seq, regexp_matches(text, '(?i)\\b(she|her|hers|herself)\\b') AS she, regexp_matches(text, '(?i)\\b(he|him|his|himself)\\b') AS he, regexp_matches(text, '(?i)\\b(they|them|their|theirs)\\b') AS they FROM chunk),
prior AS (SELECT c.doc_id, c.seq, m.name, m.g, max(m.m) AS m FROM chunk c JOIN met m ON m.doc_id = c.doc_id AND m.seq < c.seq GROUP BY ALL),
recent AS (SELECT doc_id, seq, arg_max(name, m) FILTER (g = 'she') AS she_name, arg_max(name, m) FILTER (g = 'he') AS he_name, (list(name ORDER BY m DESC))[1:2] AS last_two FROM prior GROUP BY ALL),
own_names AS (SELECT doc_id, seq, list(name) AS es, coalesce(bool_or(g = 'she'), false) AS has_she, coalesce(bool_or(g = 'he'), false) AS has_he FROM name GROUP BY ALL),
entity AS MATERIALIZED (
  SELECT s.doc_id, s.seq, list_sort(list_distinct(list_concat(list_concat(coalesce(es, []), list_filter([CASE WHEN she AND NOT coalesce(has_she, false) THEN she_name END, CASE WHEN he AND NOT coalesce(has_he, false) THEN he_name END], lambda x: x IS NOT NULL)),
    CASE WHEN they AND es IS NULL THEN coalesce(last_two, []) ELSE [] END))) AS entities
  FROM said_by s LEFT JOIN own_names USING (doc_id, seq) LEFT JOIN recent USING (doc_id, seq))"""


MONTHS_SQL = "|".join(sorted({m[:k] for m in lex.MONTHS for k in (3, len(m))} | {"sept"}, key=len, reverse=True))
#: (pattern, group of the day, of the month, of the year; 0: none), in their order.
DATE_FORMS = (
    (rf"(?i)\(.*?(?:\bon\s+)?(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTHS_SQL})[,.]?\s*(\d{{4}}).*?\)", 1, 2, 3),
    (rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTHS_SQL})[,.]?\s*(\d{{4}})\b", 1, 2, 3),
    (rf"(?i)\b({MONTHS_SQL})\s+(\d{{1,2}})(?:st|nd|rd|th)?[,.]?\s*(\d{{4}})\b", 2, 1, 3),
    (r"\b(\d{4})-(\d{2})-(\d{2})\b", 3, 2, 1),
    (rf"(?i)\b({MONTHS_SQL})\s+(\d{{4}})\b", 0, 1, 2),
    (r"(?i)\b(?:in|since|back in|around|during|of|from)\s+(\d{4})\b", 0, 0, 1),
)


def _hits(name: str, texts: str, keys: str) -> str:
    """`name` (keys, form, s, e, d, m, y): dates in `texts` (keys, text); of overlapping ones the first, unless a later one says more."""
    parts = []
    for k, (pattern, day, month, year) in enumerate(DATE_FORMS):
        # a found stretch is set between two marks; what stands before it gives its place
        cut = f"string_split(regexp_replace(text, {quoted(pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"
        get = [f"regexp_extract(hit, {quoted(pattern)}, {g})" if g else "NULL" for g in (day, month, year)]
        number = f"CAST({get[1]} AS INT)" if k == 3 else f"list_position([{words_in(m[:3] for m in lex.MONTHS)}], left(lower({get[1]}), 3))" if month else "NULL::INT"
        parts.append(
            f"SELECT {keys}, {k} AS form, s, s + length(hit) AS e, CAST({get[0]} AS INT) AS d, {number} AS m, CAST({get[2]} AS INT) AS y FROM ("
            f"SELECT {keys}, list_sum(list_transform(parts[1:i], lambda x: length(x))) - (i - 1) AS s, string_split(parts[i + 1], chr(2))[1] AS hit FROM ("
            f"SELECT *, unnest(range(1, len(parts))) AS i FROM (SELECT {keys}, {cut} AS parts FROM {texts} WHERE regexp_matches(text, '[0-9]{{4}}'))))"
        )
    return f"""
{name}_raw AS MATERIALIZED (
  SELECT *, CASE WHEN d IS NULL THEN CASE WHEN m IS NULL THEN 1 ELSE 3 END ELSE 7 END AS says, row_number() OVER (PARTITION BY {keys} ORDER BY s, e DESC, form) AS o
  FROM ({" UNION ALL ".join(parts)}) WHERE y BETWEEN 1900 AND 2100 AND (form = 3 OR d IS NULL OR d BETWEEN 1 AND 31)),
{name} AS MATERIALIZED (SELECT * FROM {name}_raw h WHERE NOT EXISTS (SELECT 1 FROM {name}_raw k WHERE {" AND ".join(f"k.{c} = h.{c}" for c in keys.split(", "))} AND k.o < h.o AND h.s < k.e AND h.e > k.s AND k.says >= h.says))"""


def _moved(unit: str, n: str) -> str:
    """The anchor (ay, am, ad) moved; only whole dates move by days, and days stay as they are when months move."""
    if unit == "month":
        total = f"(ay * 12 + am - 1 + {n})"
        return f"CASE WHEN am IS NULL THEN CAST(ay + floor({n} / 12) AS INT)::VARCHAR ELSE ({total} // 12) || '-' || lpad(({total} % 12 + 1)::VARCHAR, 2, '0') || coalesce('-' || lpad(ad::VARCHAR, 2, '0'), '') END"
    days = f"{n} * 7" if unit == "week" else n
    return f"CASE WHEN am IS NULL OR ad IS NULL THEN anchor ELSE strftime(make_date(ay, am, 1) + CAST(ad - 1 + {days} AS INT), '%Y-%m-%d') END"


def _relative() -> str:
    days = "|".join(lex.WEEKDAYS)
    gap = f"list_position([{words_in(lex.WEEKDAYS)}], regexp_extract(low, '\\b(last|next|this)\\s+({days})\\b', 2)) - 1 - dayofweek(make_date(ay, am, 1) + (ad - 1))"
    turn = f"regexp_extract(low, '\\b(last|next|this)\\s+({days})\\b', 1)"
    rules = [
        (r"\byesterday\b", _moved("day", "-1")), (r"\b(today|tonight)\b", "anchor"), (r"\btomorrow\b", _moved("day", "1")),
        (r"\blast\s+week\b", _moved("week", "-1")), (r"\bnext\s+week\b", _moved("week", "1")), (r"\bthis\s+week\b", "anchor"),
        (r"\blast\s+month\b", _moved("month", "-1")), (r"\bnext\s+month\b", _moved("month", "1")), (r"\bthis\s+month\b", "left(anchor, 7)"),
        (r"\blast\s+year\b", "(ay - 1)::VARCHAR"), (r"\bnext\s+year\b", "(ay + 1)::VARCHAR"),
    ]
    for unit in ("day", "week", "month"):
        ago = rf"\b(\d+)\s+{unit}s?\s+ago\b"
        later = r"\b(\d+)\s+days?\s+(?:from now|later)\b" if unit == "day" else rf"\bin\s+(\d+)\s+{unit}s?\b"
        rules += [(p, _moved(unit, f"{sign}CAST(regexp_extract(low, '{p}', 1) AS INT)")) for p, sign in ((ago, "-"), (later, ""))]
    sides = [(rf"\bthe\s+({days})\s+before\b", _moved("day", "-7")), (r"\bthe\s+week\s+before\b", _moved("week", "-1")), (rf"\bthe\s+({days})\s+after\b", _moved("day", "7")), (r"\bthe\s+week\s+after\b", _moved("week", "1"))]
    weekday = f"WHEN regexp_matches(low, '\\b(last|next|this)\\s+({days})\\b') AND ad IS NOT NULL THEN strftime(make_date(ay, am, 1) + CAST(ad - 1 + {gap} + CASE WHEN {turn} = 'last' AND {gap} >= 0 THEN -7 WHEN {turn} = 'next' AND {gap} <= 0 THEN 7 ELSE 0 END AS INT), '%Y-%m-%d')"
    whens = [f"WHEN regexp_matches(low, '{p}') THEN {v}" for p, v in rules] + [weekday] + [f"WHEN regexp_matches(low, '{p}') THEN {v}" for p, v in sides]
    return f"CASE WHEN anchor IS NULL THEN NULL {' '.join(whens)} END"


def _iso(y: str, m: str, d: str) -> str:
    return f"({y}::VARCHAR || coalesce('-' || lpad({m}::VARCHAR, 2, '0'), '') || coalesce('-' || lpad({d}::VARCHAR, 2, '0'), ''))"


def _dates() -> str:
    return f"""
{_hits("own_hit", "chunk", "doc_id, seq")},
{_hits("doc_hit", "whole", "doc_id")},
best_hit AS (SELECT doc_id, seq, {_iso("y", "m", "d")} AS day FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY (d IS NOT NULL)::INT * 2 + (m IS NOT NULL)::INT DESC, o) AS k FROM own_hit) WHERE k = 1),
before AS (SELECT c.doc_id, c.seq, arg_max({{'d': h.d, 'm': h.m, 'y': h.y}}, h.o) AS a FROM chunk c JOIN doc_hit h ON h.doc_id = c.doc_id AND h.s < c.s GROUP BY ALL),
anchored AS (
  SELECT c.doc_id, c.seq, lower(c.text) AS low, CASE WHEN a IS NULL THEN s.y ELSE a.y END AS ay, CASE WHEN a IS NULL THEN s.m ELSE a.m END AS am, CASE WHEN a IS NULL THEN s.d ELSE a.d END AS ad, CASE WHEN s.y IS NOT NULL THEN {_iso("s.y", "s.m", "s.d")} END AS session
  FROM chunk c JOIN session s USING (doc_id) LEFT JOIN before USING (doc_id, seq)),
told AS (SELECT *, CASE WHEN ay IS NOT NULL THEN {_iso("ay", "am", "ad")} END AS anchor FROM anchored),
dated AS (SELECT t.doc_id, t.seq, coalesce(day, {_relative()}, session) AS resolved_date FROM told t LEFT JOIN best_hit USING (doc_id, seq))"""


ROOT = "translate(replace(strip_accents(topic), 'ß', 'ss'), ' _-', chr(1) || chr(2) || chr(3))"


def topic_words(passages: str) -> str:
    """unigrams (doc_id, idx, low, freq, first, score), phrases and their parts; passages: doc_id, idx, text.

    Sums and products go from left to right, so that scores are the same doubles.
    """
    return f"""
parts AS (SELECT doc_id, idx, regexp_split_to_array(text, '\\s+') AS p FROM {passages}),
raw AS (SELECT doc_id, idx, len(p) AS n, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS w FROM parts),
shown AS (SELECT doc_id, idx, n, pos, regexp_replace(regexp_replace(w, '^[^A-Za-z0-9_-]+|[^A-Za-z0-9_-]+$', '', 'g'), '[''".,!?;:()\\[\\]{{}}]', '', 'g') AS shown FROM raw),
stream AS MATERIALIZED (SELECT *, lower(shown) AS low, length(shown) > 2 AND lower(shown) NOT IN ({TOPIC_STOP}) AS content FROM shown),
stats AS (SELECT doc_id, idx, n, low, count(*) AS freq, list(pos ORDER BY pos) AS ps, arg_min(shown, pos) AS sh, min(pos) AS first FROM stream WHERE content GROUP BY ALL),
unigrams AS MATERIALIZED (
  SELECT doc_id, idx, low, freq, first,
    freq / n * CASE WHEN freq > 1 THEN 1 + sqrt(list_sum(list_transform(ps, lambda p: (p - list_sum(ps) / freq) * (p - list_sum(ps) / freq))) / freq) / n ELSE 1 END
    * CASE WHEN regexp_full_match(sh, '[A-Z]{{2,}}') THEN 2.0::DOUBLE WHEN regexp_full_match(sh, '[A-Z][a-z]+([A-Z][a-z]*)+') THEN 2.5::DOUBLE
      WHEN contains(sh, '-') AND len(list_filter(string_split(sh, '-'), lambda x: length(x) < 2)) = 0 THEN 1.8::DOUBLE WHEN length(sh) > 6 AND regexp_matches(sh, '(?i)({TECH})$') THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS score FROM stats),
near AS (SELECT s.*, u.score, s.content AND length(replace(s.low, '-', '')) > 3 AS good FROM stream s LEFT JOIN unigrams u ON u.doc_id = s.doc_id AND u.idx = s.idx AND u.low = s.low),
ahead AS (SELECT *, lead(low, 1) OVER w AS low1, lead(good, 1) OVER w AS good1, lead(score, 1) OVER w AS score1, lead(low, 2) OVER w AS low2, lead(good, 2) OVER w AS good2, lead(score, 2) OVER w AS score2 FROM near WINDOW w AS (PARTITION BY doc_id, idx ORDER BY pos)),
grams AS (
  SELECT doc_id, idx, 2 * pos AS pl, [low, low1] AS parts, score * score1 AS v FROM ahead WHERE good AND good1 AND low <> low1
  UNION ALL SELECT doc_id, idx, 2 * pos + 1, [low, low1, low2], score * score1 * score2 FROM ahead WHERE good AND good1 AND good2 AND NOT (low = low1 AND low1 = low2)),
phrases AS MATERIALIZED (SELECT doc_id, idx, array_to_string(parts, ' ') AS phrase, parts, freq, first, CASE WHEN freq > 1 THEN v / (freq * freq + 1) ELSE v END AS score
  FROM (SELECT doc_id, idx, parts, count(*) AS freq, min(pl) AS first, arg_min(v, pl) AS v FROM grams GROUP BY ALL))"""


TOPICS = f"""
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, idx ORDER BY score DESC, first) AS k FROM phrases WHERE score > 0) WHERE k <= 4),
cover AS (SELECT doc_id, idx, low, max(score) * 1.5 AS lim FROM (SELECT doc_id, idx, unnest(list_distinct(parts)) AS low, score FROM best) GROUP BY ALL),
used AS (SELECT doc_id, idx, count(*) AS used FROM best GROUP BY ALL),
singles AS (
  SELECT u.doc_id, u.idx, u.low, u.score, row_number() OVER (PARTITION BY u.doc_id, u.idx ORDER BY u.score DESC, u.first) AS k
  FROM unigrams u LEFT JOIN cover c ON c.doc_id = u.doc_id AND c.idx = u.idx AND c.low = u.low WHERE c.lim IS NULL OR u.score > c.lim),
allt AS (
  SELECT doc_id, idx, phrase AS topic, score FROM best
  UNION ALL SELECT s.doc_id, s.idx, s.low, s.score FROM singles s LEFT JOIN used u ON u.doc_id = s.doc_id AND u.idx = s.idx WHERE k <= 8 - coalesce(used, 0)),
topics AS (SELECT * FROM (SELECT doc_id, idx, topic, CAST(row_number() OVER (PARTITION BY doc_id, idx ORDER BY score DESC, {ROOT}, topic) AS INT) AS rank FROM allt) WHERE rank <= 8)"""

#: Passages as topics see them: no brackets, no speakers.
CLEAN = r"""
speaker AS (SELECT doc_id, string_agg(n, '|' ORDER BY n) AS who FROM (SELECT doc_id, n FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '\b([A-Z][a-z]{2,15}):', 1))) AS n FROM whole) GROUP BY ALL HAVING count(*) >= 3) GROUP BY doc_id),
bare AS (SELECT doc_id, seq AS idx, regexp_replace(regexp_replace(text, '\([^)]{3,60}\)', ' ', 'g'), '(?m)^[A-Z][a-zA-Z]{1,20}:\s*', ' ', 'g') AS text FROM chunk),
clean AS (SELECT b.doc_id, idx, CASE WHEN who IS NULL THEN text ELSE regexp_replace(text, '(?i)\b(?:' || who || ')\b', ' ', 'g') END AS text FROM bare b LEFT JOIN speaker USING (doc_id))"""


def links(notes: str, least: float = 0.3, top: int = 3) -> str:
    """tied (doc_id, a, b, score, from_id, to_id, shared...): the links of `notes` (doc_id, seq, id, entities, topics), at most `top` at each."""
    return f"""
sets AS MATERIALIZED (SELECT doc_id, seq, id, entities, topics, list_distinct(entities) AS es, list_filter(list_distinct(flatten(list_transform(topics, lambda t: string_split(t, ' ')))), lambda w: length(w) >= 2) AS ws FROM {notes}),
size AS (SELECT doc_id, max(seq) AS n FROM sets GROUP BY doc_id),
both_sets AS (SELECT a.doc_id, a.seq AS a, b.seq AS b, len(list_intersect(a.es, b.es)) AS e, len(list_intersect(a.ws, b.ws)) AS w, len(a.es) AS ea, len(b.es) AS eb, len(a.ws) AS wa, len(b.ws) AS wb FROM sets a JOIN sets b ON a.doc_id = b.doc_id AND a.seq < b.seq),
near_sets AS (SELECT doc_id, a, b, greatest(CASE WHEN e > 0 THEN e / (ea + eb - e) * 1.2::DOUBLE ELSE 0 END, CASE WHEN w > 0 THEN w / (wa + wb - w) ELSE 0 END) AS score FROM both_sets),
queue AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, a, b) AS k FROM near_sets WHERE score >= {least}),
step AS (
  SELECT doc_id, 0::BIGINT AS k, list_transform(range(0, n), lambda x: 0) AS used, false AS ok FROM size WHERE doc_id IN (SELECT doc_id FROM queue)
  UNION ALL
  SELECT s.doc_id, q.k, CASE WHEN s.used[q.a] < {top} AND s.used[q.b] < {top} THEN list_transform(s.used, lambda u, i: u + CASE WHEN i = q.a OR i = q.b THEN 1 ELSE 0 END) ELSE s.used END, s.used[q.a] < {top} AND s.used[q.b] < {top}
  FROM step s JOIN queue q ON q.doc_id = s.doc_id AND q.k = s.k + 1),
tied AS MATERIALIZED (SELECT q.doc_id, q.a, q.b, q.score FROM queue q JOIN step s ON s.doc_id = q.doc_id AND s.k = q.k WHERE s.ok)"""


def weighted(notes: str, weight: str) -> str:
    """final (doc_id, seq, weight): weights with centrality in `tied`, by rank."""
    return f"""
deg AS (SELECT doc_id, seq, count(*) AS d FROM (SELECT doc_id, a AS seq FROM tied UNION ALL SELECT doc_id, b FROM tied) GROUP BY ALL),
blend AS (SELECT n.doc_id, n.seq, 0.8::DOUBLE * n.{weight} + 0.2::DOUBLE * CASE WHEN max(d) OVER (PARTITION BY n.doc_id) > 0 THEN coalesce(d, 0) / max(d) OVER (PARTITION BY n.doc_id) ELSE 0 END AS weight FROM {notes} n LEFT JOIN deg USING (doc_id, seq)),
mid AS (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY weight) - 1 + (count(*) OVER (PARTITION BY doc_id, weight) - 1) / 2 AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM blend),
ex AS (SELECT *, exp(r / greatest(n - 1, 1) / 0.5::DOUBLE - 2) AS x FROM mid),
lim AS (SELECT *, min(x) OVER (PARTITION BY doc_id) AS lo, max(x) OVER (PARTITION BY doc_id) AS hi FROM ex),
final AS (SELECT doc_id, seq, CASE WHEN n <= 1 THEN weight WHEN hi > lo THEN floor((x - lo) / (hi - lo) * 100 + 0.5) / 100 ELSE 1.0 END AS weight FROM lim)"""


def recalled(top: int = 5, hops: bool = False) -> str:
    """answers (query_id, doc_id, id, score, rank) from scored (BM25), notes, questions and, with hops, links: dates, walks, order."""
    month = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
    number = lambda x: f"lpad(list_position([{words_in(m[:3] for m in lex.MONTHS)}], left(lower({x}), 3))::VARCHAR, 2, '0')"
    one, two = rf"(?i)\b{month}\b[\s,]*(\d{{4}})\b", rf"(?i)\b(\d{{4}})\b[\s,]*{month}\b"
    pair = lambda p, y, m: f"list_transform(list_zip(regexp_extract_all(text, '{p}', {y}), regexp_extract_all(text, '{p}', {m})), lambda z: z[1] || '-' || {number('z[2]')})"
    out = rf"""
spoken AS (SELECT query_id, doc_id, list_concat({pair(one, 2, 1)}, {pair(two, 1, 2)}) AS months, regexp_extract_all(text, '\b((?:20|19)\d{{2}})\b', 1) AS years FROM questions),
spoken2 AS (SELECT query_id, doc_id, CASE WHEN len(months) > 0 THEN months ELSE years END AS qs FROM spoken),
asked_date AS (SELECT query_id, doc_id, q, i FROM (SELECT query_id, doc_id, unnest(qs) AS q, generate_subscripts(qs, 1) AS i FROM spoken2)),
speaks AS (
  SELECT query_id, doc_id, id, arg_min(bonus, i) AS bonus FROM (
    SELECT a.query_id, a.doc_id, n.id, i, CASE WHEN starts_with(resolved_date, q) OR starts_with(q, resolved_date) THEN 0.25::DOUBLE
      WHEN length(q) = 7 AND length(resolved_date) >= 7 AND abs((CAST(left(resolved_date, 4) AS INT) - CAST(left(q, 4) AS INT)) * 12 + CAST(substring(resolved_date, 6, 2) AS INT) - CAST(substring(q, 6, 2) AS INT)) = 1 THEN 0.1::DOUBLE ELSE 0 END AS bonus
    FROM asked_date a JOIN notes n ON n.doc_id = a.doc_id WHERE resolved_date IS NOT NULL)
  WHERE bonus > 0 GROUP BY ALL),
matched AS (SELECT s.query_id, s.doc_id, n.id, s.score / max(s.score) OVER (PARTITION BY s.query_id, s.doc_id) AS score FROM scored s JOIN notes n ON n.doc_id = s.doc_id AND n.seq = s.seq WHERE s.score > 0),
seeds AS MATERIALIZED (
  SELECT query_id, doc_id, id, sum(score) AS score FROM (SELECT * FROM matched UNION ALL SELECT s.* FROM speaks s WHERE (s.query_id, s.doc_id) IN (SELECT (query_id, doc_id) FROM matched)) GROUP BY ALL)"""
    if not hops:
        return out + f""",
answers AS (SELECT query_id, doc_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 9) DESC, id) AS rank FROM seeds) WHERE rank <= {top})"""
    steps = []
    for k in range(20):
        steps.append(f"""
w{k + 1} AS MATERIALIZED (
  SELECT p.query_id, p.doc_id, p.id, (0.15::DOUBLE + 0.85::DOUBLE * coalesce(i.idle, 0)) * p.p + coalesce(f.flow, 0) AS r FROM w0 p
  LEFT JOIN (SELECT query_id, doc_id, sum(r) AS idle FROM w{k} WHERE deg = 0 GROUP BY ALL) i USING (query_id, doc_id)
  LEFT JOIN (SELECT w.query_id, w.doc_id, e.b AS id, sum(0.85::DOUBLE * w.r / w.deg) AS flow FROM w{k} w JOIN arcs e ON e.doc_id = w.doc_id AND e.a = w.id GROUP BY ALL) f USING (query_id, doc_id, id))""".replace("AS r FROM w0 p", "AS r, p.p, p.deg FROM w0 p"))
    return out + f""",
arcs AS MATERIALIZED (SELECT doc_id, from_id AS a, to_id AS b FROM links UNION ALL SELECT doc_id, to_id, from_id FROM links),
degs AS (SELECT doc_id, a AS id, count(*) AS deg FROM arcs GROUP BY ALL),
w0 AS MATERIALIZED (
  SELECT q.query_id, n.doc_id, n.id, coalesce(s.score, 0) / q.total AS p, coalesce(s.score, 0) / q.total AS r, coalesce(d.deg, 0) AS deg FROM (SELECT query_id, doc_id, sum(score) AS total FROM seeds WHERE doc_id IN (SELECT doc_id FROM links) GROUP BY ALL) q
  JOIN notes n ON n.doc_id = q.doc_id LEFT JOIN seeds s ON s.query_id = q.query_id AND s.doc_id = q.doc_id AND s.id = n.id LEFT JOIN degs d ON d.doc_id = n.doc_id AND d.id = n.id),
{",".join(steps)},
walked AS (SELECT query_id, doc_id, id, r / max(r) OVER (PARTITION BY query_id, doc_id) AS r FROM w20),
mixed AS (SELECT w.query_id, w.doc_id, w.id, 0.6::DOUBLE * coalesce(s.score, 0) + 0.4::DOUBLE * w.r AS score FROM walked w LEFT JOIN seeds s USING (query_id, doc_id, id)
  UNION ALL SELECT query_id, doc_id, id, score FROM seeds WHERE doc_id NOT IN (SELECT doc_id FROM links)),
answers AS (SELECT query_id, doc_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 9) DESC, id) AS rank FROM mixed WHERE score > 0) WHERE rank <= {top})"""


def note_parts(pairs: tuple[tuple[str, str], ...], next_start: str, *parts: str) -> str:
    """Common table expressions of the notes of documents with planted sentences: passages and the parts asked for."""
    made = {"signals": _signals, "names": _names, "dates": _dates, "topics": lambda: f"{CLEAN},{topic_words('clean')},{TOPICS}"}
    return ",".join([planted(pairs), passages(next_start), *(made[p]() for p in parts)])
