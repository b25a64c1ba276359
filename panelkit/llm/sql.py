"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from panelkit.llm import chat, licenses, lm, quality

ORACLE: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _re2(value: str) -> str:
    """A literal as a regular expression."""
    return "".join(f"\\{c}" if c in r"\.+*?()|[]{}^$<>/" and c not in "<>/" else c for c in value)


def _lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_SPACED = r"[^\x20\x09-\x0D]+"
_CONTROLS = "|".join(map(_re2, chat.CONTROL))
_EXTRA = f"length(t) - length(replace(t, {_text(chat.ESCAPE)}, '')) + len(regexp_extract_all(t, {_text(_CONTROLS)}))"
_FRAME = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
_OWN = "</s>[INST] ok [/INST]"
ORACLE["op1_chat_format"] = f"""WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{_OWN}' UNION ALL SELECT -1, 1, 'assistant', '{_OWN}'),
  sized AS (SELECT *, role || text AS t FROM turns)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
    CAST(sum(length(t) + {_FRAME} + {_EXTRA}) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id"""

ORACLE["op2_stupid_backoff"] = f"""WITH docs AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_SPACED}') AS w FROM documents),
  tokens AS (SELECT k, len(w) AS size, unnest(w) AS c, unnest(list_prepend(NULL, w)[1:len(w)]) AS b, unnest(list_prepend(NULL, list_prepend(NULL, w))[1:len(w)]) AS a FROM docs WHERE len(w) > 0),
  total AS (SELECT count(*) AS n FROM tokens),
  one AS (SELECT k, c, count(*) AS own, sum(count(*)) OVER (PARTITION BY c) AS n FROM tokens GROUP BY k, c),
  two AS (SELECT k, b, c, count(*) AS own, sum(count(*)) OVER (PARTITION BY b, c) AS n FROM tokens WHERE b IS NOT NULL GROUP BY k, b, c),
  three AS (SELECT k, a, b, c, count(*) AS own, sum(count(*)) OVER (PARTITION BY a, b, c) AS n FROM tokens WHERE a IS NOT NULL GROUP BY k, a, b, c),
  others AS (SELECT t.*, greatest(o1.n - o1.own, 1) AS n1, greatest(total.n - size, 1) AS x1, o2.n - o2.own AS n2, p1.n - p1.own AS x2, o3.n - o3.own AS n3, p2.n - p2.own AS x3
    FROM tokens t CROSS JOIN total JOIN one o1 ON o1.k = t.k AND o1.c = t.c LEFT JOIN two o2 ON o2.k = t.k AND o2.b = t.b AND o2.c = t.c
      LEFT JOIN three o3 ON o3.k = t.k AND o3.a = t.a AND o3.b = t.b AND o3.c = t.c
      LEFT JOIN one p1 ON p1.k = t.k AND p1.c = t.b LEFT JOIN two p2 ON p2.k = t.k AND p2.b = t.a AND p2.c = t.b),
  scored AS (SELECT k, CASE WHEN n3 > 0 THEN ln(n3 / x3) WHEN n2 > 0 THEN ln(n2 / x2) + CASE WHEN a IS NOT NULL THEN ln({lm.ALPHA}) ELSE 0 END
      ELSE ln(n1 / x1) + CASE WHEN a IS NOT NULL THEN 2 * ln({lm.ALPHA}) WHEN b IS NOT NULL THEN ln({lm.ALPHA}) ELSE 0 END END AS s FROM others),
  sums AS (SELECT k, sum(s) AS s FROM scored GROUP BY k)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0.0), 4) AS log_score, round(s / len(w), 4) AS per_word FROM docs LEFT JOIN sums USING (k)"""


def _chain(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def _licenses() -> str:
    known = ", ".join(f"({_text(v)}, {_text(k)})" for v, k in licenses.KNOWN.items())
    alone = ", ".join(f"({_text(k)}, {_text(v)})" for k, v in licenses.ALONE.items())
    found = [f"CASE WHEN contains(l{n}, {_text(_chain(ids))}) THEN {_text(name)} END" for n, (name, ids) in enumerate(licenses.RULES)]
    steps = "s0 AS (SELECT *, chain AS l0 FROM chained)"
    for n, (_, ids) in enumerate(licenses.RULES):
        steps += f", s{n + 1} AS (SELECT *, replace(l{n}, {_text(_chain(ids))}, '|') AS l{n + 1} FROM s{n})"
    last = len(licenses.RULES)
    return rf"""WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents), known(sentence, id) AS (VALUES {known}), alone(id, name) AS (VALUES {alone}),
  cut AS (SELECT k, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM (
    SELECT k, string_split_regex(replace(text, chr(13), ''), '[.!?]+(?:[ \t]+|\n|$)|\n') AS parts FROM docs WHERE regexp_matches(text, '{licenses.HINT}'))),
  ids AS (SELECT k, i, id FROM cut JOIN known ON known.sentence = trim(regexp_replace(lower(s), '{licenses.NOT_NORMAL}', ' ', 'g'))),
  chained AS (SELECT d.k, d.doc_id, coalesce(string_agg(id, ',' ORDER BY i), '') AS sentence_ids, coalesce(string_agg('<' || id || '>', '' ORDER BY i), '') AS chain, count(id) AS n_known
    FROM docs d LEFT JOIN ids USING (k) GROUP BY d.k, d.doc_id), {steps},
  ruled AS (SELECT k, unnest(found) AS name, generate_subscripts(found, 1) AS i FROM (SELECT k, [{", ".join(found)}] AS found FROM s{last})),
  rest AS (SELECT k, unnest(left_over) AS id, generate_subscripts(left_over, 1) + {last} AS i FROM (SELECT k, regexp_extract_all(l{last}, '<([^>]+)>', 1) AS left_over FROM s{last})),
  named AS (SELECT k, name, min(i) AS i FROM (SELECT k, name, i FROM ruled WHERE name IS NOT NULL UNION ALL SELECT k, name, i FROM rest JOIN alone USING (id)) GROUP BY k, name),
  listed AS (SELECT k, string_agg(name, ',' ORDER BY i) AS licenses FROM named GROUP BY k)
  SELECT doc_id, sentence_ids, coalesce(licenses, '') AS licenses, n_known FROM s{last} LEFT JOIN listed USING (k)"""


ORACLE["op3_license_scan"] = _licenses()

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE["op6_decontaminate"] = f"""WITH docs AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
  items AS (SELECT item_id, regexp_extract_all({_lower("text")}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
  cut AS (SELECT item_id, w, least(len(w), 13) AS n FROM items WHERE len(w) > 0),
  windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM cut)),
  sizes AS (SELECT DISTINCT n FROM windows),
  spots AS (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
  hits AS (SELECT k, i, n, item_id FROM spots JOIN windows USING (n, s)),
  covered AS (SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS place FROM hits) GROUP BY k),
  found AS (SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY k)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM docs LEFT JOIN covered USING (k) LEFT JOIN found USING (k)"""


def _quality() -> str:
    word = r"[^\x20\x09-\x0D]+"
    chars = ", ".join(f"length(regexp_replace(t, {_text(c)}, '', 'g'))" for c in quality.CLASSES)
    common = ", ".join(f"len(list_filter(w, lambda x: lower(x) = {_text(c)}))" for c in quality.COMMON_WORDS)
    n_chars, n_common = len(quality.CLASSES), len(quality.COMMON_WORDS)
    sums = lambda column, n: "[" + ", ".join(f"sum({column}[{i + 1}])" for i in range(n)) + "]"

    def shares(counts: str, total: str) -> str:
        listed = f"list_append({counts}, {total} - list_sum({counts}))"
        return f"list_transform({listed}, lambda v: v / {total}::DOUBLE)"

    def distance(p: str, q: str) -> str:
        term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
        return f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {term('z[1]')} + {term('z[2]')})) / 2, 0))"

    return rf"""WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
  spots AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8)),
  twice AS (SELECT k, s FROM spots GROUP BY k, s HAVING count(*) > 1),
  covered AS (SELECT k, count(DISTINCT place) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS place FROM spots JOIN twice USING (k, s)) GROUP BY k),
  counted AS (SELECT k, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines, length(t) AS n_chars, [{chars}] AS chars, [{common}] AS common FROM docs),
  features AS (SELECT c.*, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM counted c LEFT JOIN covered USING (k)),
  refs AS (SELECT lang, {sums('chars', n_chars)} AS rc, sum(n_chars) AS rn, {sums('common', n_common)} AS rw, sum(n_words) AS rwn FROM features
    WHERE n_words >= {quality.MIN_WORDS} AND 20 * n_symbols <= n_words GROUP BY lang),
  apart AS (SELECT f.*, CASE WHEN rn >= {quality.MIN_REFERENCE_CHARS} AND n_chars >= {quality.MIN_CHARS} THEN {distance(shares('chars', 'n_chars'), shares('rc', 'rn'))} END AS class_distance,
    CASE WHEN rn >= {quality.MIN_REFERENCE_CHARS} AND n_words >= {quality.MIN_JUDGED_WORDS} THEN {distance(shares('common', 'n_words'), shares('rw', 'rwn'))} END AS word_distance
    FROM features f LEFT JOIN refs USING (lang)),
  judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM apart)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(class_distance > {quality.MAX_CLASS_DISTANCE}, FALSE) AND NOT coalesce(word_distance > {quality.MAX_WORD_DISTANCE}, FALSE) AS kept,
    round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM judged"""


ORACLE["op7_quality"] = _quality()
