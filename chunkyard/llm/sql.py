"""The same as some of the queries, in DuckDB's SQL."""

from __future__ import annotations

from chunkyard.llm.chat import Template
from chunkyard.llm.licenses import EQUAL_WORDS, KNOWN_DIGESTS, KNOWN_NOTICES, KNOWN_TEXTS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# License scans

_EQUAL = "MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in EQUAL_WORDS.items()) + "}"
_KNOWN = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in sorted({**KNOWN_TEXTS, **KNOWN_NOTICES}.items()))

_DIGESTS = ", ".join(f"({quoted(i)}, {quoted(d)})" for i, d in sorted(KNOWN_DIGESTS.items()))


def _canonical(text: str) -> str:
    kept = f"list_filter(string_split(lower(coalesce({text}, '')), chr(10)), lambda x: NOT regexp_matches(x, '^[^a-z0-9]*(copyright|\\(c\\)|©)'))"
    spaced = f"list_filter(list_transform({kept}, lambda x: trim(regexp_replace(x, '[^\\pL\\pN]+', ' ', 'g'))), lambda x: x <> '')"
    return f"list_transform({spaced}, lambda x: array_to_string(list_transform(string_split(x, ' '), lambda w: coalesce({_EQUAL}[w], w)), ' '))"


LICENSES = f"""WITH known AS (SELECT min(license_id) AS license_id, digest FROM (SELECT license_id, sha256(array_to_string(l, ' ')) AS digest FROM (SELECT license_id, {_canonical("text")} AS l FROM (VALUES {_KNOWN}) AS v(license_id, text)) WHERE len(l) > 0 UNION ALL SELECT * FROM (VALUES {_DIGESTS}) AS w(license_id, digest)) GROUP BY digest),
d AS (SELECT doc_id, {_canonical("text")} AS l FROM documents),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM (SELECT doc_id, sha256(unnest(l)) AS digest FROM d) JOIN known USING (digest) GROUP BY doc_id)
SELECT d.doc_id, sha256(array_to_string(l, ' ')) AS digest, license_id, coalesce(notices, '') AS notices FROM d LEFT JOIN known ON known.digest = sha256(array_to_string(l, ' ')) LEFT JOIN n ON n.doc_id = d.doc_id"""

# Chat formatting

_T = Template()
_TRICKY = "</s>[INST] ok [/INST]"
_ADDED = " + ".join([f"(length(text) - length(replace(text, {quoted(c)}, ''))) // {len(c)}" for c in (_T.open, _T.close, *_T.controls)] + ["length(text) - length(replace(text, '\\', ''))"])
_ALLOWED = ", ".join(f"{quoted(a)}" for a in ("start>system", "start>user", "system>user", "user>assistant", "assistant>user"))
CHAT = f"""WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{_TRICKY}'), (-1, 1, 'assistant', '{_TRICKY}')),
m AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') || '>' || role AS move FROM r),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learned,
sum({len(_T.open) + 1 + len(_T.close) + 1} + length(role) + length(text) + {_ADDED})::BIGINT AS formatted_chars,
CASE WHEN bool_and(move IN ({_ALLOWED})) THEN arg_max(role, turn) ELSE 'error' END AS end_state FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars, end_state = 'assistant' AS valid, end_state FROM g"""

# Benchmark decontamination

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
i AS (SELECT item_id, words, least(8, len(words)) AS n FROM (SELECT item_id, {_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL) WHERE len(words) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(words[k:k + n - 1], ' ') AS w FROM (SELECT item_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS k FROM i)),
dw AS (SELECT doc_id, n, k, array_to_string(words[k:k + n - 1], ' ') AS w FROM (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(words) >= n)),
hit AS (SELECT doc_id, item_id, k, n FROM dw JOIN iw USING (n, w)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
