"""The queries that SQL can express as plain SQL for an independent engine."""

from __future__ import annotations

from stridelog.llm.licenses import BASE, NOTICES
from stridelog.llm.secrets import KINDS

A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _chat() -> str:
    def coded(column: str, marks: str) -> str:
        """Code points of a text in which each of `marks` takes two."""
        return f"length({column})" + "".join(f" + length({column}) - length(replace({column}, '{m}', ''))" for m in marks)

    return rf"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 3 AS tokens,
         row_number() OVER w AS position,
         14 + {coded("role", "\\<#:")} + {coded("text", "\\<#")} AS chars
  FROM told WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
placed AS (
  SELECT *, sum(tokens) OVER w - tokens AS start,
         CASE WHEN first(role) OVER w = 'system' THEN first(tokens) OVER w ELSE 0 END AS system
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY position)),
laid AS (
  SELECT *, greatest(640 - system, 192) AS stride FROM placed),
turns AS (
  SELECT *, CASE WHEN position = 1 AND system > 0 THEN 0
       ELSE (start - system) // stride * 2
            + CASE WHEN (start - system + tokens - 1) // stride > (start - system) // stride THEN 1 ELSE 0 END
       END AS win FROM laid),
firsts AS (SELECT conv_id, win, min(position) AS first, min(start) AS at FROM turns GROUP BY ALL),
pieces AS (
  SELECT conv_id, win, chars FROM turns
  UNION ALL
  SELECT f.conv_id, f.win, t.chars FROM firsts f JOIN turns t
    ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.position < f.first
   AND ((t.position = 1 AND t.system > 0)
        OR (t.position >= f.first - 4 AND t.start >= f.at - 128)))
SELECT a.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows
FROM (SELECT conv_id, count(*) AS n_turns,
             sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY position)) AS turns_sha256,
             coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
             sha256(coalesce(string_agg(text, '' ORDER BY position) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256
      FROM turns GROUP BY conv_id) a
JOIN (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars, count(DISTINCT win) AS n_windows
      FROM pieces GROUP BY conv_id) b ON a.conv_id IS NOT DISTINCT FROM b.conv_id"""


def _licenses() -> str:
    rows = ", ".join(f"({i}, '{t.label}', {str(t.exact).lower()}, string_split('{t.words}', ' '))" for i, t in enumerate(BASE + NOTICES))
    return rf"""
WITH RECURSIVE templates(template, label, exact, words) AS (VALUES {rows}),
docs AS (
  SELECT row_number() OVER () AS line, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{A_Z}', '{A_Z.lower()}'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
places AS (
  SELECT template, label, exact, len(words) AS n, unnest(range(len(words))) AS place, unnest(words) AS word,
         unnest(list_concat([NULL], words[:len(words) - 1])) AS prior, unnest(list_concat(words[2:], [NULL])) AS follow FROM templates),
spots AS (
  SELECT line, unnest(range(len(words))) AS spot, unnest(words) AS word,
         unnest(list_concat([NULL], words[:len(words) - 1])) AS prior, unnest(list_concat(words[2:], [NULL])) AS follow FROM docs),
same AS (
  SELECT line, template, label, exact, n, spot, place, coalesce(s.follow = p.follow, false) AS pair
  FROM spots s JOIN places p USING (word) WHERE s.prior = p.prior OR s.follow = p.follow),
whole AS (
  SELECT line, label, exact, spot - place AS start, 1.0::DOUBLE AS cover FROM same
  WHERE exact GROUP BY line, template, label, exact, n, spot - place HAVING count(*) = n),
starts AS (
  SELECT DISTINCT line, template, label, n, spot - place AS start FROM same WHERE pair AND NOT exact),
likely AS (
  SELECT s.line, s.template, s.label, s.n, start
  FROM starts s JOIN same h ON h.line = s.line AND h.template = s.template AND h.pair AND h.spot - h.place - s.start BETWEEN 0 AND 8
  GROUP BY ALL HAVING count(DISTINCT h.place) >= 0.7 * (s.n - 1)),
marks AS (
  SELECT l.line, l.template, l.start, h.spot, list(DISTINCT h.place) AS fits
  FROM likely l JOIN same h ON h.line = l.line AND h.template = l.template AND h.spot - h.place - l.start BETWEEN 0 AND 8
  GROUP BY ALL),
longest AS (
  SELECT line, template, label, n, start, 0 AS step, list_transform(range(n + 1), lambda j: 0) AS best FROM likely
  UNION ALL
  SELECT l.line, l.template, l.label, l.n, l.start, step + 1,
         list_transform(range(1, l.n + 2), lambda k: list_max(list_transform(range(1, k + 1), lambda j:
           CASE WHEN j > 1 AND list_contains(m.fits, j - 2) THEN greatest(best[j], best[j - 1] + 1) ELSE best[j] END)))
  FROM longest l LEFT JOIN marks m ON m.line = l.line AND m.template = l.template AND m.start = l.start AND m.spot = l.start + step
  WHERE step <= l.n + 8),
spans AS (
  SELECT line, label, exact, start, cover FROM whole
  UNION ALL
  SELECT line, label, false, start, best[n + 1] / n::DOUBLE FROM longest WHERE step = n + 9 AND best[n + 1] / n::DOUBLE >= 0.7)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN (
  SELECT line, count(*) FILTER (WHERE exact) AS n_base, min(start) FILTER (WHERE exact) AS first_word,
         max(start) FILTER (WHERE exact) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
  FROM spans GROUP BY line) USING (line)"""


def _secrets() -> str:
    each = " UNION ALL ".join(
        f"""
  SELECT line, doc_id, owner, '{kind}' AS kind, {rank} AS rank, value, start, start + length(whole) AS stop FROM (
    SELECT line, doc_id, owner, wholes[i] AS whole, vals[i] AS value,
           (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(wholes[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
    FROM (SELECT *, unnest(range(1, len(wholes) + 1)) AS i
          FROM (SELECT line, doc_id, owner, regexp_extract_all(text, {pattern}) AS wholes,
                       regexp_extract_all(text, {pattern}, {group}) AS vals,
                       string_split_regex(text, {pattern}) AS gaps FROM docs)))
  WHERE length(value) >= {least}""" + "".join(f" AND regexp_matches(value, '{part}')" for part in holds)
        for kind, rank, raw, group, least, holds in KINDS
        for pattern in ["'" + raw.replace("'", "''") + "'"]
    )
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS line, doc_id, source AS owner, coalesce(text, '') AS text FROM documents),
spans AS ({each}),
owned AS (
  SELECT value, count(DISTINCT coalesce(owner, chr(1))) AS owners, count(DISTINCT (coalesce(owner, chr(1)), doc_id)) AS copies
  FROM spans GROUP BY value),
judged AS (
  SELECT line, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
         count(*) FILTER (WHERE owners < 3 AND copies < 100) AS n_live, count(*) FILTER (WHERE owners >= 3 OR copies >= 100) AS n_example,
         max(copies) AS most_docs, max(owners) AS most_owners
  FROM spans JOIN owned USING (value) GROUP BY line)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
       coalesce(most_docs, 0) AS most_docs, coalesce(most_owners, 0) AS most_owners
FROM docs LEFT JOIN judged USING (line)"""


ORACLES = {"op1_chat_windows": _chat(), "op4_license_scan": _licenses(), "op9_secret_ownership": _secrets()}
