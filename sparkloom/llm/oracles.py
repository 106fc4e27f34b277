"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

OP1 = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

_LUHN = """list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(digits, length(digits) - i + 1, 1)::INT
  WHEN 2 * substr(digits, length(digits) - i + 1, 1)::INT > 9 THEN 2 * substr(digits, length(digits) - i + 1, 1)::INT - 9
  ELSE 2 * substr(digits, length(digits) - i + 1, 1)::INT END)) % 10 = 0"""

_MOD97 = """list_reduce(list_prepend(0, list_transform(string_split(substr(solid, 5) || substr(solid, 1, 4), ''), lambda c: ascii(c)::INT)),
  lambda r, c: CASE WHEN c >= 65 THEN (r * 100 + c - 55) % 97 ELSE (r * 10 + c - 48) % 97 END) = 1"""

#: kind: pattern, condition on the value v, needed score from context.
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(v, '.'), lambda p: p::HUGEINT)) <= 255"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length(digits) BETWEEN 13 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15"),
    "iban": (r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", _MOD97),
    "local_phone": (
        r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}",
        r"regexp_matches(near, '(?i)phone|tel|call|mobile|fax') AND NOT regexp_matches(near, '\+[0-9]{1,3} ?\n')",
    ),
}


def op3() -> str:
    parts = []
    for order, (kind, (pattern, holds)) in enumerate(_KINDS.items()):
        parts.append(
            f"""
SELECT doc_id, '{kind}' AS kind, {order} AS ord, s, s + length(v) AS e FROM (
  SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits, replace(v, ' ', '') AS solid,
         right(gaps[i], 40) || chr(10) || left(gaps[i + 1], 40) AS near FROM (
    SELECT doc_id, i, gaps, hits[i] AS v,
           (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, regexp_split_to_array(t, '{pattern}') AS gaps FROM d),
         unnest(range(1, len(hits) + 1)) AS u(i)))
WHERE {holds}"""
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
found AS (
  SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) AS spans,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) FILTER (ord < 4), '') AS base,
         count(*) AS n_spans, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN found USING (doc_id)
"""

OP5 = r"""
WITH said AS (
  SELECT conv_id, coalesce(nullif(trim(role), ''), 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text, turn
  FROM conversations),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS nth FROM said),
people AS (SELECT DISTINCT conv_id, role AS participant FROM said WHERE role <> 'system'),
lines AS (
  SELECT s.conv_id, participant, nth // 64 AS segment, nth, role = participant AS own,
         '<|im_start|>' || CASE WHEN role = participant THEN 'assistant' WHEN role = 'system' THEN role ELSE 'user name=' || role END || chr(10) AS head,
         text || '<|im_end|>' || chr(10) AS body
  FROM ranked s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, (sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant, segment ORDER BY nth ROWS UNBOUNDED PRECEDING))::BIGINT AS e
  FROM lines)
SELECT conv_id, participant, segment, count(*) AS n_messages, count(*) FILTER (own) AS n_own,
       string_agg(head || body, '' ORDER BY nth) AS rendered,
       coalesce(string_agg((e - length(body)) || ':' || e, ',' ORDER BY nth) FILTER (own), '') AS mask,
       coalesce(sum(length(body)) FILTER (own), 0)::BIGINT AS n_masked
FROM placed GROUP BY conv_id, participant, segment
"""

OP12 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS us,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d),
c AS (
  SELECT doc_id, t, us, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, coalesce(array_to_string(us[1:a], ''), '') AS prefix, coalesce(array_to_string(us[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(us[b + 1:], ''), '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
