"""DuckDB SQL for the queries that SQL can express, written from the definitions."""

from __future__ import annotations

from spanloom.llm.quality_lines import BOILERPLATE, NAVIGATION, SENTENCE_MARK
from spanloom.llm.url_filter import PATTERN_RULES, SITE_RULES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _without_lookaround(pattern: str) -> str:
    """The same rule for a matcher without lookaround, for URLs of letters, digits and marks."""
    return pattern.replace("(?<![a-z0-9])", "(?:^|[^a-zA-Z0-9])").replace("(?![a-z0-9])", "(?:[^a-zA-Z0-9]|$)")


def op3_url_filter() -> str:
    sites = ", ".join(f"({_text(r.site)}, {_text(r.verdict)})" for r in SITE_RULES)
    blocks = " OR ".join(
        f"regexp_matches(target, {_text(_without_lookaround(r.pattern))})"
        for r in PATTERN_RULES
        if r.verdict == "block"
    )
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
lowered AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path,
         translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
           || substr(rest, length(raw) + 1) AS target FROM parts),
sites(site, verdict) AS (VALUES {sites}),
split_sites AS (
  SELECT site, verdict, split_part(site, '/', 1) AS h, substr(site, strpos(site, '/')) AS p FROM sites)
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(site, length(site)) AS rule,
  coalesce(arg_max(verdict, length(site)), CASE WHEN any_value({blocks}) THEN 'block' ELSE 'allow' END) AS verdict
FROM lowered LEFT JOIN split_sites
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY page_id
"""


def op4_secret_scan() -> str:
    kinds = {
        "assign": (
            r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
            r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            2, 6,
        ),
        "access": ("AKIA[A-Z0-9]+", 0, 20),
        "hex": ("[0-9a-f]+", 0, 24),
        "forge": ("gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
        "chat": ("xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
        "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
        "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    }
    parts = []
    for place, (kind, (pattern, group, least)) in enumerate(kinds.items()):
        p = _text(pattern)
        parts.append(f"""
  SELECT doc_id, {place} AS place, '{kind}' AS kind, s AS start, s + size AS "end" FROM (
    SELECT doc_id, size, judged,
      sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i) - size AS s FROM (
      SELECT doc_id, i, length(g[i]) AS gap, length(m[i]) AS size, length(j[i]) AS judged FROM (
        SELECT doc_id, g, m, j, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT doc_id, string_split_regex(text, {p}) AS g, regexp_extract_all(text, {p}) AS m,
                 regexp_extract_all(text, {p}, {group}) AS j FROM t))))
  WHERE judged >= {least}""")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
agg AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, place)
      FILTER (place < 3) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, place) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN agg USING (doc_id)
"""


def op6_quality_lines() -> str:
    letters = r"regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g')"
    fails = (
        f"(NOT regexp_matches(line, {_text(SENTENCE_MARK)}) OR regexp_matches(line, {_text(NAVIGATION)}) "
        f"OR regexp_matches(line, {_text(BOILERPLATE)}))"
    )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
line_counts AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup,
    coalesce(sum(length({letters.format("line")})) FILTER ({fails}), 0) AS lost
  FROM lines GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length({letters.format("text")}) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN line_counts USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 * word_chars AS kept
FROM counts
"""


def op8_chat_format() -> str:
    esc = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({esc.format("role")}) + length({esc.format("text")}) + 11)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def op11_topk_threshold() -> str:
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op12_fill_middle() -> str:
    draw = "('0x' || substr(h, {}, 8))::BIGINT"
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units FROM t),
d AS (
  SELECT *, len(units) AS n, {draw.format(1)} % (len(units) + 1) AS a, {draw.format(9)} % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR {draw.format(17)} % 100 >= 90 THEN 'plain'
         WHEN {draw.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix,
    array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(units[greatest(a, b) + 1:], '') AS suffix FROM d)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def op13_source_terms() -> str:
    rate = "1 + (1000000000::HUGEINT * ({} + 1)) // ({} + {})"
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM t),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(any_value(s.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM t)
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) s USING (lang, source) GROUP BY ALL),
r AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, {rate.format("coalesce(c.c, 0)", "g.n", "v.v")} AS p,
    {rate.format("kept.total", "v.n", "v.v")} AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM r WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""


def all_oracles() -> dict[str, str]:
    found = (
        op3_url_filter, op4_secret_scan, op6_quality_lines, op8_chat_format,
        op11_topk_threshold, op12_fill_middle, op13_source_terms,
    )
    return {f.__name__: f() for f in found}
