"""The SQL of the operators that DuckDB can express."""

from __future__ import annotations

#: The white space between words.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

OP10 = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

OP4 = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(doc_id || '|17'), 1, 6) AS INTEGER) AS place
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][
           (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM c WHERE cap > 0),
m AS (
  SELECT arg_min(level, cap / w) AS level FROM (
    SELECT *, ((SELECT sum(source_size)::DOUBLE FROM s) * 1.5::DOUBLE - clamped) / free AS level FROM l)
  WHERE w * level <= cap),
p AS (
  SELECT source, source_size, CASE WHEN cap > 0 THEN
           least(cap, w * coalesce((SELECT level FROM m), 'inf'::DOUBLE)) ELSE 0 END AS target
  FROM c),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12::DOUBLE) ELSE 0 END AS whole
  FROM p),
r AS (SELECT *, greatest(target - whole * source_size, 0) AS rest FROM q),
k AS (SELECT source, place, sum(size) AS part FROM d GROUP BY source, place),
e AS (
  SELECT k.source, place, part, before, rest FROM (
    SELECT *, sum(part) OVER (PARTITION BY source ORDER BY place) - part AS before FROM k) k
  JOIN r ON k.source IS NOT DISTINCT FROM r.source
  WHERE before <= rest AND rest < before + part)
SELECT doc_id, size, r.source_size, r.target,
       CAST(whole * size + CASE WHEN d.place < e.place THEN size
              WHEN d.place = e.place AND 2 * (r.rest - e.before) > e.part THEN size
              ELSE 0 END AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
       LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""

_RULES = (
    "n_words < 50",
    "100 * n_repeat_words > 50 * n_words",
    "10 * n_symbols > n_words",
    "10 * n_dup_lines > 3 * n_lines",
    "word_chars < 2 * n_words OR word_chars > 20 * n_words",
)


def _host_rate(k: int) -> str:
    """The shrunk rate of rule k, from the sums in h (hosts) and a (all)."""
    mean = f"(f{k} / n)"
    between = f"((s{k} - n * {mean} * {mean} - (hosts - 1) * {mean} * (1 - {mean})) / (n - squares / n))"
    weight = f"""CASE WHEN n - squares / n <= 0 OR f{k} = 0 OR f{k} = n THEN 1e6::DOUBLE
      WHEN {between} <= 0 THEN 1e6::DOUBLE
      ELSE least(1e6::DOUBLE, greatest(2.0::DOUBLE, {mean} * (1 - {mean}) / {between} - 1)) END"""
    return f"(e{k} + {mean} * ({weight})) / (n_docs + ({weight})) > 0.5::DOUBLE"


OP6 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
x AS (
  SELECT doc_id, w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2] AS g, i
  FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x),
z AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM y, unnest([0, 1, 2]) AS v(k) WHERE c > 1 GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM d, unnest(string_split(t, chr(10))) AS u(line)
  WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{SPACES}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN z ON d.doc_id = z.doc_id),
h AS (
  SELECT source, count(*)::DOUBLE AS n_docs,
         {", ".join(f"(count(*) FILTER (WHERE {r}))::DOUBLE AS e{k}" for k, r in enumerate(_RULES))}
  FROM m WHERE source IS NOT NULL GROUP BY source),
a AS (
  SELECT sum(n_docs) AS n, count(*) AS hosts, sum(n_docs * n_docs) AS squares,
         {", ".join(f"sum(e{k}) AS f{k}, sum(e{k} * e{k} / n_docs) AS s{k}" for k in range(len(_RULES)))}
  FROM h),
r AS (SELECT source FROM h, a WHERE {" OR ".join(_host_rate(k) for k in range(len(_RULES)))}),
b AS (SELECT *, {_RULES[0]} OR {_RULES[1]} AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM r)) AS kept
FROM b
"""

OP13 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
h AS (
  SELECT doc_id, t, n,
         CAST('0x' || substr(g, 1, 8) AS BIGINT) % (n + 1) AS a,
         CAST('0x' || substr(g, 9, 8) AS BIGINT) % (n + 1) AS b,
         CAST('0x' || substr(g, 17, 8) AS BIGINT) % 100 AS whether,
         CAST('0x' || substr(g, 25, 8) AS BIGINT) % 100 AS which FROM d),
f AS (
  SELECT *, least(a, b) AS p, greatest(a, b) AS q,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR whether >= 90 THEN 'plain' WHEN which < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
c AS (
  SELECT *, substring(t, 1, p) AS prefix, substring(t, p + 1, q - p) AS middle,
         substring(t, q + 1, n - q) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""

ORACLES = {
    "op4_mix_sources": OP4,
    "op6_host_quality": OP6,
    "op10_exact_dedup": OP10,
    "op13_fill_in_middle": OP13,
}
