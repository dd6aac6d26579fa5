"""The chunker in SQL: common table expressions for DuckDB, with a recursion where the job goes over a text in order."""

from __future__ import annotations

_NL = "chr(10)"
# The separators of the chunker, and the characters that cleaning replaces.
_SEPARATORS = (f"{_NL} || {_NL}", _NL, "'. '", "'? '", "'! '", "'; '", "', '", "' '")
_LENGTHS = (2, 1, 2, 2, 2, 2, 2, 1)
_FROM = "chr(160) || chr(8199) || chr(8239) || chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8211) || chr(8212) || chr(8722)"
_TO = "'   ''''\"\"---'"
_GONE = ("chr(173)", "chr(8203)", "chr(65279)")
_LIGATURES = (("chr(64256)", "'ff'"), ("chr(64257)", "'fi'"), ("chr(64258)", "'fl'"))


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    out = rf"regexp_replace({x}, '[ \t\f\v]+', ' ', 'g')"
    out = rf"regexp_replace({out}, '(^|\n)[^\S\n]+', '\1', 'g')"
    out = rf"regexp_replace({out}, '[^\S\n]+(\n|$)', '\1', 'g')"
    return rf"regexp_replace({out}, '\n{{3,}}', {_NL} || {_NL}, 'g')"


def basic(x: str) -> str:
    """Character repair, newlines, broken words and blanks."""
    out = f"translate({x}, {_FROM}, {_TO})"
    for gone in _GONE:
        out = f"replace({out}, {gone}, '')"
    for bad, good in _LIGATURES:
        out = f"replace({out}, {bad}, {good})"
    out = rf"regexp_replace({out}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
    out = rf"regexp_replace({out}, '\r\n?', {_NL}, 'g')"
    out = rf"regexp_replace({out}, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    return collapse(out)


def cleaned(source: str, p: str = "") -> str:
    """CTEs from source(doc_id, text) to {p}cleaned(doc_id, t), without documents of which nothing is left."""
    return f"{p}one_segment AS (SELECT doc_id, 0 AS seq, NULL::INT AS page, text FROM {source}),\n" + cleaned_pages(f"{p}one_segment", p)


def cleaned_pages(source: str, p: str = "") -> str:
    """CTEs from source(doc_id, seq, page, text) to {p}spans(doc_id, seq, page, start, stop) and {p}cleaned(doc_id, t)."""
    return rf"""{p}basic AS (SELECT doc_id, seq, page, {basic("coalesce(text, '')")} AS text FROM {source}),
{p}line_rows AS (
  SELECT doc_id, {strip('line')} AS line, count(*) OVER (PARTITION BY doc_id) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, {_NL})) AS line FROM {p}basic)),
{p}counts AS (SELECT doc_id, line, count(*) AS n, any_value(n_lines) AS n_lines FROM {p}line_rows WHERE line <> '' AND n_lines >= 4 GROUP BY doc_id, line),
{p}markers AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM {p}counts WHERE regexp_matches(line, '(?i)^\s*(?:page\s+)?\d+\s*(?:of|/)\s*\d+\s*$')),
{p}furniture AS (
  SELECT doc_id, line FROM {p}counts WHERE n >= greatest(4, floor(n_lines * 0.05)) AND (length(line) < 90 OR regexp_matches(line, '^\s*[-=_*~]{{3,}}\s*$'))
  UNION SELECT doc_id, line FROM {p}markers WHERE k >= 3),
{p}sets AS (SELECT doc_id, list(line) AS furniture FROM {p}furniture GROUP BY doc_id),
{p}kept AS (
  SELECT d.doc_id, seq, page, text, furniture, array_to_string(list_filter(string_split(text, {_NL}), lambda l: {strip('l')} = '' OR NOT list_contains(furniture, {strip('l')})), {_NL}) AS body
  FROM {p}basic d LEFT JOIN {p}sets USING (doc_id)),
{p}segments AS (SELECT doc_id, seq, page, t FROM (SELECT doc_id, seq, page, {strip(f"CASE WHEN furniture IS NULL THEN text ELSE {collapse('body')} END")} AS t FROM {p}kept) WHERE t <> ''),
{p}spans AS (SELECT doc_id, seq, page, start, start + length(t) AS stop FROM (SELECT *, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM {p}segments)),
{p}cleaned AS (SELECT doc_id, string_agg(t, {_NL} || {_NL} ORDER BY seq) AS t FROM {p}segments GROUP BY doc_id)"""


def references(p: str = "") -> str:
    """CTEs from {p}cleaned to {p}refs(doc_id, ref_start)."""
    heading = r"(?i)^[ \t]*(?:\d+(?:\.\d+)*[.)]?[ \t]*)?(references?|bibliography|works cited|literature cited)[ \t]*:?[ \t]*$"
    return rf"""{p}ref_lines AS (SELECT doc_id, unnest(string_split(t, {_NL})) AS line, generate_subscripts(string_split(t, {_NL}), 1) AS pos FROM {p}cleaned),
{p}ref_places AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs FROM {p}ref_lines),
{p}ref_looked AS (
  SELECT doc_id, offs, line, avg(CASE WHEN regexp_matches({strip('line')}, '(?i)^(?:\[\d+\]|arXiv:|https?://|doi:)') THEN 1.0 ELSE 0.0 END) OVER w AS share, count(*) OVER w AS ahead
  FROM {p}ref_places WHERE {strip('line')} <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING)),
{p}refs AS (SELECT doc_id, max(offs)::INT AS ref_start FROM {p}ref_looked WHERE ahead >= 3 AND share >= 0.15 AND regexp_matches(line, '{heading}') GROUP BY doc_id)"""


def _level(n: int, size: int, p: str) -> str:
    """Texts of {p}todo{n} longer than a chunk, cut before the n-th separator and put together again from the left."""
    sep, width = _SEPARATORS[n], _LENGTHS[n]
    step = f"CASE WHEN s.e - {{prev}} <= {size} THEN {{prev}} WHEN s.e - s.b > {size} THEN s.e ELSE s.b END"
    columns = "s.doc_id, s.low, s.high, s.k, s.n, s.b, s.e"
    return f"""{p}parts{n} AS (
  SELECT doc_id, low, high, unnest(ps) AS part, generate_subscripts(ps, 1)::INT AS k, len(ps)::INT AS n
  FROM (SELECT doc_id, low, high, string_split(substr(t, low + 2, high - low - 1), {sep}) AS ps FROM {p}todo{n} JOIN {p}cleaned USING (doc_id))),
{p}segs{n} AS (
  SELECT doc_id, low, high, k, n, (CASE WHEN k = 1 THEN low ELSE low + 1 + before + (k - 2) * {width} END)::INT AS b, (CASE WHEN k = n THEN high ELSE low + 1 + before + length(part) + (k - 1) * {width} END)::INT AS e
  FROM (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY doc_id, low ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {p}parts{n}) WHERE n > 1),
{p}walk{n} AS (
  SELECT {columns}, s.low AS prev, {step.format(prev="s.low")} AS start FROM {p}segs{n} s WHERE k = 1
  UNION ALL SELECT {columns}, w.start, {step.format(prev="w.start")} FROM {p}walk{n} w JOIN {p}segs{n} s ON s.doc_id = w.doc_id AND s.low = w.low AND s.k = w.k + 1),
{p}out{n} AS (
  SELECT doc_id, prev AS a, b AS z FROM {p}walk{n} WHERE e - prev > {size} AND b > prev
  UNION ALL SELECT doc_id, start, high FROM {p}walk{n} WHERE k = n AND high > start),
{p}todo{n + 1} AS (
  SELECT doc_id, b AS low, e AS high FROM {p}walk{n} WHERE e - prev > {size} AND e - b > {size}
  UNION ALL SELECT DISTINCT doc_id, low, high FROM {p}parts{n} WHERE n = 1)"""


def chunks(p: str = "", size: int = 500, overlap: int = 100) -> str:
    """CTEs from {p}cleaned and {p}refs to {p}chunks(doc_id, chunk_index, text, char_start, char_end, is_reference). They
    need WITH RECURSIVE."""
    last = len(_SEPARATORS)
    levels = ",\n".join(_level(n, size, p) for n in range(last))
    pieces = "\n  UNION ALL ".join(f"SELECT doc_id, a, z FROM {p}out{n}" for n in range(last))
    return rf"""{p}todo0 AS (SELECT doc_id, 0 AS low, length(t)::INT AS high FROM {p}cleaned WHERE length(t) > {size}),
{levels},
{p}every AS (
  {pieces}
  UNION ALL SELECT doc_id, k::INT, least(k + {size}, high)::INT FROM (SELECT doc_id, high, unnest(range(low, high, {size})) AS k FROM {p}todo{last})
  UNION ALL SELECT doc_id, 0, length(t)::INT FROM {p}cleaned WHERE length(t) <= {size}),
{p}pieces AS (SELECT doc_id, a, z, (row_number() OVER (PARTITION BY doc_id ORDER BY a))::INT AS k, (count(*) OVER (PARTITION BY doc_id))::INT AS n FROM {p}every),
{p}grow AS (
  SELECT doc_id, k, n, 0 AS start, z AS fin, NULL::INT AS a, NULL::INT AS z FROM {p}pieces WHERE k = 1
  UNION ALL
  SELECT doc_id, k, n, (CASE WHEN NOT over THEN start WHEN regexp_matches(substr(t, tail + 1, fin - tail), '\S') AND z - tail <= {size} THEN tail ELSE b END)::INT, z, CASE WHEN over THEN start END, CASE WHEN over THEN fin END
  FROM (SELECT *, (tail0 + length(regexp_extract(substr(t, tail0 + 1, fin - tail0), '^\S*')))::INT AS tail
        FROM (SELECT s.doc_id, s.k, s.n, s.a AS b, s.z, g.start, g.fin, s.z - g.start > {size} AS over, greatest(g.start, g.fin - {overlap}) AS tail0, c.t
              FROM {p}grow g JOIN {p}pieces s ON s.doc_id = g.doc_id AND s.k = g.k + 1 JOIN {p}cleaned c ON c.doc_id = g.doc_id))),
{p}found AS (
  SELECT doc_id, a, z FROM {p}grow WHERE z IS NOT NULL AND a IS NOT NULL
  UNION ALL SELECT doc_id, start, fin FROM {p}grow WHERE k = n),
{p}bodies AS (SELECT doc_id, a + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS a, {strip('raw')} AS text FROM (SELECT doc_id, a, substr(t, a + 1, z - a) AS raw FROM {p}found JOIN {p}cleaned USING (doc_id))),
{p}chunks AS (
  SELECT b.doc_id, (row_number() OVER (PARTITION BY b.doc_id ORDER BY a) - 1)::INT AS chunk_index, text, a::INT AS char_start, (a + length(text))::INT AS char_end,
         coalesce((2 * a + length(text)) / 2.0 >= ref_start, false) AS is_reference
  FROM {p}bodies b LEFT JOIN {p}refs r ON r.doc_id = b.doc_id WHERE text <> '')"""
