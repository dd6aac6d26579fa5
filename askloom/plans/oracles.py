"""DuckDB SQL with the results of the registered queries. Left out are those that SQL can't express."""

from __future__ import annotations

from askloom.plans import chunk_oracle
from askloom.plans.chunk_oracle import collapse as _collapse
from askloom.plans.chunk_oracle import strip as _strip
from askloom.schemas import EMPTY_CORPUS, INSTRUCTION, NO_ANSWER, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_NL = "chr(10)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+(?:''[a-z]+)?')"


def _terms(x: str) -> str:
    return f"list_distinct(list_filter({_tokens(x)}, lambda w: w NOT IN ({_STOP})))"


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _truncate(x: str, n: int) -> str:
    return rf"CASE WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace(substr({x}, 1, {n - 3}), '\s+$', '') || '...' END"


def _words(x: str) -> str:
    return rf"(CASE WHEN {_strip(x)} = '' THEN 0 ELSE len(regexp_split_to_array({_strip(x)}, '\s+')) END)"


def _sentences(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"


_ASKED = f"asked AS (SELECT item_id AS question_id, text AS question FROM benchmark WHERE {_strip("coalesce(text, '')")} <> '' AND length(text) <= 2000)"
_PAIRED = f"{_ASKED}, paired AS (SELECT d.doc_id, d.text, a.question_id, a.question FROM documents d JOIN asked a ON d.doc_id % (SELECT count(*) FROM asked) = a.question_id)"
_COVER = f"CASE WHEN len({_terms('question')}) = 0 THEN 1.0 ELSE len(list_intersect({_terms('question')}, {_terms('text')}))::DOUBLE / len({_terms('question')}) END"

# Fixed value: the shape of a heading line.
HEADING = r"^(?:\d+(?:\.\d+)*[.)]?\s+|[#*\x{2022}\-]\s*)?[A-Z][\w &/''-]{0,58}$"

_PAGES = rf"""paged AS (
  SELECT doc_id, s + 1 AS page, s AS seq, array_to_string(lines[s * 20 + 1 : s * 20 + 20], {_NL}) AS text
  FROM (SELECT doc_id, lines, unnest(range(0, (len(lines) - 1) // 20 + 1)) AS s FROM (SELECT doc_id, string_split(text, {_NL}) AS lines FROM documents WHERE text IS NOT NULL))),
spans AS (
  SELECT doc_id, page, start, start + length(text) AS "end" FROM (
    SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start
    FROM paged WHERE {_strip('text')} <> ''))"""

_BOILER = rf"""line_rows AS (
  SELECT doc_id, {_strip('line')} AS line, n_lines FROM (
    SELECT doc_id, len(string_split(text, {_NL})) AS n_lines, unnest(string_split(text, {_NL})) AS line FROM documents) WHERE n_lines >= 4),
counts AS (SELECT doc_id, line, count(*) AS n, any_value(n_lines) AS n_lines FROM line_rows WHERE line <> '' GROUP BY doc_id, line),
markers AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM counts WHERE regexp_matches(line, '(?i)^\s*(?:page\s+)?\d+\s*(?:of|/)\s*\d+\s*$')),
furniture AS (
  SELECT doc_id, line FROM counts WHERE n >= greatest(4, floor(n_lines * 0.05)) AND (length(line) < 90 OR regexp_matches(line, '^\s*[-=_*~]{{3,}}\s*$'))
  UNION SELECT doc_id, line FROM markers WHERE k >= 3)"""

_HITS = """queries AS (SELECT vec_id AS question_id, embedding AS q, label AS q_label FROM embeddings WHERE vec_id % 50 = 0),
scored AS (SELECT question_id, vec_id, label, q_label, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM queries CROSS JOIN embeddings)"""

_RANKED = f"""{_HITS},
fetched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS r FROM scored) WHERE r <= 20),
demoted AS (SELECT question_id, vec_id AS chunk_id, score AS raw, round(CASE WHEN label = 0 THEN score * 0.35::DOUBLE ELSE score END, 4) AS score, label = 0 AS is_reference FROM fetched),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, raw DESC, chunk_id) AS rank FROM demoted WHERE score >= 0.05) WHERE rank <= 5),
per AS (SELECT question_id, count(*)::INT AS returned, max(score) AS top_score, round(avg(score), 4) AS average_score,
               round(max(score) - coalesce((sum(score) - max(score)) / nullif(count(*) - 1, 0), 0.0), 6) AS margin FROM reranked GROUP BY question_id),
summary AS (SELECT q.question_id, coalesce(returned, 0)::INT AS returned, coalesce(top_score, 0.0) AS top_score, coalesce(average_score, 0.0) AS average_score, coalesce(margin, 0.0) AS margin
            FROM queries q LEFT JOIN per USING (question_id))"""

_TURNS = """turns AS (
  SELECT conv_id AS question_id, (turn + 1)::INT AS rank, role AS doc_id, role || '.txt' AS filename, turn::INT AS chunk_index,
         CASE WHEN turn % 3 > 0 THEN (turn + 1)::INT END AS page, text, turn % 4 = 3 AS is_reference FROM conversations)"""

_CONTEXTS = rf"""{_TURNS},
contexts AS (
  SELECT question_id,
         string_agg('[Source ' || rank || '] file: ' || filename || ' | chunk ' || chunk_index || CASE WHEN page IS NOT NULL THEN ' | page ' || page ELSE '' END
                    || CASE WHEN is_reference THEN ' | bibliography' ELSE '' END || {_NL} || {_strip('text')}, {_NL} || {_NL} ORDER BY rank) AS context,
         string_agg(trim(filename || ' ' || coalesce(page::VARCHAR, '') || ' ' || text), ' ' ORDER BY rank) AS coverage_text
  FROM turns GROUP BY question_id)"""

_RECORDS = """records AS (
  SELECT doc_id AS id, source || '_' || doc_id || '.txt' AS filename, n_chars AS size_bytes, CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'ready' END AS status,
         n_chars // 400 AS chunk_count, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS uploaded_at, substr(sha256(text), 1, 16) AS fingerprint FROM documents)"""

# Dirt as the catalogue adds it, character by character where SQL has no escape.
_C = lambda *parts: " || ".join(f"chr({c})" if isinstance(c, int) else f"'{c}'" for c in parts)
_DIRT = _C(
    13, 10, "odd", 8199, "blanks", 8239, "here, ", 8220, "quotes", 8221, " and ", 8216, "more", 8217, ", a ", 8211, " b ", 8212, " c ", 8722, " d, in", 173, "vis", 8203, "ible", 65279, ", e", 64256, "ort ", 64257, "nds ", 64258, "ow", 13,
    "bro-", 13, 10, "ken ", 7, "words", 31, " ", 11, 12, 9, " and", 10, 10, 10, 10, "   blanks  ", 10, "-----", 10, "Page 3 of 9", 10, "Page 4 of 9", 10, "5 / 9", 10, "-----", 10, "-----", 10, "-----", 10, "last", 10,
)


def _dirty(x: str) -> str:
    return f"replace(replace({x}, 'tion ', 'ti-' || chr(10) || 'on  '), ' the ', chr(160) || 'the' || chr(160)) || {_DIRT}"


_CLEAN = f"{chunk_oracle.cleaned('documents')}, {chunk_oracle.references()}"
_CHUNKS = f"WITH RECURSIVE {_CLEAN}, {chunk_oracle.chunks()}"
_CHUNK_COUNTS = f"""counted AS (SELECT d.doc_id, d.source || '_' || d.doc_id || '.txt' AS filename, d.text, coalesce(c.n, 0)::INT AS n, length(k.t)::BIGINT AS chars, ({_words('k.t')})::BIGINT AS words
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) c ON c.doc_id = d.doc_id LEFT JOIN cleaned k ON k.doc_id = d.doc_id WHERE {_strip("coalesce(d.text, '')")} <> '')"""

# The answer job over conversations: the first turn asked, the turns as hits.
_ANSWERS = rf"""{_CONTEXTS},
questions AS (SELECT conv_id AS question_id, text AS question FROM conversations WHERE turn = 0),
facts AS (
  SELECT question_id, count(*)::INT AS returned, max(score) AS top_score, round(avg(score), 4) AS average_score, max(score) - coalesce((sum(score) - max(score)) / nullif(count(*) - 1, 0), 0.0) AS margin
  FROM (SELECT conv_id AS question_id, round(1::DOUBLE / (turn + 1), 4) AS score FROM conversations) GROUP BY question_id),
covered AS (
  SELECT q.question_id, q.question, f.returned, f.top_score, f.average_score, f.margin, {_COVER.replace("tokens", "tokens").replace(_terms("text"), _terms("coverage_text"))} AS raw
  FROM questions q JOIN facts f USING (question_id) JOIN contexts USING (question_id)),
gated AS (
  SELECT *, CASE WHEN (SELECT count(*) FROM documents) = 0 THEN 'empty corpus' WHEN raw < 0.18 THEN 'context did not cover the question' ELSE 'answered' END AS reason,
         round(greatest(0, least(1, 0.45::DOUBLE * round(greatest(0, least(1, top_score / 0.75::DOUBLE)), 4) + 0.35::DOUBLE * round(greatest(0, least(1, raw)), 4) + 0.20::DOUBLE * round(greatest(0, least(1, margin / 0.25::DOUBLE)), 4))), 4) AS blended
  FROM covered),
hit_prose AS (
  SELECT question_id, rank, filename, array_to_string(list_transform(list_filter(list_transform(string_split(text, {_NL}), lambda l: {_strip('l')}), lambda l: l <> '' AND NOT regexp_matches(l, '^[-=_*~]{{3,}}$')),
         lambda l: CASE WHEN regexp_matches(l, '{HEADING}') THEN l || '.' ELSE l END), ' ') AS body FROM turns WHERE NOT is_reference),
hit_sentences AS (
  SELECT question_id, rank, filename, pos, sentence, list_distinct({_tokens('sentence')}) AS tokens FROM (
    SELECT question_id, rank, filename, {_strip('s')} AS sentence, i - 1 AS pos FROM (SELECT question_id, rank, filename, unnest({_sentences('body')}) AS s, generate_subscripts({_sentences('body')}, 1) AS i FROM hit_prose))
  WHERE length(sentence) > 25),
stacked AS (
  SELECT question_id, list([{{'rank': rank, 'pos': pos, 'sentence': sentence, 'tokens': tokens, 'filename': filename}}] ORDER BY rank, pos) AS rows FROM hit_sentences WHERE len(tokens) > 0 GROUP BY question_id),
distinct_rows AS (
  SELECT question_id, list_reduce(rows, lambda kept, row: CASE WHEN len(list_filter(kept, lambda k: list_has_all(k.tokens, row[1].tokens) OR list_has_all(row[1].tokens, k.tokens))) > 0 THEN kept ELSE list_concat(kept, row) END) AS rows FROM stacked),
scored AS (
  SELECT question_id, place, r.sentence AS sentence, {_terms('r.sentence')} AS body, {_terms('r.filename')} AS label, terms
  FROM (SELECT question_id, unnest(rows) AS r, generate_subscripts(rows, 1) AS place, terms FROM distinct_rows JOIN (SELECT question_id, {_terms('question')} AS terms FROM gated WHERE reason = 'answered') USING (question_id))),
rated AS (
  SELECT *, len(list_intersect(terms, body)) + 0.5::DOUBLE * len(list_intersect(list_filter(terms, lambda t: NOT list_contains(body, t)), label)) + len(list_intersect(terms, body))::DOUBLE / greatest(len(body), 1) AS score FROM scored),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, place) AS r FROM rated WHERE score > 0) WHERE r <= 3),
quoted AS (SELECT question_id, string_agg(sentence, ' ' ORDER BY place) AS made FROM chosen GROUP BY question_id),
fitted AS (
  SELECT question_id, CASE WHEN length(made) <= 900 THEN made ELSE (SELECT string_agg(p.part, ' ' ORDER BY p.i) FROM (
      SELECT part, i, sum(length(part) + 1) OVER (ORDER BY i) AS used FROM (SELECT unnest({_sentences('made')}) AS part, generate_subscripts({_sentences('made')}, 1) AS i)) p WHERE p.i = 1 OR p.used <= 900) END AS made FROM quoted),
final AS (
  SELECT g.*, CASE WHEN reason = 'empty corpus' THEN {_q(EMPTY_CORPUS)} WHEN reason <> 'answered' THEN {_q(NO_ANSWER)} ELSE coalesce(nullif({_strip('made')}, ''), {_q(NO_ANSWER)}) END AS answer,
         (SELECT least(3, count(DISTINCT (doc_id, chunk_index)))::INT FROM turns t WHERE t.question_id = g.question_id) AS n_hits
  FROM gated g LEFT JOIN fitted USING (question_id)),
judged AS (SELECT *, reason <> 'answered' OR contains(lower(answer), {_q(NO_ANSWER.lower())}) AS abstained FROM final),
told AS (
  SELECT question_id, question, answer, NOT abstained AS grounded, abstained, reason, CASE WHEN abstained THEN round(blended * 0.5, 4) ELSE blended END AS confidence, round(raw, 4) AS coverage, returned, top_score, average_score,
         CASE WHEN abstained THEN 0 ELSE n_hits END AS n_sources FROM judged),
labelled AS (
  SELECT *, CASE WHEN NOT grounded THEN 'Not grounded in documents' WHEN confidence >= 0.70 THEN 'High confidence' WHEN confidence >= 0.45 THEN 'Moderate confidence' WHEN confidence >= 0.25 THEN 'Low confidence' ELSE 'Very low confidence' END AS confidence_label FROM told)"""


def _unit(p: str, source: str) -> str:
    """CTEs from source(id, text) to {p}unit(id, bucket, x): vectors of hashed features as the stored table has them, in
    single precision and then of length one."""
    return rf"""{p}toks AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {source}),
{p}feats AS (
  SELECT id, unnest(list_concat(list_transform(w, lambda t: 'w:' || t), list_transform(range(1, len(w)), lambda i: 'b:' || w[i] || '_' || w[i + 1]))) AS feature FROM {p}toks
  UNION ALL SELECT id, 'c:' || substr(p, i, 3) FROM (SELECT id, p, unnest(range(1, greatest(1, length(p) - 2) + 1)) AS i
    FROM (SELECT id, CASE WHEN length(t) >= 3 THEN '^' || t || '$' ELSE t END AS p FROM (SELECT id, unnest(w) AS t FROM {p}toks)))),
{p}tf AS (SELECT id, feature, count(*) AS n FROM {p}feats GROUP BY ALL),
{p}hashed AS (SELECT feature, (('0x' || substr(md5(feature), 1, 16))::UBIGINT % 384)::INT AS bucket, CASE WHEN substr(md5(feature), 1, 1) >= '8' THEN 1.0 ELSE -1.0 END AS sign FROM (SELECT DISTINCT feature FROM {p}tf)),
{p}sums AS (SELECT id, bucket, sum(sign * (1 + ln(n))) AS w FROM {p}tf JOIN {p}hashed USING (feature) GROUP BY ALL),
{p}norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {p}sums GROUP BY id HAVING sqrt(sum(w * w)) > 1e-12),
{p}stored AS (SELECT id, bucket, (w / norm)::FLOAT::DOUBLE AS x FROM {p}sums JOIN {p}norms USING (id) UNION ALL SELECT id, 0, 1.0 FROM {source} WHERE id NOT IN (SELECT id FROM {p}norms)),
{p}unit AS (SELECT id, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM {p}stored)"""


# Questions against the chunked corpus: the 20 best by cosine, demoted, those above the floor, the 5 best of them.
_RETRIEVED = f"""{_CHUNKS}, {_ASKED},
c_texts AS (
  SELECT c.doc_id || '::' || lpad(chunk_index::VARCHAR, 5, '0') AS id, d.source || ' ' || c.doc_id || ' ' || d.source || ' ' || c.doc_id || {_NL} || {_NL} || c.text AS text, c.text AS body, c.is_reference, c.chunk_index,
         c.doc_id::VARCHAR AS doc_id, d.source || '_' || c.doc_id || '.txt' AS filename FROM chunks c JOIN documents d ON d.doc_id = c.doc_id),
q_texts AS (SELECT question_id AS id, question AS text FROM asked),
{_unit('c_', 'c_texts')},
{_unit('q_', 'q_texts')},
v_scores AS (SELECT q.id AS question_id, c.id AS chunk_id, round(sum(q.x * c.x), 6) AS score FROM q_unit q JOIN c_unit c USING (bucket) GROUP BY ALL),
v_fetched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS r FROM v_scores) WHERE r <= 20),
v_demoted AS (SELECT f.question_id, f.chunk_id, f.score AS raw, round(CASE WHEN is_reference THEN f.score * 0.35::DOUBLE ELSE f.score END, 4) AS score, is_reference, body, doc_id, filename, chunk_index FROM v_fetched f JOIN c_texts t ON t.id = f.chunk_id),
turns AS (
  SELECT question_id, rank::INT AS rank, chunk_id, doc_id, filename, chunk_index, NULL::INT AS page, body AS text, score, is_reference
  FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, raw DESC, chunk_id) AS rank FROM v_demoted WHERE score >= 0.05) WHERE rank <= 5)"""
# The answer job over them.
_ANSWERED = (
    _RETRIEVED + ",\n" + _ANSWERS[_ANSWERS.index("contexts AS"):]
    .replace("SELECT conv_id AS question_id, text AS question FROM conversations WHERE turn = 0", "SELECT question_id, question FROM asked")
    .replace("(SELECT conv_id AS question_id, round(1::DOUBLE / (turn + 1), 4) AS score FROM conversations)", "turns")
    # halves of four places are rounded up, as in decimal arithmetic
    .replace("round(blended * 0.5, 4)", "round((blended * 0.5)::DECIMAL(18, 8), 4)::DOUBLE")
)

_LATENCY = """SELECT count(*) AS questions_asked, coalesce(round(avg(value), 2), 0.0) AS average_response_time_ms, round(min(value), 2) AS fastest_response_ms,
round(max(value), 2) AS slowest_response_ms, max(ts) AS last_question_at FROM events"""

_FILES = """contents AS (SELECT doc_id, CASE WHEN doc_id % 7 = 2 THEN '' ELSE coalesce(text, '') END AS content, CASE doc_id % 5 WHEN 3 THEN 'md' WHEN 4 THEN 'TXT' ELSE 'txt' END AS ext FROM documents WHERE doc_id % 11 <> 0),
files AS (SELECT doc_id || '.' || ext AS filename, ext, content, strlen(content) AS size_bytes,
                 CASE WHEN ext = 'md' THEN 'unsupported_file_type' WHEN strlen(content) > 4096 THEN 'file_too_large' WHEN content = '' THEN 'empty_file' END AS code FROM contents)"""

_RECENT_LATENCY = _LATENCY.replace("FROM events", "FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)")

_VERSIONS = """known AS (SELECT doc_id, 'known' AS version FROM documents WHERE doc_id % 3 <> 0),
incoming AS (SELECT doc_id, 'incoming' AS version FROM documents WHERE doc_id % 3 <> 1)"""


def _label(unit: str, size: int, past: str | None = None, future: str | None = None) -> str:
    n = f"round(s / {size}.0)::BIGINT"
    named = f"WHEN {n} = 1 THEN '{past}' WHEN {n} = -1 THEN '{future}' " if past else ""
    this = {"day": "today"}.get(unit, f"this {unit}")
    return f"CASE WHEN {n} = 0 THEN '{this}' {named}WHEN {n} > 0 THEN {n} || ' {unit}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END || ' ago' ELSE 'in ' || -({n}) || ' {unit}' || CASE WHEN {n} = -1 THEN '' ELSE 's' END END"


_TITLE = r"regexp_replace(regexp_replace(stem, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
_FINAL = r"regexp_extract(url, '([^/]*)/*$', 1)"

ORACLES = {
    "fingerprint_duplicates": "SELECT substr(sha256(text), 1, 16) AS fingerprint, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "reject_report": f"""SELECT doc_id, code FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN 'unsupported_file_type' WHEN n_chars * 1000 > 26214400 THEN 'file_too_large'
        WHEN n_chars = 0 OR {_strip("coalesce(text, '')")} = '' THEN 'empty_file' END AS code FROM documents) WHERE code IS NOT NULL""",
    "upload_outcome": f"""WITH codes AS (SELECT CASE WHEN doc_id % 5 = 3 THEN 1 WHEN n_chars > 26214400 THEN 1 WHEN n_chars = 0 OR {_strip("coalesce(text, '')")} = '' THEN 1 END AS code FROM documents),
        counted AS (SELECT count(*) - count(code) AS created, count(code) AS failed FROM codes)
        SELECT created, failed, created || ' document(s) processed' || CASE WHEN failed > 0 THEN ', ' || failed || ' failed' ELSE '' END AS message FROM counted""",
    "clean_text": rf"""WITH dirty AS (SELECT doc_id, {_dirty('text')} AS text FROM documents),
        cleaned AS (SELECT doc_id, text, {_strip(chunk_oracle.basic('text'))} AS clean_text FROM dirty)
        SELECT doc_id, clean_text, CASE WHEN length(text) > 0 THEN round((length(text) - length(clean_text))::DOUBLE / length(text) * 100, 2) ELSE 0.0 END AS noise_percent FROM cleaned""",
    "boilerplate_lines": f"WITH {_BOILER} SELECT doc_id, line FROM furniture",
    "drop_furniture": f"""WITH {_BOILER}, sets AS (SELECT doc_id, list(line) AS furniture FROM furniture GROUP BY doc_id),
        kept AS (SELECT d.doc_id, text, furniture, array_to_string(list_filter(string_split(text, {_NL}), lambda l: {_strip('l')} = '' OR NOT list_contains(furniture, {_strip('l')})), {_NL}) AS body
                 FROM documents d LEFT JOIN sets USING (doc_id))
        SELECT doc_id, CASE WHEN furniture IS NULL THEN text ELSE {_collapse('body')} END AS text FROM kept""",
    "page_spans": f'WITH {_PAGES} SELECT doc_id, page, start, "end" FROM spans',
    "page_for_offset": f"""WITH {_PAGES}, stops AS (SELECT doc_id, max("end") AS stop, arg_max(page, start) AS last_page FROM spans GROUP BY doc_id),
        starts AS (SELECT doc_id, last_page, unnest(list_concat(range(0, stop + 1, 400), [(stop + 50)::BIGINT])) AS char_start FROM stops)
        SELECT s.doc_id, s.char_start, coalesce(p.page, s.last_page) AS page FROM starts s LEFT JOIN spans p ON s.doc_id = p.doc_id AND s.char_start >= p.start AND s.char_start < p."end" """,
    "bibliography_start": rf"""WITH added AS (
          SELECT doc_id, text || CASE WHEN doc_id % 10 = 0 THEN {_NL} || {_NL} || 'References' || {_NL} || array_to_string(list_transform(range(1, doc_id % 4 + 4), lambda k: '[' || k || '] A. Author, title' || {_NL} || 'of the work'), {_NL})
                   WHEN doc_id % 10 = 1 THEN {_NL} || 'References' || {_NL} || 'as given in the text' || {_NL} || 'and more' || {_NL} || 'and more' ELSE '' END AS text FROM documents),
        lines AS (SELECT doc_id, unnest(string_split(text, {_NL})) AS line, generate_subscripts(string_split(text, {_NL}), 1) AS pos FROM added),
        placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)  AS offs FROM lines),
        looked AS (SELECT doc_id, offs, line, avg(CASE WHEN regexp_matches({_strip('line')}, '(?i)^(?:\[\d+\]|arXiv:|https?://|doi:)') THEN 1.0 ELSE 0.0 END) OVER w AS share, count(*) OVER w AS ahead
                   FROM placed WHERE {_strip('line')} <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING)),
        found AS (SELECT doc_id, max(offs)::INT AS ref_start FROM looked WHERE ahead >= 3 AND share >= 0.15
                  AND regexp_matches(line, '(?i)^[ \t]*(?:\d+(?:\.\d+)*[.)]?[ \t]*)?(references?|bibliography|works cited|literature cited)[ \t]*:?[ \t]*$') GROUP BY doc_id)
        SELECT doc_id, ref_start FROM documents LEFT JOIN found USING (doc_id)""",
    "two_column_order": rf"""WITH words AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS text, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) - 1 AS i FROM documents),
        boxes AS (SELECT doc_id, (i // 8) // 50 AS page, text, CASE WHEN i % 8 < 4 THEN 40 + 60 * (i % 8) ELSE 330 + 60 * (i % 8 - 4) END AS x0, (i // 8) % 50 * 12 AS top FROM words WHERE text <> ''),
        body AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS n FROM boxes WHERE length(text) >= 4),
        bins AS (SELECT DISTINCT doc_id, page, unnest(range(x0, x0 + 50)) AS bin FROM body WHERE n >= 40
                 UNION SELECT DISTINCT doc_id, page, unnest([-1, 612]) FROM body WHERE n >= 40),
        gaps AS (SELECT doc_id, page, greatest(bin + 1, 183) AS start, next FROM (SELECT *, lead(bin) OVER (PARTITION BY doc_id, page ORDER BY bin) AS next FROM bins) WHERE next > bin + 1),
        best AS (SELECT doc_id, page, arg_max(start, (next - start) * 1000 - start) AS start, max(next - start) AS len FROM gaps WHERE start < 440 AND next - start >= 6 GROUP BY doc_id, page),
        gutter AS (SELECT doc_id, page, start + len AS gutter_end FROM best WHERE (start + len / 2.0) / 612.0 BETWEEN 0.40 AND 0.62),
        placed AS (SELECT b.doc_id, b.page, b.text, b.x0, b.top, CASE WHEN b.x0 >= g.gutter_end THEN 1 ELSE 0 END AS col FROM boxes b LEFT JOIN gutter g ON b.doc_id = g.doc_id AND b.page = g.page),
        lines AS (SELECT doc_id, page, col, top, string_agg(text, ' ' ORDER BY x0, text) AS line FROM placed GROUP BY ALL),
        parts AS (SELECT doc_id, page, col, string_agg(line, {_NL} ORDER BY top) AS part FROM lines GROUP BY ALL)
        SELECT doc_id, page::INT AS page, string_agg(part, {_NL} || {_NL} ORDER BY col) AS text FROM parts GROUP BY doc_id, page""",
    "flatten_blocks": f"""WITH lines AS (SELECT conv_id AS doc_id, turn AS seq, CASE WHEN turn % 4 = 3 THEN trim(role) || ' |  | ' || turn WHEN role = 'user' AND {_strip('text')} <> '' THEN '## ' || {_strip('text')} ELSE {_strip('text')} END AS line FROM conversations)
        SELECT doc_id, string_agg(line, {_NL} || {_NL} ORDER BY seq) AS text FROM lines WHERE line <> '' GROUP BY doc_id""",
    "format_dispatch": f"""WITH {_PAGES}, named AS (SELECT doc_id, source || '_' || doc_id || '.txt' AS filename, text, doc_id % 4 AS kind FROM documents),
        flat AS (SELECT doc_id, string_agg(line, {_NL} || {_NL} ORDER BY i) AS text FROM (SELECT doc_id, {_strip('l')} AS line, i FROM (SELECT doc_id, unnest(string_split(text, {_NL})) AS l, generate_subscripts(string_split(text, {_NL}), 1) AS i FROM documents)) WHERE line <> '' GROUP BY doc_id)
        SELECT filename, 1::BIGINT AS segments, length(text)::BIGINT AS chars, NULL::INT AS pages FROM named WHERE kind = 0 AND strlen(text) > 0
        UNION ALL SELECT filename, count(*), sum(length(p.text))::BIGINT, max(page)::INT FROM named n JOIN paged p USING (doc_id) WHERE kind = 1 AND strlen(n.text) > 0 GROUP BY filename
        UNION ALL SELECT filename, 1, length(f.text)::BIGINT, NULL FROM named n JOIN flat f USING (doc_id) WHERE kind = 2 AND strlen(n.text) > 0
        UNION ALL SELECT filename, 0, 0, NULL FROM named WHERE kind = 3 OR strlen(text) = 0 OR text IS NULL""",
    "id_lookup": "SELECT page_id, true AS found FROM pages WHERE page_id IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, false FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages)",
    "ready_documents": f"WITH {_RECORDS} SELECT coalesce(sum(chunk_count), 0)::BIGINT AS chunks, count(*) AS documents FROM records WHERE status = 'ready'",
    "chunk_invariants": "SELECT doc_id FROM documents WHERE false",
    "chunk_stats": f"""SELECT conv_id, count(*) AS chunks, min(length(text))::INT AS smallest, max(length(text))::INT AS largest, round(avg(length(text)), 1) AS average,
        sum({_words('text')})::BIGINT AS words, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""",
    "term_counts": f"SELECT term, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS term FROM documents) GROUP BY term",
    "content_terms": f"SELECT doc_id, len(terms)::INT AS n_terms, array_to_string(list_sort(terms), ' ') AS terms FROM (SELECT doc_id, {_terms('text')} AS terms FROM documents)",
    "hash_vectors_md5": r"""WITH toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
        feats AS (
          SELECT doc_id, unnest(list_concat(list_transform(w, lambda t: 'w:' || t), list_transform(range(1, len(w)), lambda i: 'b:' || w[i] || '_' || w[i + 1]))) AS feature FROM toks
          UNION ALL SELECT doc_id, 'c:' || substr(p, i, 3) FROM (SELECT doc_id, p, unnest(range(1, greatest(1, length(p) - 2) + 1)) AS i
            FROM (SELECT doc_id, CASE WHEN length(t) >= 3 THEN '^' || t || '$' ELSE t END AS p FROM (SELECT doc_id, unnest(w) AS t FROM toks)))),
        tf AS (SELECT doc_id, feature, count(*) AS n FROM feats GROUP BY ALL),
        weighted AS (SELECT doc_id, (('0x' || substr(md5(feature), 1, 16))::UBIGINT % 384)::INT AS bucket, CASE WHEN substr(md5(feature), 1, 1) >= '8' THEN 1.0 ELSE -1.0 END * (1 + ln(n)) AS w FROM tf),
        sums AS (SELECT doc_id, bucket, sum(w) AS w FROM weighted GROUP BY ALL),
        norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM sums GROUP BY doc_id HAVING sqrt(sum(w * w)) > 1e-12)
        SELECT doc_id, bucket, round(w / norm, 6) AS value FROM sums JOIN norms USING (doc_id)
        UNION ALL SELECT doc_id, 0, 1.0 FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM norms)""",
    "unit_norm": "SELECT vec_id, 1.0::DOUBLE AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings",
    "knn_exact": f"WITH {_HITS} SELECT question_id, vec_id, rank::INT AS rank, score, round(1 - score, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5",
    "knn_filtered": f"WITH {_HITS} SELECT question_id, vec_id, rank::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM scored WHERE label = q_label) WHERE rank <= 5",
    "rerank_demoted": f"WITH {_RANKED} SELECT question_id, chunk_id, rank::INT AS rank, score, is_reference FROM reranked",
    "retrieval_summary": f"WITH {_RANKED} SELECT * FROM summary",
    "index_status": "SELECT CASE WHEN count(*) > 0 THEN 'ready' ELSE 'empty' END AS status, count(*) AS rows, max(len(embedding))::INT AS dimension, 'cosine' AS metric FROM embeddings",
    "chunks_by_document": "SELECT coalesce(label::VARCHAR, 'unknown') AS label, count(*) AS chunks FROM embeddings GROUP BY 1",
    "term_coverage": f"WITH {_PAIRED} SELECT doc_id, question_id, round({_COVER}, 6) AS coverage FROM paired",
    "confidence": f"""WITH {_RANKED}, parts AS (
          SELECT question_id, round(greatest(0, least(1, top_score / 0.75::DOUBLE)), 4) AS similarity, round((question_id % 11) / 10.0::DOUBLE, 4) AS coverage, round(greatest(0, least(1, margin / 0.25::DOUBLE)), 4) AS margin_part FROM summary),
        done AS (SELECT *, round(greatest(0, least(1, 0.45::DOUBLE * similarity + 0.35::DOUBLE * coverage + 0.20::DOUBLE * margin_part)), 4) AS confidence FROM parts)
        SELECT question_id, confidence, similarity, margin_part, CASE WHEN confidence >= 0.70 THEN 'High confidence' WHEN confidence >= 0.45 THEN 'Moderate confidence' WHEN confidence >= 0.25 THEN 'Low confidence' ELSE 'Very low confidence' END AS confidence_label FROM done""",
    "grounding_gate": f"""WITH {_PAIRED}, gated AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'no relevant chunks' WHEN {_COVER} < 0.18 THEN 'context did not cover the question' ELSE 'answered' END AS reason FROM paired)
        SELECT doc_id, reason, reason <> 'answered' AS abstained FROM gated""",
    "citations": f"""WITH {_TURNS}, firsts AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id, chunk_index ORDER BY rank) AS again FROM turns) WHERE again = 1),
        squeezed AS (SELECT *, {_squeeze('text')} AS body FROM firsts WHERE place <= 3)
        SELECT question_id, string_agg(doc_id || '|' || chunk_index || '|' || coalesce(page::VARCHAR, '-') || '|' || {_truncate('body', 320)}, {_NL} ORDER BY rank) AS sources FROM squeezed GROUP BY question_id""",
    "context_block": f"WITH {_CONTEXTS} SELECT * FROM contexts",
    "prompt_table": f"""WITH {_CONTEXTS} SELECT c.question_id, {_q(INSTRUCTION)} || 'Context:' || {_NL} || c.context || {_NL} || {_NL} || 'Question:' || {_NL} || {_strip('t.text')} || {_NL} || {_NL} || 'Answer:' AS prompt
        FROM contexts c JOIN conversations t ON t.conv_id = c.question_id AND t.turn = 0""",
    "sentences": f"""SELECT doc_id, pos::INT AS pos, sentence FROM (SELECT doc_id, {_strip('s')} AS sentence, i - 1 AS pos FROM (SELECT doc_id, unnest({_sentences('text')}) AS s, generate_subscripts({_sentences('text')}, 1) AS i FROM documents)) WHERE length(sentence) > 25""",
    "sentence_scores": f"""WITH {_PAIRED}, rows AS (SELECT doc_id, {_terms('question')} AS terms, unnest(list_transform({_sentences('text')}, lambda s: {_strip('s')})) AS sentence, generate_subscripts({_sentences('text')}, 1) - 1 AS pos FROM paired),
        bodies AS (SELECT doc_id, pos, terms, {_terms('sentence')} AS body FROM rows WHERE length(sentence) > 25),
        hits AS (SELECT doc_id, pos, len(list_intersect(terms, body)) AS overlap, len(list_filter(terms, lambda t: NOT list_contains(body, t) AND t = 'report')) AS by_label, greatest(len(body), 1) AS n FROM bodies)
        SELECT doc_id, pos::INT AS pos, round(overlap + 0.5::DOUBLE * by_label + overlap::DOUBLE / n, 6) AS score FROM hits""",
    "highlight": f"""WITH {_PAIRED}, found AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(question), '[^a-z0-9]+'), lambda t: length(t) > 2) AS ts FROM paired),
        patterns AS (SELECT doc_id, text, list_filter(ts, lambda t, i: list_position(ts, t) = i) AS terms FROM found)
        SELECT doc_id, CASE WHEN len(terms) = 0 THEN text ELSE regexp_replace(text, '(?i)(' || array_to_string(terms, '|') || ')', '<\\1>', 'g') END AS marked FROM patterns""".replace("\\\\1", "\\1"),
    "latency_stats": _LATENCY,
    "history_recent": "SELECT event_id AS id, value AS ms FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
    "registry_totals": f"""WITH {_RECORDS} SELECT count(*) AS total_documents, count(*) FILTER (status = 'ready') AS documents_ready, count(*) FILTER (status = 'error') AS documents_error,
        coalesce(sum(chunk_count) FILTER (status = 'ready'), 0)::BIGINT AS registered_chunks, coalesce(sum(size_bytes), 0)::BIGINT AS total_size_bytes, max(uploaded_at) FILTER (status = 'ready') AS last_indexed_at FROM records""",
    "registry_listing": f"WITH {_RECORDS} SELECT id, filename, uploaded_at FROM records ORDER BY uploaded_at DESC, id",
    "dashboard": f"""WITH {_RECORDS} SELECT count(*) AS total_documents, count(*) FILTER (status = 'ready') AS documents_ready, count(*) FILTER (status = 'error') AS documents_error,
        coalesce(sum(chunk_count) FILTER (status = 'ready'), 0)::BIGINT AS registered_chunks, coalesce(sum(size_bytes), 0)::BIGINT AS total_size_bytes, (SELECT count(*) FROM embeddings) AS indexed_chunks,
        (SELECT count(*) FROM events) AS questions_asked, (SELECT coalesce(round(avg(value), 2), 0.0) FROM events) AS average_response_time_ms,
        (SELECT round(min(value), 2) FROM events) AS fastest_response_ms, (SELECT round(max(value), 2) FROM events) AS slowest_response_ms FROM records""",
    "history_markdown": f"""WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations)
        SELECT conv_id, place::INT AS place, '## ' || place || '. ' || role || {_NL} || {_NL} || '- **Confidence**: ' || (turn % 4 * 25) || '% (Low confidence)' || {_NL} || '- **Response time**: ' || (turn * 100) || ' ms' || {_NL}
          || '- **Top similarity**: 0.2500' || {_NL} || '- **Model**: n/a' || {_NL} || '- **Asked at**: ' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(turn), '%Y-%m-%d %H:%M:%S') || {_NL} || {_NL} || '**Answer**' || {_NL} || {_NL} || text || {_NL} || {_NL}
          || CASE WHEN turn % 3 > 0 THEN '**Sources**' || {_NL} || {_NL} || '- `a.txt` - chunk #' || turn || CASE WHEN turn % 2 = 0 THEN ', page ' || (turn + 1) ELSE '' END || ' (similarity 0.5000)' || {_NL} || '  > ' || role || {_NL} || {_NL} ELSE '' END
          || '---' || {_NL} AS section FROM numbered""",
    "history_json": """SELECT to_json({'exported_at': '2024-01-01', 'total': (SELECT count(*) FROM conversations), 'entry': {'conv_id': conv_id, 'id': turn, 'question': role}})::VARCHAR AS line FROM conversations""",
    "title_context": rf"""WITH stems AS (SELECT page_id, regexp_replace('MyReport2NLPClassifier_' || replace(regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1), '/', '_') || '.pdf', '\.[^.]+$', '') AS stem FROM pages),
        words AS (SELECT page_id, trim(regexp_replace({_TITLE}, '[^A-Za-z0-9]+', ' ', 'g')) AS w FROM stems) SELECT page_id, w || ' ' || w AS title FROM words""",
    "file_scalars": rf"""WITH named AS (SELECT page_id, url, strlen(html) AS size, {_strip(_FINAL)} AS base, regexp_extract(url, '^.+?(\.[^.]*)$', 1) AS ext FROM pages),
        safe AS (SELECT *, substr(regexp_replace(regexp_replace(regexp_replace(base, '[^A-Za-z0-9._-]+', '_', 'g'), '_{{2,}}', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 180) AS s,
                 substr(lower(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), 1, 64) AS slug_ FROM named)
        SELECT page_id, CASE WHEN s = '' THEN 'upload' ELSE s END AS safe, lower(regexp_extract({_FINAL}, '[^.]\.([^.]+)$', 1)) AS extension,
          regexp_replace(CASE WHEN slug_ = '' THEN 'item' ELSE slug_ END, '_+$', '') AS slug, {_truncate('url', 20)} AS short,
          CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', floor(size * 10.0 / 1024 + 0.5) / 10) ELSE printf('%.1f MB', floor(size * 10.0 / 1048576 + 0.5) / 10) END AS size,
          CASE WHEN length(url) <= 28 THEN url ELSE substr(substr(url, 1, length(url) - length(ext)), 1, greatest(6, 27 - length(ext))) || '...' || ext END AS name FROM safe""",
    "display_labels": f"""WITH shown AS (SELECT event_id, value, round(value * 1000)::BIGINT AS ms, round(epoch(TIMESTAMP '2024-03-01 00:00:00') - epoch(ts))::BIGINT AS s FROM events)
        SELECT event_id, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN ((ms + 5) // 10) // 100 || '.' || lpad((((ms + 5) // 10) % 100)::VARCHAR, 2, '0') || ' s' ELSE ms // 60000 || 'm ' || round((ms % 60000) / 1000.0)::INT || 's' END AS duration,
          CASE WHEN value / 100 >= 0.5 THEN 'strong' WHEN value / 100 >= 0.3 THEN 'decent' ELSE 'weak' END AS tone,
          CASE WHEN s < 45 THEN 'just now' WHEN abs(s) < 3600 THEN {_label('minute', 60)} WHEN abs(s) < 86400 THEN {_label('hour', 3600)} WHEN abs(s) < 604800 THEN {_label('day', 86400, 'yesterday', 'tomorrow')}
            WHEN abs(s) < 2592000 THEN {_label('week', 604800, 'last week', 'next week')} WHEN abs(s) < 31536000 THEN {_label('month', 2592000, 'last month', 'next month')} ELSE {_label('year', 31536000, 'last year', 'next year')} END AS age FROM shown""",
    "upsert": f"WITH {_VERSIONS} SELECT * FROM incoming UNION ALL SELECT * FROM known WHERE doc_id NOT IN (SELECT doc_id FROM incoming)",
    "insert_ignore": f"WITH {_VERSIONS} SELECT * FROM known UNION ALL SELECT * FROM incoming WHERE doc_id NOT IN (SELECT doc_id FROM known)",
    "merge_latest": f"WITH {_VERSIONS} SELECT * FROM incoming UNION ALL SELECT * FROM known WHERE doc_id NOT IN (SELECT doc_id FROM incoming)",
    "delete_documents": "SELECT doc_id, source FROM documents WHERE doc_id % 3 = 1",
    "replace_reupload": f"""WITH {_RECORDS}, again AS (SELECT -id - 1 AS id, fingerprint, filename FROM records WHERE id % 5 = 0)
        SELECT id, fingerprint, filename FROM records r WHERE NOT EXISTS (SELECT 1 FROM again a WHERE a.fingerprint = r.fingerprint AND a.filename = r.filename) UNION ALL SELECT id, fingerprint, filename FROM again""",
    "preview_chunks": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 3",
    "rebuild_equals_ingest": "SELECT ''::VARCHAR AS chunk_id, ''::VARCHAR AS text WHERE false",
    "stream_ingest": f"SELECT doc_id, ({_words('text')})::INT AS words, substr(sha256(text), 1, 16) AS fingerprint FROM documents",
    "stream_latency": _LATENCY,
    "clean_documents": f"WITH dirty AS (SELECT doc_id, {_dirty('text')} AS text FROM documents), {chunk_oracle.cleaned('dirty')} SELECT doc_id, t AS clean_text FROM cleaned",
    "chunks": f"{_CHUNKS} SELECT doc_id || '::' || lpad(chunk_index::VARCHAR, 5, '0') AS chunk_id, doc_id::VARCHAR AS doc_id, chunk_index, text, char_start, char_end, NULL::INT AS page, is_reference FROM chunks",
    "paged_chunks": f"""WITH RECURSIVE {_PAGES.replace("spans AS (", "raw_spans AS (")}, {chunk_oracle.cleaned_pages('paged')}, {chunk_oracle.references()}, {chunk_oracle.chunks()},
        last AS (SELECT doc_id, arg_max(page, start) AS page FROM spans GROUP BY doc_id)
        SELECT c.doc_id::VARCHAR AS doc_id, c.chunk_index, c.char_start, coalesce(s.page, l.page)::INT AS page FROM chunks c JOIN last l ON l.doc_id = c.doc_id
        LEFT JOIN spans s ON s.doc_id = c.doc_id AND c.char_start >= s.start AND c.char_start < s.stop""",
    "page_totals": f"WITH {_PAGES} SELECT doc_id, count(*)::INT AS page_count, bool_and({_strip('text')} = '') AS blank FROM paged GROUP BY doc_id",
    "decoded_texts": "SELECT doc_id, length(text)::INT AS chars, sha256(text) AS digest FROM documents WHERE text IS NOT NULL",
    "knn_graph": f"WITH {_HITS} SELECT question_id, vec_id, rank::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5",
    "knn_blocks": """WITH scored AS (SELECT a.vec_id AS question_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a CROSS JOIN embeddings b)
        SELECT question_id, vec_id, rank::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 2""",
    "knn_stored": f"""WITH {_HITS} SELECT question_id, vec_id, rank::INT AS rank, score FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM scored WHERE question_id % 100 <> 0 OR question_id // 40 = vec_id // 40) WHERE rank <= 5""",
    "bucketed_changes": """WITH first AS (SELECT vec_id, vec_id // 40 AS doc_id, label FROM embeddings),
        changed AS (SELECT vec_id, doc_id, CASE WHEN doc_id % 5 = 1 THEN 99 ELSE label END AS label FROM first
                    UNION ALL SELECT -vec_id - 1, doc_id, -1 FROM first WHERE doc_id % 3 = 0 AND vec_id % 2 = 0)
        SELECT vec_id, doc_id, label, 4 AS version FROM changed WHERE doc_id % 4 <> 3""",
    "reset_index": """SELECT 1 AS step, 'ready' AS status, count(*) AS rows FROM embeddings UNION ALL SELECT 2, 'empty', 0
        UNION ALL SELECT 3, 'ready', count(*) FROM embeddings WHERE vec_id // 40 = 1""",
    "width_guard": f"WITH {_HITS} SELECT question_id, vec_id, rank::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM scored WHERE question_id % 100 <> 0) WHERE rank <= 3",
    "metadata_maps": f"""WITH {_TURNS} SELECT question_id, rank, array_to_string(list_filter(['both=["' || doc_id || '","' || filename || '"]', 'chunk_index=' || chunk_index, 'doc_id=' || doc_id, 'is_reference=' || is_reference, 'page=' || page], lambda x: x IS NOT NULL), ';') AS metadata FROM turns""",
    "question_rejects": f"""WITH rows AS (SELECT conv_id * 1000 + turn AS question_id, CASE WHEN turn % 7 = 3 THEN ' ' WHEN turn % 7 = 5 THEN repeat(text, 100) ELSE text END AS question, CASE WHEN turn % 2 = 0 THEN conv_id % 25 END AS top_k FROM conversations)
        SELECT question_id, CASE WHEN {_strip("coalesce(question, '')")} = '' OR length(question) > 2000 OR coalesce(top_k NOT BETWEEN 1 AND 20, false) THEN 'invalid_question' ELSE 'accepted' END AS code FROM rows""",
    "prose_sentences": rf"""WITH {_ANSWERS.replace("FROM turns WHERE NOT is_reference", "FROM (SELECT * REPLACE ('2.1 Related Work' || chr(10) || text || chr(10) || '----' || chr(10) || chr(10) || 'Results and more' || chr(10) || doc_id AS text) FROM turns) WHERE NOT is_reference")}
        SELECT question_id, rank, pos::INT AS pos, sentence, filename FROM hit_sentences""",
    "answer_budget": f"""SELECT doc_id, CASE WHEN length(text) <= 900 THEN text ELSE (SELECT string_agg(p.part, ' ' ORDER BY p.i) FROM (
          SELECT part, i, sum(length(part) + 1) OVER (ORDER BY i) AS used FROM (SELECT unnest({_sentences('text')}) AS part, generate_subscripts({_sentences('text')}, 1) AS i)) p WHERE p.i = 1 OR p.used <= 900) END AS answer FROM documents""",
    "prompt_parts": f"""WITH {_CONTEXTS}, made AS (SELECT c.question_id, 'Context:' || {_NL} || c.context || {_NL} || {_NL} || 'Question:' || {_NL} || {_strip('t.text')} || {_NL} || {_NL} || 'Answer:' AS task FROM contexts c JOIN conversations t ON t.conv_id = c.question_id AND t.turn = 0)
        SELECT question_id, {_q(INSTRUCTION)} AS system, sha256(task) AS user_digest, {_truncate('task', 4000)} AS preview FROM made""",
    "grounded_answers": f"WITH {_ANSWERS} SELECT * EXCLUDE (question) FROM labelled",
    "stored_history": f"WITH {_ANSWERS} SELECT question_id, question, answer, confidence, confidence_label, top_score, 'extractive' AS llm_model, n_sources FROM labelled",
    "number_added": f"WITH {_VERSIONS} SELECT count(*) AS added FROM incoming WHERE doc_id NOT IN (SELECT doc_id FROM known)",
    "processing_times": "SELECT user_id AS doc_id, round(sum(CASE WHEN event_id % 9 > 0 THEN coalesce(value, 0.0) ELSE 0.0 END), 2) AS processing_ms FROM events GROUP BY user_id",
    "ingest_records": f"""{_CHUNKS}, {_CHUNK_COUNTS} SELECT doc_id::VARCHAR AS id, filename, CASE WHEN n > 0 THEN 'ready' ELSE 'error' END AS status, n AS chunk_count, coalesce(chars, 0) AS char_count, coalesce(words, 0) AS word_count,
        strlen(text)::BIGINT AS size_bytes, substr(sha256(text), 1, 16) AS fingerprint FROM counted""",
    "document_stages": f"""{_CHUNKS}, {_CHUNK_COUNTS},
        codes AS (SELECT d.doc_id, CASE WHEN d.doc_id % 9 = 4 THEN 'unsupported_file_type' WHEN {_strip("coalesce(d.text, '')")} = '' THEN 'empty_file' END AS code, coalesce(c.n, 0) AS n, length(k.t) AS chars
                  FROM documents d LEFT JOIN counted c USING (doc_id) LEFT JOIN cleaned k ON k.doc_id = d.doc_id),
        ended AS (SELECT *, CASE WHEN code IS NOT NULL THEN 1 WHEN chars IS NULL THEN 3 WHEN n = 0 THEN 4 ELSE 99 END AS ends FROM codes),
        stages AS (SELECT * FROM (VALUES (1, 'ingest'), (2, 'extraction'), (3, 'cleaning'), (4, 'chunking'), (5, 'embedding'), (6, 'vector_store')) s(place, stage))
        SELECT doc_id::VARCHAR AS doc_id, stage, CASE WHEN ends < place THEN 'skipped' WHEN ends = place THEN 'failed' ELSE 'completed' END AS status, CASE WHEN ends = place THEN coalesce(code, 'processing_failed') ELSE '' END AS detail,
          CASE place WHEN 1 THEN coalesce(code, 'accepted') WHEN 2 THEN '1' WHEN 3 THEN CASE WHEN code IS NULL THEN coalesce(chars, 0) ELSE 0 END::VARCHAR ELSE CASE WHEN code IS NULL THEN n ELSE 0 END::VARCHAR END AS metrics FROM ended, stages""",
    "rebuilt_corpus": f"{_CHUNKS} SELECT doc_id::VARCHAR AS doc_id, chunk_index, text FROM chunks WHERE doc_id % 5 <> 2",
    "reindexed_corpus": f"""{_CHUNKS}, s_cleaned AS (SELECT * FROM cleaned WHERE doc_id % 4 = 1), s_refs AS (SELECT * FROM refs), {chunk_oracle.chunks("s_", 300, 60)}
        SELECT doc_id::VARCHAR AS doc_id, count(*) AS chunks, max(length(text))::INT AS longest FROM (SELECT doc_id, text FROM chunks WHERE doc_id % 4 <> 1 UNION ALL SELECT doc_id, text FROM s_chunks) GROUP BY doc_id""",
    "uploaded_corpus": f"""{_CHUNKS}, {_CHUNK_COUNTS} SELECT CASE WHEN doc_id % 6 = 0 THEN 'n' ELSE '' END || doc_id AS id, filename, CASE WHEN n > 0 THEN 'ready' ELSE 'error' END AS status, n AS chunk_count FROM counted""",
    "reset_counts": "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS chunks, 0::BIGINT AS documents_left, 0::BIGINT AS chunks_left",
    "recovered_names": """WITH named AS (SELECT doc_id AS number, source || '_' || doc_id || '.txt' AS filename FROM documents)
        SELECT number, CASE WHEN number % 3 > 0 THEN 'doc_' || substr(md5(filename), 1, 12) ELSE 'doc_' || substr(sha256(filename), 1, 12) END AS doc_id, filename FROM named""",
    "stored_registry": f"""WITH {_RECORDS} SELECT id::VARCHAR AS id, filename, CASE WHEN id % 5 = 0 THEN 'error' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN 0 ELSE chunk_count END::INT AS chunk_count, size_bytes, fingerprint FROM records WHERE id % 7 <> 3""",
    "stored_vectors": """WITH lengths AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
        SELECT vec_id, round(sqrt(list_dot_product(e, e)) / n, 4) AS norm, round(e[1] / n, 4) AS first, round(e[64] / n, 4) AS last FROM lengths""",
    "stream_versions": f"{_CHUNKS} SELECT doc_id || '::' || lpad(chunk_index::VARCHAR, 5, '0') AS chunk_id, text FROM chunks WHERE doc_id % 5 <> 0",
    "stream_recent_latency": _RECENT_LATENCY,
    "chunks_in_sql": f"{_CHUNKS} SELECT doc_id::VARCHAR AS doc_id, chunk_index, text, char_start, char_end FROM chunks",
    "chunks_by_lateral": f"{_CHUNKS} SELECT doc_id::VARCHAR AS doc_id, chunk_index, text, char_start, char_end FROM chunks",
    "scanned_folder": f"WITH {_FILES} SELECT filename, lower(ext) AS extension, size_bytes, code, CASE WHEN code IS NULL THEN sha256(content) END AS digest FROM files",
    "folder_rejects": f"WITH {_FILES} SELECT filename, coalesce(code, CASE WHEN {_strip('content')} = '' THEN 'empty_file' ELSE 'accepted' END) AS code FROM files",
    "retrieved_chunks_md5": f"{_RETRIEVED} SELECT question_id, rank, chunk_id, score, is_reference, greatest(1, length(text) // 4)::INT AS token_estimate, {_truncate(_squeeze('text'), 260)} AS snippet FROM turns",
    "answers_md5": f"{_ANSWERED} SELECT * EXCLUDE (question) FROM labelled",
    "sentence_dedupe": f"WITH {_ANSWERS} SELECT question_id, r.rank::INT AS rank, r.pos::INT AS pos, r.sentence AS sentence FROM (SELECT question_id, unnest(rows) AS r FROM distinct_rows)",
    "extractive_answers": f"""WITH {_ANSWERS.replace("FROM gated WHERE reason = 'answered'", "FROM gated")} SELECT h.question_id, CASE WHEN coalesce(made, '') = '' THEN {_q(NO_ANSWER)} ELSE made END AS answer
        FROM (SELECT DISTINCT question_id FROM hit_sentences) h LEFT JOIN fitted f ON f.question_id = h.question_id""",
    "plugged_answers": f"""WITH {_ANSWERS}, lengths AS (SELECT c.question_id, length({_q(INSTRUCTION)} || 'Context:' || {_NL} || c.context || {_NL} || {_NL} || 'Question:' || {_NL} || {_strip('q.question')} || {_NL} || {_NL} || 'Answer:') AS n FROM contexts c JOIN questions q ON q.question_id = c.question_id)
        SELECT g.question_id, CASE WHEN reason = 'answered' THEN n || ' characters' WHEN reason = 'empty corpus' THEN {_q(EMPTY_CORPUS)} ELSE {_q(NO_ANSWER)} END AS answer, reason = 'answered' AS grounded, reason FROM gated g JOIN lengths l ON l.question_id = g.question_id""",
    "plugged_vectors": "SELECT doc_id, length(coalesce(text, '')) + 2 AS characters, 2 AS width FROM documents",
    "stream_chunks": f"{_CHUNKS} SELECT doc_id || '::' || lpad(chunk_index::VARCHAR, 5, '0') AS chunk_id, text, 384 AS width FROM chunks",
}
