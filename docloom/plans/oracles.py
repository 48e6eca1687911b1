"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

from docloom.config import HEADING_WORDS, NOISE_ELEMENTS, PHRASES
from docloom.plans.queries import ARABIC, CELLS, CRAWL_URL, FORMS, LATIN, MAIN, PAGES, PDF_TEXT, VERDICTS

_KEEP = r"[^0-9\x{0600}-\x{06FF}\s.,!?/-]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ar(t: str) -> str:
    return f"translate(lower({t}), '{LATIN}', '{ARABIC}')"


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def norm(t: str) -> str:
    t = rf"regexp_replace({t}, '[\x{{0640}}\x{{064B}}-\x{{065F}}]', '', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '{_KEEP}', ' ', 'g'), ' {{2,}}', ' ', 'g')"
    return rf"regexp_replace({strip(t)}, '\n+', chr(10), 'g')"


def sentences(t: str) -> str:
    return rf"list_filter(list_transform(string_split_regex(regexp_replace({t}, '[ \t]+', ' ', 'g'), '[.!\x{{061F}}\n]+'), lambda x: {strip('x')}), lambda x: x <> '')"


def units(t: str) -> str:
    parts = rf"list_filter(list_transform(string_split_regex(s, '[,\x{{060C}}]+'), lambda x: {strip('x')}), lambda x: x <> '')"
    hard = f"list_transform(range(0, length(s), 150), lambda k: {strip('substr(s, CAST(k + 1 AS BIGINT), 150)')})"
    return f"list_filter(flatten(list_transform({sentences(t)}, lambda s: CASE WHEN length(s) <= 150 THEN [s] WHEN len({parts}) > 1 THEN {parts} ELSE {hard} END)), lambda x: x <> '')"


def heading(t: str) -> str:
    s = strip(rf"regexp_replace({t}, '\s+', ' ', 'g')")
    word = rf"regexp_matches({s}, '(^|[^\p{{L}}\p{{N}}_])({'|'.join(HEADING_WORDS)})($|[^\p{{L}}\p{{N}}_])')"
    title = rf"(NOT regexp_matches({s}, '[.!\x{{061F}}]$') AND length({s}) <= 60 AND length({s}) - length(replace({s}, ':', '')) = 1)"
    return f"(length({s}) BETWEEN 6 AND 80 AND length({s}) - length(replace({s}, ' ', '')) <= 10 AND ({word} OR {title}))"


def canonical(u: str) -> str:
    part = lambda k: rf"regexp_extract({u}, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', {k})"
    return rf"lower({part(1)}) || '://' || {part(2)} || regexp_replace({part(3)}, ';[^/]*$', '') || CASE WHEN {part(4)} = '' THEN '' ELSE '?' || {part(4)} END"


_DOCS = f"(SELECT doc_id, source, {ar('text')} AS text FROM documents)"
_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


def near(k: int, where: str = "a.vec_id % 20 = 0") -> str:
    return f"""(SELECT qid, id, similarity, pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS pos
      FROM (SELECT a.vec_id AS qid, b.vec_id AS id, {_COS} AS similarity FROM embeddings a, embeddings b WHERE {where})) WHERE pos <= {k})"""


def words(t: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({t}), '[a-z0-9]+'))"


def overlap(a: str, b: str) -> str:
    return f"round(CAST(len(list_intersect({words(a)}, {words(b)})) AS DOUBLE) / greatest(1, len({words(a)})), 6)"


_RETRIEVED = f"""(SELECT qid, rank, score, id, content, src, page FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank FROM (
    SELECT n.qid, n.id, n.pos, c.content, c.src, c.page, {overlap('d.text', 'c.content')} AS score,
           row_number() OVER (PARTITION BY n.qid, c.content ORDER BY n.pos) AS one
    FROM {near(15, 'a.vec_id % 20 = 0 AND b.vec_id IN (SELECT doc_id FROM documents)')} n
    JOIN (SELECT v.vec_id AS id, CASE WHEN v.vec_id % 7 = 0 THEN ' ' ELSE d.text END AS content, 's' || v.label AS src, v.vec_id % 3 AS page
          FROM embeddings v JOIN documents d ON v.vec_id = d.doc_id) c USING (id)
    JOIN documents d ON d.doc_id = n.qid WHERE trim(c.content) <> '') WHERE one = 1) WHERE rank <= 3)"""

_ANSWERS = f"""(SELECT conv_id, turn, text || CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN ' [1] [2]' WHEN 2 THEN ' [3][3] [12] [1234]' ELSE ' [[2]] [٤] [0]' END
  || CASE WHEN k % 5 = 0 THEN {q(PHRASES.refusal)} ELSE '' END || CASE WHEN k % 3 = 0 THEN chr(10) || chr(10) || {q(PHRASES.sources_header)} || chr(10) || '- s' || k ELSE '' END AS answer
  FROM (SELECT *, conv_id + turn AS k FROM conversations WHERE role = 'assistant'))"""
_IDS = r"list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\[(\p{Nd}{1,3})\]', 1), lambda x: CAST(translate(x, '٠١٢٣٤٥٦٧٨٩', '0123456789') AS INTEGER))))"
_ABSTAIN = "(" + " OR ".join(f"contains(answer, {q(p)})" for p in PHRASES.abstain) + ")"
_HEAD = q(PHRASES.sources_header)

_META = """(SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'web_page' WHEN 1 THEN 'PDF_page' END AS kind, CASE WHEN page_id % 8 = 0 THEN '' ELSE url END AS u,
  CASE WHEN page_id % 4 = 3 THEN NULL ELSE 'f' || (page_id % 5) END AS src, CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id % 9 END AS page FROM pages)"""

_REFD = f"(SELECT n.qid, n.id, n.pos AS rank, n.similarity AS score, 's' || v.label AS src, n.id % 2 AS page, 'PDF:s' || v.label || ':p' || (n.id % 2) AS ref FROM {{near}} n JOIN embeddings v ON v.vec_id = n.id)"


def distinct_refs(near_sql: str, most: int) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY qid, ref ORDER BY rank) AS one FROM {_REFD.format(near=near_sql)}) WHERE one = 1) WHERE place <= {most})"""


_HITS = f"""(SELECT u.qid, CASE WHEN g.gold IS NULL THEN 0 ELSE 1 END AS num_gold_refs, CASE WHEN p.at IS NULL THEN 0 ELSE 1 END AS hit, round(coalesce(1.0::DOUBLE / p.at, 0), 6) AS mrr, coalesce(r.retrieved, '') AS retrieved
  FROM (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 20 = 0) u
  LEFT JOIN (SELECT qid, string_agg(ref, ';' ORDER BY place) AS retrieved FROM {distinct_refs(near(15), 3)} GROUP BY qid) r USING (qid)
  LEFT JOIN (SELECT vec_id AS qid, 'PDF:s' || label || ':p1' AS gold FROM embeddings WHERE vec_id % 20 = 0 AND vec_id % 60 <> 0) g USING (qid)
  LEFT JOIN (SELECT r.qid, min(r.place) AS at FROM {distinct_refs(near(15), 3)} r JOIN embeddings v ON v.vec_id = r.qid AND r.qid % 60 <> 0 AND r.ref = 'PDF:s' || v.label || ':p1' GROUP BY r.qid) p USING (qid))"""

_REPORT = f"""(SELECT *, CASE WHEN len(gold) > 0 THEN list_has_any(gold, sources) END AS used_gold_source,
    len(ids) > 0 AND len(list_filter(ids, lambda x: x < 1 OR x > 3)) = 0 AS citation_valid,
    answerable IN (0, 1) AND abstained = (answerable = 0) AS abstention_correct
  FROM (SELECT conv_id AS qid, answer, CAST(conv_id % 3 AS BIGINT) AS answerable, {_ABSTAIN} AS abstained, {_IDS} AS ids,
      CASE conv_id % 4 WHEN 0 THEN ['a', 'z'] WHEN 1 THEN ['b', 'c'] ELSE CAST([] AS VARCHAR[]) END AS gold,
      CASE WHEN conv_id % 2 = 0 THEN ['a', 'b'] ELSE ['c'] END AS sources
    FROM (SELECT conv_id, arg_min(answer, turn) AS answer FROM {_ANSWERS} GROUP BY conv_id)))"""

_values = lambda rows: ", ".join(f"({k}, {'NULL' if v is None else q(v)})" for k, v in enumerate(rows))

ORACLES: dict[str, str] = {
    "normalize_text": f"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, {norm('text')} AS t FROM {_DOCS})",
    "arabic_letter_gate": f"SELECT doc_id, len(regexp_extract_all(text, '[ء-ي]')) AS letters FROM {_DOCS} WHERE length({strip('text')}) >= 15 AND len(regexp_extract_all(text, '[ء-ي]')) >= 10",
    "arabic_ratio_filter": rf"""SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {ar('text')} ELSE translate(text, 'ei', 'اب') END AS t FROM documents)
      WHERE len(regexp_extract_all(t, '[\x{{0600}}-\x{{06FF}}]')) >= 30 AND len(regexp_extract_all(t, '[\x{{0600}}-\x{{06FF}}]')) >= 0.2 * len(regexp_extract_all(t, '[0-9A-Za-z\x{{0600}}-\x{{06FF}}]'))""",
    "split_sentences": f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS digest FROM (SELECT doc_id, {sentences('text')} AS s FROM {_DOCS})",
    "split_long_sentences": f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS digest FROM (SELECT doc_id, {units('text')} AS s FROM {_DOCS})",
    "heading_flags": f"""SELECT doc_id, k, {heading("CASE (doc_id + k) % 3 WHEN 0 THEN line || ' الفصل' WHEN 1 THEN line || ': عام' ELSE line END")} AS heading
      FROM (SELECT doc_id, unnest(string_split_regex(text, '[.\\n]')) AS line, CAST(unnest(range(len(string_split_regex(text, '[.\\n]')))) AS BIGINT) AS k FROM {_DOCS})""",
    "chunk_documents": f"""WITH RECURSIVE u AS (SELECT doc_id, {units("CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'مقدمة عامة' || chr(10) || text ELSE text END")} AS x FROM {_DOCS}),
      w AS (SELECT doc_id, i, x, length(x) AS n, {heading('x')} AS h FROM (SELECT doc_id, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS i FROM u)),
      f AS (SELECT doc_id, i, 1 AS c, n + CASE WHEN h THEN 1 ELSE 0 END AS total FROM w WHERE i = 1
        UNION ALL SELECT w.doc_id, w.i, CASE WHEN w.h OR f.total + w.n + 1 > 300 THEN f.c + 1 ELSE f.c END,
          CASE WHEN w.h THEN w.n + 1 WHEN f.total + w.n + 1 > 300 THEN w.n ELSE f.total + w.n + 1 END FROM f JOIN w ON w.doc_id = f.doc_id AND w.i = f.i + 1)
      SELECT doc_id, CAST(c AS BIGINT) AS chunk, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, c, string_agg(x, ' ' ORDER BY i) AS t FROM f JOIN w USING (doc_id, i) GROUP BY doc_id, c)""",
    "canonical_urls": f"SELECT page_id, {canonical('url')} AS url, {canonical('url')} AS stripped FROM pages",
    "valid_internal_urls": r"""SELECT page_id, lower(host) IN ('ththre.example.com', 'www.ththre.example.com') AND NOT starts_with(lower(path), '/en/') AND contains(lower(path), '/') AND NOT starts_with(lower(path), '/images/') AS internal, ends_with(lower(u), '.pdf') AS pdf
      FROM (SELECT page_id, u, regexp_extract(u, '^[^:]+://([^/?#]*)', 1) AS host, regexp_extract(u, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM (
        SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://WWW.ththre.example.com/Images/' || page_id WHEN 1 THEN 'http://ththre.example.com/doc/' || page_id || '.PDF' ELSE url END AS u FROM pages))""",
    "page_uids": "SELECT page_id, left(sha1(url), 12) AS uid, left(sha1(url || '_pdf_1_chunk_' || page_id), 12) AS chunk_uid FROM pages",
    "crawl_bfs_levels": """WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), e AS (SELECT page_id AS src, (page_id * 7 + 1) % n AS dst FROM pages, n UNION SELECT page_id, (page_id * 3 + 2) % n FROM pages, n),
      r AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 60)
      SELECT node, min(depth) AS depth FROM r GROUP BY node""",
    "jsonl_roundtrip": "SELECT doc_id, quality, toxic FROM labels",
    "nonblank_batches": "SELECT CAST(doc_id // 128 AS BIGINT) AS batch, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id % 10 <> 0 AND trim(text) <> '' GROUP BY 1",
    "vector_topk": f"SELECT id, pos, similarity FROM {near(15, 'a.vec_id = 0')}",
    "vector_topk_batch": f"SELECT qid, id, pos, similarity FROM {near(15)}",
    "dedupe_keep_first": "SELECT source, min(doc_id) AS pos FROM documents GROUP BY source, text",
    "rerank_topk": f"""SELECT qid, pos, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank FROM (
      SELECT b.item_id AS qid, d.doc_id AS pos, {overlap('b.text', 'd.text')} AS score FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)) WHERE rank <= 10""",
    "confidence_gate": f"SELECT qid, id, similarity AS score FROM (SELECT *, max(similarity) OVER (PARTITION BY qid) AS best FROM {near(9)} WHERE id <> qid) WHERE best >= 0.4",
    "retrieve_pipeline": f"SELECT qid, rank, score, id FROM {_RETRIEVED}",
    "citation_ids": f"SELECT conv_id, turn, array_to_string({_IDS}, ',') AS ids FROM {_ANSWERS}",
    "citation_validity": f"""SELECT conv_id, turn, len(ids) > 0 AND len(list_filter(ids, lambda x: x < 1 OR x > 3)) = 0 AS valid, array_to_string(ids, ',') AS used, array_to_string(list_filter(ids, lambda x: x < 1 OR x > 3), ',') AS invalid
      FROM (SELECT conv_id, turn, {_IDS} AS ids FROM {_ANSWERS})""",
    "abstain_flag": f"SELECT conv_id, turn, {_ABSTAIN} AS abstained FROM {_ANSWERS}",
    "answer_split": f"""SELECT conv_id, turn, md5({strip(f"CASE WHEN strpos(answer, {_HEAD}) = 0 THEN answer ELSE substr(answer, 1, strpos(answer, {_HEAD}) - 1) END")}) AS answer_md5,
      md5(CASE WHEN strpos(answer, {_HEAD}) = 0 THEN '' ELSE {strip(f"substr(answer, strpos(answer, {_HEAD}))")} END) AS sources_md5 FROM {_ANSWERS}""",
    "source_labels": f"""SELECT page_id, label, dense_rank() OVER (PARTITION BY page_id % 7 ORDER BY f) AS cid FROM (
      SELECT page_id, label, min(page_id) OVER (PARTITION BY page_id % 7, label) AS f FROM (
        SELECT page_id, CASE kind WHEN 'web_page' THEN 'URL:' || coalesce(nullif(u, ''), 'UNKNOWN_URL') WHEN 'PDF_page' THEN 'PDF:' || coalesce(src, 'PDF') ELSE coalesce(src, 'UNKNOWN') END AS label FROM {_META}))""",
    "references": f"""SELECT page_id, CASE kind WHEN 'web_page' THEN CASE WHEN u = '' THEN 'URL:UNKNOWN' ELSE 'URL:' || {canonical('u')} END
      WHEN 'PDF_page' THEN 'PDF:' || coalesce(src, 'PDF') || coalesce(':p' || page, '') ELSE 'SRC:' || coalesce(src, 'UNKNOWN') END AS reference FROM {_META}""",
    "context_assembly": f"""WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY f) AS cid FROM (SELECT *, min(rank) OVER (PARTITION BY qid, src) AS f FROM {_RETRIEVED}))
      SELECT qid, md5(string_agg('[' || cid || '] ' || content, chr(10) || chr(10) ORDER BY rank)) AS context_md5, any_value(s.sources) AS sources FROM r
      JOIN (SELECT qid, string_agg(ref, ';' ORDER BY m) AS sources FROM (SELECT qid, 'PDF:' || src || ':p' || page AS ref, min(rank) AS m FROM r GROUP BY ALL) GROUP BY qid) s USING (qid) GROUP BY qid""",
    "parse_gold": f"""SELECT CAST(k AS BIGINT) AS k, array_to_string(list_filter(list_transform(CASE WHEN starts_with(trim(coalesce(cell, '')), '[') THEN CAST(CAST(cell AS JSON) AS VARCHAR[]) ELSE string_split(coalesce(cell, ''), ';') END, lambda x: trim(x)), lambda x: x <> ''), '|') AS refs
      FROM (VALUES {_values(CELLS)}) t(k, cell)""",
    "annotation_pool": f"SELECT qid, rank AS pool_rank, ref AS reference, score AS rerank_score, src AS source, page, 'vector ' || id AS example_chunk FROM {distinct_refs(near(30), 10)}",
    "gold_sets": "SELECT qid, string_agg(ref, ';' ORDER BY ref) AS gold FROM (SELECT DISTINCT doc_id % 50 AS qid, 'SRC:' || (doc_id % 20) AS ref FROM labels WHERE quality = 1) GROUP BY qid",
    "hit_mrr_at_3": f"SELECT qid, CAST(num_gold_refs AS BIGINT) AS num_gold_refs, CAST(hit AS BIGINT) AS hit, mrr, retrieved FROM {_HITS}",
    "retrieval_summary": f"SELECT round(avg(hit), 6) AS hit_rate, round(avg(mrr), 6) AS mrr, round(avg(num_gold_refs), 6) AS avg_gold_refs FROM {_HITS}",
    "generation_report": f"""SELECT qid, 'why?' AS question, answerable, abstained, abstention_correct, used_gold_source, array_to_string(sources, ';') AS retrieved_sources, array_to_string(gold, ';') AS gold_sources, md5(answer) AS answer,
      citation_valid, array_to_string(ids, ',') AS citation_used, array_to_string(list_filter(ids, lambda x: x < 1 OR x > 3), ',') AS citation_invalid, 5.0::DOUBLE AS faithfulness_score, true AS faithfulness_passed, '' AS unsupported_claims,
      4.0::DOUBLE AS relevance_score, 5.0::DOUBLE AS correctness_score, false AS critical_error, 5.0::DOUBLE AS fluency_score, 'F: | R: | C: | L:' AS judge_notes, '' AS judge_error FROM {_REPORT}""",
    "generation_summary": f"""SELECT count(*) AS n_total, count(*) AS n_scored, round(avg(CAST(citation_valid AS DOUBLE)), 6) AS citation_valid_rate, round(avg(CAST(abstention_correct AS DOUBLE)), 6) AS abstention_accuracy,
      round(avg(CAST(used_gold_source AS DOUBLE)), 6) AS gold_source_covered_rate, 1.0::DOUBLE AS faithfulness_pass_rate, 5.0::DOUBLE AS avg_faithfulness, 4.0::DOUBLE AS avg_relevance, 5.0::DOUBLE AS avg_correctness, 0.0::DOUBLE AS critical_error_rate, 5.0::DOUBLE AS avg_fluency FROM {_REPORT}""",
    "judge_parse": f"SELECT CAST(k AS BIGINT) AS k, CASE WHEN k < 3 THEN 5.0::DOUBLE END AS score, k < 3 AS ok FROM range({len(VERDICTS)}) t(k)",
}


def _plain(t: str) -> str:
    piece = "x"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        piece = f"replace({piece}, '{a}', '{b}')"
    return rf"array_to_string(list_filter(list_transform(string_split_regex({t}, '<[^>]*>'), lambda x: {strip(piece)}), lambda x: x <> ''), ' ')"


def _clean(page: str = "html") -> str:
    for tag in NOISE_ELEMENTS:
        page = rf"regexp_replace({page}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    return rf"regexp_replace({page}, '(?s)<!--.*?-->|<![^>]*>', '', 'g')"


ORACLES["html_main_text"] = rf"""SELECT page_id, length(t) AS n, md5(t) AS digest, length({norm(ar('t'))}) AS n_normalized FROM (
  SELECT page_id, CASE WHEN length({_plain('a')}) >= 200 THEN {_plain('a')} WHEN b <> '' THEN {_plain('b')} ELSE {_plain('h')} END AS t FROM (
    SELECT page_id, h, regexp_extract(h, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1) AS a, regexp_replace(regexp_extract(h, '(?is)<body\b[^>]*>(.*)', 1), '(?is)</body\s*>.*$', '') AS b FROM (SELECT page_id, {_clean()} AS h FROM pages)))"""
ORACLES["page_links"] = rf"""SELECT DISTINCT src, {canonical('dst')} AS dst FROM (
  SELECT src, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN starts_with(link, '/') THEN regexp_extract(src, '^[^:]+://[^/?#]*') || link ELSE link END AS dst FROM (
    SELECT url AS src, replace(unnest(list_concat(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']+)["'']', 1), regexp_extract_all(html, '["''](https?://[^"'']+)["'']', 1))), '&amp;', '&') AS link FROM pages))"""


def _main(page: str, more: str = "page_id") -> str:
    """Rows (page_id, t): the main text of `page`, an expression over pages."""
    return rf"""(SELECT page_id, CASE WHEN length({_plain('a')}) >= 200 THEN {_plain('a')} WHEN b <> '' THEN {_plain('b')} ELSE {_plain('h')} END AS t FROM (
      SELECT page_id, h, regexp_extract(h, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1) AS a, regexp_replace(regexp_extract(h, '(?is)<body\b[^>]*>(.*)', 1), '(?is)</body\s*>.*$', '') AS b FROM (SELECT page_id, {_clean(page)} AS h FROM pages)))"""


def packed(rows: str, keys: str, x: str = "x") -> str:
    """CTEs w, f: chunk number `c` of each unit of `rows` (keys, x list of units)."""
    on = " AND ".join(f"w.{k} = f.{k}" for k in keys.split(", "))
    own = ", ".join(f"w.{k}" for k in keys.split(", "))
    return f"""u AS ({rows}), w AS (SELECT {keys}, i, x, length(x) AS n, {heading('x')} AS h FROM (SELECT {keys}, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS i FROM u)),
      f AS (SELECT {keys}, i, 1 AS c, n + CASE WHEN h THEN 1 ELSE 0 END AS total FROM w WHERE i = 1
        UNION ALL SELECT {own}, w.i, CASE WHEN w.h OR f.total + w.n + 1 > 300 THEN f.c + 1 ELSE f.c END,
          CASE WHEN w.h THEN w.n + 1 WHEN f.total + w.n + 1 > 300 THEN w.n ELSE f.total + w.n + 1 END FROM f JOIN w ON {on} AND w.i = f.i + 1)"""


ORACLES["nfkc_forms"] = f"""SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, {norm("text || ' ' || " + "CASE doc_id % " + str(len(FORMS)) + " " + " ".join(f"WHEN {k} THEN {q(x)}" for k, (_, x) in enumerate(FORMS)) + " END")} AS t FROM {_DOCS})"""

_PAGED = f"""SELECT doc_id, page, {units(norm('t'))} AS x FROM (SELECT doc_id, unnest([text, left(text, 14), {q(PAGES[0])}, {q(PAGES[1].strip())} || chr(10) || text]) AS t, unnest([1, 2, 3, 4]) AS page FROM {_DOCS})
      WHERE length({strip('t')}) >= 15 AND len(regexp_extract_all({norm('t')}, '[ء-ي]')) >= 10"""
ORACLES["page_chunks"] = f"""WITH RECURSIVE {packed(_PAGED, 'doc_id, page')}
      SELECT 'book-' || doc_id || '_page_' || page || '_chunk_' || c AS id, CAST(page AS BIGINT) AS page, CAST(c AS BIGINT) AS chunk, 'book-' || doc_id AS source, length(t) AS n, md5(t) AS digest
      FROM (SELECT doc_id, page, c, string_agg(x, ' ' ORDER BY i) AS t FROM f JOIN w USING (doc_id, page, i) GROUP BY doc_id, page, c)"""

_SHORT = '<body><div class="a main-text">short</div>'
ORACLES["html_selected_text"] = f"""SELECT page_id, length(t) AS n, md5(t) AS digest FROM (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {q(MAIN.strip())} ELSE t END AS t FROM {_main(f"CASE WHEN page_id % 3 = 1 THEN replace(html, '<body>', {q(_SHORT)}) ELSE html END")})"""

ORACLES["page_script_links"] = "SELECT url AS src, regexp_extract(url, '^[^:]+://[^/?#]*') || '/scripts/page-' || page_id || '.aspx?a=1' AS dst FROM pages"

_LINKED = lambda a, b: f"(i.page_id * {a} + {b}) % n"
_CRAWL = f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), t AS MATERIALIZED (SELECT page_id, {norm('t')} AS t FROM {_main('html')}),
  e AS (SELECT i.page_id AS src, {_LINKED(7, 1)} AS dst FROM pages i, n WHERE i.page_id % 11 <> 10 AND i.page_id % 13 <> 5 UNION SELECT i.page_id, {_LINKED(3, 2)} FROM pages i, n WHERE i.page_id % 11 <> 10 AND i.page_id % 13 <> 5),
  r AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 60),
  d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node),
  found AS (SELECT {CRAWL_URL.format(id='node')} AS url, node, depth, t FROM d JOIN t ON t.page_id = d.node WHERE node % 11 = 10 OR (node % 13 <> 5 AND t <> ''))"""
ORACLES["crawl_pages"] = f"{_CRAWL} SELECT url, depth, CASE WHEN node % 11 <> 10 THEN length(t) END AS n FROM found"
ORACLES["crawl_collection"] = f"""{_CRAWL} SELECT left(sha1(CASE WHEN node % 11 = 10 THEN url || '_pdf_1_chunk_1' ELSE url END), 12) AS id, CASE WHEN node % 11 = 10 THEN 'PDF_page' ELSE 'web_page' END AS type,
  CASE WHEN node % 11 = 10 THEN CAST(node AS VARCHAR) ELSE 'site' END AS source, CASE WHEN node % 11 = 10 THEN CAST(1 AS BIGINT) END AS page, CASE WHEN node % 11 = 10 THEN CAST(1 AS BIGINT) END AS chunk, url AS page_url,
  md5(CASE WHEN node % 11 = 10 THEN {q(PDF_TEXT.replace('.', ''))} || node ELSE t END) AS digest FROM found"""

_LETTERS = "[" + ", ".join(f"CAST(length(content) - length(translate(content, '{c}{c.upper()}', '')) AS DOUBLE)" for c in LATIN) + "]"
ORACLES["store_and_search"] = f"""WITH s AS MATERIALIZED (SELECT doc_id, {_LETTERS} AS x FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN ' ' ELSE text END AS content FROM documents) WHERE trim(content) <> ''),
  n AS (SELECT a.doc_id AS qid, 'd' || b.doc_id AS id, round(list_cosine_similarity(a.x, b.x), 6) AS similarity FROM s a, s b WHERE a.doc_id % 50 = 0 AND list_sum(a.x) > 0 AND list_sum(b.x) > 0)
  SELECT qid, id, pos, similarity, (SELECT count(*) FROM s) AS stored FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS pos FROM n) WHERE pos <= 5"""

_FULL = f"answer || chr(10) || chr(10) || {_HEAD} || chr(10) || '- ملف PDF: ' || src || ' [1]' || chr(10)"
ORACLES["answer_questions"] = f"""WITH r AS MATERIALIZED (SELECT * FROM {_RETRIEVED} WHERE qid % 40 = 0),
  first AS (SELECT qid, src, {strip(strip("regexp_extract(content, '^(.{0,200})', 1)") + " || ' [1]'")} AS answer FROM r WHERE rank = 1),
  refs AS (SELECT qid, string_agg(ref, ';' ORDER BY m) AS sources FROM (SELECT qid, 'PDF:' || src || ':p' || page AS ref, min(rank) AS m FROM r GROUP BY ALL) GROUP BY qid)
  SELECT v.vec_id AS qid, md5(coalesce({_FULL}, {q(PHRASES.refusal)})) AS full_md5, md5(coalesce(answer, {q(PHRASES.refusal)})) AS answer_md5,
    md5(CASE WHEN answer IS NULL THEN '' ELSE {_HEAD} || chr(10) || '- ملف PDF: ' || src || ' [1]' END) AS sources_md5, (SELECT count(*) FROM r WHERE r.qid = v.vec_id) AS n_contexts, coalesce(sources, '') AS sources, true AS ok
  FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id LEFT JOIN first ON first.qid = v.vec_id LEFT JOIN refs ON refs.qid = v.vec_id WHERE v.vec_id % 20 = 0"""

ORACLES["console_report"] = f"SELECT qid, rank, score, src AS source, md5(left(content, 400)) AS text_md5 FROM {_RETRIEVED} WHERE rank <= 5"

_JUDGED = f"""(SELECT *, qid % 5 <> 0 AND qid % 7 <> 0 AS judged, len(ids) > 0 AND len(list_filter(ids, lambda x: x < 1 OR x > n)) = 0 AS citation_valid, abstained = (qid % 2 = 0) AS abstention_correct
  FROM (SELECT *, {_IDS} AS ids, {_ABSTAIN} AS abstained FROM (SELECT conv_id AS qid, CASE WHEN conv_id % 4 = 3 THEN {q(PHRASES.no_results)} ELSE arg_min(answer, turn) END AS answer, CASE WHEN conv_id % 4 = 3 THEN 0 ELSE 1 END AS n FROM {_ANSWERS} GROUP BY conv_id)))"""
ORACLES["judged_report"] = f"""SELECT qid, abstained, abstention_correct, n = 1 AS used_gold_source, CASE WHEN n = 1 THEN 's' ELSE '' END AS retrieved_sources, citation_valid, CASE WHEN judged THEN CAST(qid % 6 AS DOUBLE) END AS faithfulness_score,
  CASE WHEN judged THEN qid % 2 = 0 END AS faithfulness_passed, CASE WHEN judged THEN CASE qid % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'a | b' END END AS unsupported_claims, CASE WHEN judged THEN CAST(qid % 4 AS DOUBLE) END AS correctness_score,
  CASE WHEN judged THEN qid % 3 = 0 END AS critical_error, CASE WHEN judged THEN 'F:f | R:r | C:c | L:l' END AS judge_notes, CASE WHEN qid % 5 = 0 THEN 'judge is busy' WHEN qid % 7 = 0 THEN 'verdict lacks fluency' ELSE '' END AS judge_error, md5(answer) AS answer_md5 FROM {_JUDGED}"""
ORACLES["judged_summary"] = f"""SELECT count(*) AS n_total, count(*) FILTER (judged) AS n_scored, round(avg(CAST(citation_valid AS DOUBLE)), 6) AS citation_valid_rate, round(avg(CAST(abstention_correct AS DOUBLE)), 6) AS abstention_accuracy,
  round(avg(CAST(n = 1 AS DOUBLE)) FILTER (judged), 6) AS gold_source_covered_rate, round(avg(CAST(qid % 2 = 0 AS DOUBLE)) FILTER (judged), 6) AS faithfulness_pass_rate, round(avg(CAST(qid % 6 AS DOUBLE)) FILTER (judged), 6) AS avg_faithfulness,
  4.0::DOUBLE AS avg_relevance, round(avg(CAST(qid % 4 AS DOUBLE)) FILTER (judged), 6) AS avg_correctness, round(avg(CAST(qid % 3 = 0 AS DOUBLE)) FILTER (judged), 6) AS critical_error_rate, 5.0::DOUBLE AS avg_fluency FROM {_JUDGED}"""
