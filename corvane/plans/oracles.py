"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from corvane.operators.answer import DONT_KNOW, PROMPT
from corvane.operators.chunk import OVERLAP, SEPARATORS, SIZE
from corvane.operators.profile import STOP_WORDS


def cleaned(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[\x00-\x1F\x7F-\x9F]', '', 'g'), '[^\x00-\x7F]+', '', 'g'), '\s+', ' ', 'g'), '_+', ' ', 'g'))"


def split(x: str) -> str:
    return f"list_filter(string_split({cleaned(x)}, ' '), lambda x: x <> '')"


FILES = """
cur AS (SELECT 'doc/' || doc_id AS file_path, n_chars::BIGINT AS size FROM documents),
man AS (SELECT 'doc/' || doc_id AS file_path, (n_chars + CASE WHEN q = 0 THEN 1 ELSE 0 END)::BIGINT AS size FROM documents JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id)
        UNION ALL SELECT 'item/' || item_id, 0 FROM benchmark),
status AS (SELECT cur.file_path, cur.size, CASE WHEN man.file_path IS NULL THEN 'new' WHEN cur.size IS NOT DISTINCT FROM man.size THEN 'same' ELSE 'modified' END AS status FROM cur LEFT JOIN man USING (file_path))"""

BM25 = f"""
dw AS (SELECT doc_id AS id, {split("text")} AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM dw),
qt AS (SELECT DISTINCT item_id AS qid, unnest({split("text")}) AS t FROM benchmark),
tf AS (SELECT id, any_value(dl) AS dl, t, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS t FROM dw) GROUP BY id, t),
idf AS (SELECT t, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY t),
bm AS (SELECT qid, id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (t) JOIN idf USING (t), stats GROUP BY qid, id),
sparse AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM bm)"""

DENSE = """
dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM (
    SELECT q.item_id AS qid, v.vec_id AS id, list_cosine_similarity(qv.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
    FROM benchmark q JOIN embeddings qv ON qv.vec_id = q.item_id JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) v ON true))"""


def fused(k: int) -> str:
    return f"""
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM (
    SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT qid, id, rank FROM sparse WHERE rank <= {k} UNION ALL SELECT qid, id, rank FROM dense WHERE rank <= {k}) GROUP BY qid, id))"""


PAIRS = """
turns AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, coalesce(next_text, '') AS ref, coalesce(text, '') AS cand FROM turns WHERE role = 'user' AND next_role = 'assistant')"""


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\x00-\x20\x{{7F}}-\x{{A0}}]')"


def grams(n: int) -> str:
    def of(side: str) -> str:
        return f"(SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len({side}) - {n - 1} + 1), lambda i: array_to_string({side}[i:i + {n - 1}], ' '))) AS g FROM tok) GROUP BY ALL)"

    return f"SELECT a.conv_id, a.turn, {n} AS k, sum(least(a.c, coalesce(b.c, 0)))::DOUBLE AS hits FROM {of('cw')} a LEFT JOIN {of('rw')} b USING (conv_id, turn, g) GROUP BY ALL"


WORDS = r"list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '[!-/:-@\[-`{-~]', '', 'g')), '[\s\x1c-\x1f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')"
NAME = r"regexp_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1], '^(\.*[^.].*?|\.*)(\.[^.]*)?$', {n})"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_PROMPT = PROMPT.split("%s")
COUNTS = f"words AS (SELECT unnest({WORDS}) AS word FROM documents), counts AS (SELECT word, count(*) AS frequency FROM words WHERE word NOT IN ({', '.join(map(quoted, STOP_WORDS))}) GROUP BY word)"

_HITS = " UNION ALL ".join(grams(n) for n in range(1, 5))
BLEU = f"""
tok AS (SELECT conv_id, turn, {tokens("ref")} AS rw, {tokens("cand")} AS cw FROM pairs),
hits AS ({_HITS}),
each AS (SELECT t.conv_id, t.turn, o.k AS k, len(rw) AS r, len(cw) AS c, coalesce(h.hits, 0) AS hits, greatest(1, len(cw) - o.k + 1) AS total
         FROM tok t CROSS JOIN range(1, 5) AS o(k) LEFT JOIN hits h ON h.conv_id = t.conv_id AND h.turn = t.turn AND h.k = o.k),
counted AS (SELECT *, sum(CASE WHEN hits = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY k) AS i FROM each),
p AS (SELECT *, CASE WHEN hits > 0 THEN hits / total WHEN c > 1 THEN ln(c) / (2 ** i * 5) / total END AS p FROM counted),
bleu AS (SELECT conv_id, turn, CASE WHEN min(r) = 0 OR min(c) = 0 OR max(CASE WHEN k = 1 THEN hits END) = 0 THEN 0.0
         ELSE round(least(1.0, exp(1 - min(r)::DOUBLE / greatest(min(c), 1))) * exp(sum(coalesce(ln(p), 0)) / 4), 6) END AS bleu FROM p GROUP BY conv_id, turn)"""
#: The longest common subsequence by rows of the usual table: a word of the candidate is where it first is in the reference, 0 if nowhere.
ROUGE = """
rt AS (SELECT conv_id, turn, regexp_extract_all(lower(ref), '[a-z0-9]+') AS a, regexp_extract_all(lower(cand), '[a-z0-9]+') AS b FROM pairs),
numbered AS (SELECT conv_id, turn, len(a) AS na, len(b) AS nb, list_transform(a, lambda t: list_position(a, t)::BIGINT) AS ai,
             list_transform(b, lambda t: [coalesce(list_position(a, t), 0)::BIGINT]) AS bi FROM rt),
common AS (SELECT conv_id, turn, na, nb, list_reduce(list_prepend(list_transform(range(0, na + 1), lambda x: 0::BIGINT), bi), lambda above, y:
             list_reduce(list_prepend([0::BIGINT], list_transform(range(1, na + 1), lambda j: [j])), lambda done, j:
               list_append(done, CASE WHEN ai[j[1]] = y[1] THEN above[j[1]] + 1 ELSE greatest(above[j[1] + 1], done[j[1]]) END)))[na + 1] AS n FROM numbered),
rouge AS (SELECT conv_id, turn, CASE WHEN n > 0 THEN round(2.0::DOUBLE * n / (na + nb), 6) ELSE 0.0 END AS rouge_l FROM common)"""
BERT = """
bt AS (SELECT conv_id, turn, regexp_extract_all(lower(ref), '[a-z0-9]+') AS a, regexp_extract_all(lower(cand), '[a-z0-9]+') AS b FROM pairs),
bw AS (SELECT conv_id, turn, 1 AS side, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS w FROM bt) GROUP BY ALL
       UNION ALL SELECT conv_id, turn, 2, w, count(*) FROM (SELECT conv_id, turn, unnest(b) AS w FROM bt) GROUP BY ALL),
grams AS (SELECT w, unnest(list_transform(range(1, length(w) + 1), lambda i: ('<' || w || '>')[i:i + 2])) AS g FROM (SELECT DISTINCT w FROM bw)),
hashed AS (SELECT w, ('0x' || md5(g)[1:8])::BIGINT AS h FROM grams),
places AS (SELECT w, h % 64 AS d, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM hashed GROUP BY ALL),
norms AS (SELECT w, sqrt(sum(v * v)) AS norm FROM places GROUP BY w),
vectors AS (SELECT w, list(coalesce(v, 0) / CASE WHEN norm > 0 THEN norm ELSE 1 END ORDER BY d) AS v FROM norms CROSS JOIN range(64) AS o(d) LEFT JOIN places USING (w, d) GROUP BY w),
cosines AS (SELECT x.conv_id, x.turn, x.w AS aw, y.w AS bw, any_value(x.n) AS an, any_value(y.n) AS bn, any_value(list_inner_product(vx.v, vy.v)) AS c
            FROM bw x JOIN bw y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.side = 1 AND y.side = 2 JOIN vectors vx ON vx.w = x.w JOIN vectors vy ON vy.w = y.w GROUP BY ALL),
recall AS (SELECT conv_id, turn, sum(n * c) / sum(n) AS r FROM (SELECT conv_id, turn, aw, any_value(an) AS n, max(c) AS c FROM cosines GROUP BY ALL) GROUP BY ALL),
precise AS (SELECT conv_id, turn, sum(n * c) / sum(n) AS p FROM (SELECT conv_id, turn, bw, any_value(bn) AS n, max(c) AS c FROM cosines GROUP BY ALL) GROUP BY ALL),
bert AS (SELECT conv_id, turn, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 6) ELSE 0.0 END AS bertscore_f1 FROM pairs LEFT JOIN recall USING (conv_id, turn) LEFT JOIN precise USING (conv_id, turn))"""
EVAL = f"""
{PAIRS}, {BLEU}, {ROUGE}, {BERT},
er AS (SELECT conv_id, turn, ref AS Reference_Answer, cand AS Generated_Answer, CASE WHEN conv_id % 5 = 0 THEN 'Error' ELSE 'Success' END AS Status,
       CASE WHEN ref = '' OR cand = '' OR conv_id % 5 = 0 THEN 0.0 ELSE bleu END AS BLEU_Score, CASE WHEN ref = '' OR cand = '' OR conv_id % 5 = 0 THEN 0.0 ELSE rouge_l END AS ROUGE_L_F1,
       CASE WHEN ref = '' OR cand = '' OR conv_id % 5 = 0 THEN 0.0 ELSE bertscore_f1 END AS BERTScore_F1 FROM pairs JOIN bleu USING (conv_id, turn) JOIN rouge USING (conv_id, turn) JOIN bert USING (conv_id, turn))"""

#: Texts are split level by level; neighbouring pieces below the size are then joined by a fold over their numbers, whose state is the
#: first piece still held and the ranges given out so far. ``total`` holds running sums of lengths.
_SEPARATORS = ", ".join(f"repeat(chr(10), {len(s)})" if "\n" in s else f"'{s}'" for s in SEPARATORS)
_HELD = "(total[{i}] - total[{h}] + gap * ({i} - {h} - 1))"
CHUNKS = f"""
nodes AS (
    SELECT doc_id, []::BIGINT[] AS path, {cleaned("text")} AS t, 1::BIGINT AS s FROM documents
    UNION ALL
    SELECT doc_id, list_append(path, pos), ps[pos], level + 1 FROM (
        SELECT doc_id, path, level, ps, unnest(range(1, len(ps) + 1)) AS pos FROM (
            SELECT doc_id, path, level, list_filter(string_split(t, ([{_SEPARATORS}])[level]), lambda x: x <> '') AS ps FROM (
                SELECT *, coalesce(list_filter(range(1, {len(SEPARATORS) + 1}), lambda k: k >= s AND contains(t, ([{_SEPARATORS}])[k]))[1], {len(SEPARATORS)}) AS level FROM nodes)))
    WHERE length(ps[pos]) >= {SIZE} AND level < {len(SEPARATORS)}),
levels AS (SELECT *, coalesce(list_filter(range(1, {len(SEPARATORS) + 1}), lambda k: k >= s AND contains(t, ([{_SEPARATORS}])[k]))[1], {len(SEPARATORS)}) AS level FROM nodes),
cut AS (SELECT doc_id, path, level, list_filter(string_split(t, ([{_SEPARATORS}])[level]), lambda x: x <> '') AS ps FROM levels),
pieces AS (SELECT doc_id, path, level, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS pos FROM cut),
runs AS (SELECT *, length(piece) >= {SIZE} AS big, sum(CASE WHEN length(piece) >= {SIZE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, path ORDER BY pos) AS run FROM pieces),
groups AS (SELECT doc_id, path, min(pos) AS p0, ([{_SEPARATORS}])[any_value(level)] AS sep, list(piece ORDER BY pos) AS ps FROM runs WHERE NOT big GROUP BY doc_id, path, run),
sums AS (SELECT *, length(sep) AS gap, list_transform(range(0, len(ps) + 1), lambda n: coalesce(list_sum(list_transform(ps[1:n], lambda x: length(x))), 0)::BIGINT) AS total FROM groups),
folded AS (SELECT *, list_reduce(list_prepend([1::BIGINT], list_transform(range(1, len(ps) + 1), lambda i: [i])), lambda acc, x:
    CASE WHEN x[1] > acc[1] AND {_HELD.format(i="x[1]", h="acc[1]")} + gap + total[x[1] + 1] - total[x[1]] > {SIZE}
         THEN list_concat([list_filter(range(acc[1], x[1] + 1), lambda h: h = x[1] OR ({_HELD.format(i="x[1]", h="h")} <= {OVERLAP} AND {_HELD.format(i="x[1]", h="h")} + gap + total[x[1] + 1] - total[x[1]] <= {SIZE}))[1]], acc[2:], [acc[1], x[1] - 1])
         ELSE acc END) AS st FROM sums),
ranged AS (SELECT *, list_concat(st[2:], [st[1], len(ps)]) AS r FROM folded),
found AS (SELECT doc_id, list_concat(path, [p0, j]) AS place, trim(list_reduce(ps[r[2 * j - 1]:r[2 * j]], lambda x, y: x || sep || y)) AS page_content FROM (SELECT *, unnest(range(1, len(r) // 2 + 1)) AS j FROM ranged)
          UNION ALL SELECT doc_id, list_concat(path, [pos, 0]), piece FROM runs WHERE big AND level = {len(SEPARATORS)})"""

ORACLES: dict[str, str] = {
    "next_manifest": f"WITH {FILES} SELECT file_path, size FROM cur WHERE NOT file_path LIKE '%7' UNION ALL SELECT file_path, size FROM man WHERE file_path LIKE '%7' AND file_path IN (SELECT file_path FROM cur)",
    "index_delete_by_file": f"WITH {FILES} SELECT file_path, size FROM cur WHERE file_path NOT IN (SELECT file_path FROM man)",
    "golden_references": "SELECT b.text AS Question, coalesce(c.text, '') AS Reference_Answer FROM benchmark b LEFT JOIN conversations c ON c.conv_id = b.item_id AND c.turn = 0",
    "asked_queries": "SELECT conv_id, turn, substring(text, 1, 50) AS preview FROM conversations WHERE trim(text) <> ''",
    "unconverted_files": """
        WITH p AS (SELECT DISTINCT 'f/' || page_id // 2 AS base, CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOC' ELSE '.docx' END AS ext FROM pages)
        SELECT base || ext AS path FROM p WHERE ext <> '.pdf' AND base NOT IN (SELECT base FROM p WHERE ext = '.pdf')""",
    "local_dates": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date FROM events",
    "stats_report": f"""
        WITH {COUNTS} SELECT printf('Total words: %d', sum(frequency)::BIGINT) || chr(10) || printf('Unique words: %d', count(*)) || chr(10) ||
               printf('Average word length: %.2f', (sum(frequency * length(word)) / sum(frequency))::DOUBLE) AS report FROM counts""",
    "chunk_ids": "SELECT conv_id, turn, sha256(concat_ws('|', conv_id, turn, text)) AS chunk_id FROM conversations",
    "metric_labels": "SELECT * FROM (VALUES ('Latency_ms', 'latency(ms)'), ('Peak_Script_Memory_MB', 'peak script memory(MB)'), ('BLEU_Score', 'bleu score'), ('ROUGE_L_F1', 'rouge l f1'), ('BERTScore_F1', 'bertscore f1')) AS v(metric, label)",
    "term_postings": f"WITH dw AS (SELECT doc_id AS id, {split('text')} AS w FROM documents) SELECT id, term, count(*) AS tf, any_value(dl)::INT AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM dw) GROUP BY id, term",
    "dense_encode": f"""
        WITH words AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest({split('text')}) AS w FROM benchmark) GROUP BY ALL),
        grams AS (SELECT item_id, n, unnest(list_append(list_transform(range(1, length(w) + 1), lambda i: ('<' || w || '>')[i:i + 2]), '=' || w)) AS g FROM words),
        hashed AS (SELECT item_id, n, ('0x' || md5(g)[1:8])::BIGINT AS h FROM grams),
        sums AS (SELECT item_id, h % 384 AS dim, sum(CASE WHEN (h >> 16) & 1 = 1 THEN ln(1 + n) ELSE -ln(1 + n) END) AS v FROM hashed GROUP BY ALL)
        SELECT item_id, dim::INT AS dim, round(v::FLOAT::DOUBLE, 4) AS value FROM (SELECT item_id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY item_id)) AS v FROM sums) WHERE abs(v) > 1e-7""",
    "chunk_documents": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS chunk_ix, page_content FROM found WHERE page_content <> ''",
    "rouge_l_unstemmed": f"WITH {PAIRS}, {ROUGE} SELECT conv_id, turn, rouge_l FROM rouge",
    "bertscore_f1": f"WITH {PAIRS}, {BERT} SELECT conv_id, turn, bertscore_f1 FROM bert",
    "eval_rows": f"WITH {EVAL} SELECT * FROM er",
    "eval_summary": f"WITH {EVAL} SELECT count(*) AS total, count(*) FILTER (Status = 'Success') AS successes, {', '.join(f"round(avg({c}) FILTER (Status = 'Success'), 5) AS {c}" for c in ('BLEU_Score', 'ROUGE_L_F1', 'BERTScore_F1'))} FROM er",
    "duplicate_names": f"""
        WITH p AS (SELECT regexp_replace(url, '[?#].*$', '') AS path, lower({NAME.format(n=1)}) AS name, lower({NAME.format(n=2)}) AS ext FROM pages)
        SELECT name, count(*)::INT AS n, string_agg(ext || ' ' || path, chr(10) ORDER BY ext, path) AS files FROM p GROUP BY name HAVING count(*) > 1""",
    "clean_text": f"SELECT doc_id, {cleaned('text')} AS cleaned FROM documents",
    "page_concat": "SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS page_content, count(*) AS num_pages FROM conversations WHERE text <> '' GROUP BY conv_id",
    "change_detection": f"WITH {FILES} SELECT file_path, size, status FROM status",
    "deleted_files": f"WITH {FILES} SELECT file_path FROM man WHERE file_path NOT IN (SELECT file_path FROM cur)",
    "index_replace_by_file": f"WITH {FILES} SELECT file_path, 'new' AS version, size FROM status WHERE status <> 'same' UNION ALL SELECT file_path, 'old', size FROM man WHERE file_path IN (SELECT file_path FROM status WHERE status = 'same')",
    "corpus_stats": f"WITH {COUNTS} SELECT sum(frequency)::BIGINT AS total_words, count(*) AS unique_words, round(sum(frequency * length(word)) / sum(frequency), 6) AS avg_word_len FROM counts",
    "word_freq_top20": f"WITH {COUNTS} SELECT word, frequency FROM counts ORDER BY frequency DESC, word LIMIT 20",
    "query_responses": f"""
        WITH {BM25}, found AS (SELECT qid, rank, text, json_object('page_content', text, 'metadata', json_object('file_path', 'doc/' || id, 'score', round(score, 6))) AS j FROM sparse JOIN documents ON doc_id = id WHERE rank <= 10),
        lists AS (SELECT qid, min_by(text, rank) AS top, to_json(list(j ORDER BY rank)) AS js FROM found GROUP BY qid)
        SELECT item_id AS qid, json_object('answer', coalesce(top, {quoted(DONT_KNOW)}), 'source_documents', coalesce(js, '[]'::JSON))::VARCHAR AS response FROM benchmark LEFT JOIN lists ON qid = item_id""",
    "duplicate_groups": f"SELECT sha256({cleaned('text')}) AS text_sha256, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "classify_extension": f"WITH p AS (SELECT page_id, lower({NAME.format(n=1)}) AS stem, lower({NAME.format(n=2)}) AS extension FROM pages) SELECT page_id, stem, extension, CASE WHEN extension = '.pdf' THEN 'pdf' WHEN extension IN ('.doc', '.docx') THEN 'word' ELSE 'other' END AS kind FROM p",
    "display_name": "SELECT page_id, coalesce(nullif(string_split(url, '/')[-1], ''), 'Source Document') AS display_name FROM pages",
    "dense_topk": """
        SELECT qid, id, rank::INT AS rank, round(score, 6) AS score FROM (
            SELECT q.vec_id AS qid, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score,
                   row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank
            FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0) WHERE rank <= 10""",
    "sparse_topk": f"WITH {BM25} SELECT qid, id, rank::INT AS rank, round(score, 6) AS score FROM sparse WHERE rank <= 10",
    "hybrid_rrf": f"WITH {BM25}, {DENSE}, {fused(10)} SELECT qid, id, rank::INT AS rank, round(score, 9) AS score FROM fused WHERE rank <= 10",
    "hybrid_rerank": f"""
        WITH {BM25}, {DENSE}, {fused(20)},
        cov AS (SELECT qid, f.id, coalesce(sum(CASE WHEN tf.t IS NOT NULL THEN idf ELSE 0 END) / nullif(sum(coalesce(idf, 0)), 0), 0) AS score
                FROM (SELECT qid, id FROM fused WHERE rank <= 20) f JOIN qt USING (qid) LEFT JOIN idf USING (t) LEFT JOIN tf ON tf.id = f.id AND tf.t = qt.t GROUP BY qid, f.id),
        best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM cov)
        SELECT qid, id, rank::INT AS rank, round(score, 6) AS score FROM best WHERE rank <= 3""",
    "answer_top1": f"WITH {BM25} SELECT b.item_id AS qid, coalesce(d.text, {quoted(DONT_KNOW)}) AS answer FROM benchmark b LEFT JOIN sparse s ON s.qid = b.item_id AND s.rank = 1 LEFT JOIN documents d ON d.doc_id = s.id",
    "format_docs": f"WITH {BM25} SELECT qid, rank::INT AS rank, '' AS doc_name, 'doc/' || id AS file_path, id::VARCHAR AS display_name, round(score, 6) AS score FROM sparse WHERE rank <= 10",
    "render_prompt": f"WITH {BM25}, ctx AS (SELECT qid, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM sparse JOIN documents ON doc_id = id WHERE rank <= 10 GROUP BY qid) SELECT item_id AS qid, {quoted(_PROMPT[0])} || coalesce(context, '') || {quoted(_PROMPT[1])} || coalesce(text, '') || {quoted(_PROMPT[2])} AS prompt FROM benchmark LEFT JOIN ctx ON qid = item_id",
    "bleu": f"WITH {PAIRS}, {BLEU} SELECT conv_id, turn, bleu FROM bleu",
}
