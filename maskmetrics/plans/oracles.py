"""DuckDB SQL for the registered queries, worked out from the definitions and not from the operators."""

from __future__ import annotations

from ..functions import parser
from ..functions import text as T

_LIST = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_IGNORED = "[" + "".join("\\" + c if c in "[]-" else c for c in T.CHARACTERS_TO_IGNORE).replace("'", "''") + "]"
_ENTITIES = {
    "EMAIL": r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+", "IP": r"\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}", "CARD": r"\p{Nd}{13,19}", "PERSON": r"[A-Z][a-z]+(?: [A-Z][a-z]+)+", "QUANTITY": r"\p{Nd}+(?:[.,]\p{Nd}+)*",
}
_LABEL = "CASE " + " ".join(f"WHEN regexp_full_match(run, '{pattern}') THEN '{name}'" for name, pattern in _ENTITIES.items()) + " END"
_CLASS = (
    "CASE "
    + " ".join(f"WHEN lower(run) IN ({_LIST(members)}) THEN '{name}'" for name, members in [*parser.CLOSED_CLASSES.items(), *parser.MORE_CLASSES.items()])
    + r" WHEN regexp_matches(run, '^[0-9]') THEN 'NUM' WHEN regexp_matches(run, '^[^\p{L}\p{N}_]') THEN 'PUNCT' WHEN regexp_matches(run, '^\p{Lu}') THEN 'PROPN' "
    + " ".join(f"WHEN regexp_matches(lower(run), '..(?:{'|'.join(members)})$') THEN '{name}'" for name, members in parser.OPEN_ENDINGS.items())
    + " ELSE 'NOUN' END"
)
#: Tags O, B-X, I-X, B-Y, I-Y: what leads from one to the other, by fixed weights; I- only after its own.
_LEADS = [[((i * 7 + j * 13) % 17) * 1_000_003 if j not in (2, 4) or i in (j - 1, j) else -(10**12) for j in range(5)] for i in range(5)]
_PARTS = {
    "docs": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, length(text) AS n_chars FROM documents",
    "runs": r"SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS r FROM docs",
    "pieces": "SELECT doc_id, unnest(r) AS run, generate_subscripts(r, 1) AS pos FROM runs",
    "placed": "SELECT doc_id, run, pos, CAST(coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM pieces",
    "words": r"SELECT doc_id, run AS word, s, s + length(run) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS w_ord FROM placed WHERE regexp_matches(run, '^[\p{L}\p{N}_]')",
    "hashed": "SELECT *, CAST(doc_id AS BIGINT) * 31 + w_ord * 7 AS h FROM words",
    "mentions": " UNION ALL ".join(
        f"SELECT doc_id, '{a}' AS annotator, row_number() OVER (PARTITION BY doc_id ORDER BY w_ord) - 1 AS mention_ord, doc_id || '_{a}_' || CAST(w_ord % 5 AS VARCHAR) AS entity_id, "
        "['PERSON', 'LOC', 'ORG', 'DATETIME'][h % 4 + 1] AS entity_type, ['DIRECT', 'QUASI', 'NO_MASK'][h % 3 + 1] AS identifier_type, s, e "
        f"FROM hashed WHERE h % {k} = 0"
        for a, k in (("a1", 11), ("a2", 13))
    ),
    "ahead": "SELECT *, lead(e, 1) OVER w AS e1, lead(e, 2) OVER w AS e2, max(w_ord) OVER (PARTITION BY doc_id) AS last FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY w_ord)",
    "marks": "SELECT 'Gold' AS anon_name, doc_id, s, e, CAST(NULL AS VARCHAR) AS replacement FROM hashed WHERE h % 11 = 0 AND h % 3 <> 2 "
    "UNION ALL SELECT 'Sparse', doc_id, s, e, NULL FROM hashed WHERE h % 17 = 0 UNION ALL SELECT 'Wide', doc_id, s, e2, NULL FROM ahead WHERE w_ord % 29 = 0 AND e2 IS NOT NULL "
    "UNION ALL SELECT 'Repl', doc_id, s, e, ['PERSON', 'LOC', 'ORG', 'DATETIME'][h % 4 + 1] FROM hashed WHERE h % 19 = 0 "
    "UNION ALL SELECT 'Tail', a.doc_id, s, n_chars, NULL FROM ahead a JOIN docs d ON a.doc_id = d.doc_id WHERE w_ord = last - 2 "
    "UNION ALL SELECT 'Overlap', doc_id, s, e1, NULL FROM ahead WHERE w_ord % 23 IN (0, 1) AND e1 IS NOT NULL",
    "maskings": "SELECT *, row_number() OVER (PARTITION BY anon_name, doc_id ORDER BY s, e) - 1 AS mask_ord FROM marks",
    "names": "SELECT * FROM (VALUES ('Clear', 0), ('Gold', 1), ('Sparse', 2), ('Wide', 3), ('Repl', 4), ('Tail', 5), ('Overlap', 6)) t(anon_name, anon_ord)",
    "anon_docs": "SELECT anon_name, anon_ord, doc_id FROM names, docs",
    "begun": "SELECT *, CASE WHEN max(e) OVER (PARTITION BY anon_name, doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS new FROM maskings",
    "grouped": "SELECT *, sum(new) OVER (PARTITION BY anon_name, doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM begun",
    "islands": "SELECT anon_name, doc_id, min(s) AS s, max(e) AS e FROM grouped GROUP BY anon_name, doc_id, g",
    "inner_islands": "SELECT i.* FROM islands i JOIN docs d ON i.doc_id = d.doc_id WHERE e < n_chars",
    "entities": "SELECT doc_id, annotator, entity_id, arg_min(entity_type, mention_ord) AS entity_type, bool_or(identifier_type <> 'NO_MASK') AS need_masking, arg_min(identifier_type = 'DIRECT', mention_ord) AS is_direct, count(*) AS n_mentions FROM mentions GROUP BY ALL",
    "annotators": "SELECT doc_id, count(DISTINCT annotator) AS n_annotators FROM mentions GROUP BY doc_id",
    # words of masks: every mask of these anonymizations begins and ends at a word's edge, or at the text's end
    "mask_words": "SELECT m.anon_name, m.doc_id, m.mask_ord, w.s, w.e, lower(w.word) AS word FROM maskings m JOIN words w ON m.doc_id = w.doc_id AND m.s <= w.s AND w.e <= m.e",
    "need": "SELECT DISTINCT doc_id, annotator, s, e FROM mentions WHERE identifier_type <> 'NO_MASK'",
    "counted_words": "SELECT lower(word) AS word, count(*) AS c FROM words GROUP BY 1",
    "ics": "SELECT word, -ln((c + 1.0) / ((SELECT sum(c) FROM counted_words) + (SELECT count(*) FROM counted_words))) AS ic FROM counted_words",
    # mentions are single words: one is masked if an island holds it, or if it is an ignorable word
    "judged": f"SELECT a.anon_name, m.*, (lower(w.word) IN ({_LIST(parser.IGNORABLE_WORDS)}) OR EXISTS (SELECT 1 FROM islands i WHERE i.anon_name = a.anon_name AND i.doc_id = m.doc_id AND i.s <= m.s AND m.e <= i.e)) AS is_masked "
    "FROM mentions m JOIN words w ON w.doc_id = m.doc_id AND w.s = m.s JOIN anon_docs a ON a.doc_id = m.doc_id",
    "asked": "SELECT j.*, x.entity_type AS type, x.is_direct FROM judged j JOIN entities x ON j.doc_id = x.doc_id AND j.annotator = x.annotator AND j.entity_id = x.entity_id WHERE x.need_masking",
    "term_runs": r"SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]') AS r FROM docs",
    "term_pieces": "SELECT doc_id, unnest(r) AS run, generate_subscripts(r, 1) AS pos FROM term_runs",
    "term_places": "SELECT doc_id, run, pos, CAST(coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM term_pieces",
    "terms": r"SELECT doc_id, run, s, s + length(run) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS term_ord FROM term_places WHERE NOT regexp_matches(run, '^\s')",
    "term_ics": "SELECT t.*, coalesce(i.ic, 0) AS ic FROM terms t LEFT JOIN ics i ON lower(t.run) = i.word",
    "hit_terms": "SELECT DISTINCT i.anon_name, t.doc_id, t.term_ord, t.ic FROM term_ics t JOIN inner_islands i ON t.doc_id = i.doc_id AND ((t.s <= i.s AND i.s < t.e) OR (t.s < i.e AND i.e <= t.e))",
    "sub_runs": r"SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]{1,3}|[^\p{L}\p{N}_]') AS r FROM docs",
    "sub_pieces": "SELECT doc_id, unnest(r) AS run, generate_subscripts(r, 1) AS pos FROM sub_runs",
    "sub_places": "SELECT doc_id, run, pos, CAST(coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM sub_pieces",
    "subs": r"SELECT doc_id, s, (ord(run) * 31 + length(run) * 7) % 64 AS id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM sub_places WHERE NOT regexp_matches(run, '^\s')",
    # each subword lies in the last term that begins at or before it
    "term_subs": "SELECT b.doc_id, b.k, b.id, b.k // 100 AS seg, t.term_ord, t.term_ord % 6 AS rnd FROM subs b ASOF JOIN terms t ON b.doc_id = t.doc_id AND b.s >= t.s",
    "seg_sums": "SELECT doc_id, seg, sum(id) + CASE WHEN seg = 0 THEN 1 ELSE 0 END AS total, count(*) + CASE WHEN seg = 0 THEN 1 ELSE 0 END AS n FROM term_subs GROUP BY doc_id, seg",
    "seg_rounds": "SELECT t.doc_id, rnd, t.seg, any_value(n) AS n, count(*) AS n_masked, any_value(total) - sum(id) AS seen FROM term_subs t JOIN seg_sums s ON t.doc_id = s.doc_id AND t.seg = s.seg GROUP BY t.doc_id, rnd, t.seg",
    "denominators": "SELECT base, sum(exp(((v * 5 + base) % 11) / 4.0::DOUBLE)) AS z FROM range(11) a(base), range(64) b(v) GROUP BY base",
    "sub_bases": "SELECT t.doc_id, t.term_ord, t.id, CAST((r.seen + 3 * (t.k % 100)) % 11 AS BIGINT) AS base FROM term_subs t JOIN seg_rounds r ON t.doc_id = r.doc_id AND t.rnd = r.rnd AND t.seg = r.seg",
    "totals": "SELECT doc_id, count(*) AS n_terms, sum(ic) AS total FROM term_ics GROUP BY doc_id",
    "lost": "SELECT anon_name, doc_id, count(*) AS n, sum(ic) AS ic FROM hit_terms GROUP BY ALL",
    "kept": "SELECT a.anon_name, a.doc_id, n_terms, total, coalesce(l.n, 0) AS n, coalesce(l.ic, 0) AS ic FROM anon_docs a JOIN totals t ON a.doc_id = t.doc_id LEFT JOIN lost l ON l.anon_name = a.anon_name AND l.doc_id = a.doc_id",
    "background": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT CAST(doc_id + 1000000 AS VARCHAR), text FROM documents WHERE doc_id % 10 = 1",
    "listed": "SELECT anon_name, doc_id, list({'s': s, 'e': e, 'r': coalesce(replacement, '')} ORDER BY mask_ord) AS ms FROM maskings GROUP BY ALL",
    "components": "SELECT vec_id, label, unnest(embedding)::DOUBLE AS c, generate_subscripts(embedding, 1) AS d FROM embeddings",
    "centre_parts": "SELECT label, d, avg(c) AS c FROM components GROUP BY ALL",
    "scored": "SELECT v.vec_id, m.label AS b, sum(v.c * m.c) AS s FROM components v JOIN centre_parts m ON v.d = m.d GROUP BY ALL",
    "nearest": "SELECT vec_id, b FROM scored QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, b) = 1",
    "labelled": "SELECT e.label AS a, n.b FROM embeddings e JOIN nearest n ON e.vec_id = n.vec_id",
    "cells": "SELECT a, b, count(*)::DOUBLE AS n FROM labelled GROUP BY ALL",
    "tokens": r"SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS t FROM docs",
    "numbered": "SELECT doc_id, t, CASE WHEN len(t) <= 98 THEN 1 ELSE CAST(ceil((len(t) - 98) / 73.0) AS INT) + 1 END AS k FROM tokens WHERE doc_id IN (SELECT doc_id FROM docs WHERE text <> '')",
    "windows": "SELECT doc_id, i AS window_ord, t[i * 73 + 1 : i * 73 + 98] AS w FROM (SELECT doc_id, t, unnest(range(k)) AS i FROM numbered)",
    # entities by form; what is no entity is taken character by character
    "ent_runs": f"SELECT doc_id, regexp_extract_all(text, '{'|'.join(_ENTITIES.values())}|[\\s\\S]') AS r FROM docs",
    "ent_pieces": "SELECT doc_id, unnest(r) AS run, generate_subscripts(r, 1) AS pos FROM ent_runs",
    "ent_places": f"SELECT doc_id, run, pos, {_LABEL} AS label, CAST(coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM ent_pieces",
    "ents": "SELECT doc_id, s, s + length(run) AS e FROM ent_places WHERE label IS NOT NULL",
    "typed": "SELECT doc_id, string_agg(coalesce(label, run), '' ORDER BY pos) AS t FROM ent_places GROUP BY doc_id",
    "parsed": "SELECT t.doc_id, t.term_ord, t.s, t.e, n.s AS ent, CASE WHEN t.term_ord % 10 < 2 THEN t.term_ord // 10 END AS chunk FROM terms t LEFT JOIN ents n ON n.doc_id = t.doc_id AND n.s <= t.s AND t.e <= n.e",
    "free_chunks": "SELECT doc_id, chunk FROM parsed WHERE chunk IS NOT NULL GROUP BY ALL HAVING count(ent) = 0",
    "parsed_terms": "SELECT p.doc_id, min(p.s) AS s, max(p.e) AS e FROM parsed p LEFT JOIN free_chunks c ON p.doc_id = c.doc_id AND p.chunk = c.chunk GROUP BY p.doc_id, CASE WHEN ent IS NOT NULL THEN 'e' || ent WHEN c.chunk IS NOT NULL THEN 'c' || c.chunk ELSE 't' || p.term_ord END",
    # noun chunks as islands: words that may stand in one, up to the last noun, with a determiner right before them
    "classed": f"SELECT t.*, {_CLASS} AS class, instr(substr(d.text, CAST(coalesce(lag(e) OVER w, 0) + 1 AS INT), CAST(t.s - coalesce(lag(e) OVER w, 0) AS INT)), chr(10)) > 0 AS breaks FROM terms t JOIN docs d ON t.doc_id = d.doc_id WINDOW w AS (PARTITION BY t.doc_id ORDER BY term_ord)",
    "nominal": "SELECT *, class IN ('ADJ', 'NUM', 'NOUN', 'PROPN') AS may, class IN ('NOUN', 'PROPN') AS noun, lag(class) OVER (PARTITION BY doc_id ORDER BY term_ord) AS before FROM classed",
    "nominal_runs": "SELECT *, sum(CASE WHEN may AND NOT breaks AND before IN ('ADJ', 'NUM', 'NOUN', 'PROPN') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY term_ord) AS g FROM nominal",
    "chunk_spans": "SELECT doc_id, min(term_ord) - CASE WHEN arg_min(before = 'DET' AND NOT breaks, term_ord) THEN 1 ELSE 0 END AS a, max(term_ord) FILTER (noun) AS z FROM nominal_runs WHERE may GROUP BY doc_id, g HAVING bool_or(noun) "
    "UNION ALL SELECT doc_id, term_ord, term_ord FROM nominal WHERE class = 'PRON'",
    "chunked": "SELECT t.doc_id, t.term_ord, t.s, t.e, n.s AS ent, CASE WHEN t.term_ord <= c.z THEN c.a END AS chunk FROM terms t ASOF LEFT JOIN chunk_spans c ON t.doc_id = c.doc_id AND t.term_ord >= c.a LEFT JOIN ents n ON n.doc_id = t.doc_id AND n.s <= t.s AND t.e <= n.e",
    "own_free": "SELECT doc_id, chunk FROM chunked WHERE chunk IS NOT NULL GROUP BY ALL HAVING count(ent) = 0",
    "own_spans": "SELECT p.doc_id, min(p.s) AS s, max(p.e) AS e FROM chunked p LEFT JOIN own_free c ON p.doc_id = c.doc_id AND p.chunk = c.chunk GROUP BY p.doc_id, CASE WHEN ent IS NOT NULL THEN 'e' || ent WHEN c.chunk IS NOT NULL THEN 'c' || c.chunk ELSE 't' || p.term_ord END",
    "own_hits": "SELECT DISTINCT i.anon_name, t.doc_id, t.s FROM own_spans t JOIN inner_islands i ON t.doc_id = i.doc_id AND ((t.s <= i.s AND i.s < t.e) OR (t.s < i.e AND i.e <= t.e))",
    # a sentence ends with a line, or with marks before white space or the end; a mark by itself is none
    "mark_runs": r"SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+|[.!?]+|\n') AS r FROM docs",
    "mark_pieces": "SELECT doc_id, unnest(r) AS run, generate_subscripts(r, 1) AS pos FROM mark_runs",
    "mark_places": "SELECT *, CAST(coalesce(sum(length(run)) OVER w, 0) AS BIGINT) AS s, lead(run) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM mark_pieces WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "mark_breaks": r"SELECT *, CASE WHEN run = chr(10) OR (regexp_matches(run, '^[.!?]') AND (next IS NULL OR regexp_matches(next, '^\s'))) THEN 1 ELSE 0 END AS ends FROM mark_places",
    "mark_groups": "SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM mark_breaks",
    "sentence_spans": r"SELECT doc_id, min(s) AS s, max(s + length(run)) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS sent_id FROM mark_groups WHERE run <> chr(10) GROUP BY doc_id, g HAVING NOT regexp_full_match(string_agg(run, '' ORDER BY pos), '[.!?]')",
    # every second term is masked; two words on either side, as far as seen
    "low": "SELECT doc_id, term_ord AS pos, lower(run) AS w, lag(lower(run), 1, chr(10)) OVER o AS l1, lag(lower(run), 2, chr(10)) OVER o AS l2, lead(lower(run), 1, chr(10)) OVER o AS r1, lead(lower(run), 2, chr(10)) OVER o AS r2, s, e FROM terms WINDOW o AS (PARTITION BY doc_id ORDER BY term_ord)",
    "c0": "SELECT w, count(*) AS c FROM low GROUP BY ALL",
    "p0": "SELECT w, (c + 1)::DOUBLE / ((SELECT sum(c) + count(*) + 1 FROM c0)) AS p FROM c0",
    **{
        f"{x}1": f"SELECT g.h || ' ' || g.w AS g, (g.c + t * p)::DOUBLE / (n + t) AS p FROM (SELECT {a} AS h, w, count(*) AS c FROM low GROUP BY ALL) g JOIN (SELECT {a} AS h, count(*) AS n, count(DISTINCT w) AS t FROM low GROUP BY ALL) x ON x.h = g.h JOIN p0 ON p0.w = g.w"
        for x, a in (("pl", "l1"), ("pr", "r1"))
    },
    **{
        f"{x}2": f"SELECT g.k || ' ' || g.h || ' ' || g.w AS g, (g.c + t * p)::DOUBLE / (n + t) AS p FROM (SELECT {a}1 AS h, {a}2 AS k, w, {a}2 || ' ' || {a}1 AS kh, {a}1 || ' ' || w AS hw, count(*) AS c FROM low GROUP BY ALL) g JOIN (SELECT {a}2 || ' ' || {a}1 AS kh, count(*) AS n, count(DISTINCT w) AS t FROM low GROUP BY ALL) y ON y.kh = g.kh JOIN {x}1 b ON b.g = g.hw"
        for x, a in (("pl", "l"), ("pr", "r"))
    },
    "own_ranked": "SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS term_ord FROM own_spans",
    "covered_low": "SELECT l.*, o.term_ord, o.term_ord % 2 AS rnd FROM low l ASOF JOIN own_ranked o ON l.doc_id = o.doc_id AND l.s >= o.s",
    "seen": "SELECT *, CASE WHEN lag(rnd, 1) OVER o = rnd THEN 0 WHEN lag(rnd, 2) OVER o = rnd THEN 1 ELSE 2 END AS ol, CASE WHEN lead(rnd, 1) OVER o = rnd THEN 0 WHEN lead(rnd, 2) OVER o = rnd THEN 1 ELSE 2 END AS o_r FROM covered_low WINDOW o AS (PARTITION BY doc_id ORDER BY pos)",
    # tokens of no sentence go with the one before
    "sentence_tokens": "SELECT t.doc_id, t.term_ord, t.run, dense_rank() OVER (PARTITION BY t.doc_id ORDER BY coalesce(n.sent_id, -1)) - 1 AS sent_id FROM terms t ASOF LEFT JOIN sentence_spans n ON t.doc_id = n.doc_id AND t.s >= n.s",
    "emitted": "SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY term_ord) = 1 AS begins, list_transform(range(5), lambda k: (ord(run) * 7919 + length(run) * 104729 + (k + 1) * 1299709) * (ord(run) + k + 3) % 16777213) AS w FROM sentence_tokens",
    "steps": "SELECT doc_id, sent_id, count(*) AS n, list(CASE WHEN begins THEN list_transform(range(5), lambda k: {'s': CAST(w[k + 1] + [0, 300009, -1000000000000, 500015, -1000000000000][k + 1] AS BIGINT), 'p': CAST(k AS VARCHAR)}) "
    "ELSE list_transform(w, lambda x: {'s': CAST(x AS BIGINT), 'p': ''}) END ORDER BY term_ord) AS x FROM emitted GROUP BY ALL",
    # of equal ones the smaller tag: the greatest of (score, -tag)
    "walked": f"SELECT doc_id, sent_id, n, list_reduce(x, lambda a, t: list_transform(range(5), lambda j: list_transform([list_max(list_transform(range(5), lambda i: {{'s': a[i + 1].s + ({_LEADS})[i + 1][j + 1], 'i': -i, 'p': a[i + 1].p}}))], lambda b: {{'s': b.s + t[j + 1].s, 'p': b.p || j}})[1])) AS best FROM steps",
    "centre_ids": "SELECT k, r, j, j * 7 + r * 3 AS id FROM (SELECT unnest([2, 4, 8]) AS k), range(2) a(r), range(8) b(j) WHERE j < k",
    "centre_away": "SELECT c.k, c.r, c.j, v.vec_id, list_distance(v.embedding::DOUBLE[], m.embedding::DOUBLE[]) AS away FROM centre_ids c JOIN embeddings m ON m.vec_id = c.id, embeddings v",
    "centre_labels": "SELECT k, r, vec_id, arg_min(j, (away, j)) AS b FROM centre_away GROUP BY ALL",
    "units": "SELECT vec_id, label, d, c / sqrt(sum(c * c) OVER (PARTITION BY vec_id)) AS c FROM components",
    "lab_units": "SELECT l.k, l.r, l.b, u.vec_id, u.d, u.c FROM centre_labels l JOIN units u ON u.vec_id = l.vec_id",
    "lab_sums": "SELECT k, r, b, d, sum(c) AS c, count(*) AS n FROM lab_units GROUP BY ALL",
    "lab_dots": "SELECT u.k, u.r, u.vec_id, u.b AS own, x.b, any_value(x.n) AS n, 1 - sum(u.c * x.c) / any_value(x.n) AS away FROM lab_units u JOIN lab_sums x ON x.k = u.k AND x.r = u.r AND x.d = u.d GROUP BY ALL",
    "lab_each": "SELECT k, r, vec_id, max(CASE WHEN b = own THEN n END) AS size, max(CASE WHEN b = own AND n > 1 THEN away * n / (n - 1) END) AS mine, min(CASE WHEN b <> own THEN away END) AS other FROM lab_dots GROUP BY ALL",
    "unit_sums": "SELECT label AS b, d, sum(c) AS c FROM units GROUP BY ALL",
    "unit_sizes": "SELECT label AS b, count(DISTINCT vec_id) AS n FROM units GROUP BY ALL",
    "unit_dots": "SELECT u.vec_id, u.label, x.b, sum(u.c * x.c) AS dot FROM units u JOIN unit_sums x ON u.d = x.d GROUP BY ALL",
    "unit_away": "SELECT vec_id, any_value(CASE WHEN z.b = label THEN n END) AS own, min(CASE WHEN z.b <> label THEN 1 - dot / n END) AS other, max(CASE WHEN z.b = label AND n > 1 THEN (1 - dot / n) * n / (n - 1) END) AS mine FROM unit_dots o JOIN unit_sizes z ON o.b = z.b GROUP BY vec_id",
}


def _needed(sql: str) -> list[str]:
    """The parts that a query names, in order, with what they name."""
    import re

    found: set[str] = set()
    stack = [sql]
    while stack:
        for word in set(re.findall(r"\b\w+\b", stack.pop())):
            if word in _PARTS and word not in found:
                found.add(word)
                stack.append(_PARTS[word])
    return [k for k in _PARTS if k in found]


def _with(sql: str) -> str:
    parts = _needed(sql)
    return ("WITH " + ", ".join(f"{k} AS MATERIALIZED ({_PARTS[k]})" for k in parts) + " " if parts else "") + sql


_COVER = "(SELECT count(DISTINCT g.annotator) FROM need g WHERE g.doc_id = x.doc_id AND g.s <= x.s AND x.e <= g.e)"


def _precision(spans: str, weight: str) -> str:
    return (
        f"SELECT n.anon_name, round(coalesce(CASE WHEN sum(n_annotators * w) <> 0 THEN sum(c * w) / sum(n_annotators * w) END, 0), 6) AS precision FROM names n LEFT JOIN "
        f"(SELECT x.anon_name, {_COVER}::DOUBLE AS c, coalesce(a.n_annotators, 0) AS n_annotators, {weight} AS w FROM {spans} x LEFT JOIN annotators a ON a.doc_id = x.doc_id) p ON p.anon_name = n.anon_name GROUP BY n.anon_name"
    )


def _recall(where: str = "true") -> str:
    return f"SELECT n.anon_name, round(coalesce(avg(is_masked::INT), 0), 6) AS recall FROM names n LEFT JOIN (SELECT * FROM asked WHERE {where}) a ON a.anon_name = n.anon_name GROUP BY n.anon_name"


_ENTROPY = "(SELECT -sum(n / t * ln(n / t)) FROM (SELECT sum(n) AS n, (SELECT sum(n) FROM cells) AS t FROM cells GROUP BY {0}))"
_MASKED_TEXT = "list_reduce(list_prepend({'s': 0, 'e': 0, 'r': text}, list_reverse(ms)), lambda acc, m: {'s': 0, 'e': 0, 'r': substr(acc.r, 1, m.s) || m.r || substr(acc.r, m.e + 1)}).r"
_BAG = "list_transform(range(16), lambda k: len(list_filter(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: (ord(w) * 31 + length(w) * 7) % 16 = k))::DOUBLE)"
_MARKS = T.marks_pattern()
_TPI = "SELECT anon_name, round(avg(CASE WHEN total <> 0 THEN (total - ic) / total ELSE 'nan'::DOUBLE END), 6) AS tpi FROM kept GROUP BY anon_name"
_UNIFORM = "SELECT anon_name, round(avg((n_terms - n)::DOUBLE / n_terms), 6) AS tpi FROM kept GROUP BY anon_name"
_LONG = (
    f"SELECT 'Precision' AS metric_name, 'Precision' AS metric_key, anon_name, precision AS value FROM ({_precision('mask_words', '1.0')}) "
    f"UNION ALL SELECT 'Recall', 'Recall', anon_name, recall FROM ({_recall()}) UNION ALL SELECT 'TPI_uniform', 'TPI', anon_name, tpi FROM ({_UNIFORM})"
)
_SQL = {
    "word_tokens": "SELECT doc_id, w_ord, s AS \"start\", e AS \"end\" FROM words",
    "mask_islands": "SELECT anon_name, doc_id, s AS \"start\", e AS \"end\" FROM islands",
    "mask_islands_parity": "SELECT anon_name, doc_id, s AS \"start\", e AS \"end\" FROM inner_islands",
    "masked_offsets_len": "SELECT anon_name, doc_id, CAST(sum(e - s) AS BIGINT) AS n_masked FROM islands GROUP BY ALL",
    "apply_masking": f"SELECT anon_name, doc_id, md5(t) AS md5, length(t) AS n_chars FROM (SELECT a.anon_name, a.doc_id, CASE WHEN ms IS NULL THEN text ELSE {_MASKED_TEXT} END AS t FROM anon_docs a JOIN docs d ON a.doc_id = d.doc_id LEFT JOIN listed l ON l.anon_name = a.anon_name AND l.doc_id = a.doc_id)",
    "remove_mask_marks": f"SELECT doc_id, md5(t) AS md5, length(t) AS n_chars FROM (SELECT doc_id, regexp_replace(regexp_replace(t, '{_MARKS}', '', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT d.doc_id, CASE WHEN ms IS NULL THEN text ELSE {_MASKED_TEXT} END AS t FROM docs d LEFT JOIN listed l ON l.anon_name = 'Repl' AND l.doc_id = d.doc_id))",
    "gold_entities": "SELECT e.*, l.mentions_md5 FROM entities e JOIN (SELECT doc_id, annotator, entity_id, md5(string_agg(s || '-' || e || '-' || CAST(identifier_type <> 'NO_MASK' AS INT), ',' ORDER BY mention_ord)) AS mentions_md5 FROM mentions GROUP BY ALL) l "
    "ON l.doc_id = e.doc_id AND l.annotator = e.annotator AND l.entity_id = e.entity_id",
    "entities_to_mask": "SELECT doc_id, annotator, entity_id FROM entities WHERE need_masking AND is_direct",
    "annotators_per_doc": "SELECT * FROM annotators",
    "covering_annotators": f"SELECT x.anon_name, x.doc_id, x.mask_ord, x.s AS \"start\", x.e AS \"end\", {_COVER} AS n_covering FROM maskings x",
    "mention_masked": "SELECT anon_name, doc_id, annotator, mention_ord, is_masked FROM judged",
    "entity_masked": "SELECT anon_name, doc_id, annotator, entity_id, bool_and(is_masked OR identifier_type = 'NO_MASK') AS is_masked FROM judged GROUP BY ALL",
    "precision_token": _precision("mask_words", "1.0"),
    "precision_mention": _precision("maskings", "1.0"),
    "precision_ic": _precision("mask_words", "(SELECT ic FROM ics WHERE ics.word = x.word)"),
    "recall_token": _recall(),
    "recall_mention": _recall(),
    "recall_direct_only": _recall("is_direct"),
    "recall_quasi_only": _recall("NOT is_direct"),
    "recall_per_type": "SELECT anon_name, type AS entity_type, round(avg(is_masked::INT), 6) AS recall FROM asked GROUP BY ALL",
    "terms": "SELECT doc_id, term_ord, s AS \"start\", e AS \"end\" FROM terms",
    "term_masked_endpoint": "SELECT anon_name, doc_id, term_ord FROM hit_terms",
    "term_masked_true": "SELECT DISTINCT i.anon_name, t.doc_id, t.term_ord FROM terms t JOIN islands i ON t.doc_id = i.doc_id AND t.s < i.e AND i.s < t.e",
    "term_ic": "SELECT doc_id, term_ord, round(ic, 6) AS ic FROM term_ics",
    "term_rounds": "SELECT doc_id, term_ord % 6 AS round, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts FROM terms GROUP BY ALL",
    "subwords_of_terms": "SELECT doc_id, term_ord, count(*) AS n, min(k) AS \"first\", max(k) AS \"last\" FROM term_subs GROUP BY ALL",
    "masked_segments": "SELECT doc_id, rnd AS round, seg AS segment, n, n_masked, CAST(seen AS BIGINT) AS seen FROM seg_rounds",
    "masked_lm_ic": "SELECT doc_id, term_ord, round(max(ln(z) - ((id * 5 + b.base) % 11) / 4.0::DOUBLE), 6) AS ic FROM sub_bases b JOIN denominators d ON b.base = d.base GROUP BY ALL",
    "terms_of": "SELECT doc_id, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM parsed_terms GROUP BY doc_id",
    "noun_chunks": "SELECT c.doc_id, x.s AS start, y.e AS \"end\", CAST(c.z - c.a + 1 AS BIGINT) AS n FROM chunk_spans c JOIN terms x ON x.doc_id = c.doc_id AND x.term_ord = c.a JOIN terms y ON y.doc_id = c.doc_id AND y.term_ord = c.z",
    "terms_with_chunks": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS term_ord, s AS start, e AS \"end\" FROM own_spans",
    "tpi_with_chunks": "SELECT a.anon_name, round(avg((t.n - coalesce(h.n, 0)) / t.n::DOUBLE), 6) AS tpi FROM anon_docs a LEFT JOIN (SELECT doc_id, count(*) AS n FROM own_spans GROUP BY doc_id) t ON t.doc_id = a.doc_id LEFT JOIN (SELECT anon_name, doc_id, count(*) AS n FROM own_hits GROUP BY ALL) h ON h.anon_name = a.anon_name AND h.doc_id = a.doc_id GROUP BY a.anon_name",
    "tagger_paths": "SELECT doc_id, sent_id, n AS n_tokens, md5(list_max(list_transform(range(5), lambda i: {'s': best[i + 1].s, 'i': -i, 'p': best[i + 1].p})).p) AS path_md5 FROM walked",
    "backoff_ic": "SELECT t.doc_id, t.term_ord, round(-ln(min((CASE ol WHEN 0 THEN p0.p WHEN 1 THEN a.p ELSE b.p END + CASE o_r WHEN 0 THEN p0.p WHEN 1 THEN c.p ELSE d.p END) / 2)), 6) AS ic FROM seen t JOIN p0 ON p0.w = t.w JOIN pl1 a ON a.g = l1 || ' ' || t.w JOIN pl2 b ON b.g = l2 || ' ' || l1 || ' ' || t.w "
    "JOIN pr1 c ON c.g = r1 || ' ' || t.w JOIN pr2 d ON d.g = r2 || ' ' || r1 || ' ' || t.w GROUP BY t.doc_id, t.term_ord",
    "terms_in_sentences": "SELECT t.doc_id, n.sent_id, count(*) AS n FROM terms t JOIN sentence_spans n ON t.doc_id = n.doc_id AND n.s <= t.s AND t.e <= n.e GROUP BY ALL",
    "entity_replacement": "SELECT d.doc_id, md5(coalesce(t, '')) AS md5, length(coalesce(t, '')) AS n_chars FROM docs d LEFT JOIN typed USING (doc_id)",
    "attack_texts": "SELECT source, x.doc_id, coalesce(l.label, -1) AS label, md5(t) AS md5 FROM (SELECT '__background__' AS source, b.doc_id, t FROM background b JOIN typed ON typed.doc_id = CAST(CAST(b.doc_id AS BIGINT) % 1000000 AS VARCHAR) "
    f"UNION ALL SELECT a.anon_name, a.doc_id, CASE WHEN ms IS NULL THEN text ELSE {_MASKED_TEXT} END FROM anon_docs a JOIN docs d ON a.doc_id = d.doc_id LEFT JOIN listed l ON l.anon_name = a.anon_name AND l.doc_id = a.doc_id) x "
    "LEFT JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS label FROM (SELECT DISTINCT doc_id FROM background WHERE text <> '')) l ON x.doc_id = l.doc_id WHERE t <> ''",
    "silhouette": "SELECT round(avg(CASE WHEN own = 1 THEN 0 ELSE (other - mine) / greatest(other, mine) END), 6) AS silhouette FROM unit_away",
    "tpi_uniform": _UNIFORM,
    "tpi_ic": _TPI,
    "ic_multiplier": "SELECT anon_name, doc_id, round(CASE WHEN n_terms = n OR total - ic = 0 THEN 0 ELSE (CASE WHEN n = 0 THEN 0 ELSE ic / n END) / ((total - ic) / (n_terms - n)) END, 6) AS ic_multiplier FROM kept",
    "replacement_terms": "SELECT m.anon_name, m.doc_id, m.mask_ord, t.term_ord, m.replacement FROM terms t JOIN maskings m ON t.doc_id = m.doc_id AND m.replacement IS NOT NULL AND ((t.s <= m.s AND m.s < t.e) OR (t.s < m.e AND m.e <= t.e))",
    "cosine_similarity": "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "tps": "SELECT a.anon_name, round(avg((n_terms - coalesce(loss, 0)) / n_terms), 6) AS tps FROM anon_docs a JOIN totals t ON a.doc_id = t.doc_id LEFT JOIN (SELECT anon_name, doc_id, sum(1 - sim) AS loss FROM ("
    "SELECT h.anon_name, h.doc_id, h.term_ord, coalesce(list_dot_product(va, vb) / nullif(sqrt(list_dot_product(va, va)) * sqrt(list_dot_product(vb, vb)), 0), 0) AS sim FROM hit_terms h LEFT JOIN ("
    f"SELECT m.anon_name, m.doc_id, t.term_ord, {_BAG.format('t.run')} AS va, {_BAG.format('m.replacement')} AS vb FROM maskings m JOIN terms t ON t.doc_id = m.doc_id AND t.s = m.s WHERE m.replacement IS NOT NULL"
    ") r ON r.anon_name = h.anon_name AND r.doc_id = h.doc_id AND r.term_ord = h.term_ord "
    f"UNION ALL SELECT m.anon_name, m.doc_id, t.term_ord, list_dot_product({_BAG.format('t.run')}, {_BAG.format('m.replacement')}) / (sqrt(list_dot_product({_BAG.format('t.run')}, {_BAG.format('t.run')})) * sqrt(list_dot_product({_BAG.format('m.replacement')}, {_BAG.format('m.replacement')}))) FROM maskings m JOIN terms t ON t.doc_id = m.doc_id AND t.s = m.s JOIN docs d ON d.doc_id = m.doc_id WHERE m.replacement IS NOT NULL AND m.e >= d.n_chars"
    ") GROUP BY ALL) l ON l.anon_name = a.anon_name AND l.doc_id = a.doc_id GROUP BY a.anon_name",
    "nmi_contingency": f"SELECT round((SELECT sum(c.n / t * ln(c.n * t / (x.n * y.n))) FROM cells c JOIN (SELECT a, sum(n) AS n FROM cells GROUP BY a) x ON c.a = x.a JOIN (SELECT b, sum(n) AS n FROM cells GROUP BY b) y ON c.b = y.b, (SELECT sum(n) AS t FROM cells)) / (({_ENTROPY.format('a')} + {_ENTROPY.format('b')}) / 2), 6) AS nmi",
    "nearest_centroid_labels": "SELECT vec_id, CAST(b AS BIGINT) AS label FROM nearest",
    "silhouettes_of_centres": "SELECT CAST(k AS BIGINT) AS k, CAST(r AS BIGINT) AS run, round(avg(CASE WHEN size = 1 THEN 0 WHEN mine < other THEN 1 - mine / other WHEN mine > other THEN other / mine - 1 ELSE 0 END), 6) AS silhouette FROM lab_each GROUP BY ALL",
    "missing_docs": "SELECT anon_name, doc_id FROM anon_docs WHERE CAST(doc_id AS BIGINT) % 7 = anon_ord",
    "extra_docs": "SELECT 'BK' AS anon_name, doc_id FROM background WHERE doc_id NOT IN (SELECT doc_id FROM docs)",
    "gold_ratio": "SELECT round((SELECT count(DISTINCT doc_id) FROM mentions WHERE annotator = 'a2') / (SELECT count(*) FROM docs)::DOUBLE, 6) AS ratio",
    "validation_violations": "SELECT 'document_id_repeated' AS rule, 0::BIGINT AS n UNION ALL SELECT 'entity_of_two_annotators', 0 UNION ALL SELECT 'identifier_type_unknown', (SELECT count(*) FROM mentions WHERE mention_ord % 8 = 7) "
    "UNION ALL SELECT 'mention_without_document', (SELECT count(*) FROM mentions WHERE CAST(doc_id AS BIGINT) % 9 = 0) UNION ALL SELECT 'offsets_out_of_text', (SELECT count(*) FROM mentions WHERE mention_ord % 10 = 9) UNION ALL SELECT 'text_missing', 0",
    "bk_full_outer": "SELECT coalesce(d.doc_id, b.doc_id) AS doc_id, md5(d.text) AS text_md5, md5(b.text) AS background_md5 FROM (SELECT * FROM docs WHERE CAST(doc_id AS BIGINT) % 4 <> 0) d FULL JOIN background b ON d.doc_id = b.doc_id",
    "individuals_report": "SELECT 'all' AS kind, count(*) AS n FROM (SELECT doc_id FROM background UNION SELECT doc_id FROM docs) UNION ALL SELECT 'train', count(DISTINCT doc_id) FROM background UNION ALL SELECT 'evaluation', count(DISTINCT doc_id) FROM docs UNION ALL SELECT 'train without evaluation', count(*) FROM (SELECT doc_id FROM background EXCEPT SELECT doc_id FROM docs) UNION ALL SELECT 'evaluation without train', count(*) FROM (SELECT doc_id FROM docs EXCEPT SELECT doc_id FROM background)",
    # no look-behind: a mark goes after each end of a sentence, and texts are cut at the marks
    "sentence_split": "SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS md5 FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), chr(1)), '([.!?])[ \\t\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)), '[ \\t\\r\\f\\v]+', ' ', 'g')), lambda x: x <> '') AS s FROM docs)",
    "individual_labels": "SELECT doc_id, dense_rank() OVER (ORDER BY doc_id) - 1 AS label FROM (SELECT doc_id FROM docs UNION SELECT doc_id FROM background)",
    "reid_max_risk": "SELECT count(*) AS n_individuals, count(*) FILTER (WHERE CAST(doc_id AS BIGINT) % 10 = 0) AS n_unknown, round((1 - count(*) FILTER (WHERE CAST(doc_id AS BIGINT) % 10 = 0) / count(*)) * 100, 6) AS max_risk FROM docs",
    "curation": f"SELECT doc_id, md5(t) AS md5, length(t) AS n_chars FROM (SELECT doc_id, coalesce(array_to_string(list_transform(list_transform(list_filter(t, lambda x: x NOT IN ({_LIST(parser.STOP_WORDS)})), lambda x: regexp_replace(lower(x), '[^ \\nA-Za-z0-9À-ÖØ-öø-ÿЀ-ӿ./]+', '', 'g')), lambda x: CASE WHEN x = '.' THEN x ELSE ' ' || x END), ''), '') AS t FROM tokens)",
    "sliding_windows": "SELECT doc_id, window_ord, CAST(len(w) AS BIGINT) AS n, md5(coalesce(array_to_string(w, ' '), '')) AS md5 FROM windows",
    "logit_sum_accuracy": "SELECT source, round(avg((c = label)::INT), 6) AS accuracy FROM (SELECT 's' || CAST(CAST(doc_id AS BIGINT) % 2 AS VARCHAR) AS source, doc_id, CAST(doc_id AS BIGINT) % 4 AS label, c, sum((window_ord * 7 + c * 5 + CAST(doc_id AS BIGINT)) % 11) AS s FROM windows, (SELECT unnest(range(4)) AS c) GROUP BY doc_id, c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, c) = 1) GROUP BY source",
    "results_long": _LONG,
    "results_pivot": "SELECT metric_name, " + ", ".join(f"max(value) FILTER (WHERE anon_name = '{n}') AS \"{n}\"" for n in ("Clear", "Gold", "Sparse", "Wide", "Repl", "Tail", "Overlap")) + f" FROM ({_LONG}) GROUP BY metric_name",
}
ORACLE_SQL = {k: _with(v) for k, v in _SQL.items()}
