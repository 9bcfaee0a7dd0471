"""SQL for the results of operators that SQL can express."""

from __future__ import annotations

from palisade.llm import archive, chat, decontaminate, merkle, mixing, resample, sharding

UPPER, LOWER = decontaminate.UPPER, decontaminate.LOWER

OP4 = f"SELECT m.*, strlen(d.text)::BIGINT AS n_bytes FROM ({mixing.oracle()}) m JOIN documents d USING (doc_id)"

OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
owners AS (SELECT html, max(page_id) AS owner FROM p WHERE n >= {archive.LEAST_REVISIT} GROUP BY html)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN owner IS NULL OR owner = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN owner <> p.page_id THEN owner END AS refers_to
FROM p LEFT JOIN owners o ON p.html = o.html"""

_MARK = r"^[ \t]*((?:>[ \t]?)+)"
_QUOTED_VIEW = """SELECT conv_id, turn, role, coalesce(CASE WHEN turn % 3 = 2 THEN '> > ' || replace(lag(text, 2) OVER o, chr(10), chr(10) || '> > ') || chr(10) END, '')
  || coalesce('> ' || replace(lag(text, 1) OVER o, chr(10), chr(10) || '> ') || chr(10), '') || coalesce(text, '') AS text FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)"""


def quotations(relation: str) -> str:
    return rf"""
WITH RECURSIVE rel AS ({relation}),
texts AS (SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM rel),
messages AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT conv_id, turn, lines FROM texts WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
raw AS (SELECT id, conv_id, turn, k, lines[k] AS line, regexp_extract(lines[k], '{_MARK}', 1) AS mark FROM messages, range(1, len(lines) + 1) t(k)),
leveled AS (
  SELECT id, conv_id, turn, k, length(mark) - length(replace(mark, '>', '')) AS level,
    list_filter(regexp_split_to_array(translate(CASE WHEN mark <> '' THEN regexp_replace(line, '{_MARK}', '') ELSE line END, '{UPPER}', '{LOWER}'), '[ \t\r]+'), lambda x: x <> '') AS w FROM raw),
steps AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY id ORDER BY k) THEN 0 ELSE 1 END AS step FROM leveled),
placed AS (SELECT *, sum(step) OVER (PARTITION BY id ORDER BY k) AS p FROM steps),
passages AS (SELECT id, conv_id, turn, p, any_value(level) AS level, flatten(list(w ORDER BY k)) AS w FROM placed GROUP BY id, conv_id, turn, p),
windows AS (
  SELECT id, conv_id, turn, p, level, len(w) AS n, i, array_to_string(w[i:i + {chat.WINDOW - 1}], ' ') AS key FROM passages, range(1, greatest(len(w) - {chat.WINDOW}, 0) + 2) t(i) WHERE len(w) > 0),
own AS (
  SELECT conv_id, turn, key FROM windows WHERE level = 0
  UNION SELECT conv_id, turn, array_to_string(w, ' ') FROM placed WHERE level = 0 AND len(w) BETWEEN 1 AND {chat.WINDOW - 1}),
found AS (SELECT q.*, max(o.turn) AS source FROM windows q LEFT JOIN own o ON o.conv_id = q.conv_id AND o.key = q.key AND o.turn < q.turn WHERE q.level > 0 GROUP BY ALL),
votes AS (SELECT id, conv_id, turn, p, level, n, source, count(*) AS votes, sum(count(*)) OVER (PARTITION BY id, p) AS total FROM found GROUP BY id, conv_id, turn, p, level, n, source),
sources AS (SELECT id, conv_id, turn, p, level, n, arg_max(source, (votes, source)) AS source, max(votes) AS votes, any_value(total) AS total FROM votes WHERE source IS NOT NULL GROUP BY id, conv_id, turn, p, level, n),
matched AS (SELECT conv_id, turn, level, source, sum(n) AS matched FROM sources WHERE 2 * votes >= total GROUP BY ALL),
links AS (SELECT conv_id, turn, arg_max(source, (-level, matched, source)) AS reply_to FROM matched GROUP BY conv_id, turn),
places AS (
  SELECT conv_id, turn, reply_to AS up, 1::BIGINT AS depth FROM links
  UNION ALL
  SELECT p.conv_id, p.turn, l.reply_to, p.depth + 1 FROM places p JOIN links l ON l.conv_id = p.conv_id AND l.turn = p.up),
roots AS (SELECT conv_id, turn, arg_max(up, depth) AS thread_turn, max(depth) AS depth FROM places GROUP BY conv_id, turn),
bodies AS (
  SELECT conv_id, turn, role, len(list_filter(lines, lambda x: regexp_matches(x, '{_MARK}')))::BIGINT AS n_quoted,
    regexp_replace(array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, '{_MARK}')), chr(10)), '^(?:[ \t\r]*\n)+|(?:\n[ \t\r]*)+$', '', 'g') AS body FROM texts)
SELECT b.conv_id, b.turn, b.role, l.reply_to, coalesce(r.thread_turn, b.turn) AS thread_turn, coalesce(r.depth, 0) AS depth, b.n_quoted, b.body,
  '<|' || coalesce(b.role, '') || '|>' || chr(10) || b.body || chr(10) || '<|end|>' AS rendered
FROM bodies b LEFT JOIN links l ON l.conv_id = b.conv_id AND l.turn = b.turn LEFT JOIN roots r ON r.conv_id = b.conv_id AND r.turn = b.turn"""


OP7, QUOTED = quotations("SELECT * FROM conversations"), quotations(_QUOTED_VIEW)
BUILT = f"SELECT conv_id, thread_turn, count(*)::INT AS n_messages, string_agg(rendered, chr(10) ORDER BY depth, reply_to NULLS FIRST, turn, rendered) AS text FROM ({QUOTED}) GROUP BY conv_id, thread_turn"


def _words(name: str, key: str) -> str:
    return rf"SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {name}"


#: All item-sized windows of the documents that share a shingle with the item, compared as strings.
OP9 = f"""
WITH docs AS ({_words("documents", "doc_id")}),
items AS (SELECT item_id, w, len(w) AS n, least(len(w), {decontaminate.SHINGLE}) AS size FROM ({_words("benchmark", "item_id")}) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM items),
doc_sh AS (SELECT doc_id, len(w) AS words, size, i AS pos, array_to_string(w[i + 1:i + size], ' ') AS sh FROM docs, sizes, range(greatest(len(w) - size, 0) + 1) t(i) WHERE len(w) > 0),
item_sh AS (SELECT item_id, n, size, sh, count(*) AS b, sum(count(*)) OVER (PARTITION BY item_id) AS item_m FROM (
  SELECT item_id, n, size, array_to_string(w[i + 1:i + size], ' ') AS sh FROM items, range(n - size + 1) t(i)) GROUP BY item_id, n, size, sh),
pairs AS (SELECT DISTINCT doc_id, words, item_id, n, size FROM doc_sh JOIN item_sh USING (size, sh)),
windows AS (SELECT doc_id, item_id, n, size, s FROM pairs, range(greatest(words - n, 0) + 1) t(s)),
counts AS (SELECT w.doc_id, w.item_id, w.n, w.s, d.sh, count(*) AS a FROM windows w JOIN doc_sh d ON d.doc_id = w.doc_id AND d.size = w.size AND d.pos BETWEEN w.s AND w.s + w.n - w.size GROUP BY ALL),
totals AS (SELECT doc_id, item_id, s, sum(a) AS m FROM counts GROUP BY ALL),
shared AS (SELECT c.doc_id, c.item_id, c.n, c.s, sum(least(a, b)) AS shared, any_value(item_m) AS item_m FROM counts c JOIN item_sh i ON i.item_id = c.item_id AND i.sh = c.sh GROUP BY ALL),
alike AS (SELECT doc_id, item_id, n, s, shared / (m + item_m - shared) AS similarity FROM shared JOIN totals USING (doc_id, item_id, s))
SELECT doc_id, item_id, arg_max(s, (similarity, -s))::INT AS first_word, any_value(n)::INT AS n_words, max(similarity) AS similarity
FROM alike WHERE similarity >= {decontaminate.SIMILARITY} GROUP BY doc_id, item_id"""

ORACLES = {
    "op4_mixing": OP4,
    "op5_warc": OP5,
    "op7_quotations": OP7,
    "quoted_conversations": QUOTED,
    "built_conversations": BUILT,
    "op9_decontamination": OP9,
    "op11_merkle": merkle.oracle(),
    "op12_shards": sharding.oracle(),
    "op13_resample": resample.oracle(),
}
