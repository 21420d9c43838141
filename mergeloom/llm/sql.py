"""SQL twins of the training-data queries, written apart from the operators."""

from __future__ import annotations

#: Sources once, with the train part of their contribution.
SOURCES_ONCE = """src AS (
  SELECT source_id, any_value(corpus_id) AS corpus_id, any_value(name) AS name, any_value(author) AS author, any_value(entity_id) AS entity_id,
         any_value(lower(trim(category))) AS ckey, any_value(coalesce(contribution[1], 0)) AS train
  FROM sources GROUP BY source_id)"""

P1_BASE = f"""WITH {SOURCES_ONCE},
have AS (SELECT corpus_id, ckey, sum(train)::BIGINT AS available_bytes FROM src GROUP BY ALL),
t0 AS (
  SELECT m.mix_id, m.category, m.corpus_id, m.weight AS w, m.total_bytes, sum(m.weight) OVER (PARTITION BY m.mix_id) AS all_w, m.max_repeats, coalesce(h.available_bytes, 0) AS available_bytes
  FROM mix_targets m LEFT JOIN have h ON h.corpus_id = m.corpus_id AND h.ckey = lower(trim(m.category))),
t1 AS (SELECT *, available_bytes * max_repeats AS capacity_bytes, w / all_w AS target_share, w / all_w * total_bytes AS target_bytes, greatest(1, ceil(total_bytes / 1000))::BIGINT AS block_bytes FROM t0),
t AS (SELECT *, ceil(total_bytes / block_bytes)::BIGINT AS n_blocks, ceil(capacity_bytes / block_bytes)::BIGINT AS capacity_blocks FROM t1),
seats AS (SELECT mix_id, category, n_blocks, capacity_blocks, k, w / (2 * k + 1) AS quotient FROM (SELECT *, unnest(range(n_blocks)) AS k FROM t)),
fair AS (SELECT mix_id, category, count(*) AS fair_blocks FROM (SELECT *, row_number() OVER (PARTITION BY mix_id ORDER BY quotient DESC, category, k) AS r FROM seats) WHERE r <= n_blocks GROUP BY ALL),
got AS (SELECT mix_id, category, count(*) AS blocks FROM (SELECT *, row_number() OVER (PARTITION BY mix_id ORDER BY quotient DESC, category, k) AS r FROM seats WHERE k < capacity_blocks) WHERE r <= n_blocks GROUP BY ALL),
given AS (SELECT t.*, coalesce(fair_blocks, 0) AS fair_blocks, coalesce(blocks, 0) AS blocks, least(coalesce(blocks, 0) * block_bytes, capacity_bytes)::BIGINT AS given_bytes FROM t LEFT JOIN fair USING (mix_id, category) LEFT JOIN got USING (mix_id, category))
"""

SPLIT = "CASE WHEN lower(trim(proposed)) = 'val' THEN 'validation' WHEN lower(trim(proposed)) <> '' THEN lower(trim(proposed)) END"
NKEY = r"regexp_replace(replace(lower(trim({0})), '\', '/'), '^(\./)+', '')"

#: Tokens by rank passes on strings of one character per symbol (id + 256).
COUNTED = """ms AS (SELECT list(chr(left_id + 256) || chr(right_id + 256) || chr(result_id + 256) ORDER BY merge_rank) AS m FROM merges),
hexed AS (SELECT doc_id, corpus_id, source, lang, domain, hex(encode(coalesce(text, ''))) AS h FROM documents),
counted AS (
  SELECT DISTINCT doc_id, corpus_id, source, lang, domain,
    length(list_reduce(m, lambda acc, x: replace(acc, x[1:2], x[3]), array_to_string(list_transform(range(1, length(h), 2), lambda i: chr(256 + ('0x' || h[i:i + 1])::INT)), '')))::BIGINT AS tokens
  FROM hexed, ms)"""

P5 = f"""WITH {COUNTED},
tot AS (SELECT corpus_id, source, lang, domain, count(*) AS documents, sum(tokens)::BIGINT AS tokens FROM counted GROUP BY ALL),
said AS (SELECT DISTINCT metric_id, corpus_id, source, lang, domain, tokens AS stated_tokens FROM domain_metrics),
budget AS (
  SELECT s.metric_id, coalesce(t.corpus_id, s.corpus_id) AS corpus_id, coalesce(t.source, s.source) AS source, coalesce(t.lang, s.lang) AS lang, coalesce(t.domain, s.domain) AS domain,
    s.stated_tokens, coalesce(t.documents, 0) AS documents, coalesce(t.tokens, 0) AS tokens, coalesce(abs(s.stated_tokens - coalesce(t.tokens, 0)) * 10 > coalesce(t.tokens, 0), false) AS off
  FROM tot t FULL JOIN said s ON t.corpus_id IS NOT DISTINCT FROM s.corpus_id AND t.source IS NOT DISTINCT FROM s.source AND t.lang IS NOT DISTINCT FROM s.lang AND t.domain IS NOT DISTINCT FROM s.domain)
"""

P3 = """WITH s AS (SELECT seq_id, any_value(tokens) AS tokens FROM sequences WHERE tokens IS NOT NULL GROUP BY seq_id),
p AS (SELECT seq_id, pack_id, any_value(tokens) AS tokens FROM pack_stats WHERE tokens IS NOT NULL GROUP BY seq_id, pack_id),
terms AS (
  SELECT 'sequences.tokens' AS field, seq_id::VARCHAR AS rec, unnest(tokens)::BIGINT AS val FROM s
  UNION ALL SELECT 'pack_stats.tokens', seq_id || ' ' || pack_id, tokens FROM p),
n AS (SELECT 'sequences.tokens' AS field, count(*) AS all_records FROM s UNION ALL SELECT 'pack_stats.tokens', count(*) FROM p),
freq AS (SELECT field, val, count(*) AS occurrences, count(DISTINCT rec) AS records FROM terms WHERE val IS NOT NULL GROUP BY ALL),
marked AS (SELECT field, val, occurrences, records, all_records, CASE WHEN records * 1000 < 4 * all_records THEN 'rare' WHEN records * 100 > 28 * all_records THEN 'common' END AS mark FROM freq JOIN n USING (field))
"""

P4_FOUND = """WITH r AS (SELECT DISTINCT record_id, run_id, tokenizer, rec_date, rec_len FROM record_lengths WHERE rec_len >= 1),
o AS (
  SELECT run_id, tokenizer, rec_date::DATE AS rec_date, rec_len, row_number() OVER (PARTITION BY run_id, tokenizer, rec_date ORDER BY rec_len) AS i, count(*) OVER (PARTITION BY run_id, tokenizer, rec_date) AS n FROM r
  UNION ALL
  SELECT run_id, tokenizer, NULL, rec_len, row_number() OVER (PARTITION BY run_id, tokenizer ORDER BY rec_len), count(*) OVER (PARTITION BY run_id, tokenizer) FROM r),
q AS (SELECT run_id, tokenizer, rec_date, max(CASE WHEN i = (n + 1) // 2 THEN rec_len END) AS med, max(CASE WHEN i = (95 * n + 99) // 100 THEN rec_len END) AS q95 FROM o GROUP BY ALL)
SELECT DISTINCT summary_id FROM sequence_lengths s JOIN q ON s.run_id = q.run_id AND s.tokenizer = q.tokenizer AND s.rec_date::DATE IS NOT DISTINCT FROM q.rec_date
WHERE s.median IS NOT NULL AND (abs(s.median - med) * 20 > med OR coalesce(abs(s.p95 - q95) * 20 > q95, false))"""

P6 = rf"""WITH u AS (
  SELECT unit_id, any_value(corpus_id) AS corpus_id, any_value(source) AS source, any_value({SPLIT}) AS split, any_value(body) AS body FROM units WHERE body IS NOT NULL GROUP BY unit_id),
k AS (SELECT * FROM u WHERE split IN ('train', 'validation', 'test')),
w AS (SELECT unit_id, corpus_id, split = 'train' AS train, regexp_extract_all(lower(upper(body)), '[\p{{L}}\p{{N}}]+') AS ws FROM k),
g AS (SELECT DISTINCT unit_id, corpus_id, train, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM w)),
n AS (SELECT unit_id, count(*) AS n FROM g GROUP BY unit_id),
c AS (SELECT a.unit_id AS ua, b.unit_id AS ub, count(*) AS common FROM g a JOIN g b ON a.corpus_id = b.corpus_id AND a.gram = b.gram AND a.train AND NOT b.train GROUP BY ALL),
near AS (SELECT ua, ub FROM c JOIN n na ON na.unit_id = ua JOIN n nb ON nb.unit_id = ub WHERE common * 100 >= 60 * (na.n + nb.n - common)),
same AS (SELECT a.unit_id AS ua, b.unit_id AS ub FROM k a JOIN k b ON a.corpus_id = b.corpus_id AND a.body = b.body AND a.split = 'train' AND b.split <> 'train'),
found AS (SELECT DISTINCT least(ua, ub) AS unit_id_a, greatest(ua, ub) AS unit_id_b FROM (FROM near UNION ALL FROM same))
"""

# Characters that look like the one below them, apart from full-width forms, which follow by rule.
LOOKS = "\u00a0\u2007\u2009\u202f\u3000\u2011ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοЅІАВЕКМНОРСТХЈаеорсухѕіјόΌёЁїЇ"
LIKE = "     -ABEZHIKMNOPTYXoSIABEKMHOPCTXJaeopcyxsijóÓëËïÏ"


def look(text: str) -> str:
    """One form of a text, for the characters that occur in the given tables."""
    wide = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F))
    flat = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
    emoji = r"[\x{1F000}-\x{1FFFF}]"
    joined = f"regexp_replace({text}, '({emoji})\\x{{200D}}({emoji})', '\\1' || chr(57344) || '\\2', 'g')"
    seen = f"regexp_replace({joined}, '[\\x{{AD}}\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
    return f"nfc_normalize(translate(replace(replace({seen}, chr(64257), 'fi'), chr(64258), 'fl'), '{LOOKS}{wide}', '{LIKE}{flat}'))"


GRAMS = "SELECT {0} AS id, array_to_string(ws[i:i + 11], ' ') AS g FROM (SELECT {0}, ws, unnest(range(1, len(ws) - 10)) AS i FROM (SELECT {0}, regexp_extract_all(lower({1}), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {2}))"

#: 12-word passages of documents and items at the same words: (doc_id, item_id, i, j), and how many follow each other without a gap.
MATCHED = rf"""dt AS (SELECT DISTINCT doc_id, regexp_extract_all(lower({look('text')}), '[\p{{L}}\p{{N}}]+') AS ws FROM documents WHERE text IS NOT NULL),
it AS (SELECT DISTINCT item_id, regexp_extract_all(lower({look('text')}), '[\p{{L}}\p{{N}}]+') AS ws FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, i, array_to_string(ws[i:i + 11], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM dt)),
ig AS (SELECT item_id, j, array_to_string(ws[j:j + 11], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS j FROM it)),
m AS (SELECT doc_id, item_id, i, j FROM dg JOIN ig USING (g)),
runs AS (SELECT doc_id, item_id, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS isle FROM m) GROUP BY doc_id, item_id, i - j, isle),
dw AS (SELECT doc_id, len(ws) AS words FROM dt)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_BASE + "SELECT mix_id, category FROM t WHERE capacity_bytes < target_bytes",
        "p1_shares": P1_BASE + """SELECT mix_id, category, corpus_id, round(target_share, 9) AS target_share, round(target_bytes, 3) AS target_bytes, available_bytes, capacity_bytes, block_bytes, fair_blocks, blocks, given_bytes,
  CASE WHEN available_bytes > 0 THEN given_bytes / available_bytes END AS repeats, given_bytes / sum(given_bytes) OVER (PARTITION BY mix_id) AS reached_share, capacity_bytes < target_bytes AS short FROM given""",
        "p2_found": rf"""WITH RECURSIVE {SOURCES_ONCE},
key AS (
  SELECT source_id, corpus_id, {NKEY.format('name')} AS nkey, nullif(array_to_string(list_sort(regexp_extract_all(lower(nfc_normalize(author)), '[\p{{L}}\p{{N}}]+')), ' '), '') AS akey, entity_id FROM src),
key2 AS (SELECT source_id, corpus_id, nkey, CASE WHEN akey NOT IN ('unknown', 'anonymous', 'a n') THEN akey END AS akey, entity_id FROM key),
link AS (SELECT source_id, corpus_id, 'n' || nkey AS k FROM key2 WHERE nkey IS NOT NULL UNION SELECT source_id, corpus_id, 'a' || akey FROM key2 WHERE akey IS NOT NULL UNION SELECT source_id, corpus_id, 'e' || entity_id FROM key2 WHERE entity_id IS NOT NULL),
edge AS (SELECT DISTINCT a.source_id AS a, b.source_id AS b FROM link a JOIN link b ON a.corpus_id = b.corpus_id AND a.k = b.k),
reach AS (SELECT source_id AS a, source_id AS b FROM src UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
grp AS (SELECT a AS source_id, min(b) AS group_id FROM reach GROUP BY a),
seen AS (SELECT DISTINCT corpus_id, {NKEY.format('source')} AS nkey, {SPLIT} AS split FROM units),
apart AS (SELECT group_id FROM seen JOIN key2 USING (corpus_id, nkey) JOIN grp USING (source_id) WHERE split IS NOT NULL GROUP BY group_id HAVING count(DISTINCT split) > 1)
SELECT source_id FROM grp JOIN apart USING (group_id)""",
        "p3_found": P3 + "SELECT field, val, mark FROM marked WHERE mark IS NOT NULL",
        "p3_frequencies": P3 + "SELECT * FROM marked",
        "p4_found": P4_FOUND,
        "p5_tokens": f"WITH {COUNTED} SELECT * FROM counted",
        "p5_budget": P5 + "SELECT * FROM budget",
        "p5_found": P5 + "SELECT metric_id FROM budget WHERE off",
        "p6_found": P6 + "SELECT * FROM found",
        "p6_counts": P6 + "SELECT corpus_id, split, source, count(DISTINCT unit_id) AS units FROM k JOIN found ON unit_id IN (unit_id_a, unit_id_b) WHERE split <> 'train' GROUP BY ALL",
        "p8_found": f"WITH d AS ({GRAMS.format('doc_id', look('text'), 'documents')}), e AS ({GRAMS.format('item_id', look('text'), 'eval_items')}) SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM d JOIN e USING (g)",
        "p9_found": f"WITH d AS (SELECT DISTINCT doc_id, text, {look('text')} AS c FROM documents WHERE text IS NOT NULL) SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b USING (c) WHERE a.text <> b.text AND a.doc_id < b.doc_id",
        "p7_found": f"WITH {COUNTED} SELECT context_name, doc_id FROM (SELECT DISTINCT doc_id, tokens FROM counted), context_sizes WHERE tokens > capacity_tokens",
        "p1_block_sums": P1_BASE + "SELECT mix_id, category, blocks AS copies, true AS even FROM given WHERE blocks > 0",
        "p2_balance": "SELECT corpus_id, count(*) AS units, 0::BIGINT AS parted, true AS near FROM (SELECT unit_id, any_value(corpus_id) AS corpus_id FROM units GROUP BY unit_id) GROUP BY corpus_id",
        "p4_bounds": """WITH r AS (SELECT DISTINCT record_id, run_id, tokenizer, rec_date, rec_len FROM record_lengths WHERE rec_len >= 1)
SELECT run_id, tokenizer, rec_date::DATE::VARCHAR AS rec_date, false AS whole, count(*) AS n, true AS near FROM r GROUP BY ALL UNION ALL SELECT run_id, tokenizer, NULL, true, count(*), true FROM r GROUP BY ALL""",
        "p5_longest": r"""WITH ids AS (SELECT range AS id FROM range((SELECT 256 + count(*) FROM merges))),
back AS (SELECT list(chr(result_id + 256) || chr(left_id + 256) || chr(right_id + 256) ORDER BY merge_rank DESC) AS m FROM merges),
spelled AS (SELECT DISTINCT list_reduce(m, lambda acc, x: replace(acc, x[1], x[2:3]), chr((id + 256)::INT)) AS e FROM ids, back),
pat AS (SELECT string_agg(e, '|' ORDER BY length(e) DESC, e) AS p FROM spelled WHERE e IS NOT NULL),
sym AS (SELECT doc_id, array_to_string(list_transform(range(1, length(h), 2), lambda i: chr(256 + ('0x' || h[i:i + 1])::INT)), '') AS s FROM (SELECT DISTINCT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents))
SELECT doc_id, coalesce(len(regexp_extract_all(s, p)), 0)::BIGINT AS tokens FROM sym, pat""",
        "p6_words": rf"""WITH u AS (SELECT unit_id, any_value(corpus_id) AS corpus_id, any_value({SPLIT}) AS split, any_value(body) AS body FROM units WHERE body IS NOT NULL GROUP BY unit_id),
k AS (SELECT * FROM u WHERE split IN ('train', 'validation', 'test'))
SELECT unit_id, len(regexp_extract_all(lower(upper(body)), '[\p{{L}}\p{{N}}]+'))::BIGINT AS n_words, EXISTS (SELECT 1 FROM k t WHERE t.split = 'train' AND t.corpus_id = k.corpus_id AND t.body = k.body) AS copied, true AS sane FROM k WHERE split <> 'train'""",
        "p7_check": f"WITH {COUNTED}, one AS (SELECT DISTINCT doc_id, tokens FROM counted) SELECT context_name, count(*) AS documents, sum(tokens)::BIGINT AS tokens, sum(greatest(1, ceil(tokens / capacity_tokens)))::BIGINT AS pieces, 0::BIGINT AS misplaced, 0::BIGINT AS overfull, true AS tight FROM one, context_sizes GROUP BY context_name",
        "p8_leaks": f"WITH {MATCHED} SELECT doc_id, item_id, (max(n) + 11)::INT AS longest_words FROM runs GROUP BY ALL",
        "p8_covered": f"WITH {MATCHED}, w AS (SELECT DISTINCT doc_id, unnest(range(i, i + 12)) AS k FROM m), c AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id) SELECT doc_id, n AS removed_words, round(n / words, 9) AS removed_share, n / words > 0.5 AS dropped FROM c JOIN dw USING (doc_id)",
        "p9_members": f"WITH d AS (SELECT DISTINCT doc_id, text, {look('text')} AS c FROM documents WHERE text IS NOT NULL), g AS (SELECT c, count(DISTINCT text) AS spellings, count(*) AS documents FROM d GROUP BY c) SELECT doc_id, spellings, documents FROM d JOIN g USING (c) WHERE spellings > 1",
    }
