"""SQL twins of the queries, for DuckDB, written apart from the operators."""

from __future__ import annotations

# Bytes of documents as hex, and as strings of one character per byte (code point 256 + byte), so that no character is NUL.
HEXED = "hexed AS (SELECT doc_id, text, source, domain, hex(encode(coalesce(text, ''))) AS h FROM documents)"
SYMBOLS = f"{HEXED}, sym AS (SELECT doc_id, text, domain, h, list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::INT) AS b, array_to_string(list_transform(range(1, length(h), 2), lambda i: chr(256 + ('0x' || h[i:i + 1])::INT)), '') AS s FROM hexed)"
MERGES = "ms AS (SELECT list(chr(left_id + 256) || chr(right_id + 256) || chr(result_id + 256) ORDER BY merge_rank) AS m FROM merges {0})"
FLAT = f"{SYMBOLS}, {MERGES.format('')}, flat AS (SELECT doc_id, h, list_reduce(m, lambda acc, x: replace(acc, x[1:2], x[3]), s) AS c FROM sym, ms)"
#: Spelling of every id, by undoing merges from the last to the first.
SPELLED = """ids AS (SELECT range AS id FROM range((SELECT 256 + count(*) FROM merges))),
back AS (SELECT list(chr(result_id + 256) || chr(left_id + 256) || chr(right_id + 256) ORDER BY merge_rank DESC) AS m FROM merges),
spelled AS (SELECT id, list_reduce(m, lambda acc, x: replace(acc, x[1], x[2:3]), chr((id + 256)::INT)) AS e FROM ids, back)"""
ROUTE = r"'[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]+|[^A-Za-z0-9\x{80}-\x{10FFFF}]+'"
SYM_TEXT, SYM_NUMBER = r"[\x{141}-\x{15A}\x{161}-\x{17A}\x{180}-\x{1FF}]", r"[\x{130}-\x{139}]"
SYM_OTHER = r"[\x{100}-\x{12F}\x{13A}-\x{140}\x{15B}-\x{160}\x{17B}-\x{17F}]"


def pack(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^[A-Za-z\\x{{80}}-\\x{{10FFFF}}]') THEN 0 WHEN regexp_matches({c}, '^[0-9]') THEN 1 ELSE 2 END"


def sym_pack(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '{SYM_TEXT}+') THEN 0 WHEN regexp_full_match({c}, '{SYM_NUMBER}+') THEN 1 WHEN regexp_full_match({c}, '{SYM_OTHER}+') THEN 2 END"


NAMES = "(VALUES (0, 'TEXT'), (1, 'NUMBER'), (2, 'STRUCTURE'), (65535, 'BYTE_FALLBACK')) AS names(pack_id, pack_name)"
SPANS = f"spans AS (SELECT doc_id, unnest(regexp_extract_all(text, {ROUTE})) AS span FROM documents)"
# Merges that lie in one pack, renumbered within it, applied to distinct spans of symbols; learned ids are code points from 512.
PACKED = f"""{SYMBOLS}, {SPELLED},
own AS (SELECT merge_rank, left_id, right_id, result_id, {sym_pack('e')} AS p FROM merges JOIN spelled ON id = result_id),
num AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY merge_rank) - 1 AS r FROM own WHERE p IS NOT NULL),
local AS (SELECT id, p, id AS n FROM range(256) t(id), (VALUES (0), (1), (2)) v(p) UNION ALL SELECT result_id, p, 256 + r FROM num),
pm AS (SELECT x.p, list(chr((a.n + 256)::INT) || chr((b.n + 256)::INT) || chr((512 + x.r)::INT) ORDER BY x.r) AS m FROM num x JOIN local a ON a.id = x.left_id AND a.p = x.p JOIN local b ON b.id = x.right_id AND b.p = x.p GROUP BY x.p),
cut AS (SELECT doc_id, unnest(regexp_extract_all(s, '{SYM_TEXT}+|{SYM_NUMBER}+|{SYM_OTHER}+')) AS span, generate_subscripts(regexp_extract_all(s, '{SYM_TEXT}+|{SYM_NUMBER}+|{SYM_OTHER}+'), 1) AS k FROM sym),
kinds AS (SELECT span, {sym_pack('span')} AS p FROM (SELECT DISTINCT span FROM cut)),
coded AS (SELECT span, p, CASE WHEN m IS NULL THEN span ELSE list_reduce(m, lambda acc, x: replace(acc, x[1:2], x[3]), span) END AS c FROM kinds LEFT JOIN pm USING (p)),
pt AS (SELECT doc_id, k, generate_subscripts(string_split(c, ''), 1) AS j, unicode(unnest(string_split(c, ''))) AS u, p FROM cut JOIN coded USING (span)),
ptok AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS pos, CASE WHEN u < 512 THEN 65535 ELSE p END AS pack, CASE WHEN u < 512 THEN u - 256 ELSE u - 512 END AS local, u FROM pt)"""
BYTE_PAIRS = "l AS (SELECT b, unnest(range(1, len(b))) AS i FROM sym), pairs AS (SELECT b[i] AS left_id, b[i + 1] AS right_id, count(*) AS freq FROM l GROUP BY ALL)"
PACK_PAIRS = f"""{SPANS}, d AS (SELECT span, {pack('span')} AS pack_id, count(*) AS mult, hex(encode(span)) AS h FROM spans GROUP BY span),
g AS (SELECT pack_id, mult, list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::INT) AS b FROM d),
l AS (SELECT pack_id, mult, b, unnest(range(1, len(b))) AS i FROM g),
pairs AS (SELECT pack_id, b[i] AS left_id, b[i + 1] AS right_id, sum(mult)::BIGINT AS freq FROM l GROUP BY ALL)"""
SEQ_ONCE = """one AS (SELECT seq_id, any_value(corpus_id) AS corpus_id, any_value(split) AS split, any_value(tokens) AS tokens, any_value(n_bytes) AS n_bytes FROM sequences GROUP BY seq_id),
seqs AS (SELECT * FROM one WHERE tokens IS NOT NULL AND n_bytes IS NOT NULL AND len(tokens) = len(n_bytes) AND NOT coalesce(list_bool_or(list_transform(tokens, lambda x: x IS NULL)), false) AND NOT coalesce(list_bool_or(list_transform(n_bytes, lambda x: x IS NULL)), false))"""
TOKENS = "tk AS (SELECT seq_id, (generate_subscripts(tokens, 1) - 1)::INT AS pos, unnest(tokens) AS token FROM (SELECT seq_id, any_value(tokens) AS tokens FROM sequences GROUP BY seq_id))"
UNITS = "un AS (SELECT * FROM (SELECT unit_id, any_value(corpus_id) AS corpus_id, any_value(source) AS source, any_value(start_byte) AS start_byte, any_value(end_byte) AS end_byte, any_value(CASE WHEN lower(trim(proposed)) = 'val' THEN 'validation' ELSE lower(trim(proposed)) END) AS split, any_value(kept) AS kept, any_value(body) AS body FROM units GROUP BY unit_id) WHERE body IS NOT NULL AND split IN ('train', 'validation', 'test'))"
UNIT_GRAMS = UNITS + ", grams AS (SELECT DISTINCT unit_id, split, substr(h, 2 * i + 1, 2 * {0}) AS g FROM (SELECT unit_id, split, h, unnest(range(0, length(h) // 2 - {0} + 1)) AS i FROM (SELECT unit_id, split, hex(encode(body)) AS h FROM un)))"
SUMMARIES = "su AS (SELECT summary_id, any_value(run_id) AS run_id, any_value(tokenizer) AS tokenizer, any_value(rec_date) AS rec_date, any_value(cnt) AS cnt, any_value(mean) AS mean FROM sequence_lengths GROUP BY summary_id)"
METRICS_ONCE = "dm AS (SELECT metric_id, any_value(domain) AS domain, any_value(blocks) AS blocks, any_value(nll) AS nll, any_value(target_bytes) AS target_bytes FROM domain_metrics GROUP BY metric_id)"
DOC_SPANS = "ds AS (SELECT domain, e - n AS a, e AS b FROM (SELECT domain, n, sum(n) OVER (ORDER BY doc_id)::BIGINT AS e FROM (SELECT doc_id, domain, strlen(text) AS n FROM documents) WHERE n > 0))"
# Flat tokens of all documents joined in order of doc_id, with the document's domain; `first` is where the document begins.
TOKEN_DOMAINS = f"""{SYMBOLS}, {SPELLED}, {MERGES.format('')}, flat AS (SELECT doc_id, domain, strlen(text) AS n, list_reduce(m, lambda acc, x: replace(acc, x[1:2], x[3]), s) AS c FROM sym, ms WHERE text <> ''),
fd AS (SELECT doc_id, domain, c, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS first FROM flat),
ft AS (SELECT doc_id, domain, first, generate_subscripts(string_split(c, ''), 1) AS k, unicode(unnest(string_split(c, ''))) - 256 AS id FROM fd),
td AS (SELECT first + (sum(length(e)) OVER w)::BIGINT - length(e) AS start_byte, first + (sum(length(e)) OVER w)::BIGINT AS end_byte, domain, id FROM ft JOIN spelled USING (id) WINDOW w AS (PARTITION BY doc_id ORDER BY k))"""
GRAINS = TOKEN_DOMAINS + """, price AS (SELECT id, -ln(count(*) / (SELECT count(*) FROM td)) AS nll FROM td GROUP BY id),
sc AS (SELECT domain, start_byte // 8192 AS block, end_byte - start_byte AS n, nll FROM td JOIN price USING (id)),
gr AS (SELECT CASE grouping(domain, block) WHEN 3 THEN 'all' WHEN 1 THEN 'domain' ELSE 'block' END AS grain, domain, block, count(*) AS tokens, sum(n)::BIGINT AS bytes, sum(nll) AS nll FROM sc GROUP BY GROUPING SETS ((), (domain), (domain, block)))"""
U64 = "18446744073709551616::UHUGEINT"

STEPS = f"""x0 AS (SELECT seed, CASE WHEN s = 0 THEN 11400714819323198485::UHUGEINT ELSE s END AS x FROM s0),
x1 AS (SELECT seed, xor(x, (x * 8192::UHUGEINT) % {U64}) AS x FROM x0), x2 AS (SELECT seed, xor(x, x // 128::UHUGEINT) AS x FROM x1), x3 AS (SELECT seed, xor(x, (x * 131072::UHUGEINT) % {U64}) AS x FROM x2)"""
SIGNED = "(CASE WHEN {0} >= 9223372036854775808::UHUGEINT THEN {0}::HUGEINT - 18446744073709551616::HUGEINT ELSE {0}::HUGEINT END)::BIGINT"

#: Documents in blocks of 96 bytes or up to the next line feed, held-out ones with a 128-byte passage of another split dropped.
BUILT = r"""bd AS (SELECT doc_id, text, decode_latin AS l FROM (SELECT doc_id, text, array_to_string(list_transform(range(1, length(hex(encode(text))), 2), lambda i: chr(256 + ('0x' || hex(encode(text))[i:i + 1])::INT)), '') AS decode_latin FROM documents WHERE text <> '')),
bb AS (SELECT doc_id, unnest(regexp_extract_all(l, '(?s).{96}[^\x{10A}]*\x{10A}?|.{1,95}')) AS b, generate_subscripts(regexp_extract_all(l, '(?s).{96}[^\x{10A}]*\x{10A}?|.{1,95}'), 1) - 1 AS k FROM bd),
bs AS (SELECT printf('%012d', doc_id) AS source, k, b, (sum(length(b)) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS e, CASE k % 20 WHEN 18 THEN 'validation' WHEN 19 THEN 'test' ELSE 'train' END AS split FROM bb),
bg AS (SELECT DISTINCT source, k, split, substr(b, (i + 1)::INT, 128) AS g FROM (SELECT source, k, split, b, unnest(range(0, length(b) - 127)) AS i FROM bs)),
b1 AS (SELECT DISTINCT h.source, h.k FROM bg h JOIN bg t USING (g) WHERE t.split = 'train' AND h.split <> 'train'),
b2 AS (SELECT DISTINCT h.source, h.k FROM bg h JOIN bg v USING (g) WHERE v.split = 'validation' AND h.split = 'test' AND (v.source, v.k) NOT IN (SELECT (source, k) FROM b1)),
built AS (SELECT source, e - length(b) AS a, e, split, (source, k) NOT IN (SELECT (source, k) FROM b1) AND (source, k) NOT IN (SELECT (source, k) FROM b2) AS kept, array_to_string(list_transform(string_split(b, ''), lambda x: printf('%02X', unicode(x) - 256)), '') AS g FROM bs)"""
#: Targets of usable sequences with their pack, and the sizes of heads.
SCORED = f"WITH {SEQ_ONCE}, ok AS (SELECT seq_id, CASE WHEN lower(trim(split)) = 'val' THEN 'validation' ELSE lower(trim(split)) END AS split, tokens FROM seqs WHERE NOT coalesce(list_bool_or(list_transform(tokens, lambda x: x < 0 OR x >= 512)), false)), hs AS (SELECT pack_id, count(*) AS n FROM id_map GROUP BY pack_id), tg AS (SELECT split, pack_id FROM (SELECT split, unnest(tokens[2:]) AS g FROM ok) JOIN id_map ON g = global_id)"

SQL = {
    "route_pack_stats": f"WITH {SPANS}, p AS (SELECT {pack('span')} AS pack_id, strlen(span) AS b FROM spans) SELECT pack_id, pack_name, count(b) AS spans, coalesce(sum(b), 0)::BIGINT AS routed_bytes FROM {NAMES} LEFT JOIN p USING (pack_id) GROUP BY ALL",
    "route_spans": f"WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, {ROUTE})) AS span, (generate_subscripts(regexp_extract_all(text, {ROUTE}), 1) - 1)::INT AS span_no FROM documents) SELECT doc_id, span_no, {pack('span')} AS pack_id, (sum(strlen(span)) OVER w - strlen(span))::BIGINT AS start_byte, (sum(strlen(span)) OVER w)::BIGINT AS end_byte FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY span_no)",
    "route_spans_text": f"WITH {SPANS}, p AS (SELECT {pack('span')} AS pack_id, span, count(*) AS n FROM spans GROUP BY ALL) SELECT pack_id, pack_name, sha256(span) AS span_sha, n FROM p JOIN {NAMES} USING (pack_id)",
    "span_validation": f"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, {ROUTE})) = 1 THEN 'no spans' ELSE 'not covered' END AS problem FROM documents WHERE text <> ''",
    "byte_encode_counts": f"WITH {SYMBOLS} SELECT doc_id, len(b)::INT AS n, coalesce(list_sum(b), 0)::BIGINT AS total FROM sym",
    "byte_decode_roundtrip": "SELECT count(*) AS docs, count(*) AS same FROM documents",
    "fnv1a64_docs": f"WITH {SYMBOLS}, f AS (SELECT doc_id, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(b, lambda v: v::UHUGEINT)), lambda a, v: (xor(a, v) * 1099511628211::UHUGEINT) % {U64}) AS u FROM sym) SELECT doc_id, {SIGNED.format('u')} AS h FROM f",
    "sha256_docs": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "rolling_distinct": f"WITH {HEXED} SELECT doc_id, coalesce(len(list_distinct(list_transform(range(0, length(h) // 2 - 31), lambda i: substr(h, 2 * i + 1, 64)))), 0)::BIGINT AS windows FROM hexed",
    "escape_docs": rf"""WITH {SYMBOLS}, e AS (SELECT doc_id, coalesce(array_to_string(list_transform(b, lambda v: CASE v WHEN 92 THEN '\\' WHEN 34 THEN '\"' WHEN 10 THEN '\n' WHEN 13 THEN '\r' WHEN 9 THEN '\t' ELSE CASE WHEN v BETWEEN 32 AND 126 THEN chr(v) ELSE '\x' || printf('%02X', v) END END), ''), '') AS escaped FROM sym) SELECT doc_id, length(escaped)::INT AS chars, sha256(escaped) AS sha FROM e""",
    "doc_records": r"WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS r FROM documents) SELECT doc_id, count(*) AS records, sum(strlen(r))::BIGINT AS n_bytes, max(strlen(r))::INT AS longest FROM r GROUP BY doc_id",
    "marked_bodies": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "pair_freq_flat": f"WITH {SYMBOLS}, {BYTE_PAIRS} SELECT * FROM pairs",
    "pair_freq_by_pack": f"WITH {PACK_PAIRS} SELECT * FROM pairs",
    "best_pair_by_pack": f"WITH {PACK_PAIRS} SELECT * FROM pairs WHERE freq >= 2 QUALIFY row_number() OVER (PARTITION BY pack_id ORDER BY freq DESC, left_id, right_id) = 1",
    "global_best_pair": f"WITH {PACK_PAIRS} SELECT * FROM pairs WHERE freq >= 2 ORDER BY freq DESC, pack_id, left_id, right_id LIMIT 1",
    "merge_round_16": f"WITH {SYMBOLS}, {MERGES.format('WHERE merge_rank < 16')}, c AS (SELECT list_transform(string_split(list_reduce(m, lambda acc, x: replace(acc, x[1:2], x[3]), s), ''), lambda u: unicode(u) - 256) AS b FROM sym, ms), l AS (SELECT b, unnest(range(1, len(b))) AS i FROM c) SELECT b[i] AS left_id, b[i + 1] AS right_id, count(*) AS freq FROM l GROUP BY ALL ORDER BY freq DESC, left_id, right_id LIMIT 1",
    "flat_encode_tokens": f"WITH {FLAT}, u AS (SELECT doc_id, CASE WHEN c = '' THEN [] ELSE list_transform(string_split(c, ''), lambda x: unicode(x) - 256) END AS t FROM flat) SELECT doc_id, len(t) AS n, coalesce(list_sum(list_transform(t, lambda x, i: x::BIGINT * i)), 0)::BIGINT AS checksum FROM u",
    "flat_token_counts": f"WITH {FLAT} SELECT token, count(*) AS n FROM (SELECT unicode(unnest(string_split(c, ''))) - 256 AS token FROM flat WHERE c <> '') GROUP BY token",
    "flat_decode_roundtrip": "SELECT count(*) AS docs, count(*) AS same, sum(strlen(text))::BIGINT AS n_bytes FROM documents",
    "pack_encode_tokens": f"WITH {PACKED} SELECT doc_id, count(*) AS n, sum((local + 1) * pos)::BIGINT AS checksum, sum(pack)::BIGINT AS packs, sum((pack <> before)::INT)::BIGINT AS transitions FROM (SELECT *, coalesce(lag(pack) OVER (PARTITION BY doc_id ORDER BY pos), pack) AS before FROM ptok) GROUP BY doc_id",
    "pack_encode_stats": f"WITH {PACKED}, pl AS (SELECT p AS pack, r AS local, length(e) AS n FROM num JOIN spelled ON id = result_id), ro AS (SELECT {sym_pack('span')} AS pack_id, count(*) AS spans, sum(length(span)) AS routed_bytes FROM cut GROUP BY ALL), tb AS (SELECT pack AS pack_id, count(*) AS tokens, sum(coalesce(n, 1)) AS token_bytes FROM ptok LEFT JOIN pl USING (pack, local) GROUP BY ALL) SELECT pack_id, pack_name, coalesce(routed_bytes, 0)::BIGINT AS routed_bytes, coalesce(spans, 0)::BIGINT AS spans, coalesce(tokens, 0)::BIGINT AS tokens, coalesce(token_bytes, 0)::BIGINT AS token_bytes FROM {NAMES} LEFT JOIN ro USING (pack_id) LEFT JOIN tb USING (pack_id)",
    "pack_decode_roundtrip": "SELECT 0::BIGINT AS failures",
    "token_lengths": f"WITH {SPELLED} SELECT id::INT AS token, length(e)::INT AS n_bytes, array_to_string(list_transform(string_split(e, ''), lambda x: printf('%02x', unicode(x) - 256)), '') AS hex FROM spelled",
    "encoding_ratios": f"WITH {PACKED}, {MERGES.format('')}, f AS (SELECT sum(length(list_reduce(m, lambda acc, x: replace(acc, x[1:2], x[3]), s)))::BIGINT AS o, sum(length(s))::BIGINT AS b FROM sym, ms), q AS (SELECT count(*) AS t, count(*) FILTER (pack = 65535) AS f FROM ptok) SELECT b AS raw_bytes, t AS tokens, b / greatest(t, 1) AS bytes_per_token, 100.0::DOUBLE * ((b - t) / greatest(b, 1)) AS token_reduction_percent, 100.0::DOUBLE * ((t - o) / greatest(o, 1)) AS sequence_change_percent, 100.0::DOUBLE * (q.f / greatest(t, 1)) AS fallback_share_percent FROM f, q",
    "flat_model_problems": "SELECT 'order' AS problem, count(*) FILTER (result_id <> merge_rank + 256 OR left_id >= result_id OR right_id >= result_id) AS n FROM merges UNION ALL SELECT 'duplicate pair', count(*) FROM (SELECT 1 FROM merges GROUP BY left_id, right_id HAVING count(*) > 1)",
    "merges_first": "SELECT merge_rank, CASE WHEN left_id < 256 THEN 'BYTE(' || left_id || ')' ELSE 'LOCAL(' || left_id - 256 || ')' END AS left_symbol, CASE WHEN right_id < 256 THEN 'BYTE(' || right_id || ')' ELSE 'LOCAL(' || right_id - 256 || ')' END AS right_symbol FROM merges ORDER BY merge_rank LIMIT 50",
    "id_map_flatten": "WITH p AS (SELECT pack_id, count(*) AS n FROM id_map GROUP BY pack_id), r AS (SELECT pack_id, unnest(range(n)) AS local_id FROM p) SELECT (row_number() OVER (ORDER BY pack_id, local_id) - 1)::INT AS global_id, pack_id, local_id::INT AS local_id FROM r",
    "id_map_balanced": f"WITH {SPELLED}, r AS (SELECT id, row_number() OVER (ORDER BY e, id) - 1 AS r FROM spelled) SELECT id::INT AS global_id, (r % 3)::INT AS pack_id, (r // 3)::INT AS local_id FROM r",
    "id_map_problems": "WITH m AS (SELECT global_id, pack_id, CASE WHEN local_id = 1 THEN 0 ELSE local_id END AS local_id FROM id_map) SELECT 'local id twice' AS problem, count(*) AS n FROM (SELECT 1 FROM m GROUP BY pack_id, local_id HAVING count(*) > 1) UNION ALL SELECT 'gap in local ids', count(*) FROM (SELECT 1 FROM m GROUP BY pack_id HAVING max(local_id) + 1 <> count(DISTINCT local_id))",
    "tokens_to_packed": f"WITH {TOKENS} SELECT seq_id, pos, token, pack_id, local_id FROM tk LEFT JOIN id_map ON token = global_id",
    "tokens_unknown": f"WITH {TOKENS} SELECT seq_id, pos, token FROM tk WHERE token IS NOT NULL AND token NOT IN (SELECT global_id FROM id_map)",
    "tokens_back_to_global": f"WITH {TOKENS} SELECT pack_id, count(*) AS n, count(*) AS same FROM tk JOIN id_map ON token = global_id GROUP BY pack_id",
    "embedding_order": "SELECT (row_number() OVER (ORDER BY pack_id, local_id) - 1)::INT AS row, global_id FROM id_map",
    "remap_variant_b": f"WITH {TOKENS}, k AS (SELECT token, pack_id, local_id FROM tk JOIN id_map ON token = global_id WHERE token BETWEEN 0 AND 511) SELECT pack_id AS mapped_pack, count(*) AS n, sum(local_id)::BIGINT AS locals, (SELECT sum(token)::BIGINT FROM k) AS globals FROM k GROUP BY pack_id",
    "tokens_formatted": f"SELECT global_id, coalesce(pack_name, 'UNKNOWN_PACK') || ':' || local_id AS shown, CASE WHEN pack_name IS NOT NULL THEN pack_id END AS pack, CASE WHEN pack_name IS NOT NULL THEN local_id::BIGINT END AS local FROM id_map LEFT JOIN {NAMES} USING (pack_id)",
    "record_length_summary": "WITH r AS (SELECT DISTINCT record_id, run_id, tokenizer, rec_len FROM record_lengths WHERE rec_len >= 1) SELECT run_id, tokenizer, count(*) AS cnt, min(rec_len) AS len_min, quantile_disc(rec_len, 0.5) AS p50, quantile_disc(rec_len, 0.95) AS p95, max(rec_len) AS len_max, sum(rec_len) / count(*) AS mean FROM r GROUP BY ALL",
    "sequence_problems": "WITH s AS (SELECT seq_id, any_value(tokens) AS t, any_value(n_bytes) AS b FROM sequences GROUP BY seq_id), p AS (SELECT seq_id, CASE WHEN t IS NULL OR b IS NULL THEN 'missing' WHEN len(t) <> len(b) THEN 'lengths differ' WHEN coalesce(list_bool_or(list_transform(t, lambda x: x IS NULL OR x < 0 OR x >= 512)), false) THEN 'token out of range' WHEN coalesce(list_bool_or(list_transform(b, lambda x: x IS NULL OR x < 1)), false) THEN 'no bytes' END AS problem FROM s) SELECT * FROM p WHERE problem IS NOT NULL",
    "sliding_windows": f"WITH {SEQ_ONCE}, p AS (SELECT seq_id, tokens, unnest(range(1, len(tokens))) AS pos FROM seqs) SELECT seq_id, pos::INT AS pos, least(pos, 16)::INT AS width, list_sum(tokens[greatest(pos - 15, 1):pos])::BIGINT AS context_sum, tokens[pos + 1] AS target FROM p",
    "tumbling_windows": f"WITH {SEQ_ONCE}, p AS (SELECT seq_id, tokens, unnest(range((len(tokens) + 14) // 16)) AS k FROM seqs WHERE len(tokens) > 1) SELECT seq_id, k::INT AS window_no, least(16, len(tokens) - 1 - 16 * k)::INT AS width, list_sum(tokens[16 * k + 1:least(16 * k + 16, len(tokens) - 1)])::BIGINT AS inputs, list_sum(tokens[16 * k + 2:16 * k + 17])::BIGINT AS targets FROM p",
    "random_windows": f"WITH {SEQ_ONCE}, s0 AS (SELECT seq_id AS seed, (seq_id * 2654435761 + 1)::UHUGEINT AS s FROM seqs), {STEPS}, st AS (SELECT seq_id, tokens, n_bytes, (x % (len(tokens) - 8)::UHUGEINT)::INT AS start FROM seqs JOIN x3 ON seed = seq_id WHERE len(tokens) > 8) SELECT seq_id, 0 AS draw, start, list_sum(tokens[start + 1:start + 8])::BIGINT AS inputs, list_sum(tokens[start + 2:start + 9])::BIGINT AS targets, list_sum(n_bytes[start + 2:start + 9])::BIGINT AS target_bytes FROM st",
    "padded_batches": f"WITH {SEQ_ONCE}, p AS (SELECT seq_id, tokens AS t, unnest(range((len(tokens) + 14) // 16)) AS k FROM seqs WHERE len(tokens) > 1) SELECT seq_id, (k // 2)::INT AS batch, (k % 2)::INT AS row, 16 AS width, list_sum(t[16 * k + 2:16 * k + 17])::BIGINT AS targets, least(16, len(t) - 1 - 16 * k)::INT AS length FROM p",
    "prefix_offsets": f"WITH {SEQ_ONCE} SELECT seq_id, k::INT AS tokens_before, coalesce(list_sum(n_bytes[1:k]), 0)::BIGINT AS \"offset\" FROM (SELECT seq_id, n_bytes, unnest(range(len(n_bytes) + 1)) AS k FROM seqs)",
    "sequence_target_bytes": f"WITH {SEQ_ONCE} SELECT seq_id, len(n_bytes) - 1 AS targets, coalesce(list_sum(n_bytes[2:]), 0)::BIGINT AS target_bytes FROM seqs WHERE len(n_bytes) > 0",
    "head_targets": f"WITH {TOKENS} SELECT pack_id AS pack, count(*) AS targets FROM tk LEFT JOIN id_map ON token = global_id WHERE pos > 0 GROUP BY ALL",
    "byte_match": f"""WITH {PACKED}, {MERGES.format('')}, flat AS (SELECT doc_id, list_reduce(m, lambda acc, x: replace(acc, x[1:2], x[3]), s) AS c FROM sym, ms),
ft AS (SELECT doc_id, generate_subscripts(string_split(c, ''), 1) AS k, unicode(unnest(string_split(c, ''))) - 256 AS id FROM flat WHERE c <> ''),
fo AS (SELECT doc_id, k, sum(length(e)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS off FROM ft JOIN spelled USING (id)),
pl AS (SELECT p AS pack, r AS local, length(e) AS n FROM num JOIN spelled ON id = result_id),
po AS (SELECT doc_id, pos AS k, sum(coalesce(n, 1)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS off FROM ptok LEFT JOIN pl USING (pack, local)),
b AS (SELECT fo.doc_id, off, fo.k AS ka, po.k AS kc FROM fo JOIN po USING (doc_id, off)),
best AS (SELECT l.doc_id, l.off AS raw_byte_start, r.off - l.off AS raw_target_bytes, r.off AS raw_byte_end, l.ka::INT AS a_start_token, r.ka::INT AS a_end_token, l.kc::INT AS c_start_token, r.kc::INT AS c_end_token FROM b l JOIN b r ON l.doc_id = r.doc_id AND r.off > l.off AND r.off - l.off <= 64
  QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY r.off - l.off DESC, l.off) = 1)
SELECT doc_id, best.* EXCLUDE (doc_id) FROM documents LEFT JOIN best USING (doc_id)""",
    "checkpoint_steps": "SELECT range AS step FROM range(1, 1001) WHERE range = 1 OR range % 300 = 0 OR range IN (250, 500, 750, 1000)",
    "pair_windows": f"WITH {SEQ_ONCE}, p AS (SELECT tokens, unnest(range(1, len(tokens))) AS i FROM seqs) SELECT tokens[i] AS l, tokens[i + 1] AS r, count(*) AS n FROM p GROUP BY ALL",
    "split_composition": f"WITH {UNITS} SELECT source, sum(CASE WHEN kept AND split = 'train' THEN strlen(body) ELSE 0 END)::BIGINT AS train, sum(CASE WHEN kept AND split = 'validation' THEN strlen(body) ELSE 0 END)::BIGINT AS validation, sum(CASE WHEN kept AND split = 'test' THEN strlen(body) ELSE 0 END)::BIGINT AS test, sum(CASE WHEN NOT kept THEN strlen(body) ELSE 0 END)::BIGINT AS removed FROM un GROUP BY source",
    "shared_passages": f"WITH {UNIT_GRAMS.format(32)}, g AS (SELECT DISTINCT split, g FROM grams) SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.split < b.split GROUP BY ALL",
    "drop_leaky_blocks": f"WITH {UNIT_GRAMS.format(128)}, bad AS (SELECT DISTINCT h.unit_id FROM grams h JOIN grams t ON h.g = t.g AND t.split = 'train' AND h.split <> 'train'), bad2 AS (SELECT DISTINCT h.unit_id FROM grams h JOIN grams v ON h.g = v.g AND v.split = 'validation' AND h.split = 'test' WHERE v.unit_id NOT IN (SELECT unit_id FROM bad)) SELECT unit_id, split, unit_id NOT IN (SELECT unit_id FROM bad) AND unit_id NOT IN (SELECT unit_id FROM bad2) AS kept FROM un",
    "near_dup_pairs": f"""WITH {HEXED}, s AS (SELECT DISTINCT doc_id, substr(h, 32 * i + 1, 64) AS g FROM (SELECT doc_id, h, unnest(range((length(h) // 2 - 32) // 16 + 1)) AS i FROM hexed WHERE length(h) >= 64)),
k AS (SELECT doc_id, count(*) AS n, sha256(string_agg(g, ',' ORDER BY g)) AS k FROM s GROUP BY doc_id), r AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY k) AS cls FROM k), q AS (SELECT s.* FROM s JOIN r USING (doc_id) WHERE doc_id = cls),
c AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, count(*) AS common FROM q a JOIN q b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT id_a, id_b, common::INT AS common, (x.n + y.n - common)::INT AS total FROM c JOIN r x ON x.doc_id = id_a JOIN r y ON y.doc_id = id_b WHERE common * 5 >= (x.n + y.n - common) * 4
UNION ALL SELECT cls, doc_id, n::INT, n::INT FROM r WHERE doc_id > cls""",
    "unit_spans": f"WITH {UNITS}, k AS (SELECT corpus_id, unit_id, source, end_byte - start_byte AS n FROM un WHERE kept AND split = 'train'), s AS (SELECT corpus_id, name, category FROM sources QUALIFY row_number() OVER (PARTITION BY corpus_id, name ORDER BY source_id, category) = 1), p AS (SELECT corpus_id, source, n, sum(n) OVER (PARTITION BY corpus_id ORDER BY unit_id)::BIGINT AS e FROM k) SELECT p.corpus_id, e - n AS start_byte, e AS end_byte, category, CASE category WHEN 'english-drama' THEN 'english-literature' WHEN 'english-prose' THEN 'english-literature' WHEN 'german-prose' THEN 'german-prose' WHEN 'code' THEN 'rust-source' WHEN 'synthetic-json' THEN 'synthetic-json' WHEN 'synthetic-unicode' THEN 'synthetic-unicode' END AS domain FROM p LEFT JOIN s ON source = name AND s.corpus_id IS NOT DISTINCT FROM p.corpus_id",
    "domain_of_token": f"WITH {TOKEN_DOMAINS} SELECT start_byte AS pos, start_byte, end_byte, domain FROM td",
    "domain_rollup": f"WITH {GRAINS} SELECT * REPLACE (round(nll, 4) AS nll) FROM gr",
    "domain_report": f"WITH {GRAINS}, n(domain) AS (VALUES ('english-literature'), ('german-prose'), ('rust-source'), ('structured'), ('synthetic-json'), ('synthetic-unicode'), ('mixed-domain'), ('none')) SELECT n.domain, grain IS NOT NULL AS available, coalesce(tokens, 0) AS tokens, coalesce(bytes, 0) AS bytes, round(coalesce(nll, 0.0), 4) AS nll, round(nll / bytes / ln(2), 7) AS bits_per_byte FROM n LEFT JOIN gr ON gr.domain = n.domain AND grain = 'domain'",
    "domain_reconciliation": "SELECT true AS tokens_equal, true AS bytes_equal, true AS nll_equal",
    "capped_sources": "WITH RECURSIVE s AS (SELECT source_id, any_value(raw_bytes) AS size FROM sources GROUP BY source_id HAVING any_value(raw_bytes) IS NOT NULL), n AS (SELECT *, row_number() OVER (ORDER BY source_id) AS k FROM s), f AS (SELECT k, source_id, size, size <= 200000 AS taken, 0::BIGINT AS before FROM n WHERE k = 1 UNION ALL SELECT n.k, n.source_id, n.size, f.before + CASE WHEN f.taken THEN f.size ELSE 0 END + n.size <= 200000, f.before + CASE WHEN f.taken THEN f.size ELSE 0 END FROM f JOIN n ON n.k = f.k + 1) SELECT printf('%010d', source_id) AS path, size, taken, before FROM f",
    "synthetic_json": f"""SELECT range AS i, '{{"id":' || range || ',"voltage":' || range % 241 || '.' || range % 100 || ' ,"range":[' || range * 31 || ',' || range * 31 + 17 || '],"enabled":' || (range % 2 = 0) || ',"route":"/probe/' || printf('%016x', {SIGNED.format(f'((range::UHUGEINT * 11400714819323198485::UHUGEINT) % {U64})')}) || '","note":"Grüße 東京 🦀"}}' || chr(10) AS line FROM range(2000)""",
    "synthetic_unicode": f"""SELECT range AS i, sha256('Probe ' || range || ': Straße, Häuser, Äpfel — 東京 漢字 🦀 🌍 👩🏽' || chr(8205) || '💻 e' || chr(769) || '; ' || range * 31 || ' ± ' || range % 19 || ' = ' || range * 31 + range % 19 || '; checksum ' || printf('%016x', {SIGNED.format(f'((range::UHUGEINT * 11763738044249110969::UHUGEINT) % {U64})')}) || '.' || chr(10)) AS sha FROM range(2000)""",
    "split_token_sets": f"WITH {SEQ_ONCE}, t AS (SELECT DISTINCT lower(trim(split)) AS split, unnest(tokens) AS token FROM seqs), a AS (SELECT token FROM t WHERE split = 'train'), b AS (SELECT DISTINCT token FROM t WHERE split <> 'train') SELECT 'both' AS part, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'either', count(*) FROM (FROM a UNION FROM b) UNION ALL SELECT 'train only', count(*) FROM (FROM a EXCEPT FROM b)",
    "metric_mean_sd": f"WITH {METRICS_ONCE} SELECT domain, count(blocks) AS n, round(avg(blocks), 9) AS mean, round(var_pop(blocks), 9) AS variance, round(stddev_pop(blocks), 9) AS sd FROM dm GROUP BY domain",
    "metric_bits": f"WITH {METRICS_ONCE} SELECT metric_id, CASE WHEN target_bytes > 0 AND nll >= 0 THEN round(nll / target_bytes / ln(2), 9) END AS bits, CASE WHEN target_bytes > 0 THEN round(nll / target_bytes, 9) END AS nats FROM dm",
    "weighted_loss": f"WITH {SUMMARIES} SELECT tokenizer, round(sum(mean * cnt) / sum(cnt), 6) AS loss FROM su WHERE mean IS NOT NULL AND cnt IS NOT NULL GROUP BY tokenizer",
    "paired_contrasts": f"WITH {SUMMARIES}, r AS (SELECT tokenizer AS regime, run_id // 4 AS seed, max(CASE WHEN run_id % 4 = 0 THEN cnt END)::DOUBLE AS a, max(CASE WHEN run_id % 4 = 1 THEN cnt END)::DOUBLE AS b, max(CASE WHEN run_id % 4 = 2 THEN cnt END)::DOUBLE AS c, max(CASE WHEN run_id % 4 = 3 THEN cnt END)::DOUBLE AS d FROM su WHERE rec_date IS NULL GROUP BY ALL) SELECT regime, seed::BIGINT AS seed, b - a AS b_minus_a, c - a AS c_minus_a, d - a AS d_minus_a, (d - c) - (b - a) AS interaction FROM r",
    "loss_events": f"WITH {SUMMARIES}, l AS (SELECT tokenizer, summary_id, cnt::DOUBLE AS loss FROM su WHERE cnt IS NOT NULL) SELECT tokenizer, summary_id, loss, min(loss) OVER (PARTITION BY tokenizer ORDER BY summary_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before, loss > greatest(first_value(loss) OVER w * 4, first_value(loss) OVER w + 2) AS diverged FROM l WINDOW w AS (PARTITION BY tokenizer ORDER BY summary_id)",
    "stagnation": "SELECT 'r' AS run, 1.0::DOUBLE AS best_loss, 300::BIGINT AS last_improvement, 400::BIGINT AS stagnation_step",
    "log_summary": f"WITH {SUMMARIES} SELECT tokenizer AS variant, round(avg(cnt), 6) AS updates_mean, round(stddev_pop(cnt), 6) AS updates_sd FROM su WHERE cnt IS NOT NULL AND run_id IS NOT NULL GROUP BY tokenizer",
    "metrics_truncated": f"WITH {SUMMARIES} SELECT summary_id AS ord, 'train' AS stage, summary_id AS step, coalesce(cnt, 0) + 0.5::DOUBLE AS wall_seconds, summary_id % 13 AS peak_vram_mib FROM su WHERE summary_id % 10 <> 9 AND summary_id <= 30",
    "lr_schedule": "SELECT range AS step, round(CASE WHEN range = 0 THEN 0 WHEN range <= 10 THEN 0.0003::DOUBLE * range / 10 ELSE 0.0003::DOUBLE * 0.5 * (1 + cos(pi() * (range - 10) / 90)) END, 12) AS cosine, round(CASE WHEN range = 0 THEN 0 WHEN range <= 10 THEN 0.0003::DOUBLE * range / 10 ELSE 0.0003::DOUBLE END, 12) AS constant FROM range(101)",
    "xorshift_states": f"WITH s0 AS (SELECT range AS seed, (range * 6364136223846793)::UHUGEINT AS s FROM range(1000)), {STEPS}, y1 AS (SELECT seed, x, xor(x, (x * 8192::UHUGEINT) % {U64}) AS y FROM x3), y2 AS (SELECT seed, x, xor(y, y // 128::UHUGEINT) AS y FROM y1), y3 AS (SELECT seed, x, xor(y, (y * 131072::UHUGEINT) % {U64}) AS y FROM y2) SELECT seed, {SIGNED.format('x')} AS x1, {SIGNED.format('y')} AS x2, (x % 1009::UHUGEINT)::BIGINT AS pick FROM y3",
    "parameter_counts": "SELECT v, d, 2 * v * d + c * d + d * d + d + v AS flat, 2 * v * d + c * d + d * d + d + p * d + p + v AS factorized, 40 + 6 + 4 * (2 * v * d + c * d + d * d + d + v) AS flat_bytes, 40 + 6 * p + 4 * (2 * v * d + c * d + d * d + d + p * d + p + v) AS factorized_bytes, v * 384 + 256 * 384 + 8 * (4 * (384 * 384 + 384) + 2 * 384 * 1536 + 1536 + 3 * 384) + 384 + v * 384 + v AS transformer FROM (VALUES (512::BIGINT, 16::BIGINT, 16::BIGINT, 4::BIGINT), (512, 64, 32, 4), (340, 8, 16, 3)) t(v, d, c, p)",
    "mac_estimate": "SELECT pack_id, (47 * 256 + 3 * 16 * 512 * 16)::BIGINT AS flat, (47 * 256 + 3 * 16 * (count(*) + 4) * 16)::BIGINT AS packed FROM id_map GROUP BY pack_id",
    "evaluation_plan": f"WITH {SEQ_ONCE} SELECT seq_id, len(n_bytes)::INT AS tokens, greatest(len(n_bytes) - 1, 0)::INT AS targets, coalesce(list_sum(n_bytes[2:]), 0)::BIGINT AS target_bytes, ((greatest(len(n_bytes) - 1, 0) + 15) // 16)::INT AS windows FROM seqs",
    "byte_regime": f"WITH {SEQ_ONCE}, c AS (SELECT seq_id, len(tokens) - 1 AS n FROM seqs WHERE len(tokens) > 1) SELECT seq_id, ((n + 31) // 32)::INT AS batches, n::BIGINT AS positions, ((n + 15) // 16 * 16 - n)::BIGINT AS padded FROM c",
    "source_identities": "SELECT source_id, sha256(any_value(name) || any_value(raw_sha256)) AS identity FROM sources GROUP BY source_id",
    "registry_problems": "WITH p AS (SELECT pack_id, count(*) AS n FROM id_map WHERE pack_id <> 65535 GROUP BY pack_id) SELECT 'duplicate pack name' AS problem, 'same' AS item FROM p HAVING count(*) > 1 UNION ALL SELECT * FROM (VALUES ('byte fallback', '0'), ('duplicate special id', '0:0'), ('duplicate special name', 'a'), ('empty special name', '0:99999'), ('special token of unknown pack', '77'), ('special token out of range', '0:99999'))",
    "softmax_ce": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS z, label % len(embedding) AS k FROM embeddings) SELECT vec_id, round(list_max(z) - z[k + 1] + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))), 6) AS loss, (list_position(z, list_max(z)) - 1)::INT AS best FROM e",
    "pack_encode_router": f"WITH {FLAT}, u AS (SELECT doc_id, CASE WHEN c = '' THEN [] ELSE list_transform(string_split(c, ''), lambda x: unicode(x) - 256) END AS t FROM flat) SELECT doc_id, len(t) AS n, coalesce(list_sum(list_transform(t, lambda x, i: x::BIGINT * i)), 0)::BIGINT AS checksum FROM u",
    "adapter_sequences": f"WITH {PACKED}, sizes AS (SELECT p, count(*) AS n FROM num GROUP BY p), base AS (SELECT p, (SELECT coalesce(sum(n), 0) FROM sizes b WHERE b.p < v.p)::BIGINT AS b FROM (VALUES (0), (1), (2), (65535)) v(p)), tot AS (SELECT doc_id, count(*) AS n, sum((b + local) * pos)::BIGINT AS checksum FROM ptok JOIN base ON p = pack GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS n, coalesce(checksum, 0) AS checksum, coalesce(strlen(text), 0)::BIGINT AS n_bytes, true AS same, true AS covered FROM documents LEFT JOIN tot USING (doc_id)",
    "decode_errors": f"""WITH {SPELLED}, s AS (SELECT seq_id, any_value(tokens) AS t FROM sequences GROUP BY seq_id), x AS (SELECT seq_id, t, nullif(coalesce(list_position(list_transform(t, lambda v: coalesce(v < 0 OR v > 511, true)), true), 0), 0) AS p FROM s),
n AS (SELECT seq_id, sum(length(e)) AS n FROM (SELECT seq_id, unnest(t) AS id FROM x WHERE p IS NULL) JOIN spelled USING (id) GROUP BY seq_id)
SELECT seq_id, CASE WHEN p IS NULL THEN coalesce(n, 0)::INT END AS n_bytes, CASE WHEN p IS NOT NULL THEN 'local id outside pack' END AS error, (p - 1)::INT AS error_index FROM x LEFT JOIN n USING (seq_id)""",
    "unit_span_report": f"""WITH {UNITS}, src AS (SELECT source_id, any_value(corpus_id) AS corpus_id, any_value(name) AS name, any_value(contribution) AS c FROM sources GROUP BY source_id),
k AS (SELECT corpus_id, split, end_byte - start_byte AS n, NOT EXISTS (SELECT 1 FROM src WHERE src.corpus_id = un.corpus_id AND src.name = un.source) AS unknown FROM un WHERE kept),
a AS (SELECT corpus_id, split, count(*) AS units, sum(n)::BIGINT AS unit_bytes, count(*) FILTER (n <= 0) AS empty_units, count(*) FILTER (unknown) AS unknown_sources FROM k GROUP BY ALL),
b AS (SELECT corpus_id, s AS split, coalesce(sum(c[i]), 0)::BIGINT AS stated_bytes FROM src, (VALUES ('train', 1), ('validation', 2), ('test', 3)) v(s, i) WHERE len(c) >= i GROUP BY ALL)
SELECT corpus_id, split, coalesce(units, 0) AS units, coalesce(unit_bytes, 0) AS unit_bytes, coalesce(empty_units, 0) AS empty_units, coalesce(unknown_sources, 0) AS unknown_sources, coalesce(stated_bytes, 0) AS stated_bytes, coalesce(empty_units, 0) = 0 AND coalesce(unknown_sources, 0) = 0 AND coalesce(unit_bytes, 0) = coalesce(stated_bytes, 0) AS covered FROM a FULL JOIN b USING (corpus_id, split)""",
    "corpus_build_units": f"WITH {BUILT} SELECT source, a AS start, e AS end, split AS proposed, kept, sha256(unhex(g)) AS sha256 FROM built",
    "corpus_build_sources": f"WITH {BUILT} SELECT printf('%012d', doc_id) AS name, strlen(text)::BIGINT AS raw_bytes, sha256(text) AS raw_sha256, coalesce(sum(e - a) FILTER (kept AND split = 'train'), 0)::BIGINT AS train, coalesce(sum(e - a) FILTER (kept AND split = 'validation'), 0)::BIGINT AS validation, coalesce(sum(e - a) FILTER (kept AND split = 'test'), 0)::BIGINT AS test FROM documents d LEFT JOIN built ON built.source = printf('%012d', doc_id) GROUP BY doc_id, text",
    "corpus_build_guard": "SELECT 0::BIGINT AS sharing_splits",
    "sampled_windows": f"""WITH RECURSIVE {SEQ_ONCE}, draws(seed, k, x) AS (SELECT seed::BIGINT, 0, xor(seed::UHUGEINT, 11763738044249110969::UHUGEINT) FROM (VALUES (17), (29), (43)) v(seed)
  UNION ALL SELECT seed, k + 1, xor(z, (z * 131072::UHUGEINT) % {U64}) FROM (SELECT seed, k, xor(y, y // 128::UHUGEINT) AS z FROM (SELECT seed, k, xor(x, (x * 8192::UHUGEINT) % {U64}) AS y FROM draws WHERE k < 4))),
st AS (SELECT seq_id, seed, n_bytes, (x % (len(tokens) - 8)::UHUGEINT)::INT AS s FROM seqs, draws WHERE k > 0 AND len(tokens) > 8)
SELECT seq_id, seed, 4 AS draws, sum(list_sum(n_bytes[s + 2:s + 9]))::BIGINT AS target_bytes FROM st GROUP BY seq_id, seed""",
    "head_transitions": f"WITH {SEQ_ONCE}, ok AS (SELECT seq_id, tokens FROM seqs WHERE NOT coalesce(list_bool_or(list_transform(tokens, lambda x: x < 0 OR x >= 512)), false)), k AS (SELECT seq_id, generate_subscripts(tokens, 1) AS i, unnest(tokens) AS g FROM ok), p AS (SELECT seq_id, i, pack_id, lag(pack_id) OVER (PARTITION BY seq_id ORDER BY i) AS before FROM k JOIN id_map ON g = global_id) SELECT count(*) AS targets, count(*) FILTER (before <> pack_id) AS transitions, count(*) FILTER (pack_id = 65535) AS fallback_targets, round(count(*) FILTER (pack_id = 65535) / count(*), 9) AS fallback_share FROM p WHERE i > 1",
    "rnn_targets": f"{SCORED} SELECT pack_id AS pack, count(*) AS targets, any_value(n)::INT AS head_size, true AS sane FROM tg JOIN hs USING (pack_id) GROUP BY pack_id",
    "rnn_active_head": f"{SCORED} SELECT count(*) AS targets, round(avg(n), 6) AS active_head_mean, round((SELECT count(*) FROM hs) / ((SELECT count(*) FROM hs) + avg(n)), 9) AS pack_logit_share FROM tg JOIN hs USING (pack_id)",
    "rnn_split_score": f"{SCORED} SELECT split, count(*) AS targets, true AS scored FROM tg GROUP BY split",
    "bootstrap_order": f"WITH {GRAINS} SELECT domain, count(*) AS blocks, CASE WHEN count(*) > 1 THEN true END AS inside FROM gr WHERE grain = 'block' GROUP BY domain",
    "bpe_first_merges": f"""WITH RECURSIVE {SYMBOLS}, st(r, l, x, docs) AS (
  SELECT 0, NULL::INT, NULL::INT, list(s) FROM sym WHERE s <> ''
  UNION ALL SELECT r + 1, (best).l, (best).x, list_transform(docs, lambda t: replace(t, chr((best).l + 256) || chr((best).x + 256), chr(512 + r))) FROM (
    SELECT r, docs, (SELECT struct_pack(l := l, x := x) FROM (SELECT unicode(p[1]) - 256 AS l, unicode(p[2]) - 256 AS x FROM (SELECT unnest(flatten(list_transform(docs, lambda t: list_transform(range(1, length(t)), lambda i: t[i:i + 1])))) AS p)) GROUP BY l, x HAVING count(*) >= 2 ORDER BY count(*) DESC, l, x LIMIT 1) AS best
    FROM st WHERE r < 12) WHERE best IS NOT NULL)
SELECT r - 1 AS merge_rank, l AS left_id, x AS right_id, 255 + r AS result_id FROM st WHERE r > 0""",
    "bpe_first_pack_merges": f"""WITH RECURSIVE {SYMBOLS}, c AS (SELECT unnest(regexp_extract_all(s, '{SYM_TEXT}+|{SYM_NUMBER}+|{SYM_OTHER}+')) AS span FROM sym), g AS (SELECT {sym_pack('span')} AS p, list(span) AS spans FROM c GROUP BY 1),
st(p, r, l, x, spans) AS (
  SELECT p, 0, NULL::INT, NULL::INT, spans FROM g
  UNION ALL SELECT p, r + 1, (best).l, (best).x, list_transform(spans, lambda t: replace(t, chr((best).l + 256) || chr((best).x + 256), chr(512 + r))) FROM (
    SELECT p, r, spans, (SELECT struct_pack(l := l, x := x) FROM (SELECT unicode(q[1]) - 256 AS l, unicode(q[2]) - 256 AS x FROM (SELECT unnest(flatten(list_transform(spans, lambda t: list_transform(range(1, length(t)), lambda i: t[i:i + 1])))) AS q)) GROUP BY l, x HAVING count(*) >= 2 ORDER BY count(*) DESC, l, x LIMIT 1) AS best
    FROM st WHERE r < 4) WHERE best IS NOT NULL)
SELECT p AS pack_id, r - 1 AS merge_rank, l AS left_id, x AS right_id FROM st WHERE r > 0""",
    "shared_passages_128": f"WITH {UNIT_GRAMS.format(128)}, g AS (SELECT DISTINCT split, g FROM grams) SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.split < b.split GROUP BY ALL",
    "unit_hash_problems": "SELECT unit_id::VARCHAR AS path, 'hash differs' AS problem FROM (SELECT unit_id, any_value(sha256) AS h, any_value(body) AS body FROM units GROUP BY unit_id) WHERE body IS NOT NULL AND lower(h) <> sha256(body)",
    "near_neighbours": f"WITH {HEXED}, s AS (SELECT doc_id, list_distinct(list_transform(range(CASE WHEN length(h) >= 64 THEN (length(h) // 2 - 32) // 16 + 1 ELSE 0 END), lambda i: substr(h, 32 * i + 1, 64))) AS g FROM hexed) SELECT a.doc_id, len(list_concat(a.g, b.g)) > 0 AND len(list_intersect(a.g, b.g)) * 5 >= len(list_distinct(list_concat(a.g, b.g))) * 4 AS near FROM s a JOIN s b ON b.doc_id = a.doc_id + 1",
    "train_paths": r"SELECT replace(name, '\\', '/') || '/train.txt' AS path, count(*) AS n FROM sources GROUP BY 1",
    "throughputs": "SELECT metric_id, round(CASE WHEN any_value(blocks) > 0 THEN any_value(target_bytes) / 1048576.0 / any_value(blocks) END, 9) AS mib_per_second FROM domain_metrics GROUP BY metric_id",
    "close_metrics": f"WITH m AS (SELECT metric_id, any_value(bits_per_byte) AS a, any_value(nll) AS nll, any_value(target_bytes) AS n FROM domain_metrics GROUP BY metric_id), b AS (SELECT metric_id, a, CASE WHEN n > 0 AND nll >= 0 AND NOT isnan(nll) AND NOT isinf(nll) THEN nll / n / ln(2) END AS b FROM m) SELECT metric_id, abs(a - b) <= 1e-5 + 1e-3 * abs(b) AS close FROM b",
    "metrics_progress": f"WITH {SUMMARIES} SELECT max(summary_id) AS step, coalesce(arg_max(coalesce(cnt, 0), summary_id), 0) + 0.5::DOUBLE AS wall_seconds, max(summary_id % 13) AS peak_vram_mib FROM su",
    "schedule_plan": f"WITH {SEQ_ONCE} SELECT CASE WHEN lower(trim(split)) = 'val' THEN 'validation' ELSE lower(trim(split)) END AS split, 100::BIGINT AS steps, 6400::BIGINT AS positions, round(6400 / greatest(sum(len(tokens)), 1), 9) AS passes FROM seqs GROUP BY 1",
    "remap_variants": f"WITH {TOKENS}, k AS (SELECT token, pack_id, local_id FROM tk JOIN id_map ON token = global_id WHERE token BETWEEN 0 AND 511), s AS (SELECT count(*) AS n, sum(token)::BIGINT AS g, sum(pack_id)::BIGINT AS p, sum(local_id)::BIGINT AS l FROM k) SELECT 'A' AS variant, n, 0::BIGINT AS packs, g AS locals, 0::BIGINT AS back_packs, g AS back_locals FROM s UNION ALL SELECT 'C', n, 0, g, p, l FROM s UNION ALL SELECT 'D', n, p, l, p, l FROM s",
    "pack_invalid_bytes": f"WITH {SYMBOLS} SELECT doc_id, len(b) + 1 AS n, true AS bytes_only, (coalesce(list_sum(b), 0) + 255)::BIGINT AS total FROM sym",
    "bytes_hex_docs": "SELECT doc_id, sha256(lower(hex(encode(text)))) AS sha FROM documents",
    "rnn_ablation_plan": f"""WITH {PACKED}, sizes AS (SELECT count(*) AS n, count(*) FILTER (p = 0) AS first, count(DISTINCT p) AS packs FROM num),
rows AS (SELECT * FROM sizes, (SELECT count(*) AS merges FROM merges)), cost AS (SELECT v, 4 * 47 * 256 + 3 * 64 * 16 * x AS macs FROM (SELECT 'A' AS v, 256 + merges AS x FROM rows UNION ALL SELECT 'B', 3 + (256 + merges + 2) // 3 FROM rows UNION ALL SELECT 'C', 256 + n FROM rows UNION ALL SELECT 'D', packs + 1 + first FROM rows)),
u AS (SELECT v, macs, 'updates' AS regime, 12 AS n FROM cost UNION ALL SELECT v, macs, 'macs', greatest(1, round_even(12 * (SELECT macs FROM cost WHERE v = 'A') / macs, 0)) FROM cost)
SELECT v AS variant, regime, seed::BIGINT AS seed, n::BIGINT AS updates, CASE WHEN v IN ('A', 'C') THEN (macs * n)::BIGINT END AS macs, true AS scored FROM u, (VALUES (17), (29), (43)) s(seed)""",
    "train_run_steps": "SELECT seed::BIGINT AS seed, 20::BIGINT AS steps, true AS finite FROM (VALUES (17), (29), (43)) s(seed)",
    "generated_lengths": f"WITH {SEQ_ONCE} SELECT seq_id, 4 AS n FROM seqs WHERE len(tokens) > 0 AND NOT coalesce(list_bool_or(list_transform(tokens, lambda x: x < 0 OR x >= 512)), false)",
    "accept_blocks": f"""WITH RECURSIVE {UNIT_GRAMS.format(128)}, hx AS (SELECT unit_id, split, hex(encode(body)) AS h FROM un),
sg AS (SELECT DISTINCT unit_id, substr(h, 32 * i + 1, 64) AS g FROM (SELECT unit_id, h, unnest(range((length(h) // 2 - 32) // 16 + 1)) AS i FROM hx WHERE length(h) >= 64)), sn AS (SELECT unit_id, count(*) AS n FROM sg GROUP BY unit_id),
nr AS (SELECT a, b FROM (SELECT x.unit_id AS a, y.unit_id AS b, count(*) AS c FROM sg x JOIN sg y USING (g) WHERE x.unit_id <> y.unit_id GROUP BY ALL) JOIN sn p ON p.unit_id = a JOIN sn q ON q.unit_id = b WHERE c * 5 >= (p.n + q.n - c) * 4),
ps AS (SELECT DISTINCT x.unit_id AS a, y.unit_id AS b FROM grams x JOIN grams y USING (g) WHERE x.split <> 'train' AND y.split <> 'test' AND x.unit_id <> y.unit_id),
held AS (SELECT unit_id AS id, split FROM un WHERE split <> 'train'),
link AS (SELECT id, held.split, bool_or(kind = 0 AND o.split = 'train') AS pt, bool_or(kind = 1 AND o.split = 'train') AS nt, list(b) FILTER (kind = 0 AND o.split = 'validation' AND (held.split = 'test' OR b < id)) AS pv, list(b) FILTER (kind = 1 AND o.split = 'validation' AND (held.split = 'test' OR b < id)) AS nv
  FROM held LEFT JOIN (SELECT a, b, 0 AS kind FROM ps UNION ALL SELECT a, b, 1 FROM nr) e ON e.a = id LEFT JOIN un o ON o.unit_id = b GROUP BY ALL),
ord AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM link WHERE split = 'validation'),
walk(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.k, CASE WHEN coalesce(pt, false) OR coalesce(nt, false) OR len(list_intersect(kept, coalesce(pv, []))) > 0 OR len(list_intersect(kept, coalesce(nv, []))) > 0 THEN kept ELSE list_append(kept, id) END FROM walk JOIN ord o ON o.k = walk.k + 1),
fin AS (SELECT kept FROM walk ORDER BY k DESC LIMIT 1),
said AS (SELECT id, split, CASE WHEN coalesce(pt, false) OR len(list_intersect(kept, coalesce(pv, []))) > 0 THEN 'shared-128-byte' WHEN coalesce(nt, false) OR len(list_intersect(kept, coalesce(nv, []))) > 0 THEN 'near-duplicate-jaccard80' ELSE 'accepted' END AS reason FROM link, fin)
SELECT unit_id, split, true AS kept, 'accepted' AS reason FROM un WHERE split = 'train' UNION ALL SELECT id, split, reason = 'accepted', reason FROM said""",
}
#: blocks of at least n bytes, extended through the next line feed, on strings of one character per byte.
for _name, _size in (("blocks_split", 96), ("blocks_split_whole", 128)):
    _blocks = rf"""WITH {SYMBOLS}, bl AS (SELECT doc_id, regexp_extract_all(s, '[\x{{100}}-\x{{1FF}}]{{{_size}}}[^\x{{10A}}]*\x{{10A}}?|[\x{{100}}-\x{{1FF}}]{{1,{_size - 1}}}') AS bs, h FROM sym),
r AS (SELECT doc_id, h, unnest(bs) AS b, generate_subscripts(bs, 1) - 1 AS k FROM bl),
o AS (SELECT doc_id, k, h, (sum(length(b)) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS e, length(b) AS n FROM r), """
    if _name == "blocks_split":
        SQL[_name] = _blocks + "z AS (SELECT *, k % 20 AS q FROM o) SELECT doc_id, k AS block_no, e - n AS start_byte, e AS end_byte, sha256(unhex(substr(h, 2 * (e - n) + 1, 2 * n))) AS sha, CASE q WHEN 18 THEN 'validation' WHEN 19 THEN 'test' ELSE 'train' END AS split FROM z"
    else:
        SQL[_name] = _blocks + "z AS (SELECT *, (row_number() OVER (ORDER BY doc_id, k) - 1) % 20 AS q FROM o) SELECT CASE q WHEN 18 THEN 'validation' WHEN 19 THEN 'test' ELSE 'train' END AS split, count(*) AS blocks, sum(n)::BIGINT AS n_bytes FROM z GROUP BY ALL"
