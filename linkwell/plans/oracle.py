"""DuckDB SQL for the registered queries, with the same column names."""

TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
DOCS = f"docs AS (SELECT doc_id AS id, {TOK.format('text')} AS terms FROM documents)"
ASKED = f"asked AS (SELECT item_id AS qid, {TOK.format('text')} AS terms FROM benchmark)"
BM25 = f"""{DOCS}, {ASKED},
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(terms) AS term FROM asked) GROUP BY ALL),
p AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM docs),
sc AS (
  SELECT qid, id AS fid, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score
  FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY ALL),
bm AS (
  SELECT qid, fid, score, ix FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fid) - 1 AS ix FROM sc) WHERE ix < 20)"""
RUN = "[array_to_string(terms[i:i + 7], ' ') for i in range(1, len(terms) - 6)]"
TRUTH = f"""truth AS (
  SELECT qid, min(id) AS true_id FROM (SELECT qid, unnest({RUN}) AS run FROM asked WHERE len(terms) >= 8) JOIN (SELECT id, unnest({RUN}) AS run FROM docs WHERE len(terms) >= 8) USING (run) GROUP BY qid)"""
LABELLED = """lab AS (
  SELECT bm.qid, fid, ix, score / sum(score) OVER w AS share, coalesce((fid = true_id)::INT, 0) AS target, true_id,
         max(coalesce((fid = true_id)::INT, 0)) OVER w AS found
  FROM bm LEFT JOIN truth USING (qid) WINDOW w AS (PARTITION BY bm.qid)),
samples AS (
  SELECT qid, CASE WHEN miss THEN true_id ELSE fid END AS fid, CASE WHEN miss THEN 0.0 ELSE share END AS score,
         CASE WHEN miss THEN 1 ELSE target END AS target, true_id IS NOT NULL AS existing, CASE WHEN miss THEN -1 ELSE ix END AS ix
  FROM (SELECT *, true_id IS NOT NULL AND found = 0 AND ix = 0 AS miss FROM lab))"""
POS = """pos AS (
  SELECT qid AS et_id, true_id AS el_id,
         CASE WHEN min(CASE WHEN fid = true_id THEN ix END) IS NOT NULL THEN min(CASE WHEN fid = true_id THEN ix END) WHEN count(fid) = 0 THEN -1 ELSE -2 END::INT AS i
  FROM truth LEFT JOIN bm USING (qid) GROUP BY qid, true_id)"""
CODED = "coded AS (SELECT doc_id, md5(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))) AS barcode, source FROM documents)"
LINKS = f"""{CODED},
links AS (
  SELECT f.doc_id AS feed_id, min(barcode) AS barcode, min(m.doc_id) AS master_id
  FROM coded f JOIN coded m USING (barcode) WHERE f.doc_id % 2 = 1 AND m.doc_id % 2 = 0 GROUP BY f.doc_id HAVING count(*) = 1)"""
JUDGED = """judged AS (
  SELECT l.doc_id, source, toxic AS target, quality, round(((n_chars * 37 + l.doc_id * 11) % 1000) / 1000.0::DOUBLE, 3) AS prob
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
RANKED = f"""{JUDGED},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY prob DESC, doc_id) AS rn, row_number() OVER (PARTITION BY source ORDER BY target DESC, doc_id) AS ideal FROM judged)"""
NAMES = """names AS (SELECT p_name, min(p_partkey) AS id, string_split(p_name, ' ') AS terms FROM part GROUP BY p_name),
w AS (SELECT id, terms, p_name, unnest(terms) AS word FROM names),
pairs AS (SELECT DISTINCT a.id AS q_id, a.terms AS q, a.p_name AS qn, b.id AS d_id, b.terms AS d, b.p_name AS dn FROM w a JOIN w b USING (word) WHERE a.id <> b.id)"""


def matrix(name: str, score: str) -> str:
    """Mean, population deviation and quartiles, over the tokens of q, of the best score among those of d."""
    return f"""WITH {NAMES},
cells AS (SELECT q_id, d_id, i, max({score}) AS best FROM (SELECT q_id, d_id, i, q[i] AS a, unnest(d) AS b FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM pairs)) GROUP BY q_id, d_id, i)
SELECT q_id, d_id, round(avg(best), 6) AS {name}_1, round(stddev_pop(best), 6) AS {name}_2, round(quantile_cont(best, 0.25), 6) AS {name}_3,
       round(quantile_cont(best, 0.5), 6) AS {name}_4, round(quantile_cont(best, 0.75), 6) AS {name}_5
FROM cells GROUP BY q_id, d_id"""


def seeded_unit(seed: str, key: str) -> str:
    return f"('0x' || substr(md5('{seed}' || {key}), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE"


def split(seed: str, rows: str, columns: str) -> str:
    """Organisations sorted into test and train: several of one size by hash, those alone in their size one after the other."""
    a, b = columns.split(", ")
    return f"""sized AS (SELECT {a} || '/' || {b} AS org, count(*) AS n FROM {rows} GROUP BY 1),
peered AS (SELECT org, n, count(*) OVER (PARTITION BY n) AS peers, row_number() OVER (PARTITION BY n ORDER BY {seeded_unit(seed, 'org')}, org) AS place FROM sized),
lone AS (SELECT org, n, row_number() OVER (ORDER BY n) AS k FROM peered WHERE peers = 1),
walk AS (
  SELECT k, org, n, FALSE AS test, 0::BIGINT AS tested, n::BIGINT AS total FROM lone WHERE k = 1 UNION ALL
  SELECT l.k, l.org, l.n, w.tested + l.n <= 0.1::DOUBLE * (w.total + l.n), (w.tested + CASE WHEN w.tested + l.n <= 0.1::DOUBLE * (w.total + l.n) THEN l.n ELSE 0 END)::BIGINT, (w.total + l.n)::BIGINT
  FROM walk w JOIN lone l ON l.k = w.k + 1),
done AS (SELECT org, n, place <= ceil(peers * 0.1::DOUBLE) AS test FROM peered WHERE peers > 1 UNION ALL SELECT org, n, test FROM walk)"""


def gain(method: int, place: str) -> str:
    return f"target / log2({place} + 1)" if method == 1 else f"CASE WHEN {place} = 1 THEN target::DOUBLE ELSE target / log2(greatest({place}, 2)) END"


def ndcg(method: int) -> str:
    return f"""WITH {RANKED}, k AS (SELECT unnest([1, 2, 5, 6, 7, 10]) AS k),
g AS (
  SELECT source, k, sum(CASE WHEN rn <= k THEN {gain(method, 'rn')} ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= k THEN {gain(method, 'ideal')} ELSE 0 END) AS best
  FROM ranked, k GROUP BY source, k)"""


FOLD = "translate({}, 'ёй', 'еи')"
LATIN = "translate(replace({}, 'x', 'кс'), 'abcdefghijklmnopqrstuvwyz', 'абцдефгхийклмнопкрстуввыз')"
SYMBOLS = "'ъ*!\"#$&''()+-/:;<=>?@[\\]^_`{|}~'"

ORACLE_SQL = {
    "scan_project_docs": "SELECT doc_id, lang, n_chars AS chars FROM documents",
    "enrich_brand_category": """
SELECT p_partkey, trim(p_name || ' ' || CASE WHEN regexp_replace(p_brand, 'Brand#', '')::INT <= 20 THEN lower(p_brand) ELSE '' END) AS name, p_type AS category FROM part""",
    "lookup_left_missing": "SELECT s_suppkey, coalesce(lower(n_name), '') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey",
    "semi_known_keys": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "anti_known_keys": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "range_key_scan": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <= 3 AND l_quantity >= 10 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "count_scan": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "truth_unique_link": f"WITH {LINKS} SELECT * FROM links",
    "nullsafe_pair_join": """
WITH r AS (SELECT l_orderkey AS qid, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey END AS synid, l_partkey AS fid FROM lineitem),
o AS (SELECT DISTINCT qid, synid, qid % 7 AS org FROM r)
SELECT r.qid, r.synid, fid, org FROM r JOIN o ON r.qid IS NOT DISTINCT FROM o.qid AND r.synid IS NOT DISTINCT FROM o.synid""",
    "array_explode_overlap": """
SELECT conv_id, bool_or(role IN ('system', 'tool')) AS overlap, count(DISTINCT CASE WHEN role IN ('user', 'system') THEN role END) AS n_common FROM conversations GROUP BY conv_id""",
    "barcode_numbers": "SELECT event_id, try_cast(unnest(string_split(regexp_replace(props, '[^0-9,]', '', 'g'), ',')) AS BIGINT) AS code FROM events",
    "keep_first": """
SELECT conv_id, role, turn, size FROM (SELECT conv_id, role, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) WHERE k = 1""",
    "tokens_ascii": f"""
WITH {DOCS}, t AS (SELECT id, unnest(terms) AS term, unnest(range(1, len(terms) + 1)) AS pos FROM docs)
SELECT id AS doc_id, count(*) AS n_terms, count(DISTINCT term) AS n_distinct, sum(pos * length(term))::BIGINT AS checksum FROM t GROUP BY id""",
    "char_clean_fold": f"""
SELECT doc_id, md5({FOLD.format("translate(regexp_replace(lower(text), '[^\\x20-\\x7EЁ-ё]', ' ', 'g'), " + SYMBOLS + ", '                              ')")}) AS clean_md5 FROM documents""",
    "number_boundary_split": """
SELECT p_partkey, p_name || ' ' || p_size || ' mm ' || replace(p_retailprice::DECIMAL(12,2)::VARCHAR, ',', '.') || ' kg' AS split FROM part""",
    "number_mask": "SELECT p_partkey, p_name || ' <NUMBER> <NUMBER>' AS masked FROM part",
    "unit_expand": """
SELECT p_partkey, 'size ' || (p_size + 10) || CASE p_partkey % 6 WHEN 0 THEN ' грамм' WHEN 1 THEN ' мл' WHEN 2 THEN ' кг' WHEN 3 THEN ' мм' WHEN 4 THEN ' см' ELSE '' END AS expanded FROM part""",
    "unique_tokens_ordered": f"""
WITH {DOCS}, t AS (SELECT id, unnest(terms) AS term, unnest(range(1, len(terms) + 1)) AS pos FROM docs),
f AS (SELECT id, term, min(pos) AS pos FROM t GROUP BY id, term),
g AS (SELECT id, md5(string_agg(term, ' ' ORDER BY pos)) AS m FROM f GROUP BY id)
SELECT docs.id AS doc_id, coalesce(m, md5('')) AS unique_md5 FROM docs LEFT JOIN g USING (id)""",
    "stopword_length_filter": """
WITH k AS (
  SELECT doc_id, [t for t in regexp_split_to_array(lower(text), '[ \\t\\n\\r]+') if length(t) BETWEEN 2 AND 100 AND NOT list_contains(['the', 'of', 'and', 'to', 'in', 'is', 'that', 'for', 'de', 'la', 'le', 'der', 'die', 'und'], t)] AS kept
  FROM documents)
SELECT doc_id, len(kept)::INT AS n_kept, md5(array_to_string(kept, ' ')) AS kept_md5 FROM k""",
    "org_parse": "SELECT doc_id, source AS org FROM documents",
    "product_text": """
WITH t AS (SELECT p_partkey, lower(p_brand) AS brand, string_split(lower(p_name) || ' ' || lower(p_type) || ' ' || lower(p_name) || ' ' || lower(p_type), ' ') AS ws FROM part),
u AS (SELECT p_partkey, brand, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM t),
f AS (SELECT p_partkey, brand, w, min(pos) AS pos FROM u GROUP BY ALL),
g AS (SELECT p_partkey, brand, string_agg(w, ' ' ORDER BY pos) AS text FROM f GROUP BY ALL)
SELECT p_partkey, CASE WHEN contains(text, brand) THEN text ELSE text || ' ' || brand END AS text FROM g""",
    "tokenize_names": f"""
WITH t AS (SELECT p_partkey, p_size, lower(p_name) AS n, regexp_replace(lower(p_brand), 'brand#', '') AS b FROM part)
SELECT p_partkey,
       {LATIN.format("n || CASE WHEN p_size > 9 THEN ' ' || p_size ELSE '' END")} || ' грамм {'бранд'}' || CASE WHEN length(b) > 1 THEN ' ' || b ELSE '' END || ' 3.2%' AS tokens,
       {LATIN.format("n")} || ' ' || p_size || '.0 грамм ' || {LATIN.format("'brand#'")} || b || ' 3.2' AS normal
FROM t""",
    "index_documents": f"""
WITH k AS (SELECT length(p_type) AS id, min(p_type) AS name FROM part GROUP BY 1),
t AS (SELECT p_partkey, p_size, p_type, lower(p_name) AS n FROM part)
SELECT p_partkey AS id, {LATIN.format("n || CASE WHEN p_size < 30 THEN ' brand' || CASE WHEN p_size > 9 THEN ' ' || p_size ELSE '' END ELSE '' END")} AS name,
       length(p_type)::BIGINT AS "categoryId", k.name AS "categoryName", p_partkey::VARCHAR AS barcodes, NULL::VARCHAR AS source,
       {LATIN.format("lower(p_type)")} AS "unitName", {LATIN.format("lower(p_type) || ' ' || n")} AS synonyms
FROM t JOIN k ON k.id = length(p_type)""",
    "url_quote": "SELECT page_id, replace(url_encode(url), '%2F', '/') AS quoted FROM pages",
    "analysed_terms": r"""
WITH k AS (SELECT doc_id, [t for t in regexp_split_to_array(lower(text), '\s+') if length(t) BETWEEN 2 AND 100] AS kept FROM documents)
SELECT doc_id, len(kept)::INT AS n_terms, md5(array_to_string(kept, ' ')) AS terms_md5 FROM k""",
    "token_chunks": f"""
WITH {DOCS}, t AS (SELECT id, (pos - 1) // 64 AS k, pos, term FROM (SELECT id, unnest(terms) AS term, unnest(range(1, len(terms) + 1)) AS pos FROM docs))
SELECT id AS doc_id, k::INT AS k, md5(string_agg(term, ' ' ORDER BY pos)) AS chunk_md5 FROM t GROUP BY id, k""",
    "synonym_names": "SELECT p_partkey AS qid, CASE p_partkey % 3 WHEN 1 THEN p_partkey WHEN 2 THEN -1 END AS synid, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type || ' ' || p_name END AS name FROM part",
    "all_names": "SELECT p_partkey AS id, p_type || ' ' || p_name || '|' || reverse(p_name) AS names FROM part",
    "lookup_existing": "SELECT s_suppkey, s_nationkey, (SELECT min(c_custkey) FROM customer WHERE c_nationkey = s_nationkey AND c_nationkey < 15) AS existing FROM supplier",
    "known_words": """
SELECT p_partkey, array_to_string([w for w in string_split(p_name, ' ') if w NOT LIKE 'b%'], ' ') AS known FROM part""",
    "bm25_two_fields": f"""
WITH docs AS (
  SELECT p_partkey AS id, unnest(['name', 'synonyms']) AS field, unnest([5.0::DOUBLE, 1.0::DOUBLE]) AS boost,
         unnest([string_split(lower(p_name || ' ' || p_brand), ' '), string_split(lower(p_type || ' ' || p_name), ' ')]) AS terms FROM part),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT min(p_partkey) AS qid, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS term FROM part GROUP BY p_name, p_type) GROUP BY ALL),
p AS (SELECT id, field, boost, term, dl, count(*) AS tf FROM (SELECT id, field, boost, len(terms) AS dl, unnest(terms) AS term FROM docs) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
st AS (SELECT field, count(*) AS n, avg(len(terms)) AS mean FROM docs GROUP BY field),
sc AS (
  SELECT qid, id AS fid, round(sum(boost * qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / mean)))), 6) AS score
  FROM q JOIN p USING (term) JOIN df USING (field, term) JOIN st USING (field) GROUP BY ALL)
SELECT qid, fid, score, ix::INT AS ix FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fid) - 1 AS ix FROM sc) WHERE ix < 20""",
    "pair_dataset": f"""
WITH {NAMES},
t AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM names) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM names),
r AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN df USING (term), n),
u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM r),
dot AS (SELECT q_id, d_id, sum(x.w * y.w) AS dot FROM pairs JOIN u x ON x.id = q_id JOIN u y ON y.id = d_id AND y.term = x.term GROUP BY q_id, d_id),
v AS (SELECT id, pos, [ascii(term) - 96, ascii(right(term, 1)) - 96, length(term)]::DOUBLE[] AS v FROM (SELECT id, unnest(terms) AS term, unnest(range(1, len(terms) + 1)) AS pos FROM names) WHERE term NOT LIKE 'b%'),
m AS (SELECT id, [avg(v[1]), avg(v[2]), avg(v[3])] AS m FROM v GROUP BY id),
e AS (SELECT q_id, d_id, a.pos, min(1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v))) AS least FROM pairs JOIN v a ON a.id = q_id JOIN v b ON b.id = d_id GROUP BY ALL),
f AS (SELECT q_id, d_id, avg(least) AS f1, quantile_cont(least, 0.5) AS f2, stddev_pop(least) AS f3 FROM e GROUP BY ALL),
g AS (SELECT q_id, d_id, 1 - list_dot_product(a.m, b.m) / sqrt(list_dot_product(a.m, a.m)) / sqrt(list_dot_product(b.m, b.m)) AS f0 FROM pairs JOIN m a ON a.id = q_id JOIN m b ON b.id = d_id),
s AS (SELECT q_id, d_id, q, d, qn, dn, len(list_distinct(q)) AS a, len(list_distinct(d)) AS b, len(list_intersect(list_distinct(q), list_distinct(d))) AS c FROM pairs)
SELECT s.q_id AS qid, NULL::BIGINT AS synid, s.d_id AS fid, ((s.q_id + s.d_id) % 2)::INT AS target, round(c / len(q), 6) AS score, (s.d_id % 20)::DOUBLE AS ix,
       len(q)::DOUBLE AS q_len, len(d)::DOUBLE AS d_len, round(len(q) / len(d), 6) AS q_per_d, length(qn)::DOUBLE AS q_clen, length(dn)::DOUBLE AS d_clen, round(length(qn) / length(dn), 6) AS c_q_per_d,
       round(c / (a + b - c), 6) AS jaccard_tok, round(2 * c / (a + b), 6) AS tversky_tok, round(c / least(a, b), 6) AS overlap_tok,
       round(1 - coalesce(dot, 0), 6) AS tfidf0, round(coalesce(f0, -1), 6) AS fasttext0, round(coalesce(f1, -1), 6) AS fasttext1, round(coalesce(f2, -1), 6) AS fasttext2, round(coalesce(f3, -1), 6) AS fasttext3
FROM s LEFT JOIN dot USING (q_id, d_id) LEFT JOIN f USING (q_id, d_id) LEFT JOIN g USING (q_id, d_id)""",
    "doc_freq": f"WITH {DOCS} SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY term",
    "term_freq": f"""
WITH {DOCS}, p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM docs) GROUP BY ALL)
SELECT term, sum(tf)::BIGINT AS tf, max(tf) AS max_tf FROM p GROUP BY term""",
    "bm25_topk": f"WITH {BM25} SELECT qid, fid, score, ix::INT AS ix FROM bm",
    "score_share_flag": f"WITH {BM25}, {TRUTH}, {LABELLED} SELECT qid, fid, ix::INT AS ix, round(share, 6) AS share, found FROM lab",
    "miss_replacement": f"WITH {BM25}, {TRUTH}, {LABELLED} SELECT qid, fid, round(score, 6) AS score, target, existing, ix::INT AS ix FROM samples",
    "positions": f"WITH {BM25}, {TRUTH}, {POS} SELECT et_id, el_id, i FROM pos",
    "recall_at_n": f"""
WITH {BM25}, {TRUTH}, {POS}, c AS (SELECT i, count(*) AS c FROM pos GROUP BY i), t AS (SELECT sum(c) AS t FROM c)
SELECT n, round(c / t, 6) AS share, round(u / t, 6) AS recall FROM (SELECT i + 1 AS n, c, sum(c) OVER (ORDER BY i) AS u FROM c WHERE i >= 0), t""",
    "recall_scale": f"WITH {BM25}, {TRUTH}, {LABELLED} SELECT round(avg(CASE WHEN ix <> -1 THEN 1.0 ELSE 0.0 END), 6) AS recall_scale FROM samples WHERE target = 1",
    "negatives_seeded": f"""
WITH {LINKS}
SELECT feed_id AS doc_id, TRUE AS matched FROM links UNION ALL
SELECT doc_id, FALSE FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5('s1' || doc_id)) AS k FROM coded WHERE doc_id % 2 = 1 AND doc_id NOT IN (SELECT feed_id FROM links))
WHERE k <= (SELECT count(*) FROM links)""",
    "shuffled_rows": "SELECT c_custkey, row_number() OVER (ORDER BY md5('s2' || c_custkey), c_custkey) AS place FROM customer",
    "positions_by_barcode": f"""
WITH {BM25}, a AS (SELECT item_id AS qid, [length(text) % 97, item_id % 89 + 100] AS codes FROM benchmark), d AS (SELECT doc_id AS fid, [length(text) % 97, doc_id % 89 + 100] AS codes FROM documents),
h AS (SELECT a.qid, min(CASE WHEN list_has_any(a.codes, d.codes) THEN ix END) AS i, count(bm.fid) AS n FROM a LEFT JOIN bm USING (qid) LEFT JOIN d USING (fid) GROUP BY a.qid)
SELECT h.qid AS et_id, CASE WHEN i IS NOT NULL THEN bm.fid WHEN n > 0 THEN h.qid END AS el_id, coalesce(i, CASE WHEN n = 0 THEN -1 ELSE -2 END)::INT AS i
FROM h LEFT JOIN bm ON bm.qid = h.qid AND bm.ix = h.i""",
    "org_split": f"WITH RECURSIVE {split('split', 'documents', 'source, lang')} SELECT org, n, test FROM done",
    "nested_split": f"""
WITH RECURSIVE {split('test', 'documents', 'source, lang')},
rest AS (SELECT * FROM documents WHERE source || '/' || lang NOT IN (SELECT org FROM done WHERE test)),
{split('vali', 'rest', 'source, lang').replace('done', 'vdone').replace('sized', 'vsized').replace('peered', 'vpeered').replace('lone', 'vlone').replace('walk', 'vwalk')},
p AS (SELECT CASE WHEN source || '/' || lang IN (SELECT org FROM done WHERE test) THEN 'test' WHEN source || '/' || lang IN (SELECT org FROM vdone WHERE test) THEN 'vali' ELSE 'train' END AS part FROM documents)
SELECT t.part, count(p.part) AS n FROM (SELECT unnest(['train', 'vali', 'test']) AS part) t LEFT JOIN p USING (part) GROUP BY t.part""",
    "hash_split": f"SELECT doc_id, {seeded_unit('test', 'source')} < 0.1 AS test, {seeded_unit('vali', 'source')} < 0.1 AS vali FROM documents",
    "pair_noise_filter": f"""
WITH {BM25}, {TRUTH}, {LABELLED}
SELECT qid, fid, target, len(asked.terms)::INT AS q_len, len(docs.terms)::INT AS d_len FROM samples JOIN asked USING (qid) JOIN docs ON docs.id = fid
WHERE len(asked.terms) > 0 AND len(docs.terms) > 0 AND NOT (target = 0 AND asked.terms = docs.terms)""",
    "length_features": f"""
WITH {NAMES}
SELECT q_id, d_id, len(q)::DOUBLE AS q_len, len(d)::DOUBLE AS d_len, round(len(q) / len(d), 6) AS q_per_d, length(qn)::DOUBLE AS q_clen, length(dn)::DOUBLE AS d_clen, round(length(qn) / length(dn), 6) AS c_q_per_d FROM pairs""",
    "levenshtein_matrix": matrix("lvn", "1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE"),
    "jaro_features": matrix("jaro", "jaro_similarity(a, b)"),
    "jaro_winkler_features": matrix("jaro_win", "jaro_similarity(a, b) + 0.1::DOUBLE * (1 - jaro_similarity(a, b)) * len([i for i in range(1, least(length(a), length(b), 4) + 1) if substr(a, 1, i) = substr(b, 1, i)])"),
    "token_set_features": f"""
WITH {NAMES}, s AS (SELECT q_id, d_id, len(list_distinct(q)) AS n, len(list_distinct(d)) AS m, len(list_intersect(list_distinct(q), list_distinct(d))) AS c FROM pairs)
SELECT q_id, d_id, round(c / (n + m - c), 6) AS jaccard_tok, round(2 * c / (n + m), 6) AS tversky_tok, round(c / least(n, m), 6) AS overlap_tok FROM s""",
    "qgram_distance": f"""
WITH {NAMES}, g AS (
  SELECT q_id, d_id, substr(qn, i, 2) AS gram, 1 AS v FROM (SELECT q_id, d_id, qn, unnest(range(1, length(qn))) AS i FROM pairs) UNION ALL
  SELECT q_id, d_id, substr(dn, i, 2), -1 FROM (SELECT q_id, d_id, dn, unnest(range(1, length(dn))) AS i FROM pairs))
SELECT q_id, d_id, sum(abs(v))::DOUBLE AS qgram FROM (SELECT q_id, d_id, gram, sum(v) AS v FROM g GROUP BY ALL) GROUP BY q_id, d_id""",
    "prefix_suffix": f"""
WITH {NAMES}, c AS (
  SELECT q_id, d_id, greatest(length(qn), length(dn)) AS m,
         len([i for i in range(1, least(length(qn), length(dn)) + 1) if substr(qn, 1, i) = substr(dn, 1, i)]) AS p,
         len([i for i in range(1, least(length(qn), length(dn)) + 1) if right(qn, i) = right(dn, i)]) AS s
  FROM pairs)
SELECT q_id, d_id, round(1 - p / m, 6) AS prefix, round(1 - s / m, 6) AS postfix FROM c""",
    "tfidf_cosine": f"""
WITH {DOCS}, t AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM docs WHERE len(terms) > 0),
r AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN df USING (term), n),
u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM r),
p AS (SELECT a.id AS q, b.id AS d FROM docs a JOIN docs b ON b.id = a.id + 1 WHERE len(a.terms) > 0 AND len(b.terms) > 0),
dot AS (SELECT q, d, sum(x.w * y.w) AS dot FROM p JOIN u x ON x.id = q JOIN u y ON y.id = d AND y.term = x.term GROUP BY q, d)
SELECT p.q, p.d, round(1 - coalesce(dot, 0), 6) AS distance FROM p LEFT JOIN dot ON p.q = dot.q AND p.d = dot.d""",
    "embedding_cosine_topk": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS q, b.vec_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT q, vec_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "embedding_pair_stats": """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e),
m AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS m FROM p GROUP BY ALL) GROUP BY label)
SELECT vec_id, round(1 - list_dot_product(v, m) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(m, m))), 6) AS distance FROM e JOIN m USING (label)""",
    "embedding_set_distances": """
WITH e AS (SELECT vec_id, vec_id // 50 AS g, embedding::DOUBLE[] AS v FROM embeddings),
c AS (
  SELECT a.g, a.vec_id, min(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))) AS d
  FROM e a JOIN e b ON b.g = a.g + 1 GROUP BY a.g, a.vec_id)
SELECT g, round(avg(d), 6) AS mean_min, round(quantile_cont(d, 0.5), 6) AS median_min, round(stddev_pop(d), 6) AS std_min FROM c GROUP BY g""",
    "group_has_both": """
WITH r AS (SELECT source AS qid, d.doc_id, toxic AS target FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT * FROM r WHERE qid IN (SELECT qid FROM r GROUP BY qid HAVING min(target) <> max(target))""",
    "standard_scale": """
SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS quantity,
       round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS price FROM lineitem""",
    "letor_rows": """
WITH r AS (SELECT *, dense_rank() OVER (ORDER BY l_orderkey) AS g, (l_returnflag = 'R')::INT AS target FROM lineitem)
SELECT g AS group_no, l_linenumber, printf('%d qid:%d 1:%.6f 2:%.6f', target, g, l_quantity::DOUBLE, l_discount::DOUBLE) AS line FROM r""",
    "group_sizes": """
WITH r AS (SELECT *, dense_rank() OVER (ORDER BY l_orderkey) AS g FROM lineitem)
SELECT g AS group_no, count(*) AS n, sum((l_returnflag = 'R')::INT)::BIGINT AS positives FROM r GROUP BY g""",
    "list_truncate": "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) WHERE k <= 3",
    "list_discards": "SELECT count(*) AS lists, sum(n)::BIGINT AS docs, sum(greatest(n - 3, 0))::BIGINT AS discarded FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)",
    "dcg_ndcg_at_k": f"{ndcg(1)} SELECT source, k, round(dcg, 6) AS dcg, round(CASE WHEN best = 0 THEN 0 ELSE dcg / best END, 6) AS ndcg FROM g",
    "mean_ndcg": f"{ndcg(0)} SELECT k, round(avg(CASE WHEN best = 0 THEN 0 ELSE dcg / best END), 4) AS ndcg FROM g GROUP BY k",
    "first_relevant": f"WITH {RANKED} SELECT source, (min(CASE WHEN target > 0 THEN rn END) - 1)::INT AS pos FROM ranked GROUP BY source",
    "ordered_pair_accuracy": f"""
WITH {RANKED}, c AS (SELECT *, sum(target) OVER (PARTITION BY source ORDER BY rn) AS before FROM ranked),
g AS (SELECT source, (sum(target) * sum(1 - target))::BIGINT AS pairs, sum(CASE WHEN target = 0 THEN before ELSE 0 END)::BIGINT AS correct FROM c GROUP BY source)
SELECT source, pairs, correct, round(CASE WHEN pairs > 0 THEN correct / pairs END, 6) AS opa FROM g""",
    "arp": f"WITH {RANKED} SELECT source, round(CASE WHEN sum(target) > 0 THEN sum(rn * target) / sum(target) END, 6) AS arp FROM ranked GROUP BY source",
    "classification_report": f"""
WITH {JUDGED}, s AS (
  SELECT count(*) FILTER (target = 1 AND prob >= 0.4) AS tp, count(*) FILTER (target = 0 AND prob >= 0.4) AS fp,
         count(*) FILTER (target = 1 AND prob < 0.4) AS fn, count(*) FILTER (target = 0 AND prob < 0.4) AS tn FROM judged)
SELECT round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, tp + fn AS support,
       round((tn + fp) / (tp + fp + fn + tn), 4) AS base_accuracy, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy FROM s""",
    "confusion": f"WITH {JUDGED} SELECT target AS label, (prob >= 0.5)::INT AS pred, count(*) AS n FROM judged GROUP BY ALL",
    "pr_curve": f"""
WITH {JUDGED}, b AS (SELECT prob AS threshold, sum(target) AS p, count(*) AS n FROM judged GROUP BY prob)
SELECT threshold, round(sum(p) OVER w / sum(n) OVER w, 6) AS precision, round(sum(p) OVER w / sum(p) OVER (), 6) AS recall FROM b WINDOW w AS (ORDER BY threshold DESC)""",
    "pr_curve_ap": f"""
WITH {JUDGED}, b AS (SELECT prob AS threshold, sum(target) AS p, count(*) AS n FROM judged GROUP BY prob),
c AS (SELECT threshold, sum(p) OVER w / sum(n) OVER w AS precision, p / sum(p) OVER () AS step FROM b WINDOW w AS (ORDER BY threshold DESC))
SELECT round(sum(step * precision), 6) AS ap FROM c""",
    "abstain_curve": f"""
WITH {BM25}, {TRUTH}, {LABELLED}, {RANKED}, tops AS (SELECT unnest([1, 2, 3, 5, 10, 20]) AS topn), h AS (SELECT unnest(range(0, 101)) / 100.0::DOUBLE AS threshold),
g AS (SELECT source, topn, max(prob) AS pmax, max(target) AS has, max(CASE WHEN rn <= topn THEN target ELSE 0 END) AS hit FROM ranked, tops GROUP BY ALL),
c AS (
  SELECT topn, threshold, count(*) FILTER (has = 1 AND hit = 1 AND pmax >= threshold) AS tp, count(*) FILTER (pmax >= threshold AND (has = 0 OR hit = 0)) AS fp,
         count(*) FILTER (has = 0 AND pmax < threshold) AS tn, count(*) FILTER (has = 1 AND pmax < threshold) AS fn FROM g, h GROUP BY ALL),
scale AS (SELECT avg(CASE WHEN ix <> -1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS scale FROM samples WHERE target = 1),
shares AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS prec, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS rec FROM c)
SELECT topn, threshold, tp, fp, tn, fn, round(prec, 6) AS precision, round(rec * scale, 6) AS recall, round(avg(prec) OVER (PARTITION BY topn), 6) AS mean_precision FROM shares, scale""",
    "error_sheet": f"""
WITH {JUDGED} SELECT j.doc_id AS qid, j.doc_id AS fid, prob, target, CASE WHEN target = 0 THEN 1 ELSE 2 END AS error_type, d.source AS q, text AS d
FROM judged j JOIN documents d ON j.doc_id = d.doc_id WHERE (target = 0 AND prob > 0.9) OR (target = 1 AND prob < 0.1)""",
    "type_errors": f"""
WITH {JUDGED} SELECT doc_id, prob, target, CASE WHEN target = 0 THEN 1 ELSE 2 END AS error_type FROM judged WHERE (target = 0 AND prob > 0.9) OR (target = 1 AND prob < 0.1)""",
    "prob_histogram": f"""
WITH {JUDGED}, b AS (SELECT target, least(floor(prob * 20), 19)::INT AS bin, count(*) AS n FROM judged GROUP BY ALL)
SELECT target, bin, n, round(n * 20 / sum(n) OVER (PARTITION BY target), 6) AS density FROM b""",
    "group_best_prob": f"WITH {JUDGED} SELECT source, max(prob) AS best, max(target) AS has FROM judged GROUP BY source",
    "match_share": f"WITH {JUDGED} SELECT round(avg(has), 6) AS share FROM (SELECT max(target) AS has FROM judged GROUP BY source)",
    "describe_prob": f"""
WITH {JUDGED} SELECT count(prob) AS n, round(avg(prob), 6) AS mean, round(stddev_samp(prob), 6) AS std, min(prob) AS lo, round(quantile_cont(prob, 0.25), 6) AS q1,
       round(quantile_cont(prob, 0.5), 6) AS q2, round(quantile_cont(prob, 0.75), 6) AS q3, max(prob) AS hi FROM judged""",
    "precision_at_cut": f"WITH {JUDGED} SELECT count(*) AS n, round(avg(target), 6) AS precision FROM judged WHERE prob > 0.8",
    "org_frequencies": "SELECT source, n, round(n / sum(n) OVER (), 6) AS freq FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) ORDER BY n DESC, source LIMIT 40",
    "size_classes": "SELECT n, count(*) AS orgs, string_agg(source, ',' ORDER BY source) AS members FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) GROUP BY n",
    "watch_list": f"WITH {JUDGED} SELECT j.source, j.doc_id, target, prob, text FROM judged j JOIN documents d ON j.doc_id = d.doc_id",
}
#: An index that has grown answers as one built at once.
ORACLE_SQL |= {"segment_topk": ORACLE_SQL["bm25_topk"], "segment_two_fields": ORACLE_SQL["bm25_two_fields"]}
