"""DuckDB twins of the registered queries."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- derived collections

PLAIN = "plain AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings)"
TEXT = f"""{PLAIN},
tc AS (
  SELECT coalesce(e.id, d.doc_id) AS id, e.vector, e.label, d.text, d.lang, d.source, d.n_chars
  FROM plain e FULL OUTER JOIN documents d ON e.id = d.doc_id
)"""
COLL = f"""{TEXT},
c AS (SELECT tc.*, v.ts - (tc.id % 4) * INTERVAL 100 DAY AS created_at FROM tc LEFT JOIN events v ON v.event_id = tc.id)"""
DUP = f"""{TEXT},
base AS (SELECT * FROM tc WHERE vector IS NOT NULL),
dup AS (
  SELECT * FROM base
  UNION ALL SELECT id + 1000000, vector, label, text, lang, source, n_chars FROM base WHERE id % 10 = 0
  UNION ALL SELECT id + 2000000, list_transform(vector, lambda x, i: CASE WHEN i = 1 THEN x + 0.05 ELSE x END),
    label + 1, text, lang, source, n_chars FROM base WHERE id % 10 = 1
)"""
MIXED = f"""{PLAIN},
mixed AS (SELECT id, list_transform(vector, lambda x: x * CASE WHEN label % 2 = 0 THEN 1.0 ELSE 2.0 END) AS vector, label FROM plain)"""
POINTS = f"{PLAIN}, pts AS (SELECT id, vector[1] AS x, vector[2] AS y, vector[3] AS z FROM plain)"
AGES = f"""{COLL},
ages AS (
  SELECT id, trunc(epoch_us(TIMESTAMP '2024-06-01' ) / 3600e6 - epoch_us(created_at) / 3600e6) AS h0,
    ((epoch_us(TIMESTAMP '2024-06-01') - epoch_us(created_at)) // 3600000000) AS age_hours
  FROM c WHERE created_at IS NOT NULL
), aged AS (SELECT id, age_hours, age_hours / 24.0::DOUBLE AS age_days FROM ages)"""
CENTROIDS = f"""{PLAIN},
cells AS (SELECT id, label AS cluster, unnest(vector) AS x, generate_subscripts(vector, 1) AS d FROM plain),
means AS (SELECT cluster, d, avg(x) AS x FROM cells GROUP BY ALL),
cent AS (SELECT cluster, list(x ORDER BY d) AS centroid FROM means GROUP BY cluster)"""


def R(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def meta_json(fields: str = "tc") -> str:
    """Keys sorted, nulls kept."""
    return "to_json({'label': label, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text})::VARCHAR"


BLANK = r"regexp_full_match({0}, '\s*')"
TRIM = r"regexp_replace({0}, '^[\s\x0B\x{{85}}\p{{Z}}]+|[\s\x0B\x{{85}}\p{{Z}}]+$', '', 'g')"


def trimmed(col: str) -> str:
    return TRIM.format(col)


def add(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


# ---------------------------------------------------------------- sources and sinks

add("s1_offset_page", f"""
WITH {TEXT} SELECT id, label, lang, (SELECT count(*) FROM tc) AS total FROM tc ORDER BY id LIMIT 50 OFFSET 100""")
add("s2_keyset_page", f"WITH {TEXT} SELECT id, label, lang FROM tc WHERE id > 123 ORDER BY id LIMIT 50")
add("s2_page_of_layout", f"WITH {TEXT} SELECT id, label, lang FROM tc WHERE id > 123 ORDER BY id LIMIT 50")
add("s1_page_of_layout", f"WITH {TEXT} SELECT id, label, lang FROM tc ORDER BY id LIMIT 30 OFFSET 95")
add("s2_next_cursor", f"""
WITH {TEXT}, page AS (SELECT id FROM tc WHERE id > 123 ORDER BY id LIMIT 50)
SELECT CASE WHEN count(*) = 50 THEN max(id) END AS next_cursor FROM page""")
add("s3_full_scan", f"WITH {TEXT} SELECT id, label, lang, source, n_chars FROM tc")

INFO = """SELECT '{0}' AS name, count(*) AS count, max(len(vector))::INT AS vector_dimensions, '{2}' AS properties FROM {1}"""
TEXT_PROPS = "label,lang,n_chars,source,text"
add("s4_collection_profile", f"""
WITH {COLL}, {DUP.split('base AS', 1)[1].join(['base AS', ''])}, {MIXED.split(',', 1)[1] if False else MIXED[len(PLAIN) + 2:]}
{INFO.format('collection', 'c', 'created_at,' + TEXT_PROPS)}
UNION ALL {INFO.format('collection_dup', 'dup', TEXT_PROPS)}
UNION ALL {INFO.format('collection_mixed', 'mixed', 'label')}
UNION ALL SELECT 'chunks', count(*), NULL, 'lang,source,text' FROM documents""")
add("s5_collection_info", f"WITH {DUP} {INFO.format('collection_dup', 'dup', TEXT_PROPS)}")
add("s6_row_normaliser", f"""
WITH {TEXT} SELECT id::VARCHAR AS id, len(vector)::INT AS width, {meta_json()} AS metadata FROM tc WHERE vector IS NOT NULL""")
add("s7_export_vectors", f"""
WITH {TEXT} SELECT id::VARCHAR AS id,
  coalesce('[' || array_to_string(list_transform(vector, lambda x: floor(x * 1000)::VARCHAR), ';') || ']', '') AS vector,
  {meta_json()} AS metadata FROM tc""")
ORPHANS = f"""{TEXT},
m AS (SELECT *, list_filter([CASE WHEN text IS NULL OR {BLANK.format('text')} THEN 'text' END, CASE WHEN label IS NULL THEN 'label' END], lambda f: f IS NOT NULL) AS absent FROM tc)"""
add("s8_export_orphans", f"""
WITH {ORPHANS}
SELECT id::VARCHAR AS id, CASE WHEN vector IS NULL THEN 'missing_vector' ELSE 'missing_metadata' END AS reason,
  CASE WHEN vector IS NULL THEN 'vector' ELSE array_to_string(absent, ';') END AS missing_fields, '' AS last_updated, {meta_json()} AS metadata
FROM m WHERE vector IS NULL OR len(absent) > 0""")

# duplicate cascade: exact vectors, then components of near vectors, then texts
CASCADE = DUP.replace("WITH ", "") + """,
exact AS (SELECT 'exact' AS kind, min(id) OVER (PARTITION BY vector) AS first_id, id, count(*) OVER (PARTITION BY vector) AS n FROM dup),
exactm AS (SELECT kind, first_id, id FROM exact WHERE n > 1),
rest AS (SELECT id, vector FROM dup WHERE id NOT IN (SELECT id FROM exactm)),
link AS (SELECT a.id AS u, b.id AS v FROM rest a, rest b WHERE a.id <> b.id AND list_cosine_similarity(a.vector, b.vector) >= 0.98),
reach AS (
  SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u
),
nearm AS (SELECT 'near_duplicate' AS kind, least(u, min(v)) AS first_id, u AS id FROM reach GROUP BY u),
taken AS (SELECT id FROM exactm UNION ALL SELECT id FROM nearm),
form AS (SELECT id, lower(""" + trimmed("text") + """) AS f FROM dup WHERE text IS NOT NULL AND id NOT IN (SELECT id FROM taken)),
textg AS (SELECT 'text_hash' AS kind, min(id) OVER (PARTITION BY f) AS first_id, id, count(*) OVER (PARTITION BY f) AS n FROM form WHERE f <> ''),
textm AS (SELECT kind, first_id, id FROM textg WHERE n > 1),
members AS (SELECT * FROM exactm UNION ALL SELECT * FROM nearm UNION ALL SELECT * FROM textm),
sims AS (
  SELECT a.first_id, avg(list_cosine_similarity(x.vector, y.vector)) AS s
  FROM nearm a JOIN nearm b ON a.first_id = b.first_id AND a.id < b.id JOIN dup x ON x.id = a.id JOIN dup y ON y.id = b.id GROUP BY 1
),
grp AS (
  SELECT m.kind || '_' || m.first_id AS group_id, m.kind, m.first_id, count(*) AS size,
    CASE WHEN m.kind = 'near_duplicate' THEN any_value(s.s) ELSE 1.0 END AS similarity,
    array_to_string(list(m.id ORDER BY m.id), ';') AS vector_ids
  FROM members m LEFT JOIN sims s ON s.first_id = m.first_id GROUP BY m.kind, m.first_id
)"""
CASCADE = "RECURSIVE " + CASCADE
add("s9_export_duplicates", f"""
WITH {CASCADE}
SELECT group_id, kind AS type, {R('similarity')} AS similarity, 0 AS part, vector_ids, {meta_json()} AS sample_metadata
FROM grp JOIN dup ON dup.id = grp.first_id""")
OUTLIERS = f"""{CENTROIDS},
own AS (SELECT p.id, list_distance(p.vector, cent.centroid) AS dist FROM plain p JOIN cent ON p.label = cent.cluster),
st AS (SELECT avg(dist) AS m, stddev_pop(dist) AS s FROM own),
outl AS (SELECT id, dist AS distance_to_cluster, (dist - m) / s AS outlier_score FROM own, st WHERE dist > m + 1.5 * s)"""
add("s10_export_outliers", f"""
WITH {OUTLIERS}, {TEXT[len(PLAIN) + 2:]}
SELECT o.id::VARCHAR AS id, {R('distance_to_cluster')} AS distance_to_cluster, {R('outlier_score')} AS outlier_score, {meta_json()} AS metadata
FROM outl o JOIN tc ON tc.id = o.id""")
add("s12_csv_roundtrip", f"WITH {TEXT} SELECT id::VARCHAR AS id, {meta_json()} AS metadata FROM tc")
add("s13_manifest", f"""
WITH {TEXT} SELECT 'csv' AS format, 'vectors' AS data_type, count(*) AS record_count, 'docs_vectors_20240601_000000.csv' AS filename FROM tc""")

HASH = "('0x' || left(md5({0}::VARCHAR), 15))::BIGINT"
add("s15_id_fingerprint", f"WITH {COLL} SELECT count(*) AS n, bit_xor({HASH.format('id')}) AS id_hash FROM c")

# ---------------------------------------------------------------- filters and predicates

add("f14_hash_sample", f"SELECT vec_id AS id FROM embeddings WHERE {HASH.format('vec_id')} % 1000000 < 300000")

add("f1_empty_values", """
WITH j AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '{"f":null}' WHEN 1 THEN '{"f":"  "}' WHEN 2 THEN '{"f":[]}' WHEN 3 THEN '{"f":{}}'
  WHEN 4 THEN '{"f":"[]"}' WHEN 5 THEN '{}' WHEN 6 THEN '{"f":0}' ELSE to_json({'f': source})::VARCHAR END AS m FROM documents)
SELECT doc_id AS id, coalesce(CASE json_type(m, '$.f') WHEN 'NULL' THEN true WHEN 'VARCHAR' THEN trim(m ->> '$.f') = ''
  WHEN 'ARRAY' THEN json_array_length(m, '$.f') = 0 WHEN 'OBJECT' THEN len(json_keys(m, '$.f')) = 0 ELSE json_type(m, '$.f') IS NULL END, true) AS empty
FROM j""")
add("f2_has_embedding", f"WITH {TEXT} SELECT id FROM tc WHERE vector IS NOT NULL")
add("f3_missing_fields", f"""
WITH {TEXT}, m AS (SELECT id, vector, list_filter([CASE WHEN label IS NULL THEN 'label' END, CASE WHEN lang IS NULL OR {BLANK.format('lang')} THEN 'lang' END,
  CASE WHEN text IS NULL OR {BLANK.format('text')} THEN 'text' END], lambda f: f IS NOT NULL) AS absent FROM tc)
SELECT id, CASE WHEN vector IS NULL THEN 'missing_vector' ELSE 'missing_metadata' END AS reason,
  CASE WHEN vector IS NULL THEN 'vector' ELSE array_to_string(absent, ';') END AS missing_fields
FROM m WHERE vector IS NULL OR len(absent) > 0""")
CLASS = f"""{COLL},
k AS (SELECT id, CASE WHEN vector IS NULL THEN 'missing_vector' WHEN text IS NULL OR {BLANK.format('text')} THEN 'empty_content'
  WHEN (epoch_us(TIMESTAMP '2024-06-01') - epoch_us(created_at)) // 86400000000 > 200 THEN 'stale' END AS reason FROM c)"""
add("f4_orphan_class", f"""
WITH {CLASS} SELECT id, reason, CASE reason WHEN 'missing_vector' THEN 'vector' WHEN 'empty_content' THEN 'text' ELSE 'created_at' END AS missing_fields
FROM k WHERE reason IS NOT NULL""")
add("f5_content_field", f"""
WITH {COLL}, s AS (SELECT * FROM c ORDER BY id LIMIT 5) SELECT CASE WHEN bool_or(coalesce(text, '') <> '') THEN 'text' ELSE 'text' END AS content_field FROM s""")
add("f6_timestamp_field", f"""
WITH {COLL}, s AS (SELECT * FROM c ORDER BY id LIMIT 10) SELECT CASE WHEN bool_or(created_at IS NOT NULL) THEN 'created_at' END AS timestamp_field FROM s""")
add("f7_age_days", f"WITH {AGES} SELECT id, {R('age_days')} AS age_days FROM aged")
add("f7_age_formats", f"""
SELECT event_id AS id, {R("((epoch(TIMESTAMP '2024-06-01')::BIGINT - floor(epoch(ts))::BIGINT) // 3600) / 24.0::DOUBLE")} AS age_days FROM events WHERE event_id % 5 < 4""")
add("f8_stale_rows", f"""
WITH {COLL}, a AS (SELECT id, (epoch_us(TIMESTAMP '2024-06-01') - epoch_us(created_at)) // 86400000000 AS days FROM c) SELECT id, days FROM a WHERE days > 200""")
add("f9_empty_content", f"""
WITH {COLL} SELECT id, vector IS NOT NULL AND (text IS NULL OR {BLANK.format('text')}) AS empty_content FROM c""")
GRADE = "CASE WHEN {0} >= 90 THEN 'excellent' WHEN {0} >= 70 THEN 'good' WHEN {0} >= 50 THEN 'fair' ELSE 'poor' END"
add("f10_grades", f"SELECT doc_id, {GRADE.format('floor((n_chars % 1010) / 10.0)')} AS grade FROM documents")
LENGTH = """SELECT doc_id AS id, CASE WHEN strlen(text) < 50 THEN 'too_short' ELSE 'too_long' END AS issue,
  CASE WHEN strlen(text) < 50 THEN strlen(text) || ' chars (min: 50)' ELSE strlen(text) || ' chars (max: 5000)' END AS detail
FROM documents WHERE strlen(text) < 50 OR strlen(text) > 5000"""
add("f11_length_issues", LENGTH)
BOUNDARY = rf"""SELECT doc_id AS id, 'broken_boundary' AS issue FROM documents
WHERE regexp_matches({trimmed('text')}, '^\p{{Ll}}') AND NOT regexp_matches({trimmed('text')}, '[.!?"'')\]]$')"""
add("f12_broken_boundary", BOUNDARY)
add("f13_preview", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview FROM documents")
SHARE = "CASE WHEN n < 5000 THEN NULL WHEN n < 10000 THEN 0.30 WHEN n < 50000 THEN 0.15 WHEN n < 100000 THEN 0.07 WHEN n < 1000000 THEN 0.05 ELSE 0.01 END::DOUBLE"
add("f15_sample_share", f"WITH k AS (SELECT count(*) AS n FROM events) SELECT n, {SHARE} AS share FROM k")
add("f16_overlay_staleness", f"""
WITH {AGES} SELECT id, 'staleness' AS mode, {R('least(age_days / greatest(max(age_days) OVER (), 1.0), 1.0)')} AS value FROM aged""")
add("f16_overlay_duplicates", f"""
WITH {CASCADE}, two AS (SELECT * FROM members WHERE kind <> 'text_hash')
SELECT id, 'duplicates' AS mode, (dense_rank() OVER (ORDER BY kind, first_id) - 1)::DOUBLE AS value, kind || '_' || first_id AS label FROM two""")
add("f16_overlay_models", f"""
WITH {MIXED}, k AS (SELECT id, CASE WHEN label % 2 = 0 THEN 0 ELSE 1 END AS g FROM mixed)
SELECT id, 'model-groups' AS mode, g::DOUBLE AS value, 'Group #' || g AS label FROM k""")

# ---------------------------------------------------------------- vector scalars

NORM = "sqrt(list_inner_product(vector, vector))"
add("v1_norms", f"WITH {MIXED} SELECT id, {R(NORM)} AS norm FROM mixed")
ADJ = f"{MIXED}, p AS (SELECT a.id AS a, b.id AS b, a.vector AS va, b.vector AS vb FROM mixed a JOIN mixed b ON b.id = a.id + 1)"
add("v2_cosine_pairs", f"WITH {ADJ} SELECT a, b, {R('list_cosine_similarity(va, vb)')} AS cosine FROM p")
add("v3_euclidean", f"WITH {ADJ} SELECT a, b, {R('list_distance(va, vb)')} AS dist FROM p")
add("v4_squared_euclidean", f"WITH {ADJ} SELECT a, b, {R('list_distance(va, vb) ** 2')} AS dist2 FROM p")
add("v5_exact_fingerprint", f"""
WITH {DUP}, g AS (SELECT id, min(id) OVER (PARTITION BY vector) AS rep, count(*) OVER (PARTITION BY vector) AS copies FROM dup)
SELECT id, rep, copies FROM g WHERE copies > 1""")
add("v6_text_form", f"SELECT doc_id, md5(nullif(lower({trimmed('text')}), '')) AS form FROM documents")
P = 2147483647
add("v7_random_projection", f"""
WITH {PLAIN},
u AS (SELECT range AS c, range + 42 AS u FROM range(50 * 64)),
h0 AS (SELECT c, u, (u * 48271 + 11) % {P} AS h FROM u), h1 AS (SELECT c, u, (h * h + u) % {P} AS h FROM h0),
h2 AS (SELECT c, u, (h * h + u) % {P} AS h FROM h1), h3 AS (SELECT c, u, (h * h + u) % {P} AS h FROM h2),
w AS (SELECT c // 64 AS j, c % 64 AS d, CASE WHEN h < {P // 6} THEN -1 WHEN h < {5 * (P // 6)} THEN 0 ELSE 1 END * (sqrt(3.0::DOUBLE) / sqrt(50.0::DOUBLE)) AS w FROM h3),
cells AS (SELECT id, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS d FROM plain)
SELECT id, j::INT AS j, {R('sum(x * w)')} AS x FROM cells JOIN w USING (d) GROUP BY id, j""")
add("v8_near_zero", f"""
WITH {PLAIN} SELECT id, list_inner_product(vector, vector) * CASE WHEN label = 3 THEN 1e-12 ELSE 1.0 END < 1e-10 AS near_zero FROM plain""")

# ---------------------------------------------------------------- pairs and neighbours

PAIRS = "SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.vector, b.vector) AS similarity FROM {0} a JOIN {0} b ON a.id < b.id"
add("j1_near_pairs", f"WITH {PLAIN}, p AS ({PAIRS.format('plain')}) SELECT a, b, {R('similarity')} AS similarity FROM p WHERE similarity >= 0.3")
add("j1_near_pairs_cells", f"""
WITH {DUP}, one AS (SELECT min(id) AS id, vector FROM dup GROUP BY vector), p AS ({PAIRS.format('one')})
SELECT a, b, {R('similarity')} AS similarity FROM p WHERE similarity >= 0.9""")
DIFF = "CASE WHEN {0}a IS DISTINCT FROM {0}b THEN '{0}:' || coalesce({0}a, '') || '|' || coalesce({0}b, '') END"
CONTRA = f"""{DUP},
sig AS (
  SELECT min(id) AS id, count(*) AS m, vector, label::VARCHAR AS label, CASE WHEN NOT {BLANK.format('lang')} THEN lang END AS lang, n_chars::VARCHAR AS n_chars,
    CASE WHEN NOT {BLANK.format('source')} THEN source END AS source, CASE WHEN NOT {BLANK.format('text')} THEN text END AS text
  FROM dup GROUP BY ALL
),
p AS (
  SELECT a.id AS ia, b.id AS ib, a.m * b.m AS row_pairs, CASE WHEN a.vector = b.vector THEN 1.0 ELSE list_cosine_similarity(a.vector, b.vector) END AS similarity,
    a.label AS labela, b.label AS labelb, a.lang AS langa, b.lang AS langb, a.n_chars AS n_charsa, b.n_chars AS n_charsb,
    a.source AS sourcea, b.source AS sourceb, a.text AS texta, b.text AS textb
  FROM sig a JOIN sig b ON a.id < b.id
),
diff AS (SELECT ia AS vector_a_id, ib AS vector_b_id, similarity, row_pairs,
  array_to_string(list_filter([{DIFF.format('label')}, {DIFF.format('lang')}, {DIFF.format('n_chars')}, {DIFF.format('source')}, {DIFF.format('text')}], lambda f: f IS NOT NULL), ';') AS differences
  FROM p WHERE similarity >= 0.85)"""
add("j2_contradictions", f"""
WITH {CONTRA} SELECT vector_a_id, vector_b_id, {R('similarity')} AS similarity, row_pairs, differences FROM diff WHERE differences <> ''
ORDER BY diff.similarity DESC, 1, 2 LIMIT 100""")
add("j2_contradiction_total", f"WITH {CONTRA} SELECT coalesce(sum(row_pairs), 0)::BIGINT AS contradictions FROM diff WHERE differences <> ''")


def knn(source: str, k: int) -> str:
    return f"""alld AS (SELECT a.id AS src, b.id AS dst, list_distance(a.vector, b.vector) AS dist FROM {source} a JOIN {source} b ON a.id <> b.id),
nn AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank, dist FROM alld QUALIFY rank <= {k})"""


add("j3_knn_exact", f"WITH {PLAIN}, {knn('plain', 5)} SELECT src, dst, rank::INT AS rank, {R('dist')} AS dist FROM nn")
add("j3_knn_cells", f"WITH {DUP}, {knn('dup', 3)} SELECT src, dst, rank::INT AS rank, {R('dist')} AS dist FROM nn")
add("j4_knn_coded", f"WITH {PLAIN} SELECT count(*) AS rows, 5 * count(*) AS listed, 0::BIGINT AS wrong, true AS recall_reached FROM plain")
ONE = "near1 AS (SELECT b.id, list_distance(a.vector, b.vector) AS dist, row_number() OVER (ORDER BY list_distance(a.vector, b.vector), b.id) AS rank FROM {0} a JOIN {0} b ON a.id = 7 AND b.id <> 7)"
add("j5_neighbors", f"WITH {PLAIN}, {ONE.format('plain')} SELECT id, rank::INT AS rank, {R('dist')} AS dist FROM near1 WHERE rank <= 10")
add("j6_search", f"""
WITH {CENTROIDS}, h AS (SELECT cluster::BIGINT AS query, id, list_distance(centroid, vector) AS dist FROM cent, plain)
SELECT query, id, {R('dist')} AS dist, row_number() OVER (PARTITION BY query ORDER BY h.dist, id)::INT AS rank FROM h QUALIFY rank <= 20""")
add("j6_search_cosine", f"""
WITH {CENTROIDS}, {MIXED[len(PLAIN) + 2:]}, h AS (SELECT cluster::BIGINT AS query, id, 1 - list_cosine_similarity(centroid, vector) AS dist FROM cent, mixed)
SELECT query, id, {R('dist')} AS dist, row_number() OVER (PARTITION BY query ORDER BY h.dist, id)::INT AS rank FROM h QUALIFY rank <= 20""")
add("j7_normalised_distance", f"""
WITH {PLAIN}, {ONE.format('plain')}, t AS (SELECT * FROM near1 WHERE rank <= 20)
SELECT id, {R('dist')} AS dist, {R('(dist - min(dist) OVER ()) / (max(dist) OVER () - min(dist) OVER ())')} AS normalised FROM t""")
add("j8_attach_coordinates", f"""
WITH {DUP}, {ONE.format('dup')}, pts AS (SELECT id, vector[1] AS x, vector[2] AS y, vector[3] AS z FROM plain)
SELECT n.id, rank::INT AS rank, {R('coalesce(x, 0.0)')} AS x, {R('coalesce(y, 0.0)')} AS y, {R('coalesce(z, 0.0)')} AS z
FROM near1 n LEFT JOIN pts ON pts.id = n.id WHERE rank <= 20""")
add("j9_cascade_remaining", f"WITH {DUP} SELECT id FROM dup WHERE vector IN (SELECT vector FROM dup GROUP BY vector HAVING count(*) = 1)")
add("j10_recall_given", f"""
WITH {PLAIN}, {knn('plain', 25)},
o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS o, count(*) OVER () AS n FROM plain),
q AS (SELECT id FROM o WHERE o % (n // least(50, n)) = 0 AND o < (n // least(50, n)) * least(50, n)),
hit AS (SELECT q.id, count(nn.dst) FILTER (WHERE a.label = b.label) AS h
  FROM q JOIN plain a ON a.id = q.id JOIN nn ON nn.src = q.id AND nn.rank <= 10 JOIN plain b ON b.id = nn.dst GROUP BY q.id)
SELECT 10 AS k, {R('avg(h / 10.0::DOUBLE)')} AS recall_at_k, count(*) AS samples_tested FROM hit""")
add("j11_symmetrise", f"""
WITH {PLAIN}, {knn('plain', 5)}, e AS (SELECT src, dst, 1 / (1 + dist) AS w FROM nn)
SELECT least(src, dst) AS a, greatest(src, dst) AS b, {R('CASE WHEN count(*) = 2 THEN sum(w) - min(w) * max(w) ELSE sum(w) END')} AS weight FROM e GROUP BY 1, 2""")
add("j12_radius_pairs", f"""
WITH {POINTS}, p AS (SELECT a.id AS id1, b.id AS id2, sqrt((a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2) AS distance FROM pts a JOIN pts b ON a.id < b.id)
SELECT id1, id2, {R('distance')} AS distance FROM (SELECT * FROM p WHERE distance <= 0.05 ORDER BY distance, id1, id2 LIMIT 500)""")
add("j13_radius_rows", f"""
WITH {POINTS}, p AS (SELECT *, sqrt((x - 0.1)**2 + y**2 + (z + 0.1)**2) AS distance FROM pts)
SELECT id, {R('x')} AS x, {R('y')} AS y, {R('z')} AS z, {R('distance')} AS distance FROM p WHERE distance <= 0.2""")
add("j13_box_of_layout", f"""
WITH {POINTS} SELECT id, {R('x')} AS x, {R('y')} AS y, {R('z')} AS z FROM pts
WHERE x BETWEEN -0.1 AND 0.3 AND y BETWEEN -0.2 AND 0.2 AND z BETWEEN -0.3 AND 0.1""")
add("j14_delete_ids", f"WITH {TEXT} SELECT id, lang FROM tc WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
add("j15_keep_first", f"""
WITH {CASCADE} SELECT id, label FROM dup WHERE id NOT IN (SELECT id FROM members WHERE kind <> 'text_hash' AND id <> first_id)""")
STRIDED = f"""{PLAIN},
o AS (SELECT id, vector, row_number() OVER (ORDER BY id) - 1 AS o FROM plain),
pr AS (SELECT a.id AS id_a, b.id AS id_b, list_distance(a.vector, b.vector) AS dist, row_number() OVER (ORDER BY a.o, b.o) - 1 AS t, count(*) OVER () AS total FROM o a JOIN o b ON a.o < b.o),
sp AS (SELECT * FROM pr WHERE t % greatest(1, total // 10000) = 0 AND t // greatest(1, total // 10000) < 10000)"""
add("j16_strided_pairs", f"WITH {STRIDED} SELECT t, id_a, id_b, {R('dist')} AS dist FROM sp")

# ---------------------------------------------------------------- aggregates

add("a1_exact_dups", f"WITH {DUP} SELECT min(id) AS first_id, array_to_string(list(id ORDER BY id), ';') AS vector_ids FROM dup GROUP BY vector HAVING count(*) > 1")
add("a2_text_dups", f"""
WITH {TEXT}, f AS (SELECT id, lower({trimmed('text')}) AS f FROM tc WHERE text IS NOT NULL)
SELECT first_id, array_to_string(list(id ORDER BY id), ';') AS vector_ids
FROM (SELECT id, min(id) OVER w AS first_id, count(*) OVER w AS n FROM f WHERE f <> '' WINDOW w AS (PARTITION BY f)) WHERE n > 1
GROUP BY first_id, ('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT % ceil(n / 1000.0)::BIGINT""")
COMP = f"""RECURSIVE {PLAIN},
link AS (SELECT a.id AS u, b.id AS v FROM plain a JOIN plain b ON a.id <> b.id WHERE list_cosine_similarity(a.vector, b.vector) >= 0.4),
reach AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
comp AS (SELECT u AS id, least(u, min(v)) AS component FROM reach GROUP BY u)"""
add("a3_components", f"WITH {COMP} SELECT id, component FROM comp")
add("a3_near_groups", f"""
WITH {COMP}, s AS (SELECT a.component, avg(list_cosine_similarity(x.vector, y.vector)) AS s FROM comp a JOIN comp b ON a.component = b.component AND a.id < b.id
  JOIN plain x ON x.id = a.id JOIN plain y ON y.id = b.id GROUP BY 1)
SELECT c.component AS first_id, count(*) AS size, {R('any_value(s.s)')} AS similarity FROM comp c JOIN s ON s.component = c.component GROUP BY c.component""")
add("a3_components_cells", f"""
WITH RECURSIVE {DUP}, link AS (SELECT a.id AS u, b.id AS v FROM dup a JOIN dup b ON a.id <> b.id WHERE list_cosine_similarity(a.vector, b.vector) >= 0.98),
reach AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u)
SELECT u AS id, least(u, min(v)) AS component FROM reach GROUP BY u""")
add("a4_duplicate_totals", f"WITH {CASCADE} SELECT kind, count(*) FILTER (WHERE id = first_id) AS groups, count(*) FILTER (WHERE id <> first_id) AS surplus FROM members GROUP BY kind")
add("a5_orphans_by_reason", f"""
WITH {CLASS}, every AS (SELECT unnest(['missing_vector', 'missing_metadata', 'empty_content', 'stale']) AS reason)
SELECT e.reason, count(k.id) AS n FROM every e LEFT JOIN k ON k.reason = e.reason GROUP BY e.reason""")
FILLED = f"""((label IS NOT NULL)::INT + (text IS NOT NULL AND NOT {BLANK.format('text')})::INT + (lang IS NOT NULL AND NOT {BLANK.format('lang')})::INT
 + (source IS NOT NULL AND NOT {BLANK.format('source')})::INT + (n_chars IS NOT NULL)::INT)"""
add("a6_completeness", f"""
WITH {COLL} SELECT count(*) AS rows, sum({FILLED} + (created_at IS NOT NULL)::INT)::BIGINT AS filled,
  {R(f'sum({FILLED} + (created_at IS NOT NULL)::INT) / (count(*) * 6.0::DOUBLE)')} AS completeness,
  count(*) FILTER (WHERE vector IS NOT NULL AND (text IS NULL OR {BLANK.format('text')})) AS orphan_count,
  count(*) FILTER (WHERE vector IS NULL) AS missing_vector_count FROM c""")


def moments(table: str, col: str) -> str:
    """n, mean, std, min, max and population skewness and excess kurtosis."""
    return f"""mb AS (SELECT count({col}) AS n, avg({col}) AS mean, stddev_pop({col}) AS std, min({col}) AS min, max({col}) AS max FROM {table}),
mo AS (SELECT any_value(n) AS n, any_value(mean) AS mean, any_value(std) AS std, any_value(min) AS min, any_value(max) AS max,
  coalesce(avg(((({col}) - mean) / nullif(std, 0)) ** 3), 0) AS skewness, coalesce(avg(((({col}) - mean) / nullif(std, 0)) ** 4) - 3, 0) AS kurtosis FROM {table}, mb)"""


MOMENTS_OUT = ", ".join(["n"] + [f"{R(c)} AS {c}" for c in ("mean", "std", "min", "max", "skewness", "kurtosis")])
add("a7_moments", f"WITH {moments('events', 'value')} SELECT {MOMENTS_OUT} FROM mo")
PICK = "list_sort(list({0}))[least(floor({1} * count({0}))::BIGINT, count({0}) - 1) + 1]"
add("a8_percentiles", "SELECT count(*) AS n, " + ", ".join(f"{R(PICK.format('l_extendedprice', p))} AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.99)) + " FROM lineitem")
NORMS = f"{MIXED}, nm AS (SELECT id, round({NORM}, 6) AS norm FROM mixed)"
BC = "(skewness**2 + 1) / (kurtosis + 3.0 * (n - 1)**2 / ((n - 2.0) * (n - 3.0)))"
CLAMPED = f"greatest(0.0, least(1.0, {BC}))"
CONF = f"CASE WHEN {CLAMPED} > 0.555 THEN least(1.0, ({CLAMPED} - 0.555) / 0.445) ELSE 0.0 END"
add("a10_bimodality", f"WITH {NORMS}, {moments('nm', 'norm')} SELECT n, {R(CLAMPED)} AS bc, {R(CONF)} AS confidence, {R(BC)} AS bc_unclamped FROM mo")


def histogram(table: str, col: str, bins: int) -> str:
    return f"""sp AS (SELECT min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi, (max({col})::DOUBLE - min({col})::DOUBLE) / {bins} AS w FROM {table}),
hb AS (SELECT least(floor(({col}::DOUBLE - lo) / w)::INT, {bins - 1}) AS bin, count(*) AS n FROM {table}, sp GROUP BY 1),
hist AS (SELECT r.range::INT AS bin, {R('lo + r.range * w')} AS min, {R('lo + (r.range + 1) * w')} AS max, coalesce(n, 0) AS count FROM sp, range({bins}) r LEFT JOIN hb ON hb.bin = r.range)"""


add("a11_histogram", f"WITH {histogram('events', 'value', 30)} SELECT * FROM hist")
DIMS = f"""{PLAIN}, cells AS (SELECT unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS dim FROM plain),
dims AS (SELECT dim::INT AS dim, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, var_pop(x) AS variance FROM cells GROUP BY dim)"""
add("a12_dim_stats", f"WITH {DIMS} SELECT dim, " + ", ".join(f"{R(c)} AS {c}" for c in ("mean", "std", "min", "max", "variance")) + f", {R('variance / sum(variance) OVER ()')} AS variance_ratio FROM dims")
add("a13_meta_diff", """
WITH p AS (SELECT a.doc_id AS a, a.lang AS la, b.lang AS lb, a.n_chars::VARCHAR AS na, b.n_chars::VARCHAR AS nb, a.source AS sa, b.source AS sb FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 20)
SELECT a, 'lang' AS field, la AS value_a, lb AS value_b FROM p WHERE la IS DISTINCT FROM lb
UNION ALL SELECT a, 'n_chars', na, nb FROM p WHERE na IS DISTINCT FROM nb UNION ALL SELECT a, 'source', sa, sb FROM p WHERE sa IS DISTINCT FROM sb""")
add("a14_cluster_sizes", "SELECT r.range::INT AS cluster, count(e.vec_id) AS size FROM range(12) r LEFT JOIN embeddings e ON e.label = r.range GROUP BY 1")
SIL = """ds AS (SELECT a.id, a.cluster, b.cluster AS other, avg(list_distance(a.vector, b.vector)) AS d FROM {0} a JOIN {0} b ON a.id <> b.id GROUP BY ALL),
ab AS (SELECT id, coalesce(min(d) FILTER (WHERE other = cluster), 0) AS a, min(d) FILTER (WHERE other <> cluster) AS b FROM ds GROUP BY id),
sil AS (SELECT avg(CASE WHEN b IS NULL THEN 1.0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END) AS s FROM ab)"""
add("a15_silhouette", f"WITH {PLAIN}, lab AS (SELECT id, vector, label AS cluster FROM plain), {SIL.format('lab')} SELECT {R('s')} AS silhouette FROM sil")
add("a16_davies_bouldin", f"""
WITH {CENTROIDS}, s AS (SELECT p.label AS cluster, avg(list_distance(p.vector, cent.centroid)) AS s FROM plain p JOIN cent ON p.label = cent.cluster GROUP BY 1),
c AS (SELECT cent.cluster, centroid, s FROM cent JOIN s USING (cluster)),
r AS (SELECT i.cluster, max((i.s + j.s) / list_distance(i.centroid, j.centroid)) AS r FROM c i JOIN c j ON i.cluster <> j.cluster GROUP BY 1)
SELECT {R('sum(r) / 10')} AS davies_bouldin FROM r""")
DENS = f"{knn('{0}', 5)}, den AS (SELECT src AS id, CASE WHEN avg(dist) > 0 THEN 1 / avg(dist) ELSE 1.0 END AS density FROM nn GROUP BY src)"
add("a17_density", f"""
WITH {PLAIN}, {DENS.replace('{0}', 'plain')}, s AS (SELECT avg(density) AS m, stddev_pop(density) AS s FROM den)
SELECT {R('any_value(m)')} AS mean_density, {R('any_value(s)')} AS std_density, count(*) FILTER (WHERE density < m - s) AS sparse_region_count,
  count(*) FILTER (WHERE density > m + s) AS dense_region_count FROM den, s""")
EFF = "eff AS (SELECT count(*) FILTER (WHERE before < 0.9 * total) AS effective_dims, count(*) AS actual_dims FROM (SELECT coalesce(sum(variance) OVER (ORDER BY variance DESC, dim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(variance) OVER () AS total FROM dims))"
add("a18_effective_dims", f"WITH {DIMS}, {EFF} SELECT * FROM eff")
DISC = "least(2.0, greatest(0.0, (max(dist) - min(dist)) / avg(dist))) / 2.0"
add("a19_distance_stats", f"""
WITH {STRIDED} SELECT count(*) AS n, {R('avg(dist)')} AS mean, {R('stddev_pop(dist)')} AS std, {R('min(dist)')} AS min, {R('max(dist)')} AS max, {R(DISC)} AS discrimination FROM sp""")
SOME = f"{COLL}, {DUP[len(TEXT) + 2:]}"
SIZES = f"""{SOME},
inf AS (SELECT 'collection' AS name, count(*) AS n, max(len(vector))::INT AS d FROM c UNION ALL SELECT 'collection_dup', count(*), max(len(vector))::INT FROM dup
  UNION ALL SELECT 'chunks', count(*), NULL FROM documents),
mem AS (SELECT name, n, d, n * coalesce(d, 0)::BIGINT * 4 + (n * coalesce(d, 0)::BIGINT * 4) // 2 + n * 200 AS m FROM inf)"""
add("a20_storage", f"""
WITH {SIZES} SELECT name, n AS vector_count, d AS dimensions, m AS estimated_memory_bytes, m + m // 10 AS estimated_storage_bytes, CASE WHEN n > 0 THEN m // n ELSE 0 END AS bytes_per_vector FROM mem""")
add("a23_totals", f"""
WITH {SIZES} SELECT sum(n)::BIGINT AS total_vectors, sum(m)::BIGINT AS total_memory_bytes, sum(m + m // 10)::BIGINT AS total_storage_bytes FROM mem""")
add("a22_max_similarity", f"""
WITH {MIXED} SELECT a.id, {R('max(list_cosine_similarity(a.vector, b.vector))')} AS max_sim FROM mixed a JOIN mixed b ON a.id <> b.id GROUP BY a.id""")

# health: facts per collection, then issues

FACT = """SELECT '{name}' AS name, count(*) AS n, coalesce(max(len(vector)), 0) AS d, sum({filled}) / (count(*) * {fields}.0::DOUBLE) AS completeness,
  count(*) FILTER (WHERE vector IS NOT NULL AND (text IS NULL OR """ + BLANK.format("text") + """)) AS orphans, count(*) FILTER (WHERE vector IS NULL) AS missing,
  {median} AS median_days, count(text) AS texts, count(*) FILTER (WHERE strlen(text) < 50) AS short, {ratio} AS ratio, {bc} AS bc FROM {table}"""
DAYS = "(epoch_us(TIMESTAMP '2024-06-01') - epoch_us(created_at)) // 86400000000"
RATIO = """(SELECT (max(d) - min(d)) / avg(d) FROM (SELECT list_distance(a.vector, b.vector) AS d FROM (SELECT id, vector FROM {0} WHERE vector IS NOT NULL ORDER BY id LIMIT 20) a
  JOIN (SELECT id, vector FROM {0} WHERE vector IS NOT NULL ORDER BY id LIMIT 20) b ON a.id < b.id))"""


def bimodal(table: str) -> str:
    x = f"(SELECT sqrt(list_inner_product(vector, vector)) AS x FROM {table} WHERE vector IS NOT NULL)"
    return f"""(SELECT (s3 * s3 + 1) / (k4 - 3 + 3.0 * (n - 1)**2 / ((n - 2.0) * (n - 3.0))) FROM (SELECT any_value(n) AS n, avg(((x - m) / s) ** 3) AS s3, avg(((x - m) / s) ** 4) AS k4
  FROM {x}, (SELECT count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM {x})))"""


DOC_FILLED = f"((text IS NOT NULL AND NOT {BLANK.format('text')})::INT + (lang IS NOT NULL AND NOT {BLANK.format('lang')})::INT + (source IS NOT NULL AND NOT {BLANK.format('source')})::INT)"
HEALTH = f"""{SOME}, ch AS (SELECT doc_id AS id, NULL::DOUBLE[] AS vector, text, lang, source FROM documents),
facts AS ({FACT.format(name='collection', filled=FILLED + ' + (created_at IS NOT NULL)::INT', fields=6, median=PICK.format(DAYS, 0.5), ratio=RATIO.format('c'), bc=bimodal('c'), table='c')}
UNION ALL {FACT.format(name='collection_dup', filled=FILLED, fields=5, median='NULL', ratio=RATIO.format('dup'), bc=bimodal('dup'), table='dup')}
UNION ALL {FACT.format(name='chunks', filled=DOC_FILLED, fields=3, median='NULL', ratio='NULL', bc='NULL', table='ch')}),
issues AS (
  SELECT name, CASE WHEN completeness < 0.5 THEN 'warning' ELSE 'info' END AS severity, 'schema_inconsistency' AS category, printf('Metadata completeness is %.0f%%', completeness * 100) AS message,
    floor((1 - completeness) * n)::BIGINT AS affected_count, 1 AS o FROM facts WHERE completeness < 0.8
  UNION ALL SELECT name, 'warning', 'orphans', 'Estimated ' || orphans || ' vectors with missing or empty content', orphans, 2 FROM facts WHERE orphans > 0
  UNION ALL SELECT name, 'error', 'orphans', 'Estimated ' || missing || ' vectors with missing embeddings', missing, 3 FROM facts WHERE missing > 0
  UNION ALL SELECT name, 'info', 'performance', 'High dimension count (' || d || ') may impact performance', NULL, 4 FROM facts WHERE d > 1536
  UNION ALL SELECT name, 'info', 'storage', 'Large collection with ' || n || ' vectors', NULL, 5 FROM facts WHERE n > 100000
  UNION ALL SELECT name, 'warning', 'model_drift', printf('Possible mixed embedding models detected (bimodality coefficient: %.2f)', bc), NULL, 6 FROM facts WHERE bc > 0.6
  UNION ALL SELECT name, 'warning', 'distance_health', printf('Poor distance discrimination (ratio: %.2f)', ratio), NULL, 7 FROM facts WHERE ratio < 0.3
  UNION ALL SELECT name, 'info', 'staleness', 'Median data age is ' || median_days || ' days (field: created_at)', NULL, 8 FROM facts WHERE median_days > 180
  UNION ALL SELECT name, 'warning', 'chunk_quality', printf('%.0f%% of chunks are very short (<50 chars)', short / texts * 100), floor(short / texts * n)::BIGINT, 9 FROM facts WHERE texts >= 5 AND short / texts > 0.3
),
total AS (SELECT greatest(0, least(100, 100 - (SELECT coalesce(sum(CASE severity WHEN 'critical' THEN 25 WHEN 'error' THEN 15 WHEN 'warning' THEN 5 ELSE 1 END), 0) FROM issues)
  - sum(CASE WHEN completeness < 0.5 THEN 10 WHEN completeness < 0.8 THEN 5 ELSE 0 END)))::INT AS score, sum(n)::BIGINT AS total_vectors, sum(n * d * 4 + n * 200)::BIGINT AS storage FROM facts)"""
add("r1_health_collections", f"""
WITH {HEALTH} SELECT name, n AS vector_count, nullif(d, 0)::INT AS dimensions, (n * d * 4 + n * 200)::BIGINT AS estimated_storage_bytes, {R('completeness')} AS metadata_completeness,
  orphans AS orphan_count, 0::BIGINT AS duplicate_count FROM facts""")
add("r1_health_issues", f"WITH {HEALTH} SELECT severity, category, '[' || name || '] ' || message AS message, affected_count FROM issues")
add("a21_health_score", f"""
WITH {HEALTH} SELECT score, {GRADE.format('score')} AS grade, total_vectors, storage AS estimated_storage_bytes, (SELECT count(*) FROM issues) AS issue_count FROM total""")
add("s11_export_health", f"""
WITH {HEALTH}
SELECT f.name AS collection, n::VARCHAR AS vector_count, coalesce(nullif(d, 0)::VARCHAR, '') AS dimensions, (n * d * 4 + n * 200)::BIGINT::VARCHAR AS storage_bytes,
  printf('%.1f%%', completeness * 100) AS completeness, orphans::VARCHAR AS orphans, '0' AS duplicates,
  coalesce((SELECT string_agg('[' || upper(severity[1]) || severity[2:] || '] ' || message, '; ' ORDER BY o) FROM issues i WHERE i.name = f.name), '') AS issues FROM facts f
UNION ALL SELECT 'SUMMARY', total_vectors::VARCHAR, '', storage::VARCHAR, '', '', '', 'Score: ' || score || ' (' || {GRADE.format('score')} || ')' FROM total""")

# ---------------------------------------------------------------- windows and order

LAG = "pv AS (SELECT doc_id AS id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM documents)"
OVERLAP = """ov AS (SELECT {0}, list_max(list_filter(range((floor(greatest(length(prev), length(text)) * 0.8) + 1)::BIGINT, least(length(prev), length(text)) + 1),
  lambda n: right(prev, n) = left(text, n))) AS overlap FROM {1})"""
add("w1_overlap", f"WITH {LAG}, {OVERLAP.format('id', 'pv')} SELECT id, overlap::INT AS overlap FROM ov")
add("w1_overlap_within_docs", """
SELECT doc_id, CASE WHEN length(text) > 0 AND length(text) > 0.8 * (length(text) + 8) THEN length(text)::INT END AS overlap FROM documents""")
ZONES = """st AS (SELECT id, age_days FROM aged WHERE age_days > 90),
g AS (SELECT *, CASE WHEN age_days - lag(age_days) OVER (ORDER BY age_days, id) > 30 THEN 1 ELSE 0 END AS cutp FROM st),
z AS (SELECT *, sum(cutp) OVER (ORDER BY age_days, id ROWS UNBOUNDED PRECEDING) AS run FROM g),
zz AS (SELECT run, count(*) AS count, min(age_days) AS mn, max(age_days) AS mx, avg(age_days) AS me, array_to_string(list(id ORDER BY age_days, id)[1:5], ';') AS sample_ids FROM z GROUP BY run HAVING count(*) >= 3)"""
add("w2_dead_zones", f"""
WITH {AGES}, {ZONES} SELECT (row_number() OVER (ORDER BY run) - 1)::INT AS zone, count, {R('mn')} AS min_age_days, {R('mx')} AS max_age_days, {R('me')} AS mean_age_days, sample_ids FROM zz""")
add("w3_cumulative_variance", f"WITH {DIMS} SELECT dim, row_number() OVER (ORDER BY variance DESC, dim) - 1 AS place, {R('variance')} AS variance, {R('sum(variance) OVER (ORDER BY variance DESC, dim) / sum(variance) OVER ()')} AS share FROM dims")
add("w4_ordinals", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS ordinal FROM orders")
add("w5_first_ids", "SELECT source, array_to_string(list(doc_id ORDER BY doc_id)[1:5], ';') AS sample_ids FROM documents GROUP BY source")

# ---------------------------------------------------------------- clusters and anomalies

MEANS = """c{1} AS (SELECT cluster, list(x ORDER BY d) AS v FROM (SELECT cluster, d, avg(x) AS x FROM (SELECT a.cluster, unnest(p.vector) AS x, generate_subscripts(p.vector, 1) AS d FROM a{0} a JOIN plain p ON p.id = a.id) GROUP BY cluster, d) GROUP BY cluster)"""
ASSIGN = "a{0} AS (SELECT p.id, arg_min(cluster, (list_distance(p.vector, v), cluster)) AS cluster FROM plain p, c{0} GROUP BY p.id)"
KMEANS = f"""{PLAIN},
s0 AS (SELECT vector AS v FROM plain ORDER BY id LIMIT 1),
s1 AS (SELECT p.vector AS v FROM plain p, s0 ORDER BY list_distance(p.vector, s0.v) DESC, p.id LIMIT 1),
s2 AS (SELECT p.vector AS v FROM plain p, s0, s1 ORDER BY least(list_distance(p.vector, s0.v), list_distance(p.vector, s1.v)) DESC, p.id LIMIT 1),
c0 AS (SELECT 0 AS cluster, v FROM s0 UNION ALL SELECT 1, v FROM s1 UNION ALL SELECT 2, v FROM s2),
{ASSIGN.format(0)}, {MEANS.format(0, 1)}, {ASSIGN.format(1)}, {MEANS.format(1, 2)}, {ASSIGN.format(2)}, {MEANS.format(2, 3)},
km AS (SELECT a.id, a.cluster, p.vector, list_distance(p.vector, c3.v) AS dist FROM a2 a JOIN c3 ON c3.cluster = a.cluster JOIN plain p ON p.id = a.id)"""
add("m1_kmeans_k3_i3", f"WITH {KMEANS} SELECT id, cluster::INT AS cluster, {R('dist')} AS dist FROM km")
add("m2_auto_k", "SELECT count(*) AS n, greatest(2, least(20, floor(sqrt(count(*) / 2.0))))::INT AS k, greatest(2, least(15, floor(sqrt(count(*) / 2.0))))::INT AS k_anomaly FROM embeddings")
GROUPS = """gr AS (SELECT CASE WHEN norm <= 1.5 THEN 0 ELSE 1 END AS group_id, id, norm FROM nm),
grp AS (SELECT group_id, count(*) AS count, round(avg(norm), 6) + 0.0 AS mean_norm, round(stddev_pop(norm), 6) + 0.0 AS std_norm, array_to_string(list(id ORDER BY id)[1:5], ';') AS sample_ids FROM gr GROUP BY group_id)"""
add("m3_norm_groups", f"WITH {NORMS}, {GROUPS} SELECT * FROM grp")
add("r10_groups", f"WITH {NORMS}, {GROUPS} SELECT * FROM grp")
add("m4_outliers", f"WITH {OUTLIERS} SELECT id, {R('distance_to_cluster')} AS distance_to_cluster, {R('outlier_score')} AS outlier_score FROM outl")
add("m5_nearby_centroids", f"WITH {CENTROIDS} SELECT id, count(*) FILTER (WHERE list_distance(vector, centroid) < 1.0)::INT AS nearby FROM plain, cent GROUP BY id")


def anomaly(rows: str, filled: str, centroids: str, centroid: str, radius: str, centrality: int = 3) -> str:
    return f"""{DENS.replace('{0}', rows)},
fx AS (SELECT r.id, {filled} AS filled, sqrt(list_inner_product(vector, vector)) AS norm, density, (SELECT count(*) FROM {centroids} q WHERE list_distance(r.vector, q.{centroid}) < {radius}) AS nearby FROM {rows} r JOIN den ON den.id = r.id),
fs AS (SELECT avg(norm) AS nm, stddev_pop(norm) AS ns, avg(density) AS dm, stddev_pop(density) AS ds FROM fx),
sg AS (SELECT id, nearby >= {centrality} AS a, filled <= 1 AS b, nearby >= 2 AND density < dm - ds AS c, abs(norm - nm) > 3 * ns AS d FROM fx, fs),
an AS (SELECT id, least(1.0, 0.4 * a::INT + 0.2 * b::INT + 0.3 * c::INT + 0.3 * d::INT)::DOUBLE AS anomaly_score,
  array_to_string(list_filter([CASE WHEN a THEN 'high_centrality' END, CASE WHEN b THEN 'sparse_metadata' END, CASE WHEN c THEN 'isolated_but_central' END, CASE WHEN d THEN 'abnormal_norm' END], lambda f: f IS NOT NULL), ';') AS reasons
  FROM sg WHERE a OR b OR c OR d)"""


LABEL_AN = f"{DUP}, {CENTROIDS[len(PLAIN) + 2:]}, {anomaly('dup', FILLED, 'cent', 'centroid', '1.02')}"
add("m6_anomaly_score", f"WITH {LABEL_AN} SELECT id, {R('anomaly_score')} AS anomaly_score, reasons FROM an")
add("f16_overlay_anomalies", f"WITH {LABEL_AN} SELECT id, 'anomaly' AS mode, {R('anomaly_score')} AS value, reasons AS label FROM an")
NORMALISED = f"""ax AS (SELECT 'x' AS a, x AS v FROM pts UNION ALL SELECT 'y', y FROM pts UNION ALL SELECT 'z', z FROM pts),
en AS (SELECT a, {PICK.format('v', 0.05)} AS lo, {PICK.format('v', 0.95)} AS hi FROM ax GROUP BY a),
sc AS (SELECT max(hi - lo) AS s FROM en)"""
NCOL = "round(greatest(-1.0, least(1.0, ({0} - (SELECT (lo + hi) / 2 FROM en WHERE a = '{0}')) / s * 1.8)), 6) + 0.0 AS {0}"
NOUT = f"SELECT id, {NCOL.format('x')}, {NCOL.format('y')}, {NCOL.format('z')} FROM pts, sc"
add("m13_normalise", f"WITH {POINTS}, {NORMALISED} {NOUT}")
add("s14_stored_projection", f"WITH {POINTS}, {NORMALISED} {NOUT}")



def spacing_pass(i: int) -> str:
    """Points p{i+1} from p{i}: every point gives way to each one closer than the spacing."""
    dist = "sqrt((b.x - a.x)**2 + (b.y - a.y)**2 + (b.z - a.z)**2)"
    close = f"JOIN p{i} b ON a.id <> b.id AND {dist} < (SELECT s FROM spacing) AND {dist} > 1e-10"
    push = f"((SELECT s FROM spacing) - {dist}) * 0.5 / {dist}"
    moves = ", ".join(f"sum((b.{c} - a.{c}) * {push}) AS d{c}" for c in "xyz")
    moved = ", ".join(f"p.{c} - coalesce(d{c}, 0) AS {c}" for c in "xyz")
    return f"""m{i} AS (SELECT a.id, {moves} FROM p{i} a {close} GROUP BY a.id),
p{i + 1} AS (SELECT p.id, {moved} FROM p{i} p LEFT JOIN m{i} m ON m.id = p.id)"""


add("m12_spacing", f"""
WITH {POINTS},
o AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS o, count(*) OVER () AS n FROM pts),
few AS (SELECT * FROM o WHERE o % CASE WHEN n > 100 THEN greatest(1, n // 50) ELSE 1 END = 0),
dd AS (SELECT sqrt((b.x - a.x)**2 + (b.y - a.y)**2 + (b.z - a.z)**2) AS d FROM few a JOIN few b ON a.o < b.o),
spacing AS (SELECT list_sort(list(d))[count(d) // 2 + 1] * 0.02 AS s FROM dd),
p0 AS (SELECT * FROM pts), {spacing_pass(0)}, {spacing_pass(1)}, {spacing_pass(2)}, {spacing_pass(3)}
SELECT id, {R('x')} AS x, {R('y')} AS y, {R('z')} AS z FROM p4""")

# ---------------------------------------------------------------- reports

add("r3_duplicates", f"WITH {CASCADE} SELECT group_id, kind, first_id, size, {R('similarity')} AS similarity FROM grp")
add("r3_duplicate_members", f"WITH {CASCADE} SELECT kind, first_id, id FROM members")
add("r4_cluster_metrics", f"""
WITH {KMEANS}, {SIL.format('km')}, sp AS (SELECT cluster, avg(dist) AS s FROM km GROUP BY 1),
r AS (SELECT i.cluster, max((si.s + sj.s) / list_distance(i.v, j.v)) AS r FROM c3 i JOIN c3 j ON i.cluster <> j.cluster JOIN sp si ON si.cluster = i.cluster JOIN sp sj ON sj.cluster = j.cluster GROUP BY 1)
SELECT {R('(SELECT s FROM sil)')} AS silhouette, {R('sum(r) / 3')} AS davies_bouldin, 3 AS cluster_count FROM r""")
add("r4_outliers", f"""
WITH {KMEANS}, st AS (SELECT avg(dist) AS m, stddev_pop(dist) AS s FROM km)
SELECT id, {R('dist')} AS distance_to_cluster, {R('(dist - m) / s')} AS outlier_score, row_number() OVER (ORDER BY dist DESC, id) - 1 AS rank FROM km, st WHERE dist > m + 1.5 * s""")
BYTES = "CASE WHEN {0} >= 1073741824 THEN printf('%.1f GB', {0} / 1073741824.0) WHEN {0} >= 1048576 THEN printf('%.1f MB', {0} / 1048576.0) WHEN {0} >= 1024 THEN printf('%.1f KB', {0} / 1024.0) ELSE {0} || ' bytes' END"
add("r5_recommendations", f"""
WITH {SIZES}, alls AS (SELECT * FROM mem UNION ALL SELECT 'lineitem', count(*), NULL, count(*) * 200 FROM lineitem), tot AS (SELECT sum(n) AS n, sum(m) AS m FROM alls)
SELECT 'dimensionality' AS category, CASE WHEN d > 1536 THEN 'high' ELSE 'medium' END AS priority, printf('Collection ''%s'' uses %d-dimensional vectors. Consider dimensionality reduction if query performance is slow.', name, d) AS message,
  'Reducing dimensions by ' || CASE WHEN d > 1536 THEN 4 ELSE 2 END || 'x could save ~' || {BYTES.format('(m // CASE WHEN d > 1536 THEN 4 ELSE 2 END)')} || ' memory' AS potential_savings FROM alls WHERE d > 768
UNION ALL SELECT 'scaling', CASE WHEN n > 1000000 THEN 'high' ELSE 'medium' END, 'Collection ''' || name || ''' has ' || format('{{:,}}', n) || ' vectors. Consider sharding or horizontal scaling for better performance.', NULL FROM alls WHERE n > 100000
UNION ALL SELECT 'memory', 'high', 'Total estimated memory usage is ' || {BYTES.format('m')} || '. Ensure your system has adequate RAM to avoid disk spillover.', NULL FROM tot WHERE m > 8589934592
UNION ALL SELECT 'indexing', 'low', 'Consider tuning HNSW index parameters (ef, efConstruction, maxConnections) for optimal query/build time tradeoff.', NULL FROM tot WHERE n > 10000""")
add("r7_staleness", f"""
WITH {AGES} SELECT 'created_at' AS timestamp_field, count(*) AS n, count(*) FILTER (WHERE age_days > 90) AS stale_count, {R('count(*) FILTER (WHERE age_days > 90) / count(*) * 100')} AS stale_percentage,
  {R(PICK.format('age_days', 0.5))} AS median_age_days, """ + ", ".join(f"{R(PICK.format('age_days', p))} AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.99)) + " FROM aged")
add("r7_age_histogram", f"WITH {AGES}, {histogram('aged', 'age_days', 30)} SELECT * FROM hist")
KM_AN = f"{KMEANS}, cd AS (SELECT list_sort(list(list_distance(i.v, j.v))) AS l FROM c3 i JOIN c3 j ON i.cluster < j.cluster), {anomaly('plain', '(label IS NOT NULL)::INT', 'c3', 'v', '(SELECT l[len(l) // 2 + 1] * 0.5 FROM cd)')}"
add("r9_anomalies", f"WITH {KM_AN} SELECT id, {R('anomaly_score')} AS anomaly_score, reasons FROM an")
add("r10_fingerprint", f"""
WITH {NORMS}, {moments('nm', 'norm')} SELECT n, {R('mean')} AS mean, {R('std')} AS std, {R('min')} AS min, {R('max')} AS max, {R('(SELECT ' + PICK.format('norm', 0.5) + ' FROM nm)')} AS median,
  {R(CLAMPED)} AS bimodality_coefficient, {R(CONF)} AS multi_model_confidence FROM mo""")
add("r10_histogram", f"WITH {NORMS}, {histogram('nm', 'norm', 50)} SELECT * FROM hist")
CHUNKS = f"""{TEXT}, tx AS (SELECT id AS doc_id, text, source, vector, strlen(text) AS len FROM tc WHERE text IS NOT NULL),
pv AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM tx), {OVERLAP.format('doc_id', 'pv')},
lone AS (SELECT a.id FROM plain a JOIN plain b ON a.id <> b.id GROUP BY a.id HAVING max(list_cosine_similarity(a.vector, b.vector)) < 0.5),
iss AS (SELECT id, issue FROM ({LENGTH.replace('FROM documents', 'FROM tx')}) UNION ALL ({BOUNDARY.replace('FROM documents', 'FROM tx')})
  UNION ALL SELECT doc_id, 'high_overlap' FROM ov WHERE overlap IS NOT NULL UNION ALL SELECT id, 'orphan' FROM lone)"""
add("r11_chunk_issues", f"WITH {CHUNKS} SELECT id, issue FROM iss")
QUALITY = "greatest(0.0, least(100.0, 100.0 - (SELECT count(*) FROM iss) / count(*) * 100.0))"
add("r11_chunk_summary", f"""
WITH {CHUNKS} SELECT 'text' AS content_field, count(*) AS n, {R(QUALITY)} AS quality_score, {GRADE.format(f'floor({QUALITY})')} AS grade, {R('avg(len)')} AS mean, {R(PICK.format('len', 0.5) + '::DOUBLE')} AS median,
  min(len) AS min, max(len) AS max, {R('stddev_pop(len)')} AS std FROM tx""")
add("r11_length_histogram", f"WITH {CHUNKS}, {histogram('tx', 'len', 20)} SELECT * FROM hist")
add("r12_distance_health", f"""
WITH {STRIDED}, {DIMS[len(PLAIN) + 2:]}, {EFF}, x AS (SELECT {DISC} AS score FROM sp)
SELECT count(*) AS n, {R('avg(dist)')} AS mean, {R('stddev_pop(dist)')} AS std, {R('min(dist)')} AS min, {R('max(dist)')} AS max, {R(PICK.format('dist', 0.5))} AS median, {R('any_value(score)')} AS discrimination_score,
  any_value(effective_dims) AS effective_dims, any_value(actual_dims) AS actual_dims, 10 AS recall_k, 1.0::DOUBLE AS recall_at_k, (SELECT least(50, count(*)) FROM plain) AS samples_tested,
  CASE WHEN any_value(score) > 0.5 THEN 'healthy' WHEN any_value(score) > 0.3 THEN 'moderate' ELSE 'unhealthy' END AS overall FROM sp, eff, x""")
add("r12_distance_histogram", f"WITH {STRIDED}, {histogram('sp', 'dist', 30).replace('sp AS (', 'sq AS (', 1).replace(', sp GROUP', ', sq GROUP').replace('FROM sp, range', 'FROM sq, range')} SELECT * FROM hist")
