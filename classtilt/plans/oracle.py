"""The registered queries once more, as plain SQL for DuckDB over the same tables."""

from __future__ import annotations

from classtilt import rules
from classtilt.operators.contrasts import declared_pairs
from classtilt.plans.views import PREDICTIONS_SQL, RECORDS_SQL

ORACLE: dict[str, str] = {}


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def r6(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0" + (f" AS {name}" if name else "")


def r6l(expr: str, name: str) -> str:
    return f"list_transform({expr}, lambda v: round(CAST(v AS DOUBLE), 6) + 0.0) AS {name}"


def draw(*parts: str) -> str:
    return "CAST('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 8) AS BIGINT)"


RECORDS = "records AS (" + RECORDS_SQL.format(lineitem="lineitem", open="[", close="]") + ")"
RESULTS = RECORDS + ", results AS (SELECT * FROM records WHERE status = 'VALID')"
PREDICTIONS = "predictions AS (" + PREDICTIONS_SQL.format(lineitem="lineitem") + ")"
TRAIN = "train AS (SELECT vec_id AS id, label AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
CONFUSION = (
    PREDICTIONS
    + """, scored AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS yhat
  FROM predictions),
conf AS (SELECT f.fold, a.c AS y, b.c AS yhat,
    (SELECT count(*) FROM scored s WHERE s.fold = f.fold AND s.y = a.c AND s.yhat = b.c) AS n
  FROM (SELECT DISTINCT fold FROM scored) f, (SELECT unnest([0, 1, 2]) AS c) a, (SELECT unnest([0, 1, 2]) AS c) b),
margins AS (SELECT fold, c AS class, CAST(sum(CASE WHEN y = c AND yhat = c THEN n ELSE 0 END) AS DOUBLE) AS tp,
    CAST(sum(CASE WHEN y = c THEN n ELSE 0 END) AS DOUBLE) AS support,
    CAST(sum(CASE WHEN yhat = c THEN n ELSE 0 END) AS DOUBLE) AS predicted
  FROM conf, (SELECT unnest([0, 1, 2]) AS c) GROUP BY 1, 2),
recalls AS (SELECT *, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall FROM margins)"""
)

# ---- flagship ----------------------------------------------------------------------------------
ORACLE["macro_f1_by_fold"] = f"""
WITH {TRAIN},
folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('0:' || id), id) - 1) % 5 AS INT) AS fold FROM train),
fitted AS (SELECT f.id, f.y, f.x, g.g AS fold FROM folds f, (SELECT unnest(range(5)) AS g) g WHERE g.g <> f.fold),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fold, y ORDER BY md5('0:under:' || id), id) AS r,
    count(*) OVER (PARTITION BY fold, y) AS n FROM fitted),
under AS (SELECT id, y, x, fold FROM (SELECT *, min(n) OVER (PARTITION BY fold) AS m FROM ranked) WHERE r <= m),
both_sets AS (SELECT 'raw' AS condition, * FROM fitted UNION ALL SELECT 'random_under', * FROM under),
cells AS (SELECT condition, fold, y, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM both_sets),
centroids AS (SELECT condition, fold, y AS c, list(m ORDER BY i) AS m
  FROM (SELECT condition, fold, y, i, avg(v) AS m FROM cells GROUP BY ALL) GROUP BY ALL),
gaps AS (SELECT c.condition, c.fold, f.id, f.y, c.c,
    round(list_sum(list_transform(list_zip(f.x, c.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d
  FROM folds f JOIN centroids c ON f.fold = c.fold),
pred AS (SELECT condition, fold, y, c AS yhat
  FROM (SELECT *, row_number() OVER (PARTITION BY condition, fold, id ORDER BY d, c) AS r FROM gaps) WHERE r = 1),
per AS (SELECT condition, fold, c, CAST(sum(CASE WHEN y = c AND yhat = c THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
    sum(CASE WHEN y = c THEN 1 ELSE 0 END) + sum(CASE WHEN yhat = c THEN 1 ELSE 0 END) AS total
  FROM pred, (SELECT unnest(range(10)) AS c) GROUP BY ALL)
SELECT condition, CAST(fold AS BIGINT) AS fold, {r6("avg(CASE WHEN total = 0 THEN 0 ELSE 2 * tp / total END)", "macro_f1")}
FROM per GROUP BY ALL"""

# ---- audit -------------------------------------------------------------------------------------
ORACLE["aud_profile"] = f"""
WITH c AS (SELECT source, lang, count(*) AS n,
    bool_or(doc_id IS NULL OR text IS NULL OR lang IS NULL OR source IS NULL OR n_chars IS NULL) AS gap
  FROM documents GROUP BY 1, 2)
SELECT source, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (lang IS NOT NULL) AS n_classes,
  coalesce(min(n) FILTER (lang IS NOT NULL), 0) AS n_min, coalesce(max(n) FILTER (lang IS NOT NULL), 0) AS n_max,
  {r6("max(n) FILTER (lang IS NOT NULL) / (min(n) FILTER (lang IS NOT NULL))", "ir")},
  CAST(3 AS BIGINT) AS d_raw, bool_or(gap) AS has_missing
FROM c GROUP BY 1"""
ORACLE["aud_class_counts"] = """
SELECT p_brand, string_agg(p_type || ':' || n, '|' ORDER BY p_type) AS class_counts
FROM (SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""
ORACLE["aud_class_share"] = f"""
SELECT source, row_number() OVER (PARTITION BY source ORDER BY lang) - 1 AS class_index, lang AS label,
  {r6("n / sum(n) OVER (PARTITION BY source)", "proportion")}
FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2)"""
BAND = (
    "CASE WHEN {0} < 2 THEN 'near_balanced_ir_lt_2' WHEN {0} < 5 THEN 'mild_ir_2_to_5' "
    "WHEN {0} <= 20 THEN 'moderate_ir_5_to_20' WHEN {0} > 20 THEN 'severe_ir_gt_20' END"
)
ORACLE["aud_band"] = f"""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2),
p AS (SELECT p_brand, max(n) / min(n) AS ir FROM c GROUP BY 1)
SELECT p_brand, {r6("ir", "ir")}, {BAND.format("ir")} AS imbalance_band FROM p"""
ORACLE["aud_missing"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM events"
    for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
)
ORACLE["aud_duplicates"] = """
SELECT l_returnflag, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT l_returnflag, l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1"""
ORACLE["aud_label_conflict"] = """
SELECT l_linestatus, count(*) FILTER (n > 1) AS "groups"
FROM (SELECT l_linestatus, l_partkey, l_suppkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1, 2, 3)
GROUP BY 1"""
ORACLE["aud_unique_nonempty"] = """
SELECT md5(v) AS value_md5, count(*) AS n, CASE WHEN v = '' THEN 'empty' ELSE 'duplicate' END AS problem
FROM (SELECT trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS v FROM documents)
GROUP BY v HAVING v = '' OR count(*) > 1"""
ORACLE["aud_min_support"] = """
WITH c AS (SELECT p_brand, p_size, p_type, count(*) AS n FROM part GROUP BY 1, 2, 3),
p AS (SELECT p_brand, p_size, count(*) AS n_classes, min(n) AS n_min FROM c GROUP BY 1, 2)
SELECT p_brand, CAST(p_size AS BIGINT) AS p_size, n_classes, n_min,
  CASE WHEN n_classes < 3 THEN 'fewer than three classes' ELSE 'smallest class has fewer rows than folds' END AS problem
FROM p WHERE n_classes < 3 OR n_min < 5"""
REGISTRY = f"""
tc AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2),
prof AS (SELECT p_brand, sum(n) AS n, count(*) AS n_classes, min(n) AS n_min, max(n) / min(n) AS ir FROM tc GROUP BY 1),
registry AS (SELECT p_brand AS dataset_id, 'part' AS source, 'part:' || p_brand AS source_id, n, n_classes, n_min, ir,
  'v' || n || ' table' AS source_version, sha256(p_brand) AS raw_sha256,
  CASE WHEN n % 3 = 0 THEN 'mixed' WHEN n % 3 = 1 THEN 'numeric' ELSE 'categorical' END AS feature_type,
  n % 7 = 0 AS timed, n % 5 <> 0 AS passed, {BAND.format("ir")} AS imbalance_band,
  CASE WHEN n % 11 = 0 THEN NULL ELSE n % 2 = 0 END AS flag, CASE WHEN n % 2 = 0 THEN '' ELSE 'small' END AS why,
  CASE WHEN n % 3 = 0 THEN '{";".join(rules.MIXED_CONDITIONS)}' WHEN n % 3 = 1 THEN '{";".join(rules.NUMERIC_CONDITIONS)}'
    ELSE '' END AS conditions FROM prof)"""
ORACLE["aud_eligibility"] = f"""
WITH {REGISTRY}, j AS (SELECT *, concat_ws('; ',
  CASE WHEN n_classes < 3 OR n_min < 10 THEN 'minimum row/class/minority-support rule is not met' END,
  CASE WHEN feature_type = 'categorical' THEN 'feature type is outside the numeric/mixed core benchmark' END,
  CASE WHEN timed THEN 'time-ordered data is excluded from the core benchmark' END,
  CASE WHEN NOT passed THEN 'leakage audit is not marked pass' END,
  CASE WHEN feature_type = 'categorical' THEN 'unsupported feature representation' END) AS reasons FROM registry)
SELECT dataset_id, reasons = '' AS expected_eligible, reasons, flag = (reasons = '') AS agrees,
  CASE WHEN flag IS NULL THEN 'eligible is not boolean'
       WHEN flag <> (reasons = '') THEN 'eligible disagrees with the rules'
       WHEN reasons <> '' AND why = '' THEN 'ineligible row has no exclusion_reason' END AS problem FROM j"""
ORACLE["aud_quota"] = f"""
WITH {REGISTRY}, e AS (SELECT * FROM registry WHERE flag),
w AS (SELECT * FROM (VALUES {", ".join(f"('feature_type', '{v}', {n})" for v, n in rules.FEATURE_QUOTAS.items())},
  {", ".join(f"('imbalance_band', '{v}', {n})" for v, n in rules.BAND_QUOTAS.items())}) AS q(dimension, value, minimum)),
c AS (SELECT dimension, value, CAST(minimum AS BIGINT) AS minimum, (SELECT count(*) FROM e
  WHERE CASE dimension WHEN 'feature_type' THEN feature_type ELSE imbalance_band END = value) AS n FROM w)
SELECT dimension, value, n, minimum, n >= minimum AS ok FROM c
UNION ALL SELECT 'datasets', '40-60', count(*), 40, count(*) BETWEEN 40 AND 60 FROM e"""
MANIFEST = """, manifest AS (SELECT CASE WHEN n % 17 = 0 THEN dataset_id || '-x' ELSE dataset_id END AS dataset_id,
  CASE WHEN n % 4 = 0 THEN 'parts' ELSE source END AS source, source_id, 'v' || n AS source_version,
  upper(raw_sha256) AS raw_sha256 FROM registry WHERE n % 13 <> 0)"""
ORACLE["aud_reconcile_keys"] = f"""
WITH {REGISTRY}{MANIFEST}
SELECT dataset_id, 'left only' AS side FROM registry WHERE dataset_id NOT IN (SELECT dataset_id FROM manifest)
UNION ALL SELECT dataset_id, 'right only' FROM manifest WHERE dataset_id NOT IN (SELECT dataset_id FROM registry)"""
ORACLE["aud_reconcile_fields"] = f"""
WITH {REGISTRY}{MANIFEST}
SELECT r.dataset_id, 'source' AS field, r.source AS "left", m.source AS "right"
FROM registry r JOIN manifest m USING (dataset_id) WHERE r.source <> m.source"""
ORACLE["aud_applicability_parse"] = f"""
WITH {REGISTRY}
SELECT dataset_id, CASE WHEN feature_type = 'categorical' THEN CAST([] AS VARCHAR[]) ELSE list_prepend(feature_type,
    list_filter([{listed(rules.CONDITIONS)}], lambda c: list_contains(string_split(conditions, ';'), c))) END AS conditions,
  CASE WHEN feature_type = 'categorical' THEN 'applicable_families contains an empty semicolon-delimited value' END AS errors
FROM registry"""

PROBLEMS = f"""
problems AS (
  SELECT dataset_id, 'eligible must be true or false' AS problem FROM registry WHERE flag IS NULL
  UNION ALL SELECT dataset_id, 'eligible row does not have passing leakage status' FROM registry WHERE flag AND NOT passed
  UNION ALL SELECT dataset_id, 'eligible row has incomplete source_url provenance' FROM registry WHERE flag AND n % 4 = 0)"""
ORACLE["aud_eligible_provenance"] = f"WITH {REGISTRY}, {PROBLEMS} SELECT * FROM problems"
ORACLE["aud_scope_summary"] = f"""
WITH {REGISTRY}, {PROBLEMS},
b AS (SELECT coalesce(list(DISTINCT dataset_id || ': ' || problem ORDER BY dataset_id || ': ' || problem), []) AS blockers FROM problems),
i AS (SELECT list(dataset_id ORDER BY dataset_id) AS dataset_ids, count(*) AS n FROM registry WHERE flag),
c AS (SELECT list(DISTINCT c ORDER BY c) AS f FROM (SELECT unnest(list_prepend(feature_type, string_split(conditions, ';'))) AS c
  FROM registry WHERE feature_type <> 'categorical'))
SELECT dataset_ids, n AS dataset_count, f AS applicable_families, n AS matrix_rows, blockers,
  CASE WHEN len(blockers) = 0 AND n > 0 THEN 'ready' ELSE 'pending' END AS status FROM i, c, b"""
ORACLE["aud_pilot_evidence"] = f"""
WITH {RECORDS}, e AS (SELECT dataset AS dataset_id, feature_type, count(*) AS n, count(*) FILTER (status = 'VALID') AS v,
  count(*) FILTER (status = 'FAILED') AS f, sum(fit_predict_seconds) AS s FROM records GROUP BY 1, 2)
SELECT dataset_id, 'expected_cells must equal 405' AS problem FROM e WHERE n <> 405
UNION ALL SELECT dataset_id, 'valid and failure cells do not cover expected cells' FROM e WHERE feature_type = 'mixed'
UNION ALL SELECT dataset_id, 'valid_cells does not match the results' FROM e WHERE feature_type = 'mixed'
UNION ALL SELECT dataset_id, 'runtime exceeds the budget' FROM e WHERE s > 25000
UNION ALL SELECT dataset_id, 'failure review is not passed' FROM e WHERE f > 60"""
CATALOG = f"""
items AS (SELECT p_partkey AS data_id, p_type || '-' || p_size AS name, CAST(1 AS BIGINT) AS version,
  CAST(floor(p_retailprice) AS BIGINT) * p_size AS n_rows, CAST(p_size % 7 + 1 AS BIGINT) AS n_classes, CAST(p_size + 5 AS BIGINT) AS n_min_class,
  CAST((p_size + 5) * (length(p_type) % 9 + 1) AS BIGINT) AS n_majority, CAST(greatest(1, p_size * 3 - 1) AS BIGINT) AS d_raw,
  CAST(p_size % 3 AS BIGINT) AS n_numeric, CAST(greatest(0, length(p_brand) - p_size % 2 - 6 - 1) AS BIGINT) AS n_symbolic
  FROM part WHERE p_size <> 13),
typed AS (SELECT *, CASE WHEN n_numeric > 0 AND n_symbolic > 0 THEN 'mixed' WHEN n_numeric > 0 THEN 'numeric'
  ELSE 'categorical-only' END AS feature_type, {BAND.format("(n_majority / n_min_class)")} AS band FROM items),
catalog AS (SELECT * FROM typed WHERE data_id NOT IN ({", ".join(map(str, rules.EXCLUDED_IDS))}) AND n_classes >= 3
  AND n_min_class >= 10 AND n_rows BETWEEN 100 AND 100000 AND d_raw BETWEEN 1 AND 1000 AND feature_type <> 'categorical-only')"""
ORACLE["src_catalog"] = f"WITH {CATALOG} SELECT * FROM catalog"
ORACLE["sel_dedupe"] = f"""
WITH {CATALOG} SELECT data_id, name FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY data_id) AS r FROM catalog)
WHERE r = 1"""

# ---- preparation -------------------------------------------------------------------------------
ORACLE["prep_label_encode"] = """
SELECT doc_id, source, lang, dense_rank() OVER (PARTITION BY source ORDER BY lang) - 1 AS y FROM documents
WHERE lang IS NOT NULL"""
ORACLE["prep_kfold"] = """
SELECT vec_id AS id, CAST(label AS BIGINT) AS y,
  (row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings"""
NESTED = f"""
outer_folds AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS y,
  (row_number() OVER (PARTITION BY label ORDER BY md5('{rules.OUTER_SEED}:' || vec_id), vec_id) - 1) % 5 AS fold
  FROM embeddings),
nested AS (SELECT id, y, g.g AS outer_fold, (row_number() OVER (PARTITION BY g.g, y
    ORDER BY md5('{rules.INNER_SEED}:' || id), id) - 1) % 3 AS inner_fold
  FROM outer_folds f, (SELECT unnest(range(5)) AS g) g WHERE g.g <> f.fold)"""
ORACLE["prep_nested_kfold"] = f"WITH {NESTED} SELECT id, y, outer_fold, inner_fold FROM nested"
ORACLE["prep_split_check"] = f"""
WITH {NESTED}
SELECT n.outer_fold,
  count(*) FILTER (EXISTS (SELECT 1 FROM outer_folds o WHERE o.id = n.id AND o.fold = n.outer_fold)) AS leaked_rows,
  count(*) - count(DISTINCT n.id) AS inner_overlap, CAST(0 AS BIGINT) AS outer_overlap
FROM nested n GROUP BY 1"""
ORDERS = """
f AS (SELECT *, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('0:' || o_orderkey), o_orderkey) - 1) % 5 AS own,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders),
u AS (SELECT f.*, g.g AS fold, g.g = own AS is_test FROM f, (SELECT unnest(range(5)) AS g) g)"""
ORACLE["prep_impute_median"] = f"""
WITH {ORDERS}, m AS (SELECT fold, quantile_cont(price, 0.5) AS med FROM u WHERE NOT is_test GROUP BY 1)
SELECT fold, is_test, count(*) AS n, {r6("avg(coalesce(price, med))", "mean")}, {r6("max(med)", "median")}
FROM u JOIN m USING (fold) GROUP BY 1, 2"""
ORACLE["prep_impute_mode"] = f"""
WITH {ORDERS}, c AS (SELECT fold, status, count(*) AS n FROM u WHERE NOT is_test AND status IS NOT NULL GROUP BY 1, 2),
m AS (SELECT fold, status AS mode FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, status) AS r FROM c)
  WHERE r = 1)
SELECT fold, is_test, coalesce(status, mode) AS status, count(*) AS n FROM u JOIN m USING (fold) GROUP BY 1, 2, 3"""
ORACLE["prep_scale"] = f"""
WITH {ORDERS}, m AS (SELECT fold, avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s FROM u WHERE NOT is_test GROUP BY 1),
z AS (SELECT fold, is_test, (o_totalprice - a) / CASE WHEN s = 0 THEN 1 ELSE s END AS v FROM u JOIN m USING (fold))
SELECT fold, is_test, {r6("min(v)", "low")}, {r6("max(v)", "high")}, {r6("avg(abs(v))", "spread")} FROM z GROUP BY 1, 2"""
ORACLE["prep_ordinal"] = f"""
WITH {ORDERS},
a AS (SELECT fold, o_orderstatus, row_number() OVER (PARTITION BY fold ORDER BY o_orderstatus) - 1 AS code
  FROM (SELECT DISTINCT fold, o_orderstatus FROM u WHERE NOT is_test)),
b AS (SELECT fold, o_orderpriority, row_number() OVER (PARTITION BY fold ORDER BY o_orderpriority) - 1 AS code
  FROM (SELECT DISTINCT fold, o_orderpriority FROM u WHERE NOT is_test))
SELECT u.fold, u.o_orderstatus, coalesce(a.code, -1) AS o_orderstatus_code, u.o_orderpriority,
  coalesce(b.code, -1) AS o_orderpriority_code, count(*) AS n
FROM u LEFT JOIN a ON a.fold = u.fold AND a.o_orderstatus = u.o_orderstatus
LEFT JOIN b ON b.fold = u.fold AND b.o_orderpriority = u.o_orderpriority GROUP BY ALL"""
ORACLE["prep_onehot"] = f"""
WITH {ORDERS},
a AS (SELECT fold, list(o_orderstatus ORDER BY o_orderstatus) AS vocab
  FROM (SELECT DISTINCT fold, o_orderstatus FROM u WHERE NOT is_test) GROUP BY 1)
SELECT u.fold, u.o_orderstatus, list_transform(a.vocab, lambda v: CASE WHEN v = u.o_orderstatus THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
  AS o_orderstatus_hot, count(*) AS n FROM u JOIN a USING (fold) GROUP BY ALL"""
ORACLE["prep_native_vocab"] = f"""
WITH {ORDERS} SELECT fold, is_test, coalesce(status, '__MISSING__') AS status, count(*) AS n FROM u GROUP BY ALL"""
ORACLE["prep_class_weight"] = f"""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2),
w AS (SELECT source, lang, sum(n) OVER (PARTITION BY source) / (count(*) OVER (PARTITION BY source) * n) AS weight FROM c)
SELECT doc_id, source, lang, {r6("weight", "weight")} FROM documents JOIN w USING (source, lang)"""

ORACLE["prep_code_to_label"] = f"""
WITH {ORDERS},
a AS (SELECT fold, list(o_orderstatus ORDER BY o_orderstatus) AS vocab FROM (SELECT DISTINCT fold, o_orderstatus FROM u WHERE NOT is_test) GROUP BY 1)
SELECT u.fold, u.o_orderstatus AS before, coalesce(a.vocab[list_position(a.vocab, u.o_orderstatus) + 1], '__MISSING__') AS label, count(*) AS n
FROM u JOIN a USING (fold) GROUP BY ALL"""
ORACLE["prep_feature_assembly"] = f"""
WITH {ORDERS}, med AS (SELECT fold, quantile_cont(price, 0.5) AS med FROM u WHERE NOT is_test GROUP BY 1),
f1 AS (SELECT u.fold, is_test, coalesce(price, med) AS v, coalesce(status, (SELECT mode FROM (SELECT fold, status AS mode,
  row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, status) AS r FROM u WHERE NOT is_test AND status IS NOT NULL GROUP BY fold, status) m
  WHERE m.fold = u.fold AND r = 1)) AS c FROM u JOIN med USING (fold)),
sc AS (SELECT fold, avg(v) AS a, stddev_pop(v) AS s FROM f1 WHERE NOT is_test GROUP BY 1)
SELECT fold, is_test, count(*) AS n, CAST(3 AS BIGINT) AS width, {r6("min((v - a) / s)", "low")}, {r6("max((v - a) / s)", "high")},
  {r6("count(*) FILTER (c = 'F')", "first")}, {r6("count(*) FILTER (c = 'O')", "second")} FROM f1 JOIN sc USING (fold) GROUP BY 1, 2"""

# ---- resampling --------------------------------------------------------------------------------
PAIRS = """
pairs AS (SELECT a.id, a.y, b.id AS nb_id, b.y AS ny, list_distance(a.x, b.x) AS d FROM train a JOIN train b ON a.id <> b.id),
near_all AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb_id) AS rank FROM pairs),
near_own AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb_id) AS rank FROM pairs WHERE y = ny)"""
CLASSES = """
sizes AS (SELECT y, count(*) AS n FROM train GROUP BY 1),
classes AS (SELECT y, n, max(n) OVER () AS n_max, min(n) OVER () AS n_min, max(n) OVER () - n AS deficit FROM sizes)"""


def numbered(purpose: str, source: str = "train") -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('0:{purpose}:' || id), id) AS number FROM {source})"""


ORACLE["rs_knn_in_class"] = f"""
WITH {TRAIN}, {PAIRS}
SELECT CAST(y AS BIGINT) AS y, id, nb_id, rank, {r6("d", "distance")} FROM near_own WHERE rank <= 5"""
ORACLE["rs_knn_all_rows"] = f"""
WITH {TRAIN}, {PAIRS} SELECT id, nb_id, rank, {r6("d", "distance")} FROM near_all WHERE rank <= 3"""
ORACLE["rs_random_over"] = f"""
WITH {TRAIN}, {CLASSES},
draws AS (SELECT y, n, unnest(range(1, deficit + 1)) AS j FROM classes WHERE deficit > 0),
picked AS (SELECT y, j, {draw("'0'", "'over'", "y", "j")} % n + 1 AS number FROM draws)
SELECT CAST(id AS VARCHAR) AS id, CAST(y AS BIGINT) AS y, {r6l("x", "x")}, false AS synthetic FROM train
UNION ALL SELECT concat_ws(':', 's', p.y, p.j), CAST(p.y AS BIGINT), {r6l("t.x", "x")}, true
FROM picked p JOIN {numbered("over")} t ON t.y = p.y AND t.number = p.number"""
ORACLE["rs_random_under"] = f"""
WITH {TRAIN}, {CLASSES}
SELECT CAST(id AS VARCHAR) AS id, CAST(t.y AS BIGINT) AS y FROM {numbered("under")} t JOIN classes c ON c.y = t.y
WHERE number <= n_min"""
ORACLE["rs_neighbours"] = """
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2),
s AS (SELECT source, n, max(n) OVER (PARTITION BY source) AS big FROM c),
f AS (SELECT source, min(n) FILTER (n < big) AS support, count(*) AS classes, sum(n) AS total FROM s GROUP BY 1),
k AS (SELECT *, least(5, support - 1) AS k FROM f),
m AS (SELECT *, least(10, greatest(k + 1, classes + 1), total - 1) AS m FROM k),
p AS (SELECT *, CASE WHEN support IS NULL THEN 'no non-majority class is available for synthesis'
  WHEN support < 2 THEN 'fewer than two training examples in the smallest targeted class'
  WHEN m < 2 THEN 'insufficient fold rows for borderline m-neighbours' END AS problem FROM m)
SELECT source, CASE WHEN problem IS NULL THEN CAST(k AS BIGINT) END AS k,
  CASE WHEN problem IS NULL THEN CAST(m AS BIGINT) END AS m, support, problem FROM p"""
ORACLE["rs_noop"] = """
SELECT p_brand, min(n) = max(n) AND count(*) > 1 AS balanced
FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1"""


def synthetic(purpose: str, base: str, wanted: str) -> str:
    return f"""
draws AS (SELECT y, n, unnest(range(1, deficit + 1)) AS j FROM {wanted} WHERE deficit > 0),
keyed AS (SELECT y, j, {draw("'0'", f"'{purpose}-base'", "y", "j")} % n + 1 AS number,
  {draw("'0'", f"'{purpose}-neighbour'", "y", "j")} % 3 + 1 AS rank,
  {draw("'0'", f"'{purpose}-gap'", "y", "j")} / 4294967296.0::DOUBLE AS gap FROM draws),
made AS (SELECT k.y, k.j, concat_ws(':', 's', k.y, k.j) AS id, k.gap, b.id AS base, o.nb_id
  FROM keyed k JOIN {numbered(purpose, base)} b ON b.y = k.y AND b.number = k.number
  JOIN near_own o ON o.id = b.id AND o.rank = k.rank)"""


GROWN = f"""
grown AS (SELECT CAST(id AS VARCHAR) AS id, y, x, false AS synthetic FROM train
  UNION ALL SELECT m.id, m.y, list_transform(list_zip(a.x, b.x), lambda z: z[1] + m.gap * (z[2] - z[1])), true
  FROM made m JOIN train a ON a.id = m.base JOIN train b ON b.id = m.nb_id)"""
SMOTE = f"{TRAIN}, {PAIRS}, {CLASSES}, {synthetic('smote', 'train', 'classes')}, {GROWN}"
SHOWN = f"SELECT id, CAST(y AS BIGINT) AS y, {r6l('x', 'x')}, synthetic FROM grown"
ORACLE["rs_smote"] = f"WITH {SMOTE} {SHOWN}"
ORACLE["rs_borderline"] = f"""
WITH {TRAIN}, {PAIRS}, {CLASSES},
others AS (SELECT id, y, count(*) FILTER (ny <> y) AS o FROM near_all WHERE rank <= 10 GROUP BY 1, 2),
danger AS (SELECT id, y FROM others WHERE o >= 5 AND o < 10),
wanted AS (SELECT c.y, c.deficit, d.n FROM classes c JOIN (SELECT y, count(*) AS n FROM danger GROUP BY 1) d USING (y)),
{synthetic('borderline', 'danger', 'wanted')}, {GROWN} {SHOWN}"""
ORACLE["rs_adasyn"] = f"""
WITH {TRAIN}, {PAIRS}, {CLASSES},
others AS (SELECT id, y, count(*) FILTER (ny <> y) AS o FROM near_all WHERE rank <= 3 GROUP BY 1, 2),
shares AS (SELECT o.id, o.y, c.deficit, o / 3.0::DOUBLE AS share, sum(o) OVER (PARTITION BY o.y) / 3.0::DOUBLE AS total
  FROM others o JOIN classes c USING (y) WHERE deficit > 0),
planned AS (SELECT *, CAST(round_even(share / total * deficit, 0) AS BIGINT) AS n FROM shares),
draws AS (SELECT y, id AS base, unnest(range(1, n + 1)) AS j FROM planned WHERE n > 0),
made AS (SELECT d.y, concat_ws(':', 's', d.y, d.base, d.j) AS id, d.base, o.nb_id,
  {draw("'0'", "'adasyn'", "d.y", "d.base", "d.j", "'gap'")} / 4294967296.0::DOUBLE AS gap
  FROM draws d JOIN near_own o ON o.id = d.base
  AND o.rank = {draw("'0'", "'adasyn'", "d.y", "d.base", "d.j", "'neighbour'")} % 3 + 1), {GROWN} {SHOWN}"""
ORACLE["rs_smotenc"] = f"""
WITH train AS (SELECT o_orderkey AS id, o_orderpriority AS y, o_totalprice AS x, o_orderstatus AS c FROM orders), {CLASSES},
pen AS (SELECT y, stddev_pop(x) AS p FROM train GROUP BY 1),
draws AS (SELECT y, n, unnest(range(1, deficit + 1)) AS j FROM classes WHERE deficit > 0),
keyed AS (SELECT y, j, {draw("'0'", "'smotenc-base'", "y", "j")} % n + 1 AS number,
  {draw("'0'", "'smotenc-neighbour'", "y", "j")} % 3 + 1 AS rank,
  {draw("'0'", "'smotenc-gap'", "y", "j")} / 4294967296.0::DOUBLE AS gap FROM draws),
based AS (SELECT k.*, b.id AS base, b.x, b.c FROM keyed k JOIN {numbered("smotenc")} b ON b.y = k.y AND b.number = k.number),
pairs AS (SELECT s.base, s.y, t.id AS nb_id, t.x, t.c, (s.x - t.x) * (s.x - t.x) + CASE WHEN s.c = t.c THEN 0 ELSE p * p END AS d
  FROM (SELECT DISTINCT base, y, x, c FROM based) s JOIN train t ON t.y = s.y AND t.id <> s.base JOIN pen ON pen.y = s.y),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY d, nb_id) AS rank FROM pairs) WHERE rank <= 3),
votes AS (SELECT base, c FROM (SELECT base, c, row_number() OVER (PARTITION BY base ORDER BY count(*) DESC, c) AS r
  FROM near GROUP BY base, c) WHERE r = 1)
SELECT concat_ws(':', 's', b.y, b.j) AS id, b.y, [{r6("b.x + b.gap * (n.x - b.x)")}] AS x, [v.c] AS cats, true AS synthetic
FROM based b JOIN near n ON n.base = b.base AND n.rank = b.rank JOIN votes v ON v.base = b.base"""
ORACLE["rs_enn"] = """
WITH train AS (SELECT c_custkey AS id, c_mktsegment AS y, c_acctbal AS x FROM customer),
near AS (SELECT a.id, a.y, b.y AS ny, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x), b.id) AS rank
  FROM train a JOIN train b ON a.id <> b.id)
SELECT id, y FROM near WHERE rank <= 3 GROUP BY 1, 2 HAVING count(*) FILTER (ny <> y) = 0"""
ORACLE["rs_tomek"] = f"""
WITH {TRAIN}, {PAIRS}, one AS (SELECT * FROM near_all WHERE rank = 1)
SELECT id, CAST(y AS BIGINT) AS y FROM one a WHERE NOT (y <> ny AND EXISTS
  (SELECT 1 FROM one b WHERE b.id = a.nb_id AND b.nb_id = a.id))"""
AGAIN = """
pairs2 AS (SELECT a.id, a.y, a.synthetic, b.id AS nb_id, b.y AS ny, list_distance(a.x, b.x) AS d
  FROM grown a JOIN grown b ON a.id <> b.id),
near2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb_id) AS rank FROM pairs2)"""
ORACLE["rs_smoteenn"] = f"""
WITH {SMOTE}, {AGAIN}
SELECT id, CAST(y AS BIGINT) AS y, synthetic FROM near2 WHERE rank <= 3 GROUP BY ALL HAVING count(*) FILTER (ny <> y) = 0"""
ORACLE["rs_smotetomek"] = f"""
WITH {SMOTE}, {AGAIN}, one AS (SELECT * FROM near2 WHERE rank = 1)
SELECT id, CAST(y AS BIGINT) AS y, synthetic FROM one a WHERE NOT (y <> ny AND EXISTS
  (SELECT 1 FROM one b WHERE b.id = a.nb_id AND b.nb_id = a.id))"""
ORACLE["rs_balanced_bootstrap"] = f"""
WITH {TRAIN}, {CLASSES},
bags AS (SELECT y, n, n_min, unnest(range(3)) AS bag FROM classes),
draws AS (SELECT bag, y, n, unnest(range(1, n_min + 1)) AS j FROM bags),
keyed AS (SELECT *, {draw("'0'", "'bag'", "bag", "y", "j")} % n + 1 AS number FROM draws)
SELECT k.bag, CAST(k.y AS BIGINT) AS y, k.j, t.id FROM keyed k JOIN {numbered("bag")} t ON t.y = k.y AND t.number = k.number"""
ORACLE["rs_row_accounting"] = """
WITH c AS (SELECT o_orderpriority AS y, count(*) AS n FROM orders GROUP BY 1)
SELECT y, n AS before, max(n) OVER () AS after, 'random_over' AS condition FROM c
UNION ALL SELECT y, n, min(n) OVER (), 'random_under' FROM c"""
UNSUPPORTED = "CASE " + " ".join(
    f"WHEN feature_type = '{f}' AND condition = '{c}' THEN '{m}'" for (f, c), m in rules.UNSUPPORTED_MESSAGES.items()
) + " END"
ORACLE["rs_gate"] = f"""
WITH {RECORDS}, m AS (SELECT *, {UNSUPPORTED} AS message FROM records)
SELECT dataset, CAST(seed AS BIGINT) AS seed, CAST(fold AS BIGINT) AS fold, feature_type, classifier, condition,
  message AS error, 'applicability' AS stage, 'ValueError' AS error_type FROM m WHERE message IS NOT NULL"""

# ---- metrics and thresholds --------------------------------------------------------------------
FOLD = "CAST(fold AS BIGINT) AS fold"
ORACLE["met_confusion"] = f"""
WITH {CONFUSION} SELECT {FOLD}, CAST(y AS BIGINT) AS y, CAST(yhat AS BIGINT) AS yhat, n FROM conf"""
F1 = "avg(CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted) END)"
GMEAN = "CASE WHEN min(recall) = 0 THEN 0 ELSE power(product(recall), 1.0 / count(*)) END"
MCC = """(sum(tp) * sum(support) - sum(predicted * support))
  / sqrt((sum(support) * sum(support) - sum(predicted * predicted)) * (sum(support) * sum(support) - sum(support * support)))"""
BALANCED = "avg(recall) FILTER (support > 0)"
ORACLE["met_macro_f1"] = f"WITH {CONFUSION} SELECT {FOLD}, {r6(F1, 'value')} FROM margins GROUP BY fold"
RECALL_LIST = r6l("list(recall ORDER BY class)", "per_class_recall")
ORACLE["met_recall"] = f"WITH {CONFUSION} SELECT {FOLD}, {RECALL_LIST} FROM recalls GROUP BY fold"
ORACLE["met_gmean"] = f"WITH {CONFUSION} SELECT {FOLD}, {r6(GMEAN, 'value')} FROM recalls GROUP BY fold"
ORACLE["met_mcc"] = f"WITH {CONFUSION} SELECT {FOLD}, {r6(MCC, 'value')} FROM margins GROUP BY fold"
ORACLE["met_balanced_acc"] = f"WITH {CONFUSION} SELECT {FOLD}, {r6(BALANCED, 'value')} FROM recalls GROUP BY fold"
LONG = """
long AS (SELECT fold, y, 0 AS class, p0 AS p FROM predictions UNION ALL SELECT fold, y, 1, p1 FROM predictions
  UNION ALL SELECT fold, y, 2, p2 FROM predictions)"""
AP = f"""{LONG},
steps AS (SELECT fold, class, p, count(*) AS n, count(*) FILTER (y = class) AS tp FROM long GROUP BY 1, 2, 3),
curve AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM steps
  WINDOW w AS (PARTITION BY fold, class ORDER BY p DESC)),
ap AS (SELECT fold, class, sum(tp * (ctp / cn)) / sum(tp) AS ap, CAST(sum(tp) AS BIGINT) AS positives,
  CAST(sum(n) - sum(tp) AS BIGINT) AS negatives FROM curve GROUP BY 1, 2)"""
ORACLE["met_ap"] = f"""
WITH {PREDICTIONS}, {AP}
SELECT {FOLD}, CAST(class AS BIGINT) AS class, {r6("ap", "ap")}, positives, negatives FROM ap"""
ORACLE["met_macro_ap"] = f"""
WITH {PREDICTIONS}, {AP}
SELECT {FOLD}, {r6("avg(ap)", "value")}, CASE WHEN min(positives) > 0 AND min(negatives) > 0 THEN 'VALID'
  ELSE 'NOT APPLICABLE' END AS status FROM ap GROUP BY fold"""
BRIER = "avg(power(p - CASE WHEN y = class THEN 1 ELSE 0 END, 2))"
LOSS = "avg(-ln(greatest(p, 2.220446049250313e-16))) FILTER (y = class)"
ORACLE["met_brier"] = f"WITH {PREDICTIONS}, {LONG} SELECT {FOLD}, {r6(BRIER, 'value')} FROM long GROUP BY fold"
ORACLE["met_log_loss"] = f"WITH {PREDICTIONS}, {LONG} SELECT {FOLD}, {r6(LOSS, 'value')} FROM long GROUP BY fold"
ORACLE["met_validate_proba"] = f"""
WITH {PREDICTIONS}
SELECT {FOLD}, CAST(y AS BIGINT) AS y, 'probabilities have the wrong shape' AS problem, count(*) AS n
FROM predictions WHERE y = 1 GROUP BY fold, y"""
SHIFTED = """
shifted AS (SELECT fold, y, p0 AS s0, p1 / exp(-0.5::DOUBLE) AS s1, p2 / exp(0.25::DOUBLE) AS s2 FROM predictions),
applied AS (SELECT fold, y, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS yhat FROM shifted)"""
ORACLE["thr_apply"] = f"""
WITH {PREDICTIONS}, {SHIFTED}
SELECT {FOLD}, CAST(y AS BIGINT) AS y, CAST(yhat AS BIGINT) AS yhat, count(*) AS n FROM applied GROUP BY fold, y, yhat"""
F1_BY = """avg(CASE WHEN total = 0 THEN 0 ELSE 2 * tp / total END)"""
ORACLE["met_bundle"] = f"""
WITH {CONFUSION}, {AP}, {SHIFTED},
cal AS (SELECT fold, c, CAST(count(*) FILTER (y = c AND yhat = c) AS DOUBLE) AS tp,
  count(*) FILTER (y = c) + count(*) FILTER (yhat = c) AS total
  FROM applied, (SELECT unnest([0, 1, 2]) AS c) GROUP BY 1, 2),
a AS (SELECT fold, {r6(F1, "macro_f1_argmax")}, {r6(GMEAN, "g_mean_argmax")}, {r6(MCC, "mcc_argmax")},
  {r6(BALANCED, "balanced_accuracy_argmax")}, {r6l("list(recall ORDER BY class)", "per_class_recall_argmax")}
  FROM recalls GROUP BY 1),
b AS (SELECT fold, {r6(F1_BY, "macro_f1_calibrated")} FROM cal GROUP BY 1),
c AS (SELECT fold, {r6("avg(ap)", "macro_average_precision")}, 'VALID' AS status,
  {r6l("list(ap ORDER BY class)", "per_class_average_precision")} FROM ap GROUP BY 1),
d AS (SELECT fold, {r6(BRIER, "multiclass_brier")}, {r6(LOSS, "multiclass_log_loss")} FROM long GROUP BY 1)
SELECT CAST(fold AS BIGINT) AS fold, * EXCLUDE (fold) FROM a JOIN b USING (fold) JOIN c USING (fold) JOIN d USING (fold)"""
ORACLE["thr_fit"] = f"""
WITH {PREDICTIONS},
grid AS (SELECT a.o * 0.25::DOUBLE AS o1, b.o * 0.25::DOUBLE AS o2
  FROM (SELECT unnest(range(-8, 9)) AS o) a, (SELECT unnest(range(-8, 9)) AS o) b),
s AS (SELECT fold, y, o1, o2, p0 AS s0, p1 / exp(o1) AS s1, p2 / exp(o2) AS s2 FROM predictions, grid),
hits AS (SELECT fold, o1, o2, y, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS yhat FROM s),
n AS (SELECT fold, o1, o2, y, yhat, count(*) AS n FROM hits GROUP BY ALL),
per AS (SELECT fold, o1, o2, c, CAST(sum(CASE WHEN y = c AND yhat = c THEN n ELSE 0 END) AS DOUBLE) AS tp,
  sum(CASE WHEN y = c THEN n ELSE 0 END) + sum(CASE WHEN yhat = c THEN n ELSE 0 END) AS total
  FROM n, (SELECT unnest([0, 1, 2]) AS c) GROUP BY ALL),
f AS (SELECT fold, o1, o2, {F1_BY} AS score FROM per GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(score, 12) DESC, o1 + 2 * o2, o1, o2) AS r FROM f)
SELECT {FOLD}, [0.0::DOUBLE, o1, o2] AS offsets, {r6("score", "score")}, 'VALID' AS status, CAST(NULL AS VARCHAR) AS reason
FROM r WHERE r = 1"""

ORACLE["met_cost"] = f"""
SELECT l_returnflag, {r6("sum(l_quantity)", "wall_seconds")}, {r6("sum(l_quantity) FILTER (l_linestatus = 'F')", "fit_seconds")},
  {r6("sum(l_quantity) FILTER (l_linestatus <> 'F')", "predict_seconds")} FROM lineitem GROUP BY 1"""
ORACLE["tune_inner_score"] = f"""
WITH {PREDICTIONS}, long AS (SELECT l_linenumber AS trial, CASE WHEN fold < 2 THEN 0 WHEN fold < 4 THEN 1 ELSE 2 END AS g, y, c,
  CASE c WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p FROM predictions, (SELECT unnest([0, 1, 2]) AS c)),
steps AS (SELECT trial, g, c, p, count(*) AS n, count(*) FILTER (y = c) AS tp FROM long GROUP BY ALL),
curve AS (SELECT *, sum(tp) OVER w / sum(n) OVER w AS pr FROM steps WINDOW w AS (PARTITION BY trial, g, c ORDER BY p DESC)),
ap AS (SELECT trial, g, c, sum(tp * pr) / sum(tp) AS ap FROM curve GROUP BY ALL),
m AS (SELECT trial, g, avg(ap) AS m FROM ap GROUP BY ALL)
SELECT CAST(trial AS BIGINT) AS trial, {r6("CASE WHEN count(m) = 3 THEN avg(m) END", "score")} FROM m GROUP BY 1"""
ORACLE["tune_oof"] = """
WITH c AS (SELECT o_orderpriority, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders)
SELECT o_orderpriority, count(*) FILTER (n = 0) AS missing, count(*) FILTER (n > 1) AS doubled FROM c GROUP BY 1
HAVING count(*) FILTER (n = 0) > 0 OR count(*) FILTER (n > 1) > 0"""

# ---- accounting --------------------------------------------------------------------------------
KEYS = "dataset, CAST(seed AS BIGINT) AS seed, CAST(fold AS BIGINT) AS fold, classifier, condition"
GRID = f"""
expected AS (SELECT dataset, s AS seed, f AS fold, c AS classifier, k AS condition
  FROM (SELECT DISTINCT dataset FROM records), (SELECT unnest(range(3)) AS s), (SELECT unnest(range(5)) AS f),
  (SELECT unnest([{listed(rules.CLASSIFIERS)}]) AS c), (SELECT unnest([{listed(rules.CONDITIONS)}]) AS k)),
observed AS (SELECT dataset, seed, fold, classifier, condition, count(*) FILTER (status = 'VALID') AS v,
  count(*) FILTER (status = 'FAILED') AS f FROM records GROUP BY ALL),
validated AS (SELECT dataset, seed, fold, classifier, condition, coalesce(o.v, 0) AS valid_records,
  coalesce(o.f, 0) AS failure_records, CASE WHEN e.seen IS NULL THEN 'extra' WHEN o.v IS NULL THEN 'missing'
    WHEN v > 0 AND f > 0 THEN 'valid and failed' WHEN v + f > 1 THEN 'duplicate' WHEN v = 1 THEN 'valid'
    ELSE 'failed' END AS state
  FROM (SELECT *, true AS seen FROM expected) e FULL JOIN observed o USING (dataset, seed, fold, classifier, condition))"""
ORACLE["acc_expected"] = f"WITH {RECORDS}, {GRID} SELECT {KEYS} FROM expected"
ORACLE["acc_validate"] = f"WITH {RECORDS}, {GRID} SELECT {KEYS}, valid_records, failure_records, state FROM validated"
ORACLE["acc_counts"] = f"""
WITH {RECORDS}, {GRID}
SELECT dataset, count(*) FILTER (state <> 'extra') AS expected_cells, count(*) FILTER (state = 'valid') AS valid_cells,
  count(*) FILTER (state = 'failed') AS failure_cells, count(*) FILTER (state NOT IN ('valid', 'failed')) AS violations
FROM validated GROUP BY 1"""
CATEGORY = f"""
failures AS (SELECT *, CASE WHEN error = 'fewer than six rows' THEN 'RuntimeError' ELSE 'ValueError' END AS error_type,
  CASE WHEN {UNSUPPORTED} = error THEN 'unsupported' WHEN {UNSUPPORTED} IS NOT NULL THEN 'unexpected_message'
    WHEN condition IN ({listed(rules.SAMPLER_CONDITIONS)}) AND (error = '{rules.NO_SAMPLES_MESSAGE}'
      OR contains(error, '{rules.NO_BORDER_MESSAGE}')) THEN 'sampler_specific_failure'
    ELSE 'other_applicable_failure' END AS record_category
  FROM records WHERE status = 'FAILED')"""
ORACLE["acc_failure_category"] = f"""
WITH {RECORDS}, {CATEGORY} SELECT {KEYS}, feature_type, error, record_category FROM failures"""
ORACLE["acc_failure_summary"] = f"""
WITH {RECORDS}, {CATEGORY},
r AS (SELECT feature_type, classifier, condition, 'valid' AS c FROM records WHERE status = 'VALID'
  UNION ALL SELECT feature_type, classifier, condition, record_category FROM failures),
g AS (SELECT 'overall' AS aggregation_level, 'all' AS feature_type, 'all' AS classifier, 'all' AS condition, c FROM r
  UNION ALL SELECT 'feature_classifier_condition', * FROM r),
s AS (SELECT aggregation_level, feature_type, classifier, condition, count(*) AS enumerated_records,
  count(*) FILTER (c = 'unsupported') AS unsupported_records, count(*) FILTER (c = 'valid') AS valid_records,
  count(*) FILTER (c = 'sampler_specific_failure') AS sampler_specific_failures,
  count(*) FILTER (c = 'other_applicable_failure') AS other_applicable_failures FROM g GROUP BY ALL)
SELECT *, enumerated_records - unsupported_records AS applicable_records,
  valid_records + sampler_specific_failures + other_applicable_failures AS attempted_evaluations,
  {r6("sampler_specific_failures / nullif(enumerated_records - unsupported_records, 0)", "sampler_failure_rate")} FROM s"""
ORACLE["acc_failure_reasons"] = f"""
WITH {RECORDS}, {CATEGORY}
SELECT feature_type, classifier, condition, record_category, error_type, error, count(*) AS records FROM failures GROUP BY ALL"""
ORACLE["acc_finite"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL OR NOT isfinite(CAST({c} AS DOUBLE))) AS n FROM events"
    for c in ("event_id", "user_id", "value")
)
ORACLE["acc_replay_match"] = f"""
WITH {RESULTS}, a AS (SELECT dataset, seed, fold, classifier, condition, train_rows_before_sampling AS n FROM results),
b AS (SELECT dataset, seed, fold, classifier, condition, CASE WHEN seed = 2 THEN n + 1 ELSE n END AS n FROM a)
SELECT side, {KEYS}, n AS train_rows_before_sampling, CAST(1 AS BIGINT) AS surplus FROM (
  SELECT 'first' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
  UNION ALL SELECT 'replay', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))"""
ORACLE["acc_run_evidence"] = f"""
WITH {RECORDS}
SELECT dataset, count(*) FILTER (status = 'VALID') AS valid_cells, count(*) FILTER (status = 'FAILED') AS failure_cells,
  {r6("sum(fit_predict_seconds) FILTER (status = 'VALID')", "wall_seconds")}, CAST(NULL AS DOUBLE) AS peak_mb,
  sum(fit_predict_seconds) FILTER (status = 'VALID') <= 10000 AS within_budget, count(*) = 405 AS complete
FROM records GROUP BY 1"""
RAW = f"""{RECORDS}, raw AS (SELECT dataset, CASE WHEN status = 'FAILED' THEN 'x1' ELSE CAST(seed AS VARCHAR) END AS seed,
  CAST(fold AS BIGINT) AS fold, classifier, condition, seed AS s, status FROM records)"""
ORACLE["acc_key_types"] = f"""
WITH {RAW} SELECT dataset, seed, fold, classifier, condition, 'seed is not an integer' AS problem FROM raw WHERE status = 'FAILED'"""
ORACLE["acc_json_array"] = f"""
WITH {RAW} SELECT dataset, seed, fold, classifier, condition, CASE WHEN s = 1 THEN 'empty list' ELSE 'invalid JSON' END AS problem
FROM raw WHERE s = 1 OR (s = 2 AND fold = 0)"""
ORACLE["acc_status_values"] = f"WITH {RAW} SELECT status, count(*) AS n FROM raw WHERE status <> 'VALID' GROUP BY 1"
ORACLE["acc_failure_record"] = f"""
WITH {RECORDS} SELECT dataset AS dataset_id, CAST(fold AS BIGINT) AS outer_fold, CAST(seed AS BIGINT) AS outer_seed, classifier, condition,
  feature_type, 'outer_fit_predict' AS stage, 'ValueError' AS exception_type, error AS reason, 'APPLICABLE' AS applicability,
  0.0::DOUBLE AS wall_seconds, 'failed' AS resource_status, CAST(0 AS BIGINT) AS retry_count, CAST(1 AS BIGINT) AS worker_count,
  false AS timeout, '' AS config_sha256, '{rules.FAILED}' AS status FROM records WHERE status = 'FAILED'"""
ORACLE["acc_plan"] = f"""
WITH {RECORDS}, {REGISTRY}, {PROBLEMS},
b AS (SELECT list(DISTINCT problem ORDER BY problem) AS blockers FROM problems),
d AS (SELECT count(DISTINCT dataset) AS n FROM records)
SELECT n AS dataset_count, n * 495 AS expected_cells, CAST(5 AS BIGINT) AS folds, CAST(20 AS BIGINT) AS trials, blockers,
  CASE WHEN len(blockers) = 0 THEN 'READY' ELSE 'BLOCKED' END AS status FROM d, b"""
ORACLE["acc_gate_totals"] = f"""
WITH {RECORDS}, {GRID}
SELECT 'aggregate valid_cells differs from the dataset sum' AS problem
UNION ALL SELECT 'outputs do not cover the grid' FROM validated HAVING count(*) FILTER (state IN ('valid', 'failed')) <> count(*) FILTER (state <> 'extra')"""
ORACLE["acc_marker_stale"] = f"""
WITH {RECORDS}, {GRID}, f AS (SELECT dataset FROM validated GROUP BY 1 HAVING count(*) FILTER (state = 'failed') > 20)
SELECT dataset, 'complete marker is not complete' AS problem FROM f
UNION ALL SELECT DISTINCT dataset, 'stale config_sha256' FROM records WHERE feature_type = 'mixed'"""
ORACLE["shard_validate"] = """
SELECT p_brand || ' is not locked' AS problem FROM part GROUP BY p_brand
HAVING count(*) FILTER (p_size = 13 AND p_type = 'PROMO') = 0"""
ORACLE["shard_plan"] = """
WITH i AS (SELECT DISTINCT p_brand AS dataset FROM part),
d AS (SELECT dataset, (row_number() OVER (ORDER BY dataset) - 1) % 4 AS s FROM i)
SELECT 'shard-' || lpad(CAST(s + 1 AS VARCHAR), 2, '0') AS shard_id, list(dataset ORDER BY dataset) AS dataset_ids,
  count(*) * 495 AS expected_cells FROM d GROUP BY s"""

# ---- cells and statistics ----------------------------------------------------------------------
FAMILY_ROWS = ", ".join(
    f"('{family}', '{kind}', '{classifier}', '{condition}', {position}, {len(conditions)})"
    for family, (kind, conditions) in rules.FAMILIES.items()
    for classifier in rules.family_classifiers(family)
    for position, condition in enumerate(conditions)
)
DONE = "HAVING count(*) = 15 AND count(DISTINCT seed) = 3 AND count(DISTINCT fold) = 5"
CELLS = f"""{RESULTS},
cells AS (SELECT dataset, classifier, condition, feature_type, count(*) AS complete_records, avg(macro_f1) AS macro_f1,
  avg(g_mean) AS g_mean, avg(mcc) AS mcc, avg(balanced_accuracy) AS balanced_accuracy
  FROM results GROUP BY dataset, classifier, condition, feature_type {DONE}),
long AS (SELECT dataset, classifier, condition, feature_type, metric, value FROM cells
  UNPIVOT (value FOR metric IN (macro_f1, g_mean, mcc, balanced_accuracy))),
families(family, feature_type, classifier, condition, position, size) AS (VALUES {FAMILY_ROWS}),
fam AS (SELECT f.family, f.position, f.size, l.* FROM long l JOIN families f USING (feature_type, classifier, condition))"""
BLOCKS = f"""{CELLS},
avail AS (SELECT family, classifier, metric, count(DISTINCT condition) AS k FROM fam GROUP BY ALL),
blocks AS (SELECT * FROM (SELECT fam.*, k, count(*) OVER (PARTITION BY family, classifier, metric, dataset) AS own
  FROM fam JOIN avail USING (family, classifier, metric)) WHERE own = k),
ranked AS (SELECT *, rank() OVER (PARTITION BY family, classifier, metric, dataset ORDER BY value)
  + (count(*) OVER (PARTITION BY family, classifier, metric, dataset, value) - 1) / 2.0::DOUBLE AS rk,
  count(*) OVER (PARTITION BY family, classifier, metric, dataset, value) AS tied FROM blocks),
sums AS (SELECT family, classifier, metric, condition, sum(rk) AS s, count(*) AS n, sum(tied * tied - 1) AS ties
  FROM ranked GROUP BY ALL),
fried AS (SELECT family, classifier, metric, max(n)::DOUBLE AS n, count(*)::DOUBLE AS k, sum(s * s) AS sq, sum(ties) AS ties
  FROM sums GROUP BY ALL),
stat AS (SELECT *, 1 - ties / (n * (k * k * k - k)) AS tie_correction,
  (12 / (n * k * (k + 1)) * sq - 3 * n * (k + 1)) / (1 - ties / (n * (k * k * k - k))) AS stat FROM fried)"""


def chi2(x: str, df: str) -> str:
    return (
        f"CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0, 1 - list_sum(list_transform(range(0, 600), lambda i: "
        f"exp(({df}) / 2.0 * ln(({x}) / 2.0) - ({x}) / 2.0 + i * ln(({x}) / 2.0) - lgamma(({df}) / 2.0 + i + 1))))) END"
    )


DELTAS = f"""{CELLS},
deltas AS (SELECT a.family, a.classifier, a.metric, a.dataset, a.condition, r.value AS raw_mean, a.value AS alternative_mean,
  a.value - r.value AS delta FROM fam a JOIN fam r ON r.family = a.family AND r.classifier = a.classifier
  AND r.metric = a.metric AND r.dataset = a.dataset AND r.condition = 'raw' WHERE a.condition <> 'raw')"""
WTL = """count(*) FILTER (delta > 1e-12) AS wins, count(*) FILTER (abs(delta) <= 1e-12) AS ties,
  count(*) FILTER (delta < -1e-12) AS losses"""
ORACLE["st_cell_means"] = f"""
WITH {CELLS} SELECT dataset, classifier, condition, feature_type, complete_records, {r6("macro_f1", "macro_f1")},
  {r6("g_mean", "g_mean")}, {r6("mcc", "mcc")}, {r6("balanced_accuracy", "balanced_accuracy")} FROM cells"""
CLASS_MEANS = f"""{RESULTS},
u AS (SELECT dataset, classifier, condition, feature_type, seed, fold, unnest(per_class_recall) AS r,
  generate_subscripts(per_class_recall, 1) - 1 AS class_index FROM results),
class_means AS (SELECT dataset, classifier, condition, feature_type, class_index, avg(r) AS recall, count(*) AS complete_records
  FROM u GROUP BY dataset, classifier, condition, feature_type, class_index {DONE})"""
ORACLE["st_class_means"] = f"WITH {CLASS_MEANS} SELECT * REPLACE ({r6('recall')} AS recall) FROM class_means"
ORACLE["st_efficiency"] = f"""
WITH {RESULTS}
SELECT dataset, classifier, condition, feature_type, count(*) AS complete_records,
  {r6("avg(fit_predict_seconds)", "fit_predict_seconds_mean")}, {r6("median(fit_predict_seconds)", "fit_predict_seconds_median")},
  {r6("avg(train_rows_before_sampling)", "train_rows_before_sampling_mean")},
  {r6("median(train_rows_before_sampling)", "train_rows_before_sampling_median")}
FROM results GROUP BY dataset, classifier, condition, feature_type {DONE}"""
MEANS = f"""{RESULTS},
means AS (SELECT dataset, feature_type, classifier, condition, avg(macro_f1) AS macro_f1, avg(g_mean) AS g_mean, avg(mcc) AS mcc,
  avg(balanced_accuracy) AS balanced_accuracy FROM results GROUP BY ALL),
ml AS (SELECT * FROM means UNPIVOT (score FOR metric IN (macro_f1, g_mean, mcc, balanced_accuracy)))"""
ORACLE["st_rankings"] = f"""
WITH {MEANS}
SELECT dataset, feature_type, classifier, condition, metric, {r6("score", "score")},
  {r6("rank() OVER (PARTITION BY dataset, feature_type, classifier, metric ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, feature_type, classifier, metric, score) - 1) / 2.0", "rank")}
FROM ml"""
ORACLE["st_family_matrix"] = f"""
WITH {CELLS} SELECT dataset, {", ".join(r6(f"max(macro_f1) FILTER (condition = '{c}')", c) for c in rules.FAMILIES["numeric_core"][1])}
FROM cells WHERE feature_type = 'numeric' AND classifier = 'xgboost' GROUP BY 1"""
ORACLE["st_complete_blocks"] = f"""
WITH {CELLS} SELECT family, classifier, metric, dataset, condition, {r6("value", "value")}
FROM (SELECT *, count(*) OVER (PARTITION BY family, classifier, metric, dataset) AS own FROM fam) WHERE own = size"""
ORACLE["st_baseline_deltas"] = f"""
WITH {DELTAS} SELECT family, classifier, metric, dataset, condition, {r6("raw_mean", "raw_mean")},
  {r6("alternative_mean", "alternative_mean")}, {r6("delta", "delta")} FROM deltas"""
CLASS_DELTAS = f"""{CLASS_MEANS}, families(family, feature_type, classifier, condition, position, size) AS (VALUES {FAMILY_ROWS}),
fam AS (SELECT f.family, c.* FROM class_means c JOIN families f USING (feature_type, classifier, condition)),
d AS (SELECT a.family, a.classifier, a.dataset, a.condition, a.class_index, r.recall AS raw_recall, a.recall AS alternative_recall,
  a.recall - r.recall AS delta FROM fam a JOIN fam r
  ON r.family = a.family AND r.classifier = a.classifier AND r.dataset = a.dataset AND r.class_index = a.class_index
  AND r.condition = 'raw' WHERE a.condition <> 'raw')"""
ORACLE["st_class_deltas"] = f"""
WITH {CLASS_DELTAS} SELECT family, classifier, dataset, condition, class_index, {r6("raw_recall", "raw_recall")},
  {r6("alternative_recall", "alternative_recall")}, {r6("delta", "delta")} FROM d"""
ORACLE["st_complete_gate"] = f"""
WITH {CELLS}, n AS (SELECT count(DISTINCT dataset) AS n FROM cells WHERE feature_type = 'numeric'),
k AS (SELECT classifier, count(*) AS k, n FROM cells, n WHERE feature_type = 'numeric' AND condition IN ({listed(rules.POSTHOC_CONDITIONS)}) GROUP BY 1, 3)
SELECT classifier, 'incomplete post hoc blocks' AS problem FROM k WHERE k <> n * 8
UNION ALL SELECT classifier, 'expected 9 retained numeric datasets' FROM k WHERE n <> 9"""
ORACLE["st_moderators"] = f"""
WITH {REGISTRY} SELECT dataset_id, CAST(n AS VARCHAR) AS n_rows, CAST(n_classes AS VARCHAR) AS n_classes, CAST(n_min AS VARCHAR) AS n_min_class,
  CAST(CAST(ir AS DOUBLE) AS VARCHAR) AS ir_majority_minority, feature_type FROM registry
WHERE dataset_id IN (SELECT p_brand FROM part WHERE p_size = 13 AND p_type = 'PROMO')"""
ORACLE["st_class_summary"] = f"""
WITH {CLASS_MEANS}, families(family, feature_type, classifier, condition, position, size) AS (VALUES {FAMILY_ROWS}),
fam AS (SELECT f.family, c.* FROM class_means c JOIN families f USING (feature_type, classifier, condition)),
d AS (SELECT a.family, a.classifier, a.condition, a.class_index, a.recall - r.recall AS delta FROM fam a JOIN fam r
  ON r.family = a.family AND r.classifier = a.classifier AND r.dataset = a.dataset AND r.class_index = a.class_index
  AND r.condition = 'raw' WHERE a.condition <> 'raw')
SELECT family, classifier, condition, class_index, count(*) AS n_pairs, {r6("avg(delta)", "mean_delta")},
  {r6("median(delta)", "median_delta")}, {WTL} FROM d GROUP BY 1, 2, 3, 4"""
ORACLE["st_effects"] = f"""
WITH {DELTAS},
g AS (SELECT DISTINCT family, classifier, metric, condition FROM fam a WHERE condition <> 'raw' AND EXISTS (SELECT 1 FROM fam r
  WHERE r.family = a.family AND r.classifier = a.classifier AND r.metric = a.metric AND r.condition = 'raw')),
m AS (SELECT family, classifier, metric, condition, count(*) AS n_pairs, avg(delta) AS mean_delta, median(delta) AS median_delta, {WTL}
  FROM deltas GROUP BY 1, 2, 3, 4)
SELECT family, classifier, metric, condition, coalesce(n_pairs, 0) AS n_pairs, {r6("mean_delta", "mean_delta")},
  {r6("median_delta", "median_delta")}, coalesce(wins, 0) AS wins, coalesce(ties, 0) AS ties, coalesce(losses, 0) AS losses,
  CASE WHEN n_pairs IS NULL THEN 'skipped' WHEN n_pairs < 3 THEN 'descriptive' ELSE 'computed' END AS status,
  CASE WHEN n_pairs IS NULL THEN 'no complete paired blocks' WHEN n_pairs < 3 THEN
    'fewer than three complete dataset blocks; inferential test skipped per frozen rule' END AS reason
FROM g LEFT JOIN m USING (family, classifier, metric, condition)"""
SIGNED = f"""{DELTAS},
sr AS (SELECT *, count(*) OVER (PARTITION BY family, classifier, metric, condition) AS n_pairs,
  CASE WHEN delta <> 0 THEN rank() OVER (PARTITION BY family, classifier, metric, condition, delta <> 0 ORDER BY abs(delta))
    + (count(*) OVER (PARTITION BY family, classifier, metric, condition, abs(delta)) - 1) / 2.0::DOUBLE END AS rk,
  count(*) OVER (PARTITION BY family, classifier, metric, condition, abs(delta)) AS tied FROM deltas),
wil AS (SELECT family, classifier, metric, condition, max(n_pairs) AS n_pairs, count(rk) AS n,
  coalesce(sum(rk) FILTER (delta > 0), 0) AS wp, coalesce(sum(rk) FILTER (delta < 0), 0) AS wm,
  coalesce(max(tied) FILTER (delta <> 0), 1) > 1 AS tied, list(rk) FILTER (delta <> 0) AS rks FROM sr GROUP BY 1, 2, 3, 4),
pat AS (SELECT family, classifier, metric, condition, n, wp, wm, rks, unnest(range(0, CAST(power(2, n) AS BIGINT))) AS s FROM wil),
tail AS (SELECT family, classifier, metric, condition, avg(CASE WHEN abs(list_sum(list_transform(rks, lambda r, i:
  CASE WHEN (s >> (i - 1)) & 1 = 1 THEN r ELSE -r END))) >= abs(wp - wm) - 1e-12 THEN 1 ELSE 0 END) AS p
  FROM pat GROUP BY 1, 2, 3, 4)"""
WP = "CASE WHEN n_pairs >= 3 THEN CASE WHEN n = 0 THEN 1 ELSE p END END"
PAIR_KEYS = "family, classifier, metric, condition"
ORACLE["st_rank_biserial"] = f"""
WITH {SIGNED} SELECT {PAIR_KEYS}, {r6("CASE WHEN n = 0 THEN 0 ELSE (wp - wm) / (n * (n + 1) / 2.0) END", "rank_biserial")} FROM wil"""
ORACLE["st_wilcoxon"] = f"""
WITH {SIGNED} SELECT {PAIR_KEYS}, {r6("CASE WHEN n_pairs >= 3 THEN least(wp, wm) END", "wilcoxon_statistic")},
  {r6(WP, "wilcoxon_p_value")} FROM wil LEFT JOIN tail USING ({PAIR_KEYS})"""
ORACLE["st_wilcoxon_calibration"] = f"""
WITH {SIGNED}, c AS (SELECT *, CASE WHEN n_pairs < 3 THEN 'not_run_below_three_pairs' WHEN n = 0 THEN 'degenerate_all_zero_p_one'
  WHEN NOT tied AND n = n_pairs THEN 'exact_no_ties_or_zeros' WHEN n_pairs <= 13 THEN 'exhaustive_sign_permutation'
  ELSE 'asymptotic' END AS label FROM wil)
SELECT {PAIR_KEYS}, label AS wilcoxon_calibration, n AS wilcoxon_effective_n,
  {r6("CASE WHEN n_pairs >= 3 THEN CASE WHEN n = 0 THEN 1 ELSE 2 / power(2, n) END END", "wilcoxon_min_attainable_p")} FROM c"""
ORACLE["st_holm"] = f"""
WITH {SIGNED}, t AS (SELECT {PAIR_KEYS}, {WP} AS p FROM wil LEFT JOIN tail USING ({PAIR_KEYS})),
m AS (SELECT *, count(p) OVER (PARTITION BY family, classifier, metric) AS m,
  row_number() OVER (PARTITION BY family, classifier, metric ORDER BY p NULLS LAST) AS r FROM t)
SELECT {PAIR_KEYS}, {r6("p", "wilcoxon_p_value")}, {r6("CASE WHEN p IS NOT NULL THEN least(1, max((m - r + 1) * p) OVER (PARTITION BY family, classifier, metric ORDER BY r)) END", "holm_p_value")},
  m AS holm_family_size FROM m"""
ORACLE["st_signed_rank_exact"] = f"""
WITH {SIGNED} SELECT {PAIR_KEYS}, {r6("least(wp, wm)", "wilcoxon_statistic")}, {r6("CASE WHEN n = 0 THEN 1 ELSE p END", "exact_p_value")},
  n AS n_nonzero_pairs, CAST(power(2, n) AS BIGINT) AS sign_patterns,
  {r6("CASE WHEN n = 0 THEN 1 ELSE 2 / power(2, n) END", "minimum_attainable_p")} FROM wil LEFT JOIN tail USING ({PAIR_KEYS})"""
ORACLE["st_coverage_grid"] = f"""
WITH {CELLS}, t AS (SELECT feature_type, classifier, condition, avg(macro_f1) AS m, count(DISTINCT dataset) AS n FROM cells GROUP BY ALL)
SELECT f.feature_type, c.classifier, k.condition, {r6("t.m", "mean_macro_f1")}, coalesce(t.n, 0) AS n_datasets
FROM (SELECT DISTINCT feature_type FROM cells) f CROSS JOIN (SELECT DISTINCT classifier FROM cells) c
CROSS JOIN (SELECT DISTINCT condition FROM cells) k LEFT JOIN t ON t.feature_type = f.feature_type
AND t.classifier = c.classifier AND t.condition = k.condition"""
ORACLE["st_stratified"] = f"""
WITH {DELTAS}, s AS (SELECT dataset, classifier, count(*) AS n FROM records GROUP BY 1, 2),
ratio AS (SELECT dataset, max(n) / min(n) AS ir FROM s GROUP BY 1),
j AS (SELECT d.*, CASE WHEN abs(ir - 1) <= 1e-12 THEN 'exactly_balanced_ir_1.0' WHEN ir > 1 THEN 'imbalanced_ir_gt_1.0' END AS stratum
  FROM deltas d JOIN ratio USING (dataset))
SELECT classifier, condition, metric, stratum, string_agg(DISTINCT dataset, ';' ORDER BY dataset) AS dataset_ids,
  count(*) AS n_datasets, {r6("avg(delta)", "mean_paired_delta")}, {r6("median(delta)", "median_paired_delta")}, {WTL},
  'descriptive_only_no_tests' AS inferential_status FROM j WHERE stratum IS NOT NULL GROUP BY 1, 2, 3, 4"""
ORACLE["st_box_stats"] = f"""
WITH {DELTAS}, q AS (SELECT {PAIR_KEYS}, quantile_cont(delta, 0.25) AS q1, quantile_cont(delta, 0.5) AS q2,
  quantile_cont(delta, 0.75) AS q3 FROM deltas GROUP BY ALL),
j AS (SELECT *, delta BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside FROM deltas JOIN q USING ({PAIR_KEYS}))
SELECT {PAIR_KEYS}, {r6("q1", "q1")}, {r6("q2", "median")}, {r6("q3", "q3")}, {r6("min(delta) FILTER (inside)", "whisker_low")},
  {r6("max(delta) FILTER (inside)", "whisker_high")}, count(*) FILTER (NOT inside) AS outliers
FROM j GROUP BY {PAIR_KEYS}, q1, q2, q3"""
ORACLE["st_figure_means"] = f"""
WITH {CELLS} SELECT feature_type, condition, {", ".join(r6(f"avg(macro_f1) FILTER (classifier = '{c}')", c) for c in rules.ANALYSIS_CLASSIFIERS)}
FROM cells GROUP BY 1, 2"""
ORACLE["st_friedman"] = f"""
WITH {BLOCKS},
base AS (SELECT family, classifier, metric, list(condition ORDER BY condition) AS all_c
  FROM families, (SELECT unnest([{listed(rules.METRICS)}]) AS metric) GROUP BY ALL),
have AS (SELECT family, classifier, metric, list(DISTINCT condition) AS have FROM fam GROUP BY ALL),
j AS (SELECT b.*, coalesce(h.have, []) AS have, coalesce(CAST(s.n AS BIGINT), 0) AS n_blocks, s.stat, s.k,
  array_to_string(list_filter(all_c, lambda c: NOT list_contains(coalesce(h.have, []), c)), ', ') AS missing
  FROM base b LEFT JOIN have h USING (family, classifier, metric) LEFT JOIN stat s USING (family, classifier, metric)),
r AS (SELECT *, CASE WHEN len(have) < 3 THEN 'fewer than three complete conditions'
  WHEN n_blocks < 3 THEN 'fewer than three complete dataset blocks'
  WHEN missing <> '' THEN 'incomplete condition matrix: ' || missing END AS reason FROM j)
SELECT family, classifier, metric, n_blocks, len(have) AS n_conditions, {r6("CASE WHEN reason IS NULL THEN stat END", "stat")},
  {r6("CASE WHEN reason IS NULL THEN " + chi2("stat", "k - 1") + " END", "p")},
  CASE WHEN reason IS NULL THEN 'computed' ELSE 'skipped' END AS status, reason FROM r"""
ORACLE["st_friedman_pilot"] = f"""
WITH {MEANS},
shape AS (SELECT feature_type, classifier, metric, count(DISTINCT dataset) AS n_blocks, count(DISTINCT condition) AS n_conditions,
  count(*) AS cells FROM ml GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY feature_type, classifier, metric, dataset ORDER BY score)
  + (count(*) OVER (PARTITION BY feature_type, classifier, metric, dataset, score) - 1) / 2.0::DOUBLE AS rk,
  count(*) OVER (PARTITION BY feature_type, classifier, metric, dataset, score) AS tied FROM ml),
s AS (SELECT feature_type, classifier, metric, condition, sum(rk) AS s, count(*) AS n, sum(tied * tied - 1) AS ties FROM rk GROUP BY ALL),
f AS (SELECT feature_type, classifier, metric, max(n)::DOUBLE AS n, count(*)::DOUBLE AS k, sum(s * s) AS sq, sum(ties) AS ties FROM s GROUP BY ALL),
j AS (SELECT *, (12 / (n * k * (k + 1)) * sq - 3 * n * (k + 1)) / (1 - ties / (n * (k * k * k - k))) AS stat,
  CASE WHEN n_blocks < 3 THEN 'fewer than three dataset blocks' WHEN n_conditions < 3 THEN 'fewer than three conditions for Friedman test'
    WHEN cells <> n_blocks * n_conditions THEN 'incomplete dataset-by-condition block' END AS reason
  FROM shape JOIN f USING (feature_type, classifier, metric))
SELECT feature_type, classifier, metric, n_blocks, n_conditions, {r6("CASE WHEN reason IS NULL THEN stat END", "stat")},
  {r6("CASE WHEN reason IS NULL THEN " + chi2("stat", "k - 1") + " END", "p")},
  CASE WHEN reason IS NULL THEN 'computed' ELSE 'skipped' END AS status, reason FROM j"""
ORACLE["st_mean_ranks"] = f"""
WITH {BLOCKS} SELECT family, classifier, metric, condition, {r6("avg(rk)", "mean_rank")}, count(*) AS n_blocks FROM ranked GROUP BY 1, 2, 3, 4"""
ORACLE["st_nemenyi"] = f"""
WITH {BLOCKS},
ok AS (SELECT s.* FROM stat s JOIN (SELECT DISTINCT family, classifier, size FROM families) f USING (family, classifier)
  WHERE s.n >= 3 AND s.k = f.size),
mr AS (SELECT family, classifier, metric, condition, avg(rk) AS m FROM ranked GROUP BY ALL),
pr AS (SELECT a.family, a.classifier, a.metric, a.condition AS a, b.condition AS b, o.k,
  abs(a.m - b.m) / sqrt(o.k * (o.k + 1) / (6 * o.n)) * sqrt(2) AS q
  FROM mr a JOIN mr b USING (family, classifier, metric) JOIN ok o USING (family, classifier, metric) WHERE a.condition < b.condition),
z AS (SELECT i * 0.1::DOUBLE AS z FROM (SELECT unnest(range(-80, 81)) AS i)),
phi AS (SELECT family, classifier, metric, a, b, k, q, z, z - q AS w FROM pr, z),
cdf AS (SELECT *,
  CASE WHEN abs(z) > 8 THEN CASE WHEN z > 0 THEN 1 ELSE 0 END ELSE 0.5 + z / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda n:
    exp(n * ln(greatest(z * z, 1e-300)) - z * z / 2 + n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2)))) END AS fz,
  CASE WHEN abs(w) > 8 THEN CASE WHEN w > 0 THEN 1 ELSE 0 END ELSE 0.5 + w / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda n:
    exp(n * ln(greatest(w * w, 1e-300)) - w * w / 2 + n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2)))) END AS fw FROM phi)
SELECT family, classifier, metric, a, b, {r6("least(1, greatest(0, 1 - k * 0.1 * sum(exp(-z * z / 2) / sqrt(2 * pi()) * power(greatest(0, fz - fw), k - 1))))", "p")}
FROM cdf GROUP BY family, classifier, metric, a, b, k"""
ORACLE["st_sign_flip"] = f"""
WITH {BLOCKS},
pr AS (SELECT a.family, a.classifier, a.metric, a.condition AS a, b.condition AS b, list(a.value - b.value ORDER BY a.dataset) AS d
  FROM blocks a JOIN blocks b USING (family, classifier, metric, dataset) WHERE a.position < b.position GROUP BY ALL),
e AS (SELECT *, len(d) AS n, list_sum(d) / len(d) AS mean, unnest(range(0, CAST(power(2, len(d)) AS BIGINT))) AS s FROM pr WHERE len(d) >= 3)
SELECT family, classifier, metric, a, b, {r6("mean", "mean")}, n AS n_blocks, count(*) AS sign_patterns,
  {r6("avg(CASE WHEN abs(list_sum(list_transform(d, lambda v, i: CASE WHEN (s >> (i - 1)) & 1 = 1 THEN v ELSE -v END)) / n) >= abs(mean) - 1e-12 THEN 1 ELSE 0 END)", "exact_p_value")}
FROM e GROUP BY family, classifier, metric, a, b, mean, n"""
ORACLE["st_bootstrap_ci"] = f"""
WITH {DELTAS},
g AS (SELECT {PAIR_KEYS}, list(delta ORDER BY dataset) AS d FROM deltas GROUP BY ALL),
r AS (SELECT *, unnest(range(1, 501)) AS r FROM g),
s AS (SELECT *, unnest(range(1, len(d) + 1)) AS s FROM r),
m AS (SELECT {PAIR_KEYS}, r, avg(d[{draw("'0'", "r", "s")} % len(d) + 1]) AS m FROM s GROUP BY {PAIR_KEYS}, r)
SELECT {PAIR_KEYS}, {r6("quantile_cont(m, 0.025)", "bootstrap_low")}, {r6("quantile_cont(m, 0.975)", "bootstrap_high")} FROM m GROUP BY ALL"""

ORACLE["st_comparisons"] = f"""
SELECT e.*, b.* EXCLUDE ({PAIR_KEYS}), w.* EXCLUDE ({PAIR_KEYS}), h.holm_p_value, h.holm_family_size, r.rank_biserial,
  coalesce(c.wilcoxon_calibration, 'not_run_below_three_pairs') AS wilcoxon_calibration,
  coalesce(c.wilcoxon_effective_n, 0) AS wilcoxon_effective_n, c.wilcoxon_min_attainable_p,
  CASE WHEN e.n_pairs = 0 THEN 'not_available' WHEN e.n_pairs < 3 THEN 'descriptive_only_below_minimum_three_blocks'
    ELSE 'paired_dataset_block_percentile_interval' END AS bootstrap_interpretation
FROM ({ORACLE["st_effects"]}) e LEFT JOIN ({ORACLE["st_bootstrap_ci"]}) b USING ({PAIR_KEYS})
LEFT JOIN ({ORACLE["st_wilcoxon"]}) w USING ({PAIR_KEYS}) LEFT JOIN ({ORACLE["st_holm"]}) h USING ({PAIR_KEYS})
LEFT JOIN ({ORACLE["st_rank_biserial"]}) r USING ({PAIR_KEYS}) LEFT JOIN ({ORACLE["st_wilcoxon_calibration"]}) c USING ({PAIR_KEYS})"""


def permutation(ranked: str, stat: str, seed: int) -> str:
    return f"""
perm AS (SELECT r.family, r.classifier, r.metric, r.dataset, x.r, r.rk, row_number() OVER (PARTITION BY r.family, r.classifier, r.metric, r.dataset, x.r
    ORDER BY md5(concat_ws(':', '{seed}', x.r, r.dataset, r.condition))) AS slot
  FROM {ranked} r JOIN {stat} s USING (family, classifier, metric), (SELECT unnest(range(1, 2001)) AS r) x WHERE s.n >= 3 AND s.k >= 3),
psum AS (SELECT family, classifier, metric, r, slot, sum(rk) AS s FROM perm GROUP BY ALL),
pstat AS (SELECT family, classifier, metric, r, sum(s * s) AS sq FROM psum GROUP BY ALL),
hits AS (SELECT family, classifier, metric, max(n) AS n, max(k) AS k, max(stat) AS stat, max(tie_correction) AS tie_correction,
  count(*) AS m, count(*) FILTER ((12 / (n * k * (k + 1)) * p.sq - 3 * n * (k + 1)) / tie_correction >= stat - 1e-12) AS e
  FROM pstat p JOIN {stat} USING (family, classifier, metric) GROUP BY ALL)
SELECT family, classifier, metric, CAST(n AS BIGINT) AS n_blocks, CAST(k AS BIGINT) AS n_conditions, {r6("stat", "stat")},
  {r6("tie_correction", "tie_correction")}, e AS permutation_exceedances, m AS permutation_resamples,
  {r6("(e + 1) / (m + 1)", "permutation_p_value")},
  {r6("sqrt((e + 1) / (m + 1) * (1 - (e + 1) / (m + 1)) / (m + 1))", "permutation_monte_carlo_se")},
  {r6(chi2("stat", "k - 1"), "asymptotic_p_value")} FROM hits"""


ORACLE["st_friedman_permutation"] = f"WITH {BLOCKS}, {permutation('ranked', 'stat', 0)}"
REDUCED = f"""{CELLS},
rc AS (SELECT 'numeric_core_without_adasyn' AS family, classifier, 'macro_f1' AS metric, dataset, condition, macro_f1 AS value,
  count(*) OVER (PARTITION BY classifier, dataset) AS own FROM cells WHERE feature_type = 'numeric'
  AND condition IN ({listed(rules.POSTHOC_CONDITIONS)})),
rb AS (SELECT * FROM rc WHERE own = {len(rules.POSTHOC_CONDITIONS)})"""
ORACLE["st_reduced_omnibus"] = f"""
WITH {REDUCED},
rr AS (SELECT *, rank() OVER (PARTITION BY classifier, dataset ORDER BY value)
  + (count(*) OVER (PARTITION BY classifier, dataset, value) - 1) / 2.0::DOUBLE AS rk,
  count(*) OVER (PARTITION BY classifier, dataset, value) AS tied FROM rb),
rs AS (SELECT family, classifier, metric, condition, sum(rk) AS s, count(*) AS n, sum(tied * tied - 1) AS ties FROM rr GROUP BY ALL),
rf AS (SELECT family, classifier, metric, max(n)::DOUBLE AS n, count(*)::DOUBLE AS k, sum(s * s) AS sq, sum(ties) AS ties FROM rs GROUP BY ALL),
rt AS (SELECT *, 1 - ties / (n * (k * k * k - k)) AS tie_correction,
  (12 / (n * k * (k + 1)) * sq - 3 * n * (k + 1)) / (1 - ties / (n * (k * k * k - k))) AS stat FROM rf),
{permutation("rr", "rt", rules.POSTHOC_SEED)}"""
ORACLE["st_reduced_pairwise"] = f"""
WITH {REDUCED},
deltas AS (SELECT a.family, a.classifier, a.metric, a.dataset, a.condition, a.value - r.value AS delta FROM rb a JOIN rb r
  ON r.classifier = a.classifier AND r.dataset = a.dataset AND r.condition = 'raw' WHERE a.condition <> 'raw'),
{SIGNED[len(DELTAS) + 1:]},
d AS (SELECT {PAIR_KEYS}, count(*) AS n_pairs, avg(delta) AS mean_delta, median(delta) AS median_delta, {WTL} FROM deltas GROUP BY ALL),
t AS (SELECT d.*, wil.n, least(wp, wm) AS w, CASE WHEN wil.n = 0 THEN 1 ELSE p END AS p FROM d JOIN wil USING ({PAIR_KEYS}) LEFT JOIN tail USING ({PAIR_KEYS})),
h AS (SELECT *, count(p) OVER (PARTITION BY classifier) AS m, row_number() OVER (PARTITION BY classifier ORDER BY p) AS r FROM t)
SELECT {PAIR_KEYS}, n_pairs, {r6("mean_delta", "mean_delta")}, {r6("median_delta", "median_delta")}, wins, ties, losses,
  {r6("w", "wilcoxon_statistic")}, {r6("p", "exact_p_value")}, n AS n_nonzero_pairs, CAST(power(2, n) AS BIGINT) AS sign_patterns,
  {r6("CASE WHEN n = 0 THEN 1 ELSE 2 / power(2, n) END", "minimum_attainable_p")},
  {r6("least(1, max((m - r + 1) * p) OVER (PARTITION BY classifier ORDER BY r))", "holm_p_value")}, m AS holm_family_size FROM h"""
CONTRAST_ROWS = ", ".join(
    f"({pos}, '{left}', '{right}', '{classifier}')"
    for pos, (left, right) in enumerate(declared_pairs())
    for classifier in rules.ANALYSIS_CLASSIFIERS
    if classifier == "random_forest" or "balanced_random_forest" not in (left, right)
)
CONTRASTS = f"""{RESULTS},
contrasts(pos, left_condition, right_condition, classifier) AS (VALUES {CONTRAST_ROWS}),
rec AS (SELECT dataset || '-' || seed AS dataset, feature_type, fold, classifier, condition, macro_f1 FROM results),
paired AS (SELECT c.left_condition, c.right_condition, c.classifier, l.dataset, l.feature_type, l.fold, l.macro_f1 AS "left",
  r.macro_f1 AS "right", l.macro_f1 - r.macro_f1 AS delta,
  count(*) OVER (PARTITION BY c.left_condition, c.right_condition, c.classifier, l.dataset) AS n
  FROM contrasts c JOIN rec l ON l.classifier = c.classifier AND l.condition = c.left_condition
  JOIN rec r ON r.classifier = c.classifier AND r.condition = c.right_condition AND r.dataset = l.dataset AND r.fold = l.fold),
cb AS (SELECT * FROM paired WHERE n = 5)"""
CKEYS = "left_condition, right_condition, classifier"
ORACLE["st_contrast_blocks"] = f"""
WITH {CONTRASTS} SELECT {CKEYS}, dataset, feature_type, {FOLD}, {r6('"left"', '"left"')}, {r6('"right"', '"right"')}, {r6("delta", "delta")} FROM cb"""
ORACLE["st_contrast_table"] = f"""
WITH {CONTRASTS}, k AS (SELECT {CKEYS}, count(DISTINCT dataset) AS n FROM cb GROUP BY ALL)
SELECT CAST(pos AS BIGINT) AS pos, {CKEYS}, coalesce(n, 0) AS complete_dataset_blocks,
  CASE WHEN coalesce(n, 0) < 3 THEN 'SKIPPED' ELSE 'VALID' END AS status,
  CASE WHEN coalesce(n, 0) < 3 THEN 'fewer than three complete dataset blocks' END AS reason
FROM contrasts LEFT JOIN k USING ({CKEYS})"""
POSTERIOR = f"""{CONTRASTS},
pd AS (SELECT {CKEYS}, dataset, avg(delta) AS m, var_pop(delta) * 5 AS w FROM cb GROUP BY ALL),
ps AS (SELECT {CKEYS}, count(*) AS n, avg(m) AS centre, var_pop(m) * count(*) AS between_ss, sum(w) AS within_ss FROM pd GROUP BY ALL HAVING count(*) >= 3),
pz AS (SELECT *, sqrt(2.0::DOUBLE / n) AS a, asinh(30.0::DOUBLE / sqrt(2.0::DOUBLE / n)) AS reach,
  ln(greatest(sqrt(between_ss / n), 1e-6)) AS ln_tau, ln(greatest(within_ss / (n * 4), 1e-12)) AS ln_s FROM ps),
pg AS (SELECT pz.*, i, j, reach * (i * (2.0::DOUBLE / 64) - 1) AS t_tau, reach * (j * (2.0::DOUBLE / 32) - 1) AS t_s,
  1.0::DOUBLE / (exp(9.0::DOUBLE - k * (18.0::DOUBLE / 40)) + 1) AS rho
  FROM pz, (SELECT unnest(range(65)) AS i), (SELECT unnest(range(33)) AS j), (SELECT unnest(range(41)) AS k)),
pu AS (SELECT *, exp((ln_tau + a * sinh(t_tau)) * 2) AS tau2, exp(ln_s + a * sinh(t_s)) AS s FROM pg),
pv AS (SELECT *, s / (1 - rho) AS sigma2, tau2 + s / (1 - rho) * (rho * 4 + 1) / 5 AS v FROM pu),
pl AS (SELECT *, centre * 0.25::DOUBLE / (v / n + 0.25::DOUBLE) AS mu1, v / n * 0.25::DOUBLE / (v / n + 0.25::DOUBLE) AS var1, CAST(floor(ln(v) * 50) AS BIGINT) AS i_v,
  -0.5::DOUBLE * (n - 1) * ln(v) - 0.5::DOUBLE * between_ss / v - 0.5::DOUBLE * ln(v / n + 0.25::DOUBLE)
  - 0.5::DOUBLE * centre * centre / (v / n + 0.25::DOUBLE) - 2.0::DOUBLE * n * ln(s) - 0.5::DOUBLE * within_ss / s - tau2 / 0.5::DOUBLE
  - sigma2 / 0.125::DOUBLE + 2 * (ln(rho) + ln(1 - rho)) + 0.5::DOUBLE * (ln(tau2) + ln(sigma2)) + ln(cosh(t_tau)) + ln(cosh(t_s)) AS l FROM pv),
pe AS (SELECT *, exp(l - max(l) OVER (PARTITION BY {CKEYS}, i_v)) AS e FROM pl),
pw AS (SELECT {CKEYS}, n, i_v, max(l) AS top, sum(e) AS e, sum(e * mu1) / sum(e) AS mean,
  sum(e * (var1 + mu1 * mu1)) / sum(e) - (sum(e * mu1) / sum(e)) * (sum(e * mu1) / sum(e)) AS var,
  coalesce(sum(e) FILTER (i IN (0, 64)), 0) AS tau_e, coalesce(sum(e) FILTER (j IN (0, 32)), 0) AS sigma_e FROM pe GROUP BY ALL),
px AS (SELECT *, exp(top - max(top) OVER (PARTITION BY {CKEYS})) AS scale FROM pw),
post AS (SELECT *, e * scale / sum(e * scale) OVER (PARTITION BY {CKEYS}) AS weight, tau_e * scale / sum(e * scale) OVER (PARTITION BY {CKEYS}) AS edge_tau,
  sigma_e * scale / sum(e * scale) OVER (PARTITION BY {CKEYS}) AS edge_sigma FROM px)"""
ORACLE["st_posterior"] = f"""WITH {POSTERIOR} SELECT {CKEYS}, n, i_v, {r6("mean", "mean")}, {r6("var", "var")}, {r6("weight", "weight")},
  {r6("edge_tau", "edge_tau")}, {r6("edge_sigma", "edge_sigma")} FROM post"""


def upper_tail(z: str) -> str:
    """P(standard normal > z) in SQL: a Taylor series about 0 up to 7 deviations."""

    series = f"""list_sum(list_transform(range(120), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - (k + 1) * ln(2)
      - lgamma(k + 1.5) + 0.5::DOUBLE * ln(pi()))))"""
    return f"CASE WHEN {z} > 7 THEN 0 WHEN {z} < -7 THEN 1 ELSE 0.5::DOUBLE - sign({z}) * exp(-0.5::DOUBLE * {z} * {z}) / sqrt(2 * pi()) * {series} END"


ORACLE["st_rope"] = f"""
WITH {POSTERIOR}, z AS (SELECT {CKEYS}, weight, (mean + 0.01::DOUBLE) / sqrt(var) AS z1, (0.01::DOUBLE - mean) / sqrt(var) AS z2 FROM post WHERE weight > 1e-12),
m AS (SELECT {CKEYS}, sum(weight * ({upper_tail("z1")})) AS w, sum(weight * ({upper_tail("z2")})) AS b, sum(weight) AS total FROM z GROUP BY ALL),
q AS (SELECT *, total - w - b AS e FROM m)
SELECT {CKEYS}, {r6("w", "p_practically_worse")}, {r6("e", "p_practically_equivalent")}, {r6("b", "p_practically_better")},
  CASE WHEN w >= e AND w >= b THEN 'practically_worse' WHEN e >= b THEN 'practically_equivalent' ELSE 'practically_better' END AS posterior_category
FROM q"""

# ---- text and provenance -----------------------------------------------------------------------
EMAIL, REVISION, LOCAL = (p.replace("'", "''") for p in (rules.EMAIL, rules.REVISION, rules.LOCAL_PATH))
ORACLE["txt_identity_scan"] = f"""
SELECT doc_id, 'email' AS kind FROM documents WHERE regexp_matches(text, '{EMAIL}')
UNION ALL SELECT doc_id, 'local_path' FROM documents WHERE regexp_matches(text, '{LOCAL}')
UNION ALL SELECT doc_id, 'revision' FROM documents WHERE regexp_matches(text, '{REVISION}')
UNION ALL SELECT doc_id, 'term:license' FROM documents WHERE contains(lower(text), 'license')
UNION ALL SELECT doc_id, 'term:Copyright' FROM documents WHERE contains(lower(text), 'copyright')"""
ORACLE["txt_redact"] = f"""
SELECT doc_id, len(regexp_extract_all(text, '{LOCAL}')) AS local_paths, len(regexp_extract_all(text, '{REVISION}')) AS revisions,
  len(regexp_extract_all(text, '{EMAIL}')) AS emails,
  md5(regexp_replace(regexp_replace(regexp_replace(text, '{LOCAL}', '<local-path>', 'g'), '{REVISION}', '<revision>', 'g'),
    '{EMAIL}', '<email>', 'g')) AS text_md5 FROM documents"""
ORACLE["txt_json_redact"] = """
SELECT conv_id, turn, '{"git_head":null,"inner":{"source_commit":null,"size":' || length(text) || '}}' AS body FROM conversations"""
ORACLE["txt_hash_rebind"] = """
WITH m AS (SELECT url, min(CASE WHEN length(html) % 2 = 0 THEN sha256(html) END) AS h FROM pages GROUP BY 1)
SELECT page_id, p.url AS path, coalesce(m.h, sha256(p.url)) AS sha256 FROM pages p LEFT JOIN m ON m.url = p.url"""
ORACLE["prov_set_digest"] = """
SELECT count(*) AS paths, sha256(string_agg(p, chr(0) ORDER BY p)) AS digest
FROM (SELECT DISTINCT concat_ws('/', source, lang) AS p FROM documents)"""
ORACLE["prov_member_digest"] = """
WITH m AS (SELECT url || '#' || page_id AS name, html, length(html) AS n FROM pages)
SELECT name, CASE WHEN n % 5 = 0 THEN 'present but not listed' ELSE 'digest mismatch' END AS problem FROM m
WHERE n % 5 = 0 OR (n % 2 = 1 AND sha256(html) <> sha256(upper(html)))"""
ORACLE["prov_path_rules"] = r"""
WITH p AS (SELECT regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages),
u AS (SELECT path, CASE WHEN path = '' THEN 'empty' WHEN contains(path, '\') THEN 'backslash' WHEN starts_with(path, '/') THEN 'absolute'
  WHEN regexp_matches(path, '^[A-Za-z]:') THEN 'drive'
  WHEN list_has_any(string_split(path, '/'), ['', '.', '..']) THEN 'empty or dot segment' END AS problem FROM p)
SELECT path, problem FROM u WHERE problem IS NOT NULL
UNION ALL SELECT path, 'duplicate or case collision' FROM (SELECT path, count(*) OVER (PARTITION BY lower(path)) AS n FROM p) WHERE n > 1"""
ORACLE["prov_generated_paths"] = f"""
WITH p AS (SELECT doc_id, [{listed((*rules.GENERATED_PREFIXES, "src/"))}][length(text) % 6 + 1] || source
  || CASE WHEN lang = 'en' THEN '.gitkeep' ELSE '.csv' END AS path FROM documents)
SELECT doc_id, path FROM p WHERE list_bool_or([{", ".join(f"starts_with(path, '{g}')" for g in rules.GENERATED_PREFIXES)}])
AND NOT ends_with(path, '.gitkeep') AND path NOT IN ({listed(rules.TRACKED_PROVENANCE)})"""
ORACLE["tune_select"] = f"""
WITH {RECORDS}, s AS (SELECT dataset, seed, fold, classifier, list_position([{listed(rules.CONDITIONS)}], condition) AS trial,
  CASE WHEN status = 'VALID' THEN round(macro_f1, 9) END AS score FROM records),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, seed, fold, classifier ORDER BY score DESC NULLS LAST, trial) AS r FROM s)
SELECT dataset, CAST(seed AS BIGINT) AS seed, CAST(fold AS BIGINT) AS fold, classifier, CAST(trial AS BIGINT) AS trial, {r6("score", "score")}
FROM r WHERE r = 1 AND score IS NOT NULL"""

# ---- sources, sinks and operators that other queries use only in part ----------------------------
ORACLE["src_dataset"] = f"SELECT o_orderkey, o_custkey, o_orderstatus, {r6('o_totalprice', 'o_totalprice')}, o_orderdate, o_orderpriority FROM orders"
ORACLE["src_overrides"] = """
SELECT p_partkey AS dataset_id, unnest([p_brand, p_type]) AS "column" FROM part WHERE p_partkey % 3 <> 0"""
ORACLE["src_manifest"] = """
SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n, max(c_name) AS last FROM customer GROUP BY 1"""
ORACLE["snk_table"] = """
SELECT o_orderkey, '[' || o_custkey || ',' || o_orderkey || ']' AS pair FROM orders"""
ORACLE["snk_partitioned"] = """
SELECT c_custkey, CAST(c_nationkey + CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 100 ELSE 0 END AS BIGINT) AS v,
  c_mktsegment AS dataset FROM customer"""
ORACLE["snk_union"] = f"""
WITH {RECORDS} SELECT dataset, classifier, condition, CAST(seed AS BIGINT) AS seed, CAST(fold AS BIGINT) AS fold,
  CASE WHEN status = 'VALID' THEN 'results' ELSE 'failures' END AS source, CASE WHEN status = 'FAILED' THEN error END AS error
FROM records"""
ORACLE["aud_normalise"] = f"""
SELECT c_custkey, c_name AS text, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS bool,
  CASE WHEN c_custkey % 2 = 0 THEN sha256(c_name) END AS hash,
  {r6("CASE WHEN c_custkey % 3 = 2 THEN c_custkey END", "number")},
  CASE WHEN c_custkey % 2 = 0 THEN '2021-03-0' || (c_custkey % 9 + 1) || ' 00:00:00' END AS timestamp,
  'a/b/' || lower(c_name) AS path FROM customer"""
ORACLE["aud_verify_files"] = """
WITH m AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 <> 0 THEN length(s_name) END AS size,
    CASE WHEN s_suppkey % 5 <> 0 THEN sha256(s_name) END AS h,
    CASE WHEN s_suppkey % 3 <> 0 THEN length(s_name) + s_suppkey % 2 END AS found,
    CASE WHEN s_suppkey % 3 <> 0 THEN sha256(CASE WHEN s_suppkey % 4 = 0 THEN lower(s_name) ELSE s_name END) END AS now
  FROM supplier)
SELECT k AS dataset_id, 'invalid SHA-256' AS problem FROM m WHERE h IS NULL
UNION ALL SELECT k, 'invalid byte size' FROM m WHERE size IS NULL
UNION ALL SELECT k, 'file is missing' FROM m WHERE found IS NULL
UNION ALL SELECT k, 'byte size does not match' FROM m WHERE found <> size
UNION ALL SELECT k, 'SHA-256 does not match' FROM m WHERE now <> h"""
ORACLE["aud_applicability_type"] = """
SELECT p_partkey AS dataset_id, 'applicability feature type does not match feature_type' AS problem FROM part
WHERE p_partkey % 4 = 3 OR p_partkey % 4 <> p_size % 3"""
ORACLE["prep_drop_unlabelled"] = """
SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'P'"""
ORACLE["met_argmax"] = f"""
WITH {PREDICTIONS} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS BIGINT) AS yhat FROM predictions"""
ORACLE["acc_table_digest"] = """
WITH h AS (SELECT sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name
    || '","c_nationkey":' || c_nationkey || '}') AS h FROM customer),
s AS (SELECT count(*) AS n, """ + ", ".join(
    f"sum(CAST(CAST('0x' || substr(h, {at}, 13) AS BIGINT) AS HUGEINT)) AS s{at}" for at in (1, 14, 27, 40)
) + """ FROM h)
SELECT n AS rows, sha256(concat_ws(':', n, s1, s14, s27, s40)) AS digest FROM s"""
ORACLE["acc_manifest_frozen"] = """
WITH a AS (SELECT min(o_orderkey) AS f, max(o_orderkey) AS l, count(*) AS n FROM orders),
b AS (SELECT min(l_orderkey) AS f, max(l_orderkey) AS l, count(*) AS n FROM lineitem)
SELECT 'first' AS field FROM a, b WHERE a.f IS DISTINCT FROM b.f
UNION ALL SELECT 'last' FROM a, b WHERE a.l IS DISTINCT FROM b.l
UNION ALL SELECT 'n' FROM a, b WHERE a.n IS DISTINCT FROM b.n"""
ORACLE["grid_resume"] = f"""
WITH {RECORDS} SELECT dataset, classifier, condition, CAST(seed AS BIGINT) AS seed, CAST(fold AS BIGINT) AS fold FROM records
WHERE dataset IN (SELECT dataset FROM records WHERE status <> 'VALID' AND condition = 'raw')"""
ORACLE["fn_avg_rank"] = f"""
WITH v AS (SELECT c_custkey, c_nationkey, floor(c_acctbal / 1000) AS v FROM customer)
SELECT a.c_custkey, {r6("count(*) FILTER (WHERE b.v > a.v) + (count(*) FILTER (WHERE b.v = a.v) + 1) / 2", "place")}
FROM v a JOIN v b USING (c_nationkey) GROUP BY a.c_custkey"""
ORACLE["fn_hash_uniform"] = f"""
SELECT o_orderkey, {r6(draw("'7'", "'draw'", "o_orderkey") + " / 4294967296", "u")} FROM orders"""
ORACLE["fn_signed_rank_null"] = f"""
WITH n AS (SELECT DISTINCT s_suppkey % 8 + 1 AS n FROM supplier),
m AS (SELECT n, unnest(range(1 << n)) AS m FROM n),
w AS (SELECT n, list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN (m >> (i - 1)) & 1 = 1 THEN i ELSE 0 END)) AS w FROM m),
c AS (SELECT n, w, count(*) AS c FROM w GROUP BY 1, 2)
SELECT s_suppkey, CAST(w AS BIGINT) AS w, {r6("c", "patterns")} FROM supplier JOIN c ON c.n = s_suppkey % 8 + 1"""


def simpson(of: str, upto: str) -> str:
    """Integral from 0 to ``upto``: the tails are checked by quadrature, not by the series that Spark sums."""

    weight = "CASE WHEN i = 0 OR i = 800 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    at = f"(i * ({upto}) / 800)"
    return f"({upto}) / 2400 * list_sum(list_transform(range(801), lambda i: {weight} * {of.format(u=at)}))"


# With t = u * u the density has no pole at 0.
ORACLE["fn_chi2_sf"] = f"""
WITH r AS (SELECT s_suppkey, s_suppkey % 57 / 2 AS x, s_suppkey % 9 + 1 AS k FROM supplier)
SELECT s_suppkey, {r6("1 - " + simpson("pow({u}, k - 1) * exp(-{u} * {u} / 2)", "sqrt(x)") + " / (pow(2, k / 2 - 1) * gamma(k / 2))", "p")} FROM r"""
ORACLE["fn_norm_cdf"] = f"""
WITH r AS (SELECT s_suppkey, (s_suppkey % 81 - 40) / 8 AS z FROM supplier)
SELECT s_suppkey, {r6("0.5 + " + simpson("exp(-{u} * {u} / 2)", "z") + " / sqrt(2 * pi())", "p")} FROM r"""
