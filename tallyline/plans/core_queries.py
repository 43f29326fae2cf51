"""Queries of the matching engine over the whole test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.functions import extraction as X
from tallyline.functions import normalize as N
from tallyline.functions import similarity as S
from tallyline.operators import evaluation as E
from tallyline.operators import jobs as J
from tallyline.operators import matching as M
from tallyline.operators import review as R
from tallyline.operators import tuning as L
from tallyline.plans import sql_parts as Q
from tallyline.plans.catalog import query
from tallyline.sources.tables import table

CURVE = tuple(i / 100 for i in range(50, 101))


@query("normalize_invoice_no", f"SELECT id, {Q.invoice_no('invoice_no')} AS canonical FROM invoices")
def normalize_invoice_no(spark, d):
    return table(spark, d, "invoices").select("id", N.invoice_no_canonical(F.col("invoice_no")).alias("canonical"))


@query("normalize_vendor", f"SELECT id, vendor, {Q.key('vendor')} AS vendor_key FROM (SELECT id, {Q.vendor('vendor_name')} AS vendor FROM invoices) z")
def normalize_vendor(spark, d):
    v = table(spark, d, "invoices").select("id", N.vendor_canonical(F.col("vendor_name")).alias("vendor"))
    return v.withColumn("vendor_key", N.vendor_key(F.col("vendor")))


@query("normalize_tax_id_period", f"SELECT id, {Q.tax_id('tax_id')} AS tax_id, coalesce(strftime(invoice_date, '%Y-%m'), '') AS period FROM invoices")
def normalize_tax_id_period(spark, d):
    return table(spark, d, "invoices").select("id", N.tax_id_canonical(F.col("tax_id")).alias("tax_id"), N.billing_period(F.col("invoice_date")).alias("period"))


@query(
    "clamped_dates",
    """SELECT id, make_date(year(invoice_date), month(invoice_date), least(31, day(last_day(invoice_date)))) AS late,
       make_date(year(invoice_date), month(invoice_date), 1) AS early FROM invoices""",
)
def clamped_dates(spark, d):
    y, m = F.year("invoice_date"), F.month("invoice_date")
    return table(spark, d, "invoices").select("id", N.clamped_date(y, m, F.lit(31)).alias("late"), N.clamped_date(y, m, F.lit(-3)).alias("early"))


@query("parse_amounts", f"SELECT id, written, {Q.amount('written')} AS amount FROM (SELECT id, regexp_extract(raw_text, '(?im)^\\s*(?:amount(?:\\s*due)?|total)\\s*:\\s*(.+?)\\s*$', 1) AS written FROM invoices) w")
def parse_amounts(spark, d):
    """Amounts as they stand in the raw texts; '' for a text without one, null for a null text."""
    raw = F.regexp_extract("raw_text", r"(?im)^\s*(?:amount(?:\s*due)?|total)\s*:\s*(.+?)\s*$", 1)
    return table(spark, d, "invoices").select("id", raw.alias("written"), N.amount_parsed(raw).alias("amount"))


@query("extract_fields")
def extract_fields(spark, d):
    return X.extracted(table(spark, d, "invoices", "id", "raw_text"), "raw_text").select("id", "fields.*", "missing", "confidence")


@query("blocking_keys", f"""SELECT * FROM (SELECT 'vn|' || vendor_key || '|' || invoice_no AS key, id FROM {Q.normalized()} n WHERE vendor_key <> '' AND invoice_no <> ''
       UNION ALL SELECT 'amt|' || amount, id FROM {Q.normalized()} n) k""")
def blocking_keys(spark, d):
    return M.blocking_keys(M.normalized(table(spark, d, "invoices"))).select("key", "id")


_CANDIDATES = f"WITH {Q.CANDIDATES}"


@query("candidate_pairs", f"{_CANDIDATES} SELECT * FROM pairs")
def candidate_pairs(spark, d):
    return M.candidate_pairs(M.normalized(table(spark, d, "invoices")))


@query("blocking_stats", f"""{_CANDIDATES}, sizes AS (SELECT key, count(*) AS c FROM keys GROUP BY key),
       s AS (SELECT (SELECT count(*) FROM n) AS n_invoices, (SELECT count(*) FROM sizes) AS n_blocks, (SELECT count(*) FROM sizes WHERE c > 1000) AS n_skipped_blocks, (SELECT count(*) FROM pairs) AS n_candidates)
       SELECT *, n_invoices * (n_invoices - 1) // 2 AS naive_candidates, round(1.0::DOUBLE - n_candidates::DOUBLE / (n_invoices * (n_invoices - 1) // 2), 6) AS reduction FROM s""")
def blocking_stats(spark, d):
    return M.blocking_stats(M.normalized(table(spark, d, "invoices")))


@query("similarity_invoice_no", f"""WITH n AS MATERIALIZED (SELECT id, invoice_no FROM {Q.normalized()} x)
       SELECT DISTINCT p.id_a, p.id_b, round(CASE WHEN a.invoice_no = '' OR b.invoice_no = '' THEN 0.0 WHEN a.invoice_no = b.invoice_no THEN 1.0
       ELSE 0.7 * jaro_winkler_similarity(a.invoice_no, b.invoice_no) END::DOUBLE, 6) AS similarity
       FROM invoice_pairs p JOIN n a ON a.id = p.id_a JOIN n b ON b.id = p.id_b""")
def similarity_invoice_no(spark, d):
    rows = M.normalized(table(spark, d, "invoices"))
    scored = M.scored(rows, table(spark, d, "invoice_pairs").select("id_a", "id_b").distinct())
    return scored.select("id_a", "id_b", F.round("breakdown.invoice_no", 6).alias("similarity"))


@query("similarity_amount_date", """SELECT DISTINCT p.id_a, p.id_b, round(CASE WHEN a.amount IS NULL OR b.amount IS NULL THEN 0.0 WHEN a.amount = b.amount THEN 1.0
       ELSE greatest(0.0, 1.0 - (greatest(abs(a.amount), abs(b.amount)) - least(abs(a.amount), abs(b.amount)))::DOUBLE / greatest(abs(a.amount), abs(b.amount))) END::DOUBLE, 9) AS amount,
       round(coalesce(greatest(0.0, 1.0 - abs(date_diff('day', a.invoice_date, b.invoice_date))::DOUBLE / 45.0), 0.0)::DOUBLE, 9) AS date,
       CASE WHEN strftime(a.invoice_date, '%Y-%m') = strftime(b.invoice_date, '%Y-%m') THEN 1.0 ELSE 0.0 END::DOUBLE AS billing_period_match
       FROM invoice_pairs p JOIN invoices a ON a.id = p.id_a JOIN invoices b ON b.id = p.id_b""")
def similarity_amount_date(spark, d):
    inv = table(spark, d, "invoices", "id", "amount", "invoice_date")
    a, b = inv.select(*(F.col(c).alias(f"{c}_a") for c in inv.columns)), inv.select(*(F.col(c).alias(f"{c}_b") for c in inv.columns))
    both = table(spark, d, "invoice_pairs").select("id_a", "id_b").distinct().join(a, "id_a").join(b, "id_b")
    period = S.period_match(N.billing_period(F.col("invoice_date_a")), N.billing_period(F.col("invoice_date_b")))
    return both.select(
        "id_a", "id_b", F.round(S.amount_similarity(F.col("amount_a"), F.col("amount_b")), 9).alias("amount"),
        F.round(S.date_similarity(F.col("invoice_date_a"), F.col("invoice_date_b")), 9).alias("date"), period.alias("billing_period_match"),
    )


@query("similarity_vendor", f"""WITH n AS MATERIALIZED (SELECT id, vendor FROM {Q.normalized()} x), p AS MATERIALIZED (SELECT DISTINCT p.id_a, p.id_b, a.vendor AS x, b.vendor AS y
       FROM invoice_pairs p JOIN n a ON a.id = p.id_a JOIN n b ON b.id = p.id_b), {Q.vendor_similarities('p')}
       SELECT id_a, id_b, round(CASE WHEN p.x = '' OR p.y = '' THEN 0.0 WHEN p.x = p.y THEN 1.0 ELSE similarity END::DOUBLE, 6) AS similarity
       FROM p LEFT JOIN sims s ON s.x = least(p.x, p.y) AND s.y = greatest(p.x, p.y)""")
def similarity_vendor(spark, d):
    scored = M.scored(M.normalized(table(spark, d, "invoices")), table(spark, d, "invoice_pairs").select("id_a", "id_b").distinct())
    return scored.select("id_a", "id_b", F.round("breakdown.vendor", 6).alias("similarity"))


@query("detect_pairs", f"""WITH {Q.SCORED} SELECT id_a, id_b, score, label, round(s_no, 9) AS s_invoice_no, round(s_vendor, 9) AS s_vendor, round(s_amount, 9) AS s_amount, round(s_date, 9) AS s_date,
       period_match AS billing_period_match, tax AS tax_id, CASE WHEN again THEN 'reinvoice_pattern' END AS rule FROM labelled""")
def detect_pairs(spark, d):
    """The flagship: every candidate pair of all invoices with score, label and what they are made of."""
    b = {f"s_{c}": F.round(f"breakdown.{c}", 9) for c in ("invoice_no", "vendor", "amount", "date")}
    found = M.detect(table(spark, d, "invoices")).pairs
    return found.select("id_a", "id_b", "score", "label", *(c.alias(n) for n, c in b.items()), "breakdown.billing_period_match", "breakdown.tax_id", "breakdown.rule")


@query("detect_stats", f"""WITH {Q.SCORED}, sizes AS (SELECT key, count(*) AS c FROM keys GROUP BY key),
       s AS (SELECT (SELECT count(*) FROM n) AS n_invoices, (SELECT count(*) FROM sizes) AS n_blocks, (SELECT count(*) FROM sizes WHERE c > 1000) AS n_skipped_blocks, count(*) AS n_candidates, count(*) AS scored_pairs,
         count(*) FILTER (label = 'flag') AS flagged, count(*) FILTER (label = 'review') AS review FROM labelled)
       SELECT *, n_invoices * (n_invoices - 1) // 2 AS naive_candidates, round(1.0::DOUBLE - n_candidates::DOUBLE / (n_invoices * (n_invoices - 1) // 2), 6) AS reduction FROM s""")
def detect_stats(spark, d):
    return M.detect(table(spark, d, "invoices")).stats


@query("detect_evaluated", f"""WITH {Q.KNOWN}, {Q.SCORED}, s AS (SELECT least(id_a, id_b) AS key_a, greatest(id_a, id_b) AS key_b, score FROM labelled),
       j AS (SELECT variant, coalesce(score, 0.0) AS s FROM known k FULL OUTER JOIN s ON k.key_a = s.key_a AND k.key_b = s.key_b),
       c AS (SELECT count(*) FILTER (variant IS NOT NULL AND s >= 0.9) AS tp, count(*) FILTER (variant IS NOT NULL) AS gt_pairs, count(*) FILTER (s >= 0.9) AS flagged_pairs,
       count(*) FILTER (s >= 0.7 AND s < 0.9) AS review_pairs, count(*) FILTER (s >= 0.7 AND s < 0.9 AND variant IS NOT NULL) AS gt_in_review FROM j), m AS (SELECT *, {Q.MEASURES} FROM c)
       SELECT 0.9::DOUBLE AS threshold, tp, flagged_pairs - tp AS fp, gt_pairs - tp AS fn, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
       gt_pairs, flagged_pairs, review_pairs, gt_in_review FROM m""")
def detect_evaluated(spark, d):
    inv = table(spark, d, "invoices")
    return E.evaluate(inv, M.detect(inv).pairs)


@query("known_pairs", f"WITH {Q.KNOWN} SELECT * FROM known")
def known_pairs(spark, d):
    return E.known_pairs(table(spark, d, "invoices"))


@query("evaluate", f"""WITH {Q.JUDGED}, c AS (SELECT count(*) FILTER (variant IS NOT NULL AND s >= 0.9) AS tp, count(*) FILTER (variant IS NOT NULL) AS gt_pairs, count(*) FILTER (s >= 0.9) AS flagged_pairs,
       count(*) FILTER (s >= 0.7 AND s < 0.9) AS review_pairs, count(*) FILTER (s >= 0.7 AND s < 0.9 AND variant IS NOT NULL) AS gt_in_review FROM judged), m AS (SELECT *, {Q.MEASURES} FROM c)
       SELECT 0.9::DOUBLE AS threshold, tp, flagged_pairs - tp AS fp, gt_pairs - tp AS fn, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
       gt_pairs, flagged_pairs, review_pairs, gt_in_review FROM m""")
def evaluate(spark, d):
    return E.evaluate(table(spark, d, "invoices"), table(spark, d, "invoice_pairs"))


@query("recall_by_variant", f"WITH {Q.JUDGED} SELECT variant, count(*) AS total, count(*) FILTER (s >= 0.9) AS found, count(*) FILTER (s >= 0.9) / count(*) AS recall FROM judged WHERE variant IS NOT NULL GROUP BY variant")
def recall_by_variant(spark, d):
    return E.recall_by_variant(table(spark, d, "invoices"), table(spark, d, "invoice_pairs"))


@query("threshold_sweep", f"""WITH {Q.JUDGED}, t(threshold) AS (SELECT unnest([0.80, 0.85, 0.88, 0.90, 0.92, 0.95]::DOUBLE[])), c AS (SELECT threshold, count(*) FILTER (variant IS NOT NULL AND s >= threshold) AS tp,
       count(*) FILTER (variant IS NOT NULL) AS gt_pairs, count(*) FILTER (s >= threshold) AS flagged_pairs FROM judged, t GROUP BY threshold), m AS (SELECT *, {Q.MEASURES} FROM c)
       SELECT threshold, round(precision, 4) AS precision, round(recall, 4) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 4) AS f1,
       flagged_pairs - tp AS fp, flagged_pairs AS flagged FROM m""")
def threshold_sweep(spark, d):
    return E.sweep(table(spark, d, "invoices"), table(spark, d, "invoice_pairs"))


def _distribution(spark, d):
    return E.distribution(table(spark, d, "invoices"), table(spark, d, "invoice_pairs"), R.latest_decisions(table(spark, d, "review_decisions")))


@query("pair_distribution", f"WITH {Q.DISTRIBUTION} SELECT * FROM dist")
def pair_distribution(spark, d):
    return _distribution(spark, d)


_COUNTS = """count(*) FILTER (score >= threshold) AS flagged, coalesce(sum(value) FILTER (score >= threshold), 0)::BIGINT AS value_at_risk,
       count(*) FILTER (score >= threshold AND decision <> '') AS decided, count(*) FILTER (score >= threshold AND decision = 'duplicate') AS decided_duplicate"""


@query("threshold_metrics", f"""WITH {Q.DISTRIBUTION}, c AS (SELECT 0.9::DOUBLE AS threshold, {_COUNTS} FROM (SELECT *, 0.9 AS threshold FROM dist) z)
       SELECT *, CASE WHEN decided > 0 THEN round(decided_duplicate / decided, 4) END AS estimated_precision FROM c""")
def threshold_metrics(spark, d):
    return E.threshold_metrics(_distribution(spark, d), 0.90)


@query("threshold_curve", f"""WITH {Q.DISTRIBUTION}, t(threshold) AS (SELECT i / 100.0::DOUBLE FROM range(50, 101) r(i)), c AS (SELECT threshold, {_COUNTS} FROM dist, t GROUP BY threshold)
       SELECT *, CASE WHEN decided > 0 THEN round(decided_duplicate / decided, 4) END AS estimated_precision FROM c""")
def threshold_curve(spark, d):
    return E.curve(_distribution(spark, d), CURVE)


@query("score_histogram", f"""WITH {Q.DISTRIBUTION} SELECT least(19, greatest(0, floor(score * 20)))::INT AS bin, count(*) FILTER (gt) AS known, count(*) FILTER (NOT gt) AS other FROM dist WHERE score IS NOT NULL GROUP BY 1""")
def score_histogram(spark, d):
    return E.histogram(_distribution(spark, d).where("score is not null"))


@query("rule_fires", f"""WITH {Q.KNOWN} SELECT coalesce(strftime(a.invoice_date, '%Y-%m') = strftime(b.invoice_date, '%Y-%m'), false) AS same_period, k.key_a IS NOT NULL AS known, count(*) AS pairs
       FROM invoice_pairs p JOIN invoices a ON a.id = p.id_a JOIN invoices b ON b.id = p.id_b LEFT JOIN known k ON k.key_a = least(p.id_a, p.id_b) AND k.key_b = greatest(p.id_a, p.id_b)
       WHERE p.breakdown.rule = 'reinvoice_pattern' GROUP BY 1, 2""")
def rule_fires(spark, d):
    return E.rule_fires(table(spark, d, "invoices"), table(spark, d, "invoice_pairs"))


@query("variant_counts", "SELECT variant, count(*) AS n FROM invoices WHERE duplicate_of <> '' GROUP BY variant")
def variant_counts(spark, d):
    return table(spark, d, "invoices").where("duplicate_of <> ''").groupBy("variant").agg(F.count(F.lit(1)).alias("n"))


@query("invoice_count", "SELECT count(*) AS n, nullif(count(*) FILTER (duplicate_of <> ''), 0) AS known FROM invoices")
def invoice_count(spark, d):
    n = table(spark, d, "invoices").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("duplicate_of") != "").alias("k"))
    return n.select("n", F.nullif("k", F.lit(0)).alias("known"))


@query("pairs_by_label", f"SELECT {Q.TIDY.format('label')} AS label, count(*) AS n FROM invoice_pairs GROUP BY 1")
def pairs_by_label(spark, d):
    return R.counts_by(table(spark, d, "invoice_pairs"), "label")


@query("decisions_by_verdict", f"SELECT {Q.TIDY.format('decision')} AS decision, count(*) AS n FROM review_decisions GROUP BY 1")
def decisions_by_verdict(spark, d):
    return R.counts_by(table(spark, d, "review_decisions"), "decision")


@query("latest_decisions", f"WITH {Q.DECIDED} SELECT * FROM decided")
def latest_decisions(spark, d):
    return R.latest_decisions(table(spark, d, "review_decisions"))


@query("review_queue_undecided", f"""WITH {Q.DECIDED} SELECT p.id_a, p.id_b, p.score, {Q.TIDY.format('p.label')} AS label, a.vendor_name AS vendor_a, b.vendor_name AS vendor_b, a.amount AS amount_a, b.amount AS amount_b
       FROM invoice_pairs p JOIN invoices a ON a.id = p.id_a JOIN invoices b ON b.id = p.id_b LEFT JOIN decided d ON d.key_a = least(p.id_a, p.id_b) AND d.key_b = greatest(p.id_a, p.id_b)
       WHERE {Q.TIDY.format('p.label')} = 'review' AND d.key_a IS NULL""")
def review_queue_undecided(spark, d):
    q = R.review_queue(table(spark, d, "invoice_pairs"), table(spark, d, "invoices"), R.latest_decisions(table(spark, d, "review_decisions")), "review", undecided=True)
    return q.select("id_a", "id_b", "score", "label", *(F.col(f"{x}.{c}").alias(f"{n}_{x}") for c, n in (("vendor_name", "vendor"), ("amount", "amount")) for x in "ab"))


@query("pair_field_differences", """SELECT p.id_a, p.id_b, regexp_replace(lower(coalesce(a.vendor_name, '')), '[^a-z0-9]+', '', 'g') <> regexp_replace(lower(coalesce(b.vendor_name, '')), '[^a-z0-9]+', '', 'g') AS vendor_differs,
       regexp_replace(lower(coalesce(a.invoice_no, '')), '[^a-z0-9]+', '', 'g') <> regexp_replace(lower(coalesce(b.invoice_no, '')), '[^a-z0-9]+', '', 'g') AS number_differs,
       a.amount IS DISTINCT FROM b.amount AS amount_differs, a.invoice_date IS DISTINCT FROM b.invoice_date AS date_differs, a.tax_id IS DISTINCT FROM b.tax_id AS tax_id_differs
       FROM invoice_pairs p JOIN invoices a ON a.id = p.id_a JOIN invoices b ON b.id = p.id_b""")
def pair_field_differences(spark, d):
    none = spark.createDataFrame([], "key_a string, key_b string, decision string, reviewer string, decided_at timestamp")
    q = R.review_queue(table(spark, d, "invoice_pairs"), table(spark, d, "invoices"), none)
    loose = {c: N.loose_text(F.col(f"a.{c}")) != N.loose_text(F.col(f"b.{c}")) for c in ("vendor_name", "invoice_no")}
    return q.select(
        "id_a", "id_b", loose["vendor_name"].alias("vendor_differs"), loose["invoice_no"].alias("number_differs"),
        (~F.col("a.amount").eqNullSafe(F.col("b.amount"))).alias("amount_differs"), (~F.col("a.invoice_date").eqNullSafe(F.col("b.invoice_date"))).alias("date_differs"),
        (~F.col("a.tax_id").eqNullSafe(F.col("b.tax_id"))).alias("tax_id_differs"),
    )


@query("pairs_page", """SELECT id_a, id_b, score FROM invoice_pairs ORDER BY score DESC NULLS LAST, id_a, id_b, created_at LIMIT 100 OFFSET 100""")
def pairs_page(spark, d):
    return R.page(table(spark, d, "invoice_pairs"), [F.desc_nulls_last("score"), "id_a", "id_b", "created_at"], 100, 100).select("id_a", "id_b", "score")


_PAGE = ("id", "source_type", "source_name", "extraction_method", "extraction_confidence", "vendor_name", "invoice_no", "amount", "currency", "invoice_date", "tax_id", "created_at", "duplicate_of", "variant")


@query("invoices_page", f"""SELECT {', '.join(c for c in _PAGE if c != 'extraction_confidence')}, CASE WHEN NOT isnan(extraction_confidence) THEN extraction_confidence END AS extraction_confidence
       FROM invoices ORDER BY created_at NULLS FIRST, id LIMIT 100 OFFSET 200""")
def invoices_page(spark, d):
    c = F.col("extraction_confidence")
    return R.page(table(spark, d, "invoices"), ["created_at", "id"], 100, 200).select(*_PAGE).withColumn("extraction_confidence", F.when(~F.isnan(c), c))


@query("invoice_lookup", "SELECT id, vendor_name, invoice_no, amount FROM invoices WHERE id = 'iv00-000041'")
def invoice_lookup(spark, d):
    return R.lookup(table(spark, d, "invoices"), "id", "iv00-000041").select("id", "vendor_name", "invoice_no", "amount")


_JOBS = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY finished_at DESC NULLS LAST, started_at DESC NULLS LAST, created_at DESC NULLS LAST,
       coalesce(list_position(['pending', 'running', 'done', 'failed'], lower(trim(status))), 0) DESC, coalesce(error_text, '') DESC) AS rn FROM jobs WHERE id IS NOT NULL) q WHERE rn = 1)"""


@query("job_states", f"WITH {_JOBS} SELECT job_type, lower(trim(status)) AS status, count(*) AS n FROM cur GROUP BY 1, 2")
def job_states(spark, d):
    return J.states(table(spark, d, "jobs"))


@query("jobs_waiting", f"WITH {_JOBS} SELECT id, job_type, created_at FROM cur WHERE lower(trim(status)) = 'pending' ORDER BY created_at NULLS FIRST, id LIMIT 10")
def jobs_waiting(spark, d):
    return J.waiting(table(spark, d, "jobs"), 10)


@query("jobs_failed", f"WITH {_JOBS} SELECT id, job_type, coalesce(error_text, '') AS error, finished_at FROM cur WHERE lower(trim(status)) = 'failed'")
def jobs_failed(spark, d):
    return J.failed(table(spark, d, "jobs"))


@query("job_payloads", f"""WITH {_JOBS}, p AS (SELECT id, CASE WHEN json_valid(payload) THEN payload END AS payload FROM cur)
       SELECT id, json_extract_string(payload, '$.file') AS file, CAST(json_extract_string(payload, '$.bytes') AS BIGINT) AS bytes, payload IS NOT NULL AS readable FROM p""")
def job_payloads(spark, d):
    return J.payloads(table(spark, d, "jobs"))


@query("job_lookup", f"WITH {_JOBS} SELECT id, job_type, status FROM cur WHERE id = 'jb00-000007'")
def job_lookup(spark, d):
    return R.lookup(J.current_jobs(table(spark, d, "jobs")), "id", "jb00-000007").select("id", "job_type", "status")


@query("score_contributions", """SELECT id_a, id_b, field, similarity, weight, round(similarity * weight, 9) AS contribution, CASE WHEN similarity >= 0.99 THEN 'high' WHEN similarity >= 0.85 THEN 'middle' ELSE 'low' END AS band FROM (
       SELECT id_a, id_b, f.field, coalesce(f.s, 0.0)::DOUBLE AS similarity, f.w AS weight FROM (SELECT id_a, id_b, unnest([{'field': 'invoice_no', 's': breakdown.invoice_no, 'w': 0.35::DOUBLE}, {'field': 'vendor', 's': breakdown.vendor, 'w': 0.25::DOUBLE},
       {'field': 'amount', 's': breakdown.amount, 'w': 0.30::DOUBLE}, {'field': 'date', 's': breakdown.date, 'w': 0.10::DOUBLE}]) AS f FROM invoice_pairs) u) v""")
def score_contributions(spark, d):
    return R.contributions(table(spark, d, "invoice_pairs"))


@query("simulated_decisions", f"""WITH {Q.KNOWN}, s AS (SELECT DISTINCT least(id_a, id_b) AS id_a, greatest(id_a, id_b) AS id_b FROM invoice_pairs WHERE {Q.TIDY.format('label')} IN ('flag', 'review'))
       SELECT s.id_a, s.id_b, CASE WHEN k.key_a IS NULL THEN 'not_duplicate' ELSE 'duplicate' END AS decision, 'simulated' AS reviewer FROM s LEFT JOIN known k ON k.key_a = s.id_a AND k.key_b = s.id_b""")
def simulated_decisions(spark, d):
    return R.simulated_decisions(table(spark, d, "invoices"), table(spark, d, "invoice_pairs"))


@query("dashboard", f"""WITH {Q.DISTRIBUTION}, f AS (SELECT 0.9::DOUBLE AS threshold, {_COUNTS}, count(*) FILTER (score >= threshold AND gt) AS hits FROM (SELECT *, 0.9 AS threshold FROM dist) z),
       n AS (SELECT count(*) AS n_invoices, nullif(count(*) FILTER (duplicate_of <> ''), 0) AS known FROM invoices),
       l AS (SELECT count(*) FILTER (x = 'flag') AS label_flag, count(*) FILTER (x = 'review') AS label_review, count(*) FILTER (x = 'pass') AS label_pass FROM (SELECT {Q.TIDY.format('label')} AS x FROM invoice_pairs) z),
       v AS (SELECT count(*) FILTER (decision = 'duplicate') AS verdict_duplicate, count(*) FILTER (decision = 'not_duplicate') AS verdict_not_duplicate FROM decided)
       SELECT f.threshold, flagged, value_at_risk, decided, decided_duplicate, n_invoices, known, label_flag, label_review, label_pass, verdict_duplicate, verdict_not_duplicate,
       CASE WHEN known IS NOT NULL THEN hits END AS tp, CASE WHEN known IS NOT NULL THEN flagged - hits END AS fp, CASE WHEN known IS NOT NULL THEN coalesce(CASE WHEN flagged > 0 THEN round(hits / flagged, 4) END, 0.0) END::DOUBLE AS precision,
       CASE WHEN known > 0 THEN round(hits / known, 4) END AS recall, CASE WHEN decided > 0 THEN round(decided_duplicate / decided, 4) END AS estimated_precision FROM f, n, l, v""")
def dashboard(spark, d):
    """Counts and figures at the threshold of the untuned scoring."""
    return R.dashboard(table(spark, d, "invoices"), table(spark, d, "invoice_pairs"), table(spark, d, "review_decisions"))


@query("feature_rows", """SELECT p.id_a, p.id_b, coalesce(p.breakdown.invoice_no, 0.0) AS f_invoice_no, coalesce(p.breakdown.date, 0.0) AS f_date, m.same AS f_period_match,
       CASE WHEN p.breakdown.rule = 'reinvoice_pattern' THEN m.same ELSE 0.0 END::DOUBLE AS f_rule_period_match, CASE WHEN p.breakdown.rule = 'reinvoice_pattern' THEN 1.0 - m.same ELSE 0.0 END::DOUBLE AS f_rule_period_diff
       FROM invoice_pairs p LEFT JOIN invoices a ON a.id = p.id_a LEFT JOIN invoices b ON b.id = p.id_b,
       LATERAL (SELECT CASE WHEN strftime(a.invoice_date, '%Y-%m') = strftime(b.invoice_date, '%Y-%m') THEN 1.0 ELSE 0.0 END::DOUBLE AS same) m""")
def feature_rows(spark, d):
    rows = L.with_features(table(spark, d, "invoice_pairs"), table(spark, d, "invoices"))
    return rows.select("id_a", "id_b", "f_invoice_no", "f_date", "f_period_match", "f_rule_period_match", "f_rule_period_diff")


@query("tuned_pairs")
def tuned_pairs(spark, d):
    """Stored pairs rescored by a model learned from the reviewers' verdicts."""
    pairs, inv = table(spark, d, "invoice_pairs"), table(spark, d, "invoices")
    model = L.build_model(pairs, inv, R.latest_decisions(table(spark, d, "review_decisions")), "m1")
    return L.rescored(pairs, inv, model)
