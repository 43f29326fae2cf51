"""Queries of this subpackage and SQL for those that SQL can state."""

from __future__ import annotations

from tallyline.llm import components, formatting, history, mixing, spam, survivors, tokenize, variants
from tallyline.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_REACH = """, reach(a, b) AS (
    SELECT u, v FROM edges UNION SELECT r.a, e.v FROM reach r JOIN edges e ON r.b = e.u)"""

_LINKS = """WITH RECURSIVE links AS (
    SELECT id_a AS u, id_b AS v FROM invoice_pairs WHERE lower(trim(label)) = 'flag' AND id_a <> id_b),
  edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links)"""


@_query("p2_found", f"{_LINKS}{_REACH} SELECT min(b) AS group_id, a AS id FROM reach GROUP BY a")
def p2_found(spark, folder):
    return components.connected_components(components.flagged_pairs(table(spark, folder, "invoice_pairs")))


_MISSING = "(x IS NULL OR lower(regexp_replace(x, '[^\\p{L}\\p{N}]+', '', 'g')) IN ('', 'na', 'none', 'unknown', 'null'))"

_BEST = f"""WITH RECURSIVE links AS (SELECT id AS u, duplicate_of AS v FROM invoices WHERE trim(duplicate_of) <> '' AND id <> duplicate_of),
  edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links){_REACH},
  members AS (SELECT a AS id, min(b) AS label FROM reach WHERE a IN (SELECT id FROM invoices) GROUP BY a),
  heads AS (SELECT label, min(id) AS group_id FROM members GROUP BY label HAVING count(*) > 1),
  held AS (SELECT h.group_id, i.*, t.trust_rank FROM members m JOIN heads h USING (label) JOIN invoices i ON i.id = m.id
    LEFT JOIN source_trust t ON lower(trim(t.source_type)) = lower(trim(i.source_type))),
  cells AS (SELECT *, unnest([{{'f': 'vendor_name', 'x': vendor_name}}, {{'f': 'invoice_no', 'x': invoice_no}}, {{'f': 'currency', 'x': currency}},
    {{'f': 'tax_id', 'x': tax_id}}, {{'f': 'amount', 'x': CAST(nullif(amount, 0) AS VARCHAR)}}, {{'f': 'invoice_date', 'x': CAST(invoice_date AS VARCHAR)}}], recursive := true) FROM held),
  ranked AS (SELECT group_id, f AS field_name, id, row_number() OVER (PARTITION BY group_id, f ORDER BY coalesce(trust_rank, 2147483647),
    CASE WHEN isnan(extraction_confidence) OR extraction_confidence NOT BETWEEN 0 AND 1 THEN NULL ELSE extraction_confidence END DESC NULLS LAST,
    created_at DESC NULLS LAST, id) AS rn FROM cells WHERE NOT {_MISSING})
  SELECT group_id, field_name, id FROM ranked WHERE rn = 1"""


@_query("p5_found", _BEST)
def p5_found(spark, folder):
    return survivors.best_copies(table(spark, folder, "invoices"), table(spark, folder, "source_trust"))


_VOTED = f"""{_BEST.split("ranked AS")[0].rstrip().rstrip(",")},
  votes AS (SELECT group_id, f, x, CASE WHEN f IN ('amount', 'invoice_date') THEN x ELSE lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) END AS k,
    coalesce(1.0::DOUBLE / (trust_rank + 1), 0.01::DOUBLE) * coalesce(pow(0.5::DOUBLE, greatest(0, date_diff('day', created_at::DATE, (SELECT max(created_at) FROM invoices)::DATE))::DOUBLE / 180.0::DOUBLE), 0.01::DOUBLE) AS w
    FROM cells WHERE NOT {_MISSING}),
  summed AS (SELECT group_id, f, k, sum(round(w * 1e9)::BIGINT) AS n, max({{'w': w, 'v': x}}).v AS x FROM votes GROUP BY 1, 2, 3),
  won AS (SELECT group_id, f, x FROM (SELECT *, row_number() OVER (PARTITION BY group_id, f ORDER BY n DESC, k) AS rn FROM summed) q WHERE rn = 1)
  SELECT group_id, max(x) FILTER (f = 'vendor_name') AS vendor_name, max(x) FILTER (f = 'invoice_no') AS invoice_no, CAST(max(x) FILTER (f = 'amount') AS BIGINT) AS amount,
    max(x) FILTER (f = 'currency') AS currency, CAST(max(x) FILTER (f = 'invoice_date') AS DATE) AS invoice_date, max(x) FILTER (f = 'tax_id') AS tax_id FROM won GROUP BY group_id"""


@_query("p5_voted_records", _VOTED)
def p5_voted_records(spark, folder):
    return survivors.voted_records(table(spark, folder, "invoices"), table(spark, folder, "source_trust"))


@_query("p4_found")
def p4_found(spark, folder):
    return formatting.copies_of_records(table(spark, folder, "invoices"))


@_query("p4_collapsed")
def p4_collapsed(spark, folder):
    return formatting.collapsed(table(spark, folder, "invoices"))


@_query("p7_ids")
def p7_ids(spark, folder):
    return tokenize.encode(table(spark, folder, "documents"), ["doc_id"])


@_query("p7_offsets")
def p7_offsets(spark, folder):
    return tokenize.encode_with_offsets(table(spark, folder, "documents"), ["doc_id"])


@_query("p8_mixture")
def p8_mixture(spark, folder):
    return mixing.Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).documents()


@_query("p8_shares")
def p8_shares(spark, folder):
    return mixing.Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).shares()


@_query("p9_found")
def p9_found(spark, folder):
    return spam.stuffed_pages(table(spark, folder, "documents"))


@_query("p9_features")
def p9_features(spark, folder):
    return spam.page_features(table(spark, folder, "documents"))


@_query("p6_found")
def p6_found(spark, folder):
    return variants.variant_pairs(table(spark, folder, "invoices", "vendor_name"))


@_query("p6_vendors")
def p6_vendors(spark, folder):
    return variants.vendor_classes(table(spark, folder, "invoices", "vendor_name"))


@_query("p3_found")
def p3_found(spark, folder):
    columns = ("id", "vendor_name", "invoice_no", "amount", "batch_no")
    return history.late_duplicates(table(spark, folder, "invoices", *columns))
