"""SQL (for an engine without look-around) that states the canonical forms, to compare results with."""

from __future__ import annotations

from tallyline.functions.normalize import CURRENCY_WORDS, LEGAL_ANYWHERE, LEGAL_AT_END


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def invoice_no(raw: str) -> str:
    s = f"upper(regexp_replace(coalesce({raw}, ''), '[^0-9A-Za-z]+', '', 'g'))"
    return f"""(SELECT coalesce(string_agg(CASE WHEN (i > 1 AND substr(s, i - 1, 1) BETWEEN '0' AND '9') OR (i < length(s) AND substr(s, i + 1, 1) BETWEEN '0' AND '9')
        THEN translate(substr(s, i, 1), 'OILSBZG', '0115826') ELSE substr(s, i, 1) END, '' ORDER BY i), '')
        FROM (SELECT {s} AS s) q, unnest(range(1, length(s) + 1)) r(i))"""


def vendor(raw: str) -> str:
    ends = "|".join(LEGAL_AT_END)
    text = f"regexp_replace(regexp_replace(upper(coalesce({raw}, '')), '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g'), '[.,/()\\-]+', ' ', 'g')"
    kept = f"array_to_string(list_filter(regexp_split_to_array({text}, ' +'), lambda t: t <> '' AND t NOT IN ({_list(LEGAL_ANYWHERE)})), ' ')"
    return f"regexp_replace({kept}, '(?:^| )(?:{ends})(?: (?:{ends}))*$', '')"


def key(canonical: str) -> str:
    return f"array_to_string(list_sort(string_split({canonical}, ' ')), ' ')"


def tax_id(raw: str) -> str:
    return f"regexp_replace(coalesce({raw}, ''), '[^0-9]+', '', 'g')"


def amount(raw: str) -> str:
    """Whole units of an amount as ``normalize.amount_parsed`` reads it."""

    def single(mark: str) -> str:
        parts = f"string_split(t, '{mark}')"
        return f"CASE WHEN len(list_filter({parts}[2:], lambda p: length(p) <> 3)) = 0 THEN array_to_string({parts}, '') ELSE replace(t, '{mark}', '.') END"

    words = "|".join(CURRENCY_WORDS)
    cleaned = f"regexp_replace(regexp_replace(regexp_replace({raw}, '(?i)\\b(?:{words})\\b\\.?', ' ', 'g'), '[^\\d.,\\-]', '', 'g'), '^[., ]+|[., ]+$', '', 'g')"
    last = lambda mark: f"length(t) - strpos(reverse(t), '{mark}')"
    return f"""(SELECT CASE WHEN regexp_full_match(plain, '-?\\d*\\.?\\d*') AND regexp_matches(plain, '\\d') THEN TRY_CAST(round(TRY_CAST(plain AS DECIMAL(38, 10)), 0) AS BIGINT) END FROM (
        SELECT CASE WHEN contains(t, ',') AND contains(t, '.') THEN CASE WHEN {last(',')} > {last('.')} THEN replace(replace(t, '.', ''), ',', '.') ELSE replace(t, ',', '') END
        WHEN contains(t, ',') THEN {single(',')} WHEN contains(t, '.') THEN {single('.')} ELSE t END AS plain FROM (SELECT {cleaned} AS t) c) q)"""


def normalized(table: str = "invoices") -> str:
    return f"""(SELECT *, {key('vendor')} AS vendor_key FROM (
        SELECT id, coalesce(created_at, TIMESTAMP '0001-01-01') AS placed, {vendor('vendor_name')} AS vendor, {invoice_no('invoice_no')} AS invoice_no,
               coalesce(amount, 0) AS amount, invoice_date AS day, {tax_id('tax_id')} AS tax_id, coalesce(strftime(invoice_date, '%Y-%m'), '') AS period
        FROM {table}) z)"""


TIDY = "regexp_replace(lower(trim({0})), '\\s+', '_', 'g')"

KNOWN = """known AS (SELECT least(id, duplicate_of) AS key_a, greatest(id, duplicate_of) AS key_b,
        max(CASE WHEN variant <> '' THEN variant ELSE 'unknown' END) AS variant FROM invoices WHERE duplicate_of <> '' GROUP BY 1, 2)"""

SCORES = """scores AS (SELECT key_a, key_b, score FROM (SELECT *, row_number() OVER (PARTITION BY key_a, key_b ORDER BY created_at DESC NULLS LAST, score DESC) AS rn
        FROM (SELECT least(id_a, id_b) AS key_a, greatest(id_a, id_b) AS key_b, score, created_at FROM invoice_pairs WHERE score IS NOT NULL) p) q WHERE rn = 1)"""

JUDGED = f"{KNOWN}, {SCORES}, judged AS (SELECT coalesce(k.key_a, s.key_a) AS key_a, coalesce(k.key_b, s.key_b) AS key_b, variant, coalesce(score, 0.0) AS s FROM known k FULL OUTER JOIN scores s ON k.key_a = s.key_a AND k.key_b = s.key_b)"

DECIDED = f"""decided AS (SELECT key_a, key_b, decision, reviewer, decided_at FROM (SELECT *, row_number() OVER (PARTITION BY key_a, key_b
        ORDER BY decided_at DESC NULLS LAST, decision DESC, coalesce(reviewer, '') DESC) AS rn
        FROM (SELECT least(id_a, id_b) AS key_a, greatest(id_a, id_b) AS key_b, {TIDY.format('decision')} AS decision, reviewer, decided_at FROM review_decisions) d
        WHERE decision IN ('duplicate', 'not_duplicate')) q WHERE rn = 1)"""

DISTRIBUTION = f"""{DECIDED}, dist AS (SELECT p.id_a, p.id_b, round(p.score, 6) AS score,
        coalesce(a.duplicate_of = p.id_b, false) OR coalesce(b.duplicate_of = p.id_a, false) AS gt,
        greatest(coalesce(a.amount, 0), coalesce(b.amount, 0)) AS value, d.decision
        FROM invoice_pairs p JOIN invoices a ON a.id = p.id_a JOIN invoices b ON b.id = p.id_b
        LEFT JOIN decided d ON d.key_a = least(p.id_a, p.id_b) AND d.key_b = greatest(p.id_a, p.id_b))"""

MEASURES = """CASE WHEN flagged_pairs > 0 THEN tp / flagged_pairs ELSE 0.0 END AS precision, CASE WHEN gt_pairs > 0 THEN tp / gt_pairs ELSE 0.0 END AS recall"""


def vendor_similarities(pairs: str) -> str:
    """CTEs that end in ``sims(x, y, similarity)`` for the different non-empty vendors x, y of ``pairs``.

    The longest common subsequence is the bit-parallel one: a row of its table is one integer, which list_reduce carries
    over the letters of y.
    """
    return f"""vp AS MATERIALIZED (SELECT DISTINCT least(x, y) AS x, greatest(x, y) AS y FROM {pairs} q WHERE x <> '' AND y <> '' AND x <> y),
      tokens AS MATERIALIZED (SELECT x, y, list_sort(string_split(x, ' ')) AS ta, list_sort(string_split(y, ' ')) AS tb FROM vp),
      parts AS MATERIALIZED (SELECT *, list_sort(list_distinct(list_filter(ta, lambda t: list_contains(tb, t)))) AS common, list_sort(list_distinct(list_filter(ta, lambda t: NOT list_contains(tb, t)))) AS only_a,
        list_sort(list_distinct(list_filter(tb, lambda t: NOT list_contains(ta, t)))) AS only_b FROM tokens),
      texts AS MATERIALIZED (SELECT x, y, array_to_string(ta, ' ') AS sa, array_to_string(tb, ' ') AS sb, array_to_string(common, ' ') AS base,
        trim(array_to_string(common, ' ') || ' ' || array_to_string(only_a, ' ')) AS full_a, trim(array_to_string(common, ' ') || ' ' || array_to_string(only_b, ' ')) AS full_b,
        len(common) > 0 AND (len(only_a) = 0 OR len(only_b) = 0) AS inside FROM parts),
      asked AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT unnest([{{'a': sa, 'b': sb}}, {{'a': full_a, 'b': full_b}}, {{'a': base, 'b': full_a}}, {{'a': base, 'b': full_b}}], recursive := true) FROM texts WHERE NOT inside) u),
      wide AS MATERIALIZED (SELECT a, b, (1::HUGEINT << length(a)) - 1 AS whole FROM asked WHERE a <> '' AND b <> ''),
      masks AS MATERIALIZED (SELECT a, b, list_prepend({{'m': whole, 'w': whole}}, list_transform(string_split(b, ''), lambda c: {{'m': list_sum(list_transform(range(length(a)), lambda i: CASE WHEN substr(a, i + 1, 1) = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT, 'w': whole}})) AS ms FROM wide),
      rows AS MATERIALIZED (SELECT a, b, list_reduce(ms, lambda r, e: {{'m': ((r.m + (r.m & e.m)) | (r.m - (r.m & e.m))) & e.w, 'w': e.w}}).m AS r FROM masks),
      ratios AS MATERIALIZED (SELECT a, b, 2.0::DOUBLE * (length(a) - bit_count(r)) / (length(a) + length(b)) AS ratio FROM rows),
      sims AS MATERIALIZED (SELECT t.x, t.y, CASE WHEN inside THEN 1.0::DOUBLE ELSE greatest(r1.ratio, r2.ratio, coalesce(r3.ratio, 0.0), coalesce(r4.ratio, 0.0)) END AS similarity
        FROM texts t LEFT JOIN ratios r1 ON r1.a = sa AND r1.b = sb LEFT JOIN ratios r2 ON r2.a = full_a AND r2.b = full_b
        LEFT JOIN ratios r3 ON r3.a = base AND r3.b = full_a LEFT JOIN ratios r4 ON r4.a = base AND r4.b = full_b)"""


CANDIDATES = f"""n AS MATERIALIZED (SELECT * FROM {normalized()} x), keys AS MATERIALIZED (
       SELECT 'vn|' || vendor_key || '|' || invoice_no AS key, id, placed FROM n WHERE vendor_key <> '' AND invoice_no <> '' UNION ALL SELECT 'amt|' || amount, id, placed FROM n),
       usable AS (SELECT key FROM keys GROUP BY key HAVING count(*) BETWEEN 2 AND 1000), held AS (SELECT k.* FROM keys k JOIN usable USING (key)),
       pairs AS MATERIALIZED (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM held a JOIN held b ON a.key = b.key AND (a.placed < b.placed OR a.placed = b.placed AND a.id < b.id))"""

SCORED = f"""{CANDIDATES}, named AS MATERIALIZED (SELECT a.vendor AS x, b.vendor AS y FROM pairs p JOIN n a ON a.id = p.id_a JOIN n b ON b.id = p.id_b), {vendor_similarities('named')},
       raw AS MATERIALIZED (SELECT id_a, id_b, a.invoice_no AS na, b.invoice_no AS nb, a.tax_id AS ta, b.tax_id AS tb, abs(date_diff('day', a.day, b.day)) AS gap,
         CASE WHEN a.invoice_no = '' OR b.invoice_no = '' THEN 0.0 WHEN a.invoice_no = b.invoice_no THEN 1.0 ELSE 0.7 * jaro_winkler_similarity(a.invoice_no, b.invoice_no) END::DOUBLE AS s_no,
         CASE WHEN a.vendor = '' OR b.vendor = '' THEN 0.0 WHEN a.vendor = b.vendor THEN 1.0 ELSE v.similarity END::DOUBLE AS s_vendor,
         CASE WHEN a.amount = b.amount THEN 1.0 ELSE greatest(0.0, 1.0 - abs(abs(a.amount) - abs(b.amount))::DOUBLE / greatest(abs(a.amount), abs(b.amount))) END::DOUBLE AS s_amount,
         coalesce(greatest(0.0, 1.0 - abs(date_diff('day', a.day, b.day))::DOUBLE / 45.0), 0.0)::DOUBLE AS s_date, CASE WHEN a.period <> '' AND a.period = b.period THEN 1.0 ELSE 0.0 END::DOUBLE AS period_match
         FROM pairs p JOIN n a ON a.id = p.id_a JOIN n b ON b.id = p.id_b LEFT JOIN sims v ON v.x = least(a.vendor, b.vendor) AND v.y = greatest(a.vendor, b.vendor)),
       ruled AS (SELECT *, coalesce(s_vendor = 1.0 AND s_amount = 1.0 AND na <> nb AND gap BETWEEN 1 AND 14, false) AS again,
         CASE WHEN ta = '' OR tb = '' THEN 'n/a' WHEN ta = tb THEN 'match' ELSE 'mismatch' END AS tax, 0.35 * s_no + 0.25 * s_vendor + 0.30 * s_amount + 0.10 * s_date AS total FROM raw),
       scored AS MATERIALIZED (SELECT *, round(least(1.0, CASE WHEN tax = 'mismatch' THEN least(0.55, CASE WHEN again THEN greatest(total, 0.92) ELSE total END) WHEN again THEN greatest(total, 0.92) ELSE total END)::DOUBLE, 9) AS score FROM ruled),
       labelled AS MATERIALIZED (SELECT *, CASE WHEN score >= 0.9 THEN 'flag' WHEN score >= 0.7 THEN 'review' ELSE 'pass' END AS label FROM scored)"""
