"""DuckDB statements that compute each registered query another way, for comparison.

Every statement is a WITH list of shared views, the ones it needs, and a final SELECT. The
oracle favours the plainest form (whole-population windows, medians, joins), not speed.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["gl"] = """
SELECT t.entry_id, t.line_no, t.posting_date, t.entered_at, year(t.posting_date) AS fiscal_year,
       month(t.posting_date) AS period, t.account_code, a.account_name, a.account_type, t.description,
       t.debit_cents, t.credit_cents, t.debit_cents - t.credit_cents AS amount_cents,
       abs(t.debit_cents - t.credit_cents) AS abs_cents, t.source, t.created_by, t.k, t.dup
FROM (SELECT k, dup, entry_id, 1 AS line_no, posting_date, entered_at, dr AS account_code, description,
             cents AS debit_cents, CAST(0 AS BIGINT) AS credit_cents, source, created_by FROM gl_entries
      UNION ALL
      SELECT k, dup, entry_id, 2, posting_date, entered_at, cr, description, CAST(0 AS BIGINT),
             cents - CASE WHEN k % 997 = 1 THEN 1234 ELSE 0 END, source, created_by FROM gl_entries) t
JOIN (VALUES ('1000', 'Cash', 'Asset'), ('1200', 'Receivables', 'Asset'), ('1300', 'Inventory', 'Asset'),
  ('1400', 'Prepaid', 'Asset'), ('2000', 'Payables', 'Liability'), ('2200', 'Payroll Liabilities', 'Liability'),
  ('2500', 'Note Payable', 'Liability'), ('4000', 'Sales Revenue', 'Revenue'), ('6000', 'Salaries', 'Expense'))
  AS a(account_code, account_name, account_type) ON a.account_code = t.account_code"""
VIEWS["gl_base"] = """
SELECT o_orderkey AS k, o_custkey AS cust, o_orderdate AS d0, o_orderpriority AS pr,
       CAST(SUM(CAST(floor(l_extendedprice * 10 + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS BIGINT) AS c0
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"""
VIEWS["gl_posted"] = """
SELECT k, cust,
  CASE WHEN k % 613 = 0 THEN c0 - c0 % 100000 + 100000 WHEN k % 211 = 0 THEN 970000 + k % 30000
       WHEN k % 3001 = 7 THEN c0 * 100000 ELSE c0 END AS cents,
  CASE WHEN isodow(d0) >= 6 AND k % 97 <> 0 THEN d0 + to_days(CAST(8 - isodow(d0) AS INTEGER)) ELSE d0 END AS d,
  CASE substr(pr, 1, 1) WHEN '1' THEN 'Manual' WHEN '2' THEN 'AP' WHEN '3' THEN 'AR' WHEN '4' THEN 'Bank' ELSE 'Payroll' END AS source
FROM gl_base"""
VIEWS["gl_once"] = """
SELECT k, concat('JE-', lpad(CAST(k AS VARCHAR), 9, '0')) AS entry_id, d AS posting_date,
  d + to_hours(CAST(CASE WHEN k % 89 = 0 THEN 22 ELSE 8 + k % 10 END AS INTEGER)) AS entered_at, source,
  concat('user', CAST(cust % 5 AS VARCHAR)) AS created_by, concat('Order ', CAST(cust AS VARCHAR)) AS description, cents,
  CASE WHEN k % 2503 = 5 THEN '1400' WHEN source IN ('Manual', 'AR') THEN '1200' WHEN source = 'AP' THEN '1300'
       WHEN source = 'Bank' THEN '1000' ELSE '6000' END AS dr,
  CASE WHEN k % 4001 = 11 THEN '2500' WHEN source IN ('Manual', 'AR') THEN '4000' WHEN source = 'AP' THEN '2000'
       WHEN source = 'Bank' THEN '1200' ELSE '2200' END AS cr, FALSE AS dup FROM gl_posted"""
VIEWS["gl_entries"] = """
SELECT * FROM gl_once UNION ALL
SELECT k, concat(entry_id, '-D'), posting_date + to_days(CAST(k % 10 AS INTEGER)), entered_at + to_days(CAST(k % 10 AS INTEGER)),
       source, created_by, description, cents, dr, cr, TRUE FROM gl_once WHERE k % 701 = 3"""
VIEWS["holiday"] = """
SELECT CAST(x AS DATE) AS hd FROM (SELECT unnest(generate_series(
    make_date((SELECT min(fiscal_year) FROM gl), 1, 1), make_date((SELECT max(fiscal_year) FROM gl), 12, 31), INTERVAL 1 DAY)) AS x)
WHERE (month(x), day(x)) IN ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))
   OR (isodow(x) = 1 AND (month(x), (day(x) - 1) // 7 + 1) IN ((1, 3), (2, 3), (9, 1), (10, 2)))
   OR (isodow(x) = 1 AND month(x) = 5 AND month(x + INTERVAL 7 DAY) = 6)
   OR (isodow(x) = 4 AND month(x) = 11 AND (day(x) - 1) // 7 = 3)"""
VIEWS["ent"] = """
SELECT h.*, greatest(td, tc) AS ac, td - tc AS imb, isodow(entered_at) >= 6 AS is_weekend,
  CAST(entered_at AS DATE) IN (SELECT hd FROM holiday) AS is_holiday, p.debit_accounts, p.credit_accounts, p.pair
FROM (SELECT entry_id, arg_min(posting_date, line_no) AS posting_date, arg_min(entered_at, line_no) AS entered_at,
    arg_min(fiscal_year, line_no) AS fiscal_year, arg_min(period, line_no) AS period, arg_min(source, line_no) AS source,
    arg_min(created_by, line_no) AS created_by, arg_min(description, line_no) AS description,
    CAST(sum(debit_cents) AS BIGINT) AS td, CAST(sum(credit_cents) AS BIGINT) AS tc, count(line_no) AS n_lines
  FROM gl GROUP BY entry_id) h LEFT JOIN pairs p USING (entry_id)"""
VIEWS["pairs"] = """
SELECT entry_id, s.debit_accounts, c.credit_accounts,
  coalesce(s.debit_accounts, '') || '>' || coalesce(c.credit_accounts, '') AS pair
FROM (SELECT entry_id, string_agg(account_code, '|' ORDER BY account_code) AS debit_accounts
      FROM (SELECT DISTINCT entry_id, account_code FROM gl WHERE debit_cents > 0) GROUP BY 1) s
FULL JOIN (SELECT entry_id, string_agg(account_code, '|' ORDER BY account_code) AS credit_accounts
      FROM (SELECT DISTINCT entry_id, account_code FROM gl WHERE credit_cents > 0) GROUP BY 1) c USING (entry_id)"""
VIEWS["acct"] = """
SELECT account_code, n, med, median(abs(v - med)) AS mad FROM (
  SELECT account_code, log10(abs_cents / 100.0::DOUBLE) AS v, count(*) OVER w AS n,
         median(log10(abs_cents / 100.0::DOUBLE)) OVER w AS med
  FROM gl WHERE abs_cents > 0 WINDOW w AS (PARTITION BY account_code)) GROUP BY ALL"""


def money(cents: str, whole: bool = False) -> str:
    return f"format('{{:,.{0 if whole else 2}f}}', ({cents}) / 100.0::DOUBLE)"


def _flag(test: str, name: str, severity: str, reason: str, source: str, account: str = "''", line: str = "0") -> str:
    return (f"SELECT entry_id, '{test}' AS test_id, '{name}' AS test_name, '{severity}' AS severity, {reason} AS reason, "
            f"{account} AS account_code, {line} AS line_no FROM {source}")


VIEWS["f01"] = _flag("JET-01", "Round-dollar amount", "Medium",
                     f"'Entry total is exactly $' || {money('ac', True)} || ' - a round thousand. Confirm the basis for the amount and whether it is an estimate or accrual.'",
                     "ent WHERE ac >= 100000 AND ac % 100000 = 0")
VIEWS["f02"] = _flag("JET-02", "Weekend posting", "Medium",
                     "'Keyed on ' || strftime(entered_at, '%A %Y-%m-%d') || ' (a weekend) by ' || created_by || '. Ask why the entry could not wait for a business day.'",
                     "ent WHERE is_weekend")
VIEWS["f03"] = _flag("JET-03", "After-hours posting", "Medium",
                     "'Keyed at ' || strftime(entered_at, '%H:%M on %Y-%m-%d') || ' by ' || created_by || ', outside the 06:00-20:00 window. Corroborate with the user''s normal working pattern.'",
                     "ent WHERE hour(entered_at) < 6 OR hour(entered_at) >= 20")
VIEWS["f04"] = _flag("JET-04", "Holiday posting", "Medium",
                     "'Keyed on ' || strftime(entered_at, '%Y-%m-%d') || ', a US federal holiday, by ' || created_by || '.'",
                     "ent WHERE is_holiday AND NOT is_weekend")
VIEWS["f05"] = _flag("JET-05", "Period-end manual revenue", "High",
                     f"'Manual credit of $' || {money('credit_cents')} || ' to ' || account_name || ' on ' || strftime(posting_date, '%Y-%m-%d') || ', within 3 days of period close. Obtain support and test cut-off.'",
                     "(SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY line_no) AS rn FROM gl WHERE account_type = 'Revenue' AND credit_cents > 0 AND source = 'Manual' AND date_diff('day', CAST(posting_date AS DATE), last_day(posting_date)) < 3) WHERE rn = 1")
VIEWS["f06"] = _flag("JET-06", "Just under approval threshold", "High",
                     f"'$' || {money('ac')} || ' falls within 3% beneath the $10,000 approval threshold. Review for split or structured transactions.'",
                     "ent WHERE ac >= 970000 AND ac < 1000000")
VIEWS["f07"] = _flag("JET-07", "Possible duplicate entry", "High",
                     f"'Same amount ($' || {money('ac')} || '), accounts and description as ' || first_id || ' posted ' || gap || ' day(s) earlier. Confirm this is not a double posting.'",
                     "(SELECT *, date_sub('day', first_date, posting_date) AS gap FROM (SELECT *, row_number() OVER w AS rn, first_value(entry_id) OVER w AS first_id, first_value(posting_date) OVER w AS first_date FROM ent WINDOW w AS (PARTITION BY ac, pair, description ORDER BY posting_date, entered_at, entry_id))) WHERE rn > 1 AND gap BETWEEN 0 AND 7")
VIEWS["f08"] = _flag("JET-08", "Rare account combination", "Medium",
                     "'Debit ' || debit_accounts || ' / credit ' || credit_accounts || ' occurs only ' || n || ' time(s) in the population. Understand the business purpose.'",
                     "(SELECT *, count(*) OVER (PARTITION BY pair) AS n FROM ent WHERE pair IS NOT NULL) WHERE n <= 3")
VIEWS["f09"] = _flag("JET-09", "Dormant account activity", "Medium",
                     "'Account ' || account_code || ' (' || account_name || ') had no activity for ' || gap || ' days before this entry.'",
                     "(SELECT *, date_sub('day', lag(posting_date) OVER (PARTITION BY account_code ORDER BY posting_date, entered_at, entry_id, line_no), posting_date) AS gap FROM gl) WHERE gap > 120",
                     "account_code", "line_no")
VIEWS["f10"] = _flag("JET-10", "Unbalanced entry", "High",
                     f"'Debits $' || {money('td')} || ' do not equal credits $' || {money('tc')} || ' (difference $' || {money('imb')} || '). Resolve before relying on the population.'",
                     "ent WHERE abs(imb) > 0.5")
VIEWS["zlines"] = """
SELECT g.*, a.med, 0.6745::DOUBLE * (log10(abs_cents / 100.0::DOUBLE) - a.med) / a.mad AS z FROM gl g JOIN acct a USING (account_code)
WHERE g.abs_cents > 0 AND a.n >= 30 AND a.mad <> 0"""
VIEWS["f11"] = _flag("JET-11", "Large value outlier", "Medium",
                     f"'$' || {money('abs_cents')} || ' in ' || account_name || ' is ' || format('{{:.1f}}', z) || ' robust standard deviations above the account median of $' || format('{{:,.2f}}', pow(10.0::DOUBLE, med)) || ' (measured on a log scale, since transaction values are lognormal).'",
                     "zlines WHERE z > 3.5", "account_code", "line_no")
VIEWS["f12"] = _flag("JET-12", "Manual entry outside approver list", "Low",
                     "'Manual entry keyed by ' || created_by || ', who is not in the approved list (user0, user1). Confirm delegated authority.'",
                     "ent WHERE source = 'Manual' AND created_by NOT IN ('user0', 'user1')")
VIEWS["flags"] = " UNION ALL ".join(f"SELECT * FROM f{i:02d}" for i in range(1, 13))
VIEWS["scored"] = """
SELECT e.*, coalesce(r.risk_score, 0.0::DOUBLE) AS risk_score, coalesce(r.n_flags, 0) AS n_flags,
  coalesce(r.tests_fired, '') AS tests_fired, coalesce(r.reasons, '') AS reasons
FROM ent e LEFT JOIN (SELECT entry_id,
    CAST(sum(CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) AS DOUBLE) AS risk_score,
    count(DISTINCT test_id) AS n_flags, array_to_string(list_sort(list(DISTINCT test_id)), ', ') AS tests_fired,
    string_agg(reason, ' | ' ORDER BY test_id, account_code, line_no, reason) AS reasons
  FROM flags GROUP BY entry_id) r USING (entry_id)"""
VIEWS["scores"] = "SELECT entry_id, (CAST('0x' || substr(md5(entry_id), 1, 8) AS BIGINT) % 1000003) / 1000003.0::DOUBLE AS model_score FROM ent"
VIEWS["tiers"] = """
SELECT *, model_score >= (SELECT min(model_score) FROM (SELECT model_score, row_number() OVER (ORDER BY model_score DESC) AS rn FROM scores)
    WHERE rn <= greatest(1, (SELECT round_even(count(*) * 0.02::DOUBLE, 0) FROM scores))) AS model_flag, risk_score > 0 AS rule_flag
FROM scored JOIN scores USING (entry_id)"""
VIEWS["combined"] = """
SELECT *, CASE WHEN rule_flag AND model_flag THEN 'both' WHEN rule_flag THEN 'rules only' WHEN model_flag THEN 'model only' ELSE 'neither' END AS agreement FROM tiers"""
VIEWS["lab"] = """
SELECT entry_id, anomaly_type <> '' AS is_anomaly, anomaly_type FROM (SELECT entry_id, CASE WHEN dup THEN 'duplicate_entry'
  WHEN k % 613 = 0 THEN 'round_amount' WHEN k % 211 = 0 THEN 'just_under_threshold' WHEN k % 997 = 1 THEN 'unbalanced_entry'
  WHEN k % 2503 = 5 THEN 'dormant_account' WHEN k % 4001 = 11 THEN 'rare_account_pair' WHEN k % 89 = 0 THEN 'after_hours_entry'
  WHEN k % 97 = 0 THEN 'weekend_entry' WHEN k % 1009 = 2 THEN 'benford_drift' WHEN k % 1511 = 4 THEN 'token_amount' ELSE '' END AS anomaly_type
  FROM (SELECT DISTINCT entry_id, k, dup FROM gl))"""
VIEWS["once"] = "SELECT DISTINCT entry_id, k FROM gl WHERE NOT dup"
VIEWS["notes"] = """
SELECT 2 * k + v AS id, CASE WHEN k % 11 = 0 THEN 'csv:b' ELSE 'csv:a' END AS ledger_id, entry_id,
  'Note ' || v || ' on ' || entry_id AS summary, 'Several tests fired.' AS why_flagged,
  ['Invoice', 'Approval of ' || entry_id] AS evidence_to_request, 'none' AS suggested_control,
  ['high', 'medium', 'low'][k % 3 + 1] AS confidence, 'writer-1' AS model,
  '2024-01-0' || (k % 3 + 1 + v) || 'T10:' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || ':00+00:00' AS generated_at
FROM once, (VALUES (0), (1)) AS t(v) WHERE k % 7 = 0 AND (v = 0 OR k % 14 = 0)"""
VIEWS["decs"] = """
SELECT 2 * k + v AS id, CASE WHEN k % 11 = 0 THEN 'csv:b' ELSE 'csv:a' END AS ledger_id, entry_id,
  ['accept', 'dismiss', 'escalate'][(k + v) % 3 + 1] AS decision, 'reviewer' || (k % 4) AS reviewer, 'seen ' || v AS note,
  CAST(k % 7 AS DOUBLE) AS risk_score, 0.5::DOUBLE AS model_score, CASE WHEN k % 35 = 0 AND k % 2 = 0 THEN 2 * k END AS narrative_id,
  '2024-01-02T10:' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || ':00+00:00' AS decided_at
FROM once, (VALUES (0), (1)) AS t(v) WHERE k % 5 = 0 AND (v = 0 OR k % 10 = 0)"""
VIEWS["mydecs"] = "SELECT * FROM decs WHERE ledger_id = 'csv:a'"
VIEWS["mynotes"] = "SELECT * FROM notes WHERE ledger_id = 'csv:a'"
VIEWS["cur"] = "SELECT d.* FROM mydecs d JOIN (SELECT entry_id, max(id) AS id FROM mydecs GROUP BY 1) USING (entry_id, id)"
VIEWS["note_now"] = "SELECT n.* FROM mynotes n JOIN (SELECT entry_id, max(id) AS id FROM mynotes GROUP BY 1) USING (entry_id, id)"
VIEWS["state"] = """
SELECT b.entry_id, decision, reviewer, b.note, decided_at, shown AS narrative_id, v.summary AS narrative_summary, v.confidence AS narrative_confidence,
  coalesce(shown <> newest, FALSE) AS narrative_superseded,
  CASE WHEN decision IS NULL OR shown IS NULL THEN '' WHEN recorded IS NOT NULL THEN 'yes'
       WHEN coalesce(v.generated_at, '') > coalesce(decided_at, '') THEN 'no' ELSE 'unknown' END AS narrative_seen_by_reviewer
FROM (SELECT entry_id, c.decision, c.reviewer, c.note, c.decided_at, c.narrative_id AS recorded, n.id AS newest, coalesce(c.narrative_id, n.id) AS shown
      FROM cur c FULL JOIN note_now n USING (entry_id)) b LEFT JOIN mynotes v ON v.id = b.shown"""


def needed(sql: str) -> list[str]:
    """The views a statement uses, each after the ones it uses itself."""
    order: list[str] = []

    def visit_one(name: str) -> None:
        body = VIEWS[name]
        for other in VIEWS:
            if other != name and other not in order and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b|,\s*{other}\b(?=\s*(?:WHERE|$|\)))", body):
                visit_one(other)
        if name not in order:
            order.append(name)

    for name in VIEWS:
        if re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", sql):
            visit_one(name)
    return order


def statement(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` with the views it uses ahead of it."""
    extra = extra or {}
    text = " ".join([sql, *extra.values()])
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in needed(text)] + [f"{n} AS ({b})" for n, b in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + sql
