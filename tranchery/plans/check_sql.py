"""Common table expressions of the check queries, in the SQL of another engine: an independent second statement of the layers."""

from __future__ import annotations

from tranchery.functions.loan import BAD_STATUSES, STATUS_BUCKETS, TERMINAL_STATUSES

END = "2001-12-01"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def bands(c: str, table) -> str:
    out = f"case when {c} is null then 'UNKNOWN'"
    for upper, name in table[:-1]:
        out += f" when {c} < {upper} then '{name}'"
    return out + f" else '{table[-1][1]}' end"


_INCOME = [(30000, "L0_<3w"), (60000, "L1_3-6w"), (100000, "L2_6-10w"), (200000, "L3_10-20w"), (None, "L4_>=20w")]
_FICO = [(660, "F0_<660"), (700, "F1_660-699"), (740, "F2_700-739"), (780, "F3_740-779"), (None, "F4_>=780")]
RATE = [(8, "R0_<8"), (12, "R1_8-12"), (16, "R2_12-16"), (20, "R3_16-20"), (None, "R4_>=20")]
STATUS = "trim(loan_status)"
BUCKET = f"case {STATUS} " + " ".join(f"when '{k}' then '{v}'" for k, v in STATUS_BUCKETS.items()) + " else 'UNKNOWN' end"
BAD = f"coalesce({STATUS} in {_in(BAD_STATUSES)}, false)"
TERMINAL = f"coalesce({STATUS} in {_in(TERMINAL_STATUSES)}, false)"
ISSUE = "cast(try_strptime(issue_d, '%b-%Y') as date)"
LAST = "cast(try_strptime(last_pymnt_d, '%b-%Y') as date)"
TERM = "try_cast(nullif(regexp_extract(term, '([0-9]+)', 1), '') as integer)"
RATE_OF = "try_cast(replace(int_rate, '%', '') as decimal(8,4))"
EMP = "case when contains(lower(emp_length), 'n/a') then null else try_cast(nullif(regexp_extract(emp_length, '([0-9]+)', 1), '') as integer) end"


def mi(d: str) -> str:
    return f"(year({d}) * 12 + month({d}))"


def month_of(i: str) -> str:
    """First day of the month with that index (year*12 + month)."""
    return f"make_date(cast(({i} - 1) // 12 as integer), cast(({i} - 1) % 12 + 1 as integer), 1)"


_PARTS = {
    "loan_raw": """select cast(k as varchar) id, cast(o_totalprice as decimal(14,2)) loan_amnt, cast(o_totalprice as decimal(14,2)) funded_amnt,
  case when k % 3 = 0 then ' 60 months' else ' 36 months' end term,
  concat(cast(5 + k % 25 as varchar), '.', lpad(cast(k % 100 as varchar), 2, '0'), '%') int_rate, cast(null as decimal(14,2)) installment,
  case when k % 211 = 0 then null else substr('ABCDEFG', cast(1 + k % 7 as integer), 1) end grade,
  case when k % 211 = 0 then null else substr('ABCDEFG', cast(1 + k % 7 as integer), 1) || cast(1 + k % 5 as varchar) end sub_grade,
  case k % 12 when 0 then '< 1 year' when 10 then '10+ years' when 11 then 'n/a' else cast(k % 12 as varchar) || ' years' end emp_length,
  case k % 3 when 0 then ' rent' when 1 then 'Mortgage' else 'OWN ' end home_ownership, cast((c_acctbal + 1000) * 20 as decimal(16,2)) annual_inc,
  case k % 3 when 0 then 'Verified' when 1 then 'Source Verified' else 'Not Verified' end verification_status,
  case k % 4 when 0 then 'debt_consolidation' when 1 then 'credit_card' when 2 then 'home_improvement' else 'other' end purpose,
  'n' || lpad(cast(c_nationkey as varchar), 2, '0') addr_state, cast(k % 40 as decimal(10,4)) dti,
  case when c_custkey % 101 = 0 then null else cast(630 + 10 * (c_custkey % 18) as decimal(8,2)) end fico_range_low,
  case when c_custkey % 101 = 0 then null else cast(634 + 10 * (c_custkey % 18) as decimal(8,2)) end fico_range_high,
  strftime(o_orderdate, '%b-%Y') issue_d,
  case o_orderstatus when 'F' then case when k % 5 = 0 then 'Charged Off' when k % 97 = 0 then 'Default' when k % 89 = 0 then 'Does not meet the credit policy. Status:Fully Paid' else 'Fully Paid' end
    when 'O' then ' Current ' when 'P' then case k % 4 when 0 then 'In Grace Period' when 1 then 'Late (16-30 days)' when 2 then 'Late (31-120 days)' else 'Does not meet the credit policy. Status:Charged Off' end end loan_status,
  case when k % 67 = 0 then null else strftime(cast(o_orderdate as date) + to_months(cast(k % 30 as integer)), '%b-%Y') end last_pymnt_d,
  cast(k % 1000 as decimal(14,2)) out_prncp, cast(k % 5000 as decimal(14,2)) total_rec_prncp, cast(k % 700 as decimal(14,2)) total_rec_int, cast(k % 90 as decimal(14,2)) recoveries,
  cast(k % 6000 as decimal(14,2)) total_pymnt, cast(k % 400 as decimal(14,2)) last_pymnt_amnt
  from (select *, o_orderkey k from orders) o join customer on o_custkey = c_custkey""",
    "facts_all": f"""select id loan_id, loan_amnt, funded_amnt, {TERM} term_months, {RATE_OF} int_rate, installment, trim(grade) grade, trim(sub_grade) sub_grade, {EMP} emp_length_years,
  upper(trim(home_ownership)) home_ownership, annual_inc, trim(verification_status) verification_status, trim(replace(purpose, '_', ' ')) purpose, upper(trim(addr_state)) addr_state, dti,
  fico_range_low fico_low, fico_range_high fico_high, {ISSUE} issue_date, strftime({ISSUE}, '%Y-%m') issue_month, strftime({ISSUE}, '%Y-%m') vintage,
  case when id is null or not coalesce(loan_amnt > 0, false) or {ISSUE} is null then 'REJECT'
    when not coalesce({RATE_OF} between 0 and 40, false) or not coalesce(trim(grade) in ('A','B','C','D','E','F','G'), false) then 'WARN' else 'PASS' end dq_level from loan_raw""",
    "facts": "select * from facts_all where dq_level <> 'REJECT'",
    "perf": f"""select id loan_id, {STATUS} loan_status, cast({TERMINAL} as integer) is_terminal, cast({BAD} as integer) is_bad, {BUCKET} dpd_bucket, total_rec_prncp, total_rec_int, recoveries, out_prncp,
  total_pymnt, last_pymnt_amnt, {LAST} last_pymnt_d,
  greatest(0, {mi(f"coalesce(case when {TERMINAL} then {LAST} end, date '{END}')")} - {mi(ISSUE)}) mob_final from loan_raw""",
    "applicant": f"""select id loan_id, annual_inc, upper(trim(home_ownership)) home_ownership, try_cast(nullif(regexp_extract(emp_length, '([0-9]+)', 1), '') as integer) emp_length_years,
  upper(trim(addr_state)) addr_state, fico_range_low fico_low, dti, {bands("annual_inc", _INCOME)} income_band, {bands("fico_range_low", _FICO)} fico_band from loan_raw""",
    "term": "select f.*, p.is_bad, a.income_band, a.fico_band from facts f join perf p using (loan_id) join applicant a using (loan_id) where p.is_terminal = 1",
    "snap0": f"""select id loan_id, {ISSUE} issue_date, {mi(ISSUE)} i, {mi(LAST)} p, {BAD} bad, coalesce(out_prncp, 0) out_prncp, coalesce(total_rec_prncp, 0) total_rec_prncp, loan_amnt, trim(grade) grade
  from loan_raw where {ISSUE} is not null""",
    "snap1": f"""select *, i + mob m, coalesce(i + mob - p, -1) gap, case when bad then coalesce(p, i + 12) + 6 end off_at
  from snap0, (select unnest(range(1, 25)) mob) where mob <= least(24, {mi(f"date '{END}'")} - i)""",
    "snap2": "select *, case when off_at <= m then 'CHARGED_OFF' when gap >= 4 then 'DPD_120_PLUS' when gap >= 2 then 'DPD_31_120' when gap >= 1 then 'DPD_1_30' else 'CURRENT' end dpd_bucket from snap1",
    "snap": f"""select loan_id, strftime({month_of("m")}, '%Y-%m') snapshot_month, last_day({month_of("m")}) snapshot_date, strftime(issue_date, '%Y-%m') issue_month, cast(mob as integer) mob,
  cast(greatest(gap, 0) as integer) months_since_last_pymnt, dpd_bucket, cast(dpd_bucket not in ('CURRENT', 'PAID') as integer) is_delinquent, cast(dpd_bucket = 'CHARGED_OFF' as integer) is_bad_month,
  out_prncp, total_rec_prncp, loan_amnt, grade from snap2""",
    "flagged": "select *, max(is_bad_month) over (partition by issue_month, loan_id order by mob rows between unbounded preceding and current row) ever_bad, coalesce(grade, 'UNKNOWN') g from snap where mob between 1 and 24",
    "vintage": """select issue_month, g grade, mob, round(cast(sum(ever_bad) as double) / count(*), 6) bad_rate, count(*) exposure_cnt from flagged group by issue_month, g, mob
  union all select issue_month, 'ALL', mob, round(cast(sum(ever_bad) as double) / count(*), 6), count(*) from flagged group by issue_month, mob""",
    "pairs": """select a.snapshot_month from_month, a.dpd_bucket from_bucket, b.dpd_bucket to_bucket, count(*) cnt from snap a join snap b on a.loan_id = b.loan_id
  and b.snapshot_month = strftime(cast(a.snapshot_month || '-01' as date) + to_months(1), '%Y-%m')
  where a.snapshot_month >= strftime(cast((select max(snapshot_month) from snap) || '-01' as date) - to_months(12), '%Y-%m') group by 1, 2, 3""",
    "roll": "select *, round(cast(cnt as double) / sum(cnt) over (partition by from_month, from_bucket), 6) rate from pairs",
    "lines": """select k at_key, concat_ws(',', id, cast(loan_amnt as varchar), term, int_rate, coalesce(grade, ''), issue_d, coalesce(loan_status, ''), case when k >= 1000 then 'x' else '' end) as value from (select *, cast(id as bigint) k from loan_raw)
  union all select k, 'Total amount funded in policy code ' || cast(k % 3 as varchar) || ': 1000' from (select cast(id as bigint) k from loan_raw) where k % 500 = 250
  union all select k, 'Loans that do not meet the credit policy' from (select cast(id as bigint) k from loan_raw) where k % 1000 = 700
  union all select -1, 'id,loan_amnt,term,int_rate,grade,issue_d,loan_status,note' union all select 9, ''""",
    "kinds": "select *, case when regexp_matches(split_part(value, ',', 1), '^([0-9]+[.]?[0-9]*|[.][0-9]+)$') then 'data' else 'junk' end kind from lines",
    "log0": "select event_id seq, user_id pk, ts op_ts, case when event_type <> 'error' then strftime(ts, '%Y-%m-%d') end g1, case when event_type <> 'error' then cast(value as decimal(14,2)) end a1 from events",
    "log1": "select *, lag(g1) over (partition by pk order by seq) g0, lag(a1) over (partition by pk order by seq) a0 from log0",
    "log": "select *, case when g1 is null then 'd' when g0 is null then 'c' else 'u' end op from log1 where g0 is not null or g1 is not null",
    "signed": "select pk, op_ts, -1 sign, g0 grp, a0 amt from log where g0 is not null union all select pk, op_ts, 1, g1, a1 from log where g1 is not null",
    "latest": "select * from (select *, row_number() over (partition by pk order by op_ts desc, seq desc) rn from log) where rn = 1 and op <> 'd'",
}
_NEEDS = {
    "facts_all": ["loan_raw"], "facts": ["facts_all"], "perf": ["loan_raw"], "applicant": ["loan_raw"], "term": ["facts", "perf", "applicant"], "snap0": ["loan_raw"], "snap1": ["snap0"], "snap2": ["snap1"], "snap": ["snap2"],
    "flagged": ["snap"], "vintage": ["flagged"], "pairs": ["snap"], "roll": ["pairs"], "lines": ["loan_raw"], "kinds": ["lines"], "log1": ["log0"], "log": ["log1"], "signed": ["log"], "latest": ["log"],
}


def with_parts(body: str, *names: str) -> str:
    """``body`` after the definitions of the named parts and all that they need."""
    order: list[str] = []

    def add(n):
        for x in _NEEDS.get(n, ()):
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({_PARTS[n]})" for n in order) + "\n" + body
