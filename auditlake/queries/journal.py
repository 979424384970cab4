"""Queries of the journal-entry tests."""

from __future__ import annotations

from auditlake.operators import journal as j
from auditlake.queries.common import query

D = "cast({} as double)".format
LINE = "engagement_id, entry_no, cast(entry_date as varchar) as entry_date, cast(posting_date as varchar) as posting_date, user_id, account_code, entry_type, cast(debit_amount as double) as debit_amount, cast(credit_amount as double) as credit_amount"
SYSTEM = "|".join(f"^(?:{p})" for p in ("SYSTEM-", *j.SYSTEM_USERS))
CHECKS = {"entry_no": "string", "entry_date": "date", "posting_date": "date", "user_id": "string", "account_code": "bigint", "debit_amount": "decimal(20,2)", "credit_amount": "decimal(20,2)"}
SALES = "sales as (select engagement_id, cast(sum(credit_amount - debit_amount) as double) * 0.005 as threshold from {gl} where regexp_matches(account_code, '^4') group by 1)"
BARE = "coalesce(nullif(regexp_replace(account_code, '^0+', ''), ''), account_code)"


def _integrity_sql() -> str:
    parts = []
    for c, t in CHECKS.items():
        bad = "0" if t == "string" else f"count(*) filter (where nullif(trim({c}), '') is not null and try_cast(nullif(trim({c}), '') as {t}) is null)"
        req = "true" if c in ("entry_no", "entry_date", "account_code") else "false"
        parts.append(f"select engagement_id, '{c}' as \"column\", count(*) as total, count(nullif(trim({c}), '')) as filled, {bad} as invalid, {req} as required from {{gl_raw}} group by 1")
    return (
        "with p as (" + " union all ".join(parts) + ") select engagement_id, \"column\", total, filled, total - filled as missing, invalid, (filled - invalid) / total as pass_rate, "
        "case when invalid > 0 or (required and total > filled) then 'FAIL' else 'OK' end as status from p"
    )


query("je_a01_integrity", lambda t: j.integrity(t.gl_raw, CHECKS, ("entry_no", "entry_date", "account_code")), _integrity_sql())
query("je_a01_totals", lambda t: j.integrity_totals(t.gl_raw, CHECKS, ("entry_no", "entry_date", "account_code")), "with i as (" + _integrity_sql().replace("with p as", "with p0 as").replace("as status from p", "as status, required from p0") + ")\nselect engagement_id, max(total) as total, cast(coalesce(sum(missing) filter (where required), 0) as bigint) as missing_required, cast(sum(invalid) as bigint) as format_errors, count(*) filter (where status = 'FAIL') as failed_columns from i group by 1")
query(
    "je_a02_voucher_balance",
    lambda t: j.voucher_balance(t.gl),
    f"select engagement_id, entry_no, {D('sum(debit_amount)')} as debit, {D('sum(credit_amount)')} as credit, count(*) as line_count, cast(min(entry_date) as varchar) as entry_date, "
    f"{D('sum(debit_amount) - sum(credit_amount)')} as difference from {{gl}} group by 1, 2 having abs(sum(debit_amount) - sum(credit_amount)) > 0.01",
)
query(
    "je_a02_voucher_summary",
    lambda t: j.voucher_balance_summary(t.gl),
    """with v as (select engagement_id, entry_no, abs(sum(debit_amount) - sum(credit_amount)) <= 0.01 as ok from {gl} group by 1, 2),
r as (select *, row_number() over (partition by engagement_id order by entry_no) as n from v where ok)
select v.engagement_id, count(*) as vouchers, count(*) filter (where ok) as balanced,
 (select string_agg(entry_no, ',' order by entry_no) from r where r.engagement_id = v.engagement_id and n <= 10) as sample from v group by 1""",
)
A03 = """with g as (select engagement_id, coalesce(nullif(regexp_replace(account_code, '^0+', ''), ''), account_code) as account_code, sum(debit_amount) as gd, sum(credit_amount) as gc, min_by(account_name, l_linenumber) as nm from {gl_named} group by 1, 2),
a as (select engagement_id, account_code, sum(amount) as adj from {equity_adjustments} group by 1, 2),
x as (select t.engagement_id, t.account_code, coalesce(c.account_type = 'P', case when nullif(trim(g.nm), '') is not null then regexp_matches(g.nm, '매출|수익|비용|원가|손실|이익|revenue|expense') end, regexp_matches(t.account_code, '^[4-8]')) as is_pl,
  t.opening + coalesce(a.adj, 0) as op, coalesce(g.gd, 0) as gd, coalesce(g.gc, 0) as gc, t.closing, t.period_debit, t.period_credit
  from {tb} t left join g using (engagement_id, account_code) left join {coa} c using (engagement_id, account_code) left join a using (engagement_id, account_code))
select engagement_id, account_code, is_pl, cast(case when is_pl then 0 else op end as double) as used_opening, cast(case when is_pl then 0 else op end + gd - gc as double) as calculated, cast(closing as double) as closing,
 cast(case when is_pl then 0 else op end + gd - gc - closing as double) as difference, cast(gd - period_debit as double) as dr_diff, cast(gc - period_credit as double) as cr_diff
from x where abs(case when is_pl then 0 else op end + gd - gc - closing) > 0.5"""
query("je_a03_tb_rollforward", lambda t: j.tb_rollforward(t.gl_named, t.tb, t.coa, t.equity_adjustments, row_no="l_linenumber"), A03, staged=("gl", "tb", "coa"))
query(
    "je_a03_scope",
    lambda t: j.tb_rollforward_scope(t.gl_named, t.tb),
    f"""with c as (select engagement_id, {BARE} as account_code from {{gl}} union select engagement_id, account_code from {{tb}}),
g as (select engagement_id, sum(debit_amount) as g from {{gl}} group by 1), t as (select engagement_id, sum(period_debit) as t from {{tb}} group by 1)
select c.engagement_id, count(*) as accounts_checked, any_value(cast(t as double) / cast(g as double)) as ratio, any_value(cast(t as double) / cast(g as double) > 1.5 or cast(t as double) / cast(g as double) < 0.67) as scope_warning
from c join g using (engagement_id) join t using (engagement_id) group by 1""",
    staged=("gl", "tb"),
)
query(
    "je_b_pl_accounts",
    lambda t: j.profit_loss_flag(j.account_sums(t.gl_named, "l_linenumber").select("engagement_id", "account_code", "gl_name"), t.coa),
    """with g as (select engagement_id, coalesce(nullif(regexp_replace(account_code, '^0+', ''), ''), account_code) as account_code, min_by(account_name, l_linenumber) as gl_name from {gl_named} group by 1, 2)
select g.*, coalesce(c.account_type = 'P', case when nullif(trim(gl_name), '') is not null then regexp_matches(gl_name, '매출|수익|비용|원가|손실|이익|revenue|expense') end, regexp_matches(g.account_code, '^[4-8]')) as is_pl
from g left join {coa} c using (engagement_id, account_code)""",
    staged=("gl", "coa"),
)
B01 = f"""with {SALES}
select {LINE}, threshold from (select gl.*, threshold, coalesce(c.account_type = 'P', regexp_matches(gl.account_code, '^[4-8]')) as p from {{gl}} gl join sales using (engagement_id) left join {{coa}} c using (engagement_id, account_code)) x
where p and cast(greatest(debit_amount, credit_amount) as double) > threshold"""
query("je_b01_large_pl", lambda t: j.large_pl(t.gl, t.coa), B01, staged=("gl", "coa"))
query("je_b01_counts", lambda t: j.line_and_voucher_counts(j.large_pl(t.gl, t.coa)), f"with {SALES}\nselect engagement_id, count(*) as lines, count(distinct entry_no) as vouchers from (select gl.*, threshold, coalesce(c.account_type = 'P', regexp_matches(gl.account_code, '^[4-8]')) as p from {{gl}} gl join sales using (engagement_id) left join {{coa}} c using (engagement_id, account_code)) x where p and cast(greatest(debit_amount, credit_amount) as double) > threshold group by 1", staged=("gl", "coa"))
query(
    "je_b02_unmatched",
    lambda t: j.unmatched_accounts(t.gl, t.coa),
    f"""with k as (select engagement_id, account_code as c from {{coa}} union select engagement_id, {BARE} from {{coa}})
select {LINE} from {{gl}} g where engagement_id in (select engagement_id from k) and not exists (select 1 from k where k.engagement_id = g.engagement_id and (k.c = g.account_code or k.c = {BARE.replace('account_code', 'g.account_code')}))""",
    staged=("gl", "coa"),
)
NEW = f"""dated as (select engagement_id, bool_or(created_date is not null) as dated from {{coa}} group by 1),
had as (select engagement_id, account_code as c from {{tb_prior}} union select engagement_id, {BARE} from {{tb_prior}}),
found as (select c.engagement_id, c.account_code, c.created_date from {{coa}} c join {{params}} p using (engagement_id) where c.created_date between p.period_start and p.period_end
 union all select t.engagement_id, t.account_code, p.period_start from {{tb}} t join {{params}} p using (engagement_id) left join dated d using (engagement_id)
 where not coalesce(d.dated, false) and t.engagement_id in (select engagement_id from {{tb_prior}}) and not exists (select 1 from had where had.engagement_id = t.engagement_id and (had.c = t.account_code or had.c = {BARE.replace('account_code', 't.account_code')})))"""
NEW_STAGED = ("gl", "coa", "tb", "tb_prior")
query("je_b03_new_accounts", lambda t: j.new_accounts(t.coa, t.tb, t.tb_prior, t.params), f"with {NEW}\nselect engagement_id, account_code, cast(created_date as varchar) as created_date from found", staged=NEW_STAGED)
NEW_LINES = NEW + f""",
lines as (select g.*, coalesce(f.created_date, f2.created_date) as created_date from {{gl}} g left join found f on g.engagement_id = f.engagement_id and g.account_code = f.account_code
 left join found f2 on g.engagement_id = f2.engagement_id and {BARE.replace('account_code', 'g.account_code')} = f2.account_code where f.account_code is not null or f2.account_code is not null)"""
query("je_b03_new_account_lines", lambda t: j.new_account_lines(t.gl, j.new_accounts(t.coa, t.tb, t.tb_prior, t.params)), f"with {NEW_LINES}\nselect {LINE}, cast(created_date as varchar) as created_date from lines", staged=NEW_STAGED)
query(
    "je_b03_summary",
    lambda t: j.new_account_summary(t.gl, j.new_accounts(t.coa, t.tb, t.tb_prior, t.params)),
    f"with {NEW_LINES}\nselect f.engagement_id, count(*) as accounts, (select count(*) from lines l where l.engagement_id = f.engagement_id) as lines, (select count(distinct entry_no) from lines l where l.engagement_id = f.engagement_id) as vouchers, (select count(distinct account_code) from lines l where l.engagement_id = f.engagement_id) as used_accounts from found f group by 1",
    staged=NEW_STAGED,
)
query("je_b04_seldom_used", lambda t: j.seldom_used(t.gl), f"select {LINE}, usage_count from (select *, count(*) over (partition by engagement_id, account_code) as usage_count from {{gl}}) x where usage_count <= 5", staged=("gl",))
USERS = f"""u as (select g.*, h.user_id is not null as inn, date_diff('day', h.retire_date, coalesce(posting_date, entry_date)) as late, d.description as doc from {{gl}} g left join {{hr}} h using (engagement_id, user_id)
 left join {{doc_types}} d on g.user_id = 'SYSTEM-' || d.entry_type where g.engagement_id in (select engagement_id from {{hr}})),
r as (select *, case when regexp_matches(user_id, '{SYSTEM}') then 'system' when not inn and regexp_matches(user_id, '[A-Z]$') then 'external' when inn then case when late > 0 then 'post_retirement' end
 when regexp_matches(user_id, '^(?:U19)') then 'affiliate' else 'not_registered' end as reason from u)"""
DETAIL = """case when reason = 'system' and starts_with(user_id, 'SYSTEM-') then coalesce(doc, '자동전기 (' || substr(user_id, 8) || ')') when reason = 'system' then user_id when reason = 'external' then right(user_id, 1)
 when reason = 'affiliate' then substr(user_id, 1, 3) end"""
query(
    "je_b05_unusual_users",
    lambda t: j.unusual_users(t.gl, t.hr, t.doc_types, affiliate=("U19",)),
    f"""with {USERS}
select {LINE}, reason, {DETAIL} as detail_type, case when reason = 'post_retirement' then late end as days_after from r where reason is not null""",
    staged=("gl", "hr"),
)
query(
    "je_b05_user_summary",
    lambda t: j.unusual_user_summary(j.unusual_users(t.gl, t.hr, t.doc_types, affiliate=("U19",)), t.hr.select("engagement_id", "user_id", j.F.concat(j.F.lit("name "), j.F.col("user_no").cast("string")).alias("user_name"))),
    f"""with {USERS}, s as (select engagement_id, reason, user_id, count(*) as lines, cast(max(greatest(debit_amount, credit_amount)) as double) as largest, max({DETAIL}) as detail_type from r where reason is not null group by 1, 2, 3),
p as (select *, row_number() over (partition by engagement_id, reason order by lines desc, user_id) as place, greatest(count(*) over (partition by engagement_id, reason) - 100, 0) as omitted from s) select p.*, case when h.user_id is not null then 'name ' || cast(user_no as varchar) end as user_name from p left join {{hr}} h using (engagement_id, user_id) where place <= 100""",
    staged=("gl", "hr"),
)
query("je_b06_self_approved", lambda t: j.self_approved(t.gl_named), f"select {LINE} from {{gl_named}} where user_id = approver_id")
query("je_b07_back_dated", lambda t: j.back_dated(t.gl), f"select {LINE}, date_diff('day', entry_date, posting_date) as delay, case when date_diff('day', entry_date, posting_date) > 30 then 'late' else 'reversed' end as class from {{gl}} where date_diff('day', entry_date, posting_date) > 30 or date_diff('day', entry_date, posting_date) < 0")
query(
    "je_b07_summary",
    lambda t: j.back_dated_summary(t.gl),
    """with d as (select *, date_diff('day', entry_date, posting_date) as delay from {gl}) select engagement_id, count(*) filter (where delay > 30) as late_lines, count(distinct entry_no) filter (where delay > 30) as late_vouchers,
 count(*) filter (where delay < 0) as reversed_lines, count(distinct entry_no) filter (where delay < 0) as reversed_vouchers, count(*) filter (where posting_date is null) as skipped_no_date from d group by 1""",
)
NAMES = "left join {doc_types} d using (entry_type) left join {coa} a using (engagement_id, account_code)"
query("je_b08_doc_type_accounts", lambda t: j.doc_type_accounts(t.gl, doc_types=t.doc_types, accounts=t.coa), f"with {SALES}, b8 as (select engagement_id, entry_type, account_code, case when debit_amount > 0 then 'D' else 'C' end as side, {D('sum(debit_amount)')} as debit, {D('sum(credit_amount)')} as credit, count(*) as lines from {{gl}} join sales using (engagement_id) where cast(greatest(debit_amount, credit_amount) as double) > threshold group by 1, 2, 3, 4)\nselect b8.*, d.description as entry_type_name, a.account_name from b8 {NAMES}", staged=("gl", "coa"))
query("je_b08_rare_combinations", lambda t: j.rare_doc_type_accounts(t.gl, doc_types=t.doc_types, accounts=t.coa), f"with b8 as (select engagement_id, entry_type, account_code, count(*) as frequency, {D('sum(debit_amount)')} as debit, {D('sum(credit_amount)')} as credit from {{gl}} group by 1, 2, 3 having count(*) <= 2)\nselect b8.*, d.description as entry_type_name, a.account_name from b8 {NAMES}", staged=("gl", "coa"))
B09 = """cells as (select engagement_id, entry_no, account_code, case when debit_amount > 0 then 'D' else 'C' end as side, sum(debit_amount) as debit, sum(credit_amount) as credit from {gl} group by 1, 2, 3, 4),
ps(scenario) as (values ('^1'), ('^4')), b09 as (
select m.engagement_id, ps.scenario, m.account_code as main_account, m.side as main_side, c.account_code, c.side,
 case when c.account_code = m.account_code then '본계정' when c.side <> m.side then '상대계정' else '참고계정' end as relation, sum(c.debit) as debit, sum(c.credit) as credit, count(*) as vouchers
from cells m join ps on regexp_matches(m.account_code, ps.scenario) join cells c on m.engagement_id = c.engagement_id and m.entry_no = c.entry_no group by all)"""
query("je_b09_counter_accounts", lambda t: j.counter_accounts(t.gl, ("^1", "^4")), f"with {B09}\nselect * replace (cast(debit as double) as debit, cast(credit as double) as credit) from b09")
DEFAULT_B09 = B09.replace("(values ('^1'), ('^4'))", "(values " + ", ".join(f"('{p}')" for p in j.COUNTER_SCENARIOS) + ")")
query("je_b09_default_scenarios", lambda t: j.counter_accounts(t.gl), f"with {DEFAULT_B09}\nselect * replace (cast(debit as double) as debit, cast(credit as double) as credit) from b09")
ISSUE = "case when coalesce(trim(description), '') = '' then 'absent' when trim(description) in ('TBD', '기타', '임시', 'test', '-', '.') then 'vague' when length(trim(description)) < 5 then 'short' end"
query("je_b10_description", lambda t: j.description_quality(t.gl), f"select {LINE}, description, {ISSUE} as issue from {{gl}} where {ISSUE} is not null")
B11 = """b11 as (select g.*, period_end, case when entry_date between period_end - 10 and period_end + 10 then 'proximity' when entry_date <= period_end and posting_date > period_end then 'post_close' end as class from {gl} g join {params} using (engagement_id))"""
query("je_b11_period_end", lambda t: j.period_end(t.gl, t.params), f"with {B11}\nselect {LINE}, class, date_diff('day', entry_date, period_end) as days_to_period_end, coalesce(entry_date <= period_end and posting_date > period_end, false) as post_close_too from b11 where class is not null")
B12 = """b12 as (select g.*, d.description as doc_name, date_diff('day', entry_date, period_end) as days_to_period_end from {gl} g join {params} using (engagement_id) left join {doc_types} d using (entry_type)
 where entry_type in ('SA', 'SU', 'CA', 'C2', 'M3', 'M4', 'M5', 'M6', 'M7', 'M8') and (abs(date_diff('day', entry_date, period_end)) <= 10 or entry_date > period_end))"""
query("je_b12_top_side", lambda t: j.top_side(t.gl, t.params, t.doc_types), f"with {B12}\nselect {LINE}, doc_name, days_to_period_end from b12")
STATS = """stats as (select engagement_id, case when coalesce(upper(trim(entry_type)), '') = '' then '(없음)' else upper(trim(entry_type)) end as entry_type, count(*) as lines, sum(debit_amount) as debit, sum(credit_amount) as credit,
 avg(cast(debit_amount as double)) as average_debit, count(*) filter (where regexp_matches(user_id, '^SYSTEM[-_]')) as system_lines from {gl} group by 1, 2),
classed as (select s.*, case when s.entry_type in ('AF','CO','HR','MD','ML','WA','WE','WL','WI','WN','CH','PR','M9') or coalesce(d.settlement_type = 'SYSTEM', false) then 'auto' else 'manual' end as class,
 round(cast(debit as double) / cast(sum(debit) over (partition by engagement_id) as double) * 100, 2) as share from stats s left join {doc_types} d using (entry_type))"""
query("je_doc_type_stats", lambda t: j.doc_type_stats(t.gl, t.doc_types), f"with {STATS}\nselect * replace (cast(debit as double) as debit, cast(credit as double) as credit) from classed")
query("je_auto_manual_rollup", lambda t: j.auto_manual_rollup(j.doc_type_stats(t.gl, t.doc_types)), f"with {STATS}\nselect engagement_id, class, count(distinct entry_type) as doc_types, cast(sum(lines) as bigint) as lines, cast(sum(debit) as double) as debit from classed group by rollup (engagement_id, class) having engagement_id is not null")
CTX = ("coa", "tb", "tb_prior", "params", "hr", "doc_types", "equity_adjustments")
#: The ledger and what is made of it; the other masters are a few values.
STAGED = ("gl", "coa", "tb", "tb_prior", "hr", "equity_adjustments")


def findings(t):
    return j.run_rules(t.gl_named, {k: getattr(t, k) for k in CTX}, params={"B09": {"scenarios": ("^1", "^4")}}, stage=False)


AMT = "cast(greatest(debit_amount, credit_amount) as decimal(38,2))"
FORM = "engagement_id, '{0}' as rule_code, entry_no, entry_date, account_code, {1} as amount, {2} as reason".format
A03_SELECT = A03[A03.rindex("select engagement_id") :]
FIND = (
    SALES + ",\n" + USERS.replace("{gl}", "{gl_named}") + ",\n" + B09 + ",\n" + B11 + ",\n" + B12 + ",\n" + A03[5 : A03.rindex("select engagement_id")].rstrip().replace("g as (", "ga as (", 1).replace("left join g using", "left join ga g using") + f""",
a03 as ({A03_SELECT}),
pl as (select gl.*, threshold, coalesce(c.account_type = 'P', regexp_matches(gl.account_code, '^[4-8]')) as p from {{gl}} gl join sales using (engagement_id) left join {{coa}} c using (engagement_id, account_code)),
used as (select *, count(*) over (partition by engagement_id, account_code) as n from {{gl}}),
b08 as (select engagement_id, entry_type, account_code, case when debit_amount > 0 then 'D' else 'C' end as side, sum(debit_amount) as debit, sum(credit_amount) as credit from {{gl}} join sales using (engagement_id) where cast(greatest(debit_amount, credit_amount) as double) > threshold group by 1, 2, 3, 4),
f as (
select {FORM('B01', AMT, "'B01'")} from pl where p and cast(greatest(debit_amount, credit_amount) as double) > threshold
union all select {FORM('B04', AMT, "'B04'")} from used where n <= 5
union all select {FORM('B05', AMT, "case when reason = 'affiliate' then 'not_registered' else reason end")} from r where reason is not null
union all select {FORM('B06', AMT, "'B06'")} from {{gl_named}} where user_id = approver_id
union all select {FORM('B07', AMT, "case when date_diff('day', entry_date, posting_date) > 30 then 'late' else 'reversed' end")} from {{gl}} where date_diff('day', entry_date, posting_date) > 30 or date_diff('day', entry_date, posting_date) < 0
union all select engagement_id, 'B08', null, null, account_code, greatest(debit, credit), entry_type from b08
union all select engagement_id, 'B09', null, null, account_code, greatest(debit, credit), scenario from b09 where relation = '상대계정'
union all select {FORM('B10', AMT, ISSUE)} from {{gl}} where {ISSUE} is not null
union all select {FORM('B11', AMT, 'class')} from b11 where class is not null
union all select {FORM('B12', AMT, "'B12'")} from b12
union all select engagement_id, 'A03', null, null, account_code, abs(difference), 'A03' from a03)"""
)
query("je_run_rules", lambda t: findings(t).groupBy("engagement_id", "rule_code").agg(j.F.count("*").alias("findings"), j.F.sum("amount").alias("amount")), f"with {FIND}\nselect engagement_id, rule_code, count(*) as findings, cast(sum(cast(amount as decimal(38,2))) as double) as amount from f group by 1, 2", staged=STAGED)
ORDER = "['B01','B04','B05','B06','B07','B08','B09','B10','B11','B12','A03']"
BY = "entry_date asc nulls first, entry_no asc nulls first, account_code asc nulls first, amount, reason asc nulls first"
query(
    "je_q01_inquiry_list",
    lambda t: j.inquiry_list(findings(t)),
    f"""with {FIND},
c as (select *, row_number() over (partition by engagement_id, rule_code order by {BY}) as seq, count(*) over (partition by engagement_id, rule_code) as section_total from f),
n as (select *, row_number() over (partition by engagement_id order by list_position({ORDER}, rule_code), seq) as q from c where seq <= 100)
select engagement_id, 'Q-' || right('000' || q, greatest(3, length(q::varchar))) as q_no, rule_code, seq, entry_no, account_code, cast(amount as double) as amount, least(section_total, 100) as section_count, section_total, section_total > 100 as is_sampled from n""".replace("right('000' || q, greatest(3, length(q::varchar)))", "lpad(q::varchar, 3, '0')"),
    staged=STAGED,
)
for method in ("random", "systematic", "mus"):
    SAMPLE = {
        "random": f"select engagement_id, rule_code, entry_no, account_code, cast(amount as double) as amount, reason from (select *, row_number() over (partition by engagement_id, rule_code order by md5(concat_ws('|', entry_no, account_code, '0')), {BY.replace('entry_date asc nulls first, ', '')}) as r from b10) where r <= 50",
        "systematic": f"select engagement_id, rule_code, entry_no, account_code, cast(amount as double) as amount, reason from (select *, row_number() over (partition by engagement_id, rule_code order by {BY.replace('entry_date asc nulls first, ', '')}) - 1 as r, greatest(count(*) over (partition by engagement_id, rule_code) // 50, 1) as step from b10) where r % step = 0 and r // step < 50",
        "mus": f"select engagement_id, rule_code, entry_no, account_code, cast(amount as double) as amount, reason from (select *, sum(abs(amount)) over (partition by engagement_id, rule_code order by {BY.replace('entry_date asc nulls first, ', '')} rows between unbounded preceding and current row) as run, cast(sum(abs(amount)) over (partition by engagement_id, rule_code) as double) / 50 as step, count(*) over (partition by engagement_id, rule_code) as n from b10) where n <= 50 or floor(cast(run as double) / step) > floor(cast(run - abs(amount) as double) / step)",
    }[method]
    query(
        f"je_sample_{method}",
        lambda t, m=method: j.sample_findings(j.finding(j.description_quality(t.gl), "B10", reason=j.F.col("issue")), m, 50).drop("entry_date"),
        f"with b10 as (select {FORM('B10', AMT, ISSUE)} from {{gl}} where {ISSUE} is not null)\n{SAMPLE}",
    )
SCENARIOS = """(select e.engagement_id, s.rule_code, s.status from (values (cast(0 as bigint)), (1), (2), (3)) as e(engagement_id) cross join
 (values ('A03', 'run'), ('B01', 'run'), ('B02', 'not_run'), ('B04', 'run'), ('B05', 'run'), ('B06', 'waived'), ('B07', 'run'), ('B10', 'run'), ('B12', 'run')) as s(rule_code, status))"""
query(
    "je_7401_rule_summary",
    lambda t: j.rule_summary(findings(t).where("rule_code != 'B02'"), t.spark.sql(f"select * from {SCENARIOS} x")),
    f"""with {FIND}, n as (select engagement_id, rule_code, count(*) as n from f group by 1, 2), s as (select * from {SCENARIOS} q), m as (select s.*, coalesce(n, 0) as findings from s left join n using (engagement_id, rule_code))
select engagement_id, rule_code, status, findings, case when status = 'waived' then '면제' when status = 'not_run' then '미실행' when findings = 0 then '정상' else '적출 ' || findings || '건' end as label,
 case when findings >= 100 then 'fail' when findings >= 1 then 'warn' else 'pass' end as badge from m""",
    staged=STAGED,
)
