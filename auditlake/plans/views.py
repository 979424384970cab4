"""Views over the star-schema tables that stand for ledgers, replies, prices and curves.

Each text runs in Spark and in the SQL twin alike; {name} refers to a table or another view.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

VIEWS = {
    "gl_base": """
select l_orderkey % 4 as engagement_id, cast(l_orderkey as string) as entry_no,
  cast(l_shipdate as date) as entry_date,
  case when l_partkey % 97 = 0 then null
       else cast(l_shipdate as date) + cast(l_partkey % 60 - 10 as int) end as posting_date,
  case l_suppkey % 10 when 0 then concat('SYSTEM-', l_returnflag)
       when 1 then concat('Z', cast(l_suppkey as string))
       when 2 then concat('7', cast(l_suppkey as string), 'C')
       else concat('U', cast(o_custkey % 200 as string)) end as user_id,
  case when l_linenumber = 7 and l_partkey % 50 = 0 then concat('6', lpad(cast(l_orderkey as string), 7, '0'))
       else concat(cast(1 + l_partkey % 9 as string), lpad(cast(l_partkey % 53 as string), 4, '0')) end as account_code,
  cast(case when l_linenumber % 2 = 1 then l_extendedprice else 0 end as decimal(20,2)) as debit_amount,
  cast(case when l_linenumber % 2 = 0 then l_extendedprice else 0 end as decimal(20,2)) as credit_amount,
  case l_suppkey % 6 when 0 then 'SA' when 1 then 'SU' when 2 then 'CO' when 3 then 'HR' when 4 then 'WE' else 'KR' end as entry_type,
  case l_partkey % 11 when 0 then null when 1 then '  ' when 2 then 'TBD' when 3 then 'ab' else concat('part ', cast(l_partkey as string)) end as description,
  l_linenumber, l_partkey, l_suppkey
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "gl": """
select * from {gl_base} union all
select engagement_id, entry_no, max(entry_date), max(posting_date), 'U1', '10999',
  cast(greatest(sum(credit_amount) - sum(debit_amount), 0) as decimal(20,2)),
  cast(greatest(sum(debit_amount) - sum(credit_amount), 0) as decimal(20,2)),
  'SA', 'closing line', 99, 0, 0
from {gl_base} where cast(entry_no as int) % 3 <> 0 group by engagement_id, entry_no""",
    "gl_named": """
select *, case cast(account_code as bigint) % 7 when 0 then 'sales revenue' when 1 then 'cash' else null end as account_name,
  case when l_suppkey % 3 = 0 then user_id when l_suppkey % 3 = 1 then 'U3' else null end as approver_id from {gl}""",
    "params": """
select cast(engagement_id as bigint) as engagement_id, date '1998-01-01' as period_start, date '1998-12-31' as period_end,
  cast(5000000 as double) as pm, risk, reliance
from (values (0, '낮음', 'Y'), (1, '보통', 'N'), (2, '높음', 'Y'), (3, '유의적위험', 'N')) as t(engagement_id, risk, reliance)""",
    "codes": "select distinct engagement_id, account_code from {gl}",
    "coa": """
select engagement_id, account_code, concat('account ', account_code) as account_name,
  case when substring(account_code, 1, 1) in ('4', '5', '6', '7', '8') then 'P' else 'B' end as account_type,
  case when engagement_id = 3 then null else date '1998-01-01' + cast(cast(account_code as bigint) % 700 - 350 as int) end as created_date
from {codes} where cast(account_code as bigint) % 53 <> 7""",
    "tb": """
select engagement_id, account_code, cast(cast(account_code as bigint) % 1000 as decimal(20,2)) as opening,
  sum(debit_amount) as period_debit, sum(credit_amount) as period_credit,
  cast(cast(account_code as bigint) % 1000 + sum(debit_amount) - sum(credit_amount)
    + case when cast(account_code as bigint) % 5 = 0 then 1 else 0 end as decimal(20,2)) as closing
from {gl} group by engagement_id, account_code""",
    "tb_prior": "select * from {tb} where cast(account_code as bigint) % 17 <> 0",
    "equity_adjustments": "select engagement_id, account_code, cast(250 as decimal(20,2)) as amount from {tb} where cast(account_code as bigint) % 10 = 3",
    "users": "select distinct engagement_id, user_id from {gl} where user_id like 'U%'",
    "hr": """
select engagement_id, user_id, cast(substring(user_id, 2, 9) as int) as user_no,
  case when cast(substring(user_id, 2, 9) as int) % 5 = 0 then date '1998-01-01' + cast(substring(user_id, 2, 9) as int) else null end as retire_date
from {users} where cast(substring(user_id, 2, 9) as int) < 180""",
    "doc_types": """
select * from (values ('SA', 'general posting', 'MANUAL'), ('SU', 'adjustment', 'MANUAL'), ('CO', 'controlling', 'SYSTEM'),
  ('HR', 'payroll', 'MANUAL'), ('WE', 'goods receipt', 'MANUAL'), ('KR', 'vendor invoice', 'MANUAL')) as t(entry_type, description, settlement_type)""",
    "gl_raw": """
select engagement_id, entry_no, case when l_partkey % 101 = 0 then 'n/a' else cast(entry_date as string) end as entry_date,
  cast(posting_date as string) as posting_date, case when l_partkey % 89 = 0 then null else user_id end as user_id,
  case when l_partkey % 107 = 0 then '' else account_code end as account_code,
  case when l_partkey % 103 = 0 then '12x' else cast(debit_amount as string) end as debit_amount,
  cast(credit_amount as string) as credit_amount, entry_type, description from {gl_base}""",
    # confirmation sampling
    "ledger": """
select c_custkey % 4 as engagement_id, 'receivable' as kind, c_name as party,
  case o_orderpriority when '1-URGENT' then '외상매출금' when '2-HIGH' then 'Notes Receivable' when '3-MEDIUM' then ' other receivables '
    when '4-NOT SPECIFIED' then 'Prepayments' else 'Sundry' end as account_name,
  cast(o_totalprice as decimal(20,2)) as ending
from {orders} join {customer} on o_custkey = c_custkey
union all
select s_suppkey % 4, 'payable', case when s_suppkey % 9 = 0 then concat('Customer#', lpad(cast(s_suppkey as string), 9, '0')) else s_name end,
  case l_returnflag when 'A' then 'Trade Payables' when 'N' then 'Accrued Expenses' else 'Customer Advances' end,
  cast(-l_extendedprice as decimal(20,2))
from {lineitem} join {supplier} on l_suppkey = s_suppkey""",
    "account_groups": """
select * from (values ('외상매출금', '외상매출금'), ('notes receivable', '받을어음'), ('other receivables', '미수금'), ('prepayments', '선급금'),
  ('trade payables', '외상매입금'), ('accrued expenses', '미지급금'), ('customer advances', '선수금')) as t(alias, account_group)""",
    "fs": """
select engagement_id, kind, account_group, cast(amount + case when account_group = '받을어음' then 100 else 0 end as decimal(20,2)) as amount
from (select engagement_id, kind, coalesce(g.account_group, trim(account_name)) as account_group, sum(abs(ending)) as amount
      from {ledger} left join {account_groups} g on lower(trim(account_name)) = g.alias group by 1, 2, 3) x
union all select cast(0 as bigint), 'receivable', 'loans', cast(500 as decimal(20,2))""",
    "related": "select c_custkey % 4 as engagement_id, concat('㈜', c_name) as name from {customer} where c_custkey % 50 = 0",
    "excluded": "select c_custkey % 4 as engagement_id, 'receivable' as kind, c_name as party, 'dormant' as reason from {customer} where c_custkey % 70 = 0",
    "guide": """
select c_custkey % 4 as engagement_id, c_name as party, account_group, currency,
  cast(case when currency = 'KRW' then amount * (1200 + c_custkey % 200) when c_custkey % 31 = 0 then amount * 100000 else amount end as double) as amount, pos
from (select c_custkey, c_name, cast(floor(abs(c_acctbal)) + 1 as bigint) as amount from {customer}) c
  cross join (values ('외상매출금', 'KRW', 1), ('외상매출금', 'USD', 2), ('미수금', 'KRW', 3), ('미수금', 'EUR', 4)) as t(account_group, currency, pos)
where c_custkey % 2 = 0 or currency in ('KRW', 'USD')""",
    "replies": """
select c_custkey as reply_id, c_custkey % 4 as engagement_id, 'receivable' as kind, c_name as party,
  cast(floor(abs(c_acctbal)) + 1 as double) as ledger_amount,
  case when c_custkey % 13 = 0 then null else cast(floor(abs(c_acctbal)) + 1 as double) * cast(case c_custkey % 4 when 0 then 1.0 when 1 then 0.995 when 2 then 0.98 else 0.5 end as double) end as reply_amount,
  case c_custkey % 3 when 0 then null when 1 then true else false end as declared_match,
  case when c_custkey % 5 = 0 then 'USD' else 'KRW' end as currency
from {customer} where c_custkey % 6 <> 0""",
    "evidence": """
select o_custkey % 4 as engagement_id, c_name as party, case o_orderstatus when 'F' then 'KRW' when 'O' then 'USD' else null end as currency,
  cast(o_totalprice as decimal(20,2)) as amount, o_orderkey % 17 <> 0 as success, (o_orderkey % 10) / 10.0 as confidence
from {orders} join {customer} on o_custkey = c_custkey""",
    "contacts": """
select c_custkey % 4 as engagement_id, c_name as party, case when c_custkey % 4 = 1 then null else concat('c', cast(c_custkey as string), '@example.com') end as email,
  case when c_custkey % 3 = 0 then concat('02-', cast(c_custkey as string)) else null end as phone from {customer}""",
    "account_rows": """
select c_custkey as reply_id, account_group, case when pos = 3 and c_custkey % 11 = 0 then 'EUR' else currency end as row_currency,
  cast(case when c_custkey % 17 = 0 then null else amount * case c_custkey % 4 when 0 then 1.0 when 1 then 1.0 when 2 then 0.999 else 0.7 end end as double) as row_amount, pos
from {guide} join {customer} on party = c_name where pos in (1, 3) and c_custkey % 7 < 4""",
    "parsed": """
select c_custkey as reply_id, c_custkey % 4 as engagement_id, case when c_custkey % 19 = 0 then null else c_name end as party, 'receivable' as asked_kind,
  cast(case when c_custkey % 2 = 0 then abs(c_acctbal) else null end as double) as receivable_total, cast(case when c_custkey % 5 = 0 then abs(c_acctbal) / 2 else null end as double) as payable_total,
  cast(abs(c_acctbal) * 0.995 as double) as balance
from {customer} where c_custkey % 6 <> 0""",
    "sampled": """
select c_custkey % 4 as engagement_id, c_name as party, case c_custkey % 3 when 0 then 'both' when 1 then 'receivable' else 'payable' end as kind,
  cast(abs(c_acctbal) as double) as receivable_ledger, cast(abs(c_acctbal) / 2 as double) as payable_ledger from {customer}""",
    "explanations": """
select o_custkey % 4 as engagement_id, c_name as party, o_orderkey as row_no, cast(o_totalprice as decimal(20,2)) as sent, cast(o_totalprice as decimal(20,2)) - cast(o_orderkey % 3 as decimal(20,2)) as reply,
  case o_orderkey % 4 when 0 then 'timing' when 1 then 'in transit' when 2 then '' else null end as reason, o_orderstatus as account_type, case when o_orderkey % 2 = 0 then 'KRW' else 'USD' end as currency
from {orders} join {customer} on o_custkey = c_custkey where o_orderkey % 5 = 0""",
    # market data
    "prices": """
select concat('T', cast(user_id as string)) as ticker, cast(ts as date) as date, max_by(value, event_id) as close, count(*) as volume
from {events} group by 1, 2""",
    "market": "select date, avg(close) as close from {prices} group by date",
    "statements": """
select concat('S', cast(s_suppkey as string)) as ticker, date '1998-03-31' + cast(q * 91 as int) as period_end, case when q % 4 = 3 then 'annual' else 'quarter' end as period_type,
  case when (s_suppkey + q) % 5 = 0 then null else a * (1 + q) end as total_debt, case when (s_suppkey + q) % 3 = 0 then null else a * 2 + q end as equity_a, a + q as equity_b,
  a / 2 as cash, case when (s_suppkey + q) % 4 = 0 then null else cast(floor(s_acctbal) as double) / 4 + q end as ebitda, cast(floor(s_acctbal) as double) / 5 as operating_income, a / 50 as da
from (select *, cast(floor(abs(s_acctbal)) as double) as a from {supplier}) s cross join (values (0), (1), (2), (3), (4), (5), (6), (7)) as t(q)""",
    "quotes": """
select n_nationkey as curve_id, t, 2.0 + n_regionkey + ln(1 + t) as y
from {nation} cross join (values (cast(0.25 as double)), (cast(0.5 as double)), (cast(1 as double)), (cast(2 as double)), (cast(3 as double)), (cast(5 as double)), (cast(7 as double)), (cast(10 as double))) as q(t)""",
    "deals": """
select p_partkey as deal_id, p_partkey % 25 as curve_id, cast(1000 * p_size as double) as face, (p_partkey % 8) / 100.0 as coupon, 1 + p_partkey % 5 as years,
  case p_partkey % 3 when 0 then 12 when 1 then 6 else 3 end as coupon_months, (1 + p_partkey % 3) / 100.0 as put_irr, cast(1 + p_partkey % 3 as int) as put_from,
  cast(p_retailprice as double) as spot, cast(p_retailprice * 0.9 as double) as conversion_price, 0.2 + (p_partkey % 40) / 100.0 as volatility,
  date '1998-01-01' + cast(p_partkey % 365 as int) as issue_date
from {part}""",
    "companies": """
select c_custkey as company_id, 0.08 + (c_custkey % 10) / 100.0 as wacc, (c_custkey % 4) / 100.0 as growth, cast(abs(c_acctbal) as double) as net_debt,
  cast(1000 + c_custkey % 50 as double) as shares, 6.0 + c_custkey % 5 as multiple from {customer}""",
    "company_years": """
select c_custkey as company_id, yr, a * (1 + cast(0.05 as double) * yr) * 10 as revenue, a * (1 + cast(0.05 as double) * yr) as ebit, a / 10 as da, a / 8 as capex, a / 50 as dnwc, cast(0.22 as double) as tax
from (select c_custkey, cast(floor(abs(c_acctbal)) as double) as a from {customer}) c cross join (values (1), (2), (3), (4), (5)) as t(yr)""",
    "shares": """
select deal_id, curve_id, face, cast(coupon as double) as coupon, cast(coupon_months as double) / 12 as interval_years, cast(years as double) as total, cast(deal_id % 11 as double) / 10 as elapsed, cast(deal_id % 3 as double) as first_pay,
  deal_id % 4 <> 0 as cumulative, cast(years * 12 as int) as steps, cast(1 as double) / 12 as dt, cast(put_irr as double) as put_irr, put_from * 12 as put_step from {deals}""",
    "holdings": """
select p.ticker as deal_id, p.date, p.close as price, cast(60 as double) as conversion_price, cast(10000 as double) as face from {prices} p""",
}
_NAME = re.compile(r"\{([a-z]\w*)\}")


def view(spark: SparkSession, sf_dir: str, name: str, get: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """A driver table, or a view over them; get: gives the views that it refers to."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{n: get(n) if get else view(spark, sf_dir, n) for n in set(_NAME.findall(text))})


def twin(sql: str) -> str:
    """SQL with {view} references as one statement with the views before it."""
    order: list[str] = []

    def add(text: str) -> None:
        for n in _NAME.findall(text):
            if n not in TABLES and n not in order:
                add(VIEWS[n])
                order.append(n)

    add(sql)
    plain = lambda text: _NAME.sub(r"\1", text)
    views = ",\n".join(f"{n} as ({plain(VIEWS[n])})" for n in order)
    body = plain(sql).strip()
    if not order:
        return body
    for start in ("with recursive ", "with "):
        if body.startswith(start):
            return f"{start}{views},\n{body[len(start):]}"
    return f"with {views}\n{body}"
