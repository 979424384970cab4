"""Queries of confirmation sampling, currency, reconciliation and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import coverage as c
from auditlake.operators import fx
from auditlake.operators import sampling as s
from auditlake.queries.common import query

GROUPED = """grouped as (select engagement_id, kind, party, coalesce(g.account_group, trim(account_name)) as account_group, sum(abs(ending)) as amount
 from {ledger} left join {account_groups} g on lower(trim(account_name)) = g.alias where trim(party) <> '' group by 1, 2, 3, 4)"""
query("conf_account_groups", lambda t: s.map_account_groups(t.ledger, t.account_groups).groupBy("engagement_id", "kind", "account_group").agg(F.count("*").alias("lines"), F.sum("ending").alias("ending")),
      "select engagement_id, kind, coalesce(g.account_group, trim(account_name)) as account_group, count(*) as lines, cast(sum(ending) as double) as ending from {ledger} left join {account_groups} g on lower(trim(account_name)) = g.alias group by 1, 2, 3")
query("conf_party_groups", lambda t: s.party_groups(t.ledger, t.account_groups), f"with {GROUPED}\nselect * replace (cast(amount as double) as amount) from grouped")


def parties(t):
    return s.aggregate_by_party(t.ledger, t.account_groups)


query("conf_party_balances", lambda t: parties(t).select("engagement_id", "kind", "party", "balance", F.array_join(F.transform(F.map_entries("by_account"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("by_account")),
      f"with {GROUPED}\nselect engagement_id, kind, party, cast(sum(amount) as double) as balance, string_agg(account_group || '=' || cast(amount as varchar), ';' order by account_group) as by_account from grouped group by 1, 2, 3")
query("conf_completeness", lambda t: s.check_completeness(t.ledger, t.account_groups, t.fs), f"""with {GROUPED}, own as (select engagement_id, kind, account_group, sum(amount) as l from grouped group by 1, 2, 3),
b as (select engagement_id, kind, account_group, coalesce(l, 0) as l, coalesce(amount, 0) as f, case when l is null then 'ledger missing' when amount is null then 'statement missing' end as note from own full join {{fs}} using (engagement_id, kind, account_group))
select engagement_id, kind, account_group, cast(sum(l) as double) as ledger_amount, cast(sum(f) as double) as fs_amount, case when account_group is not null then max(note) end as note, cast(sum(l) - sum(f) as double) as difference
from b group by grouping sets ((engagement_id, kind, account_group), (engagement_id, kind))""")  # fmt: skip
BARE = "upper(regexp_replace({0}, '㈜|\\(주\\)|주식회사|[ ,.]', '', 'g'))".format
CLASSIFIED = GROUPED + f""",
bal as (select engagement_id, kind, party, sum(amount) as balance from grouped group by 1, 2, 3),
x as (select distinct engagement_id, kind, party, reason as exclusion_reason from {{excluded}}),
bp as (select engagement_id, kind, party, coalesce(balance, 0) as balance, exclusion_reason from bal full join x using (engagement_id, kind, party)),
rel as (select distinct b.engagement_id, b.party from bp b join {{related}} r on b.engagement_id = r.engagement_id and {BARE('r.name')} <> '' and {BARE('b.party')} <> ''
 and (contains({BARE('b.party')}, {BARE('r.name')}) or contains({BARE('r.name')}, {BARE('b.party')}))),
lim(risk, reliance, kr, cf) as (values ('낮음','Y',0.875::double,0.7::double), ('낮음','N',0.375,1.6), ('보통','Y',0.75,1.2), ('보통','N',0.30,2.3), ('높음','Y',0.625,1.9), ('높음','N',0.175,2.6), ('유의적위험','Y',0.75,1.4), ('유의적위험','N',0.15,3.0)),
pr as (select p.*, kr, cf from {{params}} p join lim using (risk, reliance)),
cls as (select b.engagement_id, b.kind, b.party, b.balance, b.exclusion_reason, rel.party is not null as is_related, exclusion_reason is not null as is_excluded, exclusion_reason is null and balance > 0 as is_active,
 exclusion_reason is null and balance > 0 and cast(balance as double) >= pm * kr as is_key from bp b left join rel on rel.engagement_id = b.engagement_id and rel.party = b.party join pr on pr.engagement_id = b.engagement_id)"""
SIZES = CLASSIFIED + """,
sz0 as (select engagement_id, kind, cast(sum(balance) as double) as population, coalesce(cast(sum(balance) filter (where is_key) as double), 0.0) as key_amount from cls where is_active group by 1, 2),
sz1 as (select sz0.*, pm * kr as threshold, kr as key_ratio, cf as confidence_factor, greatest(population - key_amount, 0.0) as remaining, greatest(population - key_amount, 0.0) / pm as base_size from sz0 join pr using (engagement_id)),
sz2 as (select *, cast(case when base_size > 0 then ceil(base_size * confidence_factor) else 0 end as bigint) as final_size from sz1),
sz as (select *, case when final_size > 0 then remaining / final_size else 0.0 end as interval from sz2)"""
MUS = SIZES + """,
pool as (select c.engagement_id, c.kind, c.party, c.balance, z.interval, z.interval * (('0x' || substr(md5(concat_ws('|', c.engagement_id::varchar, c.kind, '0')), 1, 8))::bigint::double / 4294967296.0::double) as r0 from cls c join sz z using (engagement_id, kind) where is_active and not is_key and z.interval > 0),
cum as (select *, sum(balance) over (partition by engagement_id, kind order by party rows between unbounded preceding and current row) as cumulative from pool),
nn as (select *, max(greatest(floor((cast(cumulative as double) - r0) / interval)::bigint + 1, 0)) over (partition by engagement_id, kind order by party rows between unbounded preceding and current row) as n from cum),
mus as (select *, n - coalesce(lag(n) over (partition by engagement_id, kind order by party), 0) as selections from nn)"""
FINAL = MUS + """,
fin as (select c.*, coalesce(m.selections, 0) as selections, coalesce(m.selections, 0) > 0 as is_representative, is_key or coalesce(m.selections, 0) > 0 or (is_related and not is_excluded) as is_final
 from cls c left join mus m using (engagement_id, kind, party))"""


def classified(t):
    return s.classify_parties(parties(t).drop("by_account"), t.related, t.excluded, t.params)


def decisions(t):
    return s.final_selection(classified(t), t.params)


COLS = "engagement_id, kind, party, cast(balance as double) as balance, exclusion_reason, is_related, is_excluded, is_active, is_key"
query("conf_related_parties", lambda t: s.related_parties(parties(t), t.related), f"with {CLASSIFIED.replace('bp as', 'bp as', 1)}\nselect * from rel where exists (select 1 from bal where bal.engagement_id = rel.engagement_id and bal.party = rel.party)")
query("conf_classify_parties", classified, f"with {CLASSIFIED}\nselect {COLS} from cls")
query("conf_sample_size", lambda t: s.sample_size(classified(t), t.params), f"with {SIZES}\nselect engagement_id, kind, population, key_amount, threshold, key_ratio, confidence_factor, remaining, base_size, final_size, interval from sz")


def mus(t, parts=None):
    k = classified(t)
    return s.run_mus(k.where("is_active and not is_key").select("engagement_id", "kind", "party", "balance"), s.sample_size(k, t.params), parts=parts)


MUS_SELECT = f"with {MUS}\nselect engagement_id, kind, party, cast(balance as double) as balance, cast(cumulative as double) as cumulative, selections, cast(cumulative as double) - r0 - interval * n as remainder_after, selections > 0 as hit from mus"
query("conf_mus", mus, MUS_SELECT)
query("conf_mus_two_level", lambda t: mus(t, 16), MUS_SELECT)
query("conf_final_selection", decisions, f"with {FINAL}\nselect {COLS}, selections, is_representative, is_final from fin")
query("conf_summary_distribution", lambda t: s.summary_distribution(decisions(t)), f"""with {FINAL}
select engagement_id, kind, count(*) filter (where not is_excluded) as included, count(*) filter (where is_key) as key_items, count(*) filter (where is_representative and not is_key) as representative, count(*) filter (where is_related) as related,
 count(*) filter (where is_excluded) as excluded, count(*) filter (where is_final) as final, cast(sum(balance) filter (where not is_excluded) as double) as population from fin group by rollup (engagement_id, kind) having engagement_id is not null""")  # fmt: skip
MERGED = FINAL + """,
mk as (select engagement_id, party, coalesce(r.balance, 0) as receivable, coalesce(p.balance, 0) as payable, coalesce(r.balance, 0) + coalesce(p.balance, 0) as total,
 (coalesce(r.is_excluded, false) and coalesce(p.balance, 0) = 0) or (coalesce(p.is_excluded, false) and coalesce(r.balance, 0) = 0) as is_excluded,
 coalesce(r.is_key, false) or coalesce(p.is_key, false) as is_key, coalesce(r.is_representative, false) or coalesce(p.is_representative, false) as is_representative,
 coalesce(r.is_related, false) or coalesce(p.is_related, false) as is_related, coalesce(r.is_final, false) or coalesce(p.is_final, false) as is_final
 from (select * from fin where kind = 'receivable') r full join (select * from fin where kind = 'payable') p using (engagement_id, party))"""
query("conf_merge_kinds", lambda t: s.merge_kinds(decisions(t)), f"with {MERGED}\nselect * replace (cast(receivable as double) as receivable, cast(payable as double) as payable, cast(total as double) as total), row_number() over (partition by engagement_id order by is_final desc, is_excluded, total desc, party) as place from mk")
GROUPS = ["외상매출금", "받을어음", "미수금", "선급금", "외상매입금", "미지급금", "선수금"]
query("conf_key_item_matrix", lambda t: s.key_item_matrix(t.ledger, t.account_groups, decisions(t), GROUPS),
      f"with {MERGED}, gm as (select engagement_id, party, " + ", ".join(f"cast(coalesce(sum(amount) filter (where account_group = '{g}'), 0) as double) as \"{g}\"" for g in GROUPS) + ", cast(coalesce(sum(amount) filter (where account_group in (" + ", ".join(f"'{g}'" for g in GROUPS) + ")), 0) as double) as total from grouped g where (engagement_id, party) in (select engagement_id, party from fin where is_final) group by 1, 2)\nselect gm.*, is_key, is_representative, is_related, is_final from gm join mk using (engagement_id, party)")
query("conf_send_list", lambda t: s.send_list(decisions(t), t.contacts), f"""with {FINAL},
sl as (select f.engagement_id, kind, row_number() over (partition by f.engagement_id, kind order by balance desc, f.party) as no, f.party, balance, email, phone, case when coalesce(trim(email), '') <> '' or coalesce(trim(phone), '') <> '' then '완료' else '미완료' end as contact
 from fin f left join {{contacts}} c on f.engagement_id = c.engagement_id and f.party = c.party where is_final)
select * replace (cast(balance as double) as balance) from sl union all select engagement_id, kind, 0, '합계', cast(sum(balance) as double), null, null, null from sl group by 1, 2""")  # fmt: skip

# currency and reconciliation
RATES = """gu as (select * replace (upper(currency) as currency) from {guide}),
rng(currency, lo, hi) as (values ('USD', 800, 1800), ('EUR', 900, 2000)),
pairs as (select f.engagement_id, f.currency, k.amount / f.amount as rate from gu f join gu k using (engagement_id, party, account_group) left join rng on rng.currency = f.currency
 where f.currency <> 'KRW' and k.currency = 'KRW' and f.amount > 0 and k.amount > 0 and (lo is null or k.amount / f.amount between lo and hi)),
rates as (select engagement_id, currency, list_sort(list(rate))[count(*) // 2 + 1] as rate, 'implicit' as rate_source from pairs group by 1, 2),
orig as (select engagement_id, party, coalesce(sum(amount) filter (where currency <> 'KRW'), sum(amount)) as original_amount, coalesce(min_by(currency, pos) filter (where currency <> 'KRW'), 'KRW') as original_currency from gu group by 1, 2)"""
query("fx_implicit_rates", lambda t: fx.implicit_rates(t.guide), f"with {RATES}\nselect * from rates")
query("fx_manual_rates", lambda t: fx.all_rates(t.guide, t.spark.sql("select cast(1 as bigint) as engagement_id, 'usd' as currency, cast(1350 as double) as rate")), f"with {RATES}\nselect * from rates where not (engagement_id = 1 and currency = 'USD') union all select 1, 'USD', 1350, 'manual'")
query("fx_dominant_currency", lambda t: fx.dominant_currency(t.guide), f"with {RATES}\nselect engagement_id, party, arg_max(currency, (amount, -pos)) as currency from gu where currency <> 'KRW' group by 1, 2".replace("arg_max(currency, (amount, -pos))", "list_sort(list({'a': amount, 'p': -pos, 'c': currency}), 'DESC')[1].c"))
query("fx_original_amount", lambda t: fx.party_original_amount(t.guide), f"with {RATES}\nselect * from orig")
query("fx_to_krw", lambda t: fx.to_krw(t.guide, fx.all_rates(t.guide), "amount", "currency", "krw"), f"with {RATES}\nselect g.*, case when g.currency = 'KRW' then amount else amount * rate end as krw from gu g left join rates r on g.engagement_id = r.engagement_id and g.currency = r.currency")
query("fx_from_krw", lambda t: fx.from_krw(t.replies.select("engagement_id", "party", "reply_id", "ledger_amount"), fx.all_rates(t.guide), fx.party_original_amount(t.guide), "ledger_amount"),
      f"with {RATES}\nselect p.engagement_id, p.party, reply_id, ledger_amount, original_currency, case when original_currency = 'KRW' then ledger_amount else ledger_amount / rate end as in_original from {{replies}} p left join orig o using (engagement_id, party) left join rates r on r.engagement_id = p.engagement_id and r.currency = original_currency")
REPLY = "rp as (select * replace (cast(reply_amount as double) as reply_amount) from {replies})"
query("fx_compare_amounts", lambda t: fx.compare_amounts(replies(t), fx.all_rates(t.guide), fx.party_original_amount(t.guide)), f"""with {RATES}, {REPLY},
x as (select p.*, case when p.currency = 'KRW' then reply_amount else reply_amount * rate end as reply_krw, rate, r.rate_source as rs, original_amount, original_currency from rp p left join rates r on r.engagement_id = p.engagement_id and r.currency = p.currency left join orig o on o.engagement_id = p.engagement_id and o.party = p.party)
select reply_id, engagement_id, party, ledger_amount, reply_amount, currency, reply_krw, ledger_amount - reply_krw as diff_krw,
 case when currency = 'KRW' or rate is not null then case when ledger_amount <> 0 then (ledger_amount - reply_krw) / ledger_amount end when original_currency = currency then case when original_amount <> 0 then (original_amount - reply_amount) / original_amount end end as diff_pct,
 case when currency = 'KRW' then 1.0 else rate end as rate_used, case when currency <> 'KRW' then rs end as rate_source, coalesce(currency = 'KRW' or rate is not null or original_currency = currency, false) as comparison_possible from x""")  # fmt: skip


def replies(t):
    return t.replies.withColumn("reply_amount", F.col("reply_amount").cast("double"))


query("recon_v1", lambda t: fx.reconcile(replies(t), 10.0), f"with {REPLY}\nselect reply_id, engagement_id, party, kind, ledger_amount - reply_amount as difference, case when ledger_amount <> 0 then (ledger_amount - reply_amount) / ledger_amount end as difference_pct, case when reply_amount is null then 'extraction_failed' when abs(ledger_amount - reply_amount) <= 10 then 'matched' else 'mismatch' end as status from rp")
V2 = RATES + ", " + REPLY + """,
fg as (select engagement_id, party, account_group, min_by(amount, pos) as ga, min_by(currency, pos) as gc from gu group by 1, 2, 3),
bs as (select *, case when ledger_amount > 0 then greatest(5.0, abs(ledger_amount) * 0.01) else 5.0 end as tol from rp),
ar as (select a.reply_id, tol, row_amount, upper(row_currency) as rc, ga, gc, case when upper(row_currency) = 'KRW' then row_amount else row_amount * r1.rate end as rk, case when gc = 'KRW' then ga else ga * r2.rate end as gk
 from {account_rows} a join bs using (reply_id) left join fg on fg.engagement_id = bs.engagement_id and fg.party = bs.party and fg.account_group = a.account_group
 left join rates r1 on r1.engagement_id = bs.engagement_id and r1.currency = upper(row_currency) left join rates r2 on r2.engagement_id = bs.engagement_id and r2.currency = gc),
ad as (select *, case when gc = rc then ga - row_amount when rc <> 'KRW' then gk - rk end as d from ar),
pa as (select reply_id, count(*) as n_all, count(row_amount) as n_rows, bool_or(abs(d) > tol) as is_off, bool_or(abs(d) <= tol) as is_on from ad group by 1),
jj as (select b.*, n_all, coalesce(n_rows, 0) as n_rows, is_off, r.rate as rate, is_on, coalesce(case when b.currency = 'KRW' then reply_amount else reply_amount * rate end, reply_amount) as cmp, original_amount, original_currency from bs b left join pa using (reply_id)
 left join rates r on r.engagement_id = b.engagement_id and r.currency = b.currency left join orig o on o.engagement_id = b.engagement_id and o.party = b.party),
kk as (select *, case when currency <> 'KRW' and original_currency = currency then original_amount - reply_amount else ledger_amount - cmp end as td,
 case when reply_amount is null and n_all is null then 'fallback' when declared_match is not null then 'declared' when n_rows > 0 then 'per_account' when reply_amount is null then 'fallback' else 'total' end as decision_basis,
 currency <> 'KRW' and coalesce(original_currency = currency, false) as own from jj),
v2 as (select *, case decision_basis when 'fallback' then 'extraction_failed' when 'declared' then case when declared_match then case when coalesce(ledger_amount <> 0 and abs((ledger_amount - cmp) / ledger_amount) > 0.05, false) then 'needs_review' else 'matched' end else 'mismatch' end
 when 'per_account' then case when is_off then 'mismatch' when is_on then 'matched' else 'needs_review' end else case when abs(td) <= tol then 'matched' else 'mismatch' end end as status from kk),
st as (select reply_id, engagement_id, party, 'receivable' as kind, status, decision_basis, case when decision_basis = 'total' then td when decision_basis = 'declared' and status = 'matched' then 0.0 end as difference, 
 case when decision_basis = 'total' then case when own then case when original_amount <> 0 then td / original_amount end when ledger_amount <> 0 then td / ledger_amount end when decision_basis = 'declared' and status = 'matched' then 0.0 end as difference_pct,
 case when decision_basis = 'total' and (own or (currency <> 'KRW' and rate is null)) then currency else 'KRW' end as difference_currency, tol as tolerance, n_rows as account_rows from v2)"""


def recon(t):
    return fx.reconcile_v2(replies(t), t.account_rows, t.guide, fx.all_rates(t.guide), 5.0, 0.01)


def statuses(t):
    return recon(t).withColumn("kind", F.lit("receivable"))


query("recon_v2", lambda t: recon(t).drop("findings", "notes"), f"with {V2}\nselect * exclude (kind) from st")
BK = """bk0 as (select p.*, coalesce(s.kind, asked_kind) as k, receivable_ledger, payable_ledger from {parsed} p left join {sampled} s on p.engagement_id = s.engagement_id and p.party = s.party),
bk1 as (select *, unnest(case when party is null then [asked_kind] else list_filter([case when k in ('receivable', 'both') or receivable_total is not null then 'receivable' end, case when k in ('payable', 'both') or payable_total is not null then 'payable' end], lambda x : x is not null) end) as kind from bk0),
bk2 as (select reply_id, engagement_id, party, kind, coalesce(case when kind = 'receivable' then receivable_total else payable_total end, balance) as amount, case when kind = 'receivable' then receivable_ledger else payable_ledger end as ledger from bk1)""".replace("list_filter([", "[z for z in [").replace("], lambda x : x is not null)", "] if z is not null]")
query("recon_reply_by_kind", lambda t: fx.reply_by_kind(t.parsed, t.sampled, 1.0), f"with {BK}\nselect *, ledger - amount as difference, case when party is null or ledger - amount is null then 'needs_review' when abs(ledger - amount) <= 1 or coalesce(abs(case when ledger <> 0 then (ledger - amount) / ledger end) <= 0.01, false) then 'matched' else 'mismatch' end as status from bk2")
BEST = V2 + """,
bb as (select *, row_number() over (partition by engagement_id, party, kind order by case status when 'matched' then 3 when 'mismatch' then 2 when 'needs_review' then 1 else 0 end desc, reply_id) as rn from st),
best as (select engagement_id, party, kind, case when status in ('matched', 'mismatch', 'needs_review') then status else '미회신' end as status, reply_id, difference from bb where rn = 1)"""
query("recon_best_reply", lambda t: fx.best_reply(statuses(t)), f"with {BEST}\nselect * from best")


def finals(t):
    return t.sampled.where("kind != 'payable'").select("engagement_id", "party", F.lit("receivable").alias("kind"), F.col("receivable_ledger").alias("balance"))


FIN = "fs2 as (select engagement_id, party, 'receivable' as kind, receivable_ledger as balance from {sampled} where kind <> 'payable')"
query("recon_tracking", lambda t: fx.reply_tracking(finals(t), fx.best_reply(statuses(t))).withColumn("detail_difference", F.round("detail_difference", 4)), f"""with {BEST}, {FIN}
select engagement_id, kind, count(*) as sent, count(*) filter (where status is not null and status <> '미회신') as replied, count(*) filter (where status = 'matched') as matched, count(*) filter (where status = 'mismatch') as mismatch, count(*) filter (where status = 'needs_review') as needs_review,
 count(*) filter (where status is null or status = '미회신') as no_reply, round(sum(-difference), 4) as detail_difference from fs2 left join best using (engagement_id, party, kind) group by 1, 2""")  # fmt: skip
EXPL = "ex as (select engagement_id, party, sum(sent) as sent, sum(reply) as reply, coalesce(string_agg(distinct nullif(trim(reason), ''), ', ' order by nullif(trim(reason), '')), '') as reasons, coalesce(string_agg(distinct nullif(trim(account_type), ''), ', ' order by nullif(trim(account_type), '')), '') as account_types, min_by(currency, row_no) as currency, sum(sent) - sum(reply) as difference from {explanations} group by 1, 2)"
query("recon_explanation_summary", lambda t: c.explanation_summary(t.explanations), f"with {EXPL}\nselect * replace (cast(sent as double) as sent, cast(reply as double) as reply, cast(difference as double) as difference) from ex")
query("recon_apply_explanations", lambda t: fx.apply_explanations(statuses(t).select("engagement_id", "party", "reply_id", "status"), c.explanation_summary(t.explanations)), f"""with {V2}, {EXPL}
select st.engagement_id, st.party, reply_id, case when coalesce(reasons, '') <> '' then 'matched' else status end as status, case when reasons is not null then 'reconciliation_applied' end as reviewer_status, case when coalesce(reasons, '') <> '' then reasons end as note from st left join ex using (engagement_id, party)""")  # fmt: skip

# alternative procedures and coverage
query("cov_sampled_candidates", lambda t: c.sampled_candidates(decisions(t)), f"with {FINAL}\nselect engagement_id, party, case when r.balance is not null and p.balance is not null then 'both' when r.balance is not null then 'receivable' else 'payable' end as kind, cast(coalesce(r.balance, p.balance) as double) as balance from (select * from fin where kind = 'receivable' and is_final) r full join (select * from fin where kind = 'payable' and is_final) p using (engagement_id, party)")
query("cov_pending_parties", lambda t: c.pending_parties(finals(t), fx.best_reply(statuses(t))), f"""with {BEST}, {FIN}, w as (select f.*, case when status is null or status = '미회신' then '미회신' when status = 'mismatch' then '차이' end as why, difference from fs2 f left join best using (engagement_id, party, kind))
select engagement_id, party, kind, balance, why, case when why = '차이' then difference end as difference from w where why is not null""")  # fmt: skip
plain = lambda n: F.lower(F.regexp_replace(n, r"\s", ""))
query("cov_auto_identify", lambda t: c.auto_identify(finals(t), t.replies.select("engagement_id", F.lower("party").alias("party")), t.evidence.where("currency = 'USD'"), plain), f"with {FIN}\nselect * from fs2 f where not exists (select 1 from {{replies}} r where r.engagement_id = f.engagement_id and lower(replace(r.party, ' ', '')) = lower(replace(f.party, ' ', ''))) and not exists (select 1 from {{evidence}} e where e.currency = 'USD' and e.engagement_id = f.engagement_id and e.party = f.party)")
EV = "ev as (select engagement_id, party, coalesce(upper(currency), 'KRW') as currency, sum(amount) as amount from {evidence} where success group by 1, 2, 3)"
query("cov_evidence_by_currency", lambda t: c.evidence_by_currency(t.evidence), f"with {EV}\nselect * replace (cast(amount as double) as amount) from ev")
READ = "cast(confidence as double) as confidence, case when cast(floor(amount) as bigint) % 7 = 0 then null else amount end as read_amount, cast(floor(amount) as bigint) % 3 <> 0 as has_file"


def read_evidence(t):
    """Evidence of which some files give no amount and some that failed have no file."""
    return t.spark.sql(f"select engagement_id, party, currency, success, {READ} from {{evidence}}", evidence=t.evidence).withColumnRenamed("read_amount", "amount")


query("cov_evidence_summary", lambda t: c.evidence_summary(read_evidence(t)), f"""with e as (select engagement_id, party, currency, success, {READ} from {{evidence}}), d as (select *, success and read_amount is not null as done from e),
n as (select engagement_id, party, count(*) filter (where done) as success, count(*) filter (where not done) as failed, count(*) filter (where not done and (success or has_file)) as needs_review, count(*) filter (where (not done and (success or has_file)) or (done and confidence < 0.5)) as low_confidence from d group by 1, 2),
s as (select engagement_id, party, coalesce(upper(currency), 'KRW') as currency, sum(read_amount) as amount from d where done group by 1, 2, 3),
b as (select engagement_id, party, case when bool_or(currency = 'KRW') then 'KRW' else max_by(currency, amount) end as currency from s group by 1, 2) select n.*, currency from n left join b using (engagement_id, party)""")  # fmt: skip


def ledgers(t):
    return t.ledger.where("kind = 'receivable'").groupBy("engagement_id", "party").agg(F.sum("ending").cast("double").alias("ledger"))


def covers(t, mixed=False):
    return c.coverage_ratio(t.evidence.where("currency is not null or amount > 100000"), ledgers(t), fx.all_rates(t.guide), mixed)


def cover_sql(mixed: bool) -> str:
    other = "sum(amount)" if mixed else "sum(cast(case when e.currency = 'KRW' then amount else cast(amount as double) * rate end as double))"
    return RATES + f""",
e0 as (select engagement_id, party, coalesce(upper(currency), 'KRW') as currency, sum(amount) as amount from {{evidence}} where success and (currency is not null or amount > 100000) group by 1, 2, 3),
e1 as (select e.engagement_id, e.party, cast(sum(amount) filter (where e.currency = 'KRW') as double) as own, cast({other} as double) as other from e0 e left join rates r on r.engagement_id = e.engagement_id and r.currency = e.currency group by 1, 2),
ld as (select engagement_id, party, cast(sum(ending) as double) as ledger from {{ledger}} where kind = 'receivable' group by 1, 2),
cv0 as (select ld.*, coalesce(own, case when other > 0 then other end) as covered from ld left join e1 using (engagement_id, party)),
cv1 as (select *, case when ledger > 0 and covered is not null then least(1.0::double, covered / ledger) end as share from cv0),
cv as (select *, case when share is null then 'needs_review' when share >= 0.95 then '충분' when share >= 0.5 then '부분' else '미해소' end as conclusion from cv1)"""


query("cov_coverage_ratio", covers, f"with {cover_sql(False)}\nselect * from cv")
query("cov_coverage_ratio_mixed", lambda t: covers(t, True), f"with {cover_sql(True)}\nselect * from cv")
query("cov_procedure_summary", lambda t: c.procedure_summary(covers(t)).select("engagement_id", "procedures", "enough", "part", "unresolved", "needs_review", F.round("covered", 2).alias("covered"), F.round("ledger", 2).alias("ledger"), F.round("share", 9).alias("share")),
      f"with {cover_sql(False)}\nselect engagement_id, count(*) as procedures, count(*) filter (where conclusion = '충분') as enough, count(*) filter (where conclusion = '부분') as part, count(*) filter (where conclusion = '미해소') as unresolved, count(*) filter (where conclusion = 'needs_review') as needs_review, round(sum(covered), 2) as covered, round(sum(ledger), 2) as ledger, round(sum(covered) / sum(ledger), 9) as share from cv group by 1")
STATE = """case when rs = 'matched' then 'matched' when rs = 'mismatch' then case when conclusion in ('충분', '부분') then '대체적_' || conclusion else 'mismatch' end when coalesce(conclusion, '') <> '' then case when conclusion = 'needs_review' then '대체적_pending' else '대체적_' || conclusion end when rs = 'needs_review' then 'needs_review' else 'unresolved' end"""
STATES = cover_sql(False) + ", " + BEST[len(RATES) + 2 :] + f", {FIN}, ss as (select f.engagement_id, f.party, f.kind, b.status as rs, conclusion from fs2 f left join best b using (engagement_id, party, kind) left join (select * from cv where ledger < 5000000) cv on cv.engagement_id = f.engagement_id and cv.party = f.party), states as (select *, {STATE} as state from ss)"


def states(t):
    return c.party_states(finals(t), statuses(t), covers(t).where("ledger < 5000000"))


query("cov_party_states", states, f"with {STATES}\nselect engagement_id, party, kind, rs as reply_status, conclusion, state from states")
query("cov_report", lambda t: c.coverage_report(states(t), 100), f"with {STATES}\nselect engagement_id, count(*) as parties, " + ", ".join(f"count(*) filter (where state = '{x}') as \"{x}\"" for x in ["matched", "mismatch", "needs_review", "unresolved", *c.CONCLUSIONS.values()]) + ", count(*) filter (where state in ('unresolved', 'needs_review')) <= 100 as passed from states group by 1")
query("cov_confirmation_status", lambda t: fx.confirmation_status(t.guide, fx.best_reply(statuses(t)), covers(t).where("conclusion != 'needs_review'"), plain), f"""with {STATES}, p as (select * from cv where conclusion <> 'needs_review'), q as (select g.*, case when b.status <> '미회신' then b.status end as bs, b.difference as bd, p.conclusion, p.covered from gu g left join best b on b.engagement_id = g.engagement_id and b.party = g.party left join p on p.engagement_id = g.engagement_id and p.party = g.party)
select engagement_id, party, account_group, currency, amount, case when bs is not null then '원본' when conclusion is not null then '대체적' else '미회신' end as confirmed_by, case when bs is not null then -bd when conclusion is not null then covered - amount end as difference, coalesce(bs, conclusion) as note from q""")  # fmt: skip
query("cov_confirmation_counts", lambda t: fx.confirmation_counts(fx.confirmation_status(t.guide, fx.best_reply(statuses(t)), covers(t).where("conclusion != 'needs_review'"), plain)), f"""with {STATES}, p as (select * from cv where conclusion <> 'needs_review'), q as (select g.*, case when b.status <> '미회신' then b.status end as bs, p.conclusion from gu g left join best b on b.engagement_id = g.engagement_id and b.party = g.party left join p on p.engagement_id = g.engagement_id and p.party = g.party)
select engagement_id, count(*) as rows, count(bs) as replied, count(*) filter (where bs is null and conclusion is not null) as alternative, count(*) filter (where bs is null and conclusion is null) as no_reply from q group by 1""")  # fmt: skip
query("cov_detail_coverage", lambda t: c.detail_coverage(t.explanations.select("engagement_id", "party", F.col("sent").alias("amount")), finals(t)), f"with {FIN}\nselect engagement_id, party, cast(sum(abs(sent)) as double) as detail_amount from {{explanations}} where (engagement_id, party) in (select engagement_id, party from fs2) group by 1, 2")
query("cov_audit_trail", lambda t: c.audit_trail_latest(t.explanations.select("engagement_id", "party", "row_no"), "engagement_id", 1, "row_no"), "select engagement_id, party, row_no from {explanations} where engagement_id = 1")
