"""The same results as SQL, where SQL can express them."""

from __future__ import annotations

from pitlake.plans.records import instants_sql

_P1 = f"""
with l as (
  select distinct 'backtest_results' as rec_table, run_id as rec_id, ticker as e, epoch_us(as_of) as us from backtest_results where as_of is not null
  union select 'legs', x.rec_id, g.asset, x.instant_us from ({instants_sql("legs", "client_order_id", "filled_at")}) x join (select distinct client_order_id, asset from legs) g on g.client_order_id = x.rec_id),
b as (select distinct bar_id, ticker as e, epoch_us(timestamp) as bus from bars),
near as (
  select l.*, b.bar_id, b.bus from l asof join b on l.e = b.e and l.us >= b.bus
  union all select l.*, b.bar_id, b.bus from l asof join b on l.e = b.e and l.us <= b.bus)
select rec_table, rec_id, bar_id from near where abs(us - bus) <= 1200000000 qualify row_number() over (partition by rec_table, rec_id order by abs(us - bus), bus, bar_id) = 1"""

_P3 = r"""
with i as (
  select distinct seq, cohort, trim(regexp_replace(lower(sector), '\s+', ' ', 'g')) as sector, logodds, written_at from ledger
  where type = 'decision' and sector is not null and logodds is not null and not isnan(logodds) and not isinf(logodds))
select cohort, sector, cast(place as int) as place, seq
from (select *, row_number() over (partition by cohort, sector order by logodds desc, written_at, seq) as place from i where sector <> '') where place <= 3"""

_P7 = r"""
with m as (
  select distinct message_id, run_id, seq, replace(lower(trim(sender)), ' ', '_') as sn, coalesce(regexp_matches(json_extract_string(payload, '$.content'), '\S'), false) as has, in_reply_to from agent_messages),
r as (select m.*, a.speaker_role as role from m left join agent_roles a on a.sender = m.sn),
x as (select run_id, seq, has and role is distinct from 'requester' as answers, unnest(in_reply_to) as ref from r),
damaged as (select x.run_id from x left join r on r.message_id = x.ref and r.run_id = x.run_id where r.seq is null or r.seq >= x.seq),
unanswered as (select r.run_id from r left join (select distinct run_id, ref from x where answers) a on a.run_id = r.run_id and a.ref = r.message_id where r.role = 'requester' and a.ref is null),
ok as (select run_id from r group by run_id having min(seq) = 1 and max(seq) = count(*) and count(distinct seq) = count(*) and bool_or(coalesce(role = 'requester', false)))
select run_id, seq as turn, message_id, role as speaker_role from r
where run_id in (select run_id from ok) and run_id not in (select run_id from damaged) and run_id not in (select run_id from unanswered)"""

ORACLES = {"p1_found": _P1, "p3_found": _P3, "p7_found": _P7}
