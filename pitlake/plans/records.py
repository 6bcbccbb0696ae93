"""Queries over the tables of records: units, attributes as known, spikes, instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.operators.bitemporal import locate, rectangles
from pitlake.operators.instants import instants
from pitlake.operators.spikes import implausible
from pitlake.operators.units import claim_units, history_units
from pitlake.sources.tables import table

DAY_US = 86_400_000_000


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    quarters = history_units(table(spark, folder, "quarters"), "cik", "source", "fact_id", "period_end", "value", "unit_note")
    claims = claim_units(table(spark, folder, "claims"), table(spark, folder, "measure_sources"))
    return (
        quarters.select(F.lit("quarters").alias("rec_table"), F.col("fact_id").cast("string").alias("rec_id"), "common_unit", "common_value")
        .unionByName(claims.select(F.lit("claims").alias("rec_table"), "rec_id", "common_unit", "common_value"))
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    evidence = table(spark, folder, "evidence_refs").select("evidence_id", "ticker", "published_at", "feed").where("ticker is not null and published_at is not null")
    issuers = table(spark, folder, "issuers").select("ticker", "cik").where("ticker is not null and cik is not null").distinct()
    known = instants(evidence, "published_at", table(spark, folder, "feeds")).where("instant_us is not null").select("evidence_id", "ticker", "instant_us").distinct()
    known = known.join(issuers, "ticker").select("evidence_id", "cik", F.date_from_unix_date(F.floor(F.col("instant_us") / DAY_US).cast("int")).alias("day"))
    facts = rectangles(table(spark, folder, "quarters"), "cik", "period_end", "first_filed", "fact_id")
    return locate(known, "cik", F.col("day"), facts).select("evidence_id", "fact_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return implausible(table(spark, folder, "bars"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    feeds, out = table(spark, folder, "feeds"), None
    for name, key, text in (("evidence_refs", "evidence_id", "published_at"), ("legs", "client_order_id", "filled_at"), ("backtest_results", "run_id", "recorded_at")):
        x = instants(table(spark, folder, name).select(F.col(key).alias("rec_id"), text, "feed"), text, feeds).where("instant_us is not null")
        x = x.select(F.lit(name).alias("rec_table"), "rec_id", "instant_us")
        out = x if out is None else out.unionByName(x)
    return out.distinct()


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p5_found, p6_found)}

_WHEN = """
  select {key} as rec_id, trim({text}) as t, f.tz_name, f.day_first from (select distinct {key}, {text}, feed from {table}) x join feeds f using (feed) where {text} is not null"""

#: Instants by patterns of one kind each, resolved by the engine's own zone rules: another way than the operator's.
_INSTANTS = r"""
with raw as ({raw}),
epoch as (
  select rec_id, t, case length(split_part(t, '.', 1))
    when 10 then try_cast(split_part(t, '.', 1) as bigint) * 1000000 + try_cast(left(rpad(split_part(t, '.', 2), 6, '0'), 6) as bigint)
    when 13 then try_cast(split_part(t, '.', 1) as bigint) * 1000 + try_cast(left(rpad(split_part(t, '.', 2), 3, '0'), 3) as bigint)
    else try_cast(split_part(t, '.', 1) as bigint) end as us
  from raw where regexp_matches(t, '^([0-9]{{10}}|[0-9]{{13}}|[0-9]{{16}})([.][0-9]+)?$')),
text as (
  select *, regexp_replace(t, '(:[0-9]{{2}})[.,][0-9]+', '\1') as s, try_cast(left(rpad(regexp_extract(t, ':[0-9]{{2}}[.,]([0-9]+)', 1), 6, '0'), 6) as bigint) as frac
  from raw where not regexp_matches(t, '^([0-9]{{10}}|[0-9]{{13}}|[0-9]{{16}})([.][0-9]+)?$')),
zone as (
  select *, case
    when regexp_matches(s, 'Z$|\[UTC\]$| (UTC|GMT)$') then '+00:00'
    when regexp_matches(s, ':[0-9]{{2}} ?[+-][0-9]{{2}}:?[0-9]{{2}}$') then regexp_replace(regexp_extract(s, '[+-][0-9]{{2}}:?[0-9]{{2}}$'), '([+-][0-9]{{2}}):?([0-9]{{2}})', '\1:\2')
    when regexp_matches(s, 'UTC[+-][0-9]+$') then regexp_extract(s, '([+-])[0-9]+$', 1) || lpad(regexp_extract(s, '[+-]([0-9]+)$', 1), 2, '0') || ':00'
    else map {{'EST': '-05:00', 'EDT': '-04:00', 'CST': '-06:00', 'CDT': '-05:00', 'MST': '-07:00', 'MDT': '-06:00', 'PST': '-08:00', 'PDT': '-07:00', 'BST': '+01:00', 'CET': '+01:00',
      'CEST': '+02:00', 'JST': '+09:00', 'AEST': '+10:00', 'AEDT': '+11:00'}}[regexp_extract(s, ' ([A-Z]{{3,4}})$', 1)] end as off,
    coalesce(nullif(regexp_extract(s, '[ \[]([A-Z][a-z]+/[A-Za-z_]+)\]?$', 1), ''), tz_name) as tz,
    regexp_replace(s, '(Z|\[UTC\]|(:[0-9]{{2}}) ?[+-][0-9]{{2}}:?[0-9]{{2}}| UTC[+-][0-9]+| (UTC|GMT|E[SD]T|C[SD]T|M[SD]T|P[SD]T|BST|CES?T|JST|AE[SD]T)|[ \[][A-Z][a-z]+/[A-Za-z_]+\]?)$', '\2') as b
  from text),
local as (
  select *, coalesce(try_strptime(b, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M', '%d.%m.%Y %H:%M', '%d.%m.%Y, %H:%M:%S', '%Y%m%d%H%M%S', '%Y%m%dT%H%M%S',
      '%a, %d %b %Y %H:%M:%S', '%d %b %Y %H:%M:%S', '%b %d, %Y %I:%M %p', '%d %B %Y %H:%M']),
    case when day_first then try_strptime(b, ['%d/%m/%Y %I:%M:%S %p', '%d/%m/%Y %H:%M']) else try_strptime(b, ['%m/%d/%Y %I:%M:%S %p', '%m/%d/%Y %H:%M']) end) as lt
  from zone),
done as (
  select rec_id, coalesce(frac, 0) + case when off is not null
    then epoch_us(lt) - (case left(off, 1) when '-' then -1 else 1 end) * (try_cast(substring(off, 2, 2) as bigint) * 60 + try_cast(right(off, 2) as bigint)) * 60000000
    else epoch_us(case when timezone(tz, timezone(tz, lt) - interval 1 hour) = lt then timezone(tz, lt) - interval 1 hour else timezone(tz, lt) end) end as us
  from local where lt is not null)
select rec_id, cast(us as bigint) as instant_us from (select rec_id, us from epoch union all select rec_id, us from done) where us is not null"""


def instants_sql(table: str, key: str, text: str) -> str:
    return _INSTANTS.format(raw=_WHEN.format(table=table, key=key, text=text))


_P6 = "\nunion all\n".join(
    f"select '{name}' as rec_table, rec_id, instant_us from ({instants_sql(name, key, text)})"
    for name, key, text in (("evidence_refs", "evidence_id", "published_at"), ("legs", "client_order_id", "filled_at"), ("backtest_results", "run_id", "recorded_at"))
)

_P4 = f"""
with e as (select rec_id as evidence_id, cast(make_timestamp(instant_us) as date) as day from ({instants_sql("evidence_refs", "evidence_id", "published_at")})),
k as (select distinct e.evidence_id, i.cik, e.day from e join evidence_refs r using (evidence_id) join issuers i using (ticker))
select k.evidence_id, first(q.fact_id order by q.period_end desc, q.first_filed desc, q.fact_id) as fact_id
from k join (select distinct fact_id, cik, period_end, first_filed from quarters) q on q.cik = k.cik and q.first_filed < k.day group by k.evidence_id"""


def _run_tests() -> str:
    """Runs of one to three closes that hold the current one: at place j of length n."""
    close = lambda k: "close" if k == 0 else f"lag(close, {k}) over w" if k > 0 else f"lead(close, {-k}) over w"
    names = {k: f"c{'m' if k > 0 else 'p'}{abs(k)}" for k in range(-3, 4)}
    tests = []
    for n in (1, 2, 3):
        for j in range(n):
            inside, before, after = [names[j - i] for i in range(n)], names[j + 1], names[j - n]
            ratios = [f"{x} / {y} - 1" for x in inside for y in (before, after)]
            ok = f"{before} is not null and {after} is not null"
            tests.append(f"({ok} and ((" + " and ".join(f"{r} > t" for r in ratios) + ") or (" + " and ".join(f"{r} < -t" for r in ratios) + ")))")
    return ", ".join(f"{close(k)} as {names[k]}" for k in names), " or ".join(tests)


_COLUMNS, _TESTS = _run_tests()
_P5 = f"""
with n as (select *, row_number() over (partition by ticker order by timestamp, bar_id) as i from (select distinct bar_id, ticker, timestamp, open, high, low, close, volume from bars)),
c as (select ticker, bar_id, {_COLUMNS} from n where close is not null window w as (partition by ticker order by i)),
u as (select ticker, 10 * median(abs(cp0 / cm1 - 1)) as t from (select *, cp0 from c) where cm1 is not null group by ticker),
v as (select ticker, median(volume) as mv from n where volume is not null group by ticker),
o as (select *, last_value(close ignore nulls) over (partition by ticker order by i rows between unbounded preceding and 1 preceding) as prev,
  i - row_number() over (partition by ticker, open, close, volume order by i) as still from n),
s as (select bar_id from (select bar_id, open, close, volume, count(*) over (partition by ticker, open, close, volume, still) as k from o) where k >= 6 and volume <> 0 and open is not null and close is not null)
select bar_id from c join u using (ticker) where {_TESTS}
union select bar_id from o join u using (ticker) where (open / prev - 1 > t and open / close - 1 > t) or (open / prev - 1 < -t and open / close - 1 < -t)
union select bar_id from n where least(open, high, low, close) <= 0 or volume < 0 or high < low or open < low or open > high or close < low or close > high
union select bar_id from n join v using (ticker) where volume > 20 * mv
union select bar_id from s""".replace("select *, cp0 from c", "select * from c")

#: Units by patterns over notes, tags and the text around each number; quarters without a note take the factor that fits the nearest stated level.
_P2 = r"""
with q as (select distinct fact_id, cik, period_end, value, regexp_replace(lower(trim(unit_note)), '\s+', ' ', 'g') as note from quarters where value is not null),
n as (select *, case when note is null then null when regexp_matches(note, 'billion|milliard|\bmrd\b|\bbn\b') then 9 when regexp_matches(note, 'million|millones|\bmio\b|\bmn\b|\bmm\b|\$ m$') then 6
  when regexp_matches(note, 'thousand|tausend|\btsd\b|000s?\b|k ?\$') then 3 else 0 end as k from q),
level as (select cik, period_end, avg(log10(abs(value)) + k) as level from n where k is not null and value <> 0 group by 1, 2),
u as (select * from n where k is null and value <> 0),
b as (select u.fact_id, l.level, u.period_end - l.period_end as d from u asof join level l on l.cik = u.cik and u.period_end >= l.period_end),
a as (select u.fact_id, l.level, l.period_end - u.period_end as d from u asof join level l on l.cik = u.cik and u.period_end <= l.period_end),
overall as (select quantile_cont(level, 0.5) as o from level),
near as (select u.fact_id, u.value, coalesce(case when a.d is null or b.d < a.d then b.level when b.d is null or a.d < b.d then a.level else (a.level + b.level) / 2 end, overall.o) as level from u cross join overall left join a using (fact_id) left join b using (fact_id)),
fit as (select near.fact_id, first(f.k order by abs(log10(abs(value)) + f.k - level), f.k) as k from near, (select unnest([0, 3, 6, 9]) as k) f group by 1),
quarter as (select n.fact_id, n.value, coalesce(n.k, fit.k, 0) as k from n left join fit using (fact_id)),
c as (select distinct claim_id, text, numeric_value as v, trim(regexp_extract(numeric_source, '^[^\[#@]+')) as base, lower(trim(regexp_replace(regexp_extract(numeric_source, '(\[[^\]]*\]|#.*)$'), '^\[|\]$|^#(unit=)?', '', 'g'))) as tag from claims where is_numeric and numeric_value is not null),
t as (select c.*, m.common_unit, case when tag = '' then m.declared_unit when regexp_matches(tag, '^bps?$') then 'basis point' when tag in ('%', 'pct') then 'percent' when tag in ('ratio', 'fraction') then 'fraction' when tag in ('cents', 'c/share') then 'US cent per share'
  when tag in ('usd_sh', '$/share') then 'USD per share' when regexp_matches(tag, 'bn') then 'USD billion' when regexp_matches(tag, 'mn|mm|musd') then 'USD million' when regexp_matches(tag, 'thousand|_k$|kusd') then 'USD thousand' else 'USD' end as unit from c join measure_sources m on m.numeric_source = c.base),
parts as (select claim_id, v, common_unit, regexp_extract_all(text, '[0-9]{1,3}(?:[\x{A0}\x{202F}\x{2009} ][0-9]{3})+(?:,[0-9]+)?|[0-9]+(?:[.,][0-9]+)*') as nums, regexp_split_to_array(text, '[0-9]{1,3}(?:[\x{A0}\x{202F}\x{2009} ][0-9]{3})+(?:,[0-9]+)?|[0-9]+(?:[.,][0-9]+)*') as around from t where unit is null and text is not null),
each as (select claim_id, v, common_unit, i, regexp_replace(nums[i], '[\x{A0}\x{202F}\x{2009} ]', '', 'g') as num, lower(around[i]) as pre, lower(regexp_replace(around[i + 1], '^\)', '')) as post from parts, unnest(generate_series(1, len(nums))) g(i)),
hit as (select *, regexp_matches(pre, '(us ?\$|usd|\$)\s*[-−(]*\s*$') or regexp_matches(post, '^\s*(outright|(us[- ]?)?dollars?|usd|\$)') as money from each
  where abs(try_cast(replace(num, ',', '') as double) - abs(v)) <= 1e-9 * greatest(1, abs(v)) or abs(try_cast(replace(replace(num, '.', ''), ',', '.') as double) - abs(v)) <= 1e-9 * greatest(1, abs(v))),
said as (select claim_id, i, case common_unit
  when 'basis point' then case when regexp_matches(post, '^\s*(%|per ?cent|prozent|pour ?cent)') then 'percent' when regexp_matches(post, '^\s*(bps?\b|basis|points? de base)') then 'basis point'
    when regexp_matches(pre, '(ratio of|anteil von|rapport de)\s*[-−(]*\s*$') or regexp_matches(post, '^\s*as a fraction') then 'fraction' end
  when 'US cent per share' then case when regexp_matches(post, '^\s*(¢|(us[- ]?)?cents?\b)') then 'US cent per share' when money then 'USD per share' end
  else case when regexp_matches(post, '^\s*(billion|milliard|mrd|bn\b|md ?\$)') then 'USD billion' when regexp_matches(post, '^\s*(million|mio|mn\b|mm\b|m ?\$|m\b)') then 'USD million'
    when regexp_matches(post, '^\s*(thousand|tausend|tsd|millier|k ?\$|k\b)') then 'USD thousand' when money then 'USD' end end as unit from hit),
found as (select t.claim_id, t.v, t.common_unit, coalesce(t.unit, s.unit) as unit from t left join (select claim_id, first(unit order by i) as unit from said where unit is not null group by 1) s using (claim_id)),
factors as (select unnest(['USD', 'USD thousand', 'USD million', 'USD billion', 'fraction', 'percent', 'basis point', 'USD per share', 'US cent per share']) as unit, unnest([1, 1000, 1000000, 1000000000, 10000, 100, 1, 100, 1]) as f)
select 'quarters' as rec_table, cast(fact_id as varchar) as rec_id, 'USD' as common_unit, cast(round(cast(value as decimal(30,8)) * cast(pow(10, k) as bigint), 0) as bigint) as common_value from quarter
union all select 'claims', claim_id, common_unit, cast(round(cast(v as decimal(24,8)) * f, 0) as bigint) from found join factors using (unit)"""

ORACLES = {"p2_found": _P2, "p4_found": _P4, "p5_found": _P5, "p6_found": _P6}
