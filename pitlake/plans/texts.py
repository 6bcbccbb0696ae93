"""Text, evidence, context and memory queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitlake.functions.columns import numbers, plain_text, states, visible_text
from pitlake.operators.folds import fold, greedy
from pitlake.plans.registry import query
from pitlake.sources.tables import table

_BLANK = r"[ \t\n\r\f\v]"


@query(
    r"""select doc_id, cast(length(t) as int) as n, sha256(t) as h from (select doc_id, lower(trim(regexp_replace(translate(text, '‘’“”–—', chr(39) || chr(39) || '""--'), '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) as t from documents where text is not null)"""
)
def normalised_text(spark: SparkSession, folder: str) -> DataFrame:
    """Texts in lower case with plain quotes and single spaces, as length and hash."""
    t = F.lower(F.trim(F.regexp_replace(F.translate("text", "‘’“”–—", "''\"\"--"), _BLANK + "+", " ")))
    x = table(spark, folder, "documents").where("text is not null").select("doc_id", t.alias("t"))
    return x.select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("h"))


@query(
    r"""with n as (select claim_id, numeric_value, [try_cast(regexp_replace(m, '[()$,-]', '', 'g') as double) * case when m like '(%)' or contains(m, '-') then -1 else 1 end for m in regexp_extract_all(text, '\(?-?\$?[0-9][0-9,]*(?:\.[0-9]+)?\)?')] as xs from (select distinct claim_id, text, numeric_value from claims) where text is not null)
select claim_id, cast(len(xs) as int) as n, coalesce(numeric_value is not null and len(list_filter(xs, lambda x: abs(abs(x) - abs(numeric_value)) <= greatest(0.005, 0.0005 * abs(numeric_value)))) > 0, false) as stated from n"""
)
def number_in_quote(spark: SparkSession, folder: str) -> DataFrame:
    """How many numbers a claim's text writes and whether its value is one of them."""
    x = table(spark, folder, "claims").select("claim_id", "text", "numeric_value").distinct().where("text is not null")
    return x.select("claim_id", F.size(numbers(F.col("text"))).alias("n"), F.coalesce(states(F.col("numeric_value"), F.col("text")), F.lit(False)).alias("stated"))


_LABELS = {"restatement": "restate", "going_concern": "going concern", "guidance_up": "rais(ed|es) (its )?(guidance|outlook)", "dividend": "dividend"}


@query("select doc_id, " + ", ".join(f"regexp_matches(lower(text), '{p}') as {k}" for k, p in _LABELS.items()) + ", regexp_matches(text, '[0-9]') as has_number from documents where text is not null")
def silver_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword labels of each whole text."""
    x = table(spark, folder, "documents").where("text is not null").select("doc_id", "text", F.lower("text").alias("t"))
    return x.select("doc_id", *[F.col("t").rlike(p).alias(k) for k, p in _LABELS.items()], F.col("text").rlike("[0-9]").alias("has_number"))


@query(
    r"""with c as (select left(regexp_replace(regexp_replace(text, 'https?://[^ ]+', '<url>', 'g'), '[0-9]+([.][0-9]+)?', '#', 'g'), 60) as cause, claim_id from (select distinct claim_id, text from claims) where text is not null)
select cause, count(*) as n from c group by 1 order by n desc, cause limit 15"""
)
def failure_causes_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The fifteen most frequent texts once numbers and addresses are removed: a top-k report."""
    x = table(spark, folder, "claims").select("claim_id", "text").distinct().where("text is not null")
    cause = F.substring(F.regexp_replace(F.regexp_replace("text", r"https?://[^ ]+", "<url>"), r"[0-9]+([.][0-9]+)?", "#"), 1, 60)
    return x.groupBy(cause.alias("cause")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cause").limit(15)


@query(
    r"""with s as (select doc_id, unnest(regexp_split_to_array(text, '\n')) as line from documents where text is not null), k as (select doc_id, count(*) as lines, count(*) filter (where length(trim(line)) between 25 and 200) as kept, max(length(line)) as longest from s group by 1)
select doc_id, lines, kept, cast(longest as int) as longest from k"""
)
def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each text and how many are of a headline's length: arrays in place of exploded rows."""
    x = table(spark, folder, "documents").where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    size = F.transform("lines", lambda s: F.length(F.trim(s)))
    return x.select("doc_id", F.size("lines").cast("bigint").alias("lines"), F.size(F.filter(size, lambda n: n.between(25, 200))).cast("bigint").alias("kept"), F.array_max(F.transform("lines", F.length)).alias("longest"))


@query(
    r"""select doc_id, cast(greatest(1, floor(length(text) / 3.5)) as bigint) as tokens, len(regexp_extract_all(text, '[.!?]+[ \n]')) as sentences, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(1, length(text)), 6) as digits from documents where text is not null"""
)
def text_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated tokens, sentence ends and the share of digits."""
    x = table(spark, folder, "documents").where("text is not null")
    return x.select(
        "doc_id", F.greatest(F.lit(1), F.floor(F.length("text") / 3.5)).cast("bigint").alias("tokens"), F.regexp_count("text", F.lit(r"[.!?]+[ \n]")).cast("bigint").alias("sentences"),
        F.round(F.length(F.regexp_replace("text", "[^0-9]", "")) / F.greatest(F.lit(1), F.length("text")), 6).alias("digits"),
    )


@query(
    r"""with recursive d as (select doc_id, length(text) as chars, string_split_regex(regexp_replace(trim(text, ' '), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)) as s from documents where text is not null),
o as (select doc_id, chars, list_concat(list_filter(s, lambda v: regexp_matches(v, '[0-9]')), list_filter(s, lambda v: not regexp_matches(v, '[0-9]'))) as s from d),
u as (select doc_id, unnest(s) as v, generate_subscripts(s, 1) as i from o), r as (select doc_id, i, sum(length(v) + 1) over (partition by doc_id order by i) - 1 as want from u), k as (select doc_id, coalesce(min(i) filter (where want > 700), max(i) + 1) - 1 as kept from r group by 1)
select o.doc_id, o.chars, cast(k.kept as int) as sentences, case when k.kept > 0 then array_to_string(o.s[1:k.kept], ' ') end as summary from o join k using (doc_id)"""
)
def compressed_numeric_first(spark: SparkSession, folder: str) -> DataFrame:
    """Each text's sentences, those with numbers first, up to the first that doesn't fit a budget of characters; the whole text if none fits.

    A fold over the array of sentences of one text; nothing is shuffled.
    """
    budget = 700
    x = table(spark, folder, "documents").where("text is not null").select("doc_id", F.split(F.trim("text"), r"(?<=[.!?])\s+").alias("s"), F.length("text").alias("chars"))
    x = x.select("doc_id", "chars", F.concat(F.filter("s", lambda v: v.rlike(r"\d")), F.filter("s", lambda v: ~v.rlike(r"\d"))).alias("s"))
    size = F.transform("s", F.length)
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(False).alias("full"))

    def step(acc, n):
        want = acc["used"] + n + (acc["kept"] > 0).cast("int")
        fits = ~acc["full"] & (want <= budget)
        return F.struct(F.when(fits, want).otherwise(acc["used"]).alias("used"), (acc["kept"] + fits.cast("int")).alias("kept"), (acc["full"] | ~fits).alias("full"))

    x = x.withColumn("f", F.aggregate(size, start, step))
    return x.select("doc_id", "chars", F.col("f.kept").alias("sentences"), F.when(F.col("f.kept") > 0, F.array_join(F.slice("s", 1, F.col("f.kept")), " ")).alias("summary"))


@query(
    """with recursive e as (select ticker as key, evidence_id as item, evidence_id, data_quality_score, retrieved_at from (select distinct evidence_id, ticker, retrieved_at, data_quality_score from evidence_refs where ticker is not null)),
s as (select key, item, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(item, ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda d, k: case when d & 1 = 1 then xor(3988292384, d >> 1) else d >> 1 end))) % 400 + 20 as size, row_number() over (partition by key order by -data_quality_score nulls first, -epoch_us(retrieved_at) nulls first, item) as i from e),
p as (select key, item, size, i, size <= 1000 as taken, case when size <= 1000 then size else 0 end as used from s where i = 1 union all select s.key, s.item, s.size, s.i, p.used + s.size <= 1000, p.used + case when p.used + s.size <= 1000 then s.size else 0 end from p join s on s.key = p.key and s.i = p.i + 1)
select key, item as evidence_id, taken, cast(used as bigint) as used from p"""
)
def context_pack(spark: SparkSession, folder: str) -> DataFrame:
    """By ticker the evidence that fits a budget, best and newest first, skipping what doesn't fit and going on: a streamed fold by ticker, whose state is one running total."""
    x = table(spark, folder, "evidence_refs").where("ticker is not null").select("evidence_id", "ticker", "retrieved_at", "data_quality_score").distinct()
    x = x.select(
        F.col("ticker").alias("key"), F.col("evidence_id").alias("item"), (F.pmod(F.crc32("evidence_id"), F.lit(400)) + 20).alias("size"),
        (-F.col("data_quality_score")).alias("a"), (-F.unix_micros("retrieved_at")).alias("b"),
    )
    return fold(x, ["key"], ["a", "b", "item"], greedy(1000), "key string, item string, taken boolean, used bigint").withColumnRenamed("item", "evidence_id")


@query(
    """with r as (select run_id, claim_id, verification_status, case verification_status when 'contradicted' then 3 when 'unverified' then 2 when 'stale' then 1 else 0 end as bad from (select distinct claim_id, run_id, verification_status from claims))
select run_id, count(*) as n, case max(bad) when 3 then 'contradicted' when 2 then 'unverified' when 1 then 'stale' else 'verified' end as worst, round(avg(case when verification_status = 'verified' then 1.0 else 0.0 end), 6) as pass_rate, bool_or(bad = 3) as blocking from r group by run_id"""
)
def claim_worst_of(spark: SparkSession, folder: str) -> DataFrame:
    """By run the worst status of its claims, the share that passed, and whether it blocks."""
    x = table(spark, folder, "claims").select("claim_id", "run_id", "verification_status").distinct()
    ladder = F.array(*[F.lit(s) for s in ("verified", "stale", "unverified", "contradicted")])
    bad = F.greatest(F.array_position(ladder, F.col("verification_status")) - 1, F.lit(0))
    x = x.withColumn("bad", F.coalesce(bad, F.lit(0)))
    return x.groupBy("run_id").agg(F.count("*").alias("n"), F.element_at(ladder, (F.max("bad") + 1).cast("int")).alias("worst"), F.round(F.avg((F.coalesce(F.col("verification_status") == "verified", F.lit(False))).cast("double")), 6).alias("pass_rate"), F.max(F.col("bad") == 3).alias("blocking"))


@query(
    """with c as (select run_id, avg(case when verification_status = 'verified' then 1.0 else 0.0 end) as ev, count(*) filter (where verification_status = 'unverified') as un, count(*) filter (where verification_status = 'contradicted') as co from (select distinct claim_id, run_id, verification_status from claims) group by 1)
select run_id, round(0.6 * ev + 0.4 * greatest(0, 1 - 0.05 * (un + co)), 6) as confidence, cast((un > 0) as int) + cast((co > 0) as int) as caveats from c"""
)
def confidence(spark: SparkSession, folder: str) -> DataFrame:
    """A weighted composition of pass rate and open points, with the number of caveats."""
    x = table(spark, folder, "claims").select("claim_id", "run_id", "verification_status").distinct()
    is_ = lambda s: F.coalesce(F.col("verification_status") == s, F.lit(False)).cast("int")
    x = x.groupBy("run_id").agg(F.avg(is_("verified")).alias("ev"), F.sum(is_("unverified")).alias("un"), F.sum(is_("contradicted")).alias("co"))
    score = 0.6 * F.col("ev") + 0.4 * F.greatest(F.lit(0.0), 1 - 0.05 * (F.col("un") + F.col("co")))
    return x.select("run_id", F.round(score, 6).alias("confidence"), ((F.col("un") > 0).cast("int") + (F.col("co") > 0).cast("int")).alias("caveats"))


@query(
    """with e as (select vec_id, cast(embedding as double[]) as v from embeddings), q as (select * from e where vec_id % 50 = 0), s as (select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) as score from q join e on q.vec_id <> e.vec_id)
select query_id, vec_id, score from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5"""
)
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one, exactly: the stated query set, in blocks, against all rows.

    Queries are dealt into blocks of bounded size and rows into shares; each task multiplies one share of the rows with one block of queries and leaves the few
    rows of its share that may be among a query's first. Nothing reaches the driver but two counts.
    """
    top = 5
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    asks = e.where("vec_id % 50 = 0")
    blocks, shares = max(1, -(-asks.count() // 4096)), max(1, -(-e.count() // 65_536))
    at = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")
    rows = e.select("vec_id", "v", F.lit(False).alias("ask"), at("vec_id", shares).alias("share"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asks = asks.select("vec_id", "v", F.lit(True).alias("ask"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), at("vec_id", blocks).alias("block"))

    def near(x: pd.DataFrame) -> pd.DataFrame:
        unit = lambda f: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))(np.stack(f["v"].to_numpy())) if len(f) else None
        q, r = x[x["ask"]], x[~x["ask"]]
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, own = q["vec_id"].to_numpy(), r["vec_id"].to_numpy()
        s = np.round(unit(r) @ unit(q).T, 6)
        s[own[:, None] == ids[None, :]] = -np.inf
        # every row that may be among a query's first few, with all that tie at six digits
        least = np.partition(s, len(own) - top, axis=0)[len(own) - top] if len(own) > top else np.full(len(ids), -np.inf)
        i, j = np.nonzero((s >= least[None, :]) & np.isfinite(s))
        return pd.DataFrame({"query_id": ids[j], "vec_id": own[i], "score": s[i, j]})

    out = rows.unionByName(asks).groupBy("share", "block").applyInPandas(near, "query_id bigint, vec_id bigint, score double")  # a share and a block are bounded
    return out.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= top).drop("r")


@query(
    """with d as (select doc_id, list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')) as w from documents where text is not null), s as (select doc_id, cast(len(list_intersect(w, ['revenue', 'margin', 'guidance', 'dividend', 'cash'])) as int) as score from d)
select doc_id, score from s where score > 0 order by score desc, doc_id limit 25"""
)
def tag_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 texts that hold most of a set of words: a top-k report over whole texts."""
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    asks = F.array(*[F.lit(w) for w in ("revenue", "margin", "guidance", "dividend", "cash")])
    x = table(spark, folder, "documents").where("text is not null").select("doc_id", F.size(F.array_intersect(words, asks)).alias("score"))
    return x.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(25)


@query(
    r"""select message_id, topic, case when payload is null then null else json_extract_string(payload, '$.content') end as content, cast(coalesce(try_cast(json_extract_string(payload, '$.v') as int), 1) as int) as v, cast(coalesce(len(in_reply_to), 0) as int) as replies from (select distinct message_id, topic, payload, in_reply_to from agent_messages)"""
)
def parsed_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of JSON payloads with defaults for bare ones."""
    x = table(spark, folder, "agent_messages").select("message_id", "topic", "payload", "in_reply_to").distinct()
    return x.select(
        "message_id", "topic", F.get_json_object("payload", "$.content").alias("content"), F.coalesce(F.expr("try_cast(get_json_object(payload, '$.v') as int)"), F.lit(1)).alias("v"), F.greatest(F.coalesce(F.size("in_reply_to"), F.lit(0)), F.lit(0)).alias("replies")
    )


#: What a page's visible text leaves out, in a pattern without references back, which the SQL engine's patterns lack.
_UNSEEN = "|".join(rf"<{t}\b.*?</{t}\s*>" for t in ("script", "style", "nav", "header", "footer", "noscript"))


@query(
    rf"""with a as (select doc_id, regexp_replace(text, '(?is){_UNSEEN}|<!--.*?-->', ' ', 'g') as t from documents where text is not null), b as (select doc_id, regexp_replace(t, '(?is)<[^>]+>', ' ', 'g') as t from a),
c as (select doc_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') as t from b), d as (select doc_id, trim(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') as t from c)
select doc_id, cast(length(t) as int) as n, sha256(lower(trim(regexp_replace(translate(t, '‘’“”–—', chr(39) || chr(39) || '""--'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '))) as h from d"""
)
def plain_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Visible text of each document as if it were a page: tags, scripts and entities resolved, with its length."""
    x = table(spark, folder, "documents").where("text is not null").select("doc_id", visible_text(F.col("text")).alias("t"))
    return x.select("doc_id", F.length("t").alias("n"), F.sha2(plain_text(F.col("t")), 256).alias("h"))


@query(
    """with e as (select distinct evidence_id, ticker, data_quality_score as q, retrieved_at from evidence_refs where ticker is not null), a as (select evidence_id, ticker, q, greatest(0, 1 - date_diff('day', retrieved_at, timestamptz '2025-12-31 00:00:00+00') / 3650.0) as fresh from e)
select ticker, count(*) as n, round(avg(cast(q as double)), 5) as quality, round(avg(fresh), 5) as fresh from a group by ticker"""
)
def evidence_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Mean quality and freshness of the evidence of each ticker; freshness decays over ten years."""
    e = table(spark, folder, "evidence_refs").where("ticker is not null").select("evidence_id", "ticker", F.col("data_quality_score").cast("double").alias("q"), "retrieved_at").distinct()
    age = F.datediff(F.lit("2025-12-31").cast("date"), F.col("retrieved_at").cast("date"))
    return e.groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.avg("q"), 5).alias("quality"), F.round(F.avg(F.greatest(F.lit(0.0), 1 - age / 3650)), 5).alias("fresh"))
