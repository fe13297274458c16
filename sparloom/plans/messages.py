"""Queries of rules, messages, streams (batch forms), retrieval and the relational tables (MSG, FN, AGG, JOIN, STR, VEC, WIN, RANK)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparloom.functions.formula import compile_formula, compile_mapping
from sparloom.operators import retrieval, rules
from sparloom.operators.rules import Rule
from sparloom.sources.tables import table
from sparloom.streaming import messages as M

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _events(s, d):
    return table(s, d, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("name"), "value", F.get_json_object("props", "$.k").alias("payload"))


_E = "(select event_id, ts, user_id, event_type as name, value, json_extract_string(props, '$.k') as payload from events)"
_RULES = [
    Rule("AMOUNT", "l_extendedprice * (1 - l_discount)", ("l_extendedprice", "l_discount")),
    Rule("BAND", "l_quantity > 30 ? 3 : (l_quantity > 10 ? 2 : 1)", ("l_quantity",)),
    Rule("REST", "l_partkey % 7", ("l_partkey",)),
    Rule("HALF", "l_suppkey // 2", ("l_suppkey",)),
    Rule("LATE", "clip(l_tax * 100, 1, 6)", ("l_tax",), when="l_linenumber >= 2", default="0"),
]


@query("""select l_orderkey, l_linenumber, l_extendedprice::double * (1 - l_discount::double) as "AMOUNT", (case when l_quantity > 30 then 3 when l_quantity > 10 then 2 else 1 end)::double as "BAND", (l_partkey % 7)::double as "REST", floor(l_suppkey / 2.0)::double as "HALF",
  case when l_linenumber >= 2 then least(greatest(l_tax::double * 100, 1), 6) else 0 end::double as "LATE" from lineitem""")
def msg_02_convert(s, d):
    """MSG-02/03/05: rules compiled to columns over wide messages."""
    li = table(s, d, "lineitem").withColumn("row_key", F.struct("l_orderkey", "l_linenumber"))
    num = [F.col(c).cast("double").alias(c) for c in ("l_extendedprice", "l_discount", "l_quantity", "l_partkey", "l_suppkey", "l_tax", "l_linenumber")]
    return rules.convert(li.select("row_key", *num), _RULES, "row_key").select("row_key.l_orderkey", "row_key.l_linenumber", *[r.target for r in _RULES])


@query(f"select event_id, name as target, case when value > 5 then round_even(100.0 / (value - 5), 3)::varchar end is not null as ok from {_E}")
def msg_02_records(s, d):
    """MSG-02 in long form: a value that can't be computed is an error record."""
    e = _events(s, d).select("event_id", "name", F.when(F.col("value") > 5, F.col("value")).alias("value"))
    return rules.conversion_records(e.drop("name"), [Rule("X", "100 / (value - 5)", ("value",))], "event_id").join(e.select("event_id", "name"), "event_id").select("event_id", F.col("name").alias("target"), "ok")


@query(f"select event_id, case when value < 0 then null when value <= 10 then 'LOW' when value <= 40 then 'MID' when value <= 1000 then 'HIGH' end as label from (select event_id, floor(value)::int as value from {_E})")
def fn_13_mapping(s, d):
    v = _events(s, d).select("event_id", F.floor("value").cast("int").alias("value"))
    return v.select("event_id", compile_mapping("0-10=LOW; 10-40=MID; 40-1000=HIGH", F.col("value")).alias("label"))


@query("select p_partkey, case when (p_size & 255) >= 32 then (p_size & 255) - 64 else (p_size & 255) end::double as signed6, p_size * 0.5::double + 3 as scaled, least(greatest(p_size, 5), 20)::double as clipped from part")
def fn_12_bits(s, d):
    p = table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("raw"))
    f = lambda t: compile_formula(t, {"raw": F.col("raw")}).cast("double")
    return p.select("p_partkey", f("signed(raw & 255, 6)").alias("signed6"), f("scale(raw, 0.5, 3)").alias("scaled"), f("clip(raw, 5, 20)").alias("clipped"))


@query("select o_orderkey, round(greatest(0.0, 1 - least(abs(o_totalprice - 150000) / greatest(abs(150000.0), 1.0), 1.0)), 6) as similarity from (select o_orderkey, o_totalprice::double as o_totalprice from orders)")
def fn_14_similarity(s, d):
    return table(s, d, "orders").select("o_orderkey", F.round(rules.numeric_similarity(F.col("o_totalprice").cast("double"), F.lit(150000.0)), 6).alias("similarity"))


@query("select l_returnflag, l_linestatus, round(sum(l_discount::double * l_quantity::double) / greatest(sum(l_quantity::double), 1.0) * 100, 4) as weighted from lineitem group by 1, 2")
def agg_04_weighted(s, d):
    li = table(s, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_discount").cast("double").alias("v"), F.col("l_quantity").cast("double").alias("w"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(rules.weighted(F.col("v"), F.col("w")), 4).alias("weighted"))


@query("""select l_returnflag, round(coverage * 0.35 + exact_rate * 0.25 + confident * 0.2 + low_loss * 0.1 + hits * 0.1, 4) as conversion_rate from (select l_returnflag, 100.0::double * count(*) filter (l_tax > 0) / count(*) as coverage, 100.0::double * count(*) filter (l_quantity > 25) / count(*) as exact_rate,
  100.0::double * count(*) filter (l_quantity * 2 >= 80) / count(*) as confident, 100.0::double * count(*) filter (l_quantity <= 20) / count(*) as low_loss, 100.0::double * count(*) filter (l_discount > 0.02) / count(*) as hits from lineitem group by 1)""")
def agg_06_conversion_rate(s, d):
    q = F.col("l_quantity").cast("double")
    li = table(s, d, "lineitem").select("l_returnflag", (F.col("l_tax") > 0).alias("present"), (q > 25).alias("exact"), (q * 2).alias("correctness"), q.alias("loss"), (F.col("l_discount") > 0.02).alias("hit"))
    return rules.conversion_metrics(li, "l_returnflag").select("l_returnflag", "conversion_rate")


@query("""select coalesce(a.p_partkey, b.p_partkey) as p_partkey, case when a.p_partkey is null then 'added' when b.p_partkey is null then 'removed' when a.s <> b.s then 'modified' else 'unchanged' end as change, case when a.s <> b.s then 's' else '' end as columns
  from (select p_partkey, p_size as s from part where p_partkey % 3 <> 0) a full join (select p_partkey, case when p_partkey % 5 = 0 then p_size + 1 else p_size end as s from part where p_partkey % 7 <> 0) b using (p_partkey)""")
def join_08_rule_diff(s, d):
    """JOIN-08: two versions of a table, changed columns named."""
    p = table(s, d, "part")
    old = p.where("p_partkey % 3 <> 0").select("p_partkey", F.col("p_size").alias("s"))
    new = p.where("p_partkey % 7 <> 0").select("p_partkey", F.expr("case when p_partkey % 5 = 0 then p_size + 1 else p_size end").alias("s"))
    return rules.rule_diff(old, new, ["p_partkey"])


@query(f"""with r as (select *, coalesce(lag(payload) over w <> payload, true)::int as new from {_E} window w as (partition by name order by ts, payload)), g as (select *, sum(new) over (partition by name order by ts, payload rows unbounded preceding) as run from r)
  select event_id, row_number() over (partition by name, run order by ts, payload) as repeats from g""")
def str_01_repeats(s, d):
    """STR-01: repeat count of equal payloads in a row, per message name."""
    return M.repeat_runs(_events(s, d)).select("event_id", F.col("repeats").cast("bigint").alias("repeats"))


@query(f"""with r as (select *, coalesce(lag(payload) over w <> payload, true)::int as new from {_E} window w as (partition by name order by ts, payload)), g as (select *, sum(new) over (partition by name order by ts, payload rows unbounded preceding) as run from r),
  k as (select event_id, row_number() over (partition by name, run order by ts, payload) as n from g) select event_id from k where n = 2""")
def str_02_fetchable(s, d):
    """STR-02: payloads seen twice in a row."""
    return M.fetchable(_events(s, d), 2).select("event_id")


@query(f"select a.user_id as user_id, a.event_id as a_id, b.event_id as b_id from {_E} a join {_E} b on a.user_id = b.user_id and a.name = 'click' and b.name = 'view' and epoch_ms(b.ts) - epoch_ms(a.ts) <= 3600000 and epoch_ms(a.ts) - epoch_ms(b.ts) <= 600000")
def str_04_joint_pairs(s, d):
    """STR-04/JOIN-18: pairs of two message names of a user within a time matrix."""
    e = _events(s, d)
    side = lambda n: e.where(F.col("name") == n).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("value"))
    return M.joint_pairs(side("click"), side("view"), 3_600_000, 600_000).select(F.col("key").alias("user_id"), F.col("a_value").alias("a_id"), F.col("b_value").alias("b_id"))


@query(f"select name, user_id, max(ts) as last_ts from {_E} group by 1, 2 having epoch_ms((select max(ts) from events)) - epoch_ms(max(ts)) <= 86400000")
def str_09_unexpired(s, d):
    e = _events(s, d)
    last = e.groupBy("name", "user_id").agg(F.max("ts").alias("last_ts"))
    return last.join(F.broadcast(e.agg(F.max("ts").alias("now")))).where(F.unix_millis(F.col("now").cast("timestamp")) - F.unix_millis(F.col("last_ts").cast("timestamp")) <= 86_400_000).drop("now")


@query(f"select event_id, name from {_E} where event_id > 5000 order by event_id desc limit 2000")
def str_07_replay(s, d):
    return M.replay(_events(s, d).withColumnRenamed("event_id", "id"), 5000).select(F.col("id").alias("event_id"), "name")


@query(f"with e as (select user_id, event_id, ts, value, case when value > 20 then value end as metric from {_E}) select user_id, event_id, max(value) over w as progress, last_value(metric ignore nulls) over w as metric from e window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)")
def win_07_monotone(s, d):
    """WIN-07: progress that never falls, and the last known value of a metric that is not always reported."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    metric = F.last(F.when(F.col("value") > 20, F.col("value")), ignorenulls=True).over(w)
    return _events(s, d).select("user_id", "event_id", F.max("value").over(w).alias("progress"), metric.alias("metric"))


@query(f"with r as (select user_id, event_id, sum(value) over (partition by user_id order by ts, event_id) as v from {_E}), p as (select *, coalesce(floor(lag(v) over (partition by user_id order by v, event_id) / 100), 0)::bigint as b0, floor(v / 100)::bigint as b1 from r) select user_id, unnest(range(b0 + 1, b1 + 1)) as checkpoint from p where b1 > b0")
def win_09_checkpoints(s, d):
    """WIN-09: a checkpoint at every full hundred, several where a step jumps over several."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    r = _events(s, d).withColumn("v", F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)))
    b0 = F.coalesce(F.floor(F.lag("v").over(W.partitionBy("user_id").orderBy("v", "event_id")) / 100), F.lit(0))
    return r.select("user_id", b0.alias("b0"), F.floor(F.col("v") / 100).alias("b1")).where("b1 > b0").select("user_id", F.explode(F.sequence(F.col("b0") + 1, F.col("b1"))).alias("checkpoint"))


@query("""with q as (select vec_id as query_id, embedding as qv from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id, list_cosine_similarity(embedding::double[], qv::double[]) as score from embeddings, q)
  select query_id, vec_id, round(score, 4) as score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as r from s) where r <= 10""")
def vec_02_search(s, d):
    """VEC-02: exact top 10 of every hundredth vector against all vectors."""
    e = table(s, d, "embeddings")
    return retrieval.search(e, e.where("vec_id % 100 = 0"), 10).select("query_id", "vec_id", F.round("score", 4).alias("score"))


@query()
def vec_01_ivf_recall(s, d):
    """VEC-01: inverted-file search; recall of its top 10 against the exact one, per query."""
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0")
    exact = retrieval.search(e, q, 10).select("query_id", "vec_id")
    got = retrieval.ivf_search(e, q, 10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(got, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 4) as norm, len(embedding) as dims, 1.0::double as unit_norm from embeddings")
def vec_04_unit(s, d):
    """VEC-04: vectors at length one."""
    u = retrieval.unit(F.col("embedding"))
    return table(s, d, "embeddings").select("vec_id", F.round(F.sqrt(retrieval.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"), F.size("embedding").cast("bigint").alias("dims"), F.round(F.sqrt(retrieval.dot(u, u)), 6).alias("unit_norm"))


@query("select l_returnflag, l_linestatus, sum(l_quantity)::double as qty, round(sum(l_extendedprice * (1 - l_discount))::double, 2) as revenue, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by 1, 2")
def rel_q1(s, d):
    li = table(s, d, "lineitem").where("l_shipdate <= date '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")).cast("double"), 2).alias("revenue"), F.count("*").alias("n"))


@query("select o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount))::double, 2) as revenue from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey where o_orderdate < date '1995-03-15' and l_shipdate > date '1995-03-15' group by 1, 2 order by revenue desc, o_orderkey limit 10")
def rel_q3(s, d):
    o = table(s, d, "orders").where("o_orderdate < date '1995-03-15'").join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    li = table(s, d, "lineitem").where("l_shipdate > date '1995-03-15'").select(F.col("l_orderkey").alias("o_orderkey"), F.expr("l_extendedprice * (1 - l_discount)").alias("v"))
    return o.join(li, "o_orderkey").groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum("v").cast("double"), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)
