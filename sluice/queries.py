"""One query for each operator over the test tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import tagged_json
from sluice.operators import MULT, Flow, consolidate, expand, negate, union, weighted
from sluice.plans import Machine
from sluice.plans.examples import latest_status, paired, paired_rows, production_summary
from sluice.sinks import MSSQL, POSTGRES, SQLITE, ColumnSpec, TableSet, TableSpec, sqlite_sink
from sluice.sources import above, between, decode, joint_look_back, look_back_bound, looked_back, offsets, route, subscribe
from sluice.sources.folders import remove, shared_folder
from sluice.streaming import Export, catch_up, stream_deltas
from sluice.streaming.runner import print_duration

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _query(name: str, sql: str | None):
    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            @cache
            def table(t: str) -> Flow:
                return Flow.new(spark.read.parquet(f"{sf_dir}/{t}.parquet"))

            return function(table)

        _queries[name] = run
        if sql:
            _sql[name] = sql
        return function

    return add


def _k():
    """The number in an event's properties; columns need a session, so it isn't made on import."""
    return F.get_json_object("props", "$.k").cast("bigint")


def _mult(flow: Flow) -> DataFrame:
    """The rows with multiplicities under a plain name."""
    return weighted(flow.df).withColumnRenamed(MULT, "mult")


@_query("filter", "select event_id, event_type from events where starts_with(event_type, 'p')")
def _(t):
    return t("events").filter(F.col("event_type").startswith("p")).map("event_id", "event_type").df


_STATUS = "user_id, case when event_type = 'click' then 'working' else 'idle' end as status, case when event_type = 'click' then cast(props ->> '$.k' as bigint) end as order_no, ts"


@_query("map", f"select {_STATUS} from events where event_type in ('click', 'purchase')")
def _(t):
    click = F.col("event_type") == "click"
    return t("events").filter(F.col("event_type").isin("click", "purchase")).map("user_id", F.when(click, "working").otherwise("idle").alias("status"), F.when(click, _k()).alias("order_no"), "ts").df


@_query("map_in_place", "select c_custkey, upper(c_mktsegment) as c_mktsegment from customer")
def _(t):
    return t("customer").map("c_custkey", "c_mktsegment").map_in_place(c_mktsegment=F.upper("c_mktsegment")).df


@_query("flat_map", "select event_id, unnest(range(1, cast(props ->> '$.k' as bigint) % 3 + 2)) as i from events")
def _(t):
    return t("events").flat_map(F.sequence(F.lit(1).cast("bigint"), _k() % 3 + 1), "i", "event_id").df


@_query("negate", "select s_suppkey, cast(-1 as bigint) as mult from supplier")
def _(t):
    return _mult(t("supplier").map("s_suppkey").negate())


def _nations(t, table: str, column: str) -> Flow:
    return t(table).map(F.col(column).alias("nk"))


@_query("concat", "select c_nationkey as nk from customer union all select s_nationkey from supplier")
def _(t):
    return _nations(t, "customer", "c_nationkey").concat(_nations(t, "supplier", "s_nationkey")).df


@_query("concat_many", "select c_nationkey as nk from customer union all select s_nationkey from supplier union all select n_nationkey from nation")
def _(t):
    return _nations(t, "customer", "c_nationkey").concat_many([_nations(t, "supplier", "s_nationkey"), _nations(t, "nation", "n_nationkey")]).df


@_query("filter_mut", "select event_id, user_id from events qualify row_number() over (partition by user_id order by event_id) % 2 = 1")
def _(t):
    def every_other():
        seen = [0]

        def keep(row):
            seen[0] += 1
            return seen[0] % 2 == 1

        return keep

    return t("events").map("event_id", "user_id").filter_mut(every_other(), ["event_id"], ["user_id"]).df


@_query("map_mut", "select event_id, user_id, cast(sum(cast(props ->> '$.k' as bigint)) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as k from events")
def _(t):
    def running():
        total = [0]

        def add(row):
            total[0] += row["k"]
            return row | {"k": total[0]}

        return add

    return t("events").map("event_id", "user_id", _k().alias("k")).map_in_place_mut(running(), ["event_id"], ["user_id"]).df


@_query("distinct", "select distinct l_returnflag, l_linestatus from lineitem")
def _(t):
    return t("lineitem").map("l_returnflag", "l_linestatus").distinct().df


@_query("count", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all")
def _(t):
    return t("lineitem").map("l_orderkey", "l_linenumber").count().df


@_query("threshold", "select l_orderkey, l_linenumber, count(*) - 1 as mult from lineitem group by all having count(*) > 1")
def _(t):
    return _mult(t("lineitem").map("l_orderkey", "l_linenumber").threshold(lambda m: m - 1))


@_query("negate_consolidate", "select k, cast(sum(m) as bigint) as mult from (select c_nationkey as k, 1 as m from customer union all select s_nationkey, -1 from supplier) group by 1 having sum(m) <> 0")
def _(t):
    flow = _nations(t, "customer", "c_nationkey").concat(_nations(t, "supplier", "s_nationkey").negate()).map(F.col("nk").alias("k"))
    return consolidate(flow.df).withColumnRenamed(MULT, "mult")


@_query("max_by", "select user_id, ts, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def _(t):
    return t("events").map("user_id", "ts", "event_id", "event_type", "value").group("user_id").max_by(F.col("ts")).ungroup_both().df


@_query("min", "select o_custkey, o_totalprice, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) = 1")
def _(t):
    return t("orders").map("o_custkey", "o_totalprice", "o_orderkey").group("o_custkey").min().ungroup_both().df


@_query("grouped_max", "select l_returnflag, l_linestatus, l_linenumber, l_orderkey from lineitem qualify row_number() over (partition by l_returnflag order by l_linestatus desc, l_linenumber desc, l_orderkey desc) = 1")
def _(t):
    return t("lineitem").map("l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey").group("l_returnflag").max().ungroup_both().df


@_query("monotonic_max_by", "select event_type, user_id, event_id from events qualify row_number() over (partition by event_type order by user_id desc, event_id desc) = 1")
def _(t):
    return t("events").map("event_type", "user_id", "event_id").monotonic_max_by("event_type").df


@_query("representative", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts, event_id) = 1")
def _(t):
    return t("events").map("user_id", "event_id", "event_type", "ts").monotonic_representative_by(["user_id"], ["ts", "event_id"]).map("user_id", "event_id", "event_type").df


@_query("grouped_count", "select event_type, count(*) as n from events group by 1")
def _(t):
    return t("events").map("event_type", "event_id").group("event_type").count().ungroup_both().df


@_query("grouped_distinct", "select distinct user_id, event_type from events")
def _(t):
    return t("events").map("user_id", "event_type").group("user_id").distinct().ungroup_both().df


@_query("grouped_threshold", "select user_id, event_type, cast(1 as bigint) as mult from events group by all having count(*) >= 15")
def _(t):
    return _mult(t("events").map("user_id", "event_type").group("user_id").threshold(lambda m: F.when(m >= 15, 1).otherwise(0)).ungroup_both())


@_query("ungroup_with", "select concat_ws(':', o_orderstatus, cast(count(*) as varchar)) as s from orders group by o_orderstatus")
def _(t):
    return t("orders").map("o_orderstatus", "o_orderkey").group("o_orderstatus").count().ungroup_with(F.concat_ws(":", "o_orderstatus", F.col("n").cast("string")).alias("s")).df


@_query("ungroup", "select max(o_orderkey) as o_orderkey from orders group by o_custkey")
def _(t):
    return t("orders").map("o_custkey", "o_orderkey").group("o_custkey").max().ungroup().df


@_query("group_by", "select o_custkey % 5 as k, count(*) as n from orders group by 1")
def _(t):
    return t("orders").map("o_custkey", "o_orderkey").group_by(k=F.col("o_custkey") % 5).count().ungroup_both().df


@_query("regroup", "select n_regionkey, max(n) as mx from (select c_nationkey, count(*) as n from customer group by 1) join nation on c_nationkey = n_nationkey group by 1")
def _(t):
    per_nation = t("customer").map(F.col("c_nationkey").alias("nk"), "c_custkey").group("nk").count()
    region = t("nation").map(F.col("n_nationkey").alias("nk"), "n_regionkey").group("nk")
    joined = per_nation.join_single(region, "nk", "n", "n_regionkey").group("nk")
    return joined.regroup({"n_regionkey": F.col("n_regionkey")}, {"mx": F.col("n")}).max().ungroup_both().df


@_query("reduce_rows", "select event_type, user_id, cast(n as bigint) as n from (select event_type, user_id, count(*) as n, row_number() over (partition by event_type order by user_id) as r from events group by 1, 2) where r <= 2")
def _(t):
    first_two = lambda key, rows: [((v[0], m), 1) for v, m in rows[:2]]
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("user_id", LongType()), StructField("n", LongType())])
    return t("events").map("event_type", "user_id").group("event_type").reduce_rows(first_two, schema).ungroup_both().df.drop(MULT)


@_query(
    "production_summary",
    "select l_partkey, l_suppkey, arg_min(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_returnflag)) as first_flag, cast(sum(cast(l_quantity as bigint)) as bigint) as total_pcs from lineitem group by all",
)
def _(t):
    rows = t("lineitem").map("l_partkey", "l_suppkey", F.col("l_returnflag").alias("first_flag"), F.col("l_quantity").cast("bigint").alias("pcs"), "l_shipdate", "l_orderkey", "l_linenumber")
    return production_summary(rows, ["l_partkey", "l_suppkey"], "first_flag", "pcs", ["l_shipdate", "l_orderkey", "l_linenumber"]).df


@_query("join_single", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def _(t):
    orders = t("orders").map(F.col("o_custkey").alias("k"), "o_orderkey").group("k")
    return orders.join_single(t("customer").map(F.col("c_custkey").alias("k"), "c_name").group("k"), "o_orderkey", "c_name").df


@_query("join_many", "select c_custkey, unnest([n_name, c_mktsegment]) as tag from nation join customer on n_nationkey = c_nationkey")
def _(t):
    nations = t("nation").map(F.col("n_nationkey").alias("k"), "n_name").group("k")
    customers = t("customer").map(F.col("c_nationkey").alias("k"), "c_custkey", "c_mktsegment").group("k")
    return nations.join(customers, F.array("n_name", "c_mktsegment"), "tag", "c_custkey").df


@_query("join_mult", "select c_nationkey as k, count(*) as mult from customer join supplier on c_nationkey = s_nationkey group by 1")
def _(t):
    a, b = (_nations(t, *x).map(F.col("nk").alias("k")) for x in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    # one row for each key and side, with its total; the totals multiply
    pairs = Flow(consolidate(a.df)).group("k").join_single(Flow(consolidate(b.df)).group("k"), "k")
    return consolidate(pairs.df).withColumnRenamed(MULT, "mult")


_USAGE = """
with x as (select user_id, cast(props ->> '$.k' as bigint) % 4 as ord, ts, event_id, event_type from events where event_type in ('click', 'purchase')),
y as (select *, lag(event_type) over w as pt, lag(ts) over w as ps from x window w as (partition by user_id, ord order by ts, event_id))
select user_id, ord, ps as started, epoch_us(ts) - epoch_us(ps) as duration_micros{} from y where event_type = 'purchase' and pt = 'click'"""


def _usage(flow: Flow) -> Flow:
    rows = flow.filter(F.col("event_type").isin("click", "purchase")).map("user_id", (_k() % 4).alias("ord"), F.col("event_type").alias("kind"), "ts", "event_id")
    df = rows.df.drop(MULT)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return Flow(paired(df, ["user_id", "ord"], ["ts", "event_id"], "click", "purchase").select("user_id", "ord", "started", (micros("ts") - micros("started")).alias("duration_micros")), True)


@_query("usage", _USAGE.format(""))
def _(t):
    return _usage(t("events")).df


@_query(
    "dashboard",
    """
with d as (select user_id as machine, case when event_type = 'click' then 1 else 0 end as ordinal, case when event_type = 'click' then cast(props ->> '$.k' as bigint) end as order_no, ts as since
  from events where event_type in ('click', 'purchase'))
select machine, case when ordinal = 1 then 'working' else 'idle' end as status, order_no, since from d
qualify row_number() over (partition by machine order by since desc, ordinal desc, order_no desc nulls last) = 1""",
)
def _(t):
    click = F.col("event_type") == "click"
    rows = t("events").filter(F.col("event_type").isin("click", "purchase"))
    return latest_status(rows.map(F.col("user_id").alias("machine"), F.when(click, 1).otherwise(0).alias("ordinal"), F.when(click, _k()).alias("order_no"), F.col("ts").alias("since"))).df


@_query("look_back", "select user_id, count(*) as n from events where ts > (select max(ts) from events) - interval 7 day group by 1")
def _(t):
    events = t("events").df.select("user_id", F.col("event_id").alias("lamport"), F.col("ts").cast("timestamp").alias("ts"))
    latest = events.agg(F.max("ts").alias("now"))
    limited = looked_back(events.join(F.broadcast(latest)), "7 days", F.col("now"))
    return Flow.new_limited(limited.select("user_id", "lamport"), "7 days").group("user_id").count().ungroup_both().df


@_query("inputs_pair", "select case when event_type in ('click', 'view') then 1 when event_type in ('view', 'error') then 2 end as route, count(*) as n from events group by 1")
def _(t):
    accepts = [F.when(F.col("event_type").isin(*kinds), F.lit(1)) for kinds in (("click", "view"), ("view", "error"))]
    return Flow(route(t("events").df, accepts).select("route", "event_id")).group("route").count().ungroup_both().df


@_query("inspect", "select c_nationkey as nk, count(*) as n from customer group by 1")
def _(t):
    return _nations(t, "customer", "c_nationkey").inspect("seen").count().df


@_query("except_all", "select c_nationkey as nk from customer except all select s_nationkey from supplier")
def _(t):
    rest = _nations(t, "customer", "c_nationkey").concat(_nations(t, "supplier", "s_nationkey").negate()).threshold(lambda m: F.greatest(m, F.lit(0)))
    return expand(rest.df)


@_query("union", "select c_nationkey as nk from customer union select s_nationkey from supplier")
def _(t):
    return _nations(t, "customer", "c_nationkey").concat(_nations(t, "supplier", "s_nationkey")).distinct().df


@_query("intersect", "select c_nationkey as nk from customer intersect select s_nationkey from supplier")
def _(t):
    a, b = _nations(t, "customer", "c_nationkey").distinct(), _nations(t, "supplier", "s_nationkey").distinct()
    return a.group("nk").join_single(b.group("nk"), "nk").df


@_query("semi_join", "select c_custkey from customer semi join (from orders where o_orderstatus = 'F' and o_totalprice > 200000) t on c_custkey = o_custkey")
def _(t):
    keys = t("orders").filter("o_orderstatus = 'F' and o_totalprice > 200000").map(F.col("o_custkey").alias("c_custkey")).distinct()
    return t("customer").map("c_custkey").group("c_custkey").join_single(keys.group("c_custkey"), "c_custkey").df


@_query("anti_join", "select c_custkey from customer anti join (from orders where o_orderstatus = 'F' and o_totalprice > 200000) t on c_custkey = o_custkey")
def _(t):
    customers = t("customer").map("c_custkey")
    keys = t("orders").filter("o_orderstatus = 'F' and o_totalprice > 200000").map(F.col("o_custkey").alias("c_custkey")).distinct()
    semi = customers.group("c_custkey").join_single(keys.group("c_custkey"), "c_custkey")
    return expand(consolidate(customers.concat(semi.negate()).df))


@_query(
    "sink_apply",
    """select k, unnest(range(1, cast(m as bigint) + 1)) as "copy" from (select k, sum(m) as m from (select c_nationkey as k, 1 as m from customer union all select s_nationkey, -15 from supplier) group by 1) where m > 0""",
)
def _(t):
    """Through a table: rows put in and taken out, 15 for each supplier; what isn't there can't be taken out."""
    spec = TableSpec("nations", 1, (ColumnSpec("k", "integer", index=True),))
    sink = sqlite_sink(_database(), (spec,))
    removed = weighted(t("supplier").map(F.col("s_nationkey").alias("k")).negate().df).withColumn(MULT, F.col(MULT) * 15)
    for n, rows in enumerate((t("customer").map(F.col("c_nationkey").alias("k")).df, removed)):
        sink.apply({"s": n}, {"nations": ((r[:-1], r[-1]) for r in consolidate(rows).select("k", MULT).toLocalIterator())}, n)
    back = t("customer").df.sparkSession.createDataFrame(sink.rows("nations"), "k int")
    return Flow(back).count().map("k", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy")).df


def _stepped(t, query, columns: list[str], keys: list[str] | None, linear: bool = False) -> DataFrame:
    """The sum of the deltas of four batches by event_id."""
    rows = t("events").df.select(*columns)
    batches = rows.withColumn("__step", (F.col("event_id") % 4).cast("int"))
    return consolidate(Machine(query, keys, linear=linear).steps(batches, "__step", 4)).withColumnRenamed(MULT, "mult")


@_query("incremental_max_by", "select user_id, ts, event_id, cast(1 as bigint) as mult from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def _(t):
    return _stepped(t, lambda f: f.group("user_id").max_by(F.col("ts")).ungroup_both(), ["user_id", "ts", "event_id"], ["user_id"])


@_query("incremental_count", "select event_type, count(*) as n, cast(1 as bigint) as mult from events group by 1")
def _(t):
    return _stepped(t, lambda f: f.group("event_type").count().ungroup_both(), ["event_type", "event_id"], ["event_type"])


@_query("incremental_join", "select user_id, event_id, c_name, cast(1 as bigint) as mult from events join customer on user_id = c_custkey")
def _(t):
    names = t("customer").map(F.col("c_custkey").alias("user_id"), "c_name").group("user_id")
    return _stepped(t, lambda f: f.group("user_id").join_single(names, "user_id", "event_id", "c_name"), ["user_id", "event_id"], ["user_id"], linear=True)


@_query("incremental_regroup", "select event_type, max(n) as mx, cast(1 as bigint) as mult from (select event_type, user_id, count(*) as n from events group by 1, 2) group by 1")
def _(t):
    def query(f):
        return f.group("event_type", "user_id").count().regroup({"event_type": F.col("event_type")}, {"mx": F.col("n")}).max().ungroup_both()

    return _stepped(t, query, ["event_type", "user_id", "event_id"], ["event_type"])


@_query("incremental_usage", _USAGE.format(", cast(1 as bigint) as mult"))
def _(t):
    return _stepped(t, _usage, ["user_id", "props", "ts", "event_id", "event_type"], ["user_id"])


@_query("flat_map_mut", "select event_id, user_id, i from (select event_id, user_id, row_number() over (partition by user_id order by event_id) as n from events), lateral (select unnest(range(1, n % 3 + 1)) as i)")
def _(t):
    from pyspark.sql.types import LongType, StructField, StructType

    def rising():
        seen = [0]

        def several(row):
            seen[0] += 1
            return [row | {"i": i} for i in range(1, seen[0] % 3 + 1)]

        return several

    schema = StructType([StructField(c, LongType()) for c in ("event_id", "user_id", "i")])
    return t("events").map("event_id", "user_id").flat_map_mut(rising(), schema, ["event_id"], ["user_id"]).df


@_query("inspect_mut", "select event_id, user_id from events")
def _(t):
    seen = []
    return t("events").map("event_id", "user_id").inspect_mut(lambda row, m: seen.append(m), ["event_id"], ["user_id"]).df


@_query("output", "select event_type, user_id, cast(1 as bigint) as mult from events union all select event_type, user_id, -1 from events where event_type = 'click'")
def _(t):
    rows = t("events").map("event_type", "user_id")
    return rows.concat(rows.filter("event_type = 'click'").negate()).output().withColumnRenamed(MULT, "mult")


@_query("except", "select c_nationkey as nk from customer except select s_nationkey from supplier where s_nationkey % 2 = 0")
def _(t):
    a, b = _nations(t, "customer", "c_nationkey").distinct(), _nations(t, "supplier", "s_nationkey").filter("nk % 2 = 0").distinct()
    return expand(a.concat(b.negate()).threshold(lambda m: F.greatest(m, F.lit(0))).df)


@_query("epoch_seconds", "select event_id, epoch_us(ts) // 1000000 as seconds, cast(octet_length(encode(event_type)) as integer) as bytes from events")
def _(t):
    return t("events").map("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"), F.octet_length("event_type").alias("bytes")).df


# --- the event log: events as envelopes of eight sources -----------------------------------------------------------------

_ENVELOPE_SQL = "select event_type as semantics, concat('user', user_id) as stream_name, concat('s', event_id % 8) as source, event_id as lamport, ts from events"


def _envelopes(t) -> DataFrame:
    """events as a log: the type is the semantics, the user the stream, and the sources' offsets rise with the Lamport time."""
    payload = F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","k":'), _k().cast("string"), F.lit("}"))
    return t("events").df.select(
        F.col("event_type").alias("semantics"), F.concat(F.lit("user"), F.col("user_id")).alias("stream_name"), F.concat(F.lit("s"), F.col("event_id") % 8).alias("source"),
        F.floor(F.col("event_id") / 8).cast("long").alias("offset"), F.col("event_id").alias("lamport"), F.col("ts").cast("timestamp").alias("ts"), payload.alias("payload"),
    )


@_query("subscription", "select lamport, source from (" + _ENVELOPE_SQL + ") where semantics = 'click' and stream_name = 'user7'")
def _(t):
    return subscribe(_envelopes(t), "click", "user7").select("lamport", "source")


@_query("inputs_event", "select event_type as type, event_id as lamport, cast(props ->> '$.k' as bigint) as k from events where event_type in ('click', 'view')")
def _(t):
    good, _ = decode(_envelopes(t), tagged_json(F.col("payload"), "type", {"click": {"k": "long"}, "view": {"k": "long"}}))
    return good.select("record.type", "lamport", "record.k")


@_query("dead_letters", "select event_id as lamport from events where event_type not in ('click', 'view')")
def _(t):
    return decode(_envelopes(t), tagged_json(F.col("payload"), "type", {"click": {"k": "long"}, "view": {"k": "long"}}))[1].select("lamport")


@_query("inputs_triple", "select case when event_type = 'click' then 1 when event_type in ('click', 'view') then 2 when event_type in ('view', 'error') then 3 end as input, count(*) as n, cast(sum(cast(props ->> '$.k' as bigint)) as bigint) as k from events where event_type in ('click', 'view', 'error') group by 1")
def _(t):
    decoders = [tagged_json(F.col("payload"), "type", {v: {"k": "long"} for v in kinds}) for kinds in (("click",), ("click", "view"), ("view", "error"))]
    query = lambda *flows: flows[0].map(F.lit(1).alias("input"), "k").concat_many([f.map(F.lit(i + 2).alias("input"), "k") for i, f in enumerate(flows[1:])])
    machine = Machine(query, inputs=3, look_backs=[None, "7 days", None])
    machine.feed_first(_envelopes(t), decoders)
    return machine.drain().groupBy("input").agg(F.sum(MULT).alias("n"), F.sum(F.col("k") * F.col(MULT)).alias("k"))


@_query("query_between", "select event_id as lamport from events where (event_id % 8 = 0 and event_id // 8 > 100 and event_id // 8 <= 500) or (event_id % 8 = 1 and event_id // 8 <= 7)")
def _(t):
    return between(_envelopes(t), {"s0": 100}, {"s0": 500, "s1": 7}).select("lamport")


@_query("present_offsets", 'select concat(\'s\', event_id % 8) as source, max(event_id // 8) as "offset" from events group by 1')
def _(t):
    found = offsets(_envelopes(t))  # a row for each source
    return t("events").df.sparkSession.createDataFrame(sorted(found.items()), "source string, offset long")


@_query("go_back", "select event_id as lamport from events where event_id > (select max(event_id) from events where ts <= (select max(ts) from events) - interval 3 day)")
def _(t):
    log = _envelopes(t)
    now = F.lit(log.agg(F.max("ts")).first()[0])
    return above(log, look_back_bound(log, "3 days", now)).select("lamport")


@_query("look_back_of_inputs", "select * from (values ('two', '1 weeks 1 day'), ('one without', null), ('one', '3 hours')) v(inputs, look_back)")
def _(t):
    made = [("two", joint_look_back(["7 days", "1 weeks 1 day"])), ("one without", joint_look_back(["7 days", None])), ("one", Machine(lambda f: f, look_backs=["3 hours"]).look_back)]
    return t("events").df.sparkSession.createDataFrame(made, "inputs string, look_back string")


@_query("durations", "select * from (values (5, '5s'), (60, '1m0s'), (3600, '1h0m0s'), (93784, '1d2h3m4s')) v(seconds, text)")
def _(t):
    return t("events").df.sparkSession.createDataFrame([(x, print_duration(x)) for x in (5, 60, 3600, 93784)], "seconds int, text string")


@_query("needs_state", "select * from (values ('count', true), ('filter', false), ('monotonic', true)) v(flow, stateful)")
def _(t):
    flows = {"filter": lambda f: f.filter("user_id > 1"), "count": lambda f: f.count(), "monotonic": lambda f: f.monotonic_max_by("user_id")}
    return t("events").df.sparkSession.createDataFrame([(k, Machine(q).needs_state(t("events").df)) for k, q in sorted(flows.items())], "flow string, stateful boolean")


# --- streams: the same verbs as keyed processors, fed in two micro-batches; their deltas add up to the batch result --------

STATE_PARTITIONS = 4


def _state_partitions(spark: SparkSession) -> int:
    """One for each core of the session, so that more machines take more of the state."""
    return max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism)


def _streamed(t, table: str, columns: list, step: str, query) -> DataFrame:
    rows = t(table).map(*columns).df
    frames = [rows.filter(f"pmod({step}, 2) = {k}") for k in range(2)]
    return consolidate(stream_deltas(frames, query, _state_partitions(t(table).df.sparkSession)).drop("step")).withColumnRenamed(MULT, "mult")


_ONE = ", cast(1 as bigint) as mult"


@_query("stream_threshold", "select user_id, event_type, count(*) - 10 as mult from events group by all having count(*) > 10")
def _(t):
    return _streamed(t, "events", ["user_id", "event_type", "event_id"], "event_id", lambda f: f.map("user_id", "event_type").threshold(lambda m: F.greatest(m - 10, F.lit(0))))


@_query("stream_grouped_threshold", "select user_id, event_type, cast(1 as bigint) as mult from events group by all having count(*) >= 15")
def _(t):
    return _streamed(t, "events", ["user_id", "event_type", "event_id"], "event_id", lambda f: f.map("user_id", "event_type").group("user_id").threshold(lambda m: F.when(m >= 15, 1).otherwise(0)).ungroup_both())


@_query("stream_distinct", f"select distinct user_id, event_type{_ONE} from events")
def _(t):
    return _streamed(t, "events", ["user_id", "event_type", "event_id"], "event_id", lambda f: f.map("user_id", "event_type").distinct())


@_query("stream_count", f"select event_type, count(*) as n{_ONE} from events group by 1")
def _(t):
    return _streamed(t, "events", ["event_type", "event_id"], "event_id", lambda f: f.group("event_type").count().ungroup_both())


@_query("stream_max_by", f"select user_id, ts, event_id{_ONE} from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def _(t):
    return _streamed(t, "events", ["user_id", "ts", "event_id"], "event_id", lambda f: f.group("user_id").max_by(F.col("ts")).ungroup_both())


@_query("stream_min", f"select user_id, min(event_id) as event_id{_ONE} from events group by 1")
def _(t):
    return _streamed(t, "events", ["user_id", "event_id"], "event_id", lambda f: f.group("user_id").min().ungroup_both())


@_query("stream_monotonic", f"select event_type, user_id, event_id{_ONE} from events qualify row_number() over (partition by event_type order by user_id desc, event_id desc) = 1")
def _(t):
    return _streamed(t, "events", ["event_type", "user_id", "event_id"], "event_id", lambda f: f.monotonic_max_by("event_type"))


@_query("stream_representative", f"select user_id, event_id{_ONE} from (select user_id, event_id, row_number() over (partition by user_id order by event_id % 2, event_id) as r from events) where r = 1")
def _(t):
    return _streamed(t, "events", ["user_id", "event_id"], "event_id", lambda f: f.monotonic_representative_by(["user_id"], ["event_id"]))


@_query("stream_join", f"select user_id, event_id, other{_ONE} from events join (select user_id, max(event_id) as other from events group by 1) using (user_id)")
def _(t):
    def query(f):
        best = f.group("user_id").max().ungroup_both().map("user_id", F.col("event_id").alias("other"))
        return f.group("user_id").join_single(best.group("user_id"), "user_id", "event_id", "other")

    return _streamed(t, "events", ["user_id", "event_id"], "event_id", query)


@_query("stream_regroup", f"select event_type, max(n) as mx{_ONE} from (select event_type, user_id, count(*) as n from events group by 1, 2) group by 1")
def _(t):
    query = lambda f: f.group("event_type", "user_id").count().regroup({"event_type": F.col("event_type")}, {"mx": F.col("n")}).max().ungroup_both()
    return _streamed(t, "events", ["event_type", "user_id", "event_id"], "event_id", query)


@_query("stream_usage", _USAGE.format(_ONE))
def _(t):
    rows = ["user_id", (_k() % 4).alias("ord"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "event_id"]

    def query(f):
        out = paired_rows(f.filter("kind in ('click', 'purchase')"), ["user_id", "ord"], ["event_id"], "click", "purchase")
        return out.map("user_id", "ord", F.col("started").cast("timestamp_ntz").alias("started"), (F.unix_micros("ts") - F.unix_micros("started")).alias("duration_micros"))

    return _streamed(t, "events", rows, "event_id", query)


@_query(
    "stream_summary",
    f"select o_orderpriority, arg_min(o_orderstatus, (o_orderkey, o_orderstatus)) as first_status, cast(sum(o_custkey) as bigint) as total_pcs{_ONE} from (select *, o_custkey % 97 as o_orderpriority from (select o_orderkey, o_custkey, o_orderstatus from orders)) group by 1",
)
def _(t):
    rows = [(F.col("o_custkey") % 97).alias("o_orderpriority"), F.col("o_orderstatus").alias("first_status"), F.col("o_custkey").alias("pcs"), "o_orderkey"]
    return _streamed(t, "orders", rows, "o_orderkey", lambda f: production_summary(f, ["o_orderpriority"], "first_status", "pcs", ["o_orderkey"]))


# --- the runner and the sinks: an SQLite file on the driver, brought up to date and read back ------------------------------

_LATEST = TableSpec("latest", 1, (ColumnSpec("stream_name", "text", index=True), ColumnSpec("lamport", "bigint")))
_TALLY = TableSpec("tally", 1, (ColumnSpec("semantics", "text"), ColumnSpec("n", "bigint")))


def _latest(f: Flow) -> Flow:
    return f.map("stream_name", "lamport").group("stream_name").max().ungroup_both()


def _tally(f: Flow) -> Flow:
    return f.map("semantics", "lamport").group("semantics").count().ungroup_both()


_BOARD_SQL = "select stream_name as key, max(lamport) as value, 'latest' as name from ({0}) group by 1 union all select semantics, count(*), 'tally' from ({0}) group by 1 union all select source, max(lamport // 8), 'offsets' from ({0}) group by 1".format(_ENVELOPE_SQL)


def _read_back(t, sink) -> DataFrame:
    rows = [(*r, n) for n in ("latest", "tally") for r in sink.rows(n)] + [(*r, "offsets") for r in sink.offsets().items()]
    return t("events").df.sparkSession.createDataFrame(rows, "key string, value long, name string")


def _database():
    import tempfile

    return f"{tempfile.mkdtemp(prefix='sluice-')}/x.db"  # the driver's own, like the connection


@_query("runner_catch_up", _BOARD_SQL)
def _(t):
    """Three runs over a growing log, in batch."""
    sink, log = sqlite_sink(_database(), (_LATEST, _TALLY)), _envelopes(t)
    half = log.agg(F.max("lamport")).first()[0] // 2
    for rows in (log.filter(F.col("lamport") <= half), log, log):
        catch_up(rows, F.struct("payload"), {"latest": _latest, "tally": _tally}, sink)
    return _read_back(t, sink)


@_query("runner_export", _BOARD_SQL)
def _(t):
    """One stream into two tables: it is stopped, loses its checkpoint, warms up again and goes on."""
    spark = t("events").df.sparkSession
    base, db, log = shared_folder(spark, "export"), _database(), _envelopes(t)
    most = log.agg(F.max("lamport")).first()[0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", STATE_PARTITIONS)
    try:
        for k in range(3):
            log.filter(F.col("lamport").between(k * most // 3 + (k > 0), (k + 1) * most // 3)).coalesce(1).write.mode("append").parquet(f"{base}/log")
            if k == 1:
                remove(spark, f"{base}/checkpoint")
            export = Export(spark, f"{base}/log", F.struct("payload"), {"latest": _latest, "tally": _tally}, None, sqlite_sink(db, (_LATEST, _TALLY)), f"{base}/checkpoint")
            export.catch_up()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return _read_back(t, export.sink)


@_query("sink_migration", "select * from (values ('first', true, 2, 1), ('again', false, 2, 1), ('newer', true, 0, 0)) v(opened, migrated, n_rows, n_offsets)")
def _(t):
    path, out = _database(), []
    for name, version in (("first", 1), ("again", 1), ("newer", 2)):
        sink = sqlite_sink(path, (TableSpec("tally", version, _TALLY.columns),), "p")
        if name == "first":
            sink.apply({"s": 1}, {"tally": [(("a", 1), 1), ((None, 2), 1)]}, 0)
        out.append((name, sink.migrated, len(sink.rows("tally")), len(sink.offsets())))
    return t("events").df.sparkSession.createDataFrame(out, "opened string, migrated boolean, n_rows int, n_offsets int")


_STATEMENTS = {
    "SQLite": (
        "insert into p_t (a, b) values (?, ?)",
        "delete from p_t where a is ? and b is ?",
        "insert into p_t_offsets (source, offset_) values (?, ?) on conflict (source) do update set offset_ = excluded.offset_",
        "create table if not exists p_t (a text, b bigint, id serial)",
        "create index if not exists p_t_index on p_t (a)",
    ),
    "PostgreSQL": (
        "insert into p_t (a, b) values ($1, $2)",
        "delete from p_t where a is not distinct from $1 and b is not distinct from $2",
        "insert into p_t_offsets (source, offset_) values ($1, $2) on conflict (source) do update set offset_ = excluded.offset_",
        "create table if not exists p_t (a text, b bigint, id serial)",
        "create index if not exists p_t_index on p_t (a)",
    ),
    "SQL Server": (
        "insert into p_t (a, b) values (@P1, @P2)",
        "delete top (@P3) from p_t where exists (select a intersect select @P1) and exists (select b intersect select @P2)",
        "merge p_t_offsets with (holdlock) as t using (select @P1 as source, @P2 as offset_) as n on t.source = n.source when matched then update set offset_ = n.offset_ when not matched then insert (source, offset_) values (n.source, n.offset_);",
        "if object_id('p_t', 'U') is null create table p_t (a text, b bigint, id serial)",
        "if indexproperty(object_id('p_t'), 'p_t_index', 'IndexID') is null create index p_t_index on p_t (a)",
    ),
}
_KINDS = ("insert", "delete", "offset", "table", "index")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


@_query("sink_statements", f"select * from (values {_values((d, k, s) for d, all_ in _STATEMENTS.items() for k, s in zip(_KINDS, all_, strict=True))}) v(dialect, kind, statement)")
def _(t):
    spec, out = TableSpec("t", 3, (ColumnSpec("a", "text", index=True), ColumnSpec("b", "bigint"), ColumnSpec("id", "serial", exclude=True))), []
    for dialect in (SQLITE, POSTGRES, MSSQL):
        tables = TableSet((spec,), dialect, "p")
        made = (tables.insert(spec), tables.delete(spec), tables.upsert_offset(), *tables.migration()[-2:])
        out += [(dialect.name, k, s) for k, s in zip(_KINDS, made, strict=True)]
    return t("events").df.sparkSession.createDataFrame(out, "dialect string, kind string, statement string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
