"""Every operator on the driver's tables, with the same question as DuckDB SQL.

Money and event values are doubles with two decimals: Spark turns them into whole hundredths
(``scaled``), so all totals are exact. Sorting for display is left out: results are compared as
sets, and a sort of a large listing is one more shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as ops
from ..functions import scaled, shift_millis, whole_div
from ..session import scratch_folder
from ..sources import (
    block_records,
    latest_rollover_rows,
    numbered_log_lines,
    read_snapshots,
    read_table,
    render_text,
    rollover_rows,
    write_logs,
    write_rollover,
    write_snapshots,
)
from ..sources.tables import TABLES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def binding(sql: str) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        QUERIES[query.__name__] = query
        ORACLE[query.__name__] = sql
        return query

    return register


@binding("""
    with g as (
        select l_suppkey, sum(cast(round(l_extendedprice * 100) as bigint)) as value,
               count(*) as line_count
        from lineitem where l_returnflag not in ('R') group by l_suppkey),
    r as (
        select *, row_number() over (order by value desc, l_suppkey) as row_rank,
               sum(value) over (order by value desc, l_suppkey
                                rows between unbounded preceding and current row) as running,
               sum(value) over () as total
        from g)
    select l_suppkey, cast(value as bigint) as value, cast(line_count as bigint) as line_count,
           cast(row_rank as bigint) as row_rank, cast(running - value as bigint) as preceding,
           cast(value as double) / cast(total as double) as share
    from r where (running - value) * 100 < total * 99
""")
def coverage_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers that together hold 99 % of the value of lines that were not returned."""
    top = ops.coverage_topk(
        read_table(spark, folder, "lineitem"),
        "l_suppkey",
        scaled("l_extendedprice"),
        exclude=["R"],
        exclude_on="l_returnflag",
        measures={"line_count": F.count("*")},
    )
    return top.withColumn("preceding", F.col("preceding").cast("bigint")).drop("total")


@binding("""
    with w as (
        select l_partkey, sum(l_linenumber) as value,
               row_number() over (order by sum(l_linenumber) desc, l_partkey) as row_rank
        from lineitem group by l_partkey)
    select a.l_partkey, cast(max(a.value) as bigint) as value, cast(a.row_rank as bigint) as row_rank,
           cast(sum(b.value) as bigint) as running
    from w a join w b on b.row_rank <= a.row_rank
    group by a.l_partkey, a.row_rank
""")
def running_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Parts by line numbers with the sum so far; the SQL says it as a triangular self-join."""
    lines = read_table(spark, folder, "lineitem")
    ranked = ops.running_totals(lines, "l_partkey", "l_linenumber")
    return ranked.withColumn("running", F.col("running").cast("bigint")).drop("total")


@binding("""
    with newest as (
        select * from (
            select o_custkey, o_orderkey, o_orderdate,
                   row_number() over (partition by o_custkey
                                      order by o_orderdate desc, o_orderkey desc) as rn
            from orders) where rn = 1)
    select o_custkey, o_orderkey, o_orderdate, l_partkey, l_suppkey, l_linenumber, l_quantity
    from newest join lineitem on l_orderkey = o_orderkey
""")
def latest_per_group(spark: SparkSession, folder: str) -> DataFrame:
    """The newest order of every customer with its lines."""
    orders = read_table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    lines = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
    )
    return ops.latest_per_group(
        orders,
        "o_custkey",
        [F.desc("o_orderdate"), F.desc("o_orderkey")],
        facts=[(lines, ["o_orderkey"])],
    )


LINE_COLUMNS = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]


@binding("""
    select o_custkey, o_orderdate, o_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
           l_extendedprice
    from (
        select *, row_number() over (
            partition by o_custkey
            order by o_orderdate desc, o_orderkey desc, l_partkey, l_suppkey, l_linenumber,
                     l_quantity, l_extendedprice) as rn
        from orders join lineitem on l_orderkey = o_orderkey)
    where rn <= 5
""")
def recent_n(spark: SparkSession, folder: str) -> DataFrame:
    """The five newest order lines of every customer."""
    orders = read_table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    lines = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), *LINE_COLUMNS
    )
    return ops.recent_n(
        orders,
        [F.desc("o_orderdate"), F.desc("o_orderkey"), *LINE_COLUMNS],
        5,
        facts=[(lines, ["o_orderkey"])],
        scope=["o_custkey"],
    )


@binding("""
    with g as (
        select l_suppkey, sum(cast(round(l_extendedprice * 100) as bigint)) as value
        from lineitem where l_suppkey <> 99 group by l_suppkey)
    select l_suppkey, cast(value as bigint) as value,
           cast(row_number() over (order by value desc, l_suppkey) as bigint) as row_rank,
           cast(value as double) / cast(sum(value) over () as double) as share
    from g
""")
def share_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers by value with their share; one supplier is left out before rank and share."""
    ranked = ops.share_rank(
        read_table(spark, folder, "lineitem"),
        "l_suppkey",
        scaled("l_extendedprice"),
        exclude=[99],
    )
    return ranked.drop("total")


@binding("""
    select user_id, sample, event_id, ts, value from (
        select *, cast(row_number() over (partition by user_id
                                          order by ts desc, event_id desc) as integer) as sample
        from events) where sample <= 16
""")
def first_n_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The sixteen newest events of every user."""
    events = read_table(spark, folder, "events").select("user_id", "event_id", "ts", "value")
    return ops.first_n_samples(events, "user_id", [F.desc("ts"), F.desc("event_id")], 16)


@binding("""
    select l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
           row_number() over (partition by l_returnflag order by
               l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) as sample
    from lineitem
    qualify sample <= 1500
""")
def first_n_samples_many(spark: SparkSession, folder: str) -> DataFrame:
    """The first 1,500 lines of every return flag: far more than Spark cuts early."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    lines = read_table(spark, folder, "lineitem").select("l_returnflag", *order)
    return ops.first_n_samples(lines, "l_returnflag", order, 1500)


@binding("""
    with b as (
        select c_mktsegment, c_custkey, cast(c_acctbal as decimal(18,2)) as value from customer)
    select c_mktsegment, c_custkey, value,
           row_number() over (partition by c_mktsegment
               order by value desc, c_custkey) as row_rank,
           sum(value) over (partition by c_mktsegment order by value desc, c_custkey
               rows unbounded preceding) as running,
           sum(value) over (partition by c_mktsegment) as total
    from b
""")
def running_totals_decimal(spark: SparkSession, folder: str) -> DataFrame:
    """Running totals of balances with cents, some of them negative, per market segment."""
    balances = read_table(spark, folder, "customer").select(
        "c_mktsegment", "c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("balance")
    )
    return ops.running_totals(
        balances, "c_custkey", "balance", scope=["c_mktsegment"], one_row_per_key=True
    )


@binding("""
    select p_partkey, p_name, p_brand, line_count from (
        select l_partkey as p_partkey, count(*) as line_count from lineitem group by l_partkey)
    join part using (p_partkey)
    where line_count > 0
    order by line_count desc, p_name, p_partkey limit 50
""")
def top_volatile(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty parts with the most lines."""
    counted = ops.count_by(
        read_table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey")),
        "p_partkey",
        "p_partkey",
        alias="line_count",
    )
    parts = read_table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    return ops.top_volatile(
        counted, "line_count", ["p_name", "p_partkey"], 50, facts=[(parts, ["p_partkey"])]
    )


@binding("""
    with wide as (
        select user_id as c_custkey,
               sum(case when event_type like 'view%'
                        then cast(round(value * 100) as bigint) end) as numerator,
               sum(case when event_type like 'click%'
                        then cast(round(value * 100) as bigint) end) as denominator
        from events group by user_id)
    select c_custkey, c_name, cast(numerator as bigint) as numerator,
           cast(denominator as bigint) as denominator,
           cast(((2 * numerator * 100 + denominator) // (2 * denominator)) as decimal(18,2))
               as percent
    from customer join wide using (c_custkey)
    where numerator is not null and denominator > 0
""")
def counter_pair_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Views against clicks of every user, next to the customer's name."""
    customers = read_table(spark, folder, "customer").select("c_custkey", "c_name")
    counters = read_table(spark, folder, "events").select(
        "user_id", F.col("event_type").alias("counter_name"), scaled("value").alias("cntr_value")
    )
    return ops.counter_pair_ratio(
        customers, counters, ("c_custkey", "user_id"), "view", "click"
    )


@binding("""
    select user_id, event_type, count(value) as n from events group by user_id, event_type
""")
def count_by(spark: SparkSession, folder: str) -> DataFrame:
    return ops.count_by(read_table(spark, folder, "events"), ["user_id", "event_type"], "value")


@binding("""
    select cast(year(l_shipdate) as integer) as year, cast(month(l_shipdate) as integer) as month,
           cast((sum(rate) // count(rate)) // 1000000000 as bigint) as rate_avg,
           cast(min(rate) // 1000000000 as bigint) as rate_min,
           cast(max(rate) // 1000000000 as bigint) as rate_max
    from (
        select l_shipdate,
               (cast(round(l_extendedprice * 100) as hugeint) * 86400 * 1000000000)
                   // (date_diff('second', o_orderdate, l_shipdate) * 100) as rate
        from orders join lineitem on l_orderkey = o_orderkey
        where round(l_extendedprice * 100) * 86400 > 100000
          and date_diff('second', o_orderdate, l_shipdate) > 1)
    group by all
""")
def throughput_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """Value per day between order and shipping, per month of shipping."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    lines = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_shipdate"
    )
    return ops.throughput_by_month(
        orders.join(lines, "o_orderkey"),
        scaled("l_extendedprice") * F.lit(86400),
        "o_orderdate",
        "l_shipdate",
        min_size=100000,
        unit=100,
    )


@binding("""
    select c_custkey, c_name, count(o_orderkey) as n
    from customer left join orders on o_custkey = c_custkey and o_totalprice > 400000
    group by c_custkey, c_name
""")
def count_per_member(spark: SparkSession, folder: str) -> DataFrame:
    """Large orders per customer; most customers without one show 0."""
    return ops.count_per_member(
        read_table(spark, folder, "customer").select("c_custkey", "c_name"),
        read_table(spark, folder, "orders"),
        ("c_custkey", "o_custkey"),
        where=F.col("o_totalprice") > 400000,
    )


@binding("""
    with t as (
        select user_id, event_type, sum(cast(round(value * 100) as hugeint)) as total
        from events group by all),
    c as (select user_id, event_type, count(*) as n from events group by all)
    select user_id, event_type, cast(total as bigint) as total, n,
           cast(((2 * total * 10 + 1 + n) // (2 * (1 + n))) / 10.0 as decimal(18,1)) as average
    from t join c using (user_id, event_type)
""")
def smoothed_average(spark: SparkSession, folder: str) -> DataFrame:
    """Average event value per user and type, with 1 added to the count."""
    events = read_table(spark, folder, "events").select(
        "user_id", "event_type", scaled("value").alias("hundredths")
    )
    keys = ["user_id", "event_type"]
    totals = events.groupBy(*keys).agg(F.sum("hundredths").alias("total"))
    counts = ops.count_by(events, keys, "user_id")
    return ops.smoothed_average(totals, counts, keys, {"average": ("total", "n")})


@binding("""
    select cast(part_sum as decimal(38,0)) as part_sum, cast(total_sum as decimal(38,0)) as total_sum,
           cast(part_sum as double) / cast(total_sum as double) as part_ratio,
           cast(cast((2 * part_sum * 10000 + total_sum) // (2 * total_sum) as decimal(20,0))
                * 0.01 as decimal(20,2)) as part_percent,
           cast(cast((2 * (total_sum - part_sum) * 10000 + total_sum) // (2 * total_sum)
                     as decimal(20,0)) * 0.01 as decimal(20,2)) as rest_percent
    from (
        select sum(cast(round(l_extendedprice * 100) as hugeint)
                   * cast(round(l_discount * 100) as hugeint)) as part_sum,
               sum(cast(round(l_extendedprice * 100) as hugeint) * 100) as total_sum
        from lineitem where l_returnflag not in ('R', 'X'))
""")
def global_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """The part of the value of unreturned lines that went into discounts."""
    price = scaled("l_extendedprice")
    return ops.global_ratio(
        read_table(spark, folder, "lineitem"),
        price * scaled("l_discount"),
        price * F.lit(100),
        exclude=["R", "X"],
        exclude_on="l_returnflag",
    )


@binding("""
    select l_suppkey, count(*) as pages, count(*) * 8 / 1024.0::double as mb
    from lineitem where l_suppkey > 4 and l_suppkey <> 99 group by l_suppkey
""")
def pages_to_mb(spark: SparkSession, folder: str) -> DataFrame:
    return ops.pages_to_mb(
        read_table(spark, folder, "lineitem"),
        "l_suppkey",
        id_column="l_suppkey",
        excluded_id=99,
    )


@binding("""
    with s as (
        select event_id, user_id, ts, cast(round(value * 100) as bigint) as reading,
               lag(cast(round(value * 100) as bigint))
                   over (partition by user_id order by ts, event_id) as last
        from events)
    select event_id, user_id, ts, reading,
           case when reading < last then reading else reading - last end as reading_delta
    from s
""")
def counter_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Growth of every user's event value from event to event; a fall counts as a reset."""
    events = read_table(spark, folder, "events").select(
        "event_id", "user_id", "ts", scaled("value").alias("reading")
    )
    return ops.counter_delta(events, "user_id", ["ts", "event_id"], "reading")


@binding("""
    select distinct n_name, r_name
    from supplier
    cross join lateral (
        select n_name, r_name from nation join region on r_regionkey = n_regionkey
        where n_nationkey = s_nationkey)
""")
def distinct_lateral(spark: SparkSession, folder: str) -> DataFrame:
    """The nations and regions that have a supplier."""
    places = (
        read_table(spark, folder, "nation")
        .join(
            read_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        .select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    )
    return ops.distinct_lateral(
        read_table(spark, folder, "supplier"), places, "s_nationkey", ["n_name", "r_name"]
    )


@binding("""
    select p_partkey, s_suppkey, p_name, s_name, l_orderkey, l_linenumber,
           l_quantity * p_retailprice * (l_discount * 0.01::double) as advantage
    from part join lineitem on l_partkey = p_partkey join supplier on s_suppkey = l_suppkey
""")
def advantage_score(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as the bridge from parts to suppliers; quantity x price x discount."""
    parts = read_table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    lines = read_table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"),
        F.col("l_suppkey").alias("s_suppkey"),
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_discount",
    )
    suppliers = read_table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return ops.advantage_score(
        parts,
        lines,
        suppliers,
        "p_partkey",
        "s_suppkey",
        ["l_quantity", "p_retailprice", "l_discount"],
    ).drop("p_retailprice", "l_quantity", "l_discount")


@binding("""
    select c_nationkey as owner,
           cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as value
    from orders cross join lateral (
        select c_nationkey from customer where c_custkey = o_custkey)
    group by c_nationkey
""")
def lateral_attribute_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Order value per nation, the nation being one attribute of the customer."""
    attributes = (
        read_table(spark, folder, "customer")
        .select(
            F.col("c_custkey").alias("o_custkey"),
            F.col("c_nationkey").cast("string").alias("nation"),
            F.col("c_mktsegment").alias("segment"),
        )
        .unpivot("o_custkey", ["nation", "segment"], "attribute", "value")
    )
    return ops.lateral_attribute_rollup(
        read_table(spark, folder, "orders"),
        attributes,
        "o_custkey",
        "nation",
        scaled("o_totalprice"),
    )


@binding("""
    with members as (
        select o_orderkey, c_nationkey, o_orderstatus from orders
        join customer on c_custkey = o_custkey and (o_orderstatus = 'F' or o_orderstatus = 'P')
        union all
        select o_orderkey, c_nationkey, o_orderstatus from orders
        join customer on c_custkey = o_custkey and o_orderstatus = 'O')
    select n_name, c_nationkey, o_orderstatus, count(*) as n
    from lineitem join (
        select * from members left join nation on n_nationkey = c_nationkey) on l_orderkey = o_orderkey
    group by all
""")
def union_hierarchy_count(spark: SparkSession, folder: str) -> DataFrame:
    """Lines per nation and order status, orders coming from two branches."""
    orders = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("c_custkey"),
        "o_orderstatus",
    )
    customers = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    branches = [
        orders.where(F.col("o_orderstatus").isin(*states)).join(customers, "c_custkey")
        for states in (["F", "P"], ["O"])
    ]
    nations = read_table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name"
    )
    return ops.union_hierarchy_count(
        branches,
        nations,
        read_table(spark, folder, "lineitem").select("l_orderkey"),
        "c_nationkey",
        "l_orderkey",
        ["n_name", "c_nationkey", "o_orderstatus"],
    )


@binding("""
    select n_nationkey, n_name, n_regionkey, r_regionkey
    from nation join region on r_name = 'ASIA' where n_regionkey < r_regionkey
""")
def setting_breach(spark: SparkSession, folder: str) -> DataFrame:
    """Nations whose region number is below that of one named region."""
    return ops.setting_breach(
        read_table(spark, folder, "nation"),
        read_table(spark, folder, "region"),
        "ASIA",
        F.col("n_regionkey") < F.col("r_regionkey"),
        name_column="r_name",
        keep=["r_regionkey"],
    )


@binding("""
    select doc_id, lang, n_chars, quality, toxic, substring(text, 1, 87) as text
    from documents join labels using (doc_id)
""")
def dimension_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with their text shortened to 87 characters, as in a job listing."""
    return ops.dimension_listing(
        read_table(spark, folder, "documents").select("doc_id", "lang", "n_chars", "text"),
        read_table(spark, folder, "labels"),
        "doc_id",
        "text",
    )


@binding("""
    select l_orderkey, l_linenumber, l_quantity, o_orderpriority, c_name, n_regionkey
    from lineitem
    join orders on o_orderkey = l_orderkey
    join customer on c_custkey = o_custkey
    join nation on n_nationkey = c_nationkey
    where l_quantity > 30 and o_orderpriority is not null
""")
def detail_over_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Large lines with order priority, customer and region: a four-way join."""
    return ops.detail_over_threshold(
        read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"),
        read_table(spark, folder, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.col("o_custkey").alias("c_custkey"),
            "o_orderpriority",
        ),
        read_table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey"),
        read_table(spark, folder, "nation").select(
            F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"
        ),
        names_on=["l_orderkey"],
        parents_on=["c_custkey"],
        name="o_orderpriority",
        counts_name="n_name",
        counts_on=["c_nationkey"],
        where=F.col("l_quantity") > 30,
    ).drop("c_custkey", "c_nationkey")


@binding("""
    select c_custkey, c_name, max(o_orderdate) as last_update
    from customer left join orders on o_custkey = c_custkey group by c_custkey, c_name
""")
def last_update(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer with the date of the last order."""
    return ops.last_update(
        read_table(spark, folder, "customer").select("c_custkey", "c_name"),
        read_table(spark, folder, "orders"),
        [("c_custkey", "o_custkey")],
        "o_orderdate",
    )


@binding("""
    select p_partkey, p_partkey // 128 as block, cast(p_retailprice as decimal(18,2)) as price
    from part where p_type <> 'ECONOMY'
""")
def unit_projection(spark: SparkSession, folder: str) -> DataFrame:
    return ops.unit_projection(
        read_table(spark, folder, "part"),
        {
            "p_partkey": "p_partkey",
            "block": whole_div("p_partkey", 128),
            "price": F.col("p_retailprice").cast("decimal(18,2)"),
        },
        where=F.col("p_type") != "ECONOMY",
    )


@binding("""
    select s_suppkey, s_name, s_nationkey from supplier
    where s_nationkey > 4 and s_nationkey <> 20 or s_nationkey = 2
""")
def scoped_listing(spark: SparkSession, folder: str) -> DataFrame:
    return ops.scoped_listing(
        read_table(spark, folder, "supplier"),
        "s_nationkey",
        {c: c for c in ("s_suppkey", "s_name", "s_nationkey")},
        excluded_id=20,
    )


@binding("""
    select lang, source, text from documents group by lang, source, text
""")
def drop_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct documents by language, source and whole text."""
    return ops.drop_exact_duplicates(
        read_table(spark, folder, "documents"), ["lang", "source", "text"]
    )


@binding("""
    select event_id, case cast(props ->> '$.k' as integer)
                         when 0 then 'never' else (props ->> '$.k') end as value
    from events
""")
def key_value_pick(spark: SparkSession, folder: str) -> DataFrame:
    """Field k of every event's properties, 0 shown as a label."""
    k = F.from_json("props", "k int")["k"]
    return ops.key_value_pick(
        read_table(spark, folder, "events"), None, k, 0, "never", keep=["event_id"]
    )


@binding("""
    select c_mktsegment, o_orderkey, o_orderdate, l_linenumber,
           cast(trunc(l_quantity) as bigint) // 8 as quantity_units,
           cast(round(l_extendedprice * 100) as bigint) // 100000 as price_units
    from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey
""")
def size_history(spark: SparkSession, folder: str) -> DataFrame:
    """Line sizes in whole units over time, per market segment."""
    customers = read_table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    orders = read_table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate"
    )
    lines = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity", "l_extendedprice"
    )
    return ops.size_history(
        customers.join(orders, "c_custkey"),
        lines,
        "o_orderkey",
        {
            "quantity_units": (F.col("l_quantity").cast("bigint"), 8),
            "price_units": (scaled("l_extendedprice"), 100000),
        },
        ["c_mktsegment", "o_orderkey", "o_orderdate", "l_linenumber"],
    )


@binding("""
    select p_partkey, p_name, p_type, p_retailprice from part
    where p_name like '%ring%' and p_type = 'ECONOMY'
""")
def gauge(spark: SparkSession, folder: str) -> DataFrame:
    return ops.gauge(
        read_table(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_retailprice"),
        "ring",
        "ECONOMY",
        object_column="p_name",
        counter_column="p_type",
    )


@binding("""
    select 'In debt' as label, 'Supplier: [' || rtrim(s_name) || ']' as details
    from supplier where s_acctbal < 0 and s_name <> 'Supplier#000000000'
""")
def flagged_members(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers with a negative balance."""
    return ops.flagged_members(
        read_table(spark, folder, "supplier"),
        F.col("s_acctbal") < 0,
        "s_name",
        "In debt",
        exclude="Supplier#000000000",
        pattern=("Supplier: [", "]"),
    )


@binding("""
    with kinds as (select distinct event_type, upper(event_type) as name from events)
    select event_id, ts, name, cast(floor(value) as bigint) * 8 / 1024.0::double as growth_mb,
           (event_id * 7) // 1000 as dur_ms
    from events join kinds using (event_type) where event_type in ('error', 'purchase')
""")
def rollover_events(spark: SparkSession, folder: str) -> DataFrame:
    """Two classes of events from the event file and whatever it rolled over to."""
    rows = rollover_rows(spark, f"{folder}/events.parquet", schema=TABLES["events"]).select(
        "event_id",
        "ts",
        F.col("event_type").alias("EventClass"),
        F.floor("value").alias("IntegerData"),
        (F.col("event_id") * 7).alias("duration"),
    )
    kinds = (
        read_table(spark, folder, "events")
        .select(F.col("event_type").alias("trace_event_id"))
        .distinct()
        .withColumn("name", F.upper("trace_event_id"))
    )
    return ops.rollover_events(rows, ["error", "purchase"], kinds).select(
        "event_id", "ts", "name", "growth_mb", "dur_ms"
    )


@binding("""
    with kinds as (select distinct event_type, upper(event_type) as name from events)
    select event_id, name, cast(floor(value) as bigint) * 8 / 1024.0::double as growth_mb,
           'trace' || ['', '_1', '_2', '_10'][event_id % 4 + 1] || '.parquet' as file,
           cast(nullif([0, 1, 2, 10][event_id % 4 + 1], 0) as bigint) as rollover
    from events join kinds using (event_type) where event_type in ('error', 'purchase')
""")
def rolled_over_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a set of files that is found by itself, among files of other sets.

    All events are written as one file that rolled over three times, beside older files with
    similar names; the set is read back from the folder alone."""
    events = read_table(spark, folder, "events")
    traces = scratch_folder(spark)
    for stranger, number in (("audit", 7), ("trace_old", 3), ("trace_2x", 0)):
        write_rollover(events.where("event_type = 'error'"), F.lit(number), traces, stranger)
    numbers = F.element_at(F.array(*map(F.lit, (0, 1, 2, 10))), (F.col("event_id") % 4 + 1).cast("int"))
    write_rollover(events, numbers, traces, "trace")
    rows = latest_rollover_rows(spark, traces, schema=TABLES["events"]).select(
        "event_id",
        F.col("event_type").alias("EventClass"),
        F.floor("value").alias("IntegerData"),
        F.lit(0).alias("duration"),
        F.element_at(F.split("source_file", "/"), -1).alias("file"),
        F.col("rollover").cast("bigint").alias("rollover"),
    )
    kinds = events.select(F.col("event_type").alias("trace_event_id")).distinct()
    kinds = kinds.withColumn("name", F.upper("trace_event_id"))
    return ops.rollover_events(rows, ["error", "purchase"], kinds).select(
        "event_id", "name", "growth_mb", "file", "rollover"
    )


@binding("""
    with lines as (
        select event_type, event_id || ' ' || props as line,
               row_number() over (partition by event_type order by ts, event_id) - 1 as line_no
        from events)
    select event_type, line_no, line from lines where line like '%7%'
""")
def log_file_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with a term and their numbers, from text files that several tasks read.

    All events are written as one log per type, of several files if it is long; splits are a sixth of the usual size or less, so
    even these files are several splits each."""
    logs = scratch_folder(spark)
    events = read_table(spark, folder, "events")
    line = F.concat_ws(" ", F.col("event_id").cast("string"), "props")
    write_logs(events, line, [F.col("ts"), F.col("event_id")], "event_type", logs)
    found = numbered_log_lines(spark, logs, "7", split_bytes=16 << 10, continued=True)
    return found.select("event_type", "line_no", "line")


@binding("""
    select event_type, row_number() over (partition by event_type order by ts, event_id) - 1 as record,
           event_id, user_id, case when event_id % 5 > 0 then props end as props
    from events
""")
def command_records(spark: SparkSession, folder: str) -> DataFrame:
    """Events printed as blocks of several lines and put together again, over small splits."""
    printed = scratch_folder(spark)
    events = read_table(spark, folder, "events")
    props = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("  Props = "), "props"))
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("EVENT HEADER @"), F.col("event_id")),
        F.concat(F.lit("  User = "), F.col("user_id")),
        props,
        F.lit("  ----"),
    )
    write_logs(events, block, [F.col("ts"), F.col("event_id")], "event_type", printed)
    fields = {"event_id": "^EVENT HEADER @(.*)$", "user_id": "^  User = (.*)$", "props": "^  Props = (.*)$"}
    found = block_records(spark, printed, "^EVENT HEADER @", fields, split_bytes=16 << 10, continued=True)
    number = [F.col(c).cast("bigint").alias(c) for c in ("event_id", "user_id")]
    return found.select("event_type", "record", *number, "props")


@binding("""
    select event_id, cast(props ->> '$.k' as integer) as k,
           100 - cast(props ->> '$.k' as integer) as rest,
           ts - to_milliseconds(1000000 - event_id) as event_time
    from events where props like '%"k"%'
    order by ts desc, event_id desc limit 256
""")
def payload_history(spark: SparkSession, folder: str) -> DataFrame:
    """The newest 256 event payloads taken apart, their time set back by a tick difference."""
    return ops.payload_history(
        read_table(spark, folder, "events"),
        "props",
        F.from_json("props", "k int"),
        {"k": F.col("parsed.k"), "rest": F.lit(100) - F.col("parsed.k")},
        [F.desc("ts"), F.desc("event_id")],
        must_contain='"k"',
        event_time=shift_millis("ts", -(F.lit(1000000) - F.col("event_id"))),
        keep=["event_id", "ts"],
    ).drop("ts")


@binding("""
    with lines as (
        select doc_id, unnest(string_split(text, chr(10))) as line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no
        from documents)
    select doc_id, cast(line_no as integer) as line_no, line from lines
    where line like '%the of%'
""")
def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Document lines that contain a term."""
    return ops.log_lines(read_table(spark, folder, "documents"), "text", "the of", keep=["doc_id"])


@binding("""
    select cast(s_suppkey as varchar) as s_suppkey, rtrim(substring(s_name, 1, 12)) as s_name,
           cast(s_nationkey as varchar) as s_nationkey
    from supplier
""")
def render_text_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as cut strings."""
    suppliers = read_table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return render_text(suppliers, {"s_name": 12})


@binding("""
    select c_custkey, c_name, o_orderkey, o_totalprice
    from customer, lateral (
        select o_orderkey, o_totalprice from orders where o_custkey = c_custkey
        order by o_totalprice desc, o_orderkey limit 3)
""")
def lateral_top(spark: SparkSession, folder: str) -> DataFrame:
    """The three dearest orders of every customer that has any."""
    return ops.lateral_top(
        read_table(spark, folder, "customer").select("c_custkey", "c_name"),
        read_table(spark, folder, "orders"),
        {"c_custkey": "o_custkey"},
        ["o_orderkey", "o_totalprice"],
        [F.desc("o_totalprice"), F.asc("o_orderkey")],
        3,
    )


@binding("""
    select p_partkey, p_name, l_orderkey, l_linenumber, l_quantity
    from part, lateral (
        select l_orderkey, l_linenumber, l_quantity from lineitem
        where l_partkey = p_partkey and l_quantity > p_size and l_returnflag = 'R')
""")
def lateral_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Returned lines of every part in a quantity above the part's size."""
    larger = (F.col("l_quantity") > F.col("p_size").outer()) & (F.col("l_returnflag") == "R")
    found = ops.lateral_rows(
        read_table(spark, folder, "part").select("p_partkey", "p_name", "p_size"),
        read_table(spark, folder, "lineitem"),
        {"p_partkey": "l_partkey"},
        ["l_orderkey", "l_linenumber", "l_quantity"],
        where=larger,
    )
    return found.drop("p_size")


@binding("""
    select p_partkey, line_count, quantity
    from part, lateral (
        select count(*) as line_count, cast(sum(l_linenumber) as bigint) as quantity
        from lineitem where l_partkey = p_partkey and l_shipdate >= timestamp '1997-01-01')
""")
def lateral_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Late lines of every part, parts without any as well."""
    return ops.lateral_summary(
        read_table(spark, folder, "part").select("p_partkey"),
        read_table(spark, folder, "lineitem"),
        {"p_partkey": "l_partkey"},
        {"line_count": F.count("*"), "quantity": F.sum("l_linenumber")},
        where=F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"),
    )


@binding("""
    with days as (
        select distinct cast(date_trunc('quarter', o_orderdate) as date) as day from orders
        where o_totalprice > 450000 and o_orderpriority = '1-URGENT')
    select 'db' || o_custkey as database_name, o_orderkey as backup_set_id,
           cast(date_trunc('quarter', o_orderdate) as date) as taken
    from orders where o_orderstatus = 'F'
      and cast(date_trunc('quarter', o_orderdate) as date) in (select day from days)
""")
def snapshot_store(spark: SparkSession, folder: str) -> DataFrame:
    """Full backups on the days of a filtered table, from a store by day and type.

    All orders are written as backups of quarterly snapshots and read back; only the folders of one
    type and of days the other table names are opened."""
    orders = read_table(spark, folder, "orders")
    quarter = F.date_trunc("quarter", "o_orderdate")
    backups = orders.select(
        F.concat(F.lit("srv"), F.col("o_custkey") % 5).alias("server_name"),
        quarter.cast("timestamp_ntz").alias("snapshot_ts"),
        F.concat(F.lit("db"), F.col("o_custkey")).alias("database_name"),
        F.col("o_orderkey").alias("backup_set_id"),
        F.when(F.col("o_orderstatus") == "F", "D").otherwise("L").alias("type"),
    )
    store = scratch_folder(spark)
    write_snapshots(backups, store, "backupset")
    days = orders.where("o_totalprice > 450000 and o_orderpriority = '1-URGENT'")
    days = days.select(F.to_date(quarter).alias("snapshot_date"))
    found = read_snapshots(spark, store, "backupset", days_of=days, where=F.col("type") == "D")
    return found.select("database_name", "backup_set_id", F.to_date("snapshot_ts").alias("taken"))
