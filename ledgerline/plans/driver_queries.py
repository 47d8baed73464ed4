"""Each operator applied to the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import projection, stats, text
from ..operators import lines, match, pareto, reshape, scans, status

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a query; its function gets t(name), which reads a table."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""select c_nationkey, n_name, count(c_acctbal) as n, round(avg(c_acctbal), 6) as mean
    from customer join nation on c_nationkey = n_nationkey group by all""")
def tract_count_mean(t):
    rows = stats.count_mean(t("customer"), ["c_nationkey"], "c_acctbal")
    names = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return match.lookup(rows, names, "c_nationkey").select("c_nationkey", "n_name", "n", F.round("mean", 6).alias("mean"))


@query("""select p_partkey, label from part left join (select distinct p_size, 'size ' || p_size as label from part where p_size % 3 = 0) using (p_size)""")
def lookup_left_null(t):
    dim = t("part").filter("p_size % 3 = 0").select("p_size", F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("label")).distinct()
    return match.lookup(t("part"), dim, "p_size").select("p_partkey", "label")


@query("""select p_partkey, p_type, code, first_part from part join
    (select p_type, length(p_type)::bigint as code, min(p_partkey) as first_part from part group by p_type) using (p_type)""")
def distinct_backmap(t):
    part = t("part")
    keys = match.distinct_keys(part, "p_type", ["p_partkey"])
    resolved = keys.select("p_type", F.length("p_type").cast("long").alias("code"), F.col("first_seen.p_partkey").alias("first_part"))
    return match.lookup(part, resolved, "p_type", strict=True).select("p_partkey", "p_type", "code", "first_part")


@query("""select case s_nationkey when 1 then 100 when 2 then 100 when 3 then 103 else s_nationkey end::int as id, round(coalesce(sum(s_acctbal), 0), 2) as total from supplier group by 1""")
def recode_collapse_sum(t):
    rows = reshape.recode(t("supplier").withColumn("id", F.col("s_nationkey")), "id", {1: 100, 2: 100, 3: 103})
    return reshape.collapse_sum(rows, ["id"], ["s_acctbal"]).select("id", F.round("s_acctbal", 2).alias("total"))


@query("""select count(*) as n, count(text) as n_text, count(quality) as n_quality, count(toxic) as n_toxic from documents left join labels using (doc_id)""")
def count_nonnull(t):
    both = match.lookup(t("documents"), t("labels"), "doc_id")
    return both.agg(F.count("*").alias("n"), F.count("text").alias("n_text"), F.count("quality").alias("n_quality"), F.count("toxic").alias("n_toxic"))


@query("""select coalesce(a.k, b.k) as k, a.name, b.orders, case when a.k is null then 2 when b.k is null then 1 else 3 end::int as merge
    from (select c_custkey as k, c_name as name from customer where c_nationkey < 20) a
    full join (select o_custkey as k, count(*) as orders from orders where o_totalprice > 250000 group by 1) b on a.k = b.k""")
def merge_indicator(t):
    left = t("customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    right = t("orders").filter("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    return reshape.merge(left, right, ["k"])


@query("""select c_custkey as k, c_name as name, o.orders from customer join (select o_custkey, count(*) as orders from orders group by 1) o on c_custkey = o_custkey where c_nationkey < 20""")
def merge_matched(t):
    left = t("customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    right = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    return reshape.matched(left, right, ["k"], check=True)


@query("""select c_custkey, c_name, c_acctbal, null::bigint as s_suppkey, null::varchar as s_name from customer
    union all by name select s_suppkey, s_name, s_acctbal as c_acctbal, null::bigint as c_custkey, null::varchar as c_name from supplier""")
def append_missing_cols(t):
    return reshape.append(t("customer").select("c_custkey", "c_name", "c_acctbal"), t("supplier").select("s_suppkey", "s_name", F.col("s_acctbal").alias("c_acctbal")))


WIDE = """select l_shipmode_year, sum(case when l_returnflag = 'A' then l_quantity end) as q_A, sum(case when l_returnflag = 'N' then l_quantity end) as q_N, sum(case when l_returnflag = 'R' then l_quantity end) as q_R
    from (select year(l_shipdate)::int as l_shipmode_year, * from lineitem) group by 1"""


def _wide(t):
    rows = t("lineitem").groupBy(F.year("l_shipdate").alias("l_shipmode_year"), "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return reshape.wider(rows, ["l_shipmode_year"], "l_returnflag", "q", ["A", "N", "R"], "q_")


@query(WIDE)
def pivot_wide(t):
    return _wide(t)


@query(f"""with w as ({WIDE}) select l_shipmode_year, 'A' as flag, q_A as q_ from w union all select l_shipmode_year, 'N', q_N from w union all select l_shipmode_year, 'R', q_R from w""")
def unpivot_long(t):
    return reshape.longer(_wide(t), ["l_shipmode_year"], ["q_"], ["A", "N", "R"], "flag")


@query("""select o_orderkey, o_totalprice from orders where o_totalprice is not null order by o_totalprice desc, o_orderkey limit 50""")
def topk_cities(t):
    return reshape.top_rows(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 50)


@query("""select year, sum(n) over (order by year)::bigint as sum_active from (select year(o_orderdate)::int as year, count(*) as n from orders group by 1)""")
def cumulative_active(t):
    return reshape.cumulative_by_year(t("orders").select(F.year("o_orderdate").alias("year")), "year")


@query("""select y.year, last_value(c.sum_active ignore nulls) over (order by y.year)::bigint as sum_active from (select unnest(range(1990, 2011))::int as year) y
    left join (select year, sum(n) over (order by year) as sum_active from (select year(o_orderdate)::int as year, count(*) as n from orders where year(o_orderdate) % 2 = 0 group by 1)) c on c.year = y.year""")
def filled_years(t):
    orders = t("orders")
    counts = reshape.cumulative_by_year(orders.select(F.year("o_orderdate").alias("year")).filter("year % 2 = 0"), "year")
    years = orders.sparkSession.range(1990, 2011).select(F.col("id").cast("int").alias("year"))
    return reshape.filled_years(counts, years, "year", ["sum_active"])


@query("""select event_id, coalesce(last_value(case when event_type = 'error' then value end ignore nulls) over (order by ts::date, ts, event_id rows unbounded preceding), -1) as value from events""")
def forward_fill(t):
    rows = t("events").select("event_id", "ts", F.to_date("ts").alias("day"), F.when(F.col("event_type") == "error", F.col("value")).alias("value"))
    return lines.forward_fill(rows, ["value"], ["day", "ts", "event_id"], -1.0).select("event_id", "value")


@query("""with g as (select *, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as grp from events)
    select user_id, min(event_id) as line_idx, string_agg(case when event_type = 'view' then event_type else event_type || ' ' end, '' order by ts, event_id) as content from g where grp > 0 group by user_id, grp""")
def header_merge(t):
    """Each user's events as a column of lines: a signup is a line of its own, the rest are indented; 'view' stands for a line that ends in a hyphen."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    word = F.when(F.col("event_type") == "view", F.lit("view-")).otherwise(F.col("event_type"))
    rows = t("events").select(
        F.lit(0).alias("page_idx"), F.col("user_id").alias("col_idx"), F.struct(F.row_number().over(order).alias("n"), "event_id").alias("line_idx"),
        word.alias("content"), F.when(F.col("event_type") == "signup", lines.ENTRY).otherwise(lines.INDENTED).alias("linetype"),
    )
    merged = lines.merge_indented(rows)
    return merged.select(F.col("col_idx").alias("user_id"), F.col("line_idx.event_id").alias("line_idx"), F.replace("content", F.lit("view-"), F.lit("view")).alias("content"))


# The first event of a group has the least place, not always the least id.
SQL["header_merge"] = SQL["header_merge"].replace("min(event_id) as line_idx", "arg_min(event_id, (ts, event_id)) as line_idx")


@query("""with b as (select c_nationkey as id, floor(c_acctbal / 2000)::bigint as bracket, count(*)::double as n, min(c_acctbal) - 1 as lower, sum(c_acctbal) as wealth from customer where c_acctbal > 0 group by 1, 2),
    a as (select *, wealth / n as average, lead(lower) over (partition by id order by bracket) as upper from b)
    select id, bracket, round(average, 6) as average, case when average > lower and (upper is null or average < upper) then 0 else 1 end::int as error from a""")
def lead_consistency(t):
    b = t("customer").filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("id"), F.floor(F.col("c_acctbal") / 2000).alias("bracket"))
    rows = b.agg(F.count("*").cast("double").alias("n"), (F.min("c_acctbal") - 1).alias("lower"), F.sum("c_acctbal").alias("wealth"))
    out = pareto.consistent(rows.withColumn("average", F.col("wealth") / F.col("n")))
    return out.select("id", "bracket", F.round("average", 6).alias("average"), "error")


PRICE_BRACKETS = """select o_custkey % 5 as id, least(floor(o_totalprice / 40000), 12)::bigint as bracket, count(*)::double as n, min(o_totalprice) as lower, sum(o_totalprice) as wealth from orders group by 1, 2"""


def _price_brackets(t):
    b = t("orders").groupBy((F.col("o_custkey") % 5).alias("id"), F.least(F.floor(F.col("o_totalprice") / 40000), F.lit(12)).alias("bracket"))
    return b.agg(F.count("*").cast("double").alias("n"), F.min("o_totalprice").alias("lower"), F.sum("o_totalprice").alias("wealth"))


@query(f"""with b as ({PRICE_BRACKETS}) select id, bracket, n, round(1 - sum(n) over (partition by id order by bracket desc) / sum(n) over (partition by id), 9) as p, round(wealth / n, 4) as average from b""")
def reverse_cum_p(t):
    return pareto.positions(_price_brackets(t)).select("id", "bracket", "n", F.round("p", 9).alias("p"), F.round("average", 4).alias("average"))


TAX = """with o as (select c_nationkey as id, o_totalprice as v, least(floor(o_totalprice / 35000), 12)::int + 1 as k from orders join customer on c_custkey = o_custkey),
    w as (select id, count(*)::double as N_people, avg(v) / 40 as income, (count(*) filter (k = 13))::double as N_people_income_tax, (count(*) filter (k = 1 and v < 9000))::double as ex,
        """ + ", ".join(f"(count(*) filter (k = {k} and v >= 9000))::double / 2 as c{k}" for k in range(1, 13)) + """ from o group by id),
    a as (select *, """ + " + ".join(f"c{k}" for k in range(1, 13)) + """ as units_class, """ + " + ".join(f"c{k} * {m}" for k, m in enumerate(pareto.MIDPOINT, 1)) + """ as income_class from w),
    b as (select *, ex / nullif((N_people - N_people_income_tax - ex) / nullif(units_class, 0), 0) as units_exempt, N_people_income_tax * (25200 / 82062) as units_income from a),
    c as (select *, case when units_income = 0 then 0 else N_people * income - income_class - units_exempt * 150 end as income_tax from b) """
TAX_SQL = TAX + """select id, round(units_class, 6) as units_class, round(units_exempt, 6) as units_exempt, round(units_income, 6) as units_income, round(income_tax, 4) as income_tax,
        round((income_tax + income_class + units_exempt * 150) / nullif(units_exempt + units_class + units_income, 0), 4) as mean_income from c"""


def _tax(t):
    both = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    o = both.select(F.col("c_nationkey").alias("id"), F.col("o_totalprice").alias("v"), (F.least(F.floor(F.col("o_totalprice") / 35000), F.lit(12)) + 1).alias("k"))
    count = lambda cond: F.count_if(F.expr(cond)).cast("double")
    empty = [F.lit(None).cast("double").alias(c) for c in pareto.EXEMPT[1:]]
    return o.groupBy("id").agg(
        F.count("*").cast("double").alias("N_people"), (F.avg("v") / 40).alias("income"), count("k = 13").alias("N_people_income_tax"), count("k = 1 and v < 9000").alias(pareto.EXEMPT[0]),
        *((count(f"k = {k} and v >= 9000") / 2).alias(f"tax_class_{k}") for k in range(1, 13)),
    ).select("*", *empty)


@query(TAX_SQL)
def tax_units(t):
    u = pareto.tax_units(_tax(t))
    return u.select("id", *(F.round(c, 6).alias(c) for c in ("units_class", "units_exempt", "units_income")), *(F.round(c, 4).alias(c) for c in ("income_tax", "mean_income")))


@query(TAX + "select id, bracket, round(n, 6) as n, lower, round(wealth, 6) as wealth from (select id, unnest(range(1, 14))::int as bracket, unnest(["
    + ", ".join(f"c{k}" for k in range(1, 13)) + ", units_income]) as n, unnest([" + ", ".join(f"{x}.0" for x in pareto.LOWER) + "])::double as lower, unnest(["
    + ", ".join(f"c{k} * {m}" for k, m in enumerate(pareto.MIDPOINT, 1)) + ", income_tax]) as wealth from c)")
def bracket_tabulation(t):
    rows = pareto.bracket_rows(pareto.tax_units(_tax(t)))
    return rows.select("id", "bracket", F.round("n", 6).alias("n"), "lower", F.round("wealth", 6).alias("wealth"))


def _share_sql(position: str) -> str:
    return f"""with r as (select c_nationkey as id, o_totalprice as v, row_number() over (partition by c_nationkey order by o_totalprice) as pos, count(*) over (partition by c_nationkey) as n from orders join customer on c_custkey = o_custkey)
    select id, q::int as q, round(case when n > 100 then sum(case when {position} >= q / 100 then v else 0 end) / sum(v) end, 6) as share from r, (select unnest(range(30, 100))::double as q) group by id, q, n"""


def _shares(t, float32):
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("id"), F.col("o_totalprice").alias("v"))
    return stats.top_shares(rows, "id", "v", float32=float32).select("id", "q", F.round("share", 6).alias("share"))


@query(_share_sql("pos / n"))
def top_share(t):
    return _shares(t, False)


@query(_share_sql("(pos / n)::float::double"))
def top_share_f32(t):
    return _shares(t, True)


@query("""with r as (select l_returnflag as flag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2 as a,
    rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2 as b from lineitem where l_quantity is not null and l_extendedprice is not null)
    select flag, round(corr(a, b), 6) as rho from r group by flag""")
def spearman(t):
    rows = t("lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity", "l_extendedprice")
    return stats.spearman(rows, "l_quantity", "l_extendedprice", ["flag"]).select("flag", F.round("rho", 6).alias("rho"))


@query("""select l_returnflag as flag, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept from (select l_returnflag,
    case when l_extendedprice > 0 then ln(l_extendedprice) end as y, case when l_quantity > 0 then ln(l_quantity) end as x from lineitem) group by 1""")
def ols_fit(t):
    rows = t("lineitem").withColumn("flag", F.col("l_returnflag"))
    fit = stats.ols(rows, stats.safe_ln(F.col("l_extendedprice")), stats.safe_ln(F.col("l_quantity")), ["flag"])
    return fit.select("flag", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("""with f as (select o_orderpriority as p, regr_slope(o_totalprice, o_custkey) as s, regr_intercept(o_totalprice, o_custkey) as i from orders group by 1)
    select o_orderpriority, o_custkey, o_totalprice, round(i + s * o_custkey, 4) as fit from orders join f on p = o_orderpriority""")
def fitted_points(t):
    rows = stats.fitted(t("orders"), "o_totalprice", "o_custkey", ["o_orderpriority"])
    return rows.select("o_orderpriority", "o_custkey", "o_totalprice", F.round("fit", 4).alias("fit"))


@query("""select doc_id, coalesce(n_chars > avg(n_chars) over (partition by lang) + 3 * stddev_pop(n_chars) over (partition by lang), false) as tall from documents""")
def outlier_flag(t):
    """Documents as lines whose height is their length, languages as columns: the tall ones are headings."""
    none = F.lit(None).cast("string").alias("street")
    rows = t("documents").select("doc_id", F.lit(0).alias("page_idx"), F.col("lang").alias("col_idx"), F.lit("x").alias("content"), F.col("n_chars").alias("bbox_height"), F.lit(lines.ENTRY).alias("linetype"), none)
    return lines.tag_street_names(rows).select("doc_id", (F.col("linetype") == lines.STREET).alias("tall"))


@query("""with m as (select l_returnflag, l_linestatus, median(l_extendedprice) + stddev_pop(l_extendedprice) as lim from lineitem group by 1, 2)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_extendedprice > lim then 'INDENTED_ENTRY' else 'ENTRY' end as linetype from lineitem join m using (l_returnflag, l_linestatus)""")
def indent_flag(t):
    rows = t("lineitem").select(
        F.col("l_returnflag").alias("page_idx"), F.col("l_linestatus").alias("col_idx"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("minx"), F.lit(lines.ENTRY).alias("linetype")
    )
    return lines.tag_indented(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "linetype")


@query("""select token, count(*) as n from (select unnest(regexp_extract_all(text, '[.,&]|[^ .,&]+')) as token from documents) group by token""")
def tokenize_counts(t):
    return t("documents").select(F.explode(text.tokenize("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


NUMBERED_SQL = r"(c_custkey % 40)::varchar || case when c_custkey % 3 = 0 then 'a' else '' end || case when c_custkey % 7 = 0 then '. ' else ' ' end || c_name || ' ' || (c_custkey % 40)::varchar"


@query(rf"""with r as (select c_custkey, case when c_custkey % 5 = 0 then c_name else {NUMBERED_SQL} end as s from customer), n as (select *, regexp_extract(s, '^(?:[ .,;—-]|[\p{{Nd}}²³¹]\p{{L}}?)+') as x from r)
    select c_custkey, case when regexp_matches(x, '[\p{{Nd}}²³¹]') then x end as number, case when regexp_matches(x, '[\p{{Nd}}²³¹]') then replace(s, x, '') else s end as content from n""")
def leading_number(t):
    n = (F.col("c_custkey") % 40).cast("string")
    made = F.concat(n, F.when(F.col("c_custkey") % 3 == 0, "a").otherwise(""), F.when(F.col("c_custkey") % 7 == 0, ". ").otherwise(" "), F.col("c_name"), F.lit(" "), n)
    rows = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(made).alias("content"), F.lit(None).cast("string").alias("number"), F.lit(lines.ENTRY).alias("linetype"))
    return lines.tag_street_numbers(rows).select("c_custkey", "number", "content")


@query(r"""select conv_id, turn, regexp_replace(regexp_replace(text, '\.+$', ''), '^\s+|\s+$', '', 'g') as clean from conversations""")
def sanitize_text(t):
    return t("conversations").select("conv_id", "turn", text.sanitize("text").alias("clean"))


@query("""with a as (select *, case when lag(event_type) over w is distinct from event_type then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
    b as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from a)
    select user_id, run::int as run, min(event_type) as label, count(*) as n from b group by user_id, run qualify run < max(run) over (partition by user_id)""")
def label_runs(t):
    """Runs of one type of event of a user; the last run, which nothing ends, is not there."""
    return scans.runs(t("events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""select user_id, arg_min(event_type, (-n, event_type)) as event_type from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1""")
def mode_code(t):
    return status.modal_code(t("events"), "user_id", "event_type")


@query("""select copies, count(*) * copies as observations, count(*) * (copies - 1) as surplus from (select count(*) as copies from documents group by text) group by copies""")
def duplicates_report(t):
    return reshape.duplicates(t("documents"), ["text"])


@query("""with c as (select quality::varchar as gold, toxic::varchar as predicted, count(*) as n from labels group by 1, 2), s as (select gold as label, sum(n) as support from c group by 1), g as (select predicted as label, sum(n) as given from c group by 1),
    h as (select gold as label, n as hit from c where gold = predicted), r as (select label, coalesce(support, 0) as support, coalesce(given, 0) as given, coalesce(hit, 0) as hit from s full join g using (label) left join h using (label)),
    p as (select label, support::bigint as support, coalesce(hit / nullif(given, 0), 0) as precision, coalesce(hit / nullif(support, 0), 0) as recall from r)
    select label, support, round(precision, 9) as precision, round(recall, 9) as recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) as f1 from p""")
def token_prf(t):
    rows = t("labels").select(F.col("quality").cast("string").alias("gold"), F.col("toxic").cast("string").alias("predicted"))
    out = stats.precision_recall(rows, "gold", "predicted")
    return out.select("label", "support", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("""select page_id, len(regexp_extract_all(html, '>([0-9]{5})<', 1))::int as n, list_sort(regexp_extract_all(html, '>([0-9]{5})<', 1))[1] as least from pages""")
def html_codes(t):
    codes = text.html_codes("html")
    return t("pages").select("page_id", F.size(codes).alias("n"), F.array_min(codes).alias("least"))


@query("""select event_id, (json_extract(props, '$.k'))::int as k from events""")
def json_props(t):
    return t("events").select("event_id", text.json_value("props", "$.k", "int").alias("k"))


BOXES = [(k, x / 10, y / 10, x / 10 + 0.15, y / 10 + 0.15) for k, (x, y) in enumerate((x, y) for x in range(-3, 3) for y in range(-3, 3))]


@query("""with z as (select * from (values """ + ", ".join(f"({k}, {a}, {b}, {c}, {d})" for k, a, b, c, d in BOXES) + """) z(id, a, b, c, d))
    select vec_id, min(id)::int as zone from (select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings) left join z on x > a and x < c and y > b and y < d group by vec_id""")
def point_in_box(t):
    e = t("embeddings")
    points = e.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    zones = e.sparkSession.createDataFrame([(k, k, [(a, b), (c, b), (c, d), (a, d)]) for k, a, b, c, d in BOXES], "id int, zone_idx int, ring array<struct<x: double, y: double>>")
    return match.within_first(points, zones, "x", "y").select("vec_id", "zone")


# Stars of 24 corners about the places of a grid, every third of them large; they overlap.
STARS = [
    (k, [(round(x / 4 + r * (1 if c % 2 else 0.4) * math.cos(c * math.pi / 12), 6), round(y / 4 + r * (1 if c % 2 else 0.4) * math.sin(c * math.pi / 12), 6)) for c in range(24)])
    for k, (x, y, r) in enumerate((x, y, 0.3 if (x + y) % 3 else 0.07) for x in range(-2, 3) for y in range(-2, 3))
]


@query("""with sides as (select * from (values """ + ", ".join(f"({k}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for k, ring in STARS for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) + """) s(id, x1, y1, x2, y2)),
    points as (select vec_id, embedding[3]::double as x, embedding[4]::double as y from embeddings),
    met as (select vec_id, id from points, sides where (y1 > y) <> (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) group by vec_id, id having count(*) % 2 = 1)
    select vec_id, min(id)::int as zone from points left join met using (vec_id) group by vec_id""")
def point_in_polygon(t):
    e = t("embeddings")
    points = e.select("vec_id", F.col("embedding")[2].cast("double").alias("x"), F.col("embedding")[3].cast("double").alias("y"))
    zones = e.sparkSession.createDataFrame([(k, k, ring) for k, ring in STARS], "id int, zone_idx int, ring array<struct<x: double, y: double>>")
    return match.within_first(points, zones, "x", "y").select("vec_id", "zone")


@query("""with p as (select s_suppkey, 10000 + s_suppkey % 211 * 150 as x, 5000 + s_suppkey % 97 * 320 as y, 0.006674372231802145 as e2, 6377397.155 as a, radians(52.41864827777778) as f0 from supplier),
    m as (select *, (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2)) as e1, (y - 10000 + a * ((1 - e2/4 - 3*e2**2/64 - 5*e2**3/256) * f0 - (3*e2/8 + 3*e2**2/32 + 45*e2**3/1024) * sin(2*f0) + (15*e2**2/256 + 45*e2**3/1024) * sin(4*f0)
        - 35*e2**3/3072 * sin(6*f0))) / (a * (1 - e2/4 - 3*e2**2/64 - 5*e2**3/256)) as mu from p),
    f as (select *, mu + (3*e1/2 - 27*e1**3/32) * sin(2*mu) + (21*e1**2/16 - 55*e1**4/32) * sin(4*mu) + 151*e1**3/96 * sin(6*mu) + 1097*e1**4/512 * sin(8*mu) as foot from m),
    d as (select *, (x - 40000) * sqrt(1 - e2 * sin(foot)**2) / a as d, tan(foot)**2 as t, (1 - e2) / (1 - e2 * sin(foot)**2) as ratio from f),
    g as (select *, foot - tan(foot) / ratio * (d**2/2 - (1 + 3*t) * d**4/24) as lat, radians(13.62720366666667) + (d - t * d**3/3 + (1 + 3*t) * t * d**5/15) / cos(foot) as lon from d),
    c as (select s_suppkey, a / sqrt(1 - e2 * sin(lat)**2) as n, lat, lon, e2 from g),
    v as (select s_suppkey, n * cos(lat) * cos(lon) as x, n * cos(lat) * sin(lon) as y, n * (1 - e2) * sin(lat) as z, radians(0.202/3600) as rx, radians(0.045/3600) as ry, radians(-2.455/3600) as rz, 1 + 6.7/1000000 as s from c),
    w as (select s_suppkey, 598.1 + s * (x - rz * y + ry * z) as x, 73.7 + s * (rz * x + y - rx * z) as y, 418.2 + s * (-ry * x + rx * y + z) as z, 6378137.0 as a, 6378137.0 * (1 - 1/298.257223563) as b from v),
    u as (select *, sqrt(x**2 + y**2) as r, atan2(z * a, sqrt(x**2 + y**2) * b) as q from w)
    select s_suppkey, round(degrees(atan2(y, x)), 9) as lon, round(degrees(atan2(z + (a**2 - b**2) / b * sin(q)**3, r - (a**2 - b**2) / a * cos(q)**3)), 9) as lat from u""".replace("**", "^"))
def reprojected_points(t):
    """Suppliers' places in the Berlin Soldner system as longitude and latitude."""
    at = projection.to_wgs84(10000 + F.col("s_suppkey") % 211 * 150, 5000 + F.col("s_suppkey") % 97 * 320)
    return t("supplier").select("s_suppkey", at.alias("p")).select("s_suppkey", F.round("p.x", 9).alias("lon"), F.round("p.y", 9).alias("lat"))


# Sides of 10 and 5 meet in a corner.
@query("""with s as (select s_name as name, s_suppkey::double as k, s_nationkey + 2 as b from supplier),
    inner_ as (select name, k, 2 + i as number, i * 15.0 / (b - 2) as far from (select *, unnest(range(0, b - 2)) as i from s)),
    every as (select name, number, case when far <= 10 then far else 10.0 end as x, case when far <= 10 then k else k + far - 10 end as y, 0 as kind from inner_
        union all select name, 1, 0.0, k, 1 from s union all select name, b, 10.0, k + 5, 2 from s)
    select name || ' ' || number as address, round(arg_max(x, kind), 9) as x, round(arg_max(y, kind), 9) as y from every group by name, number""")
def interpolated_addresses(t):
    return interpolate_points(t).select("address", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("""select c_custkey, c_acctbal, case when c_acctbal between 1000 and 2000 then 'in' else 'out' end as span, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as segment,
    lpad(c_custkey::varchar, greatest(5, length(c_custkey::varchar))::int, '0') as code from customer where c_nationkey in (1, 2, 3)""")
def project_filter(t):
    span = F.when(F.col("c_acctbal").between(1000, 2000), "in").otherwise("out")
    segment = F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("none"))
    return t("customer").filter(F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_acctbal", span.alias("span"), segment.alias("segment"), text.pad_code(F.col("c_custkey").cast("string")).alias("code"))


@query("""select o_orderkey, o_orderpriority || ' ' || o_orderstatus as address, replace(replace(o_orderpriority, ' ', '+'), 'ü', '%FC') as escaped, try_cast(o_orderpriority as int) as id, replace(o_orderpriority, '*', '') as code from orders""")
def address_text(t):
    rows = t("orders").withColumn("id", F.col("o_orderpriority"))
    return rows.select("o_orderkey", text.address("o_orderpriority", "o_orderstatus").alias("address"), text.latin_escape("o_orderpriority").alias("escaped"), reshape.destring("id").alias("id"), text.strip_code("o_orderpriority").alias("code"))


@query("""select o_custkey, arg_min(o_orderkey, o_orderkey) as first_key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_key from orders group by 1""")
def first_last_rows(t):
    o = t("orders")
    first = match.first_of(o.select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("first_key")), "o_custkey", "o_orderkey")
    last = match.last_of(o.select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderkey").alias("last_key")), "o_custkey", "o_orderdate", "o_orderkey")
    return first.join(last, "o_custkey")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) / count(*) over (partition by l_orderkey) as position from lineitem""")
def row_positions(t):
    rows = match.row_numbers(t("lineitem"), ["l_linenumber", "l_partkey", "l_suppkey"], ["l_orderkey"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n", (F.col("n") / F.col("total_n")).alias("position"))


@query("""select user_id, coalesce(sum(value) filter (event_type = 'error'), 0) as in_errors, sum(value) as total, max(value) as largest, round(stddev_pop(value), 6) as spread from events group by 1""")
def conditional_totals(t):
    in_errors = stats.total_if("value", F.col("event_type") == "error").alias("in_errors")
    return t("events").groupBy("user_id").agg(in_errors, F.sum("value").alias("total"), F.max("value").alias("largest"), F.round(F.stddev_pop("value"), 6).alias("spread"))


# The longest common block (the first in the name, then in the question), then the same left and right of it, until nothing is common.
@query("""with recursive names as (select distinct p_name as match from part), asked as (select distinct substr(p_name, 1, 3) || 'x' || substr(p_name, 5, 99) as query from part),
    places as (select query, match, unnest(range(0, length(match))) as i, length(query) as m from asked, names), pairs as (select *, unnest(range(0, m)) as j from places),
    common as materialized (select query, match, i, j, k from (select *, unnest(range(1, least(length(match) - i, m - j) + 1)) as k from pairs where substr(match, i + 1, 1) = substr(query, j + 1, 1))
        where substr(match, i + 1, k) = substr(query, j + 1, k)),
    parts as (select query, match, 0::bigint as a, length(match)::bigint as b, 0::bigint as c, length(query)::bigint as d, 0::bigint as size from asked, names union all
        select query, match, unnest([a, 99 - code // 100 % 100 + code // 10000]), unnest([99 - code // 100 % 100, b]), unnest([c, 99 - code % 100 + code // 10000]), unnest([99 - code % 100, d]), unnest([code // 10000, 0])
        from (select p.query, p.match, a, b, c, d, max(k * 10000 + (99 - i) * 100 + 99 - j) as code from parts p join common o on o.query = p.query and o.match = p.match and i >= a and i + k <= b and j >= c and j + k <= d
            group by all)),
    scored as (select query, match, 2.0 * sum(size) / (length(query) + length(match)) as score from parts group by query, match)
    select query, arg_max(match, (score, match)) as match, round(max(score)::double, 6) as score from scored where score >= 0.5 group by query""")
def fuzzy_match(t):
    """The most similar part name of every name with a letter changed."""
    names = t("part").select("p_name").distinct()
    asked = names.select(F.concat(F.substring("p_name", 1, 3), F.lit("x"), F.substring("p_name", 5, 99)).alias("asked"))
    return match.best_matches(asked, "asked", names, "p_name", 0.5).select("query", "match", F.round("score", 6).alias("score"))


@query("""select c_custkey, case when c_custkey % 11 = 0 then null else lpad((c_custkey % 7)::varchar, 5, '0') end as code from customer""")
def status_lookup(t):
    """Codes of made-up occupations, from pages that a client makes of the question; every eleventh question fails, and others fail at first."""
    calls = {}

    def client(question: str) -> str:
        n = int(question.removeprefix("M%FCller+"))
        calls[n] = calls.get(n, 0) + 1
        if n % 11 == 0 or (n % 13 == 0 and calls[n] < 3):
            raise ConnectionError(question)
        return "".join(f"<td>{c:05d}</td>" for c in (n % 7, n % 5 + 90, n % 7)) + "<td>123456</td>"

    rows = t("customer").select("c_custkey", F.concat(F.lit("Müller "), F.col("c_custkey").cast("string")).alias("occupation"))
    return status.codes_online(rows, "occupation", client, "code").select("c_custkey", "code")


CASCADE = {(g, s): f"(o_orderkey + {g}) % 4 <> 0" for g in (1, 2, 3) for s in (1, 2, 3)}


@query("""with o as (select o_orderkey, o_custkey % 6 as id, o_totalprice as v from orders), m as (select * from (values """ + ", ".join(f"({g}, {s})" for g, s in CASCADE) + """) m(g, s)),
    r as (select g, s, id, v * s as v, row_number() over (partition by g, s, id order by v) as pos, count(*) over (partition by g, s, id) as n from o, m where (o_orderkey + g) % 4 <> 0 and (g <> 2 or id <> 3)),
    t as (select g, s, id, q::int as q, round(case when n > 100 then sum(case when pos / n >= q / 100 then v else 0 end) / sum(v) end, 6) as share from r, (select unnest(range(30, 100))::double as q) group by g, s, id, q, n)
    select id::int as id, q, """ + ", ".join(f"max(share) filter (g = {g} and s = {s}) as hiscam_share_{g}_{s}" for g, s in CASCADE) + """ from t group by id, q""")
def share_panel(t):
    """Top shares of three choices of orders and three scores, nine tables, side by side."""
    from . import referencing

    keep = lambda g: ((F.col("o_orderkey") + g) % 4 != 0) & (F.lit(g != 2) | (F.col("o_custkey") % 6 != 3))
    places = [F.when(keep(g), F.col("o_custkey") % 6).cast("string").alias(f"sb_{g}") for g in (1, 2, 3)]
    panel = referencing.share_panel(referencing.tract_top_shares(referencing.long_form(t("orders").select(*places, *((F.col("o_totalprice") * s).alias(f"hiscam_{s}") for s in (1, 2, 3))))))
    return panel.select("id", "q", *(F.round(c, 6).alias(c) for c in panel.columns[2:]))


@query()
def crf_label(t):
    """Labels of customers' entries by a model trained on made-up entries."""
    from ..operators.labels import parse_entries, train

    rows = t("customer").select(F.concat(F.col("c_name"), F.lit(", "), F.col("c_mktsegment"), F.lit(".")).alias("content"), "c_custkey")
    made = [(["START", f"Customer#{k}", ",", w, ".", "END"], ["START", "N", "D", "O", "O", "END"]) for k, w in enumerate(("BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE", "HOUSEHOLD"))]
    return parse_entries(rows, train(made)).select("c_custkey", "labels", F.to_json("categories").alias("categories"))


@query()
def interpolate_points(t):
    """House numbers along streets made of suppliers."""
    from ..operators.geo import street_addresses

    s, text_of = t("supplier"), lambda c: c.cast("string")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    line = F.array(point(F.lit(0), F.col("s_suppkey")), point(F.lit(10), F.col("s_suppkey")), point(F.lit(10), F.col("s_suppkey") + 5))
    streets = s.select(F.col("s_suppkey").alias("row_idx"), F.col("s_name").alias("name"), text_of(F.lit(1)).alias("num_1"), text_of(F.col("s_nationkey") + 2).alias("num_2"), F.lit(".").alias("num_3"), F.lit(".").alias("num_4"), line.alias("line"))
    return street_addresses(streets)


@query()
def pareto_fit(t):
    """Top shares of the order values of five groups of customers through 13 brackets."""
    rows = _price_brackets(t)
    mean = rows.groupBy("id").agg((F.sum("wealth") / F.sum("n")).alias("mean"))
    return pareto.interpolate(pareto.positions(rows).join(mean, "id"))


@query()
def label_stream(t):
    """The streaming labeller's function over every line of the conversations; a null text is one null line."""
    from ..operators.labels import train
    from ..streaming.labeller import label_lines

    made = [(["START", "Et", ",", "le", ".", "END"], ["START", "N", "D", "O", "O", "END"]), (["START", "In", "the", "END"], ["START", "N", "O", "END"])]
    rows = t("conversations").select("conv_id", "turn", F.posexplode_outer(F.split("text", "\n")).alias("line", "value"))
    return label_lines(rows.withColumn("line", F.coalesce("line", F.lit(0))), train(made), keys=["conv_id", "turn", "line"])
