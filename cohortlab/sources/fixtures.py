"""Inputs of the experiment operators, derived from the star-schema tables by SQL that Spark and DuckDB both run.

Templates name tables and other fixtures in braces; :func:`frame` resolves them to DataFrames, :func:`duck` to text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRODUCTS = [f"product_{i}" for i in range(1, 26)]
CHANNELS = ["view", "click", "signup", "error"]
FEATURES = ["balance", "n_web_logins", "n_mobile_logins", "n_offers_year"]

_STRAT = """
select c.c_custkey as cost_ID,
  case when c.c_mktsegment in ('BUILDING','AUTOMOBILE') then 1 when c.c_mktsegment in ('MACHINERY','FURNITURE') then 0 end as visa_ind,
  c.c_acctbal as balance, e.w as n_web_logins, e.m as n_mobile_logins, o.n as n_offers_year, c.c_mktsegment as segment
from {customer} c
left join (select user_id, count(case when event_type='view' then 1 end) w, count(case when event_type='click' then 1 end) m
           from {events} group by user_id) e on c.c_custkey = e.user_id
left join (select o_custkey, count(*) n from {orders}
           where o_orderdate >= timestamp '1998-01-01 00:00:00' and o_orderdate < timestamp '1999-01-01 00:00:00'
           group by o_custkey) o on c.c_custkey = o.o_custkey
"""


def _priority(lo: str, hi: str) -> str:
    sums = ",\n  ".join(f"cast(round(sum(case when p.p_brand = 'Brand#{i}' then cast(l.l_extendedprice*(1-l.l_discount) as decimal(18,4)) end),2) as double) as product_{i}" for i in range(1, 26))
    return f"""
select c.c_custkey as customer_id, case when c.c_custkey % 10 = 0 then 1 else 0 end as control,
  {sums}
from {{customer}} c join {{orders}} o on c.c_custkey=o.o_custkey join {{lineitem}} l on l.l_orderkey=o.o_orderkey
  join {{part}} p on p.p_partkey=l.l_partkey
where o.o_orderdate >= timestamp '{lo} 00:00:00' and o.o_orderdate < timestamp '{hi} 00:00:00' group by c.c_custkey
"""


_BITS = " + ".join(f"{1 << i} * coalesce(max(case when e.event_type = '{c}' then 1 end), 0)" for i, c in enumerate(CHANNELS))

SQL = {
    "strat_customers": _STRAT,
    "priority_legacy": _priority("1995-01-01", "1998-07-01"),
    "priority_new": _priority("1998-07-01", "2002-01-01"),
    "measurement": """
select o_orderkey as offer_id, o_custkey as customer_id,
  cast(extract(year from o_orderdate) as int)*100 + cast(extract(month from o_orderdate) as int) as month,
  o_orderpriority as product,
  case when o_orderstatus='F' and o_totalprice>=100000 then 'Interested' when o_orderstatus='F' then 'Not Interested'
       when o_orderstatus='P' and o_totalprice>=100000 then 'Actioned'   when o_orderstatus='P' then 'Activated'
       when o_totalprice>=100000 then 'Proposed' end as response_state
from {orders}
""",
    "scored_offers": """
select o_orderkey as offer_id, o_custkey as customer_id, o_orderpriority as product, o_totalprice as new_score,
  cast(o_totalprice as double)*(0.5+(o_orderkey % 97)/cast(97 as double)) as legacy_score from {orders}
""",
    "proposed_offers": "select customer_id, 'product_' || cast((customer_id*7) % 30 + 1 as varchar(12)) as proposed_product from {priority_new}",
    "coalitions": f"""
select mask, count(*) as sample_size, avg(cast(conv as double)) as rate from (
  select u.user_id, d.day, {_BITS} as mask, coalesce(max(case when e.event_type = 'purchase' then 1 end), 0) as conv
  from (select distinct user_id from {{events}}) u cross join (select distinct cast(ts as date) as day from {{events}}) d
  left join (select user_id, cast(ts as date) as day, event_type from {{events}}) e on e.user_id = u.user_id and e.day = d.day
  group by u.user_id, d.day) s group by mask
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a lazy DataFrame."""
    sql = SQL[name]
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    return spark.sql(sql, **{n: frame(spark, sf_dir, n) if n in SQL else table(spark, sf_dir, n) for n in names})


def duck(name: str) -> str:
    """A fixture as SQL text for DuckDB, in brackets."""
    return "(" + re.sub(r"\{(\w+)\}", lambda m: duck(m[1]) if m[1] in SQL else m[1], SQL[name]) + ")"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns becomes null, as every operator here expects missing values."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in kinds.items() if kind in ("double", "float")})
