"""Independent DuckDB SQL for every registered query.

The oracle never uses the activity cube: each family is written directly
against the action log with the window as a plain time predicate, so a
cube / window-selection mistake on the Spark side shows up as a mismatch.
Tables ``events``, ``lineitem``, ``orders``, ``part``, ``customer`` … are
views registered by the checker.
"""

from __future__ import annotations

import datetime as _dt

# ---- adapters (same code mappings as shopcast.sources.adapters) ------------

ACTIONS_A = """actions AS (
  SELECT CAST(user_id AS BIGINT) AS user_id, CAST(k AS BIGINT) AS sku_id, ts AS time,
         CAST(CASE event_id % 7 WHEN 0 THEN 14 WHEN 1 THEN 21 WHEN 2 THEN 28 WHEN 3 THEN 110
                                WHEN 4 THEN 210 ELSE 0 END AS INTEGER) AS model_id,
         CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3
                              WHEN 'purchase' THEN 4
                              WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 5 ELSE 6 END END
              AS INTEGER) AS type,
         CAST(4 + k % 8 AS INTEGER) AS cate, CAST(k % 13 AS INTEGER) AS brand
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e)"""

ACTIONS_B = """actions AS (
  SELECT CAST(o_custkey AS BIGINT) AS user_id, CAST(l_partkey AS BIGINT) AS sku_id, l_shipdate AS time,
         CAST(l_linenumber AS INTEGER) AS model_id,
         CAST(CASE concat(l_returnflag, l_linestatus) WHEN 'NO' THEN 1 WHEN 'RO' THEN 2 WHEN 'RF' THEN 3
              WHEN 'AF' THEN 4 WHEN 'AO' THEN 5 WHEN 'NF' THEN 6 END AS INTEGER) AS type,
         CAST(CASE p_type WHEN 'ECONOMY' THEN 4 WHEN 'LARGE' THEN 5 WHEN 'MEDIUM' THEN 6 WHEN 'PROMO' THEN 7
              WHEN 'SMALL' THEN 8 WHEN 'STANDARD' THEN 9 END AS INTEGER) AS cate,
         CAST(substr(p_brand, 7) AS INTEGER) AS brand
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

USERS = """users AS (
  SELECT CAST(c_custkey AS BIGINT) AS user_id,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '15岁以下' WHEN 'BUILDING' THEN '16-25岁'
              WHEN 'FURNITURE' THEN '26-35岁' WHEN 'HOUSEHOLD' THEN '36-45岁' ELSE '-1' END AS age,
         CASE WHEN c_custkey % 50 = 49 THEN NULL ELSE CAST(c_custkey % 3 AS DOUBLE) END AS sex,
         CAST(1 + c_custkey % 5 AS INTEGER) AS user_lv_cd,
         strftime(DATE '2023-12-01' + CAST(c_custkey % 70 AS INTEGER), '%Y-%m-%d') AS user_reg_tm
  FROM customer)"""

PRODUCTS_A = """products AS (
  SELECT CAST(p_partkey AS BIGINT) AS sku_id, CAST(p_size % 4 - 1 AS INTEGER) AS a1,
         CAST(p_size % 3 - 1 AS INTEGER) AS a2, CAST(p_size % 5 - 1 AS INTEGER) AS a3,
         CAST(4 + p_partkey % 8 AS INTEGER) AS cate,
         CAST(CASE WHEN p_partkey % 11 = 0 THEN 99 ELSE p_partkey % 13 END AS INTEGER) AS brand
  FROM part)"""

PRODUCTS_B = """products AS (
  SELECT CAST(p_partkey AS BIGINT) AS sku_id, CAST(p_size % 4 - 1 AS INTEGER) AS a1,
         CAST(p_size % 3 - 1 AS INTEGER) AS a2, CAST(p_size % 5 - 1 AS INTEGER) AS a3,
         CAST(CASE p_type WHEN 'ECONOMY' THEN 4 WHEN 'LARGE' THEN 5 WHEN 'MEDIUM' THEN 6 WHEN 'PROMO' THEN 7
              WHEN 'SMALL' THEN 8 WHEN 'STANDARD' THEN 9 END AS INTEGER) AS cate,
         CAST(substr(p_brand, 7) AS INTEGER) AS brand
  FROM part)"""

COMMENTS = """comments AS (
  SELECT s.dt, CAST(p_partkey AS BIGINT) AS sku_id, CAST((p_partkey + s.w) % 5 AS INTEGER) AS comment_num,
         CAST(CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS INTEGER) AS has_bad_comment,
         CAST(p_size AS DOUBLE) / 50 AS bad_comment_rate
  FROM part, (VALUES (DATE '2024-01-01', 0), (DATE '2024-01-08', 1),
                     (DATE '2024-01-15', 2), (DATE '2024-01-22', 3)) s(dt, w))"""


class Ctx:
    """Dates of an adapter as SQL literals plus its CTE prelude."""

    def __init__(self, adapter: str):
        self.adapter = adapter
        if adapter == "A":
            self.end = _dt.datetime(2024, 1, 26)
            self.label_end = _dt.datetime(2024, 1, 31)
            self.acc_start = _dt.datetime(2024, 1, 1)
            self.rank_start = _dt.datetime(2024, 1, 6)
            self.score_end = _dt.datetime(2024, 1, 31)
            self.ctes = [ACTIONS_A, USERS, PRODUCTS_A, COMMENTS]
        else:
            self.end = _dt.datetime(2001, 6, 5)
            self.label_end = _dt.datetime(2001, 6, 10)
            self.acc_start = _dt.datetime(2001, 1, 1)
            self.rank_start = _dt.datetime(2001, 2, 1)
            self.score_end = _dt.datetime(2001, 6, 10)
            self.ctes = [ACTIONS_B, USERS, PRODUCTS_B, COMMENTS]
        self.excl_lo = _dt.datetime(2024, 1, 7)
        self.excl_hi = _dt.datetime(2024, 1, 13)

    @property
    def acc_days(self) -> int:
        return (self.end - self.acc_start).days

    def sql(self, body: str, extra_ctes=()) -> str:
        return "WITH " + ",\n".join(list(self.ctes) + list(extra_ctes)) + "\n" + body


def ts(x: _dt.datetime) -> str:
    return f"TIMESTAMP '{x:%Y-%m-%d %H:%M:%S}'"


def dt(x: _dt.datetime) -> str:
    return f"DATE '{x:%Y-%m-%d}'"


def minus_days(x: _dt.datetime, d: int) -> _dt.datetime:
    return x - _dt.timedelta(days=d)


def in_range(start: _dt.datetime, end: _dt.datetime, col: str = "time") -> str:
    return f"{col} >= {ts(start)} AND {col} < {ts(end)}"


A = Ctx("A")
B = Ctx("B")
