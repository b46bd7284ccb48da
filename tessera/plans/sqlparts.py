"""SQL text of the stand-in tables (see ``tessera.sources.standins``) for the
DuckDB oracle. Each constant is a CTE body."""

VISITS = """
visits AS (
  SELECT user_id, CAST(ts AS DATE) AS date,
         CASE WHEN event_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device_type,
         min(event_id) AS visit_id,
         CAST(count(*) AS BIGINT) AS total_pageviews,
         CAST(count_if(event_type = 'purchase') AS BIGINT) AS shopping_pageviews,
         CAST(count_if(event_type = 'click') AS BIGINT) AS ad_clicks,
         CAST(count_if(event_type = 'signup') AS BIGINT) AS shares,
         CAST(count_if(event_type = 'view') AS BIGINT) AS bottom_of_page_reached,
         CAST(count_if(event_type = 'click' AND value >= 25) AS BIGINT) AS bottom_related_link_clicks,
         CAST(count_if(event_type = 'error') AS BIGINT) AS top_related_link_clicks,
         CASE user_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'bottom' ELSE 'top_and_bottom' END AS variant
  FROM events GROUP BY 1, 2, 3)"""

FIRST_VISITS = VISITS + """,
first_visits AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date, visit_id) AS rn FROM visits)
  WHERE rn = 1)"""

LOANS = """
loans AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderstatus = 'F' THEN 'Fully Paid'
              WHEN o_orderstatus = 'O' THEN 'Charged Off'
              WHEN o_orderpriority = '1-URGENT' THEN 'Default'
              WHEN o_orderpriority = '2-HIGH' THEN 'Late (31-120 days)'
              ELSE 'Current' END AS loan_status,
         CASE WHEN c_nationkey = 0 THEN '< 1 year' WHEN c_nationkey >= 10 THEN '10+ years'
              WHEN c_nationkey = 7 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) || ' years' END AS emp_length,
         o_orderpriority AS purpose, n_name AS addr_state, c_mktsegment AS home_ownership,
         o_orderstatus AS verification_status,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE c_acctbal + 1000.0 END AS annual_inc,
         o_totalprice / 20000.0 AS dti, o_totalprice AS revol_bal,
         CASE WHEN o_orderkey % 5 = 0 THEN c_nationkey END AS mths_since_last_major_derog,
         CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS verification_status_joint,
         strftime(o_orderdate, '%m/%d/%Y') AS apply_date,
         '1/1/' || CAST(year(o_orderdate) - c_nationkey - 1 AS VARCHAR) AS earliest_cr_line
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

CLEAN_LOANS = LOANS + """,
clean_loans AS (
  SELECT id,
         CASE WHEN loan_status IN ('Charged Off', 'Late (31-120 days)', 'Default',
                                   'Does not meet the credit policy. Status:Charged Off') THEN 'Default'
              WHEN loan_status IN ('Fully Paid', 'Does not meet the credit policy. Status:Fully Paid')
              THEN 'Fully Paid' ELSE loan_status END AS loan_status,
         CASE WHEN emp_length = '< 1 year' THEN 0
              ELSE TRY_CAST(regexp_extract(emp_length, '\\d+') AS INTEGER) END AS emp_length,
         purpose, addr_state,
         CASE WHEN home_ownership IN ('AUTOMOBILE', 'BUILDING') THEN 'OTHER' ELSE home_ownership END AS home_ownership,
         annual_inc, dti, revol_bal,
         log10(annual_inc + 1) AS log_annual_inc,
         log10(revol_bal + 1) AS log_revol_bal,
         round_even(dti / 100 * annual_inc / 12, 0) AS total_monthly_debt,
         CAST(year(TRY_STRPTIME(apply_date, '%m/%d/%Y')) - year(TRY_STRPTIME(earliest_cr_line, '%m/%d/%Y'))
              AS INTEGER) AS age_credit
  FROM loans
  WHERE loan_status IN ('Charged Off', 'Late (31-120 days)', 'Default',
                        'Does not meet the credit policy. Status:Charged Off',
                        'Fully Paid', 'Does not meet the credit policy. Status:Fully Paid'))"""

DOGS = """
dogs AS (
  SELECT l_orderkey, l_linenumber, l_quantity AS height, l_extendedprice / 1000.0 AS weight,
         CASE WHEN l_linestatus = 'F' THEN 'male' ELSE 'female' END AS gender
  FROM lineitem)"""

PRODUCT_SALES = """
product_sales AS (SELECT l_partkey AS product_id, l_quantity AS quantity FROM lineitem),
product AS (SELECT p_partkey AS product_id, p_name AS product_name FROM part)"""

SALES = """
sales AS (
  SELECT o_custkey AS member_id, l_partkey AS product_id, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
product AS (SELECT p_partkey AS product_id, p_name AS product_name FROM part)"""

LINEITEM_NULLS = """
li_nulls AS (
  SELECT l_orderkey, l_linenumber, l_quantity,
         CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS l_discount,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax,
         CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
         l_returnflag
  FROM lineitem)"""
