"""Independent SQL statements of the catalogue questions, for DuckDB.

Each statement is written from the question, not from the Spark plan: it uses
the plain line-grain joins and SQL window functions (RANK, DENSE_RANK,
ROW_NUMBER, LEAD, running SUM) that the Spark side replaces with pre-aggregation,
partial top-k and prefix sums. Column names and types match the Spark results:
money is DECIMAL(18,2) per row and DECIMAL(38,2) in totals, counts are BIGINT,
ranks over whole tables or full groups BIGINT, top-k ranks and calendar parts INTEGER, and means are rounded half up exactly with
integer arithmetic (DuckDB's AVG and `/` return DOUBLE).
"""

from __future__ import annotations


def _money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


def _cents(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,2)) * 100 AS DECIMAL(18,0))"


def _half_up(a: str, b: str) -> str:
    """Whole-number a / b rounded half away from zero (HUGEINT), NULL when b = 0."""
    a, b = f"CAST(({a}) AS HUGEINT)", f"CAST(({b}) AS HUGEINT)"
    return f"(CASE WHEN {b} = 0 THEN NULL ELSE SIGN({a}) * ((2 * ABS({a}) + {b}) // (2 * {b})) END)"


def _units2(u: str) -> str:
    return f"CAST(CAST({u} AS DECIMAL(38,0)) * 0.01 AS DECIMAL(38,2))"


def _mean(sum_cents: str, n: str) -> str:
    return _units2(_half_up(sum_cents, n))


LO = "lineitem JOIN orders ON l_orderkey = o_orderkey"
TOTAL_PRICE = f"CAST(SUM({_money('l_extendedprice')}) AS DECIMAL(38,2))"

JOIN_DAYS = """join_days AS (
    SELECT user_id, MIN(CAST(ts AS DATE)) AS join_date FROM events
    WHERE event_type = 'signup' GROUP BY user_id)"""

PURCHASES = f"""{JOIN_DAYS},
purchases AS (
    SELECT e.user_id, CAST(e.ts AS DATE) AS d, e.event_id, {_money('e.value')} AS amount, j.join_date
    FROM events e JOIN join_days j ON e.user_id = j.user_id
    WHERE e.event_type = 'purchase')"""

DIRTY_BRAND = """dirty AS (
    SELECT p_partkey, p_type, CASE WHEN p_type = 'PROMO' THEN 'null' WHEN p_type = 'SMALL' THEN ''
        WHEN p_type = 'LARGE' THEN 'NaN' ELSE p_brand END AS raw_brand FROM part)"""

ENCODED = """vocab AS (
    SELECT word, DENSE_RANK() OVER (ORDER BY word) AS word_id
    FROM (SELECT DISTINCT trim(UNNEST(string_split(p_name, ' '))) AS word FROM part) WHERE word <> ''),
toks AS (SELECT p_partkey, trim(UNNEST(string_split(p_name, ' '))) AS word FROM part),
enc AS (
    SELECT p_partkey, string_agg(CAST(word_id AS VARCHAR), ',') AS word_ids
    FROM toks JOIN vocab USING (word) GROUP BY p_partkey)"""

TYPE_PRICE = "CASE WHEN p_type = 'PROMO' THEN 12 WHEN p_type = 'SMALL' THEN 10 END"

SEGMENT_TOTALS = """seg AS (
    SELECT CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE c_mktsegment END AS segment,
           CAST(o_totalprice AS DECIMAL(18,2)) AS price
    FROM orders JOIN customer ON o_custkey = c_custkey),
tot AS (SELECT segment, CAST(SUM(price) AS DECIMAL(38,2)) AS total FROM seg {where} GROUP BY segment)"""

HIT = "l_returnflag <> 'R' AND l_discount >= 0.05"

MEAN_PER_TYPE = f"""g AS (
    SELECT p_type, {_mean(f"SUM({_cents('l_extendedprice')})", 'COUNT(*)')} AS avg_price
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type)"""


SQL: dict[str, str] = {
    # ---------------------------------------------------------- restaurant analogues
    "spend_per_customer": f"""
        SELECT o_custkey, {TOTAL_PRICE} AS total_spent FROM {LO} GROUP BY o_custkey""",
    "active_days": """
        SELECT o_custkey, COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS number_of_days
        FROM orders GROUP BY o_custkey""",
    "first_item_per_customer": f"""
        WITH x AS (
            SELECT o_custkey, p_brand,
                   DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS r
            FROM {LO} JOIN part ON l_partkey = p_partkey)
        SELECT DISTINCT o_custkey, p_brand FROM x WHERE r = 1""",
    "most_bought_item": """
        SELECT p_brand, COUNT(*) AS number_purchased FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY p_brand ORDER BY number_purchased DESC, p_brand LIMIT 1""",
    "favourite_item_ties": f"""
        WITH c AS (SELECT o_custkey, p_brand, COUNT(*) AS order_count
                   FROM {LO} JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_brand),
        r AS (SELECT *, RANK() OVER (PARTITION BY o_custkey ORDER BY order_count DESC) AS rk FROM c)
        SELECT o_custkey, p_brand, order_count FROM r WHERE rk = 1""",
    "favourite_item_one": f"""
        WITH c AS (SELECT o_custkey, p_brand, COUNT(*) AS order_count
                   FROM {LO} JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_brand),
        r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY order_count DESC, p_brand) AS rk FROM c)
        SELECT o_custkey, p_brand, order_count FROM r WHERE rk = 1""",
    "first_purchase_after_join": f"""
        WITH {PURCHASES},
        r AS (SELECT *, RANK() OVER (PARTITION BY user_id ORDER BY d) AS rk FROM purchases WHERE d >= join_date)
        SELECT user_id, d AS purchase_day, event_id, amount FROM r WHERE rk = 1""",
    "last_before_join": f"""
        WITH {PURCHASES},
        r AS (SELECT *, RANK() OVER (PARTITION BY user_id ORDER BY d DESC) AS rk FROM purchases WHERE d < join_date)
        SELECT user_id, d AS purchase_day, event_id, amount FROM r WHERE rk = 1""",
    "totals_before_join": f"""
        WITH {PURCHASES}
        SELECT user_id, COUNT(*) AS total_items, CAST(SUM(amount) AS DECIMAL(38,2)) AS amount_spent
        FROM purchases WHERE d < join_date GROUP BY user_id""",
    "points_flat": f"""
        SELECT user_id, CAST(SUM({_money('value')} * 10 *
            CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END) AS DECIMAL(38,2)) AS points
        FROM events GROUP BY user_id""",
    "points_bonus_week": f"""
        WITH {JOIN_DAYS}
        SELECT e.user_id, CAST(SUM({_money('e.value')} * 10 * CASE
                WHEN CAST(e.ts AS DATE) BETWEEN j.join_date AND j.join_date + 6 THEN 2
                WHEN e.event_type = 'purchase' THEN 2 ELSE 1 END) AS DECIMAL(38,2)) AS points
        FROM events e JOIN join_days j ON e.user_id = j.user_id
        WHERE CAST(e.ts AS DATE) <= DATE '2024-01-25'
        GROUP BY e.user_id""",
    # ---------------------------------------------------------- cleaning
    "clean_null_tokens": f"""
        WITH {DIRTY_BRAND}
        SELECT p_partkey, CASE WHEN raw_brand IN ('', 'null', 'NaN') THEN NULL ELSE raw_brand END AS brand
        FROM dirty""",
    "clean_measure": """
        WITH raw AS (
            SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'null'
                WHEN p_type = 'SMALL' THEN CAST(p_size AS VARCHAR) || 'km'
                WHEN p_type = 'LARGE' THEN CAST(p_size AS VARCHAR) || '.5 mins'
                ELSE CAST(p_size AS VARCHAR) || ' km' END AS raw FROM part)
        SELECT p_partkey, TRY_CAST(NULLIF(regexp_replace(raw, '[^0-9.]', '', 'g'), '') AS DECIMAL(10,2)) AS distance
        FROM raw""",
    "clean_timestamp": """
        WITH raw AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'null'
                     ELSE CAST(ts AS VARCHAR) END AS raw FROM events)
        SELECT event_id, TRY_CAST(CASE WHEN raw IN ('', 'null', 'NaN') THEN NULL ELSE raw END AS TIMESTAMP) AS ts_clean
        FROM raw""",
    "clean_money": r"""
        WITH raw AS (
            SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'null'
                WHEN o_orderpriority = '1-URGENT' THEN 'INR ' || CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS VARCHAR)
                ELSE '$' || CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS VARCHAR) END AS raw FROM orders),
        clean AS (SELECT o_orderkey, CASE WHEN raw IN ('', 'null', 'NaN') THEN NULL ELSE raw END AS c FROM raw)
        SELECT o_orderkey, NULLIF(regexp_extract(c, '^\s*([^0-9\s.]+)', 1), '') AS currency,
               TRY_CAST(NULLIF(regexp_replace(c, '[^0-9.]', '', 'g'), '') AS DECIMAL(20,0)) AS amount
        FROM clean""",
    # ---------------------------------------------------------- delivery analogues
    "lines_ordered": "SELECT COUNT(*) AS lines_ordered FROM lineitem",
    "distinct_orders": "SELECT COUNT(DISTINCT l_orderkey) AS distinct_orders FROM lineitem",
    "completed_per_worker": """
        SELECT l_suppkey, COUNT(*) AS completed FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey""",
    "delivered_per_type": """
        SELECT p_type, COUNT(*) AS delivered FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE l_returnflag <> 'R' GROUP BY p_type""",
    "type_pivot": f"""
        SELECT o_custkey,
            COUNT(*) FILTER (WHERE p_type = 'ECONOMY') AS n_economy,
            COUNT(*) FILTER (WHERE p_type = 'LARGE') AS n_large,
            COUNT(*) FILTER (WHERE p_type = 'MEDIUM') AS n_medium,
            COUNT(*) FILTER (WHERE p_type = 'PROMO') AS n_promo,
            COUNT(*) FILTER (WHERE p_type = 'SMALL') AS n_small,
            COUNT(*) FILTER (WHERE p_type = 'STANDARD') AS n_standard
        FROM {LO} JOIN part ON l_partkey = p_partkey GROUP BY o_custkey""",
    "largest_order": """
        SELECT MAX(n) AS max_lines FROM (
            SELECT l_orderkey, COUNT(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey)""",
    "changed_unchanged": f"""
        SELECT o_custkey,
            COUNT(*) FILTER (WHERE l_discount > 0 OR l_tax > 0) AS with_changes,
            COUNT(*) FILTER (WHERE NOT (l_discount > 0 OR l_tax > 0)) AS no_changes
        FROM {LO} WHERE l_returnflag <> 'R' GROUP BY o_custkey""",
    "both_flags": """
        SELECT COUNT(*) FILTER (WHERE l_discount > 0 AND l_tax > 0) AS n_both
        FROM lineitem WHERE l_returnflag <> 'R'""",
    "by_hour": "SELECT CAST(hour(ts) AS INTEGER) AS hour, COUNT(*) AS n FROM events GROUP BY 1",
    "by_weekday": """
        SELECT dayname(ts) AS weekday_name, CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday_number, COUNT(*) AS n
        FROM events GROUP BY 1, 2""",
    "by_month": "SELECT CAST(month(o_orderdate) AS INTEGER) AS month, COUNT(*) AS n FROM orders GROUP BY 1",
    "by_year": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS n FROM orders GROUP BY 1",
    "mean_measure_order_grain": f"""
        SELECT o_custkey, {_mean(f"SUM({_cents('o_totalprice')})", 'COUNT(*)')} AS avg_total
        FROM orders GROUP BY o_custkey""",
    "mean_measure_line_grain": f"""
        SELECT o_custkey, {_mean(f"SUM({_cents('o_totalprice')})", 'COUNT(*)')} AS avg_total
        FROM {LO} GROUP BY o_custkey""",
    "rate_per_delivery": f"""
        WITH p AS (
            SELECT l_orderkey, COUNT(*) AS n_lines,
                   SUM(CAST(l_quantity AS DECIMAL(18,2))) AS qty,
                   SUM({_money('l_extendedprice')}) AS revenue
            FROM lineitem GROUP BY l_orderkey)
        SELECT l_orderkey, n_lines, CAST(qty AS BIGINT) AS total_qty,
            {_units2(_half_up('revenue * 10000 * 6000', 'qty * 10000'))} AS speed_kph,
            {_units2(_half_up('revenue * 10000 * 6000 * 1000', 'qty * 10000 * 1609'))} AS speed_mph
        FROM p""",
    "explode_list": """
        SELECT p_partkey, token FROM (
            SELECT p_partkey, trim(UNNEST(string_split(p_name, ' '))) AS token FROM part)
        WHERE token <> ''""",
    "decode_list": f"""
        WITH {ENCODED},
        tok AS (SELECT p_partkey, CAST(trim(UNNEST(string_split(word_ids, ','))) AS BIGINT) AS tok FROM enc)
        SELECT p_partkey, string_agg(word, ', ' ORDER BY tok, word) AS words
        FROM tok JOIN vocab ON tok = word_id GROUP BY p_partkey""",
    "token_frequency": """
        WITH w AS (SELECT trim(UNNEST(string_split(p_name, ' '))) AS token
                   FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT token, COUNT(*) AS uses FROM w WHERE token <> ''
        GROUP BY token ORDER BY uses DESC, token LIMIT 3""",
    "multi_valued": f"""
        WITH {ENCODED}
        SELECT p_type, COUNT(*) AS multi_word_parts
        FROM enc JOIN part USING (p_partkey)
        WHERE position(',' IN word_ids) > 0 GROUP BY p_type""",
    "revenue_rules": f"""
        SELECT CAST(SUM({TYPE_PRICE}) AS BIGINT) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "revenue_surcharge": f"""
        SELECT CAST(COALESCE(SUM({TYPE_PRICE}), 0) + COALESCE(SUM(len(string_split(trim(p_name), ' '))), 0) AS BIGINT)
               AS total_income
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'""",
    "net_of_payout": f"""
        SELECT CAST((SELECT SUM({TYPE_PRICE}) FROM lineitem JOIN part ON l_partkey = p_partkey
                     WHERE l_returnflag <> 'R')
                  - (SELECT SUM(CAST(l_quantity AS DECIMAL(18,2)) * 0.30) FROM lineitem
                     WHERE l_returnflag <> 'R') AS DECIMAL(38,2)) AS net""",
    "append_and_join": """
        WITH c2 AS (SELECT c_custkey, c_name, c_nationkey FROM customer
                    UNION ALL SELECT -1, 'Customer#NEW', 0)
        SELECT c_custkey, c_name, n_name FROM c2 JOIN nation ON c_nationkey = n_nationkey""",
    "union_all": """
        SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier""",
    "union_distinct": """
        SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier""",
    "concat_names": """
        SELECT s_suppkey, concat(s_name, ' (', n_name, ')') AS label
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    # ---------------------------------------------------------- music-store analogues
    "top1_by_sort": f"""
        SELECT c_custkey, c_name, {_money('c_acctbal')} AS c_acctbal FROM customer
        ORDER BY c_acctbal DESC, c_custkey LIMIT 1""",
    "top5_groups": """
        SELECT n_name, COUNT(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY orders DESC, n_name LIMIT 5""",
    "segment_members": f"""
        SELECT DISTINCT c_custkey, c_name FROM {LO} JOIN part ON l_partkey = p_partkey
        JOIN customer ON o_custkey = c_custkey WHERE p_type = 'PROMO'""",
    "segment_count": f"""
        SELECT COUNT(DISTINCT o_custkey) AS members FROM {LO} JOIN part ON l_partkey = p_partkey
        WHERE p_type = 'PROMO'""",
    "producers_in_segment": """
        SELECT s_name, COUNT(*) AS line_count FROM lineitem JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey WHERE p_type = 'PROMO'
        GROUP BY s_name ORDER BY line_count DESC, s_name LIMIT 10""",
    "above_average": f"""
        SELECT l_orderkey, l_linenumber, {_money('l_extendedprice')} AS price FROM lineitem
        WHERE {_money('l_extendedprice')} * (SELECT COUNT(*) FROM lineitem)
              > (SELECT SUM({_money('l_extendedprice')}) FROM lineitem)""",
    "top_supplier_top_buyer": f"""
        WITH x AS (SELECT l_suppkey, o_custkey, {_money('l_extendedprice')} AS price FROM {LO}),
        s AS (SELECT l_suppkey, SUM(price) AS t FROM x GROUP BY l_suppkey ORDER BY t DESC, l_suppkey LIMIT 1),
        c AS (SELECT x.l_suppkey, o_custkey, SUM(price) AS amount FROM x JOIN s ON x.l_suppkey = s.l_suppkey
              GROUP BY x.l_suppkey, o_custkey)
        SELECT l_suppkey, o_custkey, CAST(amount AS DECIMAL(38,2)) AS amount FROM c
        ORDER BY amount DESC, o_custkey LIMIT 1""",
    "best_customer_per_nation": f"""
        WITH s AS (SELECT c_nationkey, o_custkey, SUM({_money('l_extendedprice')}) AS spent
                   FROM {LO} JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_custkey),
        r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY spent DESC, o_custkey) AS rn FROM s)
        SELECT n_name, o_custkey, CAST(spent AS DECIMAL(38,2)) AS spent
        FROM r JOIN nation ON c_nationkey = n_nationkey WHERE rn = 1""",
    # ---------------------------------------------------------- movie analogues
    "row_counts": "\n        UNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}"
        for t in ("region nation customer supplier part orders lineitem events documents "
                  "embeddings pages benchmark labels conversations").split()),
    "null_profile": "SELECT " + ", ".join(
        f"COUNT(*) FILTER (WHERE {c} IS NULL) AS {c}_nulls"
        for c in ("o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority "
                  "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                  "l_returnflag l_linestatus l_shipdate").split()
    ) + " FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey",
    "null_profile_cleaned": f"""
        WITH {DIRTY_BRAND},
        c AS (SELECT p_partkey, p_type,
                     CASE WHEN raw_brand IN ('', 'null', 'NaN') THEN NULL ELSE raw_brand END AS brand FROM dirty)
        SELECT COUNT(*) FILTER (WHERE p_partkey IS NULL) AS p_partkey_nulls,
               COUNT(*) FILTER (WHERE p_type IS NULL) AS p_type_nulls,
               COUNT(*) FILTER (WHERE brand IS NULL) AS brand_nulls
        FROM c""",
    "min_max_profile": """
        SELECT MIN(CAST(l_quantity AS DECIMAL(18,2))) AS min_quantity, MAX(CAST(l_quantity AS DECIMAL(18,2))) AS max_quantity,
               MIN(CAST(l_extendedprice AS DECIMAL(18,2))) AS min_price, MAX(CAST(l_extendedprice AS DECIMAL(18,2))) AS max_price,
               MIN(CAST(l_discount AS DECIMAL(18,2))) AS min_discount, MAX(CAST(l_discount AS DECIMAL(18,2))) AS max_discount,
               MIN(l_shipdate) AS min_l_shipdate, MAX(l_shipdate) AS max_l_shipdate
        FROM lineitem""",
    "contains_filter": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%'",
    "token_filter": """
        SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'bolt')""",
    "prefix_regex": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^SMALL')",
    "date_between": """
        SELECT o_orderstatus, COUNT(*) AS n FROM orders
        WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'
        GROUP BY o_orderstatus""",
    "in_list_sum": f"""
        SELECT n_name, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_qty
        FROM {LO} JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE lower(n_name) IN ('nation_1', 'nation_2') GROUP BY n_name""",
    "distinct_values": "SELECT DISTINCT p_type FROM part",
    "singletons": """
        SELECT COUNT(*) AS n_single FROM (
            SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) = 1)""",
    "mean_per_group": f"WITH {MEAN_PER_TYPE} SELECT p_type, avg_price FROM g",
    "count_per_group_filtered": """
        SELECT p_type, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN part ON l_partkey = p_partkey
        WHERE month(o_orderdate) = 3 AND year(o_orderdate) = 1997 AND l_returnflag = 'N' AND l_quantity > 10
        GROUP BY p_type""",
    "rank_of_one": """
        WITH c AS (SELECT p_brand, COUNT(*) AS line_count FROM lineitem JOIN part ON l_partkey = p_partkey
                   GROUP BY p_brand),
        r AS (SELECT *, RANK() OVER (ORDER BY line_count DESC) AS brand_rank FROM c)
        SELECT p_brand, line_count, brand_rank FROM r WHERE p_brand = 'Brand#7'""",
    "rank_all_groups": """
        WITH c AS (SELECT p_brand, COUNT(*) AS line_count FROM lineitem JOIN part ON l_partkey = p_partkey
                   GROUP BY p_brand)
        SELECT p_brand, line_count, RANK() OVER (ORDER BY line_count DESC) AS brand_rank FROM c""",
    "top10_rank": f"""
        SELECT p_partkey, {_money('p_retailprice')} AS price,
               CAST(RANK() OVER (ORDER BY p_retailprice DESC) AS INTEGER) AS price_rank
        FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10""",
    "rank_with_null_group": f"""
        WITH {SEGMENT_TOTALS.format(where='')},
        r AS (SELECT *, CAST(RANK() OVER (ORDER BY total DESC) AS INTEGER) AS seg_rank FROM tot)
        SELECT segment, total, seg_rank FROM r WHERE seg_rank <= 3""",
    "rank_without_null_group": f"""
        WITH {SEGMENT_TOTALS.format(where='WHERE segment IS NOT NULL')},
        r AS (SELECT *, CAST(RANK() OVER (ORDER BY total DESC) AS INTEGER) AS seg_rank FROM tot)
        SELECT segment, total, seg_rank FROM r WHERE seg_rank <= 3""",
    "top_in_top_categories": f"""
        WITH hits AS (SELECT l_suppkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {HIT}),
        top_types AS (SELECT p_type FROM hits GROUP BY p_type ORDER BY COUNT(*) DESC, p_type LIMIT 3),
        s AS (SELECT l_suppkey, COUNT(*) AS hit_count FROM hits WHERE p_type IN (SELECT p_type FROM top_types)
              GROUP BY l_suppkey),
        r AS (SELECT *, CAST(RANK() OVER (ORDER BY hit_count DESC) AS INTEGER) AS supp_rank FROM s)
        SELECT l_suppkey, hit_count, supp_rank FROM r WHERE supp_rank <= 3""",
    "top_per_year_in_top_categories": f"""
        WITH top_types AS (SELECT p_type FROM lineitem JOIN part ON l_partkey = p_partkey
                           GROUP BY p_type ORDER BY COUNT(*) DESC, p_type LIMIT 3),
        pairs AS (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey
                  WHERE p_type IN (SELECT p_type FROM top_types)),
        rows AS (SELECT p_type, CAST(year(o_orderdate) AS INTEGER) AS order_year, o_orderkey,
                        {_money('o_totalprice')} AS price
                 FROM pairs JOIN orders ON l_orderkey = o_orderkey),
        r AS (SELECT *, CAST(DENSE_RANK() OVER (PARTITION BY order_year ORDER BY price DESC) AS INTEGER) AS order_rank
              FROM rows)
        SELECT p_type, order_year, o_orderkey, price, order_rank FROM r WHERE order_rank <= 5""",
    "weighted_rank": f"""
        WITH a AS (
            SELECT l_suppkey, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight_total,
                   SUM({_cents('p_retailprice')} * CAST(l_quantity AS BIGINT)) AS vw
            FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'
            GROUP BY l_suppkey HAVING COUNT(*) >= 400),
        m AS (SELECT l_suppkey, n, weight_total, {_mean('vw', 'weight_total')} AS weighted_mean FROM a)
        SELECT l_suppkey, n, weight_total, weighted_mean,
               RANK() OVER (ORDER BY weighted_mean DESC, weight_total DESC) AS supp_rank
        FROM m""",
    "weighted_rank_by_count": f"""
        WITH a AS (
            SELECT l_suppkey, COUNT(*) AS n, SUM(CAST(l_quantity AS BIGINT)) AS w,
                   SUM({_cents('p_retailprice')} * CAST(l_quantity AS BIGINT)) AS vw
            FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {HIT} AND p_type = 'PROMO'
            GROUP BY l_suppkey),
        m AS (SELECT l_suppkey, n, {_mean('vw', 'w')} AS weighted_mean FROM a),
        r AS (SELECT *, CAST(RANK() OVER (ORDER BY n DESC, weighted_mean DESC) AS INTEGER) AS supp_rank FROM m)
        SELECT l_suppkey, n, weighted_mean, supp_rank FROM r WHERE supp_rank <= 3""",
    "bins": """
        SELECT p_partkey, CASE WHEN p_retailprice > 1800 THEN 'luxury'
            WHEN p_retailprice BETWEEN 1400 AND 1800 THEN 'upper'
            WHEN p_retailprice BETWEEN 1000 AND 1400 THEN 'middle'
            ELSE 'basic' END AS price_class
        FROM part""",
    # the means that are summed are not rounded: the running total of AVG, rounded last
    "cumulative": f"""
        WITH m AS (SELECT p_type, SUM({_cents('l_extendedprice')}) AS s, COUNT(*) AS n
                   FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type),
        u AS (SELECT p_type, {_mean('s', 'n')} AS avg_price, {_half_up('CAST(s AS HUGEINT) * 100000000', 'n')} AS units FROM m),
        w AS (SELECT *, SUM(units) OVER (ORDER BY p_type) AS rt, COUNT(*) OVER (ORDER BY p_type) AS cnt FROM u)
        SELECT p_type, avg_price, {_mean('rt', '100000000')} AS running_total,
               {_mean('rt', 'cnt * 100000000')} AS moving_avg
        FROM w""",
    "gap_summary": f"""
        WITH g AS (
            SELECT o_custkey, CAST(o_orderdate AS DATE) AS d,
                   LEAD(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nd,
                   {_money('o_totalprice')} AS price
            FROM orders),
        s AS (SELECT o_custkey, COUNT(*) AS n_orders, SUM(date_diff('day', d, nd)) AS gap_sum, COUNT(nd) AS n_gaps,
                     CAST(SUM(price) AS DECIMAL(38,2)) AS total_spent, MIN(price) AS min_price, MAX(price) AS max_price
              FROM g GROUP BY o_custkey)
        SELECT o_custkey, n_orders,
               CASE WHEN n_gaps > 0 THEN {_mean('gap_sum * 100', 'n_gaps')} END AS avg_gap_days,
               total_spent, min_price, max_price
        FROM s ORDER BY n_orders DESC, o_custkey LIMIT 9""",
    "left_join_null_sum": """
        SELECT o_orderkey, COUNT(l_orderkey) AS n_lines, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_qty
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
    # ---------------------------------------------------------- ordered analytics at full scale
    "best_nation": f"""
        SELECT n_name, CAST(SUM({_money('o_totalprice')}) AS DECIMAL(38,2)) AS order_total
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_name ORDER BY order_total DESC, n_name LIMIT 1""",
    "best_customer": f"""
        SELECT c_custkey, c_name, CAST(SUM({_money('o_totalprice')}) AS DECIMAL(38,2)) AS order_total
        FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY c_custkey, c_name ORDER BY order_total DESC, c_custkey LIMIT 1""",
    "top_type_per_nation": """
        WITH c AS (SELECT n_name, p_type, COUNT(*) AS purchases
                   FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
                   JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
                   GROUP BY n_name, p_type)
        SELECT n_name, p_type, purchases FROM c
        QUALIFY ROW_NUMBER() OVER (PARTITION BY n_name ORDER BY purchases DESC, p_type) = 1""",
    "top_type_in_year": """
        SELECT p_type, COUNT(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey
        JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = 1997
        GROUP BY p_type ORDER BY lines DESC, p_type LIMIT 1""",
    "orders_per_size": """
        WITH s AS (SELECT o_orderkey, COUNT(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
        SELECT n_lines, COUNT(*) AS n_orders FROM s GROUP BY n_lines""",
    "top_suppliers_by_hits": f"""
        SELECT l_suppkey, s_name, COUNT(*) AS hit_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        WHERE {HIT} GROUP BY 1, 2 ORDER BY hit_count DESC, l_suppkey LIMIT 2""",
    "typed_from_text": f"""
        SELECT o_orderkey AS order_id,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {_money('o_totalprice')} END AS price,
               CAST(o_orderdate AS DATE) AS order_day
        FROM orders""",
    "typed_from_files": f"""
        SELECT o_orderkey AS order_id,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {_money('o_totalprice')} END AS price,
               CAST(o_orderdate AS DATE) AS order_day
        FROM orders""",
    "staged_statuses": "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus",
    "replaced_table": f"""
        SELECT o_custkey, COUNT(*) AS n_orders, CAST(SUM({_money('o_totalprice')}) AS DECIMAL(38,2)) AS total_spent
        FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1""",
    "key_ranges": "\n        UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) AS rows, COUNT({c}) AS values, "
        f"CAST(MIN({c}) AS BIGINT) AS min_value, CAST(MAX({c}) AS BIGINT) AS max_value FROM lineitem"
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")),
    "next_event": """
        SELECT user_id, event_id, ts, LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts
        FROM events""",
    "customer_spend_rank": f"""
        WITH s AS (SELECT o_custkey, {TOTAL_PRICE} AS total_spent FROM {LO} GROUP BY o_custkey)
        SELECT o_custkey, total_spent, RANK() OVER (ORDER BY total_spent DESC) AS spend_rank FROM s""",
    "order_rank_within_customer": f"""
        SELECT o_orderkey, o_custkey, {_money('o_totalprice')} AS price,
               RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS price_rank
        FROM orders""",
    "running_daily_revenue": f"""
        WITH d AS (SELECT CAST(o_orderdate AS DATE) AS order_day,
                          CAST(SUM({_money('o_totalprice')}) AS DECIMAL(38,2)) AS revenue
                   FROM orders GROUP BY 1)
        SELECT order_day, revenue, CAST(SUM(revenue) OVER (ORDER BY order_day) AS DECIMAL(38,2)) AS running_total,
               {_mean('SUM(revenue) OVER (ORDER BY order_day) * 100', 'COUNT(revenue) OVER (ORDER BY order_day)')}
               AS moving_avg
        FROM d""",
    # ---------------------------------------------------------- audits
    "audit_duplicates": """
        SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""",
    "audit_nulls": f"""
        WITH {DIRTY_BRAND}
        SELECT p_partkey, p_type FROM dirty WHERE raw_brand IN ('', 'null', 'NaN') OR raw_brand IS NULL""",
    "audit_orphans": """
        SELECT l_returnflag, COUNT(*) AS orphan_lines FROM lineitem
        WHERE l_orderkey IS NOT NULL
          AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
        GROUP BY l_returnflag""",
    "audit_length": """
        SELECT p_partkey, p_name, CAST(length(p_name) AS INTEGER) AS length FROM part WHERE length(p_name) > 10""",
}
