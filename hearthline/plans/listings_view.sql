WITH base AS (
  SELECT
    (((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 1000
      + l_linenumber * 100 + CAST(l_quantity AS BIGINT)) * 10     AS id,
    r_regionkey                                                   AS agency_id,
    o_orderpriority                                               AS source_channel,
    CASE WHEN l_linenumber <= 2
         THEN concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) END AS source_external_id,
    concat(p_type, ' ', p_name)                                   AS title,
    concat(o_orderpriority, ' ', p_name, ' ', c_mktsegment)       AS description,
    CASE WHEN l_partkey % 55 <> 0
         THEN concat(n_name, ',  ', upper(p_name), ' ', p_brand) END AS address,
    CASE WHEN l_partkey % 5 <> 0 THEN c_mktsegment END            AS district,
    CASE WHEN l_partkey % 55 <> 0 THEN n_name END                 AS city,
    CASE WHEN l_partkey % 11 <> 0 THEN r_name END                 AS region_code,
    CASE WHEN l_partkey % 13 <> 0 THEN p_size * l_quantity ELSE 0.0 END AS area_sqm,
    CASE WHEN l_quantity < 50 THEN l_extendedprice END            AS price_rub,
    o_custkey                                                     AS cust,
    l_partkey                                                     AS partkey,
    CASE l_returnflag WHEN 'A' THEN 'sale' WHEN 'R' THEN 'rent' END AS listing_type,
    least(o_orderdate, l_shipdate)                                AS created_at,
    greatest(o_orderdate, l_shipdate)                             AS updated_at
  FROM lineitem
  JOIN orders   ON l_orderkey  = o_orderkey
  JOIN part     ON l_partkey   = p_partkey
  JOIN customer ON o_custkey   = c_custkey
  JOIN nation   ON c_nationkey = n_nationkey
  JOIN region   ON n_regionkey = r_regionkey
)
SELECT id, agency_id, source_channel, source_external_id, title, description, address,
       district, city, region_code, area_sqm, price_rub,
       CASE WHEN cust % 3 <> 0
            THEN concat('8 (900) ', lpad(CAST(cust AS STRING), 7, '0')) END           AS contact_phone,
       CASE WHEN cust % 3 = 0 AND cust % 15 <> 0
            THEN concat(' Customer', CAST(cust AS STRING), '@Example.com') END        AS contact_email,
       listing_type, created_at, updated_at
FROM base
UNION ALL  -- reposts: same object on another channel, other formatting
SELECT id + 1, agency_id, 'repost', CAST(NULL AS STRING), title, description,
       lower(city || ', ' || substr(address, length(city) + 4)),
       district, city, region_code, CASE WHEN area_sqm > 0 THEN area_sqm + 0.3 ELSE area_sqm END, price_rub,
       CASE WHEN cust % 3 <> 0
            THEN concat('+7 900 ', lpad(CAST(cust AS STRING), 7, '0')) END,
       CASE WHEN cust % 3 = 0 AND cust % 15 <> 0
            THEN concat('CUSTOMER', CAST(cust AS STRING), '@example.com') END,
       listing_type, created_at, updated_at + INTERVAL '5' DAY
FROM base WHERE partkey % 7 = 0
