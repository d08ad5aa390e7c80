"""Views that present the supplied tables as document records.

Each adapter is one plain SELECT in SQL that Spark and DuckDB both accept; where a function
differs, the text holds ``{lines:...}``-style marks that are filled per engine. Queries run
their operator on these views; the oracle repeats the logic on the same views in SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# tables worth spreading when a small copy comes as a single row group
SPREAD = {"lineitem", "orders", "events", "documents", "conversations", "pages"}

# how the two engines write what standard SQL lacks
DIALECT = {
    "spark": {
        "explode_lines": "LATERAL VIEW posexplode(split({0}, '\\n')) AS {1}, {2}",
        "explode_ints": "LATERAL VIEW explode(array({1})) AS {0}",
    },
    "duckdb": {
        "explode_lines": (
            ", LATERAL (SELECT unnest(string_split({0}, chr(10))) AS {2}, "
            "unnest(range(0, len(string_split({0}, chr(10))))) AS {1})"
        ),
        "explode_ints": ", LATERAL (SELECT unnest([{1}]) AS {0})",
    },
}

VIEWS: dict[str, str] = {
    # a submission per order, a competition per customer
    "subs": """
        SELECT o.o_orderkey AS doc_id,
               CASE c.c_mktsegment WHEN 'BUILDING' THEN 'public' WHEN 'HOUSEHOLD' THEN 'residential'
                    WHEN 'MACHINERY' THEN 'industrial' WHEN 'AUTOMOBILE' THEN 'transport'
                    ELSE 'commercial' END AS facility_type,
               o.o_custkey AS competition_id, o.o_orderkey AS company,
               CASE o.o_orderstatus WHEN 'F' THEN 'win' WHEN 'P' THEN 'contracted' ELSE 'lose' END AS result,
               CASE o.o_orderstatus WHEN 'O' THEN 'lose' ELSE 'win' END AS cohort,
               o.o_totalprice AS price, CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS created_at,
               o.o_orderpriority AS priority
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    # a classified page per order line; line numbers repeat, so duplicates occur
    "cls": """
        SELECT l_orderkey AS doc_id, l_linenumber AS page,
               CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'AREA_TABLE'
                    WHEN 'AO' THEN 'COMMUNITY_PROGRAM' WHEN 'NF' THEN 'BUSINESS_VIABILITY'
                    WHEN 'NO' THEN 'FLOOR_PLAN' WHEN 'RF' THEN 'SKETCH' ELSE 'COVER' END AS type,
               l_discount * 10 AS confidence,
               (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS ord,
               CAST(l_quantity AS INT) AS quantity
        FROM lineitem""",
    "quant": """
        SELECT s.doc_id, s.facility_type, s.cohort, s.competition_id, s.result, q.total_pages,
               q.site AS site_area_sqm, q.building AS building_area_sqm,
               q.building * 4 AS total_floor_area_sqm,
               CASE WHEN s.priority = '1-URGENT' THEN NULL ELSE q.building * 3 END AS area_above_ground_sqm,
               CASE WHEN s.priority = '1-URGENT' THEN NULL ELSE q.building END AS area_below_ground_sqm,
               100 * q.building / q.site + q.tax * 10 AS building_coverage_ratio_pct,
               CASE WHEN s.priority = '5-LOW' THEN 100 * q.building / q.site / 2
                    ELSE 300 * q.building / q.site + q.tax * 20 END AS floor_area_ratio_pct,
               CAST(q.top_line * 18 AS DOUBLE) AS floors_above,
               CASE WHEN s.priority = '3-MEDIUM' THEN NULL ELSE CAST(q.total_pages + 2 AS DOUBLE) END AS floors_below,
               q.cars AS parking_count
        FROM subs s JOIN (
            SELECT l_orderkey, COUNT(*) AS total_pages, SUM(l_quantity) * 100 AS site,
                   CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 50 AS building,
                   CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS tax,
                   MAX(l_linenumber) AS top_line, SUM(l_quantity) AS cars
            FROM lineitem GROUP BY l_orderkey) q ON s.doc_id = q.l_orderkey""",
    "page_counts": """
        SELECT s.facility_type, s.cohort, s.doc_id, c.type AS primary_type, COUNT(*) AS pages,
               MAX(q.total_pages) AS total_pages
        FROM subs s JOIN cls c ON s.doc_id = c.doc_id
             JOIN (SELECT doc_id, COUNT(*) AS total_pages FROM cls GROUP BY doc_id) q ON q.doc_id = s.doc_id
        GROUP BY s.facility_type, s.cohort, s.doc_id, c.type""",
    "keywords": """
        SELECT s.facility_type, s.cohort, s.doc_id, p.p_name AS keyword
        FROM subs s JOIN lineitem l ON l.l_orderkey = s.doc_id JOIN part p ON p.p_partkey = l.l_partkey""",
    "mass_types": """
        SELECT s.facility_type, s.cohort, s.doc_id, p.p_type AS mass_type
        FROM subs s JOIN (SELECT l_orderkey, MIN(l_partkey) AS k FROM lineitem GROUP BY l_orderkey) l
             ON l.l_orderkey = s.doc_id JOIN part p ON p.p_partkey = l.k""",
    # brief pages: one per event of a user, in order of time
    "brief_pages": """
        SELECT user_id AS doc_id, event_id AS page,
               CASE event_type WHEN 'view' THEN 'BRIEF_EVALUATION' WHEN 'click' THEN 'BRIEF_PROGRAM'
                    WHEN 'signup' THEN 'BRIEF_PROJECT_INFO' WHEN 'purchase' THEN 'BRIEF_DESIGN_GUIDE'
                    ELSE 'NOTICE' END AS type,
               event_id % 3 = 0 AS has_scoring_table,
               CASE event_id % 11 WHEN 0 THEN '심사기준' WHEN 1 THEN '[서식 19] 참가자 확인서'
                    WHEN 2 THEN '17. 설계공모 결과 발표' WHEN 3 THEN '공고' WHEN 4 THEN '공고됨'
                    WHEN 5 THEN '[표 08] 상품 목록' WHEN 6 THEN '상품권' WHEN 7 THEN '부 록'
                    WHEN 8 THEN '5. 사업개요' WHEN 9 THEN '3-1. 공간구성' ELSE '' END AS page_header_text,
               value, event_id
        FROM events""",
    # requirement lines of a conversation's user, answer lines of its assistant
    "reqs": """
        SELECT conv_id AS doc_id, turn * 10000 + p AS idx,
               'axis' || CAST(CAST(FLOOR(turn / 2.0) AS BIGINT) % 3 AS STRING) AS axis, line AS description
        FROM conversations {explode_lines:text:p:line} WHERE role = 'user'""",
    "maps": """
        SELECT conv_id AS doc_id, turn * 10000 + p AS idx,
               'axis' || CAST(CAST(FLOOR(turn / 2.0) AS BIGINT) % 3 AS STRING) AS axis, line AS requirement,
               CASE p % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'partial' WHEN 2 THEN 'no' WHEN 3 THEN 'unclear'
                    ELSE 'later' END AS status
        FROM conversations {explode_lines:text:p:line} WHERE role = 'assistant'""",
    # every line of every document; documents of one source and language belong together
    "doc_lines": """
        SELECT source, lang, doc_id, CAST(p AS BIGINT) AS p, doc_id * 100000 + p AS idx, line
        FROM documents {explode_lines:text:p:line}""",
    # scoring categories of an order, one page per ship year parity
    "categories": """
        SELECT l_orderkey AS doc_id, CAST(l_suppkey % 2 AS INT) + 1 AS page, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS ord,
               CASE WHEN l_linenumber = 7 THEN '' ELSE l_returnflag || l_linestatus || '계획' END AS name,
               CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS points,
               CASE WHEN l_discount > 0.08 THEN '공유' ELSE '' END AS shared,
               CASE WHEN l_orderkey % 3 = 0 THEN 100.0E0 ELSE NULL END AS total_points
        FROM lineitem""",
    # area rows of an order: site headings, facilities, spaces
    "area_rows": """
        SELECT l_orderkey AS doc_id, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS ord,
               CASE WHEN l_orderkey % 2 = 0 AND l_linenumber <= 2 THEN 'site_total'
                    WHEN l_linenumber <= 5 THEN 'facility' ELSE 'space' END AS row_type,
               CASE WHEN l_orderkey % 2 = 0 AND l_linenumber = 1 THEN '부지' || CAST(l_suppkey AS STRING)
                    WHEN l_orderkey % 2 = 0 AND l_linenumber = 2 THEN '총합계'
                    WHEN l_linenumber = 4 AND l_discount > 0.07 THEN '소 계'
                    ELSE '· ' || l_returnflag || l_linestatus || CAST(l_suppkey % 7 AS STRING) END AS name,
               CASE WHEN l_linenumber = 5 THEN NULL
                    ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) || ',000.5 ㎡' END AS area,
               CASE WHEN l_linenumber = 1 THEN CAST(CAST(l_quantity * 2 AS BIGINT) AS STRING) || ',000'
                    ELSE NULL END AS subtotal_area
        FROM lineitem""",
    # sites of a customer: one per order
    "site_rows": """
        SELECT o_custkey AS doc_id, o_orderkey AS ord,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    ELSE '부지' || CAST(o_orderkey % 3 + 1 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN ' (본관)' ELSE '' END END AS site_id,
               CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE CAST(CAST(FLOOR(o_totalprice) AS BIGINT) % 9000 AS DOUBLE) END AS site_area_sqm,
               CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE CAST(o_orderkey % 60 + 10 AS DOUBLE) END AS building_coverage_pct,
               CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE CAST(o_orderkey % 400 + 100 AS DOUBLE) END AS floor_area_ratio_pct,
               CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderkey % 90 + 4 AS DOUBLE) END AS max_height_m,
               CAST(CAST(FLOOR(o_totalprice) AS BIGINT) % 50000 AS DOUBLE) AS floor_area_sqm,
               CASE o_orderkey % 5 WHEN 0 THEN '제2종일반주거지역' WHEN 1 THEN '준공업지역, 방화지구'
                    WHEN 2 THEN '제3종일반주거지역 (제2종일반주거지역에서 종상향)' WHEN 3 THEN '미정' ELSE '' END AS zoning,
               CASE o_orderkey % 4 WHEN 0 THEN '어린이집(노유자시설)' WHEN 1 THEN '구청(업무시설) 주택(공동주택)'
                    WHEN 2 THEN '광장(휴게)' ELSE '도서관' END AS facility
        FROM orders""",
    # statements with counts and sites, made of order columns
    "statements": """
        SELECT o_custkey AS doc_id, o_orderkey AS ord,
               CASE o_orderkey % 6
                    WHEN 0 THEN '부지1 및 부지' || CAST(o_orderkey % 3 + 1 AS STRING) || '에 주차 ' || CAST(o_orderkey % 900 AS STRING) || '대 이상 확보'
                    WHEN 1 THEN '총 2,001,' || CAST(o_orderkey % 800 + 100 AS STRING) || '대 설치'
                    WHEN 2 THEN '기존 주차장 ' || CAST(o_orderkey % 500 AS STRING) || '대 운영'
                    WHEN 3 THEN '부지2 용적률은 심의로 정한다'
                    WHEN 4 THEN '주차 ' || CAST(o_orderkey % 70 AS STRING) || '대'
                    ELSE '배치는 남측을 우선 고려' END AS text
        FROM orders""",
    "addresses": """
        SELECT o_custkey AS doc_id, o_orderkey AS ord,
               CASE o_orderkey % 3
                    WHEN 0 THEN '서울특별시 중구 세종로 ' || CAST(o_orderkey AS STRING) || ' (부지1), 태평로 ' || CAST(o_custkey AS STRING) || '(부지2)'
                    WHEN 1 THEN '역삼동 ' || CAST(o_orderkey AS STRING) || '(부지 3)'
                    ELSE '경기도 수원시 팔달구 효원로 ' || CAST(o_orderkey AS STRING) END AS address
        FROM orders""",
    # guideline items: one per order line, an entry per line number
    "guideline_items": """
        SELECT l_suppkey AS doc_id, l_linenumber AS page, l_orderkey AS entry, l_partkey AS item,
               CASE WHEN l_returnflag = 'A' THEN '' ELSE '구청' || l_returnflag END AS facility_scope,
               CASE WHEN l_linestatus = 'F' THEN '전체' ELSE '로비' END AS space_scope,
               CASE WHEN l_tax > 0.05 THEN '' ELSE '배치' END AS category,
               '계획 > ' || l_linestatus || CAST(l_suppkey % 4 AS STRING) || CASE WHEN l_discount > 0.05 THEN ' > 상세 > 끝' ELSE ' >  ' END AS section_path,
               CASE WHEN l_quantity > 40 THEN '유의' ELSE '' END AS label,
               CASE WHEN l_quantity < 3 THEN ' '
                    ELSE '반드시 ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '층 배치, 이용자의 접근과 관리의 편의를 함께 살피고 주변 건물과의 관계, 향과 소음, 이후의 증축까지 미리 헤아려 정하며, ' || l_returnflag || ' 특히 고려' END AS text
        FROM lineitem""",
    # table rows of an order: its lines in a fixed order, with the number of rows
    "table_lines": """
        SELECT l_orderkey AS doc_id,
               CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) AS r,
               CAST(COUNT(*) OVER (PARTITION BY l_orderkey) AS INT) AS n,
               l_returnflag, l_linestatus, l_linenumber, l_suppkey, l_quantity, l_tax, l_discount
        FROM lineitem""",
    # a scoring table per order: the name cell of rows 1-2 or their points cell may be merged. The first
    # line also gives the header (c from 4), and lines are numbered as in table_lines, but by the name that
    # the tables have: so they are exchanged once and stay with their order
    "scoring_cells": """
        SELECT doc_id, CASE WHEN c < 4 THEN r ELSE 0 END AS row, c % 4 AS col,
               CASE c WHEN 0 THEN CASE WHEN r = n AND n > 3 THEN '합 계' WHEN r = 2 AND n > 1 AND doc_id % 2 = 0 THEN '' ELSE l_returnflag || '계획' || CAST(r AS STRING) END
                      WHEN 1 THEN CASE WHEN l_linestatus = 'F' THEN '세부' || CAST(l_linenumber AS STRING) ELSE '' END
                      WHEN 2 THEN '등급별 99점'
                      WHEN 3 THEN CASE WHEN r = n AND n > 3 THEN '100' WHEN r = 2 AND n > 2 AND doc_id % 3 = 0 THEN ''
                                       ELSE '○' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '점' END
                      WHEN 4 THEN '구분' WHEN 5 THEN '세부 항목' WHEN 6 THEN '점수 계산 방법' ELSE '배점' END AS text,
               CASE WHEN r = 1 AND ((c = 0 AND n > 1 AND doc_id % 2 = 0) OR (c = 3 AND n > 2 AND doc_id % 3 = 0)) THEN 2 ELSE 1 END AS rowspan
        FROM (SELECT doc_id, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) AS r,
                     CAST(COUNT(*) OVER (PARTITION BY doc_id) AS INT) AS n, l_returnflag, l_linestatus, l_linenumber, l_quantity
              FROM (SELECT l_orderkey AS doc_id, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_returnflag, l_linestatus, l_linenumber, l_quantity
                    FROM lineitem) b) t {explode_ints:c:0, 1, 2, 3, 4, 5, 6, 7} WHERE c < 4 OR r = 1""",
    "unit_cells": """
        SELECT doc_id, 0 AS row, 0 AS col, CASE WHEN doc_id % 10 = 0 THEN '심사 배점' ELSE '구분' END AS text
        FROM table_lines WHERE r = 1
        UNION ALL
        SELECT doc_id, r, col,
               CASE col WHEN 0 THEN CASE WHEN l_linestatus = 'F' THEN CAST(l_suppkey % 9 + 1 AS STRING) || 'BL (임대)' ELSE '' END
                        WHEN 1 THEN CASE WHEN l_returnflag = 'A' THEN CAST(l_linenumber * 10 AS STRING) || '형' ELSE '' END
                        WHEN 2 THEN CASE WHEN l_tax > 0.02 THEN '전용 ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '㎡' ELSE '' END
                        WHEN 3 THEN CASE WHEN l_discount > 0.05 THEN CAST(l_linenumber AS STRING) || '% 내외' ELSE '' END
                        ELSE '비고' || CAST(l_linenumber AS STRING) END
        FROM table_lines t {explode_ints:col:0, 1, 2, 3, 4}""",
    # parts as search documents with weighted columns
    "part_docs": """
        SELECT CAST(p_partkey AS STRING) AS competition_id, p_name AS facility_text, p_brand AS ranking,
               p_type AS differentiators, p_name || ' ' || p_type AS winner_patterns, p_type AS concept_keywords,
               CASE WHEN p_size > 25 THEN 'high' ELSE 'partial' END AS alignment,
               p_brand || ' ' || CAST(p_size AS STRING) AS extra_meta, p_size
        FROM part""",
}


def _fill(text: str, engine: str) -> str:
    def put(m: re.Match) -> str:
        name, *args = m.group(1).split(":")
        return DIALECT[engine][name].format(*args)

    return re.sub(r"\{(\w+:[^}]*)\}", put, text)


def chain(names: list[str]) -> list[str]:
    """The named views and all they build on, in order."""
    need: list[str] = []

    def visit(name: str) -> None:
        if name in need:
            return
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
                visit(other)
        need.append(name)

    for n in names:
        visit(n)
    return need


def with_clause(names: list[str], engine: str) -> str:
    return ",\n".join(f"{n} AS ({_fill(VIEWS[n], engine)})" for n in chain(names))


def oracle(uses: str, sql: str) -> str:
    """DuckDB text: the views, optional further views, and the final SELECT."""
    sql = sql.strip()
    views = with_clause(uses.split(), "duckdb") if uses.split() else ""
    if re.match(r"(?i)\w+ AS( MATERIALIZED)? \(", sql):
        # RECURSIVE only allows what it names, so it may always stand there
        return "WITH RECURSIVE " + (views + ",\n" if views else "") + sql
    return (f"WITH {views}\n" if views else "") + sql


class Tables:
    """The supplied tables and the views over them, for one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """A supplied table. One that arrives in fewer splits than there are cores is spread
        out, so that work on its rows is not left to a single task; large inputs are read as
        they are split."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if name in SPREAD and df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores)
        return df

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}", name)

    def sql(self, text: str, uses: str = "") -> DataFrame:
        views = with_clause(uses.split(), "spark") if uses.split() else ""
        whole = (f"WITH {views}\n" if views else "") + text
        for name in TABLES:
            if re.search(rf"(?i)\b(?:FROM|JOIN)\s+{name}\b", whole):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(whole)


def r4(expr: str) -> str:
    """Oracle side of ``plans.registry.r4``."""
    return f"CAST(CAST({expr} AS DECIMAL(18,4)) AS DOUBLE)"


def r8(expr: str) -> str:
    """Oracle side of ``plans.registry.r8``."""
    return f"CAST(CAST({expr} AS DECIMAL(18,8)) AS DOUBLE)"
