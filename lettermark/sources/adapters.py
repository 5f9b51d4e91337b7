"""Domain tables derived from the star-schema test tables.

Each text is valid both in Spark SQL and in the SQL of the checking engine; `{name}` stands for an input
table or for another adapter. Nothing here is part of an operator: a deployment reads its own tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VENUES = {"Nature": 1, "Science": 2, "PNAS": 3, "PRL": 4, "PR-B": 5, "Geology": 10}

_JOURNAL = ("CASE WHEN {k} % 2 = 0 THEN CAST(substring({p}, 1, 1) AS BIGINT) ELSE 10 + {k} % 37 END")
_J = _JOURNAL.replace("{k}", "o_orderkey").replace("{p}", "o_orderpriority")

ADAPTERS = {
    # bibliographic graph
    "papers": f"""
        SELECT o_orderkey AS paper_id,
               CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE concat('10.X/', CAST(o_orderkey AS STRING)) END AS doi,
               CAST(year(o_orderdate) AS INT) AS year,
               CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(month(o_orderdate) AS INT) END AS month,
               {_J} AS journal_id,
               CASE WHEN o_orderstatus = 'P' THEN 'Conference' ELSE 'Journal' END AS doc_type,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'r' ELSE '' END AS doc_sub_types,
               CAST(2 + o_orderkey % 9 AS INT) AS reference_count,
               CASE WHEN o_orderkey % 41 = 0 THEN NULL
                    WHEN o_orderkey % 50 = 1 THEN concat('Authors reply to ', CAST(o_orderkey AS STRING))
                    WHEN o_orderkey % 50 = 3 THEN concat('Reply to ', CAST(o_orderkey AS STRING))
                    ELSE concat('On topic ', CAST(o_orderkey % 500 AS STRING)) END AS title
        FROM {{orders}}""",
    "refs": "SELECT DISTINCT l_orderkey AS paper_id, l_partkey AS paper_reference_id FROM {lineitem}",
    "aps": """
        SELECT lower(concat('10.X/', CAST(l_orderkey AS STRING))) AS citing_doi,
               CASE WHEN l_linenumber = 7 THEN '10.x/none'
                    ELSE lower(concat('10.X/', CAST(l_partkey + 1 AS STRING))) END AS cited_doi
        FROM {lineitem} WHERE l_returnflag = 'R'""",
    "journals": """
        SELECT journal_id, count(*) AS paper_count FROM {papers} GROUP BY journal_id""",
    "links": """
        SELECT DISTINCT concat('10.X/', CAST(l.l_partkey AS STRING)) AS original_doi,
               concat('10.X/', CAST(l.l_orderkey AS STRING)) AS letter_doi,
               CASE p.journal_id WHEN 1 THEN 'Nature' WHEN 2 THEN 'Science' WHEN 3 THEN 'PNAS' WHEN 4 THEN 'PRL'
                    WHEN 5 THEN 'PR-B' ELSE 'Geology' END AS venue
        FROM {lineitem} l JOIN {papers} p ON p.paper_id = l.l_partkey
        WHERE l.l_quantity = 50 AND l.l_discount >= 0.03 AND p.journal_id IN (1, 2, 3, 4, 5, 10)""",
    # fields
    "field_parents": """
        SELECT DISTINCT CAST(100 + p_size AS BIGINT) AS child_field_id,
               CAST(CASE WHEN p_size <= 10 THEN 121332964 WHEN p_size <= 19 THEN 86803240
                         WHEN p_size <= 28 THEN 185592680 WHEN p_size <= 37 THEN 71924100
                         WHEN p_size <= 44 THEN 127313418 ELSE 999 END AS BIGINT) AS field_id
        FROM {part}
        UNION
        SELECT DISTINCT CAST(100 + p_size AS BIGINT), CAST(121332964 AS BIGINT) FROM {part}
        WHERE p_size IN (15, 30, 45)""",
    "pfos": """
        SELECT DISTINCT l.l_orderkey AS paper_id, CAST(100 + p.p_size AS BIGINT) AS field_id, l.l_discount AS score
        FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey
        UNION
        SELECT DISTINCT l.l_orderkey, h.field_id, l.l_tax
        FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey
        JOIN {field_parents} h ON h.child_field_id = 100 + p.p_size
        WHERE l.l_linestatus = 'F'""",
    "fos": """
        SELECT child_field_id AS field_id, 1 AS level, concat('field ', CAST(child_field_id AS STRING)) AS name
        FROM {field_parents}
        UNION
        SELECT field_id, 0, concat('field ', CAST(field_id AS STRING)) FROM {field_parents}""",
    # people
    "authorships": """
        SELECT l_orderkey AS paper_id, 10 * l_suppkey + l_linenumber AS author_id, l_suppkey AS affiliation_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey
                    ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS INT) AS seq
        FROM {lineitem}""",
    "affiliations": """
        SELECT s.s_suppkey AS affiliation_id, concat('grid.', CAST(s.s_nationkey AS STRING)) AS grid_id,
               n.n_name AS name, r.r_name AS country
        FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey
        JOIN {region} r ON r.r_regionkey = n.n_regionkey""",
    "authors": """
        SELECT DISTINCT 10 * l_suppkey + l_linenumber AS author_id,
               concat('name ', CAST((10 * l_suppkey + l_linenumber) % 77 AS STRING)) AS name FROM {lineitem}""",
    "gender_names": """
        SELECT name, CASE WHEN length(name) = 7 AND substring(name, 7, 1) >= '4' THEN 1
                          WHEN substring(name, 6, 1) < '4' THEN 1 ELSE 0 END AS gender
        FROM (SELECT DISTINCT name FROM {authors}) a WHERE name <> 'name 11' AND name <> 'name 22'""",
    "elite": """
        SELECT DISTINCT a.grid_id FROM {affiliations} a WHERE a.country IN ('EUROPE', 'ASIA')""",
    "rankings": """
        SELECT CAST(s.s_name AS STRING) AS university, 'All sciences' AS field, 0 AS frac_counting,
               concat(CAST(year(l.l_shipdate) AS STRING), '-', CAST(year(l.l_shipdate) + 3 AS STRING)) AS period,
               CAST(count(*) AS DOUBLE) AS impact_p,
               round(avg(CASE WHEN l.l_discount >= 0.09 THEN 1.0E0 ELSE 0.0E0 END), 9) AS pp_top5
        FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
        GROUP BY s.s_name, year(l.l_shipdate)""",
    "grid_ids": """
        SELECT s_name AS university, concat('grid.', CAST(s_suppkey AS STRING)) AS grid_id FROM {supplier}
        WHERE s_acctbal >= 0""",
    # attention and stance
    "attention": """
        SELECT e.id, p.doi, round(e.mean_value, 6) AS atyp_10pct_z,
               CASE WHEN e.id % 13 = 0 THEN NULL ELSE CAST(e.clicks AS INT) END AS tweet_count,
               CASE WHEN e.id % 11 = 0 THEN NULL ELSE CAST(e.buys AS INT) END AS newsfeed_count,
               CAST(e.n AS DOUBLE) AS team_size, p.journal_id, p.year, p.doc_type
        FROM (SELECT 13 * user_id + CAST(floor(value) AS BIGINT) % 13 AS id, count(*) AS n, avg(value) AS mean_value,
                     sum(CASE WHEN event_type IN ('click', 'view', 'signup') THEN 1 ELSE 0 END) AS clicks,
                     sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS buys
              FROM {events} GROUP BY 13 * user_id + CAST(floor(value) AS BIGINT) % 13) e
        JOIN {papers} p ON p.paper_id = e.id""",
    "stance": """
        SELECT CASE WHEN user_id % 2 = 0 THEN concat('10.x/', CAST(13 * user_id + event_id % 13 AS STRING))
                    ELSE concat('10.X/', CAST(13 * user_id + event_id % 13 AS STRING)) END AS doi,
               CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS INT) AS contrasting_received,
               CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INT) AS supporting_received,
               CAST(count(*) AS INT) AS mentioning_received
        FROM {events} GROUP BY user_id, event_id % 13""",
    # reference lists with many journals
    "brand_refs": """
        SELECT l.l_orderkey AS citing_paper_id, CAST(substring(p.p_brand, 7) AS BIGINT) AS reference_journal_id,
               CAST(year(l.l_shipdate) AS INT) AS reference_year, CAST(year(o.o_orderdate) AS INT) AS citing_year,
               l.l_partkey * 100 + l.l_linenumber AS row_key
        FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey JOIN {orders} o ON o.o_orderkey = l.l_orderkey""",
    # vectors
    "paper_vectors": """
        SELECT p.paper_id, e.embedding
        FROM (SELECT paper_id, paper_id % (SELECT count(*) FROM {embeddings}) AS slot FROM {papers}) p
        JOIN {embeddings} e ON e.vec_id = p.slot""",
    # titles with comments
    "title_papers": """
        SELECT page_id AS paper_id, concat('10.P/', CAST(page_id AS STRING)) AS doi, CAST(1 AS BIGINT) AS journal_id,
               CAST(2000 + page_id % 25 AS INT) AS year,
               regexp_extract(html, '<title>(.*?)</title>', 1) AS original_title
        FROM {pages}
        UNION ALL
        SELECT 1000000000 + page_id, CASE WHEN page_id % 17 = 0 THEN '' ELSE concat('10.C/', CAST(page_id AS STRING)) END,
               CAST(1 AS BIGINT), CAST(2000 + page_id % 25 AS INT),
               CASE page_id % 5
                 WHEN 0 THEN concat('Comment on "', replace(t, 'e', 'x'), '"')
                 WHEN 1 THEN concat('Comment on: ', substring(t, 1, length(t) - 3), 'Q')
                 WHEN 2 THEN concat('Comment on ', substring(t, 2))
                 WHEN 3 THEN concat('comment "', upper(t), '" revisited')
                 ELSE concat('A note on ', t) END
        FROM (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS t FROM {pages}) q""",
}
_NAME = re.compile(r"\{(\w+)\}")


def adapter_inputs(name: str) -> list[str]:
    return _NAME.findall(ADAPTERS[name])


class Frames:
    """Base tables and adapters of one data folder as lazily built DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in ADAPTERS):
            raise AttributeError(name)
        if name not in self._cache:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                inputs = {n: getattr(self, n) for n in dict.fromkeys(adapter_inputs(name))}
                df = self.spark.sql(ADAPTERS[name], **inputs)
            self._cache[name] = df
        return self._cache[name]
