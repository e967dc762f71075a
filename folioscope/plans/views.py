"""Views over the given tables that stand for page catalogs, chapters, pixels, links, facts, pairs and boxes.

Each is given twice: as a DataFrame, and as DuckDB SQL for the oracle.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SPARK = {
    "v1": """
        with r as (select l_suppkey as book,
          cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) - 1 as int) as page,
          1200 + cast(l_partkey % 5 as int) * 300 as height, cast(l_quantity as int) as q from {lineitem})
        select book, page, height,
          cast(case when q % 10 = 0 then 2 * (height * 7 div 10) when q % 7 = 0 then height else height * 7 div 10 end as int) as width,
          concat('Series ', cast(book as string), ' - v', lpad(cast(book % 100 as string), 2, '0'), ' - p', lpad(cast(page as string), 3, '0'),
            case when q % 10 = 0 then concat('-', lpad(cast(page + 1 as string), 3, '0')) else '' end,
            case when q % 4 = 0 then '.jpg' when q % 9 = 0 then '.txt' else '.png' end) as name from r""",
    "v2": """
        select book, cast((page - 5) div 37 as int) as ord,
          cast(case when ((page - 5) div 37) % 3 = 2 then ((page - 5) div 37) + 0.5 else ((page - 5) div 37) + 1 end as double) as number,
          page as start from v1 where page >= 5 and (page - 5) % 37 = 0""",
    "v3": """
        select label as image, vec_id, pos,
          cast(floor((greatest(least(cast(e as double), 0.5D), -0.5D) + 0.5D) * 255) as int) as v
        from {embeddings} lateral view posexplode(embedding) t as pos, e""",
    "v3c": """
        select image, vec_id, pos div 3 as px, max(case when pos % 3 = 0 then v end) as r, max(case when pos % 3 = 1 then v end) as g,
          max(case when pos % 3 = 2 then v end) as b from v3 group by image, vec_id, pos div 3 having count(*) = 3""",
    "v4": """
        select page_id, url, pos, href from (select page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) a from {pages})
        lateral view posexplode(a) t as pos, href""",
    "v5": """select event_id, ts, user_id, event_type, value, cast(get_json_object(props, '$.k') as int) as k from {events}""",
    "v6a": """
        select doc_id as id, doc_id div 97 as folder, concat('doc', cast(doc_id % 97 as string)) as stem_a,
          concat(case when doc_id % 11 = 0 then 'x' else 'doc' end, cast(doc_id % 97 as string)) as stem_b,
          n_chars as size_a, n_chars div 100 * (90 + doc_id % 21) + n_chars % 7 as size_b
        from {documents}""",
    "v6b": """
        select p_partkey as page_id, 0D as mx0, 0D as my0, p_size * 40D as mx1, 800D as my1,
          case when p_size % 3 = 0 then p_size * 1D else 0D end as cx0, 10D as cy0,
          case when p_size % 3 = 0 then p_size * 19D else p_size * 39D end as cx1, 790D as cy1 from {part}""",
}
_TABLES = ("lineitem", "embeddings", "pages", "events", "documents", "benchmark", "part")
_NEEDS = {"v2": ("v1",), "v3c": ("v3",)}

#: The same in DuckDB's dialect.
SQL = {
    "v1": """v1 as materialized (
        with r as (select l_suppkey as book,
          cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) - 1 as int) as page,
          1200 + cast(l_partkey % 5 as int) * 300 as height, cast(l_quantity as int) as q from lineitem)
        select book, page, height,
          cast(case when q % 10 = 0 then 2 * (height * 7 // 10) when q % 7 = 0 then height else height * 7 // 10 end as int) as width,
          concat('Series ', cast(book as varchar), ' - v', lpad(cast(book % 100 as varchar), 2, '0'), ' - p', lpad(cast(page as varchar), 3, '0'),
            case when q % 10 = 0 then concat('-', lpad(cast(page + 1 as varchar), 3, '0')) else '' end,
            case when q % 4 = 0 then '.jpg' when q % 9 = 0 then '.txt' else '.png' end) as name from r)""",
    "v2": """v2 as (
        select book, cast((page - 5) // 37 as int) as ord,
          cast(case when ((page - 5) // 37) % 3 = 2 then ((page - 5) // 37) + 0.5 else ((page - 5) // 37) + 1 end as double) as number,
          page as start from v1 where page >= 5 and (page - 5) % 37 = 0)""",
    "v3": """v3 as (
        select label as image, vec_id, cast(i - 1 as int) as pos,
          cast(floor((greatest(least(cast(embedding[i] as double), 0.5), -0.5) + 0.5) * 255) as int) as v
        from (select label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings))""",
    "v3c": """v3c as (
        select image, vec_id, pos // 3 as px, max(case when pos % 3 = 0 then v end) as r, max(case when pos % 3 = 1 then v end) as g,
          max(case when pos % 3 = 2 then v end) as b from v3 group by image, vec_id, pos // 3 having count(*) = 3)""",
    "v4": """v4 as (
        select page_id, url, cast(i - 1 as int) as pos, a[i] as href from (
          select page_id, url, a, unnest(range(1, len(a) + 1)) as i from (
            select page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) as a from pages)))""",
    "v5": """v5 as (select event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as int) as k from events)""",
    "v6a": """v6a as (
        select doc_id as id, doc_id // 97 as folder, concat('doc', cast(doc_id % 97 as varchar)) as stem_a,
          concat(case when doc_id % 11 = 0 then 'x' else 'doc' end, cast(doc_id % 97 as varchar)) as stem_b,
          n_chars as size_a, n_chars // 100 * (90 + doc_id % 21) + n_chars % 7 as size_b
        from documents)""",
    "v6b": """v6b as (
        select p_partkey as page_id, 0::double as mx0, 0::double as my0, p_size * 40::double as mx1, 800::double as my1,
          case when p_size % 3 = 0 then p_size * 1::double else 0::double end as cx0, 10::double as cy0,
          case when p_size % 3 = 0 then p_size * 19::double else p_size * 39::double end as cx1, 790::double as cy1 from part)""",
}


def _statement(name: str, sf_dir: str) -> str:
    files = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _TABLES}
    body = _SPARK[name].format(**files)
    for other in _NEEDS.get(name, ()):
        body = f"with {other} as ({_statement(other, sf_dir)}) {body}"
    return body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_statement(name, sf_dir))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder of the session; only on a local master, where none is set, in a temporary one."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="folioscope-")
    return f"{shared.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def with_views(names: str, body: str) -> str:
    """DuckDB SQL: ``body`` over the named views."""
    wanted: list[str] = []
    for name in names.split():
        for x in (*_NEEDS.get(name, ()), name):
            if x not in wanted:
                wanted.append(x)
    return "with " + ",\n".join(SQL[x] for x in wanted) + "\n" + body
