"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, html_extract, langid, media, mixing, packing, simhash_dedup, suffix_dedup, token_counts, toxicity, url_filters, vector_codes
from .common import id_bucket

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as 8-bit samples, sniffed, read back and digested."""
    return media.store_documents(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with their best match."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key").withColumn("contaminated", F.lit(True))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = html_extract.extract(pages, html_extract.train(pages))
    return texts.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of every whole text."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text without the bytes of repeated strings of 400 bytes."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_filters.judge(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the class of those it is linked to."""
    groups = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash_dedup.hex_fingerprint().alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or toxicity of every whole text; labels of rows held out are never read in training."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), id_bucket("doc_id", 5) != 0)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("offending").alias("n_offending"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, id_bucket("doc_id", 3) != 1)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "language.lang_pred", "language.score")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix of the sources by weight takes from each document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's code of 8 parts, by codebooks of 16 entries."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes from each source, in every order of the filters."""
    return filter_audit.audit(filter_audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {
    "op1_media_columns": op1_media_columns,
    "op2_decontamination": op2_decontamination,
    "op3_html_extraction": op3_html_extraction,
    "op4_token_counts": op4_token_counts,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_mixing": op11_mixing,
    "op12_vector_codes": op12_vector_codes,
    "op13_filter_audit": op13_filter_audit,
}

_RULES = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in url_filters.RULES)
_LINK = url_filters.LINK.replace("'", "''")



def _codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS, scale: int = vector_codes.SCALE) -> str:
    """Every round of the codebooks as a step of the query; ``x`` has a row for each component."""
    near = lambda c: f"select n, part, arg_min(e, (far, e)) as e, min(far) as far from (select n, part, e, sum((v - b) * (v - b)) as far from x join {c} using (part, d) group by all) group by n, part"
    steps = [
        f"""r as (select row_number() over (order by vec_id nulls last, embedding) as n, vec_id, label, embedding, len(embedding) // {parts} as w from embeddings
    where embedding is not null and len(list_filter(embedding, lambda q: q is null or not isfinite(q))) = 0)""",
        f"x as (select n, (i - 1) // w as part, (i - 1) % w as d, floor({scale} * embedding[i]::double)::bigint as v from (select *, unnest(range(1, len(embedding) + 1)) as i from r))",
        f"c0 as materialized (select part, n - 1 as e, d, v as b from x where n <= {entries})",
    ]
    for k in range(rounds):
        steps.append(f"a{k} as ({near(f'c{k}')})")
        steps.append(f"""c{k + 1} as materialized (select part, e, d, coalesce(s, b) as b from c{k} left join
    (select part, a.e, d, floor(sum(v)::hugeint / count(*))::bigint as s from x join a{k} a using (n, part) group by all) using (part, e, d))""")
    return f"""with {", ".join(steps)},
  final as materialized ({near(f"c{rounds}")}),
  coded as (select n, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by part) as code, sum(far)::bigint as error from final group by n),
  sha as (select sha256(string_agg(b::varchar, ',' order by part, e, d)) as codebooks_sha256 from c{rounds})
  select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join r using (n) cross join sha"""



#: The other operators use hashes, tokenizers or trained models that SQL lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_url_filters": f"""with recursive u as (select page_id, html, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
  hp as (select row_number() over () as n, page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filters.UPPER}', '{url_filters.LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
  rules(verdict, rule) as (values {_RULES}),
  fit as (select n, arg_max(rule, length(rule) * 2 + (verdict = 'block')::int) as rule from hp join rules on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, strpos(rule, '/'))) group by n),
  j as (select hp.n, page_id, host, path, fit.rule, verdict as said from hp left join fit on hp.n = fit.n left join rules on fit.rule = rules.rule),
  c as (select host, count(*) filter (where said = 'allow') as a, count(*) filter (where said = 'block') as b from j where said is not null group by host),
  seeds as (select host, coalesce(a / nullif((select sum(a) from c), 0), 0) as s, coalesce(b / nullif((select sum(b) from c), 0), 0) as b from c),
  l as (select host as src, translate(unnest(regexp_extract_all(html, '{_LINK}', 1)), '{url_filters.UPPER}', '{url_filters.LOWER}') as dst from hp),
  e0 as (select src, dst, count(*) as n from l where src <> '' and src <> dst group by all),
  e as (select src, dst, n / sum(n) over (partition by src) as fwd, n / sum(n) over (partition by dst) as back from e0),
  ranks as (select 0 as step, host, s as t, b as d from seeds
    union all select * from (select any_value(step) + 1 as step, host, sum(t) as t, sum(d) as d from (
      select step, dst as host, {url_filters.DAMPING} * t * fwd as t, 0 as d from e join ranks on src = host
      union all select step, src, 0, {url_filters.DAMPING} * d * back from e join ranks on dst = host
      union all select (select max(step) from ranks), host, (1 - {url_filters.DAMPING}) * s, (1 - {url_filters.DAMPING}) * b from seeds) group by host) where step <= {url_filters.STEPS}),
  r as (select host, t, d from ranks where step = (select max(step) from ranks))
  select page_id, j.host, path, rule, coalesce(said, case when coalesce(d, 0) > coalesce(t, 0) then 'block' else 'allow' end) as verdict from j left join r on j.host = r.host""",
    "op12_vector_codes": _codes_sql(),
    "op13_filter_audit": f"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
  w as (select *, regexp_extract_all(t, '{mixing.WORD}') as words, min(doc_id) over (partition by t) as least from d),
  m as (select doc_id, part, (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as mask from w),
  g as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
  c as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join g using (doc_id) group by all),
  l(f, own) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
  o as (select a.f || b.f || c.f || d.f || e.f as filter_order, [a.own, b.own, c.own, d.own, e.own] as bits from l a, l b, l c, l d, l e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
  s as (select filter_order, k as step, bits[k] as own, list_sum(bits[1:k]) - bits[k] as before from o, unnest(range(1, 6)) as u(k)),
  z as (select part, filter_order, step::int as step, own, sum(n) filter (where mask & (own | before) = 0) as kept, sum(n) filter (where mask & own > 0 and mask & before = 0) as removed, sum(n) filter (where mask & own > 0 and mask & before > 0) as redundant,
    sum(n) filter (where mask = own) as unique_fails, sum(good) filter (where mask & own > 0 and mask & before = 0) as good_lost, sum(toxic) filter (where mask & own > 0 and mask & before = 0) as toxic_lost from c, s group by all)
  select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
    coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, coalesce(sum(removed) over (partition by part, own), 0)::bigint as shapley from z""",
}
