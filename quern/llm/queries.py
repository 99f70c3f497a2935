"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bottom_k, embed_dedup, html_text, langid, line_dedup, mixing, periodic_runs, quality, ranked_search, sentencepiece_codec, simhash, toxicity
from .common import table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, rows.where(F.col("vec_id") % 50 == 0))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, how many they are, and the digest of the text that they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.round_trip(docs, sentencepiece_codec.vocabulary()).select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_ids"), F.md5("decoded").alias("decoded_md5"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.in_fold(F.col("doc_id"), 4, 2))
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.drop_site_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites are sources; the languages of a source are its paths. Labels of every fifth document stay unseen."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    labels = table(spark, sf_dir, "labels").where(~langid.in_fold(F.col("doc_id"), 5, 0))
    out = quality.score(docs, quality.train(docs, labels))
    return out.withColumn("held_out", langid.in_fold(F.col("doc_id"), 5, 0)).select("doc_id", "held_out", "evidence", "prior", "score", "keep")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", langid.in_fold(F.col("doc_id"), 5, 0))
    labels = table(spark, sf_dir, "labels").where(~langid.in_fold(F.col("doc_id"), 5, 0))
    return toxicity.predict(docs, toxicity.train(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text, after repetitions are put into every tenth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic_runs.planted(F.col("text"), F.col("doc_id")).alias("text"))
    out = periodic_runs.collapse(docs).withColumn("best", periodic_runs.longest(F.col("runs")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.indexed(table(spark, sf_dir, "documents"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bottom_k.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = bottom_k.with_sketch(docs, "edited", "edited_sketch")
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), bottom_k.written(own).alias("fingerprint"), bottom_k.written(edited).alias("edited_fingerprint"),
        bottom_k.resemblance(own, edited).alias("near_edited"), bottom_k.resemblance(own, after).alias("near_next"),
        bottom_k.containment(own, edited).alias("kept_in_edited"), bottom_k.distinct_count(own).alias("n_shingles"),
    )


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2_SQL, "op5_line_dedup": OP5_SQL, "op6_embedding_dedup": OP6_SQL, "op12_ranked_search": OP12_SQL}


OP2_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                  md5(concat('17:', coalesce(doc_id::varchar, ''))) as key from documents),
s as (select source, sum(size)::bigint as source_size, count(*) as n from d group by source),
p as (select *, row_number() over (order by source asc nulls last) as place from s),
w as (select *, case (place - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from p),
f as (select *, 2.0::double * source_size / weight as "full", sum(source_size) over () as total, sum(weight) over () as weights from w),
l as (select *, (1.5::double * total - 2.0::double * coalesce(sum(source_size) over before, 0)) / (weights - coalesce(sum(weight) over before, 0.0::double)) as level
      from f window before as (order by "full", place rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(2.0::double * source_size, coalesce((select max(level) from l where "full" >= level) * weight, 2.0::double * source_size)) as target from l),
b as (select *, floor(target)::bigint as budget, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs from t),
r as (select d.doc_id, d.size, d.source, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size as rest,
             count(*) over (partition by d.source, d.key, d.doc_id, d.size) as copies,
             sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size range between unbounded preceding and current row) as upto
      from d join b on d.source is not distinct from b.source)
select doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, (rest - (upto - copies * size)) // copies)))::bigint as taken
from r
"""

OP5_SQL = r"""
with d as (select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
p as (select distinct source, text, lines from d where text is not null),
c as (select source, k, count(*) as n from (
        select distinct source, text, unnest(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)))) as k from p)
      where k <> '' group by source, k),
t as (select source, count(*) as pages from p group by source),
b as (select c.source, list(c.k) as bad from c join t on c.source is not distinct from t.source where n >= least(5, greatest(2, pages)) and n > 0.05::double * pages group by c.source),
k as (select d.*, case when bad is null then lines else list_filter(lines, lambda x: not list_contains(bad, trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)))) end as kept
      from d left join b on d.source is not distinct from b.source)
select doc_id, case when text is null then 0 else len(lines) end::int as n_lines, case when text is null then 0 else len(lines) - len(kept) end::int as n_dropped,
       length(coalesce(array_to_string(kept, chr(10)), case when text is null then null else '' end))::bigint as n_chars,
       md5(coalesce(array_to_string(kept, chr(10)), case when text is null then null else '' end)) as text_md5
from k
"""

# All pairs, so for small tables.
OP6_SQL = r"""
with recursive v as (select vec_id, embedding::double[] as v from embeddings),
g as (select vec_id, case when len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0 then v end as v from v),
p as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from g where v is not null),
e as (select a.vec_id as src, b.vec_id as dst from p a join p b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])) / (a.norm * b.norm) >= 0.95::double),
r as (select vec_id, vec_id as root from v union select e.dst, r.root from r join e on e.src = r.vec_id),
c as (select vec_id, min(root) as component_id from r group by vec_id),
n as (select src, count(distinct dst) as n from e group by src)
select c.vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, c.vec_id = component_id as kept from c left join n on n.src = c.vec_id
"""

OP12_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents where text is not null),
s as (select count(*)::bigint as all_docs, sum(len(terms))::bigint as all_terms from d where len(terms) > 0),
p as (select doc_id, n, term, count(*)::bigint as tf from (select doc_id, len(terms)::bigint as n, unnest(terms) as term from d) group by doc_id, n, term),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
w as (select term, floor(1000 * ln((2.0::double * all_docs + 2) / (2.0::double * count(*) + 1)))::bigint as w from p, s group by term, all_docs),
r as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_docs) // all_terms))))::bigint as score
      from q join w using (term) join p using (term), s group by item_id, doc_id),
k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from r where score > 0)
select item_id, rank, doc_id, score from k where rank <= 50
"""
