"""The registered queries over these operators, with production parameters, and their SQL."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, licenses, line_dedup, mixing, near_dup, quality, tokens, toxicity, vectors
from .shared import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def crc_mod(column: Column, n: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % n


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), lambda key: crc_mod(key, 5) != 0)
    found = quality.score(docs, model)
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path()
    tokens.write_shards(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokens.read_shards(spark, path)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_toxicity_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxic_model(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def toxic_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.train(docs, labels, lambda key: crc_mod(key, 4) != 2)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    words = F.transform("places", lambda p: p["word"])
    base = F.transform("places", lambda p: p["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    share = F.array_max(F.transform("blocks", lambda b: b["containment"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("blocks", lambda b: b["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
    )


def op4_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = "</s>[INST] ok [/INST]"
    extra = spark.sql("select -7L as conv_id, 0L as turn, 'user' as role, :t as text union all select -7L, 1L, 'assistant', :t", {"t": ok})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_trees(chat.linked(rows, "conv_id", "turn", "role", "text"))
    turns, loss = chat.parse(F.col("formatted")), chat.loss_text(F.col("segments"))
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op10_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"), lambda key: key % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_nbsvm": op1_quality_nbsvm,
    "op2_license_scan": op2_license_scan,
    "op3_token_wavelet": op3_token_wavelet,
    "op4_chat_trees": op4_chat_trees,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_latent_decontamination": op6_latent_decontamination,
    "op7_poisson_mix": op7_poisson_mix,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity_subword": op9_toxicity_subword,
    "op10_pivot_top_k": op10_pivot_top_k,
}

ORACLES: dict[str, str] = {}

# Equal shares for all sources and as many rows as there are: a row's rate is n / (sources x rows of its source).
ORACLES["op7_poisson_mix"] = """
with recursive n as (select source, count(*) as rows_there from documents group by source),
rates as (select source, (1e0 / (select count(*) from n)) * (select sum(rows_there) from n)::double / rows_there as rate from n),
drawn as (
  select d.*, r.rate, md5(coalesce(d.text, '')) as print,
    ('0x' || substr(md5('0|' || coalesce(d.doc_id::varchar, '') || '|' || md5(coalesce(d.text, ''))), 1, 13))::bigint::double / 4503599627370496e0 as u
  from documents d join rates r on d.source is not distinct from r.source),
terms as (
  select source, rate, 0 as k, exp(-rate) as p, exp(-rate) as c from rates
  union all
  select source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from terms where k < 60 + 13 * rate),
counted as (
  select d.*, (select count(*) from terms t where t.source is not distinct from d.source and t.c <= d.u) as times from drawn d)
select doc_id, text, lang, source, n_chars, copy::int as copy,
  ('0x' || substr(md5('1|' || coalesce(doc_id::varchar, '') || '|' || print || '|' || copy::varchar), 1, 13))::bigint::double / 4503599627370496e0 as shuffle_key
from (select *, unnest(generate_series(1, times)) as copy from counted where times > 0)
"""

ORACLES["op10_pivot_top_k"] = """
with good as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.v, c.v)::bigint as score
  from good q join good c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 20
"""

_GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ASCII = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _words(text: str) -> list[str]:
    return re.findall(_GAP, "".join(c.lower() if c in string.ascii_uppercase else c for c in text))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# A template's blocks are the runs of twice its words that start at every multiple of them; four fifths of its set must be there.
ORACLES["op2_license_scan"] = f"""
with docs as (select row_number() over () as rid, doc_id, regexp_extract_all({_ASCII}, '{_GAP}') as ws from documents),
phrases(p, label) as (values {", ".join(f"({_list(_words(p))}, '{label}')" for p, label in licenses.PHRASES.items())}),
templates(n, own, label) as (values {", ".join(f"({len(_words(t))}, {_list(sorted(set(_words(t))))}, '{label}')" for label, t in licenses.TEMPLATES)}),
starts as (select rid, label, unnest(list_filter(generate_series(0, len(ws) - len(p)), lambda i: ws[i + 1 : i + len(p)] = p)) as word from docs, phrases where len(ws) >= len(p)),
base as (select rid, count(*) as n_base, min(word) as first_word, max(word) as last_word, list(distinct label) as found from starts group by rid),
runs as (select rid, ws, n, own, label, unnest(generate_series(0, len(ws) - 1, n)) as a from docs, templates where len(ws) > 0),
shared as (select rid, label, len(own) as size, len(list_intersect(own, ws[a + 1 : a + 2 * n])) as hits from runs),
blocks as (select rid, max(hits / size::double) as score, list(distinct label) as found from shared where 5 * hits >= 4 * size group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.found), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.found, []), coalesce(blocks.found, [])))), ','), '') as labels,
  case when n_base > 0 then 1e0 else coalesce(blocks.score, 0e0) end as score
from docs left join base using (rid) left join blocks using (rid)
"""

# Every pair of documents that share a shingle, by exact Jaccard similarity, and what hangs together by such links.
ORACLES["op5_ngram_jaccard"] = f"""
with recursive docs as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_GAP}') as ws from documents),
sets as (select doc_id, list_distinct(case when len(ws) >= 5 then list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i : i + 4], ' '))
  when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as s from docs),
tokens as (select doc_id, len(s) as n, unnest(s) as token from sets),
links as (select a.doc_id as a, b.doc_id as b from tokens a join tokens b on a.token = b.token and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 9 * count(*) >= 4 * (a.n + b.n)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a),
class as (select a, min(b) as class_id from reach group by a),
degree as (select a, count(*) as n_links from links group by a)
select doc_id, class_id, coalesce(n_links, 0)::bigint as n_links from documents join class on class.a = doc_id left join degree on degree.a = doc_id
"""

_CONTROLS = "".join(f", '{c}', '{c[0]}\\{c[1:]}')" for c in chat.CONTROLS)
_ESCAPED = "replace(" * (len(chat.CONTROLS) + 1) + "{}, '\\', '\\\\')" + _CONTROLS

# Header and end of a turn have 13 characters beside the role.
ORACLES["op4_chat_trees"] = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns as (
  select *, length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {len("<||>") + 1 + len(chat.END)} as chars from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from turns group by conv_id
"""

# Jaccard similarity 0.8 as 9 x shared >= 4 x (both sizes).
ORACLES["op8_line_dedup"] = """
with docs as (select distinct doc_id, text from documents),
pieces as (select doc_id, text, string_split(text, chr(10)) as parts from docs),
each as (select doc_id, text, unnest(parts) as content, generate_subscripts(parts, 1) as line from pieces),
worded as (
  select doc_id, text, line, regexp_extract_all(lower(content), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from each),
keyed as (select doc_id, text, line, array_to_string(words, ' ') as key, words from worded where len(words) > 0),
firsts as (select key, min(row(doc_id, text, line)) as first, any_value(words) as words from keyed group by key),
sets as (
  select key, first, list_distinct(case when len(words) < 5 then [key] else
    list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')) end) as s from firsts),
tokens as (select key, first, len(s) as n, unnest(s) as token from sets),
shared as (
  select a.key as key from tokens a join tokens b on a.token = b.token and a.first > b.first
  group by a.key, b.key, a.n, b.n having 9 * count(*) >= 4 * (a.n + b.n)),
gone as (
  select k.doc_id, k.text, k.line from keyed k join firsts f on k.key = f.key
  where k.key in (select key from shared) or row(k.doc_id, k.text, k.line) <> f.first),
marked as (
  select e.*, g.line is not null as removed from each e left join gone g
    on e.doc_id = g.doc_id and e.text = g.text and e.line = g.line),
rebuilt as (
  select doc_id, text, coalesce(string_agg(content, chr(10) order by line) filter (where not removed), '') as kept,
    count(*) as n_lines, count(*) filter (where removed) as n_removed from marked group by doc_id, text)
select d.doc_id, r.kept as text, r.n_lines, r.n_removed from documents d join rebuilt r on d.doc_id = r.doc_id and d.text = r.text
"""
