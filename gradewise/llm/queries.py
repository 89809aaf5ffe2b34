"""The queries ``opN_*`` over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise import prepare
from gradewise.llm import langid, quality
from gradewise.llm.ann import nearest
from gradewise.llm.bpe import round_trip_digests
from gradewise.llm.html_text import extract
from gradewise.llm.line_dedup import dedup_lines
from gradewise.llm.merkle import fingerprints
from gradewise.llm.minhash_dedup import near_duplicates
from gradewise.llm.packing import pack
from gradewise.llm.url_filter import judge

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


OP1_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
sets as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [ws]
    else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i:i+3])) end as sh
  from words),
grams as (select doc_id, unnest(sh) as g from sets),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as n from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (
  select x, y from shared join sets p on p.doc_id = x join sets q on q.doc_id = y
  where 100 * n >= 80 * (len(p.sh) + len(q.sh) - n)),
edges as (select x, y from links union all select y, x from links),
reach as (
  select doc_id as id, doc_id as root from documents
  union
  select e.y, r.root from reach r join edges e on e.x = r.id where r.root < e.y),
roots as (select id, min(root) as component_id from reach group by id)
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles, r.component_id, s.doc_id = r.component_id as kept
from sets s join roots r on r.id = s.doc_id
"""

def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, and how many code points went."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_chars")


def op3_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = langid.fit(docs.where(remainder != 0))
    return langid.identify(docs, model).select(
        F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


#: Words of a leaf, as SQL writes the tree of merkle.py.
OP6_SQL = r"""
with base as (select doc_id, coalesce(text, '') as text from documents),
ordered as (
  select doc_id, text, coalesce(lead(text) over (order by doc_id desc), first_value(text) over (order by doc_id desc)) as next_text
  from base),
edits as (
  select *, length(text) as n, length(text) // 3 as k,
    substring(text, 1, length(text) - length(text) // 3) || substring(next_text, 1, length(text) // 3) as edited
  from ordered),
texts as (
  select doc_id, 0 as kind, text as t from edits union all select doc_id, 1, edited from edits union all select doc_id, 2, next_text from edits),
parsed as (
  select doc_id, kind, list_transform(string_split(t, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p:
      {'hash': sha256(p), 'leaves': list_transform(case when length(p) < 120 then regexp_extract_all(p, '[^ ]+(?: +[^ ]+)?') else regexp_extract_all(p, '[^ ]+(?: +[^ ]+){0,7}') end, lambda x: md5(x)[1:8])})) as tree
  from texts),
sections as (
  select doc_id, kind, list_transform(tree, lambda ps: {'hash': sha256(array_to_string(list_transform(ps, lambda p: p.hash), ',')),
      'body': array_to_string(list_transform(ps, lambda p: array_to_string(list_prepend(p.hash[1:16], p.leaves), '.')), '|')}) as ss,
    list_distinct(flatten(flatten(list_transform(tree, lambda ps: list_transform(ps, lambda p: p.leaves))))) as leaves,
    flatten(list_transform(tree, lambda ps: list_transform(ps, lambda p: p.hash[1:16]))) as paras
  from parsed),
prints as (
  select doc_id, kind, leaves, paras, sha256(array_to_string(list_transform(ss, lambda s: s.hash), ',')) as root,
    array_to_string(list_transform(ss, lambda s: s.hash[1:16] || '=' || s.body), ';') as body
  from sections)
select e.doc_id, cast(e.n as bigint) as n_chars, sha256(e.edited) as edited_sha256, a.root || ':' || a.body as fingerprint,
  b.root || ':' || b.body as edited_fingerprint,
  case when a.root = b.root then 1e0 when len(a.leaves) + len(b.leaves) = 0 then 0e0
    else least(2e0 * len(list_intersect(a.leaves, b.leaves)) / (len(a.leaves) + len(b.leaves)), 1e0 - 1e0 / (len(a.leaves) + len(b.leaves) + 1e0)) end as near_edited,
  case when a.root = c.root then 1e0 when len(a.leaves) + len(c.leaves) = 0 then 0e0
    else least(2e0 * len(list_intersect(a.leaves, c.leaves)) / (len(a.leaves) + len(c.leaves)), 1e0 - 1e0 / (len(a.leaves) + len(c.leaves) + 1e0)) end as near_next,
  list_filter(list_transform(range(0, len(a.paras)), lambda i: case when not list_contains(b.paras, a.paras[i + 1]) then cast(i as integer) end), lambda i: i is not null) as edited_at
from edits e join prints a on a.doc_id = e.doc_id and a.kind = 0 join prints b on b.doc_id = e.doc_id and b.kind = 1
  join prints c on c.doc_id = e.doc_id and c.kind = 2
"""


def op7_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4
    model = quality.fit(docs, labels.where(remainder("doc_id") != 2))
    return quality.score(docs, model).select(F.col("id").alias("doc_id"), (remainder("id") == 2).alias("held_out"), "score", "predicted")


def op8_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP8_SQL = r"""
with recursive parts as (
  select page_id, url, html, lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)) as host, regexp_extract(url, '^.*?://[^/?#]*(/[^?#]*)', 1) as path,
    case when contains(url, '://') then lower(regexp_extract(url, '^(.*?://[^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^([^#]*)', 1), '^.*?://[^/?#]*', '') end as node
  from pages),
rules(rh, rp, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits as (
  select page_id, rh || rp as rule, verdict, row_number() over (partition by page_id order by length(rh || rp) desc, rh || rp) as place
  from parts join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)),
tags as (select node, url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)[^>]*>')) as tag from parts where node is not null),
named as (
  select node, url, case
      when regexp_matches(tag, '(?is)rel\s*=\s*["'']?([^"''>]*\s)?canonical[\s"''>]') then nullif(regexp_extract(tag, '(?is)href\s*=\s*["'']?([^\s"''>]+)', 1), '')
      when regexp_matches(tag, '(?is)http-equiv\s*=\s*["'']?refresh') then nullif(trim(regexp_extract(tag, '(?is)url\s*=\s*[''"]?([^''">]*)', 1)), '') end as link
  from tags),
absolute as (
  select node, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link when starts_with(link, '//') then regexp_extract(url, '^([^:]*:)', 1) || link
      when starts_with(link, '/') then regexp_extract(url, '^(.*?://[^/?#]*)', 1) || link end as link
  from named),
links as (
  select node as a, lower(regexp_extract(link, '^(.*?://[^/?#]*)', 1)) || regexp_replace(regexp_extract(link, '^([^#]*)', 1), '^.*?://[^/?#]*', '') as b
  from absolute where link is not null),
edges as (select a, b from links where a <> b union select b, a from links where a <> b),
reach as (select a as id, a as root from edges union select e.b, r.root from reach r join edges e on e.a = r.id),
classes as (select id, min(root) as class from reach group by id),
member as (select p.page_id, host, path, f.rule, f.verdict as own, c.class from parts p left join fits f on f.page_id = p.page_id and f.place = 1 left join classes c on c.id = p.node),
sums as (select class, max(case when own = 'allow' then 1 else 0 end) as allows, max(case when own = 'block' then 1 else 0 end) as blocks, count(*) as n from member where class is not null group by class)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule,
  coalesce(own, case when blocks = 1 and allows = 0 then 'block' else 'allow' end) as verdict, coalesce(n, 1) as class_size
from member left join sums using (class)
"""


def op9_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


OP9_SQL = r"""
with v as (select vec_id, cast(embedding as double[]) as x from embeddings where embedding is not null and vec_id is not null),
ok as (select * from v where len(x) > 0 and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(x, lambda c: c <> 0)) > 0),
pairs as (select q.vec_id as query_id, o.vec_id, list_distance(q.x, o.x) as score from ok q join ok o on o.vec_id <> q.vec_id where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from pairs)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 10
"""


def op10_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_bpe_chunks": op3_bpe_chunks,
    "op4_packing": op4_packing,
    "op5_language_id": op5_language_id,
    "op6_merkle_fingerprints": op6_merkle_fingerprints,
    "op7_quality_nbsvm": op7_quality_nbsvm,
    "op8_url_aliases": op8_url_aliases,
    "op9_one_bit_neighbours": op9_one_bit_neighbours,
    "op10_html_layout": op10_html_layout,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": OP1_SQL,
    "op6_merkle_fingerprints": OP6_SQL,
    "op8_url_aliases": OP8_SQL,
    "op9_one_bit_neighbours": OP9_SQL,
}
