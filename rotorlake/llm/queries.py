"""The registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontam, langid, license_scan, ngram_join, quality_gam, quality_rules, token_counts, token_files, url_filter
from .common import hashed_remainder, shared_folder, small_batches, table

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
RANKS, TOKENIZER, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
END_ID = 2


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a directory for each source, in it one for each 1000 and 100 ids."""
    return license_scan.scan(table(spark, sf_dir, "documents").withColumn("path", F.expr("concat_ws('/', source, doc_id div 1000, doc_id div 100, concat(doc_id, '.txt'))")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), folder, TOKENIZER, public_tokenizers.PATTERN, END_ID)
    return token_files.read(spark, folder, ids=False)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = hashed_remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held), PIECES)
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("class_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = hashed_remainder(F.col("doc_id"), 3) == 1
    model = quality_gam.train(docs.where(~held), table(spark, sf_dir, "labels"))
    scored = quality_gam.classify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_license_scan, op2_url_filter, op3_byte_bpe, op4_token_files, op5_decontamination, op6_language_id, op7_ngram_jaccard, op8_token_counts, op9_quality_rules, op10_quality_classifier, pipeline]
    return {f.__name__: small_batches(f) for f in own}


_URL_SQL = """
with parts as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
  from pages)
select page_id, host, path, case
    when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule,
  case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict
from parts"""

_FILES_SQL = "select doc_id, concat_ws('/', source, doc_id // 1000, doc_id // 100, doc_id || '.txt') as path, text from documents"


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LEAK_SQL = f"""
with d as (select doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, {_WORD}) as ws from documents),
b as (select coalesce(item_id::varchar, '') as item, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, {_WORD}) as ws from benchmark),
phrases as (select item, least(len(ws), 10) as n, unnest(range(0, len(ws) - least(len(ws), 10) + 1)) as i, ws from b where len(ws) > 0),
phrase as (select distinct item, n, array_to_string(ws[i + 1 : i + n], ' ') as p from phrases),
sizes as (select distinct n from phrase),
places as (select doc_id, n, unnest(range(0, len(ws) - n + 1)) as i, ws from d, sizes where len(ws) >= n),
hits as (select doc_id, n, i, item from (select doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') as p from places) join phrase using (n, p)),
covered as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join found using (doc_id)"""

_JOIN_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as ws from documents),
places as (select doc_id, ws, least(len(ws), 5) as n, unnest(range(0, len(ws) - least(len(ws), 5) + 1)) as i from d where len(ws) > 0),
s as (select distinct doc_id, array_to_string(ws[i + 1 : i + n], ' ') as g from places),
size as (select doc_id, count(*) as n from s group by doc_id),
pair as (select x.doc_id as a, y.doc_id as b, count(*) as n from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all),
link as (select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b where 100 * pair.n >= 75 * (x.n + y.n - pair.n)),
reach(doc_id, pos) as (select doc_id, doc_id from d union select reach.doc_id, link.b from reach join link on link.a = reach.pos),
low as (select doc_id, min(pos) as component_id from reach group by doc_id)
select d.doc_id, coalesce(size.n, 0) as n_shingles, component_id from d join low using (doc_id) left join size using (doc_id)"""


def _rules_sql() -> str:
    """Word by word; an n-gram is a hash of its halves, so that no list of words is carried."""
    shares = quality_rules.NGRAM_SHARES
    sizes = sorted({3, *shares})
    need: set[int] = set()

    def parts(n: int) -> None:
        if n > 1 and n not in need:
            need.add(n)
            half = 1 << (n - 1).bit_length() - 1
            parts(half)
            parts(n - half)

    for n in sizes:
        parts(n)
    grams, last = [], "word"
    for n in sorted(need):
        half = 1 << (n - 1).bit_length() - 1
        grams.append(f"g{n}s as (select *, hash(g{half}, lead(g{n - half}, {half}) over (partition by doc_id order by pos)) as g{n} from {last})")
        last = f"g{n}s"
    twice = ", ".join(f"case when pos + {n} <= n_all then (count(*) over (partition by doc_id, pos + {n} <= n_all, g{n}) > 1)::int else 0 end as r{n}" for n in sizes)
    inside = ", ".join(f"max(r{n}) over (partition by doc_id order by pos rows between {n - 1} preceding and current row) as i{n}" for n in sizes)
    covers = ", ".join(f"coalesce(sum(b * i{n}), 0) / greatest(coalesce(sum(b), 0), 1)::double as coverage_{n}" for n in shares)
    limits = " and ".join(f"coverage_{n} <= {most!r}" for n, most in shares.items())
    return f"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
word as (select doc_id, n_all, pos, length(w) as c, strlen(w) as b, hash(w) as g1 from (select doc_id, len(ws) as n_all, unnest(ws) as w, unnest(range(len(ws))) as pos from d)),
{", ".join(grams)},
twice as (select doc_id, pos, c, b, {twice} from {last}),
inside as (select doc_id, c, b, {inside} from twice),
base as (select doc_id, count(c) as n_words, coalesce(sum(c), 0)::bigint as word_chars, coalesce(sum(b), 0)::bigint as bytes, coalesce(sum(i3), 0)::bigint as n_repeat_words, {covers} from d left join inside using (doc_id) group by doc_id),
cut as (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(len(string_split(text, chr(10))))) as i from d),
line as (select doc_id, strlen(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g')) as b, row_number() over (partition by doc_id, l order by i) as r from cut),
lines as (select doc_id, count(*) as n_dup_lines, sum(b) as dup_bytes from line where b > 0 and r > 1 group by doc_id),
full_ as (select d.doc_id, n_words, word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
 coalesce(dup_bytes, 0) / greatest(bytes, 1)::double as line_coverage, {", ".join(f"coverage_{n}" for n in shares)} from d join base using (doc_id) left join lines using (doc_id))
select *, not base_failed and line_coverage <= {quality_rules.LINE_SHARE!r} and {limits} as kept from full_"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.sql(_FILES_SQL), "op2_url_filter": _URL_SQL, "op5_decontamination": _LEAK_SQL, "op7_ngram_jaccard": _JOIN_SQL, "op9_quality_rules": _rules_sql()}
