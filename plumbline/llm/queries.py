"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language_id, packing, quotes, secret_scan, simhash, token_counts, token_store, url_filter
from .shared import new_path, stored, table


#: Tokenizer versions that op1 counts: column -> (vocabulary, kind).
TOKENIZERS = {"word_bpe_49k": ("word_bpe_49k.json", "word"), "byte_bpe_50k": ("byte_bpe_50k.json", "byte")}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, lang, tokenizer, docs, tokens after five batches: documents counted by one tokenizer, by a second one, the
    second one's counts revised (the end of a document counts as a token), the toxic documents taken down, and the first
    batch sent again, which changes nothing. Null sources and languages are groups; a document labelled twice goes once.
    """
    first, second = TOKENIZERS
    docs = token_counts.with_counts(table(spark, sf_dir, "documents"), {k: (public_tokenizers.path(name), kind) for k, (name, kind) in TOKENIZERS.items()})
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(True))
    counted = stored(docs.join(toxic, "doc_id", "left"), "token-counts")
    change = lambda op, tokenizer, tokens, old=None: counted.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(op).alias("op"), tokens.alias("tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"), "toxic")
    rollup = token_counts.Rollup(spark, new_path(spark, "rollup"))
    rollup.commit("1-load", change("insert", first, F.col(first)))
    rollup.commit("2-second", change("insert", second, F.col(second)))
    rollup.commit("3-ends", change("revise", second, F.col(second) + 1, second))
    rollup.compact()
    rollup.commit("4-takedown", change("delete", first, F.col(first)).unionAll(change("delete", second, F.col(second) + 1)).filter("toxic"))
    if rollup.commit("1-load", change("insert", first, F.col(first))):
        raise AssertionError("a batch was committed twice")
    return rollup.totals()


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of documents; a null doc_id isn't held out and not learned from."""
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    dictionaries = language_id.learn(docs, ~held)
    out = language_id.classify(docs, dictionaries)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of documents, from files written in doc_id order (null first)."""
    folder = new_path(spark, "tokens")
    manifest = token_store.write_store(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_store(spark, folder, manifest)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of documents."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
with d as (
    select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
), g as (
    select *, first_value(doc_id) over (partition by norm order by n desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g
"""


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of conversations without quotes, linked to what they quote, with their places in reply order."""
    return quotes.reply_ordered(quotes.link_quotes(table(spark, sf_dir, "conversations")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_terms for each row of pages."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def _op6_sql() -> str:
    # every boundary is doubled, so that two hits side by side have one each
    found = lambda term: f"'(^|[^a-z0-9]){term.replace('-', '--')}($|[^a-z0-9])'"
    hit = lambda term: f"regexp_matches(w, {found(term)})"
    strict = " + ".join(f"len(regexp_extract_all(w, {found(t)}))" for t in url_filter.STRICT)
    soft = " + ".join(f"cast({hit(t)} as bigint)" for t in url_filter.SOFT)
    rules = []
    for verdict, rule in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        rules.append((f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}')", rule, verdict))
    rule = "case " + " ".join(f"when {c} then '{r}'" for c, r, _ in rules) + " end"
    verdict = "case " + " ".join(f"when {c} then '{v}'" for c, _, v in rules) + " when strict_hits > 0 or soft_terms >= 2 then 'block' else 'allow' end"
    return f"""
with p as (
    select page_id, regexp_replace(lower(coalesce(url, '')), '([^a-z0-9])', '\\1\\1', 'g') as w, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
), q as (
    select page_id, w, rest, regexp_extract(rest, '^[^/?#]*') as h from p
), r as (
    select page_id, lower(h) as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path, cast({strict} as bigint) as strict_hits, cast({soft} as bigint) as soft_terms from q
)
select page_id, host, path, {rule} as rule, {verdict} as verdict, strict_hits, soft_terms from r
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, containment, found, shingles, copies: what each row of documents holds of benchmark."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
with w as (
    select 'd' as side, doc_id as id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') as words from documents where text is not null
    union all
    select 'b', item_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') from benchmark where text is not null
), z as (
    select distinct least(len(words), 5) as n from w where side = 'b' and len(words) > 0
), s as (
    select distinct side, id, n, array_to_string(words[k : k + n - 1], ' ') as shingle
    from (select side, id, words, n, unnest(range(1, len(words) - n + 2)) as k from w join z on len(words) >= n and (side = 'd' or n = least(len(words), 5)))
), i as (
    select min(id) as item_id, count(*) as copies, n, all_shingles from (select id, n, list(shingle order by shingle) as all_shingles from s where side = 'b' group by id, n) group by n, all_shingles
), j as (
    select item_id, copies, n, len(all_shingles) as shingles, unnest(all_shingles) as shingle from i
)
select s.id as doc_id, item_id, count(*) / shingles as containment, count(*) as found, shingles, copies
from j join s on s.side = 'd' and s.n = j.n and s.shingle = j.shingle group by s.id, item_id, shingles, copies having count(*) >= 0.8 * shingles - 1e-9
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, at, n_chars, shown, sha256, score, is_secret for each place of a candidate in documents."""
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    return secret_scan.scan(table(spark, sf_dir, "documents"), model)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of documents."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_token_store, op4_exact_dedup, op5_quote_links, op6_url_filter, op7_decontaminate, op8_simhash, op9_secret_scan, op10_packing)}
ORACLES = {"op4_exact_dedup": OP4_SQL, "op6_url_filter": _op6_sql(), "op7_decontaminate": OP7_SQL}
