"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.decontaminate import decontaminate
from plumbline.llm.html_text import extract_text
from plumbline.llm.jaccard_join import jaccard_components
from plumbline.llm.language_cnn import predict_language
from plumbline.llm.neighbour_quality import score_quality
from plumbline.llm.packed_ids import read_packed, write_packed
from plumbline.llm.prefix_trie import conversation_trie
from plumbline.llm.quality_rules import quality_rules
from plumbline.llm.secret_scan import find_secrets, joined
from plumbline.llm.sentencepieces import encode_pieces
from plumbline.llm.shared import documents, shared_folder
from plumbline.llm.structure_repair import repair_conversations
from plumbline.llm.token_counts import count_tokens
from plumbline.llm.url_filter import judge_urls

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
TOKEN_LIMIT = 512
QUALITY_CUT = 0.7
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word statistics and verdict of every document."""
    return quality_rules(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = find_secrets(documents(spark, sf_dir))
    known = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(known), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("random").alias("n_random"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    counts = count_tokens(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def held_out(doc_id: str) -> Column:
    """Rows that no label may be learnt from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def op4_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    scores = score_quality(documents(spark, sf_dir), labels)
    return scores.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids, spans and decoded text of every document."""
    out = encode_pieces(documents(spark, sf_dir), public_tokenizers.path(PIECE_BPE))
    return out.select("doc_id", *piece_digests())


def piece_digests() -> list:
    return [
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.crc32(F.concat("begins", "ends")).alias("spans_crc32"),
    ]


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that every document holds, literally or with other numbers, names and units."""
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; the list holds the URLs of pages that came broken off, without an end tag."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = pages.where(~F.col("html").contains("</html>")).select("url")
    return judge_urls(pages, listed, URL_RULES)


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document's ids lie in the written files, and their checksum as read back."""
    folder = shared_folder(spark)
    manifest = write_packed(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), folder)
    return read_packed(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return jaccard_components(documents(spark, sf_dir), shared_folder(spark))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: A rebuilt conversation begins with fewer turns than this of the first one of its hundred.
HEAD_TURNS = 6


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, each rebuilt on the first turns of the first one of its hundred."""
    conv = F.col("conv")
    head = conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % HEAD_TURNS, HEAD_TURNS - 1
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), shared_folder(spark), head=head)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns of which one in twenty each is dropped (`dropped`), emptied, left without ends of sentences, repeated or said by the user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20).alias("code"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("dropped"), F.explode(copies).alias("copy"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), absent=F.col("dropped"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents that are not held out."""
    docs = documents(spark, sf_dir)
    found = predict_language(docs, docs.where(~held_out("doc_id")))
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_counts": op3_token_counts,
    "op4_neighbour_quality": op4_neighbour_quality,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_decontaminate": op6_decontaminate,
    "op7_url_filter": op7_url_filter,
    "op8_packed_ids": op8_packed_ids,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_html_text": op10_html_text,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_structure_repair": op12_structure_repair,
    "op13_language_id": op13_language_id,
}

_CANONICAL = """
    case when host <> '' then regexp_replace(host, '^(www|m)[.]', '')
        || regexp_replace(regexp_replace(path, '/index[.]html?$', ''), '/+$', '')
        || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end end"""

SQL = {
    "op7_url_filter": rf"""
with parts as (
    select page_id, html, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
split as (
    select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
        list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
            lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) as params from parts),
keyed as (select *, {_CANONICAL} as key,
    case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
        when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
        when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
        when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule from split),
listed as (select distinct key from keyed where not contains(html, '</html>') and key is not null)
select page_id, host, path, rule,
    case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
        when key in (select key from listed) then 'block' else 'allow' end as verdict
from keyed""",
    "op11_prefix_trie": """
with turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as i
    from conversations where conv_id is not null),
crc as (
    select conv_id, xor(list_reduce(
        list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
        lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)),
            lambda a, k: case when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end)), 4294967295::bigint) as crc
    from (select distinct conv_id from turns)),
heads as (select conv_id, conv_id - conv_id % 100 as source, crc % 6 as h from crc),
built as (
    select h.conv_id, 0 as part, t.i, t.role, t.text from heads h join turns t on t.conv_id = h.source and t.i < h.h
    union all select h.conv_id, 1, t.i, t.role, t.text from heads h join turns t on t.conv_id = h.conv_id and t.i >= h.h),
placed as (select conv_id, row_number() over (partition by conv_id order by part, i) as depth, length(text) as n,
    sha256(length(role) || ':' || role || text) as own from built),
keyed as (select conv_id, depth, n, sha256(string_agg(own, '') over (partition by conv_id order by depth rows unbounded preceding)) as key from placed),
members as (
    select conv_id, 0 as depth, 0 as n, 'root' as key, null as parent from heads
    union all select conv_id, depth, n, key, coalesce(lag(key) over (partition by conv_id order by depth), 'root') from keyed),
nodes as (select key, min(conv_id) as conv_id, min(depth) as depth, min(parent) as parent, min(n) as n, count(*) as n_convs from members group by key),
children as (select parent as key, count(*) as n_children from nodes where parent is not null group by parent),
full_nodes as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (key)),
below as (
    select m.key, sum(case when v.n_children = 0 then 1 else 0 end) as n_leaves, sum((v.n_convs - 1) * v.n) as saved
    from full_nodes v join members m on m.conv_id = v.conv_id and m.depth <= v.depth group by m.key),
ends as (
    select key, string_agg(conv_id::varchar, ',' order by conv_id) as ids
    from (select *, max(depth) over (partition by conv_id) as deepest from members) where depth = deepest group by key)
select v.conv_id, v.depth::bigint as depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children,
    below.n_leaves::bigint as n_leaves, below.saved::bigint as saved_tokens, sha256(coalesce(ends.ids, '')) as ends_sha256
from full_nodes v join below using (key) left join ends using (key) left join nodes p on p.key = v.parent""",
}
