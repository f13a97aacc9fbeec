"""The registered queries of the operators, on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_topk, hard_negatives, language_id, lm_scoring, minhash_dedup, prefix_trie, quality_classifier, secret_scan, sentence_piece, suffix_dedup, toxicity, warc
from ._spark import hash_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def piece_model() -> str:
    """The tokenizer file of the queries, found where the tokenizers are installed."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_piece.digests(table(spark, sf_dir, "documents"), piece_model())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = language_id.predict(docs, language_id.fit(docs))
    return got.select("doc_id", (hash_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.kept_texts(table(spark, sf_dir, "documents"), width=400)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return suffix_dedup.digests(kept, (F.size("spans") > 0).alias("repeated"), spans.alias("removed_spans"), "kept_text")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = hash_mod(F.col("doc_id"), 5)
    got = lm_scoring.score(table(spark, sf_dir, "documents"), fold != 1, piece_model())
    return got.withColumn("held_out", F.coalesce(fold == 1, F.lit(False))).drop("trained")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths(table(spark, sf_dir, "conversations"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_secrets": op4_secrets,
    "op5_minhash": op5_minhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_language": op7_language,
    "op8_warc": op8_warc,
    "op9_suffix": op9_suffix,
    "op10_topk": op10_topk,
    "op11_lm_score": op11_lm_score,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {
    "op5_minhash": r"""
        with recursive w as (
          select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
        s as (select doc_id, unnest(case when len(words) = 0 then [] when len(words) < 2 then [words[1]] else list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) end) as shingle from w),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
        e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * common >= 80 * (a.n + b.n - common)),
        r(doc_id, reach) as (select doc_id, doc_id from documents union select r.doc_id, case when e.x = r.reach then e.y else e.x end from r join e on r.reach in (e.x, e.y)),
        c as (select doc_id, min(reach) as component_id from r group by doc_id)
        select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
        from documents d join c using (doc_id) left join n using (doc_id)
    """,
    "op8_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
        d as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as h from p),
        t as (select *, max(page_id) over (partition by h) as top from d)
        select page_id, cast(payload_bytes as bigint) as payload_bytes,
          array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + ((cast('0x' || substr(h, cast(5 * (i // 4) + 1 as integer), 5) as integer) >> cast(15 - 5 * (i % 4) as integer)) & 31), 1)), '') as payload_digest,
          case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
        from t
    """,
    "op10_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
                   from embeddings where vec_id is not null and embedding is not null
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
              from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
        select query_id, cast(rank as integer) as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
    """,
    "op12_prefix_trie": r"""
        with t as (select conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as own
                   from conversations where conv_id is not null group by conv_id),
        h as (select *, cast(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
                lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))), 4294967295::bigint) % 4 as integer) as h from t),
        p as (select a.conv_id, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) as path from h a left join t b on b.conv_id = a.conv_id - a.conv_id % 20),
        k as (select conv_id, path, unnest(range(0, len(path) + 1)) as depth from p),
        g as (select path[1:depth] as node, depth, min(conv_id) as conv_id, count(*) as n_convs,
                sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(path) = depth), '')) as ends_sha256 from k group by 1, 2),
        c as (select node[1:depth - 1] as node, count(*) as n from g where depth > 0 group by 1),
        f as (select g.*, coalesce(c.n, 0) as n_children, case when depth > 0 then (n_convs - 1) * len(regexp_extract_all(node[depth].x, '[^\x20\x09-\x0D]+')) else 0 end as own from g left join c using (node)),
        u as (select node[1:d] as node, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum(own) as saved_tokens from (select *, unnest(range(0, depth + 1)) as d from f) group by 1)
        select f.conv_id, f.depth, q.conv_id as parent_conv_id, f.n_convs, f.n_children, cast(u.n_leaves as bigint) as n_leaves, cast(u.saved_tokens as bigint) as saved_tokens, f.ends_sha256
        from f join u using (node) left join f q on f.depth > 0 and q.node = f.node[1:f.depth - 1]
    """,
    "op13_hard_negatives": """
        with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
                   from embeddings where vec_id is not null and label is not null and embedding is not null
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
              from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
        p as (select anchor_id, vec_id as positive_id, score as positive_score
              from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where same) where place <= 5),
        n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
              from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score)
        select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5
    """,
}
