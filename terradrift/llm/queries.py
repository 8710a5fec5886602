"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terradrift.llm.common import table

#: Fixed rules of the url query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.url_filters import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.decontaminate import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from terradrift.llm.token_store import stored_documents

    return stored_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the setting terradrift.pii.key; without one, a new one each time, so that its pseudonyms are linked within
    the result only."""
    import secrets

    from terradrift.llm.pii import report

    key = spark.conf.get("terradrift.pii.key", None) or secrets.token_hex(32)
    return report(table(spark, sf_dir, "documents"), key)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.lm_ctw import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from terradrift.llm.sentencepiece_lattice import PieceTable, encode

    pieces = PieceTable.load(public_tokenizers.path("piece_bpe_32k.model"), "bpe")
    return encode(table(spark, sf_dir, "documents"), pieces, digests=True)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terradrift.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_url_filters, op2_decontamination, op3_exact_dedup, op4_ngram_join, op5_token_store, op6_pii, op7_lm_scoring, op8_sentencepiece, op9_language_id, op10_toxicity)}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    # The synthetic pages hold no canonical or redirect links, so no alias is decided by its class.
    "op1_url_filters": f"""
        with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        h as (select page_id, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
        r(rh, rp, rv) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        best as (select page_id, host, path, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(rv, length(rh || rp)) as rv
                 from h left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id, host, path)
        select page_id, host, path, rule, coalesce(rv, 'allow') as verdict, false as alias_of_blocked from best""",
    "op2_decontamination": f"""
        with d as (select doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
        ds as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s from d),
        b as (select item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from benchmark),
        bs as (select distinct item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s from b),
        n as (select item_id, count(*) as n_item from bs group by item_id),
        j as (select doc_id, item_id, count(*) as n_shared from ds join bs using (s) group by doc_id, item_id)
        select doc_id, item_id, n_item, n_shared, n_shared::double / n_item as containment from j join n using (item_id) where 10 * n_shared >= 8 * n_item""",
    "op3_exact_dedup": f"""
        with d as (select doc_id, sha256({_LOW.format("coalesce(text, '')")}) as text_sha256 from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
        from d window w as (partition by text_sha256)""",
    "op4_ngram_join": f"""
        with recursive d as (select doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
        n as (select doc_id, count(*) as n from s group by doc_id),
        link as materialized (select x.doc_id as a, y.doc_id as b from s x join s y on x.g = y.g and x.doc_id <> y.doc_id join n nx on nx.doc_id = x.doc_id join n ny on ny.doc_id = y.doc_id
                 group by x.doc_id, y.doc_id, nx.n, ny.n having 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
        reach as (select doc_id as a, doc_id as b from d union select r.a, l.b from reach r join link l on l.a = r.b)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.b) as component_id from d left join n using (doc_id) join reach r on r.a = d.doc_id group by d.doc_id, n.n""",
}
