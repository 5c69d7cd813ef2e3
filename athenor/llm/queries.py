"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from athenor.functions.storage import table
from athenor.llm import avi, best_fit, bpe, divergence, html_crf, licenses, prefix_trie
from athenor.llm.exact_dedup import exact_dedup
from athenor.llm.language_model import language_model
from athenor.llm.near_dedup import near_dedup
from athenor.llm.packing import pack
from athenor.llm.quality import quality
from athenor.llm.toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digests(avi.store_texts(table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language_model": op2_language_model,
    "op3_media": op3_media,
    "op4_packing": op4_packing,
    "op5_near_dedup": op5_near_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_licenses": op10_licenses,
    "op11_best_fit": op11_best_fit,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_divergence": op13_divergence,
}

ORACLES: dict[str, str] = {
    "op8_exact_dedup": """
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents)
        select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from t""",    "op12_prefix_trie": """
        with r as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as txt from conversations where conv_id is not null),
        t as (select c, sha256(length(role) || ':' || role || txt) as key, len(regexp_extract_all(txt, '[^\\x20\\x09-\\x0D]+')) as words,
                     row_number() over (partition by c order by turn nulls first, sha256(length(role) || ':' || role || txt)) - 1 as pos from r),
        ids as (select c, c - c % 20 as head, xor(list_reduce([ascii(d) for d in string_split(c::varchar, '')], lambda a, x:
                     list_reduce(range(8), lambda b, i: xor(b >> 1, case when b & 1 = 1 then 3988292384 else 0 end), xor(a, x)), 4294967295), 4294967295) % 4 as h
                from (select distinct c from t)),
        b as (select ids.c, 0 as own, pos, key, words from ids join t on t.c = ids.head and pos < h
              union all select ids.c, 1, pos, key, words from ids join t on t.c = ids.c and pos >= h),
        p as (select c, row_number() over w as d, sum(words) over w as words_before, words, sha256(string_agg(key, '') over w) as node from b window w as (partition by c order by own, pos)),
        m as (select c, d, words, node from p union all select c, 0, 0, '' from ids),
        e as (select c, arg_max(node, d) as last from m group by c),
        f as (select last as node, sha256(string_agg(c::varchar, ',' order by c)) as ends from e group by last),
        up as (select m.c, m.d, m.node, coalesce(q.node, '') as parent from m left join m q on q.c = m.c and q.d = m.d - 1),
        n as (select m.node, any_value(m.d) as depth, min(m.c) as conv_id, count(*) as n_convs, any_value(words) as words, any_value(parent) as parent
              from m join up on m.c = up.c and m.d = up.d group by m.node),
        k as (select parent, count(*) as n_children from n where depth > 0 group by parent),
        below as (select distinct m.node as top, x.node from m join m x on x.c = m.c and x.d >= m.d),
        s as (select top, sum((n_convs - 1) * words) as saved, sum((k.n_children is null)::int) as leaves from below join n on n.node = below.node left join k on k.parent = n.node group by top)
        select n.conv_id, n.depth::bigint as depth, case when n.depth > 0 then u.conv_id end as parent_conv_id, n.n_convs::bigint as n_convs, coalesce(k.n_children, 0)::bigint as n_children,
               s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, coalesce(f.ends, sha256('')) as ends_sha256
        from n left join n u on u.node = n.parent left join k on k.parent = n.node left join f on f.node = n.node join s on s.top = n.node""",
    "op13_divergence": """
        with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text, row_number() over () as row from documents),
        w as (select lang, source, row, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
        v as (select lang, term, count(*)::hugeint as n from w group by lang, term having count(distinct row) >= 10),
        c as (select lang, source, term, count(*)::hugeint as n from w group by all),
        g as (select distinct lang, source from d),
        z as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from v group by lang),
        t as (select g.lang, g.source, v.term, coalesce(c.n, 0) as n from g join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = v.term),
        p as (select t.lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) over (partition by t.lang, source)::hugeint + 2 * z.v) as p from t join z on z.lang = t.lang),
        q as (select v.lang, term, 1 + (1000000000 * (n + 2)) // (total + 2 * z.v) as q from v join z on z.lang = v.lang),
        x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce((select sum(((l.p - r.p) * (l.p - r.p)) // (l.p + r.p)) from p l join p r on r.lang = l.lang and r.term = l.term
                     where l.lang = a.lang and l.source = a.source and r.source = b.source), 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source),
        y as (select p.lang, p.source, 'term' as part, p.term as item, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) as value from p join q on p.lang = q.lang and p.term = q.term where n > 0 and p.p > q.q),
        r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from x union all select * from y))
        select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= 10""",
}
