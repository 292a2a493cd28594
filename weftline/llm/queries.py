"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.joined(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontamination

    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.deduplicated(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.digests(bpe.encoded(table(spark, sf_dir, "documents"), texts=True))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    return token_files.digests(token_files.round_trip(table(spark, sf_dir, "documents")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import imatch

    return imatch.edited_pairs(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixes

    return suffixes.deduplicated(table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import middle

    return middle.digests(middle.transformed(table(spark, sf_dir, "documents")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import divergence

    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.digests(packing.packed(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_jaccard, op2_decontamination, op3_substrings, op4_bpe, op5_toxicity, op6_token_files, op7_secrets, op8_fingerprints, op9_licenses, op10_suffixes, op11_fim, op12_divergence, op13_packing)}
ORACLES: dict[str, str] = {
    "op11_fim": r"""
        with drawn as (select doc_id, coalesce(text, '') as t, sha256('1:' || doc_id) as h from documents where doc_id is not null),
        numbers as (select *, length(t) as n, ('0x' || substr(h, 1, 8))::ubigint as h1, ('0x' || substr(h, 9, 8))::ubigint as h2, ('0x' || substr(h, 17, 8))::ubigint as h3, ('0x' || substr(h, 25, 8))::ubigint as h4 from drawn),
        formed as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form,
            least(h1 % (n + 1), h2 % (n + 1))::bigint as a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as b from numbers),
        cut as (select *, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from formed)
        select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
            sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
        from cut""",
    "op12_divergence": r"""
        with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as t from documents),
        w as (select id, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
        kept as (select lang, term, count(*) as n from w group by lang, term having count(distinct id) >= 30),
        v as (select lang, count(*) as v, sum(n) as total from kept group by lang),
        groups as (select distinct lang, source from d),
        c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by lang, source, term),
        total as (select lang, source, sum(n) as total from c group by lang, source),
        dense as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
                1 + ((coalesce(c.n, 0) + 5)::hugeint * 1000000000) // (coalesce(total.total, 0) + 5 * v.v)::hugeint as p,
                1 + ((k.n + 5)::hugeint * 1000000000) // (v.total + 5 * v.v)::hugeint as q
            from groups g join kept k on g.lang = k.lang join v on v.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term left join total on total.lang = g.lang and total.source = g.source),
        sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
        pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
        listed as (select * from pairs union all select lang, source, 'term', term, (p - q)::bigint from dense where n > 0 and p > q),
        ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::integer as rank from listed)
        select * from ranked where part = 'pair' or rank <= 50""",
}
