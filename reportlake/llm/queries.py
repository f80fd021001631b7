"""Queries of the text operators over the given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from reportlake.llm import bpe, identifiers, mixing, names, neighbours, scans, skeleton, terms
from reportlake.session import read


def p1_found(spark, sf_dir):
    return scans.found(read(spark, sf_dir, "ocr_results"))


def p1_text(spark, sf_dir):
    return scans.paragraphs(read(spark, sf_dir, "ocr_results"))


def p3_found(spark, sf_dir):
    return terms.useless_terms(read(spark, sf_dir, "corpus_terms"))


def p3_terms(spark, sf_dir):
    return terms.term_frequencies(read(spark, sf_dir, "corpus_terms"))


def _private(spark, sf_dir):
    return [read(spark, sf_dir, t) for t in ("records", "transcriptions", "name_aliases", "referrers")]


def p4_found(spark, sf_dir):
    return identifiers.identifiers(*_private(spark, sf_dir))


def p4_redacted(spark, sf_dir):
    return identifiers.redacted(*_private(spark, sf_dir))


def _vectors(spark, sf_dir):
    return neighbours.vector_rows(read(spark, sf_dir, "chunks"), read(spark, sf_dir, "memories"))


def p6_found(spark, sf_dir):
    return neighbours.mutual_neighbours(_vectors(spark, sf_dir))


def p6_search(spark, sf_dir):
    return neighbours.search_rows(_vectors(spark, sf_dir))


def p7_found(spark, sf_dir):
    return names.linked_names(read(spark, sf_dir, "records"), read(spark, sf_dir, "referrers"), read(spark, sf_dir, "name_aliases"))


def p7_people(spark, sf_dir):
    return names.patients(read(spark, sf_dir, "records"), read(spark, sf_dir, "name_aliases"))


def p8_ids(spark, sf_dir):
    return bpe.token_ids(read(spark, sf_dir, "documents"))


def p9_mix(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "source_weights"))[0]


def p9_shares(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "source_weights"))[1]


def p10_found(spark, sf_dir):
    return skeleton.look_alike_pairs(read(spark, sf_dir, "documents"))


def p10_classes(spark, sf_dir):
    return skeleton.look_alike_classes(read(spark, sf_dir, "documents"))


def p10_forms(spark, sf_dir):
    return skeleton.with_skeleton(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_text, p3_found, p3_terms, p4_found, p4_redacted, p6_found, p6_search, p7_found, p7_people, p8_ids, p9_mix, p9_shares, p10_found, p10_classes, p10_forms)}

_SPACES = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TERMS = rf"""
with entry as (select distinct entry_id, tenant, term, sources from corpus_terms),
rows as (
  select tenant, term, unnest(map_keys(sources)) as file, unnest(map_values(sources)) as n from entry
  union all
  select tenant, term, null, 0 from entry where sources is null or cardinality(sources) = 0),
keyed as (
  select nfc_normalize(trim(regexp_replace(lower(term), '{_SPACES}', ' ', 'g'))) as term_lc, tenant, file, coalesce(n, 0) as n
  from rows where term is not null),
total as (select count(*) as files from (select distinct tenant, file from rows where file is not null)),
counted as (
  select term_lc, sum(n) as n, count(distinct (tenant, file)) filter (where file is not null) as files
  from keyed where term_lc <> '' group by term_lc)
select term_lc, cast(n as bigint) as n, cast(c.files as bigint) as files,
  case when n < {terms.MIN_OCCURRENCES} then 'rare' when c.files > {terms.MAX_FILE_SHARE} * total.files then 'common' end as mark
from counted c, total
"""

ORACLE = {
    "p3_terms": _TERMS,
    "p3_found": f"select term_lc, mark from ({_TERMS}) where mark is not null",
}
