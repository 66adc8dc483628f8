"""The queries of the training-data operators, over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import table
from postmill.llm.decontamination import leaks
from postmill.llm.license_scan import documents_as_files, license_scan
from postmill.llm.line_dedup import line_dedup
from postmill.llm.lm_scoring import lm_scores
from postmill.llm.mixing import mix
from postmill.llm.ngram_join import ngram_join
from postmill.llm.quality_rules import quality_rules
from postmill.llm.token_counts import token_counts
from postmill.llm.toxicity import toxicity
from postmill.llm.url_filters import url_filters

#: The rules of op8, (host, path, action).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents_as_files(table(spark, sf_dir, "documents"))
    return license_scan(files).select("doc_id", "path", "own_license", "own_score", "license", "license_from")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *counts, "base_failed", "kept", "n_lines", "n_removed", "n_lost")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(documents, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity(documents, labels).select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_url_filters": op8_url_filters,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op1_ngram_join": r"""
        with recursive cut as (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
            from documents),
        gram as (
            select distinct doc_id, array_to_string(words[i : least(i + 4, len(words))], ' ') as gram
            from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from cut where len(words) > 0)),
        size as (select doc_id, count(*) as n from gram group by doc_id),
        link as (
            select a.doc_id as a, b.doc_id as b
            from gram a join gram b on a.gram = b.gram and a.doc_id <> b.doc_id
                 join size x on x.doc_id = a.doc_id join size y on y.doc_id = b.doc_id
            group by a.doc_id, b.doc_id, x.n, y.n having 9 * count(*) >= 4 * (x.n + y.n)),
        reach(doc_id, other) as (
            select doc_id, doc_id from documents
            union select link.b, reach.other from reach join link on link.a = reach.doc_id),
        class as (select doc_id, min(other) as class_id from reach group by doc_id)
        select class.doc_id, class_id, (select count(*) from link where link.a = class.doc_id)::bigint as n_links from class""",
    "op3_quality_rules": r"""
        with doc as (select doc_id, coalesce(text, '') as body from documents),
        cut as (
            select doc_id, body, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
                   list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
            from doc),
        judged as (
            select *, list_filter(lines, lambda x:
                regexp_matches(regexp_replace(x, '[\x20\x09-\x0D]+$', ''), '[.!?…:;]["''”’»)\]]*\z')
                and not 100 * length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))
                    >= 10 * length(regexp_replace(regexp_replace(x, '[\x20\x09-\x0D]+$', ''), '^[\x20\x09-\x0D]+', ''))
                and not regexp_matches(x, '(?:^|\s)[|»›>·•/](?:\s(?:.*\s)?[|»›>·•/]){2}(?:\s|$)')
                and not regexp_matches(x, '(?i)all rights reserved|cookie (?:policy|settings)|we use cookies|privacy policy|terms (?:of use|of service|and conditions)|enable javascript|click here|sign (?:in|up)\b|log ?in\b|subscribe to|share (?:this|on)\b|read more|skip to (?:main )?content|powered by|lorem ipsum')) as stay
            from cut),
        windows as (
            select doc_id, i, array_to_string(words[i : i + 4], ' ') as gram
            from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from cut where len(words) >= 5)),
        often as (select doc_id, i, count(*) over (partition by doc_id, gram) as k from windows),
        repeated as (
            select doc_id, count(distinct i + d) as n
            from (select doc_id, i, unnest(range(5)) as d from often where k > 1) group by doc_id),
        counted as (
            select j.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
                   length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
                   (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
                   len(lines)::bigint as n_lines, (len(lines) - len(stay))::bigint as n_removed,
                   length(array_to_string(lines, ''))::bigint as chars,
                   (length(array_to_string(lines, '')) - length(array_to_string(stay, '')))::bigint as n_lost
            from judged j left join repeated r on r.doc_id = j.doc_id)
        select * exclude (chars), n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
               not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_lost * 100 <= chars * 50 as kept
        from counted""",
    "op5_decontamination": r"""
        with doc as (
            select doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
        item as (
            select item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from benchmark),
        dw as (select doc_id, unnest(words) as w, unnest(range(len(words))) as p, len(words) as length from doc),
        iw as (
            select item_id, unnest(words) as w, unnest(range(len(words))) as j, len(words) as n, least(len(words), 13) as span,
                   case when len(words) >= 13 then 11 when len(words) >= 8 then len(words) - 1 else len(words) end as need
            from item where len(words) > 0),
        shifted as (
            select doc_id, item_id, p - j as shift, n, length, span, need, list(j) as js
            from dw join iw on dw.w = iw.w group by all having count(*) >= need),
        windowed as (select *, unnest(range(n - span + 1)) as s from shifted),
        judged as (
            select *, len(list_filter(js, lambda j: j >= s and j < s + span)) as agreeing
            from windowed where s + shift >= 0 and s + span + shift <= length)
        select doc_id, item_id, max(n)::bigint as item_words, max(agreeing)::bigint as agreeing, min(shift)::bigint as "at"
        from judged where agreeing >= need group by doc_id, item_id""",
    "op6_line_dedup": r"""
        with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        line as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as nth from split),
        keyed as (
            select doc_id, line, nth, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from line),
        repeated as (
            select key, max(doc_id) as keeper from keyed where length(key) >= 40
            group by key having count(distinct doc_id) >= 5),
        judged as (
            select k.doc_id, k.line, k.nth, r.key is not null and r.keeper <> k.doc_id as dropped
            from keyed k left join repeated r on k.key = r.key)
        select doc_id, count(*)::bigint as n_lines, count(*) filter (dropped)::bigint as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by nth) filter (not dropped), '')) as kept_sha256
        from judged group by doc_id""",
    "op8_url_filters": r"""
        with split as (
            select page_id, coalesce(substr(url, nullif(strpos(url, '://'), 0) + 3), '') as rest from pages),
        cut as (
            select page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
            from split),
        rules(h, p, action) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
            ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        fits as (
            select page_id, h || p as rule, action,
                   row_number() over (partition by page_id order by length(h || p) desc, length(h) desc) as nth
            from cut join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
        select cut.page_id, host, path, rule, coalesce(action, 'allow') as verdict
        from cut left join fits on cut.page_id = fits.page_id and nth = 1""",
}
