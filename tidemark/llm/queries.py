"""The queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import chat, collocations, exact_dedup, html_text, licenses, lm_score, media, mixing, near_dedup, packing, resampling, toxicity, url_filter
from tidemark.llm.shared import table

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_mix_sources(spark, sf_dir):
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op2_stupid_backoff(spark, sf_dir):
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op3_mixture_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_stateful_exact_dedup(spark, sf_dir):
    _, decisions = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return decisions.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_url_link_graph(spark, sf_dir):
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), RULES)


def op6_lstm_main_text(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_tiff_media(spark, sf_dir):
    return media.text_media(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


def op9_ftrl_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op10_chat_formatting(spark, sf_dir):
    return chat.chat_digests(table(spark, sf_dir, "conversations"))


def op11_importance_resampling(spark, sf_dir):
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_license_scan(spark, sf_dir):
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = [op1_mix_sources, op2_stupid_backoff, op3_mixture_packing, op4_stateful_exact_dedup, op5_url_link_graph, op6_lstm_main_text, op7_tiff_media, op8_minhash_near_dedup, op9_ftrl_toxicity, op10_chat_formatting, op11_importance_resampling, op12_license_scan, op13_phrase_collocations]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {
        "op4_stateful_exact_dedup": """
            select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
              doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
            from documents window same as (partition by coalesce(text, ''))""",
        "op10_chat_formatting": r"""
            with turns as (
              select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
              union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
              union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
            escaped as (
              select *, '<|im_start|>' || replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '\', '\\'), '<|', '<\|') || chr(10)
                || content || '<|im_end|>' || chr(10) as piece
              from (select *, replace(replace(text, '\', '\\'), '<|', '<\|') as content from turns))
            select conv_id, count(*) as n_turns,
              sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, content)) as turns_sha256,
              cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
              sha256(coalesce(string_agg(text, '' order by turn nulls first, role, content) filter (role = 'assistant'), '')) as loss_sha256,
              cast(sum(length(piece)) as bigint) as formatted_chars
            from escaped group by conv_id""",
        "op13_phrase_collocations": r"""
            with pieces as (
              select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as words
              from documents),
            totals as (select lang, cast(sum(len(words)) as bigint) as n from pieces group by lang),
            grams as (
              select lang, m, array_to_string(words[i : i + m - 1], ' ') as phrase
              from (select lang, words, m, unnest(range(1, len(words) - m + 2)) as i from pieces, (select unnest([1, 2, 3, 4]) as m))),
            counts as (select lang, m, phrase, count(*) as f from grams group by all having count(*) >= 30),
            cuts as (
              select c.lang, c.m, c.phrase, c.f as a, k, array_to_string(string_split(c.phrase, ' ')[1 : k], ' ') as head, array_to_string(string_split(c.phrase, ' ')[k + 1 :], ' ') as tail
              from counts c, (select unnest([1, 2, 3]) as k) where k < c.m),
            scores as (
              select x.*, l.f as l, r.f as r, cast(cast(2000000 as hugeint) * x.a // (cast(l.f as hugeint) + r.f) as bigint) as score
              from cuts x join counts l on l.lang = x.lang and l.phrase = x.head join counts r on r.lang = x.lang and r.phrase = x.tail),
            best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1),
            kept as (
              select * from best b where not exists (
                select 1 from counts y where y.lang = b.lang and y.m > b.m and contains(' ' || y.phrase || ' ', ' ' || b.phrase || ' ') and cast(100 as hugeint) * y.f >= cast(80 as hugeint) * b.a)),
            ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
            select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000""",
    }
