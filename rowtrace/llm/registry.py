"""Queries of the subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowtrace.llm.decontamination import op3_decontamination
from rowtrace.llm.divergence import SQL as DIVERGENCE
from rowtrace.llm.divergence import op13_source_divergence
from rowtrace.llm.html import op9_html_extraction
from rowtrace.llm.merkle import op5_fingerprints
from rowtrace.llm.mixing import op10_mixing
from rowtrace.llm.neardup import op8_near_duplicates
from rowtrace.llm.pieces import op11_pieces
from rowtrace.llm.ranking import SQL as RANKING
from rowtrace.llm.ranking import op12_ranked_search
from rowtrace.llm.sharding import op6_sharding
from rowtrace.llm.substrings import op2_substring_dedup
from rowtrace.llm.tokens import op7_token_counts
from rowtrace.llm.toxicity import op4_toxicity
from rowtrace.llm.urls import op1_url_filters

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_url_filters,
            op2_substring_dedup,
            op3_decontamination,
            op4_toxicity,
            op5_fingerprints,
            op6_sharding,
            op7_token_counts,
            op8_near_duplicates,
            op9_html_extraction,
            op10_mixing,
            op11_pieces,
            op12_ranked_search,
            op13_source_divergence,
        )
    }


# Windows of 20 words, all but the first occurrence of each, and the words they cover.
SUBSTRING_DEDUP = r"""
with texts as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents),
windows as (
  select doc_id, start, array_to_string(words[start:start + 19], ' ') as content
  from (select doc_id, words, unnest(generate_series(1, len(words) - 19)) as start from texts)),
repeats as (
  select doc_id, start from windows
  qualify row_number() over (partition by content order by doc_id, start) > 1),
covered as (select distinct doc_id, unnest(generate_series(start, start + 19)) as place from repeats),
placed as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as place from texts),
kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by place) as content
  from placed anti join covered using (doc_id, place) group by doc_id)
select t.doc_id, len(t.words) as n_words, len(t.words) - coalesce(k.n, 0) as n_removed,
       sha256(coalesce(k.content, '')) as kept_sha256
from texts t left join kept k using (doc_id)"""


def sql() -> dict[str, str]:
    """The other queries rest on learned models, signatures, trees, checksums or iterations that SQL lacks."""
    return {
        "op2_substring_dedup": SUBSTRING_DEDUP,
        "op12_ranked_search": RANKING,
        "op13_source_divergence": DIVERGENCE,
    }
