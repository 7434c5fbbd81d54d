"""The queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from textloom.llm import decontamination, html_blocks, jaccard, lines, media, oracles, packing, pii, quality, sharding, token_files
from textloom.llm.common import table


def op1_decontamination(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_html(spark, sf_dir):
    return html_blocks.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_media(spark, sf_dir):
    return media.features(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_line_dedup(spark, sf_dir):
    return lines.decisions(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_token_files(spark, sf_dir):
    return token_files.read_files(token_files.write_files(table(spark, sf_dir, "documents", "doc_id", "text")))


def op9_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def queries():
    return {f.__name__: f for f in (op1_decontamination, op2_pii, op3_html, op4_media, op5_sharding, op6_packing, op7_line_dedup, op8_token_files, op9_jaccard, op10_quality)}


def oracle_sql():
    return {"op7_line_dedup": oracles.LINES, "op9_jaccard": oracles.JACCARD}
