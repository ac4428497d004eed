"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import chat_trees, decontaminate, language_id, line_dedup, near_dedup, pseudonyms, sentence_pieces, spot_signatures, token_files, warc_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_trees": chat_trees.op1_chat_trees,
        "op2_token_files": token_files.op2_token_files,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_warc_normaliser": warc_files.op4_warc_normaliser,
        "op5_sentence_pieces": sentence_pieces.op5_sentence_pieces,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_language_id": language_id.op7_language_id,
        "op8_spot_signatures": spot_signatures.op8_spot_signatures,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_pseudonyms": pseudonyms.op10_pseudonyms,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_trees": chat_trees.OP1_SQL,
        "op4_warc_normaliser": warc_files.OP4_SQL,
        "op6_line_dedup": line_dedup.OP6_SQL,
    }
