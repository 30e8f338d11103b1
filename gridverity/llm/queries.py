"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embeddings import op8_embedding_cells
from .fingerprints import op3_bottom_k
from .packing import op7_pack
from .pieces import op4_pieces
from .quality import op5_quality
from .sharding import op9_hash_tree_shards
from .simhash import op6_simhash_pivots
from .substrings import op2_substring_superkmers
from .suffixes import op10_suffix_array
from .toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_superkmers": op2_substring_superkmers,
    "op3_bottom_k": op3_bottom_k,
    "op4_pieces": op4_pieces,
    "op5_quality": op5_quality,
    "op6_simhash_pivots": op6_simhash_pivots,
    "op7_pack": op7_pack,
    "op8_embedding_cells": op8_embedding_cells,
    "op9_hash_tree_shards": op9_hash_tree_shards,
    "op10_suffix_array": op10_suffix_array,
}

ORACLE_SQL: dict[str, str] = {}
