"""Token queries: op1, op2, op7 and op13."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newsflow.llm.alignment import aligned
from newsflow.llm.coding import coded
from newsflow.llm.packing import pack
from newsflow.llm.queries import query, table
from newsflow.llm.store import new_folder, small_input
from newsflow.llm.token_files import read_tokens, write_tokens
from newsflow.llm.token_pieces import token_pieces

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
SEQUENCE, END = 2048, 0


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = small_input(table(spark, folder, "documents").select("doc_id", "text"))
    return pack(token_pieces(docs, public_tokenizers.path(WORD_BPE), SEQUENCE, END), SEQUENCE)


@query("op7_bpe_transducer")
def bpe_transducer(spark: SparkSession, folder: str) -> DataFrame:
    docs = small_input(table(spark, folder, "documents").select("doc_id", "text"))
    return coded(docs, public_tokenizers.path(WORD_BPE))


@query("op2_wavelet_token_files")
def wavelet_token_files(spark: SparkSession, folder: str) -> DataFrame:
    shards = write_tokens(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), 2, new_folder(spark, "tokens"))
    return read_tokens(shards)


@query("op13_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return aligned(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))
