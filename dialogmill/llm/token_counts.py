"""Token counts: best unigram segmentation of every word, once per shared prefix of the distinct words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogmill.llm.common import map_arrow, table
from dialogmill.llm.pieces import Memo, Vocabulary, best_segmentation, long_best, row_sums, words_of

VOCABULARY_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) of every row, whole texts.

    Pre-tokens are runs of ``[^\\x20\\x09-\\x0D]`` with the word-start mark before them. Each is cut into the
    pieces with the highest sum of unigram scores -ln(rank + 1); on equal sums, the fewest pieces. A byte that no piece
    covers is a token of its own. Null and empty texts have 0 words and 0 tokens; null ids
    and repeated rows stay rows of their own; an empty table gives an empty table.

    Nothing is shuffled. A task keeps at most about a million distinct words at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(shared.value)
        memo = Memo((), np.int32)
        for batch in batches:
            n_words, n_tokens = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for words in words_of(batch.column(1)):
                counts = memo.of(words, lambda w, size, _: best_segmentation(w, size, own)[0], lambda word, _: len(long_best(word, own)))
                at = slice(words.row, words.row + len(words.bound) - 1)
                n_words[at], n_tokens[at] = np.diff(words.bound), row_sums(words, counts.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_tokens)], [id_col, "n_words", "n_tokens"])

    schema = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), count, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary_file: str = VOCABULARY_FILE) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), Vocabulary.load(vocabulary_file))
