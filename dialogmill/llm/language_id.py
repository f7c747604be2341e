"""Language identification by unigram models that sum over all segmentations."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogmill.llm.common import held_out, map_arrow, table
from dialogmill.llm.pieces import Memo, Vocabulary, best_segmentation, computed, forward, long_best, long_forward, pieces_used, row_sums, words_of
from dialogmill.llm.token_counts import VOCABULARY_FILE

UNKNOWN = "und"


def piece_counts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, n): how often each piece stands in the best segmentations of each language's texts, over all rows with a language."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(shared.value)
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(own.pieces)))
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, lang_of = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for words in words_of(batch.column(1)):
                n_rows = len(words.bound) - 1
                of_word = np.repeat(lang_of[words.row : words.row + n_rows], np.diff(words.bound))
                here = np.bincount(words.which * len(names) + of_word, minlength=len(words.keys) * len(names)).reshape(-1, len(names))

                def add(some: np.ndarray, pieces: np.ndarray, here=here, names=names) -> None:
                    for k, name in enumerate(names):
                        total[name] += np.bincount(pieces, here[some, k], len(own.pieces))

                def in_trie(w, size, which, add=add):
                    for some, pieces in pieces_used(size, best_segmentation(w, size, own)[1]):
                        add(which[some], pieces)
                    return 0

                def alone(word, k, add=add):
                    found = np.array([p for p in long_best(word, own) if p >= 0], np.int64)
                    add(np.full(len(found), k), found)
                    return 0

                computed(words, np.arange(len(words.keys)), in_trie, alone, np.zeros(len(words.keys), np.int8))
        for name, n in total.items():
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(n[found].astype(np.int64))], ["lang", "piece", "n"])

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = map_arrow(known.select(F.col(lang_col), F.col(text_col)), count, "lang string, piece int, n long")
    return counts.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Chances of all pieces in each language, with a share of the mean over the languages against zeros."""

    def __init__(self, counts: list[tuple[str, int, int]], n_pieces: int, shared: float = 0.05):
        self.langs = sorted({lang for lang, _, _ in counts})
        place = {lang: k for k, lang in enumerate(self.langs)}
        n = np.zeros((n_pieces, len(self.langs)))
        for lang, piece, times in counts:
            n[piece, place[lang]] += times
        own = n / np.maximum(n.sum(axis=0), 1)
        level = (n.sum(axis=1, keepdims=True) + 0.5) / (n.sum() + 0.5 * n_pieces)
        self.chance = (1 - shared) * own + shared * level
        self.byte_chance = 1e-9


def identify(docs: DataFrame, vocabulary: Vocabulary, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, whole texts: the language whose model makes the text most likely.

    The chance of a word is the sum over all its segmentations into pieces. ``score`` is the chance of the
    language among all, each as likely beforehand. A null text, or one without a letter, is ``und``
    with score 0; so is every text when nothing was learnt. Ties go to the smallest code. Null ids and repeated
    rows stay rows of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.pieces, model))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, own_model = shared.value
        own, n_langs = Vocabulary(pieces), len(own_model.langs)
        memo = Memo((n_langs,), np.float64, 1 << 19)
        for batch in batches:
            logs = np.zeros((len(batch), n_langs))
            for words in words_of(batch.column(1)):
                values = memo.of(words, lambda w, size, _: forward(w, size, own, own_model.chance, own_model.byte_chance), lambda word, _: long_forward(word, own, own_model.chance, own_model.byte_chance))
                # sums of differences to the mean: the running total stays small
                logs[words.row : words.row + len(words.bound) - 1] = row_sums(words, values - values.mean(axis=1, keepdims=True))
            best = logs.argmax(axis=1)
            odds = np.exp(logs - logs.max(axis=1, keepdims=True))
            has_letter = batch.column(2).to_numpy(zero_copy_only=False)
            score = np.where(has_letter, odds.max(axis=1) / odds.sum(axis=1), 0.0)
            names = np.array([*own_model.langs, UNKNOWN], object)
            pred = names[np.where(has_letter, best, n_langs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    text = F.col(text_col)
    if not model.langs:
        return docs.select(F.col(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return map_arrow(docs.select(F.col(id_col), text, letters), judge, schema)


def learn_languages(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Piece counts of all rows, gathered as one number per language and piece."""
    counts = piece_counts(docs, vocabulary, text_col, lang_col).collect()
    return LanguageModel([(r.lang, r.piece, r.n) for r in counts], len(vocabulary.pieces))


def op7_language_id(spark: SparkSession, sf_dir: str, vocabulary_file: str = VOCABULARY_FILE) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocabulary = Vocabulary.load(vocabulary_file)
    model = learn_languages(docs.where(~held_out(F.col("doc_id"))), vocabulary)
    return identify(docs, vocabulary, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
