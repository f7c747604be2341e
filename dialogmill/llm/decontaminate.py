"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmill.llm.common import table

#: Each mask looks at the words under 1 and ignores those under 0. Laid at every position, at least
#: one stays untouched by one substitution in 11 words, any two in 15, any three in 16 and any four in 21.
MASKS = ("1111111", "11011011011", "11100010111", "10110101101", "1101000100011")
#: Items of so many words, in which one may be substituted though no mask is sure to stay untouched, are also looked up by halves.
HALVED = 10
#: Test-side hashes that a broadcast may hold; for more, both sides are shuffled by hash.
BLOCK_HASHES = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _seeds(masks: Sequence[str], hashes: Column, at: Column) -> Column:
    """Array with the hash of each mask laid at position ``at``; null where it overhangs."""
    return F.array(*[
        F.when(at + len(m) <= F.size(hashes), F.xxhash64(F.lit(m), *[F.get(hashes, at + o) for o, bit in enumerate(m) if bit == "1"]))
        for m in masks
    ])


def _placed(rows: DataFrame, masks: Sequence[str]) -> DataFrame:
    """One row for each position and mask: the columns of ``rows`` with __at and __seed; __words is an array."""
    shortest = min(map(len, masks))
    return (
        rows.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
        .where(F.size("__words") >= shortest)
        .withColumn("__at", F.explode(F.sequence(F.lit(0), F.size("__words") - shortest)))
        .withColumn("__seed", F.explode(_seeds(masks, F.col("__hashes"), F.col("__at"))))
        .drop("__hashes")
        .where(F.col("__seed").isNotNull())
    )


def _test_seeds(items: DataFrame, masks: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(__seed, __key, __item_at, __item_words) of all items, and the masks to lay on documents.

    Items shorter than every mask are looked up whole, those of ``HALVED`` words by their halves too; masks for these are laid only if there are such items.
    """
    n, half = F.size("__words"), HALVED // 2
    shortest = min(map(len, masks))
    sizes = {r[0] for r in items.where((n < shortest) | (n == HALVED)).select(n).distinct().collect()}  # a few small numbers
    seeds = _placed(items.where(n >= shortest), masks)
    for size in sorted(x for x in sizes if x < shortest):
        seeds = seeds.union(_placed(items.where(n == size), ["1" * size]))
    if HALVED in sizes:
        seeds = seeds.union(_placed(items.where(n == HALVED), ["1" * half]).where(F.col("__at").isin(0, half)))
    extra = {"1" * x for x in sizes if x < shortest} | ({"1" * half} if HALVED in sizes else set())
    return seeds.select("__seed", "__key", F.col("__at").alias("__item_at"), n.alias("__item_words")), sorted({*masks, *extra})


def _best_overlap(flags: Column) -> Column:
    """The segment of aligned words with the highest score (match 1, substitution -2): its matches and length."""
    zero = F.struct(*[F.lit(0).alias(n) for n in ("score", "matched", "length", "best", "best_matched", "best_length")])

    def step(a: Column, hit: Column) -> Column:
        fresh = a["score"] < 0
        score = F.when(fresh, 0).otherwise(a["score"]) + F.when(hit, 1).otherwise(-2)
        matched = F.when(fresh, 0).otherwise(a["matched"]) + F.when(hit, 1).otherwise(0)
        length = F.when(fresh, 0).otherwise(a["length"]) + 1
        better = score > a["best"]
        return F.struct(
            score.alias("score"), matched.alias("matched"), length.alias("length"), F.when(better, score).otherwise(a["best"]).alias("best"),
            F.when(better, matched).otherwise(a["best_matched"]).alias("best_matched"), F.when(better, length).otherwise(a["best_length"]).alias("best_length"),
        )

    return F.aggregate(flags, zero, step, lambda a: F.struct(a["best_matched"].alias("matched"), a["best_length"].alias("length")))


def find_leaks(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = 13, masks: tuple[str, ...] = MASKS, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """Passages of test items in documents: (id, item, doc_word, item_word, matched, overlap, item_words).

    Words are lower-cased runs of letters and digits. Masks laid at every position of both sides
    give hashes; equal hashes are hits. Each hit fixes an alignment of the item with the
    document, whose words are compared one by one: the best-scoring segment (a match counts 1, a substitution
    -2) is the overlap, and it is a leak from ``min_words`` matched words on, or from all but one word in ten of a
    shorter item. One row per document row and item id, its best overlap, the first on ties. All such overlaps with up to
    three substitutions are found, and those with more from 21 (four), 25 (five) and 28 (six) words on; shorter ones with so many for the most part.

    Null or empty texts, and items without words, leak nothing; items of a few words are found where all of them stand in a row. Rows
    with null ids, of either side, are found with a null id. Repeated documents give repeated findings only if their texts
    differ; of several texts under one item id each is looked for. Empty tables give an empty table.

    Seeds of the test side are counted: up to ``block_hashes`` of them are broadcast, and no document text is shuffled, only
    the aligned words of hits. Above that, seeds of both sides meet in a shuffle, and texts are joined to the alignments found, so
    neither the size of the test side nor a frequent passage sets a limit. Both ways find the same.
    """
    item_words = tests.select(F.col(item_col).alias("__item"), words(F.col(item_text_col)).alias("__words")).where(F.size("__words") > 0)
    items = item_words.distinct().withColumn("__key", F.xxhash64("__item", "__words"))
    seeds, laid = _test_seeds(items, masks)
    texts = docs.select(F.col(id_col).alias("__id"), words(F.col(text_col)).alias("__words"), F.xxhash64(F.col(text_col)).alias("__row"))
    n_seeds = items.agg(F.sum(F.size("__words"))).first()[0] or 0
    shift = F.col("__at") - F.col("__item_at")
    places = [F.greatest(shift, F.lit(0)).alias("__start"), F.greatest(-shift, F.lit(0)).alias("__item_start")]
    length = F.least(F.col("__item_words") - F.col("__item_start"), F.size("__words") - F.col("__start"))
    seen = F.slice("__words", F.col("__start") + 1, length).alias("__seen")
    hit = ["__id", "__row", "__key", "__start", "__item_start"]
    if n_seeds * len(laid) <= block_hashes:
        hits = _placed(texts, laid).join(F.broadcast(seeds), "__seed").select("*", *places).select(*hit, seen).distinct()
    else:
        hits = _placed(texts, laid).drop("__words").join(seeds, "__seed").select("*", *places).select(*hit, "__item_words").distinct()
        # each document row once, whatever its id
        one = texts.select("__row", "__words").dropDuplicates(["__row"])
        hits = hits.join(one, "__row").select(*hit, seen)
    aligned = hits.join(items.select("__key", "__item", F.col("__words").alias("__own")), "__key")
    flags = F.transform("__seen", lambda w, k: w == F.get(F.col("__own"), k + F.col("__item_start")))
    found = (
        aligned.withColumn("__best", _best_overlap(flags)).withColumn("__n", F.size("__own"))
        .where(F.col("__best.matched") >= F.least(F.lit(min_words), F.ceil(F.col("__n") * 0.9)))
        .groupBy("__id", "__row", "__item")
        .agg(F.max(F.struct(F.col("__best.matched"), F.col("__best.length"), -F.col("__start"), -F.col("__item_start"), F.col("__n"))).alias("__top"))
    )
    top = [F.col("__top").getField(n) for n in ("matched", "length", "col3", "col4", "__n")]
    return found.select(F.col("__id").alias(id_col), F.col("__item").alias(item_col), (-top[2]).alias("doc_word"), (-top[3]).alias("item_word"), top[0].alias("matched"), top[1].alias("overlap"), top[4].alias("item_words"))


def drop_leaks(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without a leak, all columns as they are; rows with a null id are judged by their text alone.

    Null and empty texts stay; repeated rows are judged alike. An empty table gives an empty table.
    """
    leaks = find_leaks(docs.withColumn("__key", F.xxhash64(F.col(text_col))), tests, id_col="__key", text_col=text_col, **options)
    return docs.withColumn("__key", F.xxhash64(F.col(text_col))).join(leaks.select("__key").distinct(), "__key", "left_anti").select(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
