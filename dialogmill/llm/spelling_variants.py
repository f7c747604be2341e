"""Spelling variants: words one edit apart, found through the three rarest positional bigrams of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialogmill.llm.common import ascii_lower, discard, settled, table

#: Letters of a word. Two of them make at most 90 * 90 bigrams.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: A table of up to so many bigrams is broadcast; beyond, for words of large alphabets, it is joined like any other.
BROADCAST_GRAMS = 100_000
#: One edit destroys at most two bigrams of either word, so of three one is left.
RAREST = 3


def misspelt(run: Column, doc_id: Column, every: int = 199) -> Column:
    """The run without one code point where ``every`` divides crc32 of ``<doc_id>:<run>``; whole with a null id."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n): the distinct words of at least ``min_length`` code points and how often they occur, at least ``min_count`` times.

    Words are maximal runs of ``LETTERS`` of whole texts with A-Z lower-cased, misspelt as ``misspelt`` says. Null and
    empty texts have none, repeated rows count as often as they stand there, other columns aren't read. Counts are summed before they are
    shuffled, so a frequent word costs a row for each task.
    """
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(LETTERS), F.lit(0))).alias("run"))
    words = runs.select(misspelt(F.col("run"), F.col("id"), every).alias("word")).where(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _bigrams(words: DataFrame) -> DataFrame:
    """(word, at, gram): the bigrams of each word and where they stand, from 0."""
    places = F.sequence(F.lit(0), F.char_length("word") - 2)
    return words.where(F.char_length("word") >= 2).select("word", F.explode(places).alias("at")).withColumn("gram", F.substring("word", F.col("at") + 1, F.lit(2)))


def _keys(words: DataFrame) -> DataFrame:
    """(word, at, side, part): the three rarest bigrams of each word, each with what stands before it (the edit lies behind it) and with what follows it.

    The order is global: bigrams by the number of words that hold them, then by their text, then by place. On the side of the edit two letters next to
    the bigram or the two outermost letters are the same in both words, if that side has four letters; so the words of a
    frequent stem are split by these, and only those with up to four letters there meet at the stem alone.
    """
    grams = _bigrams(words)
    held = settled(grams.groupBy("gram").agg(F.count_distinct("word").alias("held")), "grams")
    known = F.broadcast(held) if held.count() <= BROADCAST_GRAMS else held
    ranked = grams.join(known, "gram").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("held", "gram", "at"))).alias("all"))
    rarest = ranked.select("word", F.explode(F.transform(F.slice("all", 1, RAREST), lambda g: g["at"])).alias("at"))
    word, at, n = F.col("word"), F.col("at"), F.char_length("word")

    def cut(start: Column, to: Column) -> Column:
        return F.substring(word, start + 1, F.greatest(to - start, F.lit(0)))

    none, bar = F.lit(0), F.lit("|")
    head, tail, rest = cut(none, at + 2), cut(at, n), n - at - 2
    keys = {
        "head, next": cut(none, at + 4), "head, last": F.concat(head, bar, cut(F.greatest(n - 2, at + 2), n)), "head": F.when(rest <= 4, head),
        "tail, next": cut(F.greatest(at - 2, none), n), "tail, first": F.concat(cut(none, F.least(at, F.lit(2))), bar, tail), "tail": F.when(at <= 4, tail),
    }
    sides = F.array(*[F.struct(F.lit(side).alias("side"), part.alias("part")) for side, part in keys.items()])
    return rarest.select("word", "at", F.inline(sides)).where("part IS NOT NULL")


def near_words(words: DataFrame) -> DataFrame:
    """(word, other): every ordered pair of words that differ by exactly one inserted, deleted or replaced code point.

    Words that differ by one edit share one of their ``RAREST`` rarest bigrams at places at most one apart, and the edit lies behind
    it or before it. So words meet at a bigram with equal text up to its end, or with equal text from its beginning: this bounds the
    place as the filter asks, and the many words of a frequent bigram meet only those of their own stem (see ``_keys``). Whoever meets is
    verified by edit distance.

    ``words`` has distinct words in a column ``word``; words of fewer than four code points are not compared (they may have no
    three bigrams), null words link with nothing, other columns aren't read.
    """
    keys = settled(_keys(words.select("word").where(F.char_length("word") >= RAREST + 1)), "bigrams")
    other = keys.select(F.col("word").alias("other"), F.col("at").alias("at_o"), "side", "part")
    close = (F.abs(F.col("at") - F.col("at_o")) <= 1) & (F.abs(F.char_length("word") - F.char_length("other")) <= 1)
    met = keys.join(other, ["side", "part"]).where(close & (F.col("word") < F.col("other")))
    pairs = settled(met.where(F.levenshtein("word", "other", 1) == 1).select("word", "other").distinct(), "near")
    discard(keys)
    return pairs.union(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of each word end. Every step doubles its length; forms grow more frequent, so they end."""
    steps = settled(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = settled(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        discard(steps)
        if longer.where("moved").isEmpty():
            return longer.drop("moved")
        steps = longer


def group_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root): of each word the frequent spelling it is a variant of.

    A word's form is its near word of largest n (the smallest in code-point order on ties) if that n is at least ``times`` the word's own, else
    null; its root is where its forms end, the word itself without a form. An empty table gives an empty table.
    """
    counted = settled(words.select("word", "n"), "words")
    others = counted.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), F.col("other"))).alias("best")
    found = near_words(counted).join(others, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    accepted = F.col("best.other_n") >= times * F.col("n")
    placed = settled(
        counted.join(found, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(accepted, F.col("best.other")).alias("form"), F.when(accepted, F.col("best.other_n")).alias("form_n"),
        ),
        "forms",
    )
    return placed.join(_roots(placed.where("form IS NOT NULL")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variant_groups(groups: DataFrame) -> DataFrame:
    """(root, n, spellings): all spellings of each root with their counts, most frequent first, and their sum; roots alone are left out."""
    spelling = F.struct((-F.col("n")).alias("__n"), "word", F.col("n").alias("count"))
    gathered = groups.where("form IS NOT NULL OR word <> root").groupBy("root").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(spelling)).alias("spellings"))
    return gathered.withColumn("spellings", F.transform("spellings", lambda s: F.struct(s["word"].alias("word"), s["count"].alias("n"))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(word_counts(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


_CRC = """list_reduce(list_transform(range(0, length(hex(encode(k))), 2), lambda i: CAST('0x' || substr(hex(encode(k)), CAST(i + 1 AS INT), 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, list_extract(crc_table, CAST((xor(c, b) & 255) + 1 AS INT))), 4294967295::BIGINT)"""
OP12_SQL = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS crc_table),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
d AS (SELECT run, doc_id || ':' || run AS k, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, xor({_CRC}, 4294967295) AS h FROM d, t),
m AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
c AS (SELECT word, length(word) AS size, unnest(range(1, length(word) + 1)) AS i FROM w),
x AS (SELECT word, size, i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS cut FROM c),
p AS (SELECT a.word, b.word AS other FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
      UNION SELECT x.word, w.word FROM x JOIN w ON x.cut = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.cut = w.word),
f AS (SELECT p.word, count(*) AS n_near, arg_min(p.other, (-o.n, p.other)) AS other, max(o.n) AS other_n FROM p JOIN w o ON o.word = p.other GROUP BY p.word),
g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM w LEFT JOIN f USING (word)),
s AS (SELECT word, word AS at FROM g UNION ALL SELECT s.word, g.form FROM s JOIN g ON g.word = s.at WHERE g.form IS NOT NULL)
SELECT g.word, g.form, s.at AS root, g.n, g.n_near, g.form_n FROM g JOIN s USING (word) JOIN g e ON e.word = s.at WHERE e.form IS NULL
"""
