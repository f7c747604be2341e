"""Each operator against a brute-force version, on rows that are null, empty, long, tied, repeated or oddly named."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from itertools import accumulate, combinations, product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dialogmill.llm import components, decontaminate, embedding_dedup, jaccard_join, language_id, line_dedup, mixing, passage_dedup, pieces, queries, token_counts, toxicity, warc
from tests.oracle import oracle_rows, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string, __row int, hub string, size int"


def docs_of(spark, texts, sources=None):
    """Documents 0, 1, ... with columns whose names clash with those used inside."""
    rows = [(k, t, "en", sources[k] if sources else "a", None, "x", 1, "h", 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, vocabulary=5000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def ascii_strip(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == oracle_rows(queries.ORACLE_SQL[name], sf_dir)


EMPTY_RUNS = {
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "mix": lambda s, d: mixing.mix_sources(d),
    "leaks": lambda s, d: decontaminate.find_leaks(d, s.createDataFrame([], "item_id long, text string")),
    "jaccard": lambda s, d: jaccard_join.jaccard_classes(d),
    "passages": lambda s, d: passage_dedup.repeated_passages(d),
    "vectors": lambda s, d: embedding_dedup.near_vectors(s.createDataFrame([], "vec_id long, embedding array<float>")),
    "toxic": lambda s, d: toxicity.score_toxicity(d, toxicity.learn_toxicity(d, s.createDataFrame([], "doc_id long, toxic int"))),
    "languages": lambda s, d: language_id.identify(d, VOCABULARY, language_id.learn_languages(d, VOCABULARY)),
    "tokens": lambda s, d: token_counts.count_tokens(d, VOCABULARY),
}
VOCABULARY = pieces.Vocabulary(tuple(p.encode() for p in ["▁", "▁a", "a", "b", "ab", "▁ab", "c", "abc", "e", "é", "▁the", "th"]))


@pytest.mark.parametrize("name", sorted(EMPTY_RUNS))
def test_empty_tables(spark, name):
    assert EMPTY_RUNS[name](spark, spark.createDataFrame([], SCHEMA)).collect() == []


# line dedup


def test_lines(spark):
    texts = [f" Same\tline \nown {k}\n\n" for k in range(10)] + ["SAME\tLINE", None, "", "é Same", "\n".join(f"l{i}" for i in range(20_000)) + "\nsame\tline"]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert out[3].text == "own 3\n\n" and tuple(out[3].line_dedup) == (4, 1)
    assert out[10].text == "" and tuple(out[11].line_dedup) == (1, 0) and out[11].text == "" and out[12].text == ""
    assert out[14].text.count("\n") == 19_999 and out[0].size == 2
    nine = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts[:9])).collect()}
    assert nine[0].text == texts[0]


def test_a_text_of_very_many_lines_takes_linear_time(spark):
    text = "\n".join(f"line {k}" if k % 2 else "Same" for k in range(200_000))
    docs = docs_of(spark, [text, *["same"] * 10])
    began = time.time()
    (row,) = line_dedup.dedup_lines(docs).where("doc_id = 0").collect()
    assert row.text == "\n".join(f"line {k}" for k in range(1, 200_000, 2)) and tuple(row.line_dedup) == (200_000, 100_000)
    assert time.time() - began < 60  # splitting the text anew for each line takes hours


def test_lines_of_repeated_rows_count_once(spark):
    one = docs_of(spark, ["again\nx"])
    many = one
    for _ in range(4):
        many = many.union(many)
    assert {r.text for r in line_dedup.dedup_lines(many).collect()} == {"again\nx"}
    null_ids = docs_of(spark, ["a"] * 10 + ["b"]).withColumn("doc_id", F.when(F.col("doc_id") < 10, F.col("doc_id")))
    assert sorted(r.text for r in line_dedup.dedup_lines(null_ids).collect()) == [""] * 10 + ["b"]


# mixing


def targets(sizes, cap=3.0):
    """Shares by weight; what is above the cap is shared anew among the others."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(target.values())
        level = left / max(sum(weight[s] for s in free), 1)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: cap * sizes[s] for s in over}
        free -= over


@pytest.mark.parametrize("scale", [{"a": 100, "b": 100, "c": 5, None: 40}, {"a": 1, "b": 2, "c": 500, "d": 1}, {"a": 3}])
def test_targets(spark, scale):
    texts, sources = [], []
    for source, n in scale.items():
        texts += [prose(k, 1 + k % 7) for k in range(n)]
        sources += [source] * n
    texts, sources = [*texts, None, ""], [*sources, "a", "a"]
    out = mixing.mix_sources(docs_of(spark, texts, sources)).collect()
    sizes, taken = {}, {}
    for r in out:
        assert r.mix.size == len(WORD.findall(texts[r.doc_id] or "")) and r.mix.taken <= 3 * r.mix.size
        sizes[r.source] = sizes.get(r.source, 0) + r.mix.size
        taken[r.source] = taken.get(r.source, 0) + r.mix.taken
    want = targets(sizes)
    assert all(math.isclose(r.mix.target, want[r.source], rel_tol=1e-9) for r in out)
    assert all(abs(taken[s] - want[s]) <= 14 for s in want)
    again = {r.doc_id: r.mix for r in mixing.mix_sources(docs_of(spark, texts, sources).repartition(5)).collect()}
    assert again == {r.doc_id: r.mix for r in out}
    assert mixing.emit_copies(mixing.mix_sources(docs_of(spark, texts, sources))).count() == sum(r.mix.copies for r in out)


@pytest.mark.parametrize("kind", ["string", "spread", "null"])
def test_mixing_takes_any_ids(spark, kind):
    texts = [prose(k, 1 + k % 9) for k in range(120)] + ["x " * 70_000]
    docs = docs_of(spark, texts, ["a" if k % 4 else "b" for k in range(121)])
    own = {"string": F.concat(F.lit("id-"), "doc_id"), "spread": F.xxhash64("doc_id"), "null": F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") - (1 << 62))}[kind]
    named = docs.withColumn("doc_id", own)
    found = mixing.mix_sources(named.union(named))
    rows = found.collect()
    again = mixing.mix_sources(named.union(named).repartition(3)).collect()
    assert len(rows) == 242 and sorted(map(str, rows)) == sorted(map(str, again))
    for source in "ab":
        own_rows = [r for r in rows if r.source == source]
        taken, target = sum(r.mix.taken for r in own_rows), own_rows[0].mix.target
        assert abs(taken - target) <= max(r.mix.size for r in own_rows) and all(r.mix.taken <= 3 * r.mix.size for r in own_rows)


# decontamination


def test_leaks(spark):
    item = prose("item", 40)
    w = item.split()
    swapped = [x if k not in (5, 17, 29) else "other" for k, x in enumerate(w)]
    texts = [f"{prose(1, 50)} {item} {prose(2, 9)}", " ".join(swapped).upper(), prose(3, 200), " ".join(w[:12]), " ".join(w[20:40]), None, "", f"x {item}" * 2, prose(4, 30_000) + " " + item]
    tests = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "too short")], "item_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs_of(spark, texts), tests).collect()}
    assert set(out) == {(k, 7) for k in (0, 1, 4, 7, 8)}
    assert (out[0, 7].doc_word, out[0, 7].matched, out[1, 7].matched, out[1, 7].overlap) == (50, 40, 37, 40)
    blocks = decontaminate.find_leaks(docs_of(spark, texts), tests.union(tests.selectExpr("item_id + 100", "text")), block_hashes=50)
    assert {r.doc_id for r in blocks.collect()} == {0, 1, 4, 7, 8}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs_of(spark, texts), tests).collect()) == [2, 3, 5, 6]


@pytest.mark.parametrize(("words", "changed"), [(n, 1) for n in range(14, 30)] + [(n, 2) for n in range(15, 30)] + [(n, 3) for n in range(16, 28)] + [(n, 4) for n in range(21, 26)])
def test_masks_meet_all_patterns(words, changed):
    """Every choice of changed words that leaves 13 and whose best segment is the whole leaves a mask untouched."""
    laid = [sum(1 << (at + k) for k, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS for at in range(words - len(m) + 1)]
    for places in combinations(range(1, words - 1), changed):
        score = list(accumulate(-2 if k in places else 1 for k in range(words)))
        if min(score) > 0 and max(score[:-1]) < score[-1]:
            pattern = sum(1 << k for k in places)
            assert any(mask & pattern == 0 for mask in laid), places


def leaks_of(texts, items):
    """By trying every alignment that matches often enough: {(document, item): most matched words of a best segment that is a leak}."""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = {}
    bodies = [(item, cut(body)) for item, body in items]
    for d, text in enumerate(texts):
        w = cut(text)
        places = defaultdict(list)
        for at, x in enumerate(w):
            places[x].append(at)
        for item, own in bodies:
            need = min(13, math.ceil(len(own) * 0.9))
            shifts = Counter(at - k for k, x in enumerate(own) for at in places.get(x, ()))
            for shift in [x for x, n in shifts.items() if n >= need]:
                pairs = [w[shift + i] == x for i, x in enumerate(own) if 0 <= shift + i < len(w)]
                best = (0, 0)
                for a in range(len(pairs)):
                    score = matched = 0
                    for hit in pairs[a:]:
                        score, matched = score + (1 if hit else -2), matched + hit
                        if score > best[0]:
                            best = (score, matched)
                if best[1] >= need:
                    found[d, item] = max(found.get((d, item), 0), best[1])
    return found


@pytest.mark.parametrize("block_hashes", [1_000_000, 10])
def test_leaks_against_brute_force(spark, block_hashes):
    draw = random.Random(11)
    bodies = [prose(f"item{n}", n) for n in (1, 2, 6, 7, 9, 10, 11, 12, 14, 15, 16, 17, 18, 19, 20, 33)]
    items = [(k, b) for k, b in enumerate(bodies)] + [(3, prose("second text", 14)), (None, prose("no id", 16)), (40, None), (41, " .,")]
    texts = []
    for k in range(120):
        parts = [prose(f"d{k}", draw.randrange(0, 40), 10**6)]
        for _ in range(draw.randrange(0, 3)):
            w = draw.choice(items[:-2])[1].split()
            for at in draw.sample(range(len(w)), draw.randrange(0, 2) if len(w) < 16 else draw.randrange(0, 4)):
                w[at] = f"x{draw.random()}".replace(".", "")
            parts += [" ".join(w), prose(f"e{k}", draw.randrange(0, 9), 10**6)]
        texts.append(draw.choice([" ", ", "]).join(parts).upper() if k % 2 else " ".join(parts))
    texts += [None, "", bodies[5] + " " + bodies[5]]
    df = docs_of(spark, texts)
    tests = spark.createDataFrame(items, "item_id long, text string").withColumns({"__seed": F.lit(1), "__words": F.lit("x")})
    rows = decontaminate.find_leaks(df.union(df), tests, block_hashes=block_hashes).collect()
    got = {(r.doc_id, r.item_id): r.matched for r in rows}
    assert len(got) == len(rows) > 30 and got == leaks_of(texts, items)
    bare = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert decontaminate.drop_leaks(bare, tests).count() == len(texts) - len({d for d, _ in got})


def test_masks_find_substitutions():
    from itertools import combinations

    for words, changed in ((11, 1), (15, 2), (20, 3)):
        for places in combinations(range(words), changed):
            assert any(all(b == "0" or at + o not in places for o, b in enumerate(m)) for m in decontaminate.MASKS for at in range(words - len(m) + 1))


# n-gram Jaccard join


def classes(texts, width=5):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


def near_texts():
    base, texts = prose("base", 300).split(), []
    for k in range(60):  # near copies with 0 to 12 changed words, about the threshold
        w = list(base)
        for at in random.Random(k).sample(range(300), k % 13):
            w[at] = f"new{k}_{at}"
        texts.append(" ".join(w))
    shared = prose("shared", 80)
    texts += [f"{prose(1000 + k, 60 + 7 * k)} {shared}" for k in range(40)]  # a passage in many
    texts += [prose(5, 4), prose(5, 4).upper(), "one", "One", None, "", " \t", prose(6, 20_000), prose(6, 20_000) + " end", prose(7, 30), prose(7, 30) + " x y z"]
    return texts


def test_jaccard(spark):
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs_of(spark, texts)).collect()}
    assert got == classes(texts)


def test_jaccard_in_slices_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SLICE", 3_000)
    monkeypatch.setattr(jaccard_join, "HELD", 2_000)
    monkeypatch.setattr(jaccard_join, "BLOCK", 2_000)
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs_of(spark, texts)).collect()}
    assert got == classes(texts)


def test_jaccard_without_the_filter(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FILTER_ROWS", 0)
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs_of(spark, texts)).collect()}
    assert got == classes(texts)


def test_packed_indices():
    draw = np.random.default_rng(1)
    runs = [np.sort(draw.integers(0, top, n)) for top, n in ((5, 9), (1, 0), (100_000, 40), (255, 3), (1, 4), (3, 0), (600, 700))]
    bound = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    index, again = jaccard_join.unpack_indices(*jaccard_join.pack_indices(np.concatenate(runs), bound))
    assert (index == np.concatenate(runs)).all() and (again == bound).all()
    none = jaccard_join.unpack_indices(*jaccard_join.pack_indices(np.zeros(0, np.int64), np.zeros(3, np.int64)))
    assert len(none[0]) == 0 and none[1].tolist() == [0, 0, 0]


def test_jaccard_nulls_and_repeats(spark):
    df = docs_of(spark, ["a b c d e f", "a b c d e f", "q", "q", "r"]).withColumn("doc_id", F.when(F.col("doc_id") < 3, F.col("doc_id")))
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.jaccard_classes(df.union(df)).collect()), key=str)
    assert got == sorted([(0, 0), (1, 0), (2, 2), (None, 2), (None, None)] * 2, key=str)
    assert sorted(str(r.doc_id) for r in jaccard_join.keep_one(df.union(df)).collect()) == ["0", "2", "None", "None", "None", "None"]


def test_signature_tree_links_what_links():
    draw = np.random.default_rng(2)
    base = np.unique(draw.integers(0, 1 << 62, 120).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[draw.random(len(base)) < p], draw.integers(0, 1 << 62, 5).astype(np.uint64)])) for p in np.repeat([0.99, 0.9, 0.5], 12)]
    links = list(jaccard_join.SignatureTree(sets).links(75))
    comp = list(range(len(sets)))
    for a, b in links:
        comp = [comp[a] if c == comp[b] else c for c in comp]
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                assert comp[a] == comp[b]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in components.components(links, "a", "b").collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


# embeddings


def test_vectors(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(400, 32))
    x[100:130] = x[0] + 0.12 * draw.normal(size=(30, 32))
    x[200:210] = x[1]
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x.astype(np.float32))]
    rows += [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [None, *[1.0] * 31]), (904, [1.0, 2.0]), (None, rows[1][1]), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "n": F.lit(1), "key": F.lit(2)})
    got = sorted((tuple(r) for r in embedding_dedup.near_vectors(df).collect()), key=str)
    y = x.astype(np.float32).astype(np.float64)
    y = np.vstack([y, y[1], y[1]])
    ids = [*range(400), None, 1]
    near = (y / np.linalg.norm(y, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T >= 0.95
    root = {k: k for k in range(400)}
    for a in range(400):
        for b in np.flatnonzero(near[a, :400]):
            lo, hi = sorted((root[a], root[int(b)]))
            root = {k: lo if v == hi else v for k, v in root.items()}
    want = [(i, int(near[k].sum()) - 1, root[1 if i is None else i], i is not None and root[i] == i) for k, i in enumerate(ids)]
    want += [(i, 0, i, True) for i in range(900, 905)]
    assert got == sorted(want, key=str)


def test_vectors_of_all_lengths_ids_and_sizes(spark):
    draw = np.random.default_rng(6)
    long, short, huge = draw.normal(size=32), draw.normal(size=16), draw.normal(size=32)
    rows = [(k, list(map(float, long + 0.01 * draw.normal(size=32)))) for k in range(5)]
    rows += [(10, list(map(float, short))), (11, list(map(float, short))), (12, list(map(float, short * 3 + 0.01)))]
    rows += [(None, list(map(float, long * 2 + 0.001))), (None, [1.0, *[0.0] * 7]), (None, [2.0, *[0.0] * 7])]
    rows += [(20, list(map(float, huge * 1e200))), (21, list(map(float, huge * 1.5e-300))), (30, [5.0]), (31, [1e-320]), (32, [-1.0]), (7, list(map(float, -long))), (7, list(map(float, draw.normal(size=32))))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()), key=str)
    want = [(0, 5, 0, True), *[(k, 5, 0, False) for k in range(1, 5)], (None, 5, 0, False), (10, 2, 10, True), (11, 2, 10, False), (12, 2, 10, False)]
    want += [(None, 1, None, False)] * 2 + [(20, 1, 20, True), (21, 1, 20, False), (30, 1, 30, True), (31, 1, 30, False), (32, 0, 32, True), (7, 0, 7, True), (7, 0, 7, True)]
    assert found == sorted(want, key=str)


@pytest.mark.parametrize("size", [16, 32, 64, 256])
def test_recall_and_candidates_of_each_length(spark, size):
    """Pairs at and above the least cosine are found, and random vectors are seldom compared."""
    draw = np.random.default_rng(size)
    base = draw.normal(size=(1500, size))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = draw.normal(size=base.shape)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = draw.uniform(0.951, 0.999, len(base))[:, None]
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * other])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(9000, [1.0] * 64)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    links = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(df).collect()}
    found, all_links = sum(links.values()), int(near.sum()) - len(x)
    assert 0.99 * all_links <= found <= all_links and links[9000] == 0
    quantisers = {size: embedding_dedup.Quantiser.learn(base)}
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(base)], "id long, vector array<double>")
    compared = embedding_dedup.candidates(embedding_dedup.postings(rows, quantisers, 16), 16, 24, 4).count()
    assert compared < 0.02 * len(base) ** 2 / 2


# toxicity


def test_long_signs_take_little_time():
    """A megabyte of digits set apart, of one encoded word, or of signs and letters in turns blocks no task."""
    draw = random.Random(1)
    model = toxicity.CharModel(np.arange(1000), np.ones(1000, np.int64))
    digits = " ".join(draw.choices("0123456789", k=1 << 19))
    encoded = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=1 << 20))
    for text in (digits, encoded, "\n".join(" ".join(draw.choices("0123456789", k=40)) for _ in range(13_000))):
        began = time.time()
        assert sum(n for _, n, _, _ in toxicity.Reader(model).chunks(pa.array([text]))) == 1
        assert time.time() - began < 5


def test_words_set_apart_in_long_rows_are_found():
    texts = ["the idiot and the moron is a stupid loser of trash worthless disgusting clown scum pathetic"] * 50
    total = Counter()
    for t in texts:
        s = toxicity._SYMBOL[np.frombuffer(f" {t} ".encode(), np.uint8)].astype(int)
        total.update((s[:-2] * toxicity.N_SYMBOLS + s[1:-1]) * toxicity.N_SYMBOLS + s[2:])
    model = toxicity.CharModel(np.array(list(total)), np.array(list(total.values())))
    word = toxicity._keys(np.frombuffer(b"worthless", np.uint8), np.array([0]), np.array([8]))[0, 0]
    for before in range(0, 60, 7):
        text = " ".join(["t h e"] * before + ["w 0 r t h l 3 s s"] + ["t h e"] * 40)
        assert any(word in keys[:, 0] for _, _, _, keys in toxicity.Reader(model).chunks(pa.array([text])))


def test_restoring():
    texts = ["the idiot and the moron is a stupid loser of trash worthless disgusting clown scum pathetic"] * 50
    total = np.zeros(toxicity.N_SYMBOLS**3)
    for t in texts:
        low = np.frombuffer(f" {t} ".encode(), np.uint8)
        s = toxicity._SYMBOL[low]
        np.add.at(total, (s[:-2] * toxicity.N_SYMBOLS + s[1:-1]) * toxicity.N_SYMBOLS + s[2:], 1)
    model = toxicity.CharModel(np.flatnonzero(total), total[total > 0])
    for hidden, plain in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("m.o.r.o.n", "moron"), ("$tup1d", "stupid"), ("looooser", "loser"), ("tr@sh", "trash"), ("w0rthl3ss", "worthless"), ("idiot", "idiot")):
        assert toxicity.restore(hidden.encode(), model)[0].decode() == plain
    assert b"scum" in toxicity.restore(b"sc*m", model, 5)


def test_restoring_is_the_best_of_all_readings():
    draw = np.random.default_rng(7)
    keys = draw.choice(27**3, 4000, replace=False)
    a, b, c = keys // 729, keys // 27 % 27, keys % 27
    model = toxicity.CharModel((a * toxicity.N_SYMBOLS + b) * toxicity.N_SYMBOLS + c, draw.integers(1, 50, len(keys)))
    letters = "aeilost013457@$!*.-"
    for _ in range(300):
        token = "".join(draw.choice(list(letters), draw.integers(1, 7)))
        runs = [m.group() for m in re.finditer(r"(.)\1*", token)]
        best = None
        for said in product(*[toxicity._choices(r[0].encode(), len(r)) for r in runs]):
            gain, x, y = sum(cost for _, cost in said), 0, 0
            for symbol in b"".join(s for s, _ in said):
                z = int(toxicity._SYMBOL[symbol])
                gain, x, y = gain + model.log[x, y, z], y, z
            gain += model.log[x, y, 0]
            best = gain if best is None else max(best, gain)
        got = toxicity.restore(token.encode(), model)[0]
        options = [sum(c for _, c in said) + sum(model.log[p, q, r] for p, q, r in zip([0, 0, *s][:-1], [0, *s], [*s, 0], strict=False)) for said in product(*[toxicity._choices(r[0].encode(), len(r)) for r in runs]) if b"".join(x for x, _ in said) == got for s in [[int(toxicity._SYMBOL[x]) for x in got]]]
        assert math.isclose(max(options), best, rel_tol=1e-4, abs_tol=1e-3), token


def test_long_words_hide_words_too():
    """Words of any number of runs are restored, with the best reading of the whole."""
    texts = ["the idiot and the moron is a stupid loser of trash worthless disgusting clown scum pathetic"] * 50
    total = Counter()
    for t in texts:
        s = toxicity._SYMBOL[np.frombuffer(f" {t} ".encode(), np.uint8)].astype(int)
        total.update((s[:-2] * toxicity.N_SYMBOLS + s[1:-1]) * toxicity.N_SYMBOLS + s[2:])
    model = toxicity.CharModel(np.array(list(total)), np.array(list(total.values())))
    for more in (0, 1, 5, 400):
        plain = "worthless" + "moronandtheclown" * more
        word = toxicity._keys(np.frombuffer(plain.encode(), np.uint8), np.array([0]), np.array([len(plain) - 1]))[0]
        text = "so w0rthl3ss" + "m0ronandtheclown" * more + " it is"
        assert any((keys == word).all() for _, _, _, found in toxicity.Reader(model).chunks(pa.array([text])) for keys in found)


def area_under_curve(scores, labels):
    """Chance that a row of label 1 scores above one of label 0; a tie counts half."""
    pos, neg = scores[labels == 1], scores[labels == 0]
    return float(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = toxicity.op4_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id").toPandas()
    area = area_under_curve(scored.score.to_numpy(), scored.toxic.to_numpy())
    hit = ((scored.predicted == 1) & (scored.toxic == 1)).sum()
    f1 = 2 * hit / max((scored.predicted == 1).sum() + (scored.toxic == 1).sum(), 1)
    print(f"held-out rows {len(scored)}, label 1 {int((scored.toxic == 1).sum())}, area {area:.4f}, F1 {f1:.4f}")
    assert area > 0.9 and f1 > 0.85


def test_toxicity_of_awkward_rows(spark):
    """Null ids and repeated rows are rows of their own, contradicting labels of an id count as 1, columns may be named like inner ones."""
    texts = [f"{prose(k, 30, 300)} {'idiot moron' if k % 4 == 0 else 'fine'}" for k in range(200)]
    docs = docs_of(spark, texts)
    twice = docs.union(docs.limit(5)).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id"))).withColumns({"__text": F.lit("moron"), "score": F.lit(9), "__doc": F.lit(1)})
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(4, 0), (8, 0)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(twice, labels)
    rows = toxicity.score_toxicity(twice, model).collect()
    assert len(rows) == 205 and sum(r.doc_id is None for r in rows) == 2
    assert all((r.score >= 0.3) == (r.doc_id % 4 == 0) for r in rows if r.doc_id is not None)
    assert toxicity.drop_toxic(twice, model).columns == twice.columns


def test_toxicity_learns_and_holds_out(spark):
    texts = [f"{prose(k, 60, 300)} {'idiot moron' if k % 4 == 0 else 'fine'} {prose(-k, 20, 300)}" for k in range(400)]
    docs = docs_of(spark, [*texts, None, "", "an 1d10t and a m0r0n", prose(9, 50_000)])
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 1) for k in range(400)] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.learn_toxicity(docs, toxicity.learnable(labels))
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((score[k] >= 0.3) == (k % 4 == 0) for k in range(400)) and all(0 <= s <= 1 for s in score.values())
    assert score[400] == score[401] < 0.3 <= score[402] and score[403] < 0.3
    assert {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()} == {k for k, s in score.items() if s < 0.3}
    assert toxicity.deobfuscate(docs.where("doc_id IN (400, 402)"), model.chars).select("restored").collect()[1].restored == "an idiot and a moron"


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, ["a", None])
    model = toxicity.learn_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in toxicity.score_toxicity(docs, model).collect()} == {0.05}


# pieces


def best_count(word, vocabulary):
    score = {p: s for p, s in zip(vocabulary.pieces, vocabulary.scores, strict=True)}
    best = [(0.0, 0)] + [(-1e18, 0)] * len(word)
    for i in range(len(word)):
        for j in range(i + 1, len(word) + 1):
            gain = score.get(word[i:j], vocabulary.byte_score if j == i + 1 else None)
            if gain is not None:
                s, n = best[i][0] + gain, best[i][1] + 1
                if s > best[j][0] + 1e-9 or (abs(s - best[j][0]) <= 1e-9 and n < best[j][1]):
                    best[j] = (s, n)
    return best[-1][1]


def test_token_counts(spark):
    draw = random.Random(1)
    texts = [" ".join("".join(draw.choice("abcéx") for _ in range(draw.randrange(1, 9))) for _ in range(draw.randrange(0, 30))) for _ in range(80)]
    texts += [None, "", " \n", "abc" * 40 + " ab", "ab\x00c", "the the"]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs_of(spark, texts), VOCABULARY).collect()}
    for k, t in enumerate(texts):
        words = [pieces.WORD_START + w for w in (t or "").encode().split()]
        assert got[k] == (len(words), sum(best_count(w, VOCABULARY) for w in words)), t


def all_segmentations(word, chance, pieces_, byte_chance):
    total = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        total[j] = total[j - 1] * byte_chance + sum(total[i] * chance[pieces_.index(word[i:j])] for i in range(j) if word[i:j] in pieces_)
    return total[-1]


def test_forward_sums_all_segmentations():
    draw = random.Random(3)
    chance = np.random.default_rng(3).dirichlet(np.ones(len(VOCABULARY.pieces)), 2).T
    words = sorted({"".join(draw.choice("abcx") for _ in range(draw.randrange(1, 10))).encode() for _ in range(200)} | {"é".encode()})
    table = np.full((len(words), 64), 256, np.int16)
    for k, w in enumerate(words):
        full = pieces.WORD_START + w
        table[k, : len(full)] = np.frombuffer(full, np.uint8)
    got = pieces.forward(table, np.array([len(w) + 3 for w in words]), VOCABULARY, chance, 1e-4)
    for k, w in enumerate(words):
        for m in range(2):
            want = all_segmentations(pieces.WORD_START + w, chance[:, m], list(VOCABULARY.pieces), 1e-4)
            assert math.isclose(math.exp(got[k, m]), want, rel_tol=1e-9)
        assert np.allclose(pieces.long_forward(pieces.WORD_START + w, VOCABULARY, chance, 1e-4), got[k])


def test_languages_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = language_id.op7_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id").toPandas()
    share = float((found.lang == found.lang_pred).mean())
    print(f"held-out rows {len(found)}, right {share:.4f}")
    assert share > 0.95


def test_pieces_of_awkward_rows(spark):
    """Null ids, repeated rows and very long texts are counted and judged row by row."""
    vocabulary = pieces.Vocabulary.load(token_counts.VOCABULARY_FILE)
    rows = [(1, "the house is in the town", "en"), (2, "der Hund ist nicht in dem Haus", "de"), (None, "the house", None), (None, "the house", None), (3, "the house " * 200_000, None), (3, "das Haus", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "n_words": F.lit(2)})
    counts = sorted(((r.doc_id, r.n_words) for r in token_counts.count_tokens(docs, vocabulary).collect()), key=str)
    assert counts == sorted([(1, 6), (2, 7), (None, 2), (None, 2), (3, 400_000), (3, 2)], key=str)
    model = language_id.learn_languages(docs, vocabulary)
    found = sorted(((r.doc_id, r.lang_pred) for r in language_id.identify(docs, vocabulary, model).collect()), key=str)
    assert found == sorted([(1, "en"), (2, "de"), (None, "en"), (None, "en"), (3, "en"), (3, "de")], key=str)


def test_long_words_follow_the_same_rule():
    draw = random.Random(5)
    chance = np.random.default_rng(5).dirichlet(np.ones(len(VOCABULARY.pieces)), 3).T
    text = " ".join("".join(draw.choice("abcx") for _ in range(draw.choice([5, 47, 49, 90, 100, 300]))) for _ in range(300)) + " " + "x" * 700 + " " + "ab" * 2000
    (words,) = pieces.words_of(pieces.pa.array([text]))
    everything, zero = np.arange(len(words.keys)), np.zeros((len(words.keys), 3))
    got = pieces.computed(words, everything, lambda w, n, _: pieces.forward(w, n, VOCABULARY, chance, 1e-9), lambda w, _: pieces.long_forward(w, VOCABULARY, chance, 1e-9), zero.copy())
    counts = pieces.computed(words, everything, lambda w, n, _: pieces.best_segmentation(w, n, VOCABULARY)[0], lambda w, _: len(pieces.long_best(w, VOCABULARY)), np.zeros(len(words.keys), int))
    for k in everything:
        word = pieces.WORD_START + words.raw[words.begin[k] : words.begin[k] + words.size[k]].tobytes()
        assert np.allclose(got[k], pieces.long_forward(word, VOCABULARY, chance, 1e-9), rtol=1e-9)
        assert counts[k] == best_count(word, VOCABULARY)


def test_languages(spark):
    vocabulary = pieces.Vocabulary.load(token_counts.VOCABULARY_FILE)
    rows = [(k, "the thing of that nation is in the house" if k % 2 else "der Hund ist nicht in dem Haus und schläft", "en" if k % 2 else "de") for k in range(40)]
    docs = spark.createDataFrame([*rows, (100, None, "en"), (101, "12 *** 3", "de"), (102, "the nation", None), (103, "nicht " + "x" * 500, None), (None, "der Hund", "de")], "doc_id long, text string, lang string")
    model = language_id.learn_languages(docs.where("doc_id < 40"), vocabulary)
    got = {r.doc_id: r for r in language_id.identify(docs, vocabulary, model).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows)
    assert [got[k].lang_pred for k in (100, 101, 102, 103, None)] == ["und", "und", "en", "de", "de"]
    assert got[100].score == 0 and 0.5 <= got[102].score <= 1


def test_hot_keys_are_spread(spark, monkeypatch):
    draw = np.random.default_rng(8)
    base = draw.normal(size=64)
    x = np.concatenate([base + draw.normal(size=(300, 64)) * 0.15, draw.normal(size=(200, 64))])
    table = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id int, vector array<double>")
    posted = embedding_dedup.postings(table, {64: embedding_dedup.Quantiser.learn(x)}, 16)
    whole = sorted(tuple(sorted(r)) for r in embedding_dedup.candidates(posted, 16, 24, 3).collect())
    monkeypatch.setattr(embedding_dedup, "KEY_ROWS", 20)
    tasks = embedding_dedup.spread(posted, 3).where("i >= 0").groupBy("part", "i", "j").count().agg(F.max("count"), F.count("*")).first()
    assert tasks[0] < 100 and tasks[1] > 100
    assert sorted(tuple(sorted(r)) for r in embedding_dedup.candidates(posted, 16, 24, 3).collect()) == whole and len(set(whole)) == len(whole) > 40_000


# passages


def test_passages(spark):
    passage = prose("passage", 51)
    texts = [f"{prose(1, 70)} {passage} {prose(2, 70)}", f"{prose(3, 33)} {passage.upper()}\n{prose(4, 50)}", prose(5, 300), None, "", "short " * 30, f"é {passage}", prose(6, 39), prose(6, 39)]
    out = passage_dedup.repeated_passages(docs_of(spark, texts)).collect()
    assert {r.doc_id for r in out} == {1, 6} and {r.kept_id for r in out} == {0}
    for r in out:
        assert WORD.findall(texts[r.doc_id][r.start : r.stop].lower())[0] in passage and len(WORD.findall(texts[r.doc_id][r.start : r.stop])) >= 40
    cut = {r.doc_id: r.text for r in passage_dedup.cut_repeats(docs_of(spark, texts)).collect()}
    assert cut[0] == texts[0] and cut[3] is None and len(WORD.findall(cut[6])) <= 12 and cut[7] == cut[8] == texts[7]


def test_every_repeat_of_50_words_is_found(spark):
    texts = []
    for k in range(40):
        p = prose(f"p{k}", 50)
        texts += [f"{prose(k, 20 + k)} {p} {prose(-k, 31)}", f"{prose(100 + k, 11 + k)} {p} {prose(200 + k, 5)}"]
    assert {r.doc_id for r in passage_dedup.repeated_passages(docs_of(spark, texts)).collect()} == set(range(1, 80, 2))


def test_short_lines_and_paragraphs(spark):
    texts = ["one two\nthree", f"{prose(1, 60)}\nTHREE\n\nsix seven\neight nine ten\n", "x\n\nsix seven eight\nnine ten\n\ny", "three\nthree", "own"]
    found = {(r.doc_id, texts[r.doc_id][r.start : r.stop], r.kept_id) for r in passage_dedup.repeated_passages(docs_of(spark, texts), line_words=1).collect()}
    assert found == {(1, "THREE", 0), (2, "six seven eight\nnine ten", 1), (3, "three", 0)}
    cut = {r.doc_id: r.text for r in passage_dedup.cut_repeats(docs_of(spark, texts), line_words=1).collect()}
    assert cut[3] == "\n" and cut[0] == texts[0] and cut[4] == "own"


def test_passages_are_cut_to_their_ends(spark):
    texts, want = [], {}
    for k in range(40):
        more, p = prose(f"m{k}", 1 + k % 10, 10**9), prose(f"p{k}", 50, 10**9)
        # the second shares the passage with the first, the third also what stands before it in the second
        texts += [f"{prose(k, 20 + k)} {p} {prose(-k, 31)}", f"{prose(100 + k, 11 + k)} {more} {p} {prose(200 + k, 5)}", f"{prose(300 + k, 9)} {more} {p}"]
        want |= {3 * k + 1: p, 3 * k + 2: f"{more} {p}"}
    got = {r.doc_id: texts[r.doc_id][r.start : r.stop] for r in passage_dedup.repeated_passages(docs_of(spark, texts)).collect()}
    assert got == want


def covered(texts, width, line_words, text_words):
    """Places of words, by document, that an earlier line, paragraph, text or run of ``width`` words makes redundant."""
    first, out, units = {}, [], []
    for k, text in enumerate(texts):
        words = [(m.group().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m.start()) for m in WORD.finditer(text or "")]
        spans, line = [], 0
        lines = (text or "").split("\n")
        at = 0
        for one in lines:
            n = len(WORD.findall(one))
            spans.append((at, at + n))
            at += n
        blocks, start = [], None
        for a, b in [*spans, (at, at)]:
            if b > a and start is None:
                start = a
            if b == a and start is not None:
                blocks.append((start, a))
                start = None
        fit = {x for x in [*spans, *blocks] if x[1] - x[0] >= max(1, line_words)} | ({(0, at)} if at >= max(1, text_words) else set())
        units.append([("run", a, a + width) for a in range(len(words) - width + 1)] + [("block", a, b) for a, b in sorted(fit)])
        out.append(set())
        for kind, a, b in sorted(units[-1], key=lambda u: u[1]):
            key = (kind, tuple(w for w, _ in words[a:b]))
            if first.setdefault(key, (k, a)) != (k, a):
                out[-1] |= set(range(a, b))
    return out


@pytest.mark.parametrize("line_words", [1, 12, None])
def test_passages_against_brute_force(spark, line_words):
    """All of each repeated run of 50 words is found, and nothing that isn't in one of 40 (or in a repeated block)."""
    draw = random.Random(9)
    pool = [prose(f"pool{k}", n) for k, n in enumerate([3, 8, 20, 45, 50, 55, 60, 90])]
    texts = []
    for k in range(70):
        parts = [draw.choice(pool) if draw.random() < 0.4 else prose(f"{k}/{n}", draw.randrange(1, 60)) for n in range(draw.randrange(1, 6))]
        texts.append("".join(x + draw.choice([" ", " ", "\n", "\n\n", " \t "]) for x in parts))
    texts += [None, "", " \n", texts[3].upper(), texts[4] + " tail", "one", "One\n", prose("long", 9000) + " " + pool[-1] + " " + pool[-1]]
    got = [set() for _ in texts]
    df = docs_of(spark, texts)
    for r in passage_dedup.repeated_passages(df.union(df.limit(7)), line_words=line_words, text_words=1).collect():
        assert r.kept_id <= r.doc_id
        starts = [m.start() for m in WORD.finditer(texts[r.doc_id])]
        got[r.doc_id] |= {n for n, at in enumerate(starts) if r.start <= at < r.stop}
    least = 40 if line_words is None else line_words
    surely, possibly = covered(texts, 50, least, 1), covered(texts, 40, least, 1)
    for k in range(len(texts)):
        assert surely[k] <= got[k] <= possibly[k], texts[k]
    assert sum(map(len, got)) > 1000


def test_passages_without_the_filter(spark, monkeypatch):
    texts = [f"{prose(k, 9)} {prose(f'm{k // 4}', k % 7)} {prose(f'p{k // 4}', 55)} {prose(-k, 12)}" for k in range(32)]
    run = lambda: sorted(tuple(r) for r in passage_dedup.repeated_passages(docs_of(spark, texts)).collect())
    whole = run()
    monkeypatch.setattr(passage_dedup, "FILTER_KEYS", 0)
    assert run() == whole and len(whole) == 24


def test_passages_of_ties_and_null_ids(spark):
    text = f"{prose('t', 60)} end"
    rows = [(None, text), (None, text), (1, text), (1, text), (1, f"other {text}"), (2, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.start, r.stop, r.kept_id) for r in passage_dedup.repeated_passages(df).collect()}
    assert found == {(2, 0, len(text), 1)}


# archives


def test_archives(spark, tmp_path):
    big = "<p>é" + "x" * 1000 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/1\n2", big), (5, "http://a/5", big), (3, None, big), (7, "u", "small"), (8, "u", "small"), (9, "u", None), (10, "u", ""), (None, "u", big), (11, "u", "y" * 999), (12, "u", "y" * 999), (13, "u", "z" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"n": F.lit(1), "original": F.lit("x"), "payload": F.lit("y")})
    warc.write_archives(warc.resolve_revisits(pages).repartition(4), str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        body = (html or "").encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert got[page_id].payload is None if got[page_id].record_type == "revisit" else bytes(got[page_id].payload) == body
    assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {1: 5, 3: 5, None: 5}
    assert got[1].url == "http://a/1%0A2" and got[3].url is None
    warc.write_archives(warc.resolve_revisits(pages.limit(0)), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).collect() == []


def test_archives_of_repeated_ids(spark, tmp_path):
    big = "y" * 1500
    pages = spark.createDataFrame([(5, "u", big), (5, "u", big), (4, "v", big), (4, "v", big), (4, "w", "z" * 1500)], "page_id long, url string, html string")
    warc.write_archives(warc.resolve_revisits(pages), str(tmp_path / "w"))
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_digest == hashlib.sha1(big.encode()).hexdigest()) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    assert got == [(4, "response", None, False), (4, "revisit", 5, True), (4, "revisit", 5, True), (5, "response", None, True), (5, "response", None, True)]


def test_archives_are_read_by_others(spark, tmp_path):
    """Every file is a run of gzip members that hold whole records, also under the names that other readers ask for."""
    import gzip

    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<p>{prose(k % 3, 400)}") for k in range(30)], "page_id long, url string, html string")
    warc.write_archives(warc.resolve_revisits(pages), str(tmp_path / "w"))
    warc.name_archives(spark, str(tmp_path / "w"))
    kinds = Counter()
    files = list((tmp_path / "w").glob("*.warc.gz"))
    for file in files:
        data = gzip.decompress(file.read_bytes())
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            kinds[fields["WARC-Type"]] += 1
            size = int(fields["Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            data = rest[size + 4 :]
    assert files and kinds == {"warcinfo": len(files), "response": 3, "revisit": 27}
