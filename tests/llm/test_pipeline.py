"""Each stage of the pipeline against a brute-force version of it, and on awkward rows."""

from __future__ import annotations

import re
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from dialogmill.llm import mixing, toxicity
from dialogmill.llm.common import table
from tests.llm.test_operators import ascii_strip, classes, leaks_of

STAGES = dict(corpus_pipeline.STAGES)


def plain_score(text, model, known):
    """The score of one text, word by word: its plain words and the readings of what may hide one, each with its best piece of evidence."""
    raw = (text or "").lower().encode()
    letters = bytes(c if toxicity._LETTER[c] else 32 for c in raw)
    words = set(letters.split())
    own = np.frombuffer(raw, np.uint8)
    bounds = [(m.start(), m.end() - 1) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    begin, end = (np.array([b[k] for b in bounds], np.int64) for k in (0, 1))
    for a, b in toxicity.disguised(own, begin, end, np.array([0, len(begin)])):
        token = raw[a:b]
        for word in toxicity.restore(token.rstrip(b".,!?;:"), model.chars, 5 if b"*" in token.rstrip(b".,!?;:") else 1):
            words |= {word[k : k + n] for k in range(len(word)) for n in range(4, min(14, len(word) - k) + 1)} if b" " in token else {word} - {b""}
    total = model.prior
    for word in words:
        if word not in known:
            raw_word = np.frombuffer(word, np.uint8)
            keys = toxicity._keys(raw_word, np.array([0]), np.array([len(word) - 1]))[0]
            at = np.minimum(np.searchsorted(model.keys, keys), len(model.keys) - 1)
            known[word] = float(np.where(model.keys[at] == keys, model.weights[at], 0.0).max()) if len(model.keys) else 0.0
        total += known[word]
    return 1 / (1 + np.exp(-total))


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage_against_brute_force(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents")
    model, known = toxicity.learn_toxicity(docs, toxicity.learnable(table(spark, sf_dir, "labels"))), {}
    texts = rows_of(docs)
    want = {k: t for k, t in texts.items() if plain_score(t, model, known) < 0.3}
    assert 0 < len(want) < len(texts)

    def step(name, want, before):
        out = STAGES[name](spark, before, sf_dir)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.count() == len(want) and rows_of(after) == want
        return after

    after = step("toxicity", want, docs)
    holders = defaultdict(set)
    for k, text in want.items():
        for line in (text or "").split("\n"):
            holders[ascii_strip(line)].add(k)
    want = {k: "\n".join(x for x in (t or "").split("\n") if not ascii_strip(x) or len(holders[ascii_strip(x)]) < 10) for k, t in want.items()}
    after = step("line_dedup", want, after)
    assert all(r.n_chars == len(r.text) for r in after.collect())
    order = sorted(want)
    groups = classes([want[k] for k in order])
    want = {k: want[k] for n, k in enumerate(order) if groups[n][1] == n}
    after = step("jaccard_join", want, after)
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    leaked = {list(want)[d] for d, _ in leaks_of(list(want.values()), items)}
    want = {k: t for k, t in want.items() if k not in leaked}
    after = step("decontamination", want, after)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/decontamination/*.parquet'")
    taken = {k: (n, size) for k, n, size in con.execute(f"SELECT doc_id, taken, size FROM ({mixing.OP5_SQL})").fetchall()}
    out = {r.doc_id: r for r in STAGES["mixing"](spark, after, sf_dir).collect()}
    assert {k for k, (n, _) in taken.items() if n} <= set(out) <= set(want)
    assert all((r.text, r.taken) == (want[k], taken[k][0]) and r.taken == r.copies * taken[k][1] and r.copies >= 1 for k, r in out.items())
    assert {r.doc_id: r.copies for r in corpus_pipeline.run(spark, sf_dir).collect()} == {k: r.copies for k, r in out.items()}


def test_stages_take_awkward_rows(spark, sf_dir):
    """Null ids, texts and sources, empty texts, repeats and further columns pass every stage; so does an empty table."""
    docs = table(spark, sf_dir, "documents")
    odd = [(None, None, None, None, None), (None, "some words without an id", "en", "a", 24), (10**9, "", "en", None, 0), (10**9, "", "en", None, 0), (10**9 + 1, None, None, "a", None), (10**9 + 2, "x " * 60_000, "en", "a", 120_000)]
    more = {"__id": F.lit("x"), "__row": F.lit(1), "key": F.lit(2), "mix": F.lit("m"), "size": F.lit(3), "__key": F.lit(4)}
    rows = docs.union(spark.createDataFrame(odd, docs.select("doc_id", "text", "lang", "source", "n_chars").schema).select(docs.columns)).withColumns(more)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf_dir)
        found = out.collect()
        if name != "mixing":
            assert out.columns == rows.columns
            assert sum(r.doc_id is None for r in found) == 2, name
            # a text of nothing is no copy of another, but a repeated row is
            assert sum(r.doc_id == 10**9 for r in found) == (1 if name == "jaccard_join" else 2), name
            assert {10**9 + 1, 10**9 + 2} <= {r.doc_id for r in found}
        assert all(r["__id"] == "x" and r.key == 2 for r in found)
        assert stage(spark, rows.limit(0), sf_dir).collect() == []
