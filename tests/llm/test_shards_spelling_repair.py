"""Sharding, spelling variants and conversation repair against brute force, on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from dialogmill.llm import conversation_repair as repair
from dialogmill.llm import sharding, spelling_variants

CLASH = "lang string, node long, hub string, shard int, word string, conv long, pos long, n long"
CLASH_ROW = ("x", 1, "h", 2, "w", 3, 4, 5)


# sharding


def groups_cut(rows, text_of):
    """Texts of two rows or more, and those of them in more than one shard."""
    shards = defaultdict(set)
    counts = Counter()
    for row in rows:
        if text_of[row["id"]] is not None:
            shards[text_of[row["id"]]].add(row["shard"])
            counts[text_of[row["id"]]] += 1
    return [t for t in shards if counts[t] > 1], [t for t in shards if counts[t] > 1 and len(shards[t]) > 1]


def check_slots(rows):
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    out = [" ".join(draw.choices("abcdefgh", k=draw.randrange(1, 200))) for _ in range(900)]
    out += [out[draw.randrange(200)] for _ in range(500)]  # copies in groups of two and more
    out += ["", "", None, None, "é" * 40, "é" * 40, "x " * 3000]
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards_are_even_and_keep_groups_whole(spark, texts, law):
    docs = spark.createDataFrame([(k, t, *CLASH_ROW) for k, t in enumerate(texts)], f"doc_id long, text string, {CLASH}")
    rows = sharding.shard_documents(docs, law=law).collect()
    assert sorted(r["id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        encoded = (texts[r["id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(encoded) + 1, zlib.crc32(encoded))
    check_slots(rows)
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"] if law == "bytes" else 1
    assert set(load) == set(range(16))
    assert max(load.values()) - min(load.values()) <= (500 if law == "bytes" else 1)
    groups, cut = groups_cut(rows, dict(enumerate(texts)))
    assert len(groups) > 150 and not cut


def test_shards_agree_on_reruns_and_other_partitions(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = sharding.shard_documents(docs.coalesce(1)).collect()
    assert sorted(one) == sorted(sharding.shard_documents(docs.repartition(7)).collect())


def test_shards_of_a_group_larger_than_a_shard(spark):
    texts = ["the same text"] * 400 + [f"own text {k}" for k in range(500)] + [f"pair {k // 2}" for k in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_documents(docs, shards=10, law="rows").collect()
    load = Counter(r["shard"] for r in rows)
    assert set(load.values()) == {100}
    assert len({r["shard"] for r in rows if r["id"] < 400}) <= 6  # four at the least
    _, cut = groups_cut(rows, dict(enumerate(texts)))
    assert cut == ["the same text"]


def test_shards_of_a_graph_cut_few_links(spark):
    """Edges inside planted groups, and a few between them."""
    draw = random.Random(5)
    edges = {(a, b) for k in range(40) for a in range(k * 20, k * 20 + 20) for b in draw.sample(range(k * 20, k * 20 + 20), 6) if a < b}
    edges |= {tuple(sorted(draw.sample(range(800), 2))) for _ in range(100)}
    nodes = spark.createDataFrame([(k, 1 + k % 3) for k in range(1000)], "node long, size long")
    links = spark.createDataFrame([(n, f"{e}") for e in edges for n in e] + [(None, "z"), (5, None), (7777, "gone"), (3, "gone")], "node long, hub string")
    found = sharding.balanced_shards(nodes, links, 8)
    report = sharding.cut_links(found.select("node", "shard"), links).first()
    assert report["hubs"] == len(edges) and report["cut_hubs"] < 0.5 * len(edges)  # at random 7 of 8 are cut
    load = Counter()
    for r in found.collect():
        load[r["shard"]] += r["size"]
    assert sum(load.values()) == sum(1 + k % 3 for k in range(1000)) and max(load.values()) - min(load.values()) <= 12


def test_shards_of_awkward_tables(spark, tmp_path):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a"), (None, "a"), (1, "b"), (1, "b"), (1, "c"), (2, None)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=3)
    assert sorted((r["id"] or 0) for r in found.collect()) == [0, 0, 1, 1, 1, 2]
    check_slots(found.collect())
    sharding.write_shards(found.withColumn("text", F.lit("t")), f"{tmp_path}/shards", files=2)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == 6


# spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdé"])
def test_near_words_equal_all_pairs(spark, letters):
    """Small alphabets: words of repeated bigrams, where many ties stand among the rarest."""
    draw = random.Random(len(letters))
    words = {"".join(draw.choices(letters, k=draw.randrange(4, 10))) for _ in range(400)}
    found = {(r[0], r[1]) for r in spelling_variants.near_words(spark.createDataFrame([(w, "x") for w in [*words, "ab", ""]] + [(None, "x")], "word string, part string")).collect()}
    assert found == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_near_words_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "BROADCAST_GRAMS", 0)
    found = spelling_variants.near_words(spark.createDataFrame([("colour",), ("color",), ("colors",)], "word string")).collect()
    assert {tuple(r) for r in found} == {("colour", "color"), ("color", "colour"), ("color", "colors"), ("colors", "color")}


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    return {w: n for w, n in counts.items() if n >= 5}


def test_variants_equal_brute_force(spark):
    draw = random.Random(11)
    stems = ["".join(draw.choices("aeinrstÉÖé", k=draw.randrange(6, 10))) for _ in range(12)]
    rows = []
    for k in range(400):
        said = draw.choices(stems, weights=[2**j for j in range(12)], k=60)
        said = [w[:3] + w[4:] if draw.random() < 0.05 else w + "s" if draw.random() < 0.05 else w for w in said]
        rows.append((k, draw.choice([" ", ", ", "\n", "1"]).join(said)))
    rows += [(None, rows[0][1]), rows[1], rows[1], (1000, None), (1001, ""), (1002, "Q" * 50_000), (1003, "ÀÀÀÀÀÀ " * 30_000)]
    docs = spark.createDataFrame([(*r, *CLASH_ROW) for r in rows], f"doc_id long, text string, {CLASH}")
    counts = words_of(rows)
    found = {r["word"]: r for r in spelling_variants.group_variants(spelling_variants.word_counts(docs)).collect()}
    assert {w: r["n"] for w, r in found.items()} == counts

    def form(word):
        near = sorted((-counts[o], o) for o in counts if one_edit(word, o))
        return near[0][1] if near and counts[near[0][1]] >= 5 * counts[word] else None

    for word, row in found.items():
        root = word
        while form(root):
            root = form(root)
        assert (row["n_near"], row["form"], row["root"]) == (sum(one_edit(word, o) for o in counts), form(word), root)
        assert row["form_n"] == (counts[row["form"]] if row["form"] else None)
    assert sum(r["form"] is not None for r in found.values()) > 5
    gathered = spelling_variants.variant_groups(spark.createDataFrame(list(found.values()))).collect()
    assert all(r["n"] == sum(s["n"] for s in r["spellings"]) for r in gathered)


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants.group_variants(spelling_variants.word_counts(empty)).collect() == []


# conversation repair


def least_repair(turns):
    """(cost, audit, lines) of [(role, text, fault)]: all edits, cheapest first and then by audit, state by state."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(3):
            for q, (cost, audit, lines) in list(states.items()):
                for r, to in after[q].items():
                    if r != "s":
                        new = (cost + 5, audit + "I", (*lines, f"{names[r]}:"))
                        states[to] = min(states.get(to, new), new, key=lambda x: x[:2])
        return states

    states = inserted({"": (0, "", ())})
    for role, text, fault in turns:
        new = {}

        def offer(to, found, new=new):
            new[to] = min(new.get(to, found), found, key=lambda x: x[:2])

        for q, (cost, audit, lines) in states.items():
            offer(q, (cost + 2, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                if role[:1] in after[q]:
                    offer(role[:1], (cost + late, audit + "K", (*lines, f"{role}:{text}")))
                for r, to in after[q].items():
                    if r != "s":
                        offer(to, (cost + late + 1, audit + "R", (*lines, f"{names[r]}:{text}")))
        states = inserted(new)
    return min((states[q] for q in ("", "a") if q in states), key=lambda x: x[:2])


def faulty(rows):
    """Rows (turn, role, text) in order, nulls as blanks, with their first fault."""
    order = sorted(((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text) for turn, role, text in rows))
    seen, out = set(), []
    for _, _, role, text in order:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def symbols_of(turns):
    kinds = {"": repair.SOUND, "truncated": repair.CUT, "blank": repair.BLANK, "duplicate": repair.TWIN}
    return "".join(kinds[fault]["sua".index(role[0]) if role[:1] in ("s", "u", "a") else 3] for role, _, fault in turns)


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_layers_equal_all_edits(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    draw = random.Random(block)
    for size in [*range(9)] * 20 + [40, 90, 150]:
        turns = [(draw.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), f"t{k}", draw.choice(["", "", "", "truncated", "blank", "duplicate"])) for k in range(size)]
        cost, audit, outputs = repair.repair(symbols_of(turns))
        lines = []
        for (role, text, _), made in zip(turns, outputs, strict=True):
            lines += [{"k": f"{role}:{text}", "u": f"user:{text}", "a": f"assistant:{text}", "U": "user:", "A": "assistant:"}[c] for c in made]
        assert (cost, audit, tuple(lines)) == least_repair(turns)


def test_long_conversations_take_time_in_proportion():
    cost, audit, outputs = repair.repair("u" * 20_000)
    assert cost == 10_000 and audit == "KR" * 10_000 and len(outputs) == 20_000


def test_conversations_equal_brute_force(spark):
    draw = random.Random(7)
    said = ["Yes.", "No!", "What?", "cut off", "", " \t\n", None, "Yes. ", "Über: é.", "line\nline."]
    rows = [(conv, draw.choice([None, *range(12)]), draw.choice(["user", "assistant", "system", "tool", None, ""]), draw.choice(said)) for conv in [None, *range(60)] for _ in range(draw.randrange(1, 12))]
    rows += [(900, k, ("user", "assistant")[k % 2], f"turn {k}{'.' * (k % 5 > 0)}") for k in range(3000)]
    rows += [(901, None, "user", "the same.")] * 500
    turns = spark.createDataFrame([(*r, *CLASH_ROW[:5], 4, 5) for r in rows], f"conv_id long, turn long, role string, text string, {CLASH.replace('conv long, ', '')}")
    found = repair.repair_conversations(turns)
    told = {r["conv"]: r for r in found.conversations.collect()}
    digests = {r["conv"]: r["sha256"] for r in repair.turn_digests(found.turns).collect()}
    by_conv = defaultdict(list)
    for conv, *row in rows:
        by_conv[conv].append(row)
    assert set(told) == set(by_conv)
    for conv, own in by_conv.items():
        marked = faulty(own)
        cost, audit, lines = least_repair(marked)
        places = [t for t, _, _ in own if t is not None]
        kinds = Counter(f for _, _, f in marked)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, *_), (b, *_) in pairwise(marked))
        gaps = max(places) - min(places) + 1 - len(set(places)) if places else 0
        r = told[conv]
        names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
        assert tuple(r[c] for c in names) == (gaps, *(kinds[f] for f in names[1:4]), illegal, cost, audit)
        assert digests.get(conv) == (hashlib.sha256("\n".join(lines).encode()).hexdigest() if lines else None)


def test_no_conversations(spark):
    found = repair.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert found.conversations.collect() == [] and repair.turn_digests(found.turns).collect() == []
