"""Toxicity: obfuscated words are restored through a noisy channel, then the restored text is scored."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogmill.llm.common import discard, held_out, map_arrow, settled, ship_package, table
from dialogmill.llm.text_hash import mix, shingle_sets, span_hashes, text_chunks, word_spans

#: Bytes of text that are looked at together.
CHUNK = 1 << 20
#: Rows of a batch that is given on.
ROWS_OUT = 1_000
#: What a sign may stand for, and the log chance of each reading; "" drops the sign.
READINGS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "6": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c"}
READ_COST, DROP_COST, GAP_COST, RUN_COST = -0.7, -6.0, -0.2, -0.5
GAPS = ".-_ ~"
MASKED = "*"  # may also stand for any vowel
MASK_COST = -2.5

#: Symbols of the character model: the word's edge, a-z, and each byte from 0x80 on.
N_SYMBOLS = 155
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = np.arange(27, 155)
_LETTER = _SYMBOL > 0
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in READINGS] + [ord(MASKED)]] = True
_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in "0134578@"]] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in GAPS if c != " "]] = True

#: Restored words of up to so many bytes are kept for the next time.
KEPT_BYTES = 1_000
#: Words set apart are restored window by window: no candidate word of 14 letters lies in none as a whole.
WINDOW, STRIDE = 28, 14

#: A word speaks through itself and through its first bytes.
PREFIXES = (4, 5, 6, 7)


class CharModel:
    """ln chance of a symbol after two others: trigrams, bigrams and single symbols mixed."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        n = np.zeros(N_SYMBOLS**3)
        n[keys] = counts
        n = n.reshape(N_SYMBOLS, N_SYMBOLS, N_SYMBOLS)
        tri = n / np.maximum(n.sum(axis=2, keepdims=True), 1)
        two = n.sum(axis=0)
        bi = two / np.maximum(two.sum(axis=1, keepdims=True), 1)
        one = (two.sum(axis=0) + 1) / (two.sum() + N_SYMBOLS)
        self.log = np.log(0.7 * tri + 0.2 * bi[None] + 0.1 * one[None, None]).astype(np.float32)


def symbol_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n) of all symbol trigrams of all texts, counted in each task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_SYMBOLS**3, np.int64)
        for batch in batches:
            for _, raw, off in text_chunks(pc.utf8_lower(batch.column(0)), CHUNK):
                edged = np.zeros(len(raw) + len(off) + 1, np.int32)  # an edge before each row and two after the last
                edged[np.arange(len(raw)) + np.repeat(np.arange(1, len(off)), np.diff(off))] = _SYMBOL[raw]
                key = (edged[:-2] * N_SYMBOLS + edged[1:-1]) * N_SYMBOLS + edged[2:]
                keys, n = np.unique(key[(edged[1:-1] > 0) | (edged[2:] > 0)], return_counts=True)
                total[keys] += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["key", "n"])

    return map_arrow(docs.where(F.col(text_col).isNotNull()).select(text_col), count, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))


def learn_chars(docs: DataFrame, text_col: str = "text") -> CharModel:
    """At most N_SYMBOLS ** 3 numbers come to the driver, whatever the corpus holds."""
    found = symbol_counts(docs, text_col).toArrow()
    return CharModel(found["key"].to_numpy(), found["n"].to_numpy())


def _choices(char: bytes, run: int) -> list[tuple[bytes, float]]:
    sign = char.decode("latin-1")
    if _LETTER[char[0]]:
        return [(char, 0.0)] if run == 1 else [(char * 2, 0.0), (char, RUN_COST * 10)] if run == 2 else [(char, RUN_COST), (char * 2, RUN_COST)]
    out = [(letter.encode(), READ_COST) for letter in READINGS.get(sign, "")]
    if sign == MASKED:
        out += [(letter.encode(), MASK_COST) for letter in "aeiou"]
    if run == 2:
        out += [(said * 2, cost) for said, cost in out]
    return [*out, (b"", GAP_COST if sign in GAPS else DROP_COST)]


@functools.lru_cache(maxsize=4096)
def _steps(char: bytes, run: int) -> list[tuple[bytes, float, list[int]]]:
    return [(said, cost, [int(_SYMBOL[s]) for s in said]) for said, cost in _choices(char, run)]


def _plain_until(token: bytes) -> list[int]:
    """For each place the end of the stretch of letters from there on that say themselves."""
    raw = np.frombuffer(token, np.uint8)
    again = np.concatenate([[False], (raw[1:] == raw[:-1]) & (raw[1:] < 128), [False]])
    stops = np.flatnonzero(np.append(~(_LETTER[raw] & ~again[:-1] & ~again[1:]), True))
    return stops[np.searchsorted(stops, np.arange(len(raw)))].tolist()


def restore(token: bytes, model: CharModel, keep: int = 1) -> list[bytes]:
    """The likeliest readings of a lower-case token of any length (Viterbi over the last two symbols, ``keep`` paths to each pair), best first.

    A path is a chain of (what its last characters say, the path before), so that a step costs the same however long the token. Once all paths end
    in one pair, a stretch of letters that say themselves is one step: it adds the same to each.
    """
    if keep == 1:
        return [_best_reading(token, model)]
    n, log, best = N_SYMBOLS, memoryview(model.log.reshape(-1)), {(0, 0): [(0.0, None)]}
    at, until = 0, _plain_until(token)
    while at < len(token):
        stretch = until[at]
        if len(best) == 1 and stretch - at > 1:
            [paths] = best.values()
            said = token[at:stretch]
            best = {(int(_SYMBOL[said[-2]]), int(_SYMBOL[said[-1]])): [(score, (said, path)) for score, path in paths]}
            at = stretch
            continue
        run = 1
        while at + run < len(token) and token[at + run] == token[at] and token[at] < 128:
            run += 1
        after: dict[tuple[int, int], list] = {}
        for said, cost, symbols in _steps(token[at : at + 1], min(run, 3)):
            for (a, b), paths in best.items():
                gain, x, y = cost, a, b
                for z in symbols:
                    gain += log[(x * n + y) * n + z]
                    x, y = y, z
                if (x, y) in after:
                    after[x, y] += [(score + gain, (said, path)) for score, path in paths]
                else:
                    after[x, y] = [(score + gain, (said, path)) for score, path in paths]
        best = {pair: sorted(paths, key=_score, reverse=True)[:keep] if len(paths) > 1 else paths for pair, paths in after.items()}
        at += run
    ends = sorted(((score + float(model.log[a, b, 0]), path) for (a, b), paths in best.items() for score, path in paths), key=_score, reverse=True)
    return list(dict.fromkeys(_said(path) for _, path in ends))[:keep]


def _best_reading(token: bytes, model: CharModel) -> bytes:
    """``restore`` with one path to each pair, which is a number here."""
    n, square, log, best = N_SYMBOLS, N_SYMBOLS**2, memoryview(model.log.reshape(-1)), {0: (0.0, None)}
    at, until, size = 0, _plain_until(token), len(token)
    while at < size:
        stretch = until[at]
        if len(best) == 1 and stretch - at > 1:
            [(score, path)] = best.values()
            best = {int(_SYMBOL[token[stretch - 2]]) * n + int(_SYMBOL[token[stretch - 1]]): (score, (token[at:stretch], path))}
            at = stretch
            continue
        run = 1
        while at + run < size and token[at + run] == token[at] and token[at] < 128:
            run += 1
        after: dict[int, tuple] = {}
        for said, cost, symbols in _steps(token[at : at + 1], min(run, 3)):
            for pair, (score, path) in best.items():
                gain = cost
                for z in symbols:
                    pair = pair * n + z
                    gain += log[pair]
                    pair %= square
                score += gain
                known = after.get(pair)
                if known is None or score > known[0]:
                    after[pair] = (score, (said, path))
        best = after
        at += run
    return _said(max(((score + log[pair * n], path) for pair, (score, path) in best.items()), key=_score)[1])


def _score(path: tuple) -> float:
    return path[0]


def _said(path: tuple | None) -> bytes:
    parts = []
    while path is not None:
        parts.append(path[0])
        path = path[1]
    return b"".join(reversed(parts))


def disguised(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, bound: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans that may hide a word: signs before or inside letters, letters thrice, letters set apart by gaps or spaces.

    Each holds a letter, and words may be of any length; letters set apart are cut into windows that overlap.
    """
    if not len(begin):
        return []
    letter, sign, gap = _LETTER[raw], _SIGN[raw], _GAP[raw]
    hint = np.zeros(len(raw), bool)
    hint[:-1] |= sign[:-1] & letter[1:]
    last = np.zeros(len(raw), bool)
    last[end] = True
    hint[1:] |= _TAIL[raw[1:]] & letter[:-1] & last[1:]
    hint[:-2] |= letter[:-2] & (raw[:-2] == raw[1:-1]) & (raw[1:-1] == raw[2:]) & (raw[:-2] < 128)
    hint[:-4] |= letter[:-4] & gap[1:-3] & letter[2:-2] & gap[3:-1] & letter[4:]
    seen = np.concatenate([[0], np.cumsum(hint)])
    has_letter = np.concatenate([[0], np.cumsum(letter)])
    marked = (seen[end + 1] > seen[begin]) & (has_letter[end + 1] > has_letter[begin])
    size = end - begin + 1
    lead = raw[begin]
    single = (size == 1) & (letter[begin] | sign[begin]) | (size == 2) & (lead >= 0xC0) | (size == 3) & (lead >= 0xE0)
    spans = [(int(begin[k]), int(end[k]) + 1) for k in np.flatnonzero(marked & ~single)]
    edge = np.zeros(len(begin) + 1, bool)
    edge[bound] = True
    starts = np.flatnonzero(single & ~(np.concatenate([[False], single[:-1]]) & ~edge[:-1]))
    stops = np.flatnonzero(single & ~(np.concatenate([single[1:], [False]]) & ~edge[1:]))
    for a, b in zip(starts, stops, strict=True):
        if b - a >= 2:
            windows = [(k, min(k + WINDOW - 1, b)) for k in range(a, max(a, b - WINDOW + STRIDE) + 1, STRIDE)]
            spans += [(int(begin[k]), int(end[to]) + 1) for k, to in windows if has_letter[end[to] + 1] > has_letter[begin[k]]]
    return sorted(spans)


class Reader:
    """Turns texts into words and, for hidden words, into their restored forms; keeps what it has restored before."""

    def __init__(self, model: CharModel, limit: int = 50_000):
        self.model, self.limit, self.known = model, limit, {}

    def restored(self, token: bytes) -> list[bytes]:
        """The best reading; of a token with masked letters, five."""
        keep = 5 if b"*" in token else 1
        if len(token) > KEPT_BYTES:
            return restore(token, self.model, keep)
        if token not in self.known:
            if len(self.known) >= self.limit:
                self.known.clear()
            self.known[token] = restore(token, self.model, keep)
        return self.known[token]

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, rows, row of each word, keys of each word [word, 1 + PREFIXES], identity of each word); restored words stand beside plain ones."""
        for row, raw, off in text_chunks(pc.utf8_lower(texts), CHUNK):
            begin, end = word_spans(raw, off)
            spans = disguised(raw, begin, end, np.searchsorted(begin, off))
            words = []
            for a, b in spans:
                token = raw[a:b].tobytes()
                words += [(np.searchsorted(off, a, "right") - 1, word, b" " in token) for word in self.restored(token.rstrip(b".,!?;:"))]
            more, owner = [], []
            for at, word, spaced in words:
                for start in range(len(word) if spaced else 1):  # set apart, words run together
                    for size in range(4, min(14, len(word) - start) + 1) if spaced else [len(word)]:
                        more.append(word[start : start + size])
                        owner.append(at)
            plain = np.where(_LETTER[raw], raw, 32).astype(np.uint8)
            first, last = word_spans(plain, off)
            extra = np.frombuffer(b" ".join([*more, b""]), np.uint8)
            size = np.array([len(w) for w in more], np.int64)
            place = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if len(more) else np.zeros(0, np.int64)
            place, owner = place[size > 0], np.array(owner, np.int64)[size > 0]
            k1, k2 = _keys(plain, first, last), _keys(extra, place, place + size[size > 0] - 1)
            rows = np.concatenate([np.searchsorted(off, first, "right") - 1, owner])
            yield row, len(off) - 1, rows, np.concatenate([k1, k2])


def _keys(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the whole word and of its prefixes; 0 where it is shorter."""
    out = np.zeros((len(first), 1 + len(PREFIXES)), np.uint64)
    if len(first):
        out[:, 0] = span_hashes(raw, first, last)
        for k, size in enumerate(PREFIXES):
            fits = last - first + 1 > size
            out[fits, k + 1] = mix(span_hashes(raw, first[fits], first[fits] + size - 1) ^ np.uint64(size))
    return out


@dataclass(frozen=True)
class ToxicModel:
    chars: CharModel
    keys: np.ndarray  # sorted
    weights: np.ndarray
    prior: float

    def scores(self, n_rows: int, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Chance of label 1: the evidence of each row's distinct words is added to the prior log odds."""
        total = np.full(n_rows, self.prior)
        if len(self.keys) and len(keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            weight = np.where(self.keys[place] == keys, self.weights[place], 0.0).max(axis=1)
            hit = np.flatnonzero(weight > 0)
            _, one = np.unique(np.stack([rows[hit].astype(np.uint64), keys[hit, 0]]), axis=1, return_index=True)
            np.add.at(total, rows[hit][one], weight[hit][one])
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


#: Least shingle hashes of a labelled text, each under another mix; texts that share one are of one family.
SKETCHES = 8


def _family_weights(sample: DataFrame) -> DataFrame:
    """(__row, __weight): 1 over the number of labelled rows whose texts are near copies of one another, so that each family counts once.

    The sample is bounded, and so is what comes to the driver: SKETCHES numbers for each of its rows.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64))
        for batch in batches:
            rows, least = [], []
            for k, shingles in shingle_sets(batch.column(1), 5):
                rows.append(batch.column(0)[k].as_py())
                least.append([int(mix(shingles ^ salt).min()) if len(shingles) else 0 for salt in salts])
            numbers = np.array(least, np.uint64).reshape(-1, SKETCHES).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *(pa.array(numbers[:, k]) for k in range(SKETCHES))], ["__row", *(f"s{k}" for k in range(SKETCHES))])

    found = map_arrow(sample.select("__row", "__text"), sketch, "__row long, " + ", ".join(f"s{k} long" for k in range(SKETCHES))).toPandas()
    root = np.arange(len(found))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for column in found.columns:  # the row's own hash first: equal texts
        first: dict[int, int] = {}
        for k, value in enumerate(found[column]):
            root[find(k)] = find(first.setdefault(value, k))
    family = np.array([find(k) for k in range(len(root))], np.int64)
    weight = 1.0 / np.bincount(family, minlength=1)[family] if len(family) else np.zeros(0)
    rows = pd.DataFrame({"__row": found["__row"].astype("int64"), "__weight": weight}).drop_duplicates("__row")
    return sample.sparkSession.createDataFrame(pa.Table.from_pandas(rows, schema=pa.schema([("__row", pa.int64()), ("__weight", pa.float64())]), preserve_index=False))


def _evidence(sample: DataFrame, chars: CharModel, known: np.ndarray | None = None) -> DataFrame:
    """(key, pos, neg): weights of the labelled texts that hold each word, summed in each task first; (0, ...) sums all.

    With the keys of ``known`` words: those that hold each prefix, other than in a known word, so that a prefix doesn't speak for one word alone.
    """
    shared = sample.sparkSession.sparkContext.broadcast((chars, known))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_chars, words = shared.value
        reader, seen = Reader(own_chars), []
        n = np.zeros(2)
        for batch in batches:
            label, weight = np.asarray(batch.column(1).to_pylist(), np.int64), batch.column(2).to_numpy()
            n += np.bincount(label, weight, minlength=2)
            for row, _, rows, keys in reader.chunks(batch.column(0)):
                if words is None:
                    keys = keys[:, :1]
                else:
                    other = ~np.isin(keys[:, 0], words)
                    rows, keys = rows[other], keys[other, 1:]
                pair = np.stack([np.repeat(rows, keys.shape[1]).astype(np.uint64), keys.ravel()], axis=1)
                pair = np.unique(pair[pair[:, 1] > 0], axis=0)
                at = row + pair[:, 0].astype(np.int64)
                seen.append((pair[:, 1], np.where(label[at] == 1, weight[at], 0.0), np.where(label[at] == 0, weight[at], 0.0)))
        both = [np.concatenate(x) for x in zip(*seen, strict=True)] if seen else [np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)]
        keys, which = np.unique(both[0], return_inverse=True)
        pos, neg = (np.bincount(which, x, len(keys)) for x in both[1:])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, np.uint64(0)).view(np.int64)), pa.array(np.append(pos, n[1])), pa.array(np.append(neg, n[0]))], ["key", "pos", "neg"])

    return map_arrow(sample, count, "key long, pos double, neg double").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000, min_llr: float = 8.0, min_texts: float = 4.0, z: float = 1.5) -> ToxicModel:
    """Fits on all texts (characters) and on at most ``max_labelled`` labelled rows (words), first by hash of their id.

    Near copies among the labelled texts count as one text, each by its share, so that copies of one document make no rule. A word or
    prefix counts if it is commoner in label 1 with a log likelihood ratio of at least ``min_llr`` and
    stands in at least ``min_texts`` texts of label 1; its weight is its log odds ratio less ``z`` deviations, if above 2.2; the
    sample's size bounds how many there are. Null labels, ids and texts teach nothing; of contradicting labels of an id,
    1 holds. Without labels every score is that of the prior, 0.05.
    """
    chars = learn_chars(docs, text_col)
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    )
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    labelled = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("__text", "__label", F.xxhash64("__text").alias("__row"))
    labelled = settled(labelled, "labelled")
    sample = labelled.join(F.broadcast(_family_weights(labelled)), "__row").select("__text", "__label", "__weight")

    def learnt(evidence: DataFrame, name: str) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Keys and weights of what speaks for label 1, and the weights of all texts of either label."""
        evidence = settled(evidence, name)
        total = evidence.where("key = 0").first()
        n_pos, n_neg = (total["pos"], total["neg"]) if total else (0.0, 0.0)
        pos, neg = F.col("pos"), F.col("neg")
        ratio = F.log((pos + 0.5) / (n_pos + 1.0)) - F.log((neg + 0.5) / (n_neg + 1.0))
        bound = ratio - z * F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        n, base = pos + neg, n_pos / max(n_pos + n_neg, 1)
        part = lambda k, p: F.when(k > 0, k * F.log(k / n / p)).otherwise(0.0)
        llr = part(pos, max(base, 1e-9)) + part(neg, max(1 - base, 1e-9))
        top = evidence.where("key <> 0").where((pos >= min_texts) & (llr >= min_llr)).select("key", bound.alias("weight")).where("weight > 2.2").toArrow()
        discard(evidence)
        return top["key"].to_numpy().view(np.uint64), top["weight"].to_numpy(), n_pos, n_neg

    words, word_weights, n_pos, n_neg = learnt(_evidence(sample, chars), "evidence")
    prefixes, prefix_weights, _, _ = learnt(_evidence(sample, chars, words), "prefix-evidence")
    discard(labelled)
    keys, weights = np.concatenate([words, prefixes]), np.concatenate([word_weights, prefix_weights])
    order = np.argsort(keys)
    prior = np.log((n_pos + 0.5) / (n_neg + 9.5)) if n_pos + n_neg else np.log(0.05 / 0.95)
    return ToxicModel(chars, keys[order], weights[order], float(min(prior, np.log(0.2 / 0.8))))


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, whole texts; null and empty texts get the prior. Null ids and repeated rows stay rows of their own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = Reader(own.chars)
        for batch in batches:
            out = np.full(len(batch), 1 / (1 + np.exp(-own.prior)))
            for row, n_rows, rows, keys in reader.chunks(batch.column(1)):
                out[row : row + n_rows] = own.scores(n_rows, rows, keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], [id_col, "score"])

    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])
    return map_arrow(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")), score, schema)


def deobfuscate(docs: DataFrame, chars: CharModel, text_col: str = "text", out: str = "restored") -> DataFrame:
    """All rows and columns with ``out``: the text with hidden words restored (in lower case), the rest as it is; null stays null.

    Texts without hidden words, empty ones included, stay as they are; ``out`` replaces a column of that name. An empty table gives an empty table.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chars)

    @F.pandas_udf("string")
    def clear(texts: pd.Series) -> pd.Series:
        reader, result = Reader(shared.value), []
        for text in texts:
            if text is None:
                result.append(None)
                continue
            raw = np.frombuffer(text.encode(), np.uint8)
            low = np.frombuffer(bytes(raw).lower(), np.uint8)
            off = np.array([0, len(raw)])
            begin, end = word_spans(low, off)
            parts, at = [], 0
            for a, b in disguised(low, begin, end, np.searchsorted(begin, off)):
                parts += [bytes(raw[at:a]), reader.restored(bytes(low[a:b]))[0]]
                at = b
            result.append(b"".join([*parts, bytes(raw[at:])]).decode(errors="replace"))
        return pd.Series(result, dtype=object)

    return docs.withColumn(out, clear(F.col(text_col)))


def drop_toxic(docs: DataFrame, model: ToxicModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that score below ``threshold``, all columns as they are, row by row and without a shuffle.

    Null and empty texts score the prior and so stay. Null ids and repeated rows are judged alike by their text. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, docs.columns.index(text_col)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = shared.value
        reader = Reader(own.chars)
        for batch in batches:
            clean = np.full(len(batch), 1 / (1 + np.exp(-own.prior)) < threshold)
            for row, n_rows, rows, keys in reader.chunks(pc.fill_null(batch.column(at), "")):
                clean[row : row + n_rows] = own.scores(n_rows, rows, keys) < threshold
            for start in range(0, len(batch), ROWS_OUT):
                yield batch.slice(start, ROWS_OUT).filter(pa.array(clean[start : start + ROWS_OUT]))

    return map_arrow(docs, keep, docs.schema)


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where(~held_out(F.col(id_col)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_toxicity(docs, learnable(table(spark, sf_dir, "labels")))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
