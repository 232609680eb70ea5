"""Operator 1, toxicity through a noisy channel.

The channel writes a word with look-alike signs, with separators between its letters, or with letters repeated. Spans that
it may have written become character lattices, and a Viterbi search restores the likeliest letters under a character
trigram model, whose counts cover every document. Restored texts are then scored by logistic regression on words and word
beginnings, learnt from a bounded sample of labelled rows (``max_rows``).

A span without signs, separators or repeats has a lattice with one path, so plain words need no search. Spans repeat, so
decodings are cached.

NULL and empty texts have no features and score as the bias alone. Rows without labels, or labelled twice, are handled as
in :mod:`motorlens.llm.ftrl`. Only doc_id and text are read; other columns pass through :func:`score` unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.llm import ftrl
from motorlens.llm.shared import chunks, crc_remainder, hashes, segments, small_batches

BITS, MAX_ROWS, THRESHOLD = 20, 12_000, 0.7

# ---------------------------------------------------------------- character model

#: Symbols of the model: 0 white space or text end, 1..26 letters, 27 characters beyond ASCII, 28 other ASCII.
SYMBOLS = 29
_CLASS = np.full(256, 28, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol triples over all texts; at most 29**3 rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for _, _, data, off in chunks(b.column(0)):
                keep = (data & 0xC0) != 0x80
                text = np.zeros(off[-1] + 2 * len(off), np.int64)  # two spaces after each text
                text[np.arange(len(data)) + 2 * np.repeat(np.arange(len(off) - 1), np.diff(off))] = _CLASS[data]
                lead = np.ones(len(text), bool)
                lead[(np.arange(len(data)) + 2 * np.repeat(np.arange(len(off) - 1), np.diff(off)))[~keep]] = False
                text = text[lead]
                total += np.bincount(text[:-2] * SYMBOLS**2 + text[1:-1] * SYMBOLS + text[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    out = np.zeros(SYMBOLS**3, np.int64)
    for r in docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), interpolated with the shorter contexts; [a, b, c]."""
    n3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 0.5) / (n1.sum() + 0.5 * SYMBOLS)
    p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
    return -np.log((n3 + 5 * p2[None]) / (n3.sum(2, keepdims=True) + 5))


# ---------------------------------------------------------------- lattices

#: What signs may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "^": "a", "%": "x", "#": "h",
}
PAIRS = {"()": "o", "|)": "d", "|<": "k", "\\/": "v", "/\\": "a", "|_|": "u", "|-|": "h", "vv": "w"}
SEPARATORS = " .-_*~'`,/\\:;"
#: Costs (-log probability) of a look-alike, a dropped separator, a repeat collapsed from three or more, or from two.
LOOK_COST, DROP_COST, REPEAT_COST, DOUBLE_COST = 1.5, 0.7, 1.0, 4.0
_CODE = {chr(96 + i): i for i in range(1, 27)}


def edges(span: str, i: int, run: int) -> list[tuple[int, str, float]]:
    """(next position, written letters, channel cost) of the lattice's edges at i, where one sign stands run times."""
    c, n = span[i], len(span)
    out = [(i + 1, c, 0.0)]
    letters = [c] if c in _CODE else list(LOOKS.get(c, ""))
    for x in letters:
        cost = 0.0 if c in _CODE else LOOK_COST
        if c not in _CODE:
            out.append((i + 1, x, cost))
        if run > 1:
            out += [(i + k, x, cost + (REPEAT_COST if run > 2 else DOUBLE_COST)) for k in {run, run - 1} if k > 1]
    for signs, x in PAIRS.items():
        if span.startswith(signs, i):
            out.append((i + len(signs), x, LOOK_COST))
    if c in SEPARATORS and 0 < i < n - 1:
        out.append((i + run, "", DROP_COST))
    return out


def decode(span: str, costs: np.ndarray) -> str:
    """The cheapest reading of a lower-case span: channel and character model together."""
    n = len(span)
    runs = [1] * n
    for i in range(n - 2, -1, -1):
        if span[i] == span[i + 1]:
            runs[i] = runs[i + 1] + 1
    best: list[dict[tuple[int, int], tuple[float, tuple | None]]] = [{} for _ in range(n + 1)]
    best[0][0, 0] = (0.0, None)
    for i in range(n):
        if not best[i]:
            continue
        steps = edges(span, i, runs[i])
        for state, (cost, back) in best[i].items():
            for j, x, channel in steps:
                if x:
                    code = _CODE.get(x) or (0 if x.isspace() else 27 if ord(x) > 127 else 28)
                    new, total, trail = (state[1], code), cost + channel + costs[state[0], state[1], code], (x, back)
                else:
                    new, total, trail = state, cost + channel, back
                old = best[j].get(new)
                if old is None or total < old[0]:
                    best[j][new] = (total, trail)
        best[i] = {}
    _, trail = min(((cost + costs[s[0], s[1], 0], trail) for s, (cost, trail) in best[n].items()), key=lambda v: v[0])
    out = []
    while trail is not None:
        out.append(trail[0])
        trail = trail[1]
    return "".join(reversed(out))


#: A span that the channel may have written, from the signs of the lattice itself: letters one by one with separators
#: (three at least), a word with a sign or a form of several signs in it, or a word with a letter doubled. The lattice
#: decides what of it is plain text. A sign that ends a word counts if it is not one that plain text ends with.
_FORMS = "|".join(re.escape(p) for p in PAIRS if not p.isalpha())
_SIGN = "[" + re.escape("".join(LOOKS)) + "]"
_ONE = "[a-z" + re.escape("".join(LOOKS)) + "]"
_UNIT = f"(?>{_FORMS}|{_ONE})"
_GAP = "[" + re.escape(SEPARATORS) + "]{1,2}"
_LAST = "[a-z" + re.escape("".join(c for c in LOOKS if c not in "!|+(<^")) + "]"
SUSPECT = re.compile(
    rf"(?<![^\s\"'(\[]){_UNIT}(?:{_GAP}{_UNIT}){{2,}}+{_UNIT}*+(?![^\s\"'.,;:!?)\]])"
    rf"|(?<!{_ONE})(?=[a-z]*(?:{_FORMS}|{_SIGN}))(?=(?:{_FORMS}|{_SIGN})*[a-z]|(?:{_SIGN}*(?:{_FORMS}))){_UNIT}*(?:{_FORMS}|{_LAST})"
    r"|(?<![a-z])[a-z]*([a-z])\1[a-z]*",
)


class Restorer:
    """Restores texts; keeps the readings of short spans it has met."""

    LIMIT, KEPT = 50_000, 64

    def __init__(self, costs: np.ndarray):
        self.costs, self.seen = costs, {}

    def read(self, span: str) -> str:
        if (out := self.seen.get(span)) is None:
            out = decode(span, self.costs)
            if len(span) > self.KEPT:
                return out
            if len(self.seen) > self.LIMIT:
                self.seen.clear()
            self.seen[span] = out
        return out

    def text(self, text: str) -> str:
        return SUSPECT.sub(lambda m: self.read(m.group()), text.lower())

    def chunk(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the restored texts, in lower case. Every text is looked at."""
        if not len(data):
            return data, off
        raw, at = data.tobytes(), off.tolist()
        parts = [self.text(raw[i:j].decode()).encode() for i, j in zip(at, at[1:])]
        new_off = np.zeros(len(off), np.int64)
        np.cumsum([len(x) for x in parts], out=new_off[1:])
        return np.frombuffer(b"".join(parts), np.uint8), new_off


# ---------------------------------------------------------------- scores

#: Bytes of words: ASCII letters and all bytes of other characters.
_WORD = np.zeros(256, np.uint8)
_WORD[97:123] = _WORD[65:91] = 1
_WORD[128:] = 1
BEGINNINGS = (4, 5, 6)


def word_features(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Presence of words and of their first 4, 5 and 6 bytes."""
    starts, ends, first = segments(data, off, _WORD)
    doc, shift = np.repeat(np.arange(len(off) - 1), np.diff(first)), np.uint64(64 - bits)
    keys, docs = [hashes(data, starts, ends, lower=True)], [doc]
    for k in BEGINNINGS:
        long = ends - starts >= k
        with np.errstate(over="ignore"):
            keys.append(hashes(data, starts[long], starts[long] + k, lower=True) * np.uint64(0xD6E8FEB86659FD93 + 2 * k))
        docs.append(doc[long])
    ptr, at, n = ftrl.by_document(np.concatenate(docs), np.concatenate(keys) >> shift, len(off) - 1, bits)
    return ptr, at, np.ones(len(n))


def features(costs: np.ndarray) -> ftrl.Features:
    """word_features of restored texts."""
    restorer = Restorer(costs)
    return lambda data, off: word_features(*restorer.chunk(data, off))


def train(docs: DataFrame, labels: DataFrame, costs: np.ndarray, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights learnt from labels.toxic of rows whose crc32 remainder by 3 is not 1."""
    ids = ftrl.training_ids(labels, "toxic", 3, 1, max_rows)
    return ftrl.fit(docs, ids, features(costs), BITS, epochs=5, alpha=0.5, l1=1.0, l2=0.05)


def score(docs: DataFrame, w: np.ndarray, costs: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    return docs.withColumn(out, ftrl.scorer(docs.sparkSession, w, features(costs))(F.col(text)))


def restore(docs: DataFrame, costs: np.ndarray, text: str = "text", out: str = "restored") -> DataFrame:
    """docs with the restored text, in lower case; NULL becomes empty."""
    restorer = Restorer(costs)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        done = []
        for _, _, data, off in chunks(texts):
            new, at = restorer.chunk(data, off)
            raw = new.tobytes()
            done += [raw[i:j].decode() for i, j in zip(at, at[1:])]
        return pa.array(done, pa.string())

    return docs.withColumn(out, run(F.col(text)))


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. A NULL doc_id is held out."""
    small_batches(spark)
    costs = trigram_costs(trigram_counts(docs))
    scored = score(docs.select("doc_id", "text"), train(docs, labels, costs), costs)
    return scored.select("doc_id", F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

