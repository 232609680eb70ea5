"""Operator 12, license scans: which licences a text names, and what its licence expressions allow.

Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters. One Aho-Corasick automaton holds notice
phrases and identifier tags, each between spaces, and runs over a text's words joined by single spaces. Behind an identifier
tag the original text is read to its line's end: a shunting-yard parser orders the licence expression (with before and
before or), and evaluating it gives the freedom that the reader has: the best of `or`, the least of `and`; an exception
(`with`) makes a strong copyleft a weak one.

The longest phrase at a word is the notice that stands there ("cc by nc" is not also "cc by"); base phrases count wherever
they stand, inside longer ones too. An expression ends behind a full stop and before the first token that cannot continue it; open parentheses
close at its end; without a first identifier there is none, and the tag gives no label. Labels are families: gpl-2.0-only
and GPL-3.0+ are gpl. Score: 1 - product of (1 - strength) over the labels, a tag counting more than a notice; 0 without any.

NULL and empty texts have no words, labels '' and score 0, NULL first_word and last_word. Rows come back one for one, repeated
rows too; only the text is read, and other columns pass through :func:`scan` unless they have its names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlens.llm.shared import LOWER, chunks, small_batches

#: Fixed by the query's contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices.
NOTICES = {
    "lesser general public license": "lgpl", "library general public license": "lgpl", "affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "isc license": "isc", "zlib license": "zlib", "boost software license": "bsl",
    "apache software license": "apache", "expat license": "mit", "the unlicense": "unlicense", "cc0": "cc0", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "all rights reserved": "reserved",
}
TAGS = ("spdx license identifier", "license expression")
#: What a family allows: 3 any use, 2 own part stays open, 1 whole work stays open, 0 less. Unknown families allow 0.
FREEDOM = {
    **dict.fromkeys("mit apache bsd isc zlib bsl unlicense cc0 cc-by 0bsd python artistic".split(), 3), **dict.fromkeys("lgpl mpl epl cddl cc-by-sa".split(), 2), **dict.fromkeys("gpl agpl".split(), 1),
}
TAG_STRENGTH, NOTICE_STRENGTH = 0.95, 0.7

_TABLE = bytes(c if (48 <= c < 58 or 97 <= c < 123 or c >= 128) else 32 for c in LOWER.tolist())
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+-]+)")
_RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """gpl-2.0-or-later -> gpl, cc-by-nc-4.0 -> cc-by-nc."""
    head, *more = identifier.lower().rstrip("+").split("-")
    for at, part in enumerate(more):
        if not part.isalpha() or part in ("only", "or", "later", "clause", "license"):
            return "-".join([head, *more[:at]])
    return "-".join([head, *more])


def postfix(text: str) -> list[str]:
    """The licence expression with which text begins, in postfix order; empty if there is none."""
    out: list[str] = []
    held: list[str] = []
    wanted, at = True, 0  # wanted: an identifier or an opening parenthesis comes next
    while m := _TOKEN.match(text, at):
        token = m[1]
        word = token.lower()
        if wanted:
            if token == "(":
                held.append(token)
            elif token == ")" or word in _RANK or not any(map(str.isalnum, token)):
                break
            else:
                out.append(token.rstrip(".-"))
                wanted = False
                if token.endswith("."):  # a sentence ends
                    break
        elif token == ")":
            if "(" not in held:
                break
            while (top := held.pop()) != "(":
                out.append(top)
        elif word in _RANK:
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[word]:
                out.append(held.pop())
            held.append(word)
            wanted = True
        else:
            break
        at = m.end()
    if wanted:  # nothing yet, or an operator without its right side: it goes
        while held and held[-1] == "(":
            held.pop()
        if held:
            held.pop()
    out += [t for t in reversed(held) if t != "("]
    return out


def evaluate(code: list[str]) -> tuple[int, list[str], str]:
    """(freedom, families, the expression in lower case with all its parentheses) of a licence expression in postfix order."""
    stack: list[tuple[int, str]] = []
    families: list[str] = []
    for at, token in enumerate(code):
        if token not in _RANK:
            if code[at + 1 : at + 2] != ["with"]:  # else it is an exception
                families.append(family(token))
            stack.append((FREEDOM.get(family(token), 0), token.lower()))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        value = max(a, b) if token == "or" else min(a, b) if token == "and" else 2 if a == 1 else a
        stack.append((value, f"({left} {token} {right})"))
    value, whole = stack[0]
    return value, families, whole


class Scanner:
    """The automaton and what a match means."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        for phrase in (*BASE, *NOTICES, *TAGS):
            self.automaton.add_word(f" {phrase} ", (phrase, len(phrase.split())))
        self.automaton.make_automaton()

    def places(self, words: bytes) -> Iterator[tuple[str, int, int]]:
        """(phrase, first word, words) of all matches in words, which are joined, led and followed by single spaces."""
        at = n = 0
        for end, (phrase, k) in self.automaton.iter(words.decode("latin-1")):
            n += words.count(b" ", at, end)
            at = end
            yield phrase, n - k, k

    def text(self, raw: bytes) -> dict:
        words = raw.translate(_TABLE).split()
        base: list[tuple[int, str]] = []
        notices: dict[int, tuple[int, str]] = {}
        tags: list[int] = []
        for phrase, word, k in self.places(b" %s " % b" ".join(words)) if words else ():
            if phrase in BASE:
                base.append((word, BASE[phrase]))
            if phrase in TAGS:
                tags.append(word + k)
            elif k > notices.get(word, (0, ""))[0]:
                notices[word] = (k, BASE.get(phrase) or NOTICES[phrase])
        strength = {label: NOTICE_STRENGTH for _, label in (*notices.values(), *((0, b) for _, b in base))}
        free = [FREEDOM.get(label, 0) for _, label in notices.values()]
        expressions = []
        for code in self.expressions(raw, tags):
            value, families, whole = evaluate(code)
            free.append(value)
            expressions.append(whole)
            strength |= dict.fromkeys(families, TAG_STRENGTH)
        miss = 1.0
        for label in sorted(strength):
            miss *= 1 - strength[label]
        spans = [{"word": w, "words": k, "label": label} for w, (k, label) in sorted(notices.items())]
        return {
            "n_words": len(words), "n_base": len(base), "first_word": min(w for w, _ in base) if base else None, "last_word": max(w for w, _ in base) if base else None,
            "base_labels": ",".join(sorted({b for _, b in base})), "labels": ",".join(sorted(strength)), "score": 1 - miss, "freedom": min(free, default=None), "expressions": expressions, "spans": spans,
        }

    def expressions(self, raw: bytes, ends: list[int]) -> Iterator[list[str]]:
        """Expressions behind tags; ends: for each tag in order the number of words up to its end."""
        if not ends:
            return
        wanted, n = set(ends), 0
        for m in re.finditer(rb"[^ ]+", raw.translate(_TABLE)):
            n += 1
            if n not in wanted:
                continue
            line = raw[m.end() : (raw.find(b"\n", m.end()) + 1 or len(raw) + 1) - 1].decode("utf-8", "replace").replace("\r", "")
            if (mark := re.match(r"[ \t]*:", line)) and (code := postfix(line[mark.end() :])):
                yield code


RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom int, expressions array<string>, spans array<struct<word: long, words: int, label: string>>"
)
_ARROW = pa.struct(
    [*((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("freedom", pa.int32()),
     ("expressions", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int32()), ("label", pa.string())])))]
)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, freedom, expressions (lower case,
    parentheses written out) and spans (each notice's first word, number of words and label)."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        scanner, out = Scanner(), []
        for _, _, data, off in chunks(texts):
            raw, at = data.tobytes(), off.tolist()
            out += [scanner.text(raw[i:j]) for i, j in zip(at, at[1:])]
        return pa.array(out, _ARROW)

    names = [f.name for f in _ARROW]
    rest = [c for c in docs.columns if c.lower() not in names]
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), run(F.col(text)).alias("got"))
    return inner.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], *[F.col(f"got.{c}").alias(c) for c in names])


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).drop("text", "spans")
