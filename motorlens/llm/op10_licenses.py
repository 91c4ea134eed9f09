"""Licence scan: Aho-Corasick for identifier tags and notice phrases, shunting-yard for licence expressions.

Two automata read each whole text once: one the words (lower-cased, joined by blanks) for notices, one
the lower-cased text for tags such as ``SPDX-License-Identifier:``. From the end of a tag an expression of
identifiers, ``and``, ``or``, ``with`` and brackets is read as far as it can go on: it ends at the end of
the line, at the first token that can't stand there, and before an operator that no identifier follows, so
prose behind it is never read as a licence. Each byte of a text belongs to one expression at most.

``score`` says how freely the text may be used: each licence has a degree from 0 (reserved) to 1
(permissive); ``or`` takes the larger, ``and`` the smaller, ``with`` an exception half the way to 1. The
text's score is the smallest of its statements; 0.5 without any.

Defined results: a null or empty text has no words, no labels and score 0.5; an expression whose brackets
don't close gives the identifiers in it, all required; a tag without an identifier gives nothing; repeated rows
are scanned each; an empty table gives no rows; extra columns are ignored. A very long text is held as
bytes, a few times over, and matched in spans of ``SPAN`` bytes.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op8_toxicity import _bytes
from .store import small_batches, table
from .tokens import chunks

# The base phrases and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices beyond the base phrases.
NOTICES = {
    "mit license": "mit", "apache license": "apache", "bsd license": "bsd", "isc license": "isc",
    "mozilla public license": "mpl", "eclipse public license": "epl", "lesser general public license": "lgpl",
    "affero general public license": "agpl", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd",
    "creative commons": "cc", "cc0": "cc0", "public domain": "public-domain", "boost software license": "boost",
    "proprietary and confidential": "reserved",
}
TAGS = ("spdx-license-identifier:", "license-expression:", "spdx-license-expression:")
#: How freely a licence's texts may be used.
DEGREES = {"reserved": 0.0, "cc-by-nc": 0.2, "cc-by-nd": 0.3, "agpl": 0.3, "gpl": 0.4, "lgpl": 0.6, "mpl": 0.7, "epl": 0.7, "cc-by-sa": 0.7, "cc": 0.7, "cc-by": 0.9, "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "boost": 1.0, "cc0": 1.0, "public-domain": 1.0}
_OTHER = 0.5
_FAMILIES = sorted((x for x in DEGREES if x != "reserved"), key=len, reverse=True)
_BINDING = {"or": 1, "and": 2, "with": 3}
#: Blanks of a line, then a bracket or a word (which doesn't end with a full stop: that ends a sentence).
_TOKEN = re.compile(rb"[ \t]*([()]|[a-z0-9](?:[a-z0-9.+:-]*[a-z0-9+])?)")
#: Identifiers of licences without a degree: a name with a version, an own reference, or one of the usual ones without version.
_IDENTIFIER = re.compile(r"[a-z][a-z0-9.+-]*-[0-9]+(\.[0-9]+)*[a-z]?(-(only|or-later|invariants|invariants-only|invariants-or-later))?\+?|(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
# Licence identifiers without a version.
UNVERSIONED = ("zlib", "unlicense", "wtfpl", "0bsd", "x11", "ncsa", "postgresql", "openssl", "curl", "beerware", "ftl", "ijg", "libpng", "ruby", "vim", "hpnd", "json", "imagemagick", "none", "noassertion")
_EXCEPTION = re.compile(r"[a-z0-9.+-]*exception[a-z0-9.+-]*|(documentref-[a-z0-9.-]+:)?(additionref|licenseref)-[a-z0-9.-]+")
#: Bytes that are matched at a time.
SPAN = 4_000_000

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def family(identifier: str) -> str:
    """Label of a licence identifier: ``apache-2.0`` is apache, ``gpl-3.0-only`` is gpl; otherwise itself."""
    for known in _FAMILIES:
        if identifier == known or identifier.startswith((known + "-", known + "+")):
            return known
    return identifier


def _names_licence(token: str) -> bool:
    return family(token) in DEGREES or token in UNVERSIONED or _IDENTIFIER.fullmatch(token) is not None


def read_expression(low: bytes, at: int) -> tuple[list[str], int]:
    """Tokens of the longest expression that begins at ``at`` (lower-cased text), and where it ends. What follows an operator
    must be an identifier of a licence (of an exception after ``with``) or a bracket, or the operator isn't part of it."""
    tokens: list[str] = []
    kept, end, depth, operand = 0, at, 0, False
    while found := _TOKEN.match(low, at):
        t = found[1].decode("ascii")
        if operand:
            if t == ")" and depth:
                depth -= 1
            elif t in _BINDING:
                operand = False
            else:
                break
        elif t == "(":
            depth += 1
        elif (_EXCEPTION.fullmatch(t) if tokens and tokens[-1] == "with" else _names_licence(t)) and t not in _BINDING:
            operand = True
        else:
            break
        tokens.append(t)
        at = found.end()
        if operand:
            kept, end = len(tokens), at
    return tokens[:kept], end


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order, or None if the brackets or places don't fit."""
    out, held, operand = [], [], False
    for t in tokens:
        if t == "(":
            if operand:
                return None
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held or not operand:
                return None
            held.pop()
        elif t in _BINDING:
            if not operand:
                return None
            while held and held[-1] != "(" and _BINDING[held[-1]] >= _BINDING[t]:
                out.append(held.pop())
            held.append(t)
            operand = False
        elif operand:
            return None
        else:
            out.append(t)
            operand = True
    while held:
        if held[-1] == "(":
            return None
        out.append(held.pop())
    return out if operand else None


def evaluate(tokens: list[str]) -> tuple[set[str], float] | None:
    """Labels and score of an expression's tokens; None if it names no licence."""
    order = postfix(tokens)
    if order is None:
        names = [t for t in tokens if t not in _BINDING and t not in "()"]
        return ({family(t) for t in names}, min(DEGREES.get(family(t), _OTHER) for t in names)) if names else None
    stack: list[tuple[set[str], float]] = []
    for t in order:
        if t in _BINDING:
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append((a, (x + 1) / 2) if t == "with" else (a | b, max(x, y) if t == "or" else min(x, y)))
        else:
            stack.append(({family(t)}, DEGREES.get(family(t), _OTHER)))
    return stack[0]


def _automata():
    import ahocorasick

    notices, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in dict.fromkeys([*BASE, *NOTICES]):
        notices.add_word(f" {phrase} ", f" {phrase} ")
    for tag in TAGS:
        tags.add_word(tag, tag)
    notices.make_automaton()
    tags.make_automaton()
    return notices, tags


def _matches(text: bytes, automaton):
    """(start, word) of all matches, span by span; bytes stand for characters, since all patterns are ASCII."""
    reach = max(map(len, automaton.keys())) - 1
    for at in range(0, len(text), SPAN):
        for last, word in automaton.iter(text[at : at + SPAN + reach].decode("latin-1")):
            start = last - len(word) + 1
            if start < SPAN:
                yield at + start, word


def scan(raw: bytes, automata) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text (UTF-8)."""
    line = raw.translate(_WORDS).strip(b" ")
    while b"  " in line:
        line = line.replace(b"  ", b" ")
    line = b" " + line + b" "
    n_words = line.count(b" ") - 1 if len(line) > 2 else 0
    n_base, first, last, base, labels, degrees = 0, None, None, set(), set(), []
    for start, padded in _matches(line, automata[0]):
        phrase = padded.strip(" ")
        if phrase in BASE:
            n_base += 1
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
            base.add(BASE[phrase])
        label = NOTICES.get(phrase) or BASE[phrase]
        labels.add(label)
        degrees.append(DEGREES[label])
    low = raw.translate(_LOWER)
    done = 0
    for start, tag in _matches(low, automata[1]):
        # A tag inside an expression that was read already isn't read again.
        if start >= done:
            tokens, done = read_expression(low, start + len(tag))
            if found := evaluate(tokens):
                labels |= found[0]
                degrees.append(found[1])
    first, last = (x if x is None else line.count(b" ", 0, x) for x in (first, last))
    return n_words, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(degrees, default=0.5)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id with the results of ``scan`` for each row."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches):
        automata = _automata()
        for batch in chunks(batches):
            data, bounds = _bytes(batch.column("text"))
            rows = [scan(data[a:b].tobytes(), automata) for a, b in zip(bounds[:-1], bounds[1:])]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents", spread=True))
