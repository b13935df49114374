"""Licence scan: one Aho-Corasick pass finds notice phrases and identifier tags; expressions after a tag are parsed by precedence.

Notice phrases are looked for in the sequence of words (A-Z lower-cased, ASCII punctuation is no word), identifier tags in the raw
lower-cased text. What follows a tag, up to the end of its line, is an expression of licence identifiers, ``and``, ``or``, ``with`` and
parentheses, brought into postfix order by the shunting-yard method and evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from mailpolicy.llm.common import WORD_BYTES, mapped

#: The phrases every scan counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases.
NOTICES = {
    "licensed under the apache license": "apache-2.0",
    "apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge": "mit",
    "the mit license": "mit",
    "mit license": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "isc license": "isc",
    "released into the public domain": "public-domain",
    "cc0": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
}
#: What announces a licence expression.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: How restrictive a licence is, by the start of its label; the longest start counts, an unknown one is 0.5.
RESTRICTIVE = {"public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "mit": 0.1, "bsd": 0.1, "isc": 0.1, "bsl-1.0": 0.1, "apache": 0.2, "cc-by": 0.3, "cc-by-sa": 0.5, "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "gpl": 0.7, "agpl": 0.8, "cc-by-nc": 0.8, "cc-by-nd": 0.8, "reserved": 1.0}
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")


def restrictiveness(label: str) -> float:
    starts = [s for s in RESTRICTIVE if label.startswith(s)]
    return RESTRICTIVE[max(starts, key=len)] if starts else 0.5


def postfix(expression: str) -> list[str] | None:
    """Identifiers and operators of a lower-case expression in postfix order; the longest well-formed start counts. None: there is none.

    Two identifiers in a row end the expression, as prose may follow it on its line; unclosed parentheses are closed at the end.
    """
    out, stack, operand = [], [], True  # operand: one is due
    for t in _TOKEN.findall(expression):
        if t == "(":
            if not operand:
                break
            stack.append(t)
        elif t == ")":
            if operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif t in _PRECEDENCE:
            if operand:
                break
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        else:
            if not operand:
                break
            out.append(t.rstrip(".:-") or t)
            operand = False
    if operand:  # an operator without its right side goes, as do parentheses opened after it
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    out += [t for t in reversed(stack) if t != "("]
    return out or None


def evaluated(order: list[str]) -> tuple[set[str], float]:
    """Labels named in a postfix expression, and how restrictive it is: the reader chooses at ``or``, must keep both at ``and``; an exception eases a licence."""
    values: list[tuple[set[str], float]] = []
    for t in order:
        if t not in _PRECEDENCE:
            values.append(({t}, restrictiveness(t)))
            continue
        (b, y), (a, x) = values.pop(), values.pop()
        values.append((a, x * 0.9) if t == "with" else (a | b, min(x, y) if t == "or" else max(x, y)))
    return values[-1]


@lru_cache(maxsize=4)
def _automaton(phrases: tuple[str, ...], padded: bool) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in phrases:
        key = p.encode().decode("latin-1")
        a.add_word(f" {key} " if padded else key, p)
    a.make_automaton()
    return a


def scan(text: str | None, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> dict:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    w = raw.translate(WORD_BYTES).split()
    line = (b" " + b" ".join(w) + b" ").decode("latin-1")  # a byte to a character, as all phrases are ASCII
    places, found, score = [], set(), 0.0
    for end, phrase in _automaton(tuple(dict.fromkeys([*base, *notices])), True).iter(line):
        if phrase in base:
            places.append((end - len(phrase) - 1, base[phrase]))
        if phrase in notices:
            found.add(notices[phrase])
    base_labels = {label for _, label in places}
    score = max([0.0, *map(restrictiveness, base_labels | found)])
    lower = raw.lower()
    if any(t.encode() in lower for t in TAGS):
        source = lower.decode("latin-1")
        for end, _ in _automaton(TAGS, False).iter(source):
            stop = source.find("\n", end)
            order = postfix(source[end + 1 : stop if stop >= 0 else len(source)])
            if order:
                labels, value = evaluated(order)
                found |= labels
                score = max(score, value)
    starts = [line.count(" ", 0, at + 1) - 1 for at in (min(places)[0], max(places)[0])] if places else [None, None]
    return {"n_words": len(w), "n_base": len(places), "first_word": starts[0], "last_word": starts[1], "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | found)), "score": score}


_COLUMNS = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()))


def _scan_batches(batches: Iterator[pa.RecordBatch], base, notices) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [scan(t.as_py(), base, notices) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[c] for r in rows], kind) for c, kind in _COLUMNS)], names=["doc_id", *(c for c, _ in _COLUMNS)])


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts every place of a base phrase, overlapping ones too; first_word and last_word are the least and greatest word at which
    one starts, null if there is none. labels adds what notices and tagged expressions name. score: how restrictive the strictest
    statement is, 0 (free, or nothing found) to 1. Null and empty texts have no words, no labels and score 0. Repeated rows are
    answered each, an empty table gives no rows, other columns are not looked at. One pass, no shuffle.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    return mapped(docs.select("doc_id", "text"), lambda it: _scan_batches(it, base, notices), f"doc_id {id_type}, " + ", ".join(f"{c} {kinds[k]}" for c, k in _COLUMNS))
