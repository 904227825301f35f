"""License scans by template-markup matching.

A template is license wording with two kinds of marked regions: ``[[...]]`` may be left out, ``{{name}}`` or ``{{name:3}}``
stands for up to eight (or three) words of any kind. Each template is compiled into an automaton over words. A place in a
text is accepted if its words run through the automaton: mandatory wording must match word by word, and case, white space
and punctuation don't count. All automata start at the words that can begin them, so that texts without such words cost
one search only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, text_or_empty

#: ASCII letters are lowered, other ASCII characters but digits part words, all else belongs to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
VARIABLE_WORDS = 8

#: Fixed phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so[[,]]")
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND'
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")


def _gnu(name: str, version: str) -> str:
    return (f"is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation[[,]] "
            f"either version {version} of the License[[, or (at your option) any later version]]")


#: label, template. mit-grant is the first clause alone, which several licenses share.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc-4.0", "Licensed under [[a]] [[the]] [[Creative Commons]] CC BY-NC 4.0[[ License]]"),
    ("cc-by-4.0", "Licensed under [[a]] [[the]] [[Creative Commons]] CC BY 4.0[[ International]][[ License]]"),
    ("gpl-3.0", "This {{work:2}} is licensed under the GNU General Public License[[,]] version 3[[ or {{any:4}} later version]]"),
    ("mit", "Released under the MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", f"{_MIT} subject to the following conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("mit-0", f"{_MIT} {_AS_IS}"),
    ("isc", "Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED"),
    ("bsd-2-clause", f"{_BSD} THIS SOFTWARE IS PROVIDED"),
    ("bsd-3-clause", f"{_BSD} [[3.]] Neither the name of {{{{holder:12}}}} nor the names of [[its]] [[any]] [[other]] contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED"),
    ("mpl-2.0", "This Source Code [[Form]] is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("gpl-2.0", _gnu("General", "2")),
    ("gpl-3.0", _gnu("General", "3")),
    ("lgpl-2.1", _gnu("Lesser General", "2.1")),
    ("lgpl-3.0", _gnu("Lesser General", "3")),
    ("agpl-3.0", _gnu("Affero General", "3")),
    ("copyright", "Copyright [[(c)]] {{year:2}} [[by]] {{holder:6}} All rights reserved"),
)


def words_of(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after lowering A-Z."""
    return text.translate(_TABLE).split()


@dataclass
class Automaton:
    """States with transitions by a word, by any word, and by none."""

    label: str
    by_word: list[dict[bytes, int]] = field(default_factory=list)
    by_any: list[int | None] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)

    def state(self) -> int:
        self.by_word.append({})
        self.by_any.append(None)
        self.free.append(set())
        return len(self.free) - 1

    def reach(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for k in self.free[todo.pop()] - out:
                out.add(k)
                todo.append(k)
        return out

    def begins(self) -> set[bytes]:
        return {w for s in self.reach({0}) for w in self.by_word[s]}

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run of words from ``at``, -1 if none is."""
        now, end = self.reach({0}), -1
        for k in range(at, len(words)):
            step = {self.by_word[s][words[k]] for s in now if words[k] in self.by_word[s]} | {self.by_any[s] for s in now if self.by_any[s] is not None}
            if not step:
                break
            now = self.reach(step)
            if self.last in now:
                end = k + 1
        return end

    last: int = 0


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of a template. Optional regions may be nested; ValueError if brackets don't match or nothing is mandatory."""
    a = Automaton(label)
    at, opened, mandatory = a.state(), [], 0
    for token in re.findall(r"\[\[|\]\]|\{\{\w+(?::\d+)?\}\}|[^\[\]{}]+|.", template):
        if token == "[[":
            opened.append(at)
        elif token == "]]":
            if not opened:
                raise ValueError(f"{label}: ]] without [[")
            a.free[opened.pop()].add(at)
        elif token.startswith("{{") and token.endswith("}}"):
            most = int(token[2:-2].partition(":")[2] or VARIABLE_WORDS)
            first, chain = at, []
            for _ in range(most):
                following = a.state()
                a.by_any[at] = following
                chain.append(at)
                at = following
            for k in chain[1:]:
                a.free[k].add(at)
            del first
        else:
            for word in words_of(token.encode()):
                following = a.state()
                a.by_word[at][word] = following
                at, mandatory = following, mandatory + (not opened)
    if opened or not mandatory:
        raise ValueError(f"{label}: [[ without ]]" if opened else f"{label}: no mandatory words")
    a.last = at
    return a


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in phrases]
        self.automata = [compile_template(*t) for t in templates]
        self.starts: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for word in a.begins():
                self.starts.setdefault(word, []).append(a)

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(number of words, phrases found, templates found) with (label, first word, end) each."""
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        base, more = [], []
        for phrase, label in self.phrases:
            at, seen, first = joined.find(phrase), 0, 0
            while at >= 0:
                first, seen = first + joined.count(b" ", seen, at), at
                base.append((label, first, first + phrase.count(b" ") - 1))
                at = joined.find(phrase, at + 1)
        for word in self.starts.keys() & set(words) if self.starts else ():
            at = words.index(word)
            while at >= 0:
                for a in self.starts[word]:
                    end = a.longest(words, at)
                    if end > 0:
                        more.append((a.label, at, end))
                try:
                    at = words.index(word, at + 1)
                except ValueError:
                    at = -1
        return len(words), sorted(base, key=lambda x: (x[1], x[2])), sorted(more, key=lambda x: (x[1], x[2]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(id, n_words, phrases, templates) of every row, matches as array<struct<label,first,end>> in words from 0, end exclusive.

    A null text counts as empty; overlapping matches are all reported. Other columns aren't read.
    """
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    match = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            lists = [pa.array([[{"label": a, "first": b, "end": c} for a, b, c in x[k]] for x in found], match) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), *lists], ["id", "n_words", "phrases", "templates"])

    kind = "array<struct<label:string,first:bigint,end:bigint>>"
    return rows.mapInArrow(releasing(run), f"id {rows.schema['id'].dataType.simpleString()}, n_words long, phrases {kind}, templates {kind}").withColumnRenamed("id", id_col)
