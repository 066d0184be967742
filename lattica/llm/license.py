"""License scans by an exact set-similarity join against templates.

A block, for a template of ``n`` words, is every run of ``n`` words and a fifth more of the text,
whatever lines it spans, since notices are mostly wrapped; a shorter text is one block. It matches
the template if it holds at least ``threshold`` of the template's distinct words, or all of them
where these are fewer than ``WHOLE``, as a few words less would leave out what tells
licenses apart; and if it holds none of the words in ``UNLESS``, which make it another license's
notice. The join is exact: words are put in one
global order, rarest in the corpus first; a template of ``n`` distinct words that must share ``k`` with
a block has one of its first ``n - k + 1`` words in it (prefix filter), the block needs ``k``
of the templates' words at least (length filter), and if the first shared word is at place
``p`` of the template and ``q`` of the block's ``m`` such words, in the same order, no more than
``min(n - p, m - q)`` words can be shared (positional filter). All three are put to a text as a
whole, and the first two to its parts around words of the prefix; what passes is counted out run by run.

The frequencies are those of the templates' words over all documents. The templates are a
fixed list, so their words, counts and index have a known small size whatever the corpus is;
texts are not shuffled, and no rows are gathered by key.

Nulls, ties and the like: a null text is empty: no words, no places, no labels, score 0. A
template without words matches nothing. A very long text costs time in proportion to its words;
a task holds one batch of texts at a time. Words of equal frequency are ordered by themselves.
Rows that repeat get a row each, an empty table gives an empty result, and other columns of
the input are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import LOWER, table

#: The phrases of the base rule and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices in common use, by the label that a match gets.
TEMPLATES = {
    "apache": "licensed under the apache license version 2.0",
    "apache-notice": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "boost": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-text": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "cc-by": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}
THRESHOLD = 0.8
#: A template of fewer distinct words must be held whole.
WHOLE = 12
#: Words that make a block the notice of a license other than the template's.
UNLESS = {
    "cc-by": "sharealike noncommercial noderivatives noderivs sa nc nd",
    "cc-by-nc": "sa nd",
    "cc-by-sa": "noncommercial nc",
    "gpl": "lesser library affero",
    "gpl-notice": "lesser library affero",
    "lgpl-notice": "affero",
}

#: Bytes that part words become spaces; capitals become small.
_SPLIT = bytes(b if chr(b).isalnum() or b >= 0x80 else 32 for b in range(128)) + bytes(range(128, 256))
_FOLD = LOWER.translate(_SPLIT)


def words_of(text: bytes) -> list[bytes]:
    """Runs of ``[0-9a-z]`` and non-ASCII characters of the lower-cased text."""
    return text.translate(_FOLD).split()


def phrase_places(words: list[bytes], phrases: Mapping[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    """``(start, label)`` of each place where a phrase's words stand."""
    found = []
    for phrase, label in phrases.items():
        at = -1
        last, size = phrase[-1], len(phrase)
        while True:
            try:
                at = words.index(last, at + 1)
            except ValueError:
                break
            start = at - size + 1
            if start >= 0 and tuple(words[start : at + 1]) == phrase:
                found.append((start, label))
    return found


class Index:
    """The templates' side of the join."""

    def __init__(self, templates: Mapping[str, str], counts: Mapping[bytes, int], threshold: float, unless: Mapping[str, str] = UNLESS):
        self.rank = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
        self.sets: list[tuple[str, frozenset[bytes], int]] = []
        self.lists: dict[bytes, list[tuple[int, int]]] = {}
        self.runs: dict[str, tuple[frozenset[bytes], int, int, frozenset[bytes], frozenset[bytes]]] = {}
        for label, text in sorted(templates.items()):
            own = sorted(set(words_of(text.encode())), key=lambda w: self.rank.get(w, -1))
            if not own:
                continue
            need = least(len(own), threshold)
            for place, word in enumerate(own[: len(own) - need + 1]):
                self.lists.setdefault(word, []).append((len(self.sets), place))
            self.sets.append((label, frozenset(own), need))
            barred = frozenset(words_of(unless.get(label, "").encode()))
            self.runs[label] = (frozenset(own), need, span(len(words_of(text.encode()))), frozenset(own[: len(own) - need + 1]), barred)
        self.prefix = frozenset(self.lists)

    def likely(self, held: set[bytes]) -> list[str]:
        """The templates that the words of a whole text hold enough of."""
        ordered = sorted(held & self.rank.keys(), key=self.rank.__getitem__)
        passed: dict[int, bool] = {}
        for q, word in enumerate(ordered):
            for which, place in self.lists.get(word, ()):
                if which not in passed:
                    _, own, need = self.sets[which]
                    passed[which] = min(len(own) - place, len(ordered) - q) >= need
        return [label for which, still in passed.items() if still for label, own, need in [self.sets[which]] if len(own & held) >= need]

    def matches(self, words: list[bytes], labels: Iterable[str]) -> dict[str, float]:
        """The best containment by label, over all runs of ``words``."""
        found: dict[str, float] = {}
        for label in labels:
            own, need, size, prefix, barred = self.runs[label]
            if (share := most_held(words, own, size, need, prefix, barred)) >= need:
                found[label] = share / len(own)
        return found


def least(distinct: int, threshold: float) -> int:
    """How many of a template's distinct words a block must hold."""
    return math.ceil(threshold * distinct - 1e-9) if distinct >= WHOLE else distinct


def span(n: int) -> int:
    """Words of a block for a template of ``n`` words."""
    return n + max(1, n // 5)


def most_held(words: list[bytes], own: frozenset[bytes], size: int, need: int, prefix: frozenset[bytes], barred: frozenset[bytes]) -> int:
    """How many of ``own`` a run of ``size`` words without ``barred`` ones holds at most; 0 if fewer than ``need``.

    Only runs that hold a word of the prefix are looked at: others don't match.
    """
    most, last = 0, len(words)
    parts: list[tuple[int, int]] = []  # what is within a run of some word of the prefix
    for i, w in enumerate(words):
        if w in prefix:
            a, b = max(0, i - size + 1), min(last, i + size)
            if parts and a <= parts[-1][1]:
                parts[-1] = (parts[-1][0], b)
            else:
                parts.append((a, b))
    for a, b in parts:
        hits = [i for i in range(a, b) if words[i] in own]
        if len(hits) < need:
            continue
        bad = [i for i in range(a, b) if words[i] in barred]
        held: Counter[bytes] = Counter()
        # A run can begin at each word of the part; at the text's end it keeps its size if it can.
        ahead = tail = 0
        stop = max(0, last - size)
        for start in range(a, min(b - 1, stop) + 1):
            while ahead < len(hits) and hits[ahead] < start + size:
                held[words[hits[ahead]]] += 1
                ahead += 1
            while tail < ahead and hits[tail] < start:
                gone = words[hits[tail]]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                tail += 1
            if len(held) > most and not (bad and bisect_left(bad, start + size) > bisect_left(bad, start)):
                most = len(held)
    return most if most >= need else 0


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))


def template_counts(docs: DataFrame, templates: Mapping[str, str], text_col: str = "text") -> dict[bytes, int]:
    """How often each word of the templates stands in all the texts.

    A task adds up its own counts; what comes to the driver has a row for each template word.
    """
    vocabulary = sorted({w for t in templates.values() for w in words_of(t.encode())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(vocabulary)}
        sums = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                hits = [place[w] for w in words_of(text) if w in place]
                sums += np.bincount(hits, minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary, pa.binary()), pa.array(sums)], names=["word", "n"])

    each = docs.select(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text")).mapInArrow(count, "word binary, n long")
    found = {bytes(r["word"]): r["n"] for r in each.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(w, 0) for w in vocabulary}


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, phrases: Mapping[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of phrases, labels and the best containment, a row for each row of ``docs``."""
    counts = template_counts(docs, templates, text_col)
    by_words = {tuple(k.encode().split()): v for k, v in phrases.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, counts, threshold)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                held = set(words)
                base = phrase_places(words, {p: k for p, k in by_words.items() if held.issuperset(p)})
                labels = {label for _, label in base}
                found: dict[str, float] = {}
                if not index.prefix.isdisjoint(held):
                    found = index.matches(words, index.likely(held))
                starts = [at for at, _ in base]
                every = sorted(labels | set(found))
                out.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(every), max([*found.values(), 1.0 if base else 0.0])))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return _texts(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of every document."""
    return scan(table(spark, sf_dir, "documents"))


_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def oracle() -> str:
    """DuckDB SQL for ``op10_license``: all runs of words against all templates, without an index; only texts without enough of a template's words are left out before."""
    split = {label: [w.decode() for w in words_of(t.encode())] for label, t in TEMPLATES.items()}
    rows = ", ".join(f"('{label}', list_distinct(string_split('{' '.join(ws)}', ' ')), {span(len(ws))}, {least(len(set(ws)), THRESHOLD)}, string_split('{UNLESS.get(label, '')}', ' '))" for label, ws in split.items())
    phrases = ", ".join(f"('{label}', string_split('{p}', ' '))" for p, label in PHRASES.items())
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH t(label, words, size, need, barred) AS (VALUES {rows}), p(label, words) AS (VALUES {phrases}),
d AS (SELECT doc_id, row_number() OVER () AS k, {lower} AS text FROM documents),
w AS (SELECT doc_id, k, text, regexp_extract_all(text, {_WORDS}) AS words FROM d),
b AS (SELECT k, p.label, i - 1 AS spot FROM w, p, unnest(range(1, len(w.words) - len(p.words) + 2)) u(i) WHERE w.words[i:i + len(p.words) - 1] = p.words),
l AS (SELECT k, label, w.words, t.words AS own, size, need, barred FROM w, t WHERE len(list_intersect(t.words, w.words)) >= need),
r AS (SELECT k, label, own, need, barred, words[i:i + size - 1] AS run FROM l, unnest(range(1, greatest(len(words) - size + 1, 1) + 1)) u(i)),
m AS (SELECT k, label, max(len(list_intersect(own, run)) / len(own)) AS share FROM r WHERE len(list_intersect(own, run)) >= need AND NOT list_has_any(run, barred) GROUP BY 1, 2),
bs AS (SELECT k, count(*) AS n, min(spot) AS a, max(spot) AS z, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM b GROUP BY 1),
al AS (SELECT k, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT k, label FROM b UNION ALL SELECT k, label FROM m) GROUP BY 1),
sc AS (SELECT k, max(share) AS s FROM m GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word, coalesce(bs.labels, '') AS base_labels, coalesce(al.labels, '') AS labels, greatest(coalesce(s, 0), CASE WHEN n > 0 THEN 1 ELSE 0 END)::DOUBLE AS score
FROM w LEFT JOIN bs USING (k) LEFT JOIN al USING (k) LEFT JOIN sc USING (k)"""
