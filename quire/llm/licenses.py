"""License scan by ordered signature rules.

Each text is brought to words (A-Z in lower case; letters, digits and any character beyond ASCII make words) joined by single
blanks; rules are regular expressions over that form. A rule has a keyword, and is tried only where the keyword occurs
(one Aho-Corasick pass per text), a label, a priority and a weight. Overlapping detections are resolved in the order of their
priorities, the longer first among equals: one that lies within a detection that stays, or overlaps one, is suppressed. The four base
phrases have the lowest priority, but their places count as they stand, and their labels stay in ``labels``.

Rules come from families (a name, its spellings, its versions), the short identifiers, and a few forms in which texts cite a license.

Defined results: null and empty texts have no words, no places and score 0; ties between rules go to the earlier rule;
very long texts are scanned whole; wholly repeated rows give equal results; further columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import wordbytes as wb
from quire.llm.common import released

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: name, spellings (regular expressions over words), versions, keyword that every spelling contains.
FAMILIES = [
    ("gpl", r"gnu general public licen[cs]e|gnu gpl|gpl", ("1.0", "2.0", "3.0"), ("gnu", "gpl")),
    ("lgpl", r"gnu (?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl", ("2.0", "2.1", "3.0"), ("gnu", "lgpl")),
    ("agpl", r"gnu affero general public licen[cs]e|gnu agpl|agpl", ("1.0", "3.0"), ("affero", "agpl")),
    ("gfdl", r"gnu free documentation licen[cs]e|gfdl", ("1.1", "1.2", "1.3"), ("gnu", "gfdl")),
    ("apache", r"apache (?:software )?licen[cs]e", ("1.0", "1.1", "2.0"), ("apache",)),
    ("mpl", r"mozilla public licen[cs]e|mpl", ("1.0", "1.1", "2.0"), ("mozilla", "mpl")),
    ("epl", r"eclipse public licen[cs]e|epl", ("1.0", "2.0"), ("eclipse", "epl")),
    ("cddl", r"common development and distribution licen[cs]e|cddl", ("1.0", "1.1"), ("distribution", "cddl")),
    ("eupl", r"european union public licen[cs]e|eupl", ("1.0", "1.1", "1.2"), ("european", "eupl")),
    ("artistic", r"artistic licen[cs]e", ("1.0", "2.0"), ("artistic",)),
    ("boost", r"boost software licen[cs]e|bsl", ("1.0",), ("boost", "bsl")),
    ("python", r"python software foundation licen[cs]e|psf licen[cs]e", ("2.0",), ("python", "psf")),
    ("zlib", r"zlib licen[cs]e", (), ("zlib",)),
    ("isc", r"isc licen[cs]e", (), ("isc",)),
    ("mit", r"mit licen[cs]e", (), ("mit",)),
    ("bsd-2-clause", r"(?:2|two) clause bsd(?: licen[cs]e)?|simplified bsd licen[cs]e|bsd 2 clause", (), ("bsd",)),
    ("bsd-3-clause", r"(?:3|three) clause bsd(?: licen[cs]e)?|(?:new|modified) bsd licen[cs]e|bsd 3 clause", (), ("bsd",)),
    ("bsd-4-clause", r"(?:4|four) clause bsd(?: licen[cs]e)?|original bsd licen[cs]e|bsd 4 clause", (), ("bsd",)),
    ("bsd", r"bsd licen[cs]e", (), ("bsd",)),
    ("unlicense", r"the unlicense|released into the public domain under the unlicense", (), ("unlicense",)),
    ("cc0", r"cc0|creative commons zero", ("1.0",), ("cc0", "zero")),
    ("cc-by", r"cc by|creative commons attribution(?: licen[cs]e)?", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc", "attribution")),
    ("cc-by-sa", r"cc by sa|creative commons attribution share ?alike(?: licen[cs]e)?", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc", "attribution")),
    ("cc-by-nd", r"cc by nd|creative commons attribution no ?deriv(?:ative|s|atives)(?: licen[cs]e)?", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc", "attribution")),
    ("cc-by-nc", r"cc by nc|creative commons attribution non ?commercial(?: licen[cs]e)?", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc", "attribution")),
    ("cc-by-nc-sa", r"cc by nc sa|creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc", "attribution")),
    ("cc-by-nc-nd", r"cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative|s|atives)(?: licen[cs]e)?", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("cc", "attribution")),
]
#: Signatures of license texts themselves: label, expression, keyword.
NOTICES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "distribute"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution"),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "compliance"),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of", "redistribute"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of", "redistribute"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors", "warranty"),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization", "hereby"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", r"(?:dedicated|released|placed) (?:to|into|in) the public domain", "domain"),
    ("proprietary", r"all rights reserved", "reserved"),
]
#: Short identifiers of the public license list, as words; where a number follows, they are told by themselves.
SHORT = (
    "0bsd", "afl 3 0", "agpl 3 0", "apache 1 1", "apache 2 0", "artistic 2 0", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "bsl 1 0", "cc0 1 0",
    "cc by 3 0", "cc by 4 0", "cc by sa 3 0", "cc by sa 4 0", "cc by nc 4 0", "cc by nd 4 0", "cc by nc sa 4 0", "cc by nc nd 4 0", "cddl 1 0", "cecill 2 1",
    "ecl 2 0", "epl 1 0", "epl 2 0", "eupl 1 1", "eupl 1 2", "gfdl 1 3", "gpl 1 0", "gpl 2 0", "gpl 3 0", "isc", "lgpl 2 0", "lgpl 2 1", "lgpl 3 0", "mit", "mit 0",
    "mpl 1 1", "mpl 2 0", "ms pl", "ms rl", "mulanpsl 2 0", "ncsa", "odbl 1 0", "ofl 1 1", "osl 3 0", "php 3 01", "postgresql", "python 2 0", "ruby", "sleepycat",
    "unlicense", "upl 1 0", "vim", "w3c", "wtfpl", "x11", "zlib", "zpl 2 1",
)
#: How a license is cited around its name: before, after, priority.
FORMS = [
    ("", "", 0),
    (r"(?:is |are )?(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:an? )?", "", 1),
    (r"spdx licen[cs]e identifier ", "", 2),
    ("", r" (?:applies|governs|terms)", 1),
]


@lru_cache(1)
def rules() -> list[tuple[str, int, str, re.Pattern]]:
    """(label, priority, keyword, expression) in order: the base phrases, notices, then families by form and version."""
    found = [(label, 0, phrase.split(" ")[-2], phrase) for phrase, label in BASE.items()]
    found += [(label, 8, keyword, text) for label, text, keyword in NOTICES]
    for words in SHORT:
        label, keyword = re.sub(r"(?<=\d) (?=\d)", ".", words).replace(" ", "-"), words.split(" ")[0]
        tail = "(?: only| or later| plus)?"
        found += [(label, 9, "identifier", rf"spdx licen[cs]e identifier {words}{tail}"), (label, 7, keyword, rf"{words}{tail} licen[cs]ed")]
        if words[-1].isdigit() or words.startswith("bsd "):
            found.append((label, 6, keyword, rf"{words}{tail}(?: licen[cs]e)?"))
    for name, spelling, versions, keywords in FAMILIES:
        for before, after, priority in FORMS:
            for version in (*versions, ""):
                words = version.replace(".", " ")
                bare = words.removesuffix(" 0")
                tail = rf"(?: licen[cs]e)? (?:version |v ?)?(?:{words}|{bare}|v{words}|v{bare})(?: or (?:any )?later)?" if version else ""
                label = f"{name}-{version}" if version else name
                for keyword in keywords:
                    # A spelling is tried with the keyword that it contains; the others of the family have their own rule.
                    own = "|".join(x for x in _alternatives(spelling) if keyword in re.split(r"\W+", x))
                    if own:
                        found.append((label, priority + 3 * bool(version), keyword, rf"{before}(?:{own}){tail}{after}"))
    return [(label, priority, keyword, re.compile(rf"(?<![^ ])(?:{text})(?![^ ])")) for label, priority, keyword, text in found]


def _alternatives(expression: str) -> list[str]:
    """The alternatives at the top level of an expression."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(expression):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append(expression[at:i])
            at = i + 1
    return [*parts, expression[at:]]


def _scanner():
    """The keyword automaton and the rules of each keyword; built once in a process."""
    made = sys.__dict__.get("_quire_license_scanner")
    if made is None:
        import ahocorasick

        by = {}
        for i, rule in enumerate(rules()):
            by.setdefault(rule[2], []).append(i)
        automaton = ahocorasick.Automaton()
        for keyword in by:
            automaton.add_word(f" {keyword} ", keyword)
        automaton.make_automaton()
        made = sys._quire_license_scanner = (automaton, by)
    return made


def detections(words: str, keywords: set[str], by: dict[str, list[int]]) -> list[tuple[int, int, int]]:
    """(start, end, rule number) of all matches in text of single-blank words, by place."""
    table, found = rules(), []
    for keyword in keywords:
        for i in by[keyword]:
            found += [(m.start(), m.end(), i) for m in table[i][3].finditer(words)]
    return sorted(found)


def resolve(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What stays, by place: detections in the order of priority, length, place and rule, without those that meet one that stays."""
    table = rules()
    kept: list[tuple[int, int, int]] = []
    for x in sorted(found, key=lambda x: (-table[x[2]][1], x[0] - x[1], x[0], x[2])):
        at = bisect_left(kept, x)
        if (at == len(kept) or kept[at][0] >= x[1]) and (not at or kept[at - 1][1] <= x[0]):
            kept.insert(at, x)
    return kept


def _scan(text: str) -> tuple[int, int | None, int | None, str, str, float] | None:
    """(n_base, first_word, last_word, base_labels, labels, score) of a text; None without a detection."""
    automaton, by = _scanner()
    words = " ".join(_WORDS.findall(_lower(text)))
    keywords = {k for _, k in automaton.iter(f" {words} ")}
    if not keywords:
        return None
    found = detections(words, keywords, by)
    if not found:
        return None
    base = sorted(x[0] for x in found if x[2] < len(BASE))
    kept = resolve(found)
    table = rules()
    base_labels = sorted({table[x[2]][0] for x in found if x[2] < len(BASE)})
    labels = sorted({table[x[2]][0] for x in kept} | set(base_labels))
    # Longer and more specific detections make the scan surer.
    doubt = 1.0
    for start, end, i in kept:
        doubt *= 1 - min(0.95, 0.3 + 0.05 * table[i][1] + 0.01 * (end - start))
    first = words.count(" ", 0, base[0]) if base else None
    last = words.count(" ", 0, base[-1]) if base else None
    return len(base), first, last, ",".join(base_labels), ",".join(labels), 1 - doubt


_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CASE = {c: c + 32 for c in range(65, 91)}

def _lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_CASE)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""

    def scan(batches):
        automaton, by = _scanner()
        bare = [k.encode() for k in by]
        table = wb.lower_table()
        for batch in batches:
            texts = batch.column("text")
            data, offsets = wb.text_bytes(texts)
            n = np.bincount(wb.word_spans(data, offsets, wb.alphanumeric())[2], minlength=len(texts))
            low = table[data].tobytes()
            out = []
            for i in range(len(texts)):
                one = low[offsets[i] : offsets[i + 1]]
                out.append(_scan(one.decode("utf-8", "replace")) if any(k in one for k in bare) else None)
            columns = list(zip(*[x or (0, None, None, "", "", 0.0) for x in out], strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(scan), "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
