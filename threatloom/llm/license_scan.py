"""License scan by ordered signature rules behind a keyword prefilter.

A text is lower-cased (A-Z) and reduced to its words, joined by single spaces, so
a rule is a pattern over words and every detection is an interval of words. All
keywords are searched at once; only rules whose keyword occurs run. Detections
carry their rule's priority (full text over named version over mere mention),
and one that lies inside another of the same or a higher priority is dropped.

Base phrases are counted apart from the rules, over the word list, and their
labels always stay. The score is the confidence that at least one kept
detection names a license: one minus the product of the rules' doubts.

Defined results: null text is empty text, with 0 words, null positions, empty
labels and score 0; repeated rows repeat their result; an empty table gives no
rows; other columns are ignored. A text costs time linear in its length for
every rule that runs; very long texts are scanned whole.
"""

import re
from collections import defaultdict
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query
from .common import byte_texts, pieces, read
from .words import FOLD

#: Phrase, as words, and its label.
BASE = ((b"gnu general public license", "gpl"), (b"apache license", "apache"), (b"cc by", "cc-by"), (b"mit license", "mit"))

#: Priorities: a text of the license, its name with a version, a notice that grants it, an identifier, its bare name.
TEXT, VERSIONED, NOTICE, TAG, NAME = 5, 4, 3, 2, 1
DOUBT = {TEXT: 0.02, VERSIONED: 0.05, NOTICE: 0.1, TAG: 0.1, NAME: 0.4}


class Rule(NamedTuple):
    label: str
    keywords: tuple
    priority: int
    pattern: re.Pattern


#: Families: label, keywords of which every form but the text has one, full name, other names, versions, tag, phrases of the text itself. Patterns are over words.
FAMILIES = (
    ("gpl", "general public|gpl", "gnu general public licen[sc]e", "gnu gpl|general public licen[sc]e|gplv?[0-9]?", "1|2|3", "gpl [0-9](?: 0)?(?: only| or later)?",
     ("this program is free software you can redistribute it and or modify", "either version [0-9] of the license or at your option any later version",
      "the licenses for most software are designed to take away your freedom")),
    ("lgpl", "lesser general|lgpl", "gnu lesser general public licen[sc]e", "gnu lgpl|lesser general public licen[sc]e|lgplv?[0-9]?", "2|2 1|3", "lgpl [0-9](?: [0-9])?(?: only| or later)?",
     ("this library is free software you can redistribute it", "this license the lesser general public license applies")),
    ("lgpl", "library general|lgpl", "gnu library general public licen[sc]e", "library general public licen[sc]e", "2|2 0", "lgpl 2 0", ()),
    ("agpl", "affero|agpl", "gnu affero general public licen[sc]e", "affero gpl|affero general public licen[sc]e|agplv?[0-9]?", "1|3", "agpl [0-9](?: 0)?(?: only| or later)?",
     ("remote network interaction use with the gnu general public license",)),
    ("gfdl", "free documentation|gfdl", "gnu free documentation licen[sc]e", "gfdl|free documentation licen[sc]e", "1 1|1 2|1 3", "gfdl 1 [123](?: only| or later)?",
     ("with no invariant sections no front cover texts and no back cover texts",)),
    ("apache", "apache|asl ", "apache licen[sc]e", "apache software licen[sc]e|asl", "1|1 0|1 1|2|2 0", "apache [12](?: [01])?",
     ("licensed under the apache license version", "unless required by applicable law or agreed to in writing software distributed under the license",
      "you may obtain a copy of the license at http www apache org licenses")),
    ("mit", "mit licen|mit x11|mit style|expat licen|identifier mit", "mit licen[sc]e", "mit x11 licen[sc]e|expat licen[sc]e|mit style licen[sc]e", "", "identifier mit",
     ("permission is hereby granted free of charge to any person obtaining a copy of this software",
      "the above copyright notice and this permission notice shall be included in all copies")),
    ("bsd", "bsd", "bsd licen[sc]e", "(?:new|modified|revised|simplified|original) bsd licen[sc]e|bsd style licen[sc]e", "2 clause|3 clause|4 clause", "bsd [0234] clause",
     ("redistribution and use in source and binary forms with or without modification are permitted",
      "neither the name of [a-z0-9 ]{1,60} nor the names of its contributors may be used")),
    ("isc", "isc licen|internet systems|identifier isc", "isc licen[sc]e", "internet systems consortium licen[sc]e", "", "identifier isc",
     ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",)),
    ("mpl", "mozilla|mpl", "mozilla public licen[sc]e", "mozilla licen[sc]e", "1 0|1 1|2 0", "mpl [12] [01]",
     ("this source code form is subject to the terms of the mozilla public license",)),
    ("epl", "eclipse|epl", "eclipse public licen[sc]e", "eclipse licen[sc]e", "1 0|2 0", "epl [12] 0",
     ("this program and the accompanying materials are made available under the terms of the eclipse public license",)),
    ("edl", "eclipse distribution|edl", "eclipse distribution licen[sc]e", "edl", "1 0", "edl 1 0", ()),
    ("cddl", "common development|cddl", "common development and distribution licen[sc]e", "cddl", "1 0|1 1", "cddl 1 [01]",
     ("the contents of this file are subject to the terms of the common development and distribution license",)),
    ("cpl", "common public|cpl", "common public licen[sc]e", "cpl", "1 0", "cpl 1 0", ("the accompanying program is provided under the terms of this common public license",)),
    ("ipl", "ibm public|ipl", "ibm public licen[sc]e", "ipl", "1 0", "ipl 1 0", ()),
    ("cc-by", "creative commons|cc by", "creative commons attribution(?: licen[sc]e)?", "creative commons by", "1 0|2 0|2 5|3 0|4 0", "cc by [1-4] [05]",
     ("creativecommons org licenses by [1-4] [05]",)),
    ("cc-by-sa", "creative commons|cc by sa", "creative commons attribution share ?alike(?: licen[sc]e)?", "cc by sa", "1 0|2 0|2 5|3 0|4 0", "cc by sa [1-4] [05]",
     ("creativecommons org licenses by sa [1-4] [05]",)),
    ("cc-by-nc", "creative commons|cc by nc", "creative commons attribution non ?commercial(?: licen[sc]e)?", "cc by nc", "1 0|2 0|2 5|3 0|4 0", "cc by nc [1-4] [05]",
     ("creativecommons org licenses by nc [1-4] [05]",)),
    ("cc-by-nd", "creative commons|cc by nd", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: licen[sc]e)?", "cc by nd", "1 0|2 0|2 5|3 0|4 0", "cc by nd [1-4] [05]",
     ("creativecommons org licenses by nd [1-4] [05]",)),
    ("cc-by-nc-sa", "creative commons|cc by nc sa", "creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?", "cc by nc sa", "1 0|2 0|2 5|3 0|4 0", "cc by nc sa [1-4] [05]",
     ("creativecommons org licenses by nc sa [1-4] [05]",)),
    ("cc-by-nc-nd", "creative commons|cc by nc nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: licen[sc]e)?", "cc by nc nd", "1 0|2 0|2 5|3 0|4 0",
     "cc by nc nd [1-4] [05]", ("creativecommons org licenses by nc nd [1-4] [05]",)),
    ("cc0", "cc0|creative commons zero", "cc0(?: universal)?", "creative commons zero", "1 0", "cc0 1 0", ("creativecommons org publicdomain zero 1 0",)),
    ("public-domain", "public domain|publicdomain", "public domain dedication", "(?:released|dedicated|placed) (?:in|into|to) the public domain", "", "publicdomain mark 1 0",
     ("this work is in the public domain", "the author hereby disclaims copyright to this source code")),
    ("unlicense", "unlicense", "the unlicense", "unlicense org", "", "identifier unlicense",
     ("this is free and unencumbered software released into the public domain",)),
    ("artistic", "artistic", "artistic licen[sc]e", "clarified artistic licen[sc]e|perl artistic licen[sc]e", "1 0|2|2 0", "artistic [12] 0",
     ("same terms as perl itself", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed")),
    ("zlib", "zlib|libpng", "zlib licen[sc]e", "zlib libpng licen[sc]e|libpng licen[sc]e", "", "identifier zlib",
     ("in no event will the authors be held liable for any damages arising from the use of this software",)),
    ("boost", "boost|bsl", "boost software licen[sc]e", "boost licen[sc]e", "1 0", "bsl 1 0", ("distributed under the boost software license",)),
    ("wtfpl", "wtfpl|do what the fuck", "wtfpl", "do what the fuck you want to public licen[sc]e", "1|2", "wtfpl [12]", ("you just do what the fuck you want to",)),
    ("eupl", "european union|eupl", "european union public licen[sc]e", "eupl", "1 0|1 1|1 2", "eupl 1 [012]", ("licensed under the eupl",)),
    ("ofl", "open font|ofl", "sil open font licen[sc]e", "open font licen[sc]e|sil ofl", "1 0|1 1", "ofl 1 [01]", ("this font software is licensed under the sil open font license",)),
    ("odbl", "open database|odbl", "open database licen[sc]e", "odbl", "1 0", "odbl 1 0", ("opendatacommons org licenses odbl",)),
    ("odc-by", "data commons|odc by", "open data commons attribution licen[sc]e", "odc by", "1 0", "odc by 1 0", ("opendatacommons org licenses by",)),
    ("pddl", "data commons|pddl", "open data commons public domain dedication and licen[sc]e", "pddl", "1 0", "pddl 1 0", ("opendatacommons org licenses pddl",)),
    ("python", "python|psf", "python software foundation licen[sc]e", "psf licen[sc]e|python licen[sc]e", "2|2 0", "psf 2 0|python 2 0", ("psf is making python available to licensee on an as is basis",)),
    ("php", "php", "php licen[sc]e", "the php licen[sc]e", "2 02|3 0|3 01", "php 3 0 ?1?", ("this product includes php software freely available",)),
    ("ruby", "ruby", "ruby licen[sc]e", "ruby s licen[sc]e", "", "identifier ruby", ("same terms as ruby itself",)),
    ("zpl", "zope|zpl", "zope public licen[sc]e", "zpl", "1 1|2 0|2 1", "zpl [12] [01]", ()),
    ("w3c", "w3c", "w3c software(?: notice)?(?: and)? licen[sc]e", "w3c document licen[sc]e", "", "identifier w3c", ("by obtaining using and or copying this work you the licensee agree",)),
    ("osl", "open software|osl", "open software licen[sc]e", "osl", "1 0|2 0|2 1|3 0", "osl [123] [01]", ("licensed under the open software license",)),
    ("afl", "academic free|afl", "academic free licen[sc]e", "afl", "1 1|1 2|2 0|2 1|3 0", "afl [123] [012]", ("licensed under the academic free license",)),
    ("ms-pl", "microsoft public|ms pl", "microsoft public licen[sc]e", "ms pl", "", "identifier ms pl", ()),
    ("ms-rl", "microsoft reciprocal|ms rl", "microsoft reciprocal licen[sc]e", "ms rl", "", "identifier ms rl", ()),
    ("apsl", "apple public|apsl", "apple public source licen[sc]e", "apsl", "1 0|1 1|1 2|2 0", "apsl [12] [012]", ()),
    ("qpl", "q public|qpl", "q public licen[sc]e", "qpl", "1 0", "qpl 1 0", ()),
    ("ncsa", "illinois|ncsa", "university of illinois(?: ncsa)? open source licen[sc]e", "ncsa licen[sc]e", "", "identifier ncsa", ()),
    ("postgresql", "postgres", "postgresql licen[sc]e", "postgres licen[sc]e", "", "identifier postgresql", ()),
    ("openssl", "openssl", "openssl licen[sc]e", "openssl and ssleay licen[sc]e", "", "identifier openssl", ("this product includes software developed by the openssl project",)),
    ("sspl", "server side|sspl", "server side public licen[sc]e", "sspl", "1|1 0", "sspl 1 0", ()),
    ("busl", "business source|busl", "business source licen[sc]e", "busl", "1 0|1 1", "busl 1 1", ("change date change license",)),
    ("elastic", "elastic", "elastic licen[sc]e", "elastic licen[sc]e v2", "1 0|2 0", "elastic 2 0", ()),
    ("vim", "vim", "vim licen[sc]e", "vim charityware licen[sc]e", "", "identifier vim", ()),
    ("json", "json", "json licen[sc]e", "the json licen[sc]e", "", "identifier json", ("the software shall be used for good not evil",)),
    ("beerware", "beer", "beer ?ware licen[sc]e", "the beerware licen[sc]e", "42", "identifier beerware", ("you can buy me a beer in return",)),
    ("proprietary", "proprietary|commercial licen|licenseref", "proprietary licen[sc]e", "proprietary and confidential|commercial licen[sc]e agreement", "", "licenseref proprietary",
     ("all rights reserved unauthorized copying of this file is strictly prohibited", "this software is the confidential and proprietary information of")),
    ("proprietary", "rights reserved|copyright|licenseref", "all rights reserved", "copyright (?:c )?[0-9]{4}", "", "licenseref commercial", ()),
)
GRANT = "(?:licen[sc]ed|released|distributed|available|published|provided|redistribut(?:ed|able)) under (?:the )?(?:terms of (?:the )?)?"


def rules() -> list[Rule]:
    """All rules of the families, over 400 patterns: text phrases, versions, grants, tags and names."""
    out = []
    for label, keywords, full, others, versions, tag, phrases in FAMILIES:
        name, gate = (f"(?:{full}|{others})" if others else full), tuple(k.encode() for k in keywords.split("|"))
        forms = [(NOTICE, GRANT + name), (NOTICE, f"(?:see|read) (?:the )?{name}"), (NOTICE, f"subject to (?:the )?(?:terms of )?(?:the )?{name}"),
                 (TAG, f"identifier (?:{tag})"), (TAG, tag), (NAME, full)]
        if others:
            forms.append((NAME, others))
        if versions:
            forms += [(VERSIONED, f"{name} (?:version |v ?|ver )?(?:{versions})"), (VERSIONED, f"version (?:{versions}) of the {name}"),
                      (VERSIONED, f"{GRANT}{name} (?:version |v ?|ver )?(?:{versions})(?: or (?:any )?later(?: version)?)?")]
        out += [Rule(label, gate, p, whole_words(form)) for p, form in forms]
        out += [Rule(label, (longest_run(form),), TEXT, whole_words(form)) for form in phrases]
    return out


def whole_words(form: str) -> re.Pattern:
    return re.compile(f"(?<![^ ])(?:{form})(?![^ ])".encode())


def longest_run(form: str) -> bytes:
    """The longest plain stretch of a phrase, as its keyword."""
    return max(re.split(r"\[[^\]]*\](?:\{[^}]*\})?", form), key=len).strip().encode()


class Scanner:
    """Keyword automaton and rules; built once in each task."""

    def __init__(self):
        self.rules, by_keyword = rules(), defaultdict(list)
        for i, rule in enumerate(self.rules):
            for k in rule.keywords:
                by_keyword[k].append(i)
        self.words = ahocorasick.Automaton()
        for k, ids in by_keyword.items():
            self.words.add_word(k.decode("latin-1"), ids)
        self.words.make_automaton()

    def detections(self, words: bytes) -> list[tuple[int, int, int, str]]:
        """(start, end, priority, label) in bytes of the joined words; all rules whose keyword occurs."""
        hit = {i for _, ids in self.words.iter(words.decode("latin-1")) for i in ids}
        return [(*m.span(), self.rules[i].priority, self.rules[i].label) for i in sorted(hit) for m in self.rules[i].pattern.finditer(words)]


def uncontained(found: list) -> list:
    """Detections that lie inside no other of the same or a higher priority; of equal ones the first label stays."""
    kept, reach = [], [-1] * (TEXT + 1)  # furthest end so far, by priority
    for a, b, priority, label in sorted(set(found), key=lambda d: (d[0], -d[1], -d[2], d[3])):
        if max(reach[priority:]) < b:
            kept.append((a, b, priority, label))
        reach[priority] = max(reach[priority], b)
    return kept


def base_places(words: bytes) -> list[tuple[int, str]]:
    """(word index, label) of every place of a base phrase."""
    around, places = b" " + words + b" ", []
    for phrase, label in BASE:
        needle, at, counted, n = b" " + phrase + b" ", -1, 0, 0
        while (at := around.find(needle, at + 1)) >= 0:
            n += around.count(b" ", counted, at)
            counted = at
            places.append((n, label))
    return places


def _scanned(batches):
    scanner = Scanner()
    for batch in pieces(batches):
        rows = []
        for text in byte_texts(batch, "text"):
            words = text.translate(FOLD).split()
            joined = b" ".join(words)
            base = base_places(joined)
            kept = uncontained(scanner.detections(joined))
            doubt = 1.0
            for p in (d[2] for d in kept):
                doubt *= DOUBT[p]
            starts, labels = [n for n, _ in base], {label for _, label in base}
            rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
                         ",".join(sorted(labels | {d[3] for d in kept})), max(1 - doubt, 0.9 if base else 0.0)))
        cols = list(zip(*rows))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], NAMES)


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs(doc_id, text)."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(_scanned, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                                     "base_labels string, labels string, score double")


@query("op4_scan_licenses")
def op4_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return scan_licenses(read(spark, sf_dir, "documents"))
