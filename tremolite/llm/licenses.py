"""License scans: ordered signature rules behind a gate of keywords, overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

#: The phrases whose every place counts, and their labels.
BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Words that follow "mit" where it is the German for "with".
GERMAN = r"(?! (?:der|dem|den|die|das|de[sr]sen|ein\w*|kein\w*|mein\w*|dein\w*|sein\w*|ihr\w*|uns\w*|euch|mir|dir|sich|ihm|ihnen|all\w*|dies\w*|jed\w*|viel\w*|und|hilfe)(?![^ ]))"

#: License families: (label, a name that means the license by itself, a name that does so only with a setting or a version,
#: whole words of which any such name holds one, versions).
FAMILIES = (
    ("gpl", r"(?:gnu )?(?:gpl|general public licen[cs]e)", "", "gpl license licence", ("1.0", "2.0", "3.0")),
    ("lgpl", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e)", "", "lgpl license licence", ("2.0", "2.1", "3.0")),
    ("agpl", r"(?:gnu )?(?:agpl|affero general public licen[cs]e)", "", "agpl license licence", ("1.0", "3.0")),
    ("gfdl", r"(?:gnu )?(?:gfdl|free documentation licen[cs]e)", "", "gfdl license licence", ("1.1", "1.2", "1.3")),
    ("apache", r"apache(?: software)? licen[cs]e", "apache", "apache", ("1.0", "1.1", "2.0")),
    ("mit", r"(?:mit|expat|x11) licen[cs]e", rf"mit{GERMAN}|expat|x11", "mit expat x11", ()),
    ("bsd", r"(?:(?:new|modified|simplified|revised) )?bsd licen[cs]e", r"(?:(?:new|modified|simplified|revised) )?bsd", "bsd", ("0", "1", "2", "3", "4")),
    ("mpl", r"mozilla public licen[cs]e", "mpl", "mpl license licence", ("1.0", "1.1", "2.0")),
    ("epl", r"eclipse public licen[cs]e", "epl", "epl license licence", ("1.0", "2.0")),
    ("eupl", r"(?:european union public licen[cs]e|eupl)", "", "eupl license licence", ("1.0", "1.1", "1.2")),
    ("cddl", r"(?:common development and distribution licen[cs]e|cddl)", "", "cddl license licence", ("1.0", "1.1")),
    ("cpl", r"common public licen[cs]e", "cpl", "cpl license licence", ("1.0",)),
    ("artistic", r"artistic licen[cs]e", "artistic", "artistic", ("1.0", "2.0")),
    ("bsl", r"boost software licen[cs]e", "bsl", "bsl license licence", ("1.0", "1.1")),
    ("isc", r"isc licen[cs]e", "isc", "isc", ()),
    ("zlib", r"zlib licen[cs]e", "zlib", "zlib", ()),
    ("unlicense", r"(?:the )?unlicen[cs]e", "", "unlicense unlicence", ()),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public licen[cs]e)", "", "wtfpl license licence", ("1.0", "2.0")),
    ("osl", r"open software licen[cs]e", "osl", "osl license licence", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", r"academic free licen[cs]e", "afl", "afl license licence", ("1.1", "2.0", "2.1", "3.0")),
    ("ofl", r"(?:sil )?open font licen[cs]e", "ofl", "ofl license licence", ("1.0", "1.1")),
    ("odbl", r"(?:open (?:data commons open )?database licen[cs]e|odbl)", "", "odbl license licence", ("1.0",)),
    ("python", r"(?:python software foundation|psf|python) licen[cs]e", "psf", "python psf", ("2.0",)),
    ("php", r"php licen[cs]e", "", "php", ("3.0", "3.01")),
    ("ruby", r"ruby licen[cs]e", "", "ruby", ()),
    ("postgresql", r"postgresql licen[cs]e", "", "postgresql", ()),
    ("openssl", r"openssl licen[cs]e", "", "openssl", ()),
    ("ms-pl", r"microsoft public licen[cs]e", "ms pl", "ms microsoft", ()),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", "ms rl", "ms microsoft", ()),
    ("cecill", r"cecill(?: [bc])?(?: licen[cs]e)?", "", "cecill", ("1.0", "2.0", "2.1")),
    ("cc0", r"(?:cc0|creative commons zero)", "", "cc0 creative", ("1.0",)),
    ("cc-by", r"creative commons attribution", "cc by", "cc creative", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", "", "cc creative", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:s|atives))", "", "cc creative", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", "", "cc creative", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "", "cc creative", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives))", "", "cc creative", ("1.0", "2.0", "2.5", "3.0", "4.0")),
)

#: Names that are also written in one word with their version: gplv3, gpl3.
GLUED = ("gpl", "lgpl", "agpl", "gfdl", "mpl", "epl", "eupl", "cddl", "cpl", "osl", "afl", "ofl")

#: What stands before the name: (wording, whole words of which any such text holds one, or none to look for, confidence).
SETTINGS = (
    (r"spdx licen[cs]e identifier ", "spdx", 1.0),
    (r"(?:(?:licen[cs]ed|released|distributed|available|published|provided|covered|redistributed?|use|used) (?:\w+ ){0,3}?under|(?:governed|covered) by|under) (?:the )?(?:terms of )?(?:the )?", "under by", 0.95),
    (r"(?:subject to|in accordance with|according to) (?:the )?(?:terms of )?(?:the )?", "to with", 0.85),
    (r"licen[cs]e (?:is )?(?:the )?", "license licence", 0.8),
    (r"", "", 0.6),
)

#: Names that stand for a license among others, one of which a text may choose: "Apache 2.0 or MIT".
SURE = r"(?:(?:the )?(?:apache(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?|apache licen[cs]e|mit licen[cs]e|bsd(?: \d clause| licen[cs]e)|[al]?gpl(?:v| v| version| )?\d(?: \d)?|[al]?gpl|mpl(?: v?\d(?: \d)?)?|unlicen[cs]e|isc licen[cs]e|zlib licen[cs]e|boost software licen[cs]e|bsl 1 0|cc0))"

#: Wordings that are a license's text or mean one without its name: (label, wording, a whole word of it, confidence).
TEXTS = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby", 1.0),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "distribute", 1.0),
    ("bsd", r"redistribution and use in source and binary forms", "redistribution", 1.0),
    ("gpl", r"this program is free software you can redistribute it and or modify it", "redistribute", 0.9),
    ("lgpl", r"this library is free software you can redistribute it and or modify it", "redistribute", 0.9),
    ("warranty-disclaimer", r"the software is provided as is without warranty of any kind", "warranty", 0.6),
    ("zlib", r"this software is provided as is without any express or implied warranty", "warranty", 0.7),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 1.0),
    ("public-domain", r"(?:released|placed|dedicated) (?:in)?to the public domain", "domain", 0.9),
    ("proprietary", r"all rights reserved", "reserved", 0.7),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", 0.8),
    ("copyright-notice", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 0.4),
)


class Rule(NamedTuple):
    priority: int
    label: str
    before: frozenset[bytes]
    name: frozenset[bytes]
    pattern: re.Pattern[bytes]
    confidence: float


def _versioned(label: str, name: str, words: str, version: str) -> tuple[str, str, str]:
    """(label, wording, words) of a name with a version: apart ("gpl 2 0", "gpl version 2", "gpl v2") or in one word ("gplv2").

    The version's first number stands for all of it only if no further number follows, so that 2.1 isn't 2.0 too.
    """
    major, _, minor = version.partition(".")
    number = major + (rf" {minor}" if minor.strip("0") else rf"(?: {minor}|(?! \d\d?(?![^ ])))" if minor else r"(?! \d\d?(?![^ ]))")
    apart, glued = rf"(?:{name})(?: version | v | clause | v| ){number}", [w for w in words.split() if w in GLUED]
    if glued:
        apart = rf"(?:{apart}|(?:{'|'.join(glued)})v?{number})"
    return f"{label}-{version}", apart, " ".join([words, *(f"{w}{v}{major}" for w in glued for v in ("v", ""))])


def _named(label: str, full: str, short: str, words: str, versions: tuple[str, ...]) -> Iterator[tuple[str, str, str, str, float]]:
    """Wordings of a family that hold more than its name: (label, wording, words before, words, confidence).

    The version before the name ("version 2 of the GNU General Public License"), after some words ("... as published by ...
    either version 2 of the License"), clauses before the name ("2-clause BSD"), "or later", and "MIT-licensed".
    """
    name = f"{full}|{short}" if short else full
    later = r"(?: or(?: at your option)?(?: any)? later(?: versions?)?| or newer)"
    for version in versions:
        v_label, wording, v_words = _versioned(label, name, words, version)
        major, _, minor = version.partition(".")
        number = major + (rf" {minor}" if minor.strip("0") else rf"(?: {minor})?(?! \d\d?(?![^ ]))" if minor else "")
        of = rf"(?:version |v |v){number}{later}? of (?:the )?(?:{name})"
        far = rf"(?:{full})(?: \w+){{1,14}}? version {number} of the licen[cs]e"
        yield v_label, wording + later, "later newer", v_words, 0.95
        yield v_label, far + r"(?: \w+){0,5}? any later version", "later", words, 0.95
        yield v_label, of, f"version v v{major}", words, 0.95
        yield v_label, far, "version", words, 0.9
        if label == "bsd":
            yield v_label, rf"{number} clause (?:{name})", "clause", words, 0.9
    yield label, rf"(?:{name}) licen[cs]ed(?: (?:software|code|program|library|project|work))?", "licensed licenced", words, 0.85


def _listed(label: str, full: str, short: str, words: str, versions: tuple[str, ...]) -> Iterator[tuple[str, str, str, str, float]]:
    """Lists of licenses: a name that is also a word counts beside a sure one, or at the end of what something is licensed under."""
    if short:
        yield label, rf"licen[cs]ed? (?:\w+ ){{0,8}}?(?:or|and) (?:the )?(?:{short})", "license licence licensed licenced", words, 0.8
        yield label, rf"(?:{short})(?: licen[cs]e)? (?:or|and) {SURE}", "or and", words, 0.8
        yield label, rf"{SURE} (?:or|and) (?:the )?(?:{short})", "or and", words, 0.8


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority: what holds more than a name, each setting with each family's versions and then the
    family, then lists and texts.

    Patterns are over normalised words with one space between them. A name with a version comes before one without.
    A match holds one of the words ``name``, and one of ``before`` if that has any. A name that is also an ordinary
    word (mit, apache) counts only with a setting or a version.
    """
    texts = [(label, p, "", word, conf) for label, p, word, conf in TEXTS]
    out: list[tuple[str, str, str, str, float]] = [t for t in texts if t[4] == 1.0]
    for family in sorted(FAMILIES, key=lambda f: -len(f[0])):
        out += _named(*family)
    for before, key, conf in SETTINGS:
        for label, full, short, words, versions in sorted(FAMILIES, key=lambda f: -len(f[0])):
            name = f"{full}|{short}" if short else full
            for version in versions:
                v_label, wording, v_words = _versioned(label, name, words, version)
                out.append((v_label, before + wording, key, v_words, conf))
            out.append((label, f"{before}(?:{name if before else full})", key, words, conf))
    for family in FAMILIES:  # after all names, which would else be suppressed within a list
        out += _listed(*family)
    out += [t for t in texts if t[4] < 1.0]
    words = lambda w: frozenset(w.encode().split())
    return tuple(Rule(n, label, words(key), words(name), re.compile((r"(?<![^ ])(?:" + p + r")(?![^ ])").encode()), conf) for n, (label, p, key, name, conf) in enumerate(out))


@lru_cache(1)
def gate() -> dict[bytes, list[int]]:
    """Word to the rules of whose matches each holds it or another word of the rule: a text without any has no detection."""
    out: dict[bytes, list[int]] = {}
    for r in rules():
        for w in r.name:
            out.setdefault(w, []).append(r.priority)
    return out


#: By byte: A-Z in lower case, separators to spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SEP = rb"[\x00-/:-`{-\x7f]+"
_BASE = tuple((label, re.compile(rb"(?<![0-9a-z\x80-\xff])" + _SEP.join(w.encode() for w in phrase.split()) + rb"(?![0-9a-z\x80-\xff])"), phrase.split()[-1].encode()) for phrase, label in BASE_PHRASES)


class Detection(NamedTuple):
    start: int
    end: int
    priority: int
    label: str
    confidence: float


def detect(words: list[bytes]) -> list[Detection]:
    """Detections in normalised words, best rule first; one that lies within another kept before it is suppressed."""
    have = set(words)
    hits = gate().keys() & have
    if not hits:
        return []
    normal = b" ".join(words)
    kept: list[Detection] = []
    covered: dict[int, int] = {}  # by place: the furthest end of a kept detection that holds the place
    for n in sorted(set().union(*(gate()[w] for w in hits))):
        r = rules()[n]
        if r.before and r.before.isdisjoint(have):
            continue
        for m in r.pattern.finditer(normal):
            start, end = m.span()
            if covered.get(start, 0) < end:
                kept.append(Detection(start, end, n, r.label, r.confidence))
                for at in range(start, end):
                    covered[at] = max(end, covered.get(at, 0))
    return kept


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_bytes(batch.column(1))
        cols: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
        for i, j in slices(offs):
            part = data[offs[i] : offs[j]]
            word = (part >= 128) | ((part >= 48) & (part <= 57)) | ((part >= 97) & (part <= 122)) | ((part >= 65) & (part <= 90))
            begins = word.copy()
            begins[1:] &= ~word[:-1]
            first = offs[i:j][offs[i:j] < offs[j]] - offs[i]
            begins[first] = word[first]
            starts = np.flatnonzero(begins)
            edges = np.searchsorted(starts, offs[i : j + 1] - offs[i])
            for k in range(i, j):
                at = starts[edges[k - i] : edges[k - i + 1]] - (offs[k] - offs[i])
                text = data[offs[k] : offs[k + 1]].tobytes().lower()
                base = [(int(np.searchsorted(at, m.start())), label) for label, p, key in _BASE if key in text for m in p.finditer(text)]
                found = detect(text.translate(_FOLD).split())
                labels = {label for _, label in base}
                cols["n_words"].append(len(at))
                cols["n_base"].append(len(base))
                cols["first_word"].append(min(base)[0] if base else None)
                cols["last_word"].append(max(base)[0] if base else None)
                cols["base_labels"].append(",".join(sorted(labels)))
                cols["labels"].append(",".join(sorted(labels | {d.label for d in found})))
                cols["score"].append(max([d.confidence for d in found] + [0.5] * bool(base), default=0.0))
                cols["detections"].append(len(found))
        kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
        yield pa.record_batch([batch.column(0), *(pa.array(v, kinds.get(c, pa.int64())) for c, v in cols.items())], names=["doc_id", *cols])


def license_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: n_words, the places of base phrases, labels and score (the best rule's confidence).

    Words are runs of letters, digits and bytes beyond ASCII, A-Z in lower case; phrases stand across any separators.
    Every base place counts; the rules add labels of their own, after suppression. No shuffle. Null or empty text:
    no words, no places, empty labels, score 0; a null doc_id stays null. Repeated rows: equal results. An empty table
    gives an empty table. Columns other than doc_id and text aren't read, whatever their names.
    """
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections long"
    )
