"""License scans: ordered signature rules with a keyword gate and containment suppression, in DataFrame functions only.

Texts are reduced to lower-case words with single spaces. Every rule is a regular
expression on that form with a keyword that must occur before it is tried, a
priority, and a confidence. A detection inside the interval of another with a higher
priority, or of the same priority and longer, is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.notices import BODIES, EXCEPTIONS, GRANTS, HEADERS, NAMES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: One operand of an SPDX expression, from its tag or the operator before it up to the next operator.
SPDX_OPERAND = r"(?i)((?:SPDX-License-Identifier:|\G(?!\A))[\x20\t(]*[a-z0-9.+-]+(?:[\x20\t]+with[\x20\t]+[a-z0-9.+-]+)?[\x20\t)]+)(?:or|and)(?=[\x20\t(])"
#: Fixed values of the base report.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE_SCORE = 0.6


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


#: label; keyword; title as a pattern on normalised words; identifiers, normalised.
FAMILIES = (
    ("mit", "licen", "(?:the )?(?:mit|expat|x11) licen[sc]e", "mit|x11|mit license"),
    ("mit-0", "attribution", "mit no attribution", "mit 0"),
    ("apache-1.0", "apache", "apache (?:software )?licen[sc]e (?:version |v ?)?1 0", "apache 1 0"),
    ("apache-1.1", "apache", "apache (?:software )?licen[sc]e (?:version |v ?)?1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache (?:software )?licen[sc]e (?:version |v ?)?2(?: 0)?", "apache 2 0|apache2"),
    ("gpl-1.0", "gnu", "gnu (?:general public licen[sc]e|gpl) (?:version |v ?)?1(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", "gnu", "gnu (?:general public licen[sc]e|gpl) (?:version |v ?)?2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "gnu", "gnu (?:general public licen[sc]e|gpl) (?:version |v ?)?3(?: 0)?", "gpl 3 0"),
    ("lgpl-2.0", "gnu", "gnu (?:library|lesser) general public licen[sc]e (?:version |v ?)?2 0", "lgpl 2 0"),
    ("lgpl-2.1", "gnu", "gnu lesser general public licen[sc]e (?:version |v ?)?2 1", "lgpl 2 1"),
    ("lgpl-3.0", "gnu", "gnu lesser general public licen[sc]e (?:version |v ?)?3(?: 0)?", "lgpl 3 0"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public licen[sc]e (?:version |v ?)?3(?: 0)?", "agpl 3 0"),
    ("gfdl-1.3", "documentation", "gnu free documentation licen[sc]e (?:version |v ?)?1 3", "gfdl 1 3"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd) licen[sc]e", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) licen[sc]e", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd) licen[sc]e", "bsd 4 clause"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause|0bsd) licen[sc]e", "0bsd"),
    ("isc", "isc", "isc licen[sc]e", "isc"),
    ("mpl-1.1", "mozilla", "mozilla public licen[sc]e (?:version |v ?)?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?", "mpl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public licen[sc]e (?:version |v ?)?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?", "epl 2 0"),
    ("cddl-1.0", "distribution", "common development and distribution licen[sc]e(?: (?:version |v ?)?1 0)?", "cddl 1 0"),
    ("cpl-1.0", "common", "common public licen[sc]e(?: (?:version |v ?)?1 0)?", "cpl 1 0"),
    ("eupl-1.2", "european", "european union public licen[sc]e(?: (?:version |v ?)?1 2)?", "eupl 1 2"),
    ("artistic-1.0", "artistic", "artistic licen[sc]e (?:version |v ?)?1 0", "artistic 1 0"),
    ("artistic-2.0", "artistic", "artistic licen[sc]e (?:version |v ?)?2(?: 0)?", "artistic 2 0"),
    ("bsl-1.0", "boost", "boost software licen[sc]e(?: (?:version |v ?)?1 0)?", "bsl 1 0"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", "zlib"),
    ("libpng", "libpng", "libpng licen[sc]e", "libpng(?: 2 0)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("python-2.0", "python", "python (?:software foundation )?licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?", "python 2 0|psf 2 0"),
    ("php-3.01", "php", "php licen[sc]e(?: (?:version |v ?)?3 01)?", "php 3 01"),
    ("ruby", "ruby", "ruby licen[sc]e", "ruby"),
    ("openssl", "openssl", "openssl licen[sc]e", "openssl"),
    ("ofl-1.1", "font", "(?:sil )?open font licen[sc]e(?: (?:version |v ?)?1 1)?", "ofl 1 1"),
    ("postgresql", "postgresql", "postgresql licen[sc]e", "postgresql"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[sc]e", "ncsa"),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e", "ms rl"),
    ("osl-3.0", "open", "open software licen[sc]e (?:version |v ?)?3(?: 0)?", "osl 3 0"),
    ("afl-3.0", "academic", "academic free licen[sc]e (?:version |v ?)?3(?: 0)?", "afl 3 0"),
    ("sspl-1.0", "server", "server side public licen[sc]e(?: (?:version |v ?)?1)?", "sspl 1 0"),
    ("busl-1.1", "business", "business source licen[sc]e(?: (?:version |v ?)?1 1)?", "busl 1 1"),
    ("elastic-2.0", "elastic", "elastic licen[sc]e (?:version |v ?)?2(?: 0)?", "elastic 2 0"),
    ("upl-1.0", "universal", "universal permissive licen[sc]e(?: (?:version |v ?)?1 0)?", "upl 1 0"),
    ("blueoak-1.0.0", "blue", "blue oak model licen[sc]e(?: 1 0 0)?", "blueoak 1 0 0"),
    ("mulan-psl-2.0", "mulan", "mulan (?:permissive software licen[sc]e|psl) (?:version |v ?)?2", "mulanpsl 2 0"),
    ("odbl-1.0", "database", "open (?:data commons open )?database licen[sc]e(?: (?:version |v ?)?1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "commons", "open data commons attribution licen[sc]e(?: (?:version |v ?)?1 0)?", "odc by 1 0"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
)
#: Short names of the licences of which a later version may be allowed; what tells so, and what tells that none is.
SHORT = {
    "gpl-1.0": "gpl(?: ?v ?1(?: 0)?| version 1(?: 0)?| 1 0)",
    "gpl-2.0": "gpl(?: ?v ?2(?: 0)?| version 2(?: 0)?| 2 0)",
    "gpl-3.0": "gpl(?: ?v ?3(?: 0)?| version 3(?: 0)?| 3 0)",
    "lgpl-2.0": "lgpl(?: ?v ?2(?: 0)?| version 2(?: 0)?| 2 0)",
    "lgpl-2.1": "lgpl(?: ?v ?2 1| version 2 1| 2 1)",
    "lgpl-3.0": "lgpl(?: ?v ?3(?: 0)?| version 3(?: 0)?| 3 0)",
    "agpl-3.0": "agpl(?: ?v ?3(?: 0)?| version 3(?: 0)?| 3 0)",
    "gfdl-1.3": "gfdl(?: ?v ?1 3| version 1 3| 1 3)",
}
TAILS = {"": "", "-or-later": " (?:plus|or later|or newer|or (?:at your option )?any later version|or any later)", "-only": " only"}
CC_PARTS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative)?s?", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
GRANT = "(?:re)?(?:licen[sc]ed|distributed|released|available|published|redistribute it and or modify it) under (?:the )?(?:terms of )?(?:the )?(?:conditions of )?(?:the )?"
#: label; keyword; words of the licence's own text.
TEXTS = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither the name of .{1,80}? may be used to endorse or promote products derived"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "apache", "you may not use this file except in compliance with the license"),
    ("gpl", "fitness", "merchantability or fitness for a particular purpose see the gnu general public license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("bsl-1.0", "boost", "distributed under the boost software license"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("public-domain", "domain", "(?:released|dedicated|placed) (?:in|in ?to|to) the public domain"),
    ("proprietary", "reserved", "all rights reserved"),
    ("proprietary", "confidential", "proprietary and confidential"),
)
#: label; keyword; a mention without a version.
MENTIONS = (
    ("gpl", "gnu", "gnu (?:general public licen[sc]e|gpl)"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[sc]e"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e"),
    ("apache", "apache", "apache (?:software )?licen[sc]e"),
    ("bsd", "bsd", "bsd(?: style)? licen[sc]e"),
    ("mpl", "mozilla", "mozilla public licen[sc]e"),
    ("epl", "eclipse", "eclipse public licen[sc]e"),
    ("creative-commons", "creative", "creative commons"),
    ("cc-by", "cc by", "cc by"),
    ("free-unknown", "free", "free (?:and open source )?software licen[sc]e"),
    ("see-license", "licen", "see (?:the )?licen[sc]e(?: file)?(?: for (?:more )?(?:details|information))?"),
)
URLS = (
    ("apache-2.0", "apache", "apache org licenses license 2 0"),
    ("gpl", "gnu", "gnu org licenses gpl"),
    ("lgpl", "gnu", "gnu org licenses lgpl"),
    ("agpl-3.0", "gnu", "gnu org licenses agpl"),
    ("mit", "opensource", "opensource org licenses mit"),
    ("bsd-3-clause", "opensource", "opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", "opensource", "opensource org licenses bsd 2 clause"),
    ("isc", "opensource", "opensource org licenses isc"),
    ("mpl-2.0", "mozilla", "mozilla org (?:en us )?mpl 2 0"),
    ("epl-2.0", "eclipse", "eclipse org legal epl (?:v20|2 0)"),
    ("unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", "wtfpl net"),
    ("ofl-1.1", "sil", "scripts sil org ofl"),
)


def rules() -> list[Rule]:
    """All rules: identifiers and own texts before addresses, grants, titles and bare mentions."""
    out = [Rule(label, keyword, text, 5, 0.95) for label, keyword, text in TEXTS]
    out += [Rule(label, keyword, url, 5, 0.95) for label, keyword, url in URLS]
    out += [Rule(label, keyword, text, 5, 0.95) for label, keyword, text in HEADERS + BODIES + EXCEPTIONS]
    out += [Rule(label, keyword, text, 2, 0.7) for label, keyword, text in GRANTS]
    out += [Rule(label, keyword, name, 3, 0.8) for label, keyword, name in NAMES]
    for base, keyword, title, ids in FAMILIES:
        # With its tail a rule is longer than without, so that only the former stays.
        for end, tail in TAILS.items() if base in SHORT else [("", "")]:
            label = base + end
            out += [
                Rule(label, "spdx", f"spdx licen[sc]e identifier (?:{ids}){tail}", 6, 1.0),
                Rule(label, keyword, f"{GRANT}{title}{tail}", 4, 0.9),
                Rule(label, keyword, f"{title}{tail}", 3, 0.8),
                Rule(label, "licen", f"licen[sc]e (?:is )?(?:{ids}){tail}", 2, 0.7),
            ]
            if base in SHORT:
                short = f"(?:gnu )?{SHORT[base]}{tail}"
                out += [Rule(label, base[:-4], f"{GRANT}{short}", 4, 0.9), Rule(label, base[:-4], short, 3, 0.8)]
    for part, words in CC_PARTS.items():
        short = part.replace("-", " ")
        for version in CC_VERSIONS:
            number = version.replace(".", " ")
            label = f"cc-{part}-{version}"
            out += [
                Rule(label, "creative", f"creative commons {words}(?: \\d)? (?:international |unported |generic )?(?:public )?(?:licen[sc]e )?(?:version |v ?)?{number}", 5, 0.95),
                Rule(label, "creativecommons", f"creativecommons org licenses {short} {number}", 6, 1.0),
                Rule(label, f"cc {short}", f"{GRANT}(?:an? )?cc {short} {number}", 4, 0.9),
                Rule(label, f"cc {short}", f"cc {short} {number}", 3, 0.8),
            ]
        out.append(Rule(f"cc-{part}", f"cc {short}", f"cc {short}", 2, 0.6))
    out += [Rule(label, keyword, mention, 1, 0.5) for label, keyword, mention in MENTIONS]
    return [r._replace(pattern=f"(?<= )(?:{r.pattern})(?= )") for r in out]


def needed(rule: Rule) -> str:
    """A string without which the rule cannot match: "licen", or a plain part of the pattern around its keyword, or the keyword."""
    plain, depth = "", 0
    for piece in re.findall(r"\\.|\[[^]]*\]|\.\{[^}]*\}\??|.\?|\(\?<?[:=]|\)\??|.", rule.pattern.removeprefix("(?<= )(?:").removesuffix(")(?= )")):
        depth += piece.startswith("(") - piece.startswith(")")
        plain += piece if depth == 0 and len(piece) == 1 and piece not in ")|." else "|"
    parts = [p for p in plain.split("|") if "licen" in p or rule.keyword in p]
    return "licen" if any("licen" in p for p in parts) else max(parts, key=len, default=rule.keyword)


def needs(chosen: list[Rule]) -> list[str]:
    """Strings of which every text that a rule can match holds one."""
    every = {needed(r) for r in chosen}
    return sorted(n for n in every if not any(o != n and o in n for o in every))


def gate(chosen: list[Rule]) -> str:
    """The same as an expression, parted by first letters."""
    by_first: dict[str, list[str]] = {}
    for n in needs(chosen):
        by_first.setdefault(n[0], []).append(n[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_first.items())


def words_of(text: Column) -> Column:
    """Lower-case words (A-Z only) with single spaces, one more at either end; a null is a text without words."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, NOT_WORD, " ")), F.lit(" "))


def rule_words(text: Column, norm: Column) -> Column:
    """The words that rules are tried on: a + after a number reads plus, and each operand of an SPDX expression has the tag before it."""
    tagged = F.when(text.contains("SPDX-"), F.regexp_replace(text, SPDX_OPERAND, "$1 SPDX-License-Identifier: ")).otherwise(text)
    marked = F.when(tagged.contains("+"), F.regexp_replace(tagged, r"(?<=[0-9])\+(?![0-9A-Za-z])", " plus ")).otherwise(tagged)
    return F.when(text.contains("SPDX-") | text.contains("+"), words_of(marked)).otherwise(norm)


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _base(norm: Column, n_words: Column) -> dict[str, Column]:
    """Count, first and last start of each phrase, by the parts between its occurrences."""
    parts = {p: F.when(norm.contains(f" {p} "), F.split(norm, f"(?<= ){p}(?= )")).otherwise(F.array(F.lit(""))) for p in BASE_PHRASES}
    n = {p: F.size(x) - 1 for p, x in parts.items()}
    first = [F.when(n[p] > 0, _spaces(F.element_at(x, 1)) - 1) for p, x in parts.items()]
    last = [F.when(n[p] > 0, n_words - (_spaces(F.element_at(x, -1)) - 1) - F.lit(len(p.split()))) for p, x in parts.items()]
    labels = F.array_compact(F.array(*[F.when(n[p] > 0, F.lit(label)) for p, label in BASE_PHRASES.items()]))
    return {"n_base": sum(n.values(), F.lit(0)).cast("long"), "first_word": F.least(*first).cast("long"), "last_word": F.greatest(*last).cast("long"), "base": F.array_sort(labels)}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, outside of generated code, which hundreds of rules would make too large."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The array of what its elements up to each give combined, in as many passes as its size has digits."""

    def passes(start: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(start), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.aggregate(steps, start, lambda acc, step: F.transform(acc, lambda x, i: F.when(i >= step, combine(F.get(acc, i - step), x)).otherwise(x)))

    return _let(values, passes)


def _quoted(text: str) -> str:
    """A raw string of SQL; rules have no quotation marks."""
    return f"r'{text}'"


def _detections(said: Column, chosen: list[Rule]) -> Column:
    """Every match of every rule whose keyword occurs, as (a, b, priority, label, confidence)."""
    # Hundreds of rules are said in one piece of SQL each, as every call from Python takes its time.
    fields = ((r.pattern, r.priority, r.label, r.confidence) for r in chosen)
    table = F.expr("array(" + ", ".join(f"named_struct('pattern', {_quoted(p)}, 'priority', {n}, 'label', {_quoted(label)}, 'confidence', {c}D)" for p, n, label, c in fields) + ")")
    by_keyword: dict[str, list[int]] = {}
    for k, r in enumerate(chosen):
        by_keyword.setdefault(r.keyword, []).append(k)
    tries = (f"IF(contains(text, {_quoted(word)}), array({', '.join(f'regexp_extract_all(text, {_quoted(chosen[k].pattern)}, 0)' for k in ks)}), array_repeat(array(''), 0))" for word, ks in by_keyword.items())
    places = (f"IF(contains(text, {_quoted(word)}), array({', '.join(map(str, ks))}), array_repeat(0, 0))" for word, ks in by_keyword.items())

    tried = F.expr(f"get(transform(array(said), text -> arrays_zip(concat({', '.join(places)}), concat({', '.join(tries)}))), 0)")
    tried = F.transform(tried, lambda t: F.struct(t["0"].alias("rule"), t["1"].alias("found")))

    def matches(text: Column, rule: Column, found: Column) -> Column:
        lengths = F.transform(found, F.char_length)
        gaps = F.slice(F.transform(F.split(text, rule["pattern"], -1), F.char_length), F.lit(1), F.size(found))
        ends = _running(F.zip_with(gaps, lengths, lambda gap, n: gap + n), lambda x, y: x + y)
        return F.zip_with(ends, lengths, lambda end, n: F.struct((end - n).alias("a"), end.alias("b"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence")))

    hit = F.filter(tried, lambda t: F.size(t["found"]) > 0)
    return F.flatten(F.transform(hit, lambda t: matches(said, F.element_at(table, t["rule"] + 1), t["found"])))


def _unsuppressed(found: Column) -> Column:
    """What no detection of a higher priority contains, nor a longer one of the same priority.

    In order of start (the longer first) a detection is contained in one before it if the
    furthest end so far reaches its own; of the first ones to get there the start counts.
    """
    levels = sorted({r.priority for r in rules()})
    reach = lambda end, start: F.struct(end.alias("end"), (-start).alias("back"))
    none = reach(F.lit(-1), F.lit(0))

    def swept(rows: Column) -> Column:
        # For each priority, the furthest end so far and the earliest start of one that gets there.
        fronts = [_running(F.transform(rows, lambda d: F.when(d["priority"] == p, reach(d["b"], d["a"])).otherwise(none)), lambda x, y: F.greatest(x, y)) for p in levels]  # noqa: B023

        def free(d: Column, *so_far: Column) -> Column:
            higher = F.greatest(F.lit(-1), *(F.when(F.lit(p) > d["priority"], f["end"]).otherwise(F.lit(-1)) for p, f in zip(levels, so_far, strict=True)))
            own = F.coalesce(*(F.when(d["priority"] == p, f) for p, f in zip(levels, so_far, strict=True)))
            return (higher < d["b"]) & (own == reach(d["b"], d["a"]))

        zipped = F.arrays_zip(rows.alias("d"), *(f.alias(f"f{k}") for k, f in enumerate(fronts)))
        kept = F.filter(zipped, lambda z: free(z["d"], *(z[f"f{k}"] for k in range(len(levels)))))
        return F.transform(kept, lambda z: z["d"])

    order = F.array_sort(F.transform(found, lambda d: F.struct(d["a"].alias("a"), (-d["b"]).alias("z"), (-d["priority"]).alias("y"), d.alias("d"))))
    return _let(F.transform(order, lambda o: o["d"]), swept)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs: words, base places and labels, all labels, a score, and the detections that stay.

    Offsets of detections are characters of the words that rules are tried on (`rule_words`). A null or empty text
    has no words, no labels and score 0; equal detections of two rules both count;
    repeated rows are scanned as often as they occur; very long texts are scanned whole,
    in time that grows with their length; other columns are ignored.
    """
    chosen = rules()
    rows = docs.select(F.col("doc_id").cast("long"), "text", words_of(F.col("text")).alias("norm"))
    norm, said = F.col("norm"), F.col("said")
    rows = rows.withColumn("said", F.coalesce(rule_words(F.col("text"), norm), norm))
    rows = rows.withColumn("n_words", F.when(norm == "  ", F.lit(0)).otherwise(_spaces(norm) - 1).cast("long"))
    # A plain search for each string is several times faster than one expression for all.
    passed = F.expr(" OR ".join(f"contains(said, {_quoted(n)})" for n in needs(chosen)))
    empty = F.expr("CAST(array() AS array<struct<a:int,b:int,priority:int,label:string,confidence:double>>)")
    rows = rows.withColumn("found", F.when(passed, _detections(said, chosen)).otherwise(empty))
    rows = rows.select("doc_id", "n_words", *(c.alias(k) for k, c in _base(norm, F.col("n_words")).items()), _unsuppressed(F.col("found")).alias("detections"))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("base"), F.transform("detections", lambda d: d["label"]))))
    best = F.array_max(F.transform("detections", lambda d: d["confidence"]))
    score = F.greatest(F.when(F.col("n_base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)), F.coalesce(best, F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "detections")
