"""Scalar functions on messages: keyword patterns, spans, summaries, labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int>>"
#: Services by port that reports name.
PORT_NAMES = {20: "FTP", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 80: "HTTP", 110: "POP3", 111: "RPC", 123: "NTP", 135: "MS RPC", 139: "NetBIOS", 143: "IMAP", 161: "SNMP", 389: "LDAP", 443: "HTTPS", 445: "SMB", 465: "SMTPS", 587: "SMTP", 993: "IMAPS", 995: "POP3S", 1433: "MS SQL", 1521: "Oracle", 2049: "NFS", 3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL", 5900: "VNC", 6379: "Redis", 8080: "HTTP", 8443: "HTTPS", 9200: "Elasticsearch", 27017: "MongoDB"}
SEVERITIES = ("low", "medium", "high", "critical")


def keyword_pieces(keyword: str) -> list[str]:
    r"""Literal parts of a keyword between its ``*``; ``\*`` and ``\\`` are the characters themselves."""
    tokens = re.findall(r"\\[*\\]|\*|[^*\\]+|\\", keyword)
    pieces, current = [], ""
    for token in [*tokens, "*"]:
        if token == "*":
            pieces.append(current)
            current = ""
        else:
            current += token[1] if token in (r"\*", r"\\") else token
    return [p for p in pieces if p]


def _quoted(text: str) -> str:
    return re.sub(r"([^\w\s]|_)", lambda m: "\\" + m[1] if m[1] in r"\.[]{}()<>*+-=!?^$|&~#/" else m[1], text)


def keyword_regex(keywords: list[str]) -> str:
    """A case-blind pattern (one that Java and Python read alike) for any of the keywords, longest first."""
    ordered = sorted(keywords, key=lambda k: (-len(k), k))
    if not ordered or not all(map(keyword_pieces, ordered)):
        raise ValueError("each keyword must have something to look for")
    return "(?iu)(?:" + "|".join(r"[^\n]*?".join(map(_quoted, keyword_pieces(k))) for k in ordered) + ")"


def rule_line(service: Column, message: Column) -> Column:
    """What keyword rules read: ``service: message``, or the message alone."""
    return F.when(service.isNotNull() & (service != ""), F.concat(service, F.lit(": "), message)).otherwise(message)


def folded(text: Column) -> Column:
    """Text in which a plain word stands as its lowercase letters wherever a case-blind pattern would find it."""
    # The characters beyond ASCII that such a pattern takes for i, s and k.
    for letter, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def has_keyword(keywords: tuple[str, ...], line: Column, plain: Column) -> Column:
    """Whether a line, given as it is and folded, has any of the keywords.

    A word of ASCII characters is looked for as it stands; of other keywords the longest such
    piece goes first, and only where it is found the pattern decides.
    """
    found = F.lit(False)
    for keyword in keywords:
        pieces = keyword_pieces(keyword)
        ascii_pieces = sorted((p for p in pieces if p.isascii()), key=len)
        there = F.contains(plain, F.lit(ascii_pieces[-1].lower())) if ascii_pieces else F.lit(True)
        found |= there if ascii_pieces == pieces[:1] == pieces else there & line.rlike(keyword_regex([keyword]))
    return found


def spans_array(*parts: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")) for a, b in parts])


def no_spans() -> Column:
    return F.expr(f"CAST(array() AS {SPANS})")


def span_of(message: Column, key: Column) -> Column:
    """Span of the first place of key in message, in code points; empty where there is none."""
    at = F.position(key, message)
    return F.when(at > 0, spans_array((at - 1, at - 1 + F.char_length(key)))).otherwise(no_spans())


def port_span(message: Column, port: Column) -> Column:
    """Span of the number in ``DPT=port`` as a word of its own."""
    digits = port.cast("string")
    whole = F.concat(F.lit(r"(?sU)^(.*?)(?<!\w)DPT="), digits, F.lit(r"(?!\w)"))
    before = F.regexp_extract_all(message, whole, F.lit(1))
    start = F.char_length(F.get(before, F.lit(0))) + 4
    return F.when(F.size(before) > 0, spans_array((start, start + F.char_length(digits)))).otherwise(no_spans())


def merge_spans(spans: Column) -> Column:
    """Sorted spans, those that overlap or touch made one."""

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), no_spans(), add)


def spans_to_json(spans: Column) -> Column:
    """``[[start,end],...]``"""
    return F.to_json(F.transform(spans, lambda s: F.array(s["start"], s["end"])))


def spans_from_json(text: Column) -> Column:
    return F.transform(F.from_json(text, "array<array<int>>"), lambda p: F.struct(p[0].alias("start"), p[1].alias("end")))


def pattern_spans(message: Column, prefix_length: Column, line: Column, patterns: list[tuple[str, bool]]) -> Column:
    """Merged spans, in message, of every match of the patterns.

    (pattern, True) is looked for in the line, whose first ``prefix_length`` characters
    come before the message and are cut off; (pattern, False) in the message alone.
    """
    compiled = [(re.compile(p), in_line) for p, in_line in patterns]

    @F.pandas_udf(SPANS)
    def find(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for messages, prefixes, lines in batches:
            out = []
            for text, prefix, whole in zip(messages, prefixes, lines, strict=True):
                found = []
                for pattern, in_line in compiled:
                    shift = int(prefix) if in_line else 0
                    for m in pattern.finditer((whole if in_line else text) or ""):
                        if m.end() > m.start() and m.end() > shift:
                            found.append((max(m.start() - shift, 0), m.end() - shift))
                merged: list[list[int]] = []
                for a, b in sorted(found):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                out.append([{"start": a, "end": b} for a, b in merged])
            yield pd.Series(out)

    return find(message, prefix_length, line)


def highlight_segments(message: Column, spans: Column) -> Column:
    """The message cut at every span's edges: (text, n) with the number of spans over each piece."""
    size = F.char_length(message)
    clipped = F.transform(spans, lambda s: F.struct(F.least(F.greatest(s["start"], F.lit(0)), size).alias("start"), F.least(F.greatest(s["end"], F.lit(0)), size).alias("end")))
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), size), F.transform(clipped, lambda s: s["start"]), F.transform(clipped, lambda s: s["end"]))))
    pairs = F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(
        F.filter(pairs, lambda p: p["b"] > p["a"]),
        lambda p: F.struct(F.substring(message, p["a"] + 1, p["b"] - p["a"]).alias("text"), F.size(F.filter(clipped, lambda s: (s["start"] <= p["a"]) & (s["end"] >= p["b"]))).alias("n")),
    )


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def top_severity(severities: Column) -> Column:
    """The most severe of an array; null for an empty one."""
    best = F.array_max(F.transform(severities, severity_rank))
    return F.when(best > 0, F.element_at(F.array(*map(F.lit, SEVERITIES)), best.cast("int")))


def render_summary(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` in the template replaced by columns; ``{{`` and ``}}`` are braces."""
    parts: list[Column] = []
    for token in re.findall(r"\{\{|\}\}|\{\w+\}|[^{}]+", template):
        if token in ("{{", "}}"):
            parts.append(F.lit(token[0]))
        elif token[0] == "{":
            parts.append(F.coalesce(values[token[1:-1]].cast("string"), F.lit("")))
        else:
            parts.append(F.lit(token))
    return F.concat(*parts) if parts else F.lit("")


def source_name(path: Column) -> Column:
    """The bare file name of a path, at most 255 characters; ``upload`` where nothing is left."""
    bare = F.trim(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)$", 1))
    return F.when(bare == "", F.lit("upload")).otherwise(F.left(bare, F.lit(255)))


def port_label(port: Column) -> Column:
    """``3389 (RDP)`` for a known port, else the number."""
    names = F.create_map(*[F.lit(x) for k, v in PORT_NAMES.items() for x in (k, v)])
    name = F.try_element_at(names, port.cast("int"))
    return F.when(name.isNull(), port.cast("string")).otherwise(F.concat(port.cast("string"), F.lit(" ("), name, F.lit(")")))
