"""Plain single-process statements of what the operators return."""

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def secrets(text):
    text = text or ""
    spans = []
    pattern = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for m in pattern.finditer(text):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 18:
            spans.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 16:
            spans.append((m.start(), 2, m.end(), "hex"))
    spans.sort()
    n = Counter(s[3] for s in spans)
    said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(said.encode()).hexdigest()


def repeats(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) for each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    chars, symbols = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), chars, symbols, dup, len(inside), failed


def licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    found = []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def shingle_counts(words, size=5):
    return Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else Counter()


def contamination(docs, items, similarity=0.8):
    """{(doc_id, item_id): best similarity} over item-sized windows."""
    out = {}
    held = [(i, WORD.findall(low(t or ""))) for i, t in items]
    for doc_id, text in docs:
        words = WORD.findall(low(text or ""))
        own = set(shingle_counts(words)) | set(words)
        for item_id, item in held:
            size = min(5, len(item))
            want = shingle_counts(item, size)
            if not words or not item or (size == 5 and not own & set(want)):
                continue
            for s in range(max(0, len(words) - len(item)) + 1):
                got = shingle_counts(words[s : s + len(item)], size)
                shared = sum((got & want).values())
                alike = shared / (sum(got.values()) + sum(want.values()) - shared)
                if alike >= similarity and alike > out.get((doc_id, item_id), 0):
                    out[doc_id, item_id] = alike
    return out
