"""Plain Python versions of the corpus operators, and the small tables that the tests share."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, digest string, body string, label string, ranges string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = " ".join(f"word{i * i % 97} and{i % 13}" for i in range(160))
OTHER = " ".join(f"term{i * 7 % 101} or{i % 17}" for i in range(160))
LONG = " ".join(f"long{i % 4001} text{i * 31 % 997}" for i in range(60_000))

#: nulls, empty, blank, long and periodic texts, exact and near copies, shared passages, non-ASCII, odd white space
TEXTS = [
    None, "", "   \n\t", "one", "one two", "One  two\n", PROSE, PROSE, PROSE + " ", PROSE.replace("word9 ", "other "), PROSE.upper(),
    OTHER, "before " + OTHER[:900] + " after " + PROSE[300:1200], "x " * 400, "ab" * 300, LONG, LONG[:5000] + " end", "é" * 150 + "ß中 " + PROSE[:400],
    PROSE[:700] + OTHER[:700], OTHER[:700] + PROSE[:700], "\x1c\x85 odd\u2003space \0 nul <|endoftext|> end", "tie tie tie", "tie tie tie",
]


def table(spark, texts=None, ids=None):
    texts = TEXTS if texts is None else texts
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, [None, "en", "de"][n % 3], None if n % 4 == 0 else "s", None, "x", None, "y", None, "z") for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(text):
    return WORD.findall(text or "")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def byte_repeats(docs, span):
    """{id: (n_bytes, n_removed, n_spans, kept)} for (id, text) pairs."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - span + 1):
            key = hashlib.blake2b(raw[p : p + span], digest_size=12).digest()
            if key in seen:
                gone[p : p + span] = b"\1" * span
            seen.add(key)
        out[i] = (len(raw), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), bytes(c for c, g in zip(raw, gone, strict=True) if not g))
    return out


def word_repeats(docs, width):
    """{id: (n_words, n_removed, kept)}."""
    first, out = {}, {}
    for i, text in sorted(docs):
        w = words(text)
        gone = [False] * len(w)
        keys = [tuple(w[p : p + width]) for p in range(len(w) - width + 1)]
        for p, key in enumerate(keys):
            if first.get(key, i) < i:
                gone[p : p + width] = [True] * width
        for key in keys:
            first.setdefault(key, i)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def near(docs, width, percent=80):
    """{id: (n_shingles, component, kept)}."""
    sets = {}
    for i, text in docs:
        w = words((text or "").translate(LOWER))
        sets[i] = {tuple(w[p : p + width]) for p in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


def pieces(tokenizer, docs, end, limit):
    """{(id, piece): (start, length, crc)}."""
    out = {}
    for i, text in docs:
        raw = ids_of(tokenizer, text, end)
        for k, at in enumerate(range(0, len(raw), 4 * limit)):
            own = raw[at : at + 4 * limit]
            out[i, k] = (at // 4, len(own) // 4, zlib.crc32(own))
    return out


def tiling(doc, item, least):
    """Words of an item that greedy tiling covers, by trying every pair of places again and again."""
    d, t = [re.findall(r"[A-Za-z0-9\x80-\U0010FFFF]+", (x or "").translate(LOWER)) for x in (doc, item)]
    used_d, used_t, covered = [False] * len(d), [False] * len(t), 0
    least = min(least, len(t))
    while t:
        best = (0, 0, 0)
        for p in range(len(d)):
            for q in range(len(t)):
                n = 0
                while p + n < len(d) and q + n < len(t) and d[p + n] == t[q + n] and not used_d[p + n] and not used_t[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            break
        used_d[p : p + n] = used_t[q : q + n] = [True] * n
        covered += n
    return covered, len(t)


def by_sequence(packed):
    out = defaultdict(list)
    for r in packed:
        out[r["sequence_id"]].append((r["offset"], r["length"]))
    return out
