"""Plain versions of what the operators return, one document at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def spans_text(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secrets(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    for rank, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 18), (2, "hex", r"[0-9a-f]+", 16)):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [(k, a, b) for a, _, b, k in sorted(out)]


def quality(text: str) -> tuple:
    words = SPACE_WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    hit = {j for i, g in enumerate(grams) if g in often for j in range(i, i + 3)}
    n = len(words)
    failed = n < 50 or 100 * len(hit) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def licenses(text: str) -> tuple:
    words = PLAIN_WORD.findall(lower(text))
    at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def decontaminate(texts: dict, items: dict) -> dict:
    index: dict[tuple, set] = {}
    for item, text in items.items():
        words = PLAIN_WORD.findall(lower(text or ""))
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            index.setdefault(tuple(words[i : i + n]), set()).add(str(item))
    out = {}
    for doc, text in texts.items():
        words = PLAIN_WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for n in {len(k) for k in index}:
            for i in range(len(words) - n + 1):
                if got := index.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= got
        out[doc] = (len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words))
    return out


def shingles(text: str | None) -> set:
    words = SPACE_WORD.findall(lower(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(texts: dict) -> dict:
    sets = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index: dict = {}
    for d, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(d)
    pairs = Counter((a, b) for ds in index.values() for i, a in enumerate(ds) for b in ds[i + 1 :])
    for (a, b), both in pairs.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def private(text: str) -> list[tuple[str, int, int]]:
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def repeated(texts: dict) -> dict:
    owner: dict = {}
    words = {d: SPACE_WORD.findall(t or "") for d, t in texts.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            owner.setdefault(tuple(words[d][i : i + 50]), d)
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - 49) if owner[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def unigram(texts: dict) -> dict:
    tokens = {d: [*SPACE_WORD.findall(lower(t or "")), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = counts.total(), len(counts)
    return {d: (held[d], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in ws)) for d, ws in tokens.items()}


def bigram(texts: dict) -> dict:
    """Scores by interpolation of all bigrams, unigrams and a uniform share, weights by powers of two of the context's count."""
    tokens = {d: [None, *SPACE_WORD.findall(lower(t or "")), None] for d, t in texts.items()}
    fold = {d: zlib.crc32(str(d).encode()) % 7 for d in texts}

    def counts(docs):
        return Counter(w for d in docs for w in tokens[d][1:]), Counter(p for d in docs for p in zip(tokens[d], tokens[d][1:], strict=False))

    (words, pairs), (less, fewer) = (counts([d for d in texts if fold[d] not in out]) for out in ((2,), (2, 3)))
    total, kept, kinds = words.total(), less.total(), len(words)
    bucket = lambda n: int(math.log2(n + 1))
    weights: dict = {b: [1 / 3] * 3 for b in range(bucket(max(words.values())) + 1)}
    held = Counter(p for d in texts if fold[d] == 3 for p in zip(tokens[d], tokens[d][1:], strict=False))
    some: set = set()
    for _ in range(50):
        sums: dict = {}
        for (c, w), n in held.items():
            b = bucket(less[c])
            parts = [x * y for x, y in zip(weights[b], (fewer[c, w] / max(1, less[c]), less[w] / kept, 1 / (kinds + 1)), strict=True)]
            sums[b] = [x + n * y / sum(parts) for x, y in zip(sums.get(b, [0] * 3), parts, strict=True)]
        new = {b: [x / sum(xs) for x in xs] for b, xs in sums.items()}
        moved = max(abs(x - y) for b in new for x, y in zip(new[b], weights[b], strict=True))
        weights |= new
        some = set(sums)
        if moved < 1e-6:
            break
    near = {b: weights[min(some, key=lambda x: (abs(x - b), x))] for b in weights}
    out = {}
    for d, ws in tokens.items():
        out[d] = 0.0
        for c, w in zip(ws, ws[1:], strict=False):
            a = [0.9999 * x + 0.0001 / 3 for x in near[bucket(words[c])]]
            out[d] += math.log10(a[0] * pairs[c, w] / max(1, words[c]) + a[1] * words[w] / total + a[2] / (kinds + 1))
    return out


def quotations(messages: dict) -> dict:
    """For each (conversation, turn): the originals of its passages, what it replies to and the thread."""

    def units(lines, own):
        blocks = [" ".join(b.lower().split()) for b in re.split(r"\n\s*\n", "\n".join(lines)) if b.split()]
        if not blocks:
            return [[], [], []]
        ends = [x for b in blocks for x in re.split(r"(?<=[.!?])\s", b)]
        return [[" ".join(blocks), *(blocks if own else [])], ends, [" ".join(x.lower().split()) for x in lines if x.split()]]

    first: dict = {}
    found: dict = {}
    for (conv, turn), text in sorted(messages.items()):
        own, passages, before = [], [], 0
        for line in text.split("\n"):
            m = re.match(r"[ \t]*(?:>[ \t]?)+", line)
            level = m[0].count(">") if m else 0
            if level and level != before:
                passages.append((level, []))
            if level and not before:
                while own and (not own[-1].strip() or own[-1].endswith("wrote:")):
                    own.pop()
            (passages[-1][1] if level else own).append(line[m.end() :] if m else line)
            before = level
        found[conv, turn] = []
        for level, lines in passages:
            got = None
            for kind, xs in enumerate(units(lines, False)):
                votes = Counter(o for x in xs if (o := first.get((conv, kind, x), turn)) < turn)
                best = min(votes, key=lambda o: (-votes[o], o), default=None)
                if got is None and best is not None and votes[best] * 2 >= len(xs):
                    got = best
            if any(units(lines, False)):
                found[conv, turn].append((level, got))
        for kind, xs in enumerate(units(own, True)):
            for x in xs:
                first.setdefault((conv, kind, x), turn)
    out: dict = {}
    for (conv, turn), passages in sorted(found.items()):
        linked = [(level, i, o) for i, (level, o) in enumerate(passages) if o is not None]
        reply = min(linked)[2] if linked else None
        out[conv, turn] = ([o for _, o in passages], reply, out[conv, reply][2] if linked else turn)
    return out
