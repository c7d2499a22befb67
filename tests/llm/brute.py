"""Plain-Python versions of the corpus operators' contracts, for small inputs only."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def near(rows, k=2, percent=80):
    """{doc_id: (n_shingles, component_id)} for (doc_id, text) rows with distinct ids."""
    sets = {}
    for d, t in rows:
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    common = Counter(p for ds in where.values() for p in combinations(sorted(ds), 2))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def substrings(rows, window=13):
    """{doc_id: (n_words, n_removed, kept_sha256)}."""
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def token_ids(tokenizer_file, rows, end):
    """{doc_id: ids with the end id}."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file)
    return {d: t.encode(x or "", add_special_tokens=False).ids + [end] for d, x in rows}


def crc_ids(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text):
    """Base spans (start, order of kind, kind, end)."""
    out = []
    for order, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def damaged(rows):
    """Rows (conv_id, turn, role, text) by conversation after the damage that crc32 of conv_id:turn picks, in order."""
    out = {}
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        role, text = name(role), name(text)
        fault = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        here = out.setdefault(conv, [])
        if fault == 4:
            role = "user"
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault:
            here += [(turn, role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())) for c, x in out.items()}


def repaired(rows):
    """Counts, cost, audit and digest of one conversation: least-cost search over (rows read, initials so far), cheapest and then least audit first."""
    space = " \t\n\x0b\x0c\r"
    faults, seen = [], set()
    for turn, role, text in rows:
        body = text.strip(space)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    grammar = re.compile("(s?(ua)+)?")
    heap, best = [(0, "", 0, ())], None
    reached = set()
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        initials = "".join(r[:1] or "-" for r, _ in made)
        if i == len(rows) and grammar.fullmatch(initials):
            best = (cost, audit, made)
            break
        state = (i, initials[-1:] or "")
        if (state, cost, audit) in reached or not (grammar.fullmatch(initials) or grammar.fullmatch(initials + "a") or grammar.fullmatch(initials + "ua")):
            continue
        reached.add((state, cost, audit))
        for role in ("user", "assistant"):
            if not audit.endswith("III"):
                heapq.heappush(heap, (cost + 5, audit + "I", i, made + ((role, ""),)))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, made))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, made + (rows[i][1:],)))
                for role in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, made + ((role, rows[i][2]),)))
    cost, audit, made = best
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def hard_negatives(rows, scale=256, every=50, positives=5, negatives=3, low=50, high=95):
    """Sorted (anchor, positive, rank, negative, positive score, negative score) of (id, vector, label) rows."""
    ready = [
        (i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    for a, (i, v, label) in enumerate(ready):
        if i is None or i % every:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w))
        others = [(score(w), j, other == label) for b, (j, w, other) in enumerate(ready) if b != a]
        for top, positive, _ in sorted((x for x in others if x[2]), key=order)[:positives]:
            fit = [x for x in others if not x[2] and low * top <= 100 * x[0] <= high * top]
            out += [(i, positive, n + 1, j, top, s) for n, (s, j, _) in enumerate(sorted(fit, key=order)[:negatives])]
    return sorted(out, key=repr)
