"""Plain single-process versions of the operators, for small fixtures."""

import collections
import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return WORD.findall((text or "").encode())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def substring_dedup(rows, size):
    """{doc_id: (n_words, n_removed, kept_sha256)} of (doc_id, text)."""
    first, gone = {}, collections.defaultdict(set)
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for s in range(len(w) - size + 1):
            if first.setdefault(tuple(w[s:s + size]), (i, s)) != (i, s):
                gone[i].update(range(s, s + size))
    return {i: (len(w := words(t)), len(gone[i]), sha(b" ".join(x for p, x in enumerate(w) if p not in gone[i]))) for i, t in rows}


def line_dedup(rows, min_words):
    """{doc_id: (n_lines, n_removed, kept text)} of (doc_id, text): every run with the words, of any length, that occurs earlier."""
    first, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = (t or "").encode().split(b"\n")
        solid = [(p, x.strip(), len(WORD.findall(x))) for p, x in enumerate(lines) if x.strip()]
        gone = set()
        for a in range(len(solid)):
            n = 0
            for b in range(a, len(solid)):
                n += solid[b][2]
                if n >= min_words:
                    run = tuple(s[1] for s in solid[a:b + 1])
                    if run in first:
                        gone.update(s[0] for s in solid[a:b + 1])
                    first.add(run)
        out[i] = (len(solid), len(gone), b"\n".join(x for p, x in enumerate(lines) if p not in gone).decode())
    return out


def shingle_set(text, size):
    w = [x.translate(LOWER) for x in words(text)]
    return set(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else {tuple(w)} if w else set()


def classes(rows, size, threshold):
    """{doc_id: (n_shingles, component)} of (doc_id, text), by comparing all pairs."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def quality(rows):
    """{doc_id: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, suspect, kept)} of (doc_id, text, host)."""
    out = {}
    for i, t, _ in rows:
        t = t or ""
        w = words(t)
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {p for s in range(len(w) - 2) if seen[tuple(w[s:s + 3])] > 1 for p in range(s, s + 3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")]
        chars = len(b"".join(w).decode())
        symbols = sum(c in "#*$%&|<>" for c in t)
        out[i] = (len(w), chars, symbols, len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w), 100 * len(rep) > 30 * len(w) or 100 * symbols > 10 * chars)
    hosts = collections.defaultdict(list)
    for i, _, h in rows:
        hosts[h].append(out[i][5])
    shares = [sum(v) / len(v) for v in hosts.values()]
    m = sum(shares) / len(shares)
    v = sum((s - m) ** 2 for s in shares) / (len(shares) - 1) if len(shares) > 1 else 0
    weight = m * (1 - m) / v - 1 if v > 0 and m * (1 - m) > v else 2.0
    bad = {h for h, f in hosts.items() if 100 * (sum(f) + m * weight) / (len(f) + weight) > 50}
    return {i: (*out[i], not (out[i][5] or (h in bad and out[i][6]))) for i, _, h in rows}


def normal(text):
    b = "".join(c.lower() if c < "Ā" else c for c in text or "").encode()
    return re.sub(rb"[^0-9a-z\x80-\xff]+", b" ", b).strip()


def edits_inside(pattern, text):
    """Fewest edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)
