"""Plain versions of the operators' contracts, for small fixtures."""

import hashlib
import re
from collections import Counter, defaultdict

BLANK = rb"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(BLANK, (text or "").encode()) if w]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def jaccard(rows):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text), by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        w = tuple(words((text or "").encode().lower().decode()))
        sets[doc_id] = {w[i:i + 5] for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {d: (len(sets[d]), label[d]) for d in ids}


def suffixes(rows, length=400):
    """[(doc_id, n_bytes, n_removed, n_spans, sha)] in row order."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def windows(rows, width=13):
    """{doc_id: (n_words, n_removed, sha)}."""
    texts = {d: words(t) for d, t in rows}
    first = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - width + 1):
            first.setdefault(tuple(texts[d][i:i + width]), d)
    out = {}
    for d, w in texts.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < d:
                gone.update(range(i, i + width))
        out[d] = (len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def exact(rows):
    """{doc_id: (keep_id, group_size, kept, sha)}."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").encode().lower()].append(d)
    return {d: (max(g), len(g), d == max(g), sha(k)) for k, g in groups.items() for d in g}


def quality(rows):
    """{doc_id: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)}."""
    out = {}
    for d, t in rows:
        t = t or ""
        w = [x.decode() for x in words(t)]
        wins = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        rep = {j for i in range(len(w) - 7) if wins[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        out[d] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
    return out
