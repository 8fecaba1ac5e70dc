"""Plain brute-force versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=5):
    w = words(ascii_lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def components(docs, width=5, percent=75):
    """{doc_id: (n_shingles, component)} by comparing every two documents that share a shingle."""
    sets = {d: shingles(t, width) for d, t in docs}
    index = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in index[x] if e > d).items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def removed_lines(docs, threshold=0.75):
    """{(doc_id, line_no)} of lines to which an earlier line is similar."""
    lines = [((d, i), frozenset(words(ascii_lower(x)))) for d, t in sorted((d, t) for d, t in docs if t is not None) for i, x in enumerate(t.split("\n"))]
    index, gone = defaultdict(list), set()
    for k, (key, s) in enumerate(lines):
        if not s:
            continue
        for e, n in Counter(e for x in s for e in index[x]).items():
            if n >= threshold * (len(s) + len(lines[e][1]) - n) - 1e-9:
                gone.add(key)
                break
        for x in s:
            index[x].append(k)
    return gone


def quality(text, window=5, least=10):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered by repeats of least words, longest repeat)."""
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
    counts, repeated = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            repeated.update(range(i, i + window))
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            if i != j:
                k = 0
                while max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                    k += 1
                best[i] = max(best[i], k)
    covered = {p for i, n in enumerate(best) if n >= least for p in range(i, i + n)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated), len(covered), max(best, default=0)]
