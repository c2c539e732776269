"""Plain Python versions of what operators compute."""

from collections import Counter


def shingles(text, k=5):
    """The multiset of k-word shingles of a text, lower-cased; a shorter text is one shingle."""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "").lower()).split(" ") if w]
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def jaccard(a, b):
    common = sum((a & b).values())
    return common / max(1, sum(a.values()) + sum(b.values()) - common)


def classes(docs, least=0.8):
    """id -> smallest id of its class; docs: (id, text). Single linkage over all pairs."""
    bags = [(i, shingles(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in bags}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(a, b):
        a, b = sorted((root(a), root(b)))
        parent[b] = a

    by_shingle = {}
    for n, (_, bag) in enumerate(bags):
        for s in bag:
            by_shingle.setdefault(s, []).append(n)
    seen = set()
    for group in by_shingle.values():
        for x in range(len(group)):
            for y in range(x):
                a, b = group[x], group[y]
                if (b, a) not in seen:
                    seen.add((b, a))
                    if jaccard(bags[a][1], bags[b][1]) >= least:
                        join(bags[a][0], bags[b][0])
    return {i: root(i) for i in parent}


def words_of(text):
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    out, run = [], ""
    for c in (text or "").lower():
        if c.isascii() and not c.isalnum():
            if run:
                out.append(run)
            run = ""
        else:
            run += c
    return out + [run] * bool(run)


def tiling(text, item, k=5):
    """Words of item covered by greedy string tiling, by the definition: the longest match of unmarked words, again and again."""
    a, b = words_of(text), words_of(item)
    free_a, free_b = [True] * len(a), [True] * len(b)
    covered = 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return covered, len(b)
        for x in range(n):
            free_a[i + x] = free_b[j + x] = False
        covered += n
