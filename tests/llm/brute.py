"""Plain versions of what the operators compute, for small tables."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def similar(rows, num=4, den=5):
    """{id: (class id, links)} of (id, text) rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    linked = collections.defaultdict(set)
    ids = sorted(sets)
    where = collections.defaultdict(list)
    for i in ids:
        for s in sets[i] or {None}:
            where[s].append(i)
    pairs = {(a, b) for group in where.values() for n, a in enumerate(group) for b in group[n + 1 :]}
    for a, b in pairs:
        if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            linked[a].add(b)
            linked[b].add(a)
    label = {}
    for i in ids:
        if i not in label:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in label:
                    label[x] = i
                    stack += linked[x]
    return {i: (label[i], len(linked[i])) for i in ids}


def text_classes(texts):
    """{text: class} by links of texts."""
    texts = sorted(set(texts))
    found = similar(list(enumerate(texts)))
    return {t: found[i][0] for i, t in enumerate(texts)}


def similar_rows(rows, num=4, den=5):
    """{id: (class id, links)} of rows that may repeat an id: links from each set of an id to each set of any id, itself aside."""
    nodes = sorted({(i, frozenset(shingles(t or ""))) for i, t in rows}, key=lambda n: (n[0], sorted(n[1])))
    linked = [[b for b, (_, y) in enumerate(nodes) if b != a and (den * len(x & y) >= num * len(x | y))] for a, (_, x) in enumerate(nodes)]
    same = [[b for b, n in enumerate(nodes) if n[0] == m[0]] for m in nodes]
    label, out = list(range(len(nodes))), {}
    for _ in nodes:
        label = [min(label[b] for b in [a, *linked[a], *same[a]]) for a in range(len(nodes))]
    for a, (i, _) in enumerate(nodes):
        out[i] = (nodes[label[a]][0], out.get(i, (0, 0))[1] + len(linked[a]))
    return out


def form(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = WORD.findall(text)
    places = collections.defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            n = sum(c in "0123456789" for c in m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 13 <= n <= 19 and luhn(m[0]), "phone": lambda: 9 <= n <= 15}
            if good[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out
