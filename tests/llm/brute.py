"""The contracts of the operators in plain Python, row by row, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(rows, size=13):
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text)."""
    rank = lambda i: math.inf if i is None else i
    words = [(doc, WORD.findall(text or "")) for doc, text in rows]
    least = {}
    for doc, ws in words:
        for i in range(len(ws) - size + 1):
            key = tuple(ws[i : i + size])
            least[key] = min(least.get(key, math.inf), rank(doc))
    out = []
    for doc, ws in words:
        gone = set()
        for i in range(len(ws) - size + 1):
            if least[tuple(ws[i : i + size])] < rank(doc):
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(ws) if i not in gone)
        out.append((doc, len(ws), len(gone), sha(kept)))
    return out


def shingles(text, size):
    ws = WORD.findall(lowered(text or ""))
    if not ws:
        return set()
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} or {tuple(ws)}


def smallest_reached(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(rows, size=2):
    """(doc_id, n_shingles, component_id, kept); rows that share a doc_id are one node."""
    sets = [(doc, shingles(text, size)) for doc, text in rows]
    links = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                shared = len(x & y)
                if 100 * shared >= 80 * (len(x) + len(y) - shared):
                    links.append((a, b))
    root = smallest_reached({d for d, _ in sets if d is not None}, links)
    return [(d, len(x), root.get(d), d is None or root[d] == d) for d, x in sets]


def contaminated(rows, items, size=13):
    phrases = defaultdict(set)
    for item, text in items:
        ws = ALNUM.findall(lowered(text or ""))
        for i in range(max(1, len(ws) - size + 1) if ws else 0):
            phrases[tuple(ws[i : i + size])].add("" if item is None else str(item))
    lengths = {len(p) for p in phrases}
    out = []
    for doc, text in rows:
        ws = ALNUM.findall(lowered(text or ""))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(ws) - n + 1):
                key = tuple(ws[i : i + n])
                if key in phrases:
                    hit.update(range(i, i + n))
                    found |= phrases[key]
        out.append((doc, len(ws), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return out


def tokens(rows, tokenizer, end=2):
    """(doc_id, start, n_tokens, ids_crc32) in ascending doc_id order, ties by text."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def base_secrets(text):
    """kind:start:end of the fixed patterns, in code points."""
    found = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.IGNORECASE | re.ASCII):
        if len(m.group(2)) >= 12:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for order, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 18), (2, "hex", r"[0-9a-f]+", 16)):
        for m in re.finditer(pattern, text):
            if len(m.group()) >= least:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def vectors(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) of rows with different ids."""
    good = []
    for vec, values, label in rows:
        usable = vec is not None and label is not None and values and all(v is not None and math.isfinite(v) for v in values) and any(values)
        if usable:
            norm = math.hypot(*values)
            good.append((vec, [v / norm for v in values], label))
    links = []
    for i, (a, x, la) in enumerate(good):
        for b, y, lb in good[:i]:
            if a != b and la == lb and len(x) == len(y) and sum(p * q for p, q in zip(x, y)) >= threshold:
                links.append((a, b))
    root = smallest_reached({r[0] for r in rows if r[0] is not None}, links)
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return [(v, count[v], root.get(v), v is None or root[v] == v) for v, _, _ in rows]


def targets(sizes, weights=(1, 2, 3), most=3):
    """Target of each source, from {source: size}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free} if free else {}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return {s: share.get(s, most * sizes[s]) for s in order}
        capped |= above


BLANKS = " \t\n\x0b\x0c\r"


def common_lines(rows, min_docs=10, min_chars=1):
    """(doc_id, n_lines, n_dropped, kept) of (doc_id, text); each row is a document."""
    key = lambda line: lowered(line.strip(BLANKS))
    split = [(doc, (text or "").split("\n")) for doc, text in rows]
    seen = defaultdict(int)
    for _, lines in split:
        for k in {key(line) for line in lines}:
            seen[k] += 1
    bad = {k for k, n in seen.items() if n >= min_docs and len(k) >= min_chars}
    kept = [(doc, lines, [line for line in lines if key(line) not in bad]) for doc, lines in split]
    return [(doc, len(lines), len(lines) - len(rest), "\n".join(rest)) for doc, lines, rest in kept]


def leaf(fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _up(nodes, at):
    """Levels above ``nodes`` to one node; gives it and the (before, after) steps of each place in ``at``."""
    steps = {p: [] for p in at}
    places = {p: p for p in at}
    while len(nodes) > 1:
        for p, q in places.items():
            first = q // 3 * 3
            steps[p].append(("".join(nodes[first:q]), "".join(nodes[q + 1 : first + 3])))
            places[p] = q // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], steps


def merkle(rows, tampered):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text)."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), leaf(tampered(r)), r[0]))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops, ways = [], []
    for name in names:
        by_source[name].sort(key=lambda x: x[:3])
        top, steps = _up([x[2] for x in by_source[name]], range(len(by_source[name])))
        tops.append(top)
        ways.append(steps)
    if not tops:
        return []
    root, above = _up(tops, range(len(tops)))
    out = []
    for i, name in enumerate(names):
        for p, (*_, own, node, doc) in enumerate(by_source[name]):
            path = ways[i][p] + above[i]
            for before, after in path:
                node = sha(before + node + after)
            out.append((doc, own, tops[i], root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


def runs(words, min_length=12):
    """(start, length, period) of all maximal repetitions, by comparing all pairs of places."""
    n, found = len(words), {}
    for q in range(1, n):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j > i and j - i + q >= max(min_length, 2 * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, size, q) for (a, size), q in found.items())


def collapsed(words, found):
    gone = {i for a, size, q in found for i in range(a + q, a + size)}
    return " ".join(word for i, word in enumerate(words) if i not in gone)
