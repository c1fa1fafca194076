"""Small documents and brute-force versions of operators."""

import random
import re

import xxhash


def corpus(seed=5, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    common, passage = line(9), line(40)
    texts = []
    for _ in range(n):
        t = [line(rng.randint(1, 25)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.3:
            t.insert(rng.randint(0, len(t)), common)
        if rng.random() < 0.3:
            t.append(passage[rng.randint(0, 20) :])
        texts.append("\n".join(t))
    for k in range(15):  # copies and near copies
        t = texts[k]
        texts.append(t)
        words = t.split(" ")
        words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(" ".join(words))
    texts += [None, "", " \n\t", "A", "a", "12 34", "ab " * 4000, "x" * 5000, "é" * 400, "the end" * 60 + passage, "\n\n"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3 - 40, texts[k]) for i, k in enumerate(order)]


def lines_by_brute_force(rows):
    out, earlier = {}, []
    for i, t in sorted(rows):
        kept = []
        for line in (t or "").split("\n"):
            words = frozenset(line.encode().lower().split())
            if not words or not any(5 * len(words & e) >= 4 * len(words | e) for e in earlier):
                kept.append(line)
            if words:
                earlier.append(words)
        out[i] = "\n".join(kept)
    return out


def fingerprint_by_brute_force(t):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", data)
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    ones = [sum(xxhash.xxh64_intdigest(s, seed=42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components_by_brute_force(nodes, linked):
    label = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return label


def spans_by_brute_force(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        cover = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                cover[s : s + length] = b"\1" * length
            seen.add(w)
        runs = [[m.start(), m.end()] for m in re.finditer(b"\1+", bytes(cover))]
        out[i] = (len(data), sum(b - a for a, b in runs), runs, bytes(c for c, x in zip(data, cover) if not x))
    return out
