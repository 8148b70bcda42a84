"""Plain Python versions of the operators, for small fixtures."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def repeated_bytes(rows):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} of (doc_id, text) rows with distinct ids."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i:i + 100]
            if w in seen:
                gone[i:i + 100] = b"\1" * 100
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def dedup_lines(rows, least=16, short=False):
    """{(doc_id, text): (kept text, dropped)}; ids are distinct, or rows repeat whole."""
    out, seen, brief = {}, collections.defaultdict(list), set()
    for d, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for line in t.split("\n"):
            x = line.strip(" \t\n\v\f\r")
            if len(x) < least:
                if not (short and x in brief):
                    kept.append(line)
                if x:
                    brief.add(x)
                continue
            if not any(within_one(x, y) for n in (len(x) - 1, len(x), len(x) + 1) for y in seen[n]):
                kept.append(line)
            if x not in seen[len(x)]:
                seen[len(x)].append(x)
        out[(d, t)] = ("\n".join(kept), t.count("\n") - "\n".join(kept).count("\n") + (1 if not kept and t else 0))
    return out


def shingle_set(text, n=5):
    w = WORD.findall(text or "")
    return {" ".join(w)} if 0 < len(w) < n else {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)}


def classes(items, linked):
    """(number of links, smallest item reachable) of every position."""
    n = len(items)
    links = [[j for j in range(n) if j != i and linked(items[i][1], items[j][1])] for i in range(n)]
    label = list(range(n))
    moved = True
    while moved:
        moved = False
        for i in range(n):
            low = min([label[i]] + [label[j] for j in links[i]], key=lambda k: items[k][0])
            if items[low][0] < items[label[i]][0]:
                label[i], moved = low, True
    return [(len(links[i]), items[label[i]][0]) for i in range(n)]


def similar(a, b, threshold=0.8):
    return bool(a) and bool(b) and len(a & b) >= threshold * len(a | b) - 1e-9


def mix(rows, weights=(5, 2, 1), most=3, seed=17):
    """{(doc_id): repeats} and targets of (doc_id, text, source) rows with distinct ids."""
    size = {d: len(WORD.findall(t or "")) for d, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(size[d] for d, _, x in rows if x == s) for s in sources}
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(sources)}
    total, clamped = sum(own.values()), set()
    while True:
        rest = total - sum(most * own[s] for s in clamped)
        open_ = sum(w for s, w in weight.items() if s not in clamped)
        more = {s for s in sources if s not in clamped and weight[s] * rest / open_ > most * own[s]}
        if not more:
            break
        clamped |= more
    target = {s: float(most * own[s]) if s in clamped else weight[s] * rest / open_ for s in sources}
    taken = {}
    for s in sources:
        whole = int(target[s] // own[s]) if own[s] else 0
        left, upto = target[s] - whole * own[s], 0
        mine = [d for d, _, x in rows if x == s]
        for d in sorted(mine, key=lambda d: (hashlib.md5(f"{seed}:{'' if d is None else d}".encode()).hexdigest(), d)):
            upto += size[d]
            taken[d] = min(most, whole + (upto - size[d] / 2 <= left)) if size[d] else 0
    return taken, target


def viterbi(text, vocab):
    """Ids of the best segmentation of a text, one code point after the other."""
    if not text:
        return []
    mark = "▁"
    t = (" " + text).replace(" ", mark)
    score = {}
    for _, codes, ids, values, _ in vocab.by_length.values():
        for row, i, x in zip(codes, ids, values):
            score["".join(map(chr, row))] = (float(x), int(i))
    best = [(0.0, 0, None)]
    for e in range(1, len(t) + 1):
        b = (best[e - 1][0] + vocab.floor, e - 1, None)
        for m in range(1, min(vocab.longest, e) + 1):
            p = score.get(t[e - m:e])
            if p and best[e - m][0] + p[0] >= b[0]:
                b = (best[e - m][0] + p[0], e - m, p[1])
        best.append(b)
    out, e = [], len(t)
    while e > 0:
        _, at, i = best[e]
        out.append([i] if i is not None else [int(vocab.byte[x]) for x in t[e - 1].encode()])
        e = at
    return [y for x in out[::-1] for y in x]


def auc(y, p):
    pairs = sorted(zip(p, y))
    rank, i, total = 0, 0, 0.0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        total += sum(1 for k in range(i, j) if pairs[k][1]) * (i + j + 1) / 2
        i = j
    n1 = sum(y)
    return (total - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))
