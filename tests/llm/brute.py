"""Plain Python versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LATE = 1 << 62


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def substring(rows, window=13):
    first, cut = {}, []
    for d, t in rows:
        w = SPACE_WORDS.findall(t or "")
        d = LATE if d is None else d
        cut.append((d, w))
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, w in cut:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((None if d == LATE else d, len(w), len(gone), sha(" ".join(kept))))
    return out


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, size):
    w = SPACE_WORDS.findall(lower(text))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near(rows, size=4, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(range(len(rows)), links)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[comp[i]].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min(least[comp[i]], default=None)
        out.append((d, len(sets[i]), c, d == c))
    return out


BENCH_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items, window=13):
    windows = collections.defaultdict(set)
    for item, t in items:
        w = BENCH_WORDS.findall(lower(t))
        n = min(window, len(w))
        if item is not None and n:
            for i in range(len(w) - n + 1):
                windows[tuple(w[i:i + n])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for d, t in rows:
        w = BENCH_WORDS.findall(lower(t))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i:i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def bytes_repeated(rows, size=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i:i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            if seen[t[i:i + size]] > 1:
                gone[i:i + size] = [True] * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def vectors(rows, threshold=0.9):
    def good(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if good(rows[a][1]) and good(rows[b][1])
             and len(rows[a][1]) == len(rows[b][1]) and cos(rows[a][1], rows[b][1]) >= threshold - 1e-12]
    comp = components(range(len(rows)), links)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[comp[i]].append(d)
    n = collections.Counter(x for link in links for x in link)
    return [(d, n[i], min(least[comp[i]]), d == min(least[comp[i]])) for i, (d, _) in enumerate(rows)]


def token_groups(texts, byte_path, piece_path):
    """Per text: (A ids, B ids, groups as pairs of id lists), all by the libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    from kestrel.llm.bpe import _alphabet
    a = Tokenizer.from_file(byte_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    alphabet = _alphabet()
    out = []
    for t in texts:
        whole = b" " + (t or "").encode()
        ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        ba = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not t or b"".join(ba) != whole or b"".join(bb) != whole:
            out.append(([], [], []))
            continue
        ends = [[], []]
        for side, parts in enumerate((ba, bb)):
            at = 0
            for p in parts:
                at += len(p)
                ends[side].append(at)
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, x, y = [], 0, 0
        for stop in both:
            g = ([], [])
            while x < len(ia) and ends[0][x] <= stop:
                g[0].append(ia[x])
                x += 1
            while y < len(ib) and ends[1][y] <= stop:
                g[1].append(ib[y])
                y += 1
            groups.append(g)
        out.append((ia, ib, groups))
    return out


def cross_align(rows, byte_path, piece_path):
    """The contract's row for each (id, text)."""
    found = token_groups([t for _, t in rows], byte_path, piece_path)
    count = collections.Counter()
    for _, _, groups in found:
        count.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (d, _), (ia, ib, groups) in zip(rows, found):
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((d, len(ia), len(ib), len(groups), len(links), sum(count[p] == top[p[0]] for p in links),
                    sum(count[p] for p in links), sha(text) if ia else ""))
    return out


def periodic(words, least=24, times=3):
    """(start, length, period) of every run, by looking at every period."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(words, doc_id):
    import zlib
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def periodic_row(doc_id, text, plant=True):
    from fractions import Fraction
    words = SPACE_WORDS.findall(text or "")
    if plant:
        words = planted(words, doc_id)
    found = periodic(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def warc(rows):
    """The contract's row for each (page_id, html)."""
    import base64
    top = {}
    for i, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        first = top.get(h or "")
        kind = "response" if i == first else "revisit"
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if i == first else first))
    return out
