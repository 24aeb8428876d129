"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib

import xxhash

WS = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def crc(s):
    return zlib.crc32((s or "").encode())


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOW))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, distance=4):
    """prints: [(doc_id, fingerprint)] -> component ids in the same order."""
    label = [d for d, _ in prints]
    big = float("inf")
    label = [big if x is None else x for x in label]
    near = [[j for j, (_, q) in enumerate(prints) if (p ^ q).bit_count() <= distance] for _, p in prints]
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            m = min(label[j] for j in js)
            if m < label[i]:
                label[i], changed = m, True
    return [None if x == big else x for x in label]


def substring(docs, window=13):
    """docs: [(doc_id, text)] -> [(doc_id, n_words, n_removed, sha)]."""
    key = lambda d: float("inf") if d is None else d
    first, cut = {}, [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in cut:
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            first[g] = min(first.get(g, float("inf")), key(d))
    out = []
    for d, w in cut:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < key(d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    text = text or ""
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
           "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
           "card": [], "phone": []}
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out["phone"].append(m.span())
    return out, sha(",".join(f"{k}:{a}:{b}" for k in out for a, b in out[k]))


def secrets(text):
    text = text or ""
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = {"assign": [m.span() for m in assign.finditer(text) if len(m[2]) >= 6],
           "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
           "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]}
    flat = sorted((a, i, k, b) for i, k in enumerate(out) for a, b in out[k])
    return out, sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in flat))


def edited(docs):
    """docs: [(doc_id, text)] -> {doc_id: (edited text, next text)}, distinct ids."""
    rows = sorted(docs, key=lambda r: -r[0])
    out = {}
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        third = len(t) // 3
        out[d] = (t[:len(t) - third] + n[:third], n)
    return out


def winnow(text, k=4, w=8, chunk=16):
    """Positions that winnowing selects, by definition, and their grams."""
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,%d}" % chunk, text or "")
    if not tokens:
        return [], tokens
    return tokens, [tokens[i:i + k] for i in range(max(1, len(tokens) - k + 1))]


def lines(docs, min_chars=10):
    key = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            k = x.strip(WS).translate(LOW)
            if len(k) >= min_chars:
                first[k] = min(first.get(k, float("inf")), key(d))
    out = []
    for d, t in docs:
        all_ = (t or "").split("\n")
        keep = [x for x in all_ if len(k := x.strip(WS).translate(LOW)) < min_chars or first[k] == key(d)]
        out.append((d, len(all_), len(all_) - len(keep), sha("\n".join(keep))))
    return out


def plain_words(text):
    low = (text or "").translate(LOW)
    return WORD.findall("".join(c for c in low if c not in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))


def contained(docs, items, n=5, least=0.8):
    out = []
    for d, t in docs:
        w = plain_words(t)
        for item, s in items:
            v = plain_words(s)
            if not v:
                continue
            k = min(n, len(v))
            a = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)}
            b = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
            if len(a & b) >= least * len(a) - 1e-9:
                out.append((d, item, len(a), len(a & b)))
    return out
