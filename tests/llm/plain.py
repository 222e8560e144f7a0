"""Plain Python versions of the operators, one document at a time."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def quality(text):
    text = text or ""
    w = text.encode().split()
    n = len(w)
    grams = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    hit = {i + k for i in range(n - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    base = (n, sum(len(x.decode()) for x in w), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
    return (*base, n < 10 or 100 * len(hit) > 20 * n)


def _listed(found):
    return sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found)))


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return _listed(out)


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return _listed(out)


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def decontaminated(docs, items, width=10):
    windows = {}
    for key, text in items:
        w = tokens(text)
        for i in range(max(1, len(w) - width + 1)) if w else []:
            windows.setdefault(tuple(w[i : i + width]), set()).add(key)
    sizes, out = {len(k) for k in windows}, {}
    for key, text in docs:
        w, hit, found = tokens(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out[key] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def repeats(docs, width, units, join):
    """(n, removed, runs, sha256 of the rest) by id; docs sorted by id."""
    seen, out = set(), {}
    for key, text in docs:
        u = units((text or "").encode())
        gone = bytearray(len(u))
        for i in range(len(u) - width + 1):
            k = join(u[i : i + width])
            if k in seen:
                gone[i : i + width] = b"\1" * width
            else:
                seen.add(k)
        kept = [u[i : i + 1] if isinstance(u, bytes) else u[i] for i in range(len(u)) if not gone[i]]
        runs = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(u)))
        out[key] = (len(u), sum(gone), runs, sha(join(kept)))
    return out


def simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))


def components(prints):
    """Smallest key reachable over distances of up to 3 bits, by key."""
    keys = list(prints)
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array([prints[k] for k in keys], np.uint64)
    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            a, b = find(k), find(keys[j])
            parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def pieces(text, tokenizer, size=2048):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    return [(k, s, len(ids[s : s + size]), zlib.crc32(np.array(ids[s : s + size], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), size))]
