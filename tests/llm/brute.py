"""Plain-Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    marked = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(marked), "base_failed": n < 10 or 100 * len(marked) > 20 * n}


def _hash(spans: list[tuple[int, int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)).encode()).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii(text: str | None) -> tuple[dict, str]:
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    spans = [(m.start(), r, m.end(), k) for r, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m[0])]
    return {k: sum(s[3] == k for s in spans) for k in kinds}, _hash(spans)


def secrets(text: str | None) -> tuple[dict, str]:
    text = text or ""
    kinds = {
        "assign": (r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    }
    spans = [(m.start(), r, m.end(), k) for r, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m)]
    return {k: sum(s[3] == k for s in spans) for k in kinds}, _hash(spans)


def fingerprint(text: str | None) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids: list[int], fps: list[int], radius: int = 4) -> dict[int, int]:
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = np.array(fps, dtype=np.uint64)
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[:k] ^ f[k]) <= radius):
            a, b = find(ids[k]), find(ids[int(j)])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def overlaps(text: str, item: str, tokens, similarity: float = 0.8, least: int = 13) -> bool:
    """Whether some alignment has a long enough run with enough agreement, and five agreeing words close together."""
    a, b = tokens(text), tokens(item)
    if len(b) < 5:
        return False
    for shift in range(-len(b) + 1, len(a)):
        same = [0 <= shift + j < len(a) and a[shift + j] == b[j] for j in range(len(b))]
        for i in range(len(b)):
            for j in range(i + min(least, len(b)), len(b) + 1):
                if same[i] and same[j - 1] and sum(same[i:j]) >= similarity * (j - i) - 1e-9:
                    return True
    return False


def url(value: str | None) -> tuple[str, str]:
    if value is None or "://" not in value:
        return "", ""
    rest = value.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]
