"""Plain Python twins of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind: str, word: str) -> bool:
    digits = re.sub("[^0-9]", "", word)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in word.split(".")),
            "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items())
                  for m in re.finditer(p, text or "") if valid(kind, m[0]))


def written(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def quality(text: str | None) -> dict[str, int]:
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def shingles(text: str | None, n: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall((text or "").lower())
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def near_classes(rows: list[tuple[int | None, str | None]], threshold: float = 0.8) -> list[tuple[int | None, int | None]]:
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    key = {c: min((d for d in docs if d is not None), default=None) for c, docs in least.items()}
    return sorted(((doc, key[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def base_failed(text: str | None) -> bool:
    counts = quality(text)
    return counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]


def near_groups(texts: list[str | None]) -> list[list[int]]:
    """The places of the texts of each class; texts without words stand alone."""
    groups = defaultdict(list)
    for i, least in near_classes(list(enumerate(texts))):
        groups[least].append(i)
    return list(groups.values())


def redacted(text: str | None) -> str:
    text, out, at, merged = text or "", [], 0, []
    for a, _, b, kind in base_spans(text):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out.append(text[at:a] + f"[{kind.upper()}]")
        at = b
    return "".join(out) + text[at:]
