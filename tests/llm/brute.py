"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")

PII = {  # as the contract writes them
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def valid(kind, t):
    digits = re.sub("[^0-9]", "", t)
    if kind == "ip":
        return all(int(p) <= 255 for p in t.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def pii(text):
    """(n_email, n_ip, n_card, n_phone, base_sha256)"""
    found = []
    for k, (kind, regex) in enumerate(PII.items()):
        found += [(m.start(), k, m.end()) for m in re.finditer(regex, text or "", re.A) if valid(kind, m.group())]
    found.sort()
    joined = ",".join(f"{list(PII)[k]}:{s}:{e}" for s, k, e in found)
    return (*[sum(x[1] == k for x in found) for k in range(4)], hashlib.sha256(joined.encode()).hexdigest())


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(w) < 50 or 100 * len(covered) > 50 * len(w),
    )


def shingles(text, size):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def near(docs, size, percent=80):
    """{doc_id: (n_shingles, component_id)} by all pairs."""
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def chat(turns):
    """(n_turns, turns_sha256, loss_chars, loss_sha256) of sorted (role, text)"""
    said = "".join(t for r, t in turns if r == "assistant")
    every = "".join(f"{r}\n{t}\n" for r, t in turns)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha(every), len(said), sha(said)
