"""Plain Python versions of the corpus operators' base results."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else (lambda x: x - 9 if x > 9 else x)(2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text: str) -> dict:
    t = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    spans = [(m.start(), list(kinds).index(k), k, m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, t) if ok(m[0])]
    spans.sort()
    out = {f"n_{k}": sum(s[2] == k for s in spans) for k in kinds}
    return out | {"base_sha256": hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()}


def all_spans(text: str) -> tuple[str, str]:
    """Spans and scores of all kinds, as op4 returns them."""
    from tidemark.llm import pii as P

    t = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
        "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])", lambda m: int("".join(str(int(c, 36)) for c in (lambda x: x[4:] + x[:4])(m.replace(" ", "")))) % 97 == 1),
        "secret": (P.SECRET, lambda m: True),
        "account": (P.ACCOUNT, lambda m: True),
    }
    found = []
    for rank, (kind, (pattern, ok)) in enumerate(checks.items()):
        for m in re.finditer(pattern, t):
            if not ok(m[0]):
                continue
            near = t[max(0, m.start() - 40) : m.start()]
            marked = kind == "secret" and re.match("AKIA|ASIA|gh[opsu]_|sk-", m[0])
            score = (700 if marked else P.PRIOR[kind]) + 300 * bool(re.search(P.NEARBY[kind], near)) - 300 * bool(re.search(P.AGAINST[kind], near))
            found.append((m.start(), rank, kind, m.end(), max(0, min(1000, score))))
    kept = [x for x in found if x[1] < 4 or (x[2] != "account" and x[4] >= 600)]
    kept += [x for x in found if x[2] == "account" and x[4] >= 600 and not any(y[0] < x[3] and x[0] < y[3] for y in kept)]
    kept.sort()
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b, _ in kept), ",".join(str(x[4]) for x in kept)


def lowered(text: str | None) -> list[str]:
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def decontamination(docs: list[tuple], items: list[tuple]) -> dict:
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = lowered(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = {}
    for doc, text in docs:
        w = lowered(text)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def substring_dedup(docs: list[tuple]) -> dict:
    """doc_id -> (n_words, n_removed, sha256), for distinct ids."""
    said = {d: WORD.findall(t or "") for d, t in docs}
    first: dict[tuple, int] = {}
    for d in sorted(said):
        for k in range(len(said[d]) - 12):
            first.setdefault(tuple(said[d][k : k + 13]), d)
    out = {}
    for d, w in said.items():
        hit = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < d:
                hit.update(range(k, k + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in hit)
        out[d] = (len(w), len(hit), hashlib.sha256(kept.encode()).hexdigest())
    return out


def suffix_dedup(docs: list[tuple], n: int = 400) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of each row."""
    data = [(t or "").encode() for _, t in docs]
    seen: dict[bytes, int] = {}
    for b in data:
        for k in range(len(b) - n + 1):
            h = hashlib.blake2b(b[k : k + n], digest_size=12).digest()
            seen[h] = seen.get(h, 0) + 1
    out = []
    for (d, _), b in zip(docs, data, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[hashlib.blake2b(b[k : k + n], digest_size=12).digest()] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edits(a: list, b: list, share: float) -> int | None:
    """Edits between two word lists, or None above ``share`` of the longer one."""
    most = int(share * max(len(a), len(b), 1) + 1e-9)
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return None
    d = distance(a, b)
    return d if d <= most else None
