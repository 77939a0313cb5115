"""Plain versions of the operators' results, one row at a time."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import public_tokenizers
import xxhash


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ids32(ids) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def op1(docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for d, text in docs:
        ids = lib.encode(text or "", add_bos=True, add_eos=True)
        yield d, len(ids), sha(ids32(ids)), sha(lib.decode(ids).encode())


def token_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(token_ids, "lib"):
        token_ids.lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*token_ids.lib.encode(text or "", add_special_tokens=False).ids, 2]


def op2_pieces(docs, size=1024):
    for d, text in docs:
        ids = token_ids(text)
        cut = len(ids) % size or size
        starts = [0, *range(cut, len(ids), size)]
        for i, s in enumerate(starts):
            part = ids[s : cut if i == 0 else s + size]
            yield d, i, s, len(part), zlib.crc32(ids32(part))


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def op3(docs):
    prints = [(d, print_of(t)) for d, t in docs]
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = {}
    for d, f in prints:
        distinct.setdefault(f, []).append(d)
    keys = list(distinct)
    for i, a in enumerate(keys):
        for o in distinct[a][1:]:
            x, y = sorted((find(distinct[a][0]), find(o)))
            root[y] = x
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(distinct[a][0]), find(distinct[b][0])))
                root[y] = x
    return [(d, f"{f:016x}", find(d)) for d, f in prints]


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def first_of_near_copies(docs):
    """The smallest id, null as a million, of each group linked by five-word Jaccard of 0.8 or more."""
    groups = [{i} for i in range(len(docs))]
    for i, (_, a) in enumerate(docs):
        for j in range(i):
            if groups[i] is not groups[j] and jaccard(a or "", docs[j][1] or "") >= 0.8:
                groups[i] |= groups[j]
                for k in groups[i]:
                    groups[k] = groups[i]
    return sorted(min(10**6 if docs[k][0] is None else docs[k][0] for k in g) for i, g in enumerate(groups) if i == min(g))


def op8(docs):
    groups = defaultdict(list)
    norm = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for d, t in docs:
        groups[norm(t)].append(d)
    return [(d, max(groups[norm(t)]), len(groups[norm(t)]), d == max(groups[norm(t)]), sha(norm(t).encode())) for d, t in docs]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def op10(docs):
    for d, text in docs:
        spans, counts = [], []
        for k, (kind, (pattern, ok)) in enumerate(BASE.items()):
            own = [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if ok(m[0])]
            counts.append(len(own))
            spans += own
        yield d, *counts, sha(",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(spans)).encode())
