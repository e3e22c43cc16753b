"""Small fixtures with awkward rows, and plain versions of the operators."""

import collections
import hashlib
import random
import re

WHITE = b" \t\n\r\x0b\x0c"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def corpus() -> list[tuple]:
    """(doc_id, text, ...): nulls, empty and long texts, repeated rows, copies, shared lines and passages."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgé漢") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line, passage = "This is the Shared License line", prose(60)
    texts = [None, "", " \t\n", "one", "two words", prose(12), prose(13), "\n\n" + line + "\r\n" + prose(40), prose(3000)]
    texts += [prose(80) + "\n  " + line.upper() + " \n" + prose(5) for _ in range(6)]
    texts += [prose(30) + "\n" + passage + "\n" + prose(20) for _ in range(5)]
    copy = prose(120)
    texts += [copy, copy, copy + " " + prose(1), copy.upper(), line + "\n" + line, "x" * 5000, "a\x0bb\x0cc\x1cd\x85e"]
    rows = [(i * 3 + 1, t, "en", "src%d" % (i % 3), len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[10], rows[10], (None, passage, None, None, None), (None, line, "de", None, 3)]


def frame(spark, rows=None, extra: bool = False):
    df = spark.createDataFrame(corpus() if rows is None else rows, DOCS)
    if extra:  # names that operators might use inside
        for name in ("key", "pos", "h1", "kept", "score", "fingerprint", "root", "hash", "stats", "chunk"):
            df = df.selectExpr("*", f"'{name}' AS {name}")
    return df


def same(df, expected, key=repr):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)


def drop_lines(rows) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, sha) of each row; a null id is the smallest."""
    low = lambda d: -(2**63) if d is None else d
    key = lambda x: x.strip(WHITE).lower()
    holders = collections.defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").encode().split(b"\n"):
            if len(key(x).decode()) >= 20:
                holders[key(x)].add(low(d))
    last = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for d, t, *_ in rows:
        all_ = (t or "").encode().split(b"\n")
        kept = [x for x in all_ if last.get(key(x), low(d)) == low(d)]
        out.append((d, len(all_), len(all_) - len(kept), sha(b"\n".join(kept))))
    return out


def drop_windows(rows, window=13) -> list[tuple]:
    """(doc_id, n_words, n_removed, sha) of each row; a null id is the largest."""
    high = lambda d: 2**63 - 1 if d is None else d
    words = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, high(None)), high(d))
    out = []
    for d, w in words:
        gone = {i + j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < high(d) for j in range(window)}
        out.append((d, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def fingerprint(text, size=3) -> int:
    import xxhash

    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int], radius=2) -> list[int]:
    """Index of the first print of each one's component."""
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(prints))]


def similar_groups(texts: list, size=5, least=0.8) -> list[int]:
    """Index of the first text of each one's group: texts linked by sharing so much of their distinct shingles."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {None}:
            holders[x].append(i)
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, s in enumerate(sets):
        common = collections.Counter(b for x in s or {None} for b in holders[x] if b < a)
        for b, n in common.items():
            if not s or n >= least * (len(s) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(texts))]


def rule_counts(text) -> tuple:
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))


_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text) -> tuple:
    t, found = text or "", []
    found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(t) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    found.sort()
    kinds = ("assign", "access", "hex")
    return (*[sum(k == j for _, k, _ in found) for j in range(3)], sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found).encode()))
