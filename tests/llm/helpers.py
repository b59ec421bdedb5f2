"""Small tables and brute-force twins for the text operators."""
import hashlib
import itertools
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, kept boolean, sha string, _position bigint"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def odd_documents():
    """Nulls, empty and long texts, repeated rows, ties, and columns that have the names the operators use inside."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    long = "\n".join(sentence(rng, 12) for _ in range(1500))
    texts = [None, "", "   \n\t", "one", base, base, base.upper(), base + " ", long, long + " end", None, "Ünïcödé ßtraße Σας İ " * 20, "a b c", "a  b\nc",
             "x" * 30000, "%%% *** " * 60, base + " tail words here", "it's we'll <|endoftext|> <| 12"]
    ids = [0, 1, 2, 3, 4, 4, 6, 7, 8, 9, None, 11, 12, 13, 14, 15, 16, None]
    return [(i, t, "en", None, None, 7, True, "s", 1) for i, t in zip(ids, texts)]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_groups(docs):
    """Smallest id of each document's group, from all pairs. ``docs`` maps ids to texts."""
    sets = {k: shingles(t) for k, t in docs.items()}
    root = {k: k for k in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    holders = {}
    for k, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(k)
    pairs = {p for v in holders.values() for p in itertools.combinations(sorted(v), 2)}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in docs}, sets


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
