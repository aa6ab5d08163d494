"""Small corpora and brute-force versions."""

import random
import re

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
LOWER = {i: i + 32 for i in range(65, 91)}


def low(text):
    return (text or "").translate(LOWER)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def documents(spark, rows, parts=3):
    """Rows of (doc_id, text[, lang[, source]]) in the columns of documents, in fixed partitions."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or "")) for r in rows]
    return spark.createDataFrame(spark.sparkContext.parallelize(full, parts), DOCUMENTS)


def odd_rows():
    """Nulls, empties, ties, repeated rows, very long texts, odd characters."""
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (None, None),
        (6, "x" * 70_000), (7, "word " * 20_000), (8, "é 日本 🙂  \x1c end "), (9, "A B C D E F G"), (10, "0" * 150 + "!" * 150),
    ]


def near_copies(seed, n=300, size=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20, 40, 80, 200]))] for _ in range(size)]
    rows = []
    for i in range(n):
        b = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            if b:
                p, k = r.randrange(len(b)), r.random()
                if k < 0.4:
                    b[p] = r.choice(vocabulary)
                elif k < 0.7:
                    b.insert(p, r.choice(vocabulary).upper())
                else:
                    del b[p]
        rows.append((i, " \n".join(b)))
    return rows


def shingles(text, k):
    w = words(text)
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked_components(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def repeats(rows, depth):
    seen, out = set(), []
    for _, text in rows:
        b = (text or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            w = b[p : p + depth]
            if w in seen:
                covered[p : p + depth] = b"\1" * depth
            seen.add(w)
        out.append((len(b), sum(covered), sum(1 for j in range(len(b)) if covered[j] and not (j and covered[j - 1])), bytes(x for x, c in zip(b, covered) if not c)))
    return out


def hits(text, items, n):
    """n_words, hit words, items, by comparing every window with every position."""
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))

    w, hit, found = split(text), set(), set()
    for item, said in items:
        v = split(said)
        for window in ([v[i : i + n] for i in range(len(v) - n + 1)] if len(v) >= n else [v] if v else []):
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
    return len(w), len(hit), found
