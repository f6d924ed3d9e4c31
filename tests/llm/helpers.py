"""Documents with the cases that every operator must survive."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string"

WORDS = "the cat sat on a mat while rain fell over hills and dogs ran far away from old town houses".split()


def sentence(i, n=30):
    return " ".join(WORDS[(i * 7 + j * j + j * i) % len(WORDS)] + (str(i) if j % 5 == 0 else "") for j in range(n))


def texts():
    long = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
    base = sentence(1, 60)
    return [None, "", " \n\t ", "one", "two words", "Ünïcode façade 日本語 😀", base, base, base.upper(), base + " tail", sentence(2), sentence(3), long, long, "same " * 500, "12345 !!! ...", "line\nline\nline"]


def docs(spark, rows=None):
    """Extra columns have names that operators use themselves."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x") for i, t in enumerate(rows)], DOCS)


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def components(sets, percent):
    """Smallest id reachable by links, by comparing all pairs."""
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
