"""Plain versions that results are held against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, n=5):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(n, links):
    """For each of 0..n-1 the smallest it reaches."""
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links:
        i, j = find(i), find(j)
        up[max(i, j)] = min(i, j)
    return [find(i) for i in range(n)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
