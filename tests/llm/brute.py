"""Plain versions of operators, for small tables."""

import re
from html.parser import HTMLParser

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def smallest_reachable(ids, linked):
    """Component of each id: the smallest id reachable through pairs for which ``linked`` holds."""
    of = {i: i for i in ids}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    order = sorted(ids)
    for n, i in enumerate(order):
        for j in order[:n]:
            a, b = root(i), root(j)
            if a != b and linked(i, j):
                of[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_duplicates(texts, percent=85):
    """{id: text} -> {id: (n_shingles, component)}."""
    sets = {i: shingles(t) for i, t in texts.items()}

    def linked(i, j):
        a, b = sets[i], sets[j]
        if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return False
        return 100 * len(a & b) >= percent * len(a | b)

    return {i: (len(sets[i]), c) for i, c in smallest_reachable(sets, linked).items()}


def near_vectors(vectors, least=0.9):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    at = {i: k for k, i in enumerate(ids)}
    parts = smallest_reachable(ids, lambda i, j: near[at[i], at[j]])
    return {i: (int(near[at[i]].sum()), parts[i]) for i in ids}


class Article(HTMLParser):
    """The blocks inside <article>, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.hidden, self.blocks = 0, 0, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.hidden += tag in ("footer", "nav", "script", "style") or (tag == "div" and ("class", "ad") in attrs)
        if tag in ("p", "h1", "article", "footer"):
            self.blocks.append([])
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.hidden -= tag in ("footer", "nav", "script", "style", "div")  # the pages have no other div
        if tag in ("p", "h1", "article"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside and not self.hidden:
            self.blocks[-1].append(data)

    @classmethod
    def text(cls, page):
        parser = cls()
        parser.feed(page)
        parser.close()
        blocks = (" ".join("".join(b).split()) for b in parser.blocks)
        return "\n\n".join(b for b in blocks if b)
