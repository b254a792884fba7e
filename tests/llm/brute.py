"""Plain versions of the operators' definitions, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from html.parser import HTMLParser

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_components(texts, width, percent):
    """texts: {id: text}; {id: smallest linked id}."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    label = {i: i for i in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(text, items, window=10):
    """(words, hit words, sorted item ids as strings)."""
    words = item_words(text)
    hit, ids = set(), set()
    for item, item_text in items:
        w = item_words(item_text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    ids.add(str(item))
    return len(words), len(hit), sorted(ids)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def poisson_count(doc_id, text, mean, ordinal=0, seed="mix"):
    key = md5(f"{'' if doc_id is None else doc_id}|{md5(text or '')}")
    u = int(md5(f"{seed}|{key}|{ordinal}|0")[:13], 16) / 2.0**52
    p = c = math.exp(-mean)
    k = 0
    while c <= u and k < 300:
        k += 1
        p *= mean / k
        c += p
    return k


def base_pii(text):
    def luhn(d):
        return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0

    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    return [(k, *m.span()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m.group())]


def base_secrets(text):
    text = text or ""
    rules = (
        ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
    )
    found = [(*m.span(), i, k) for i, (k, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m)]
    return [(k, a, b) for a, b, _, k in sorted(found, key=lambda x: (x[0], x[2]))]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


class ArticleText(HTMLParser):
    """Text of the article of a well-formed page; elements named in `gone` (tag or class) are left out."""

    inline = {"a", "b", "i", "em", "strong", "span", "br", "img", "code", "script", "style"}
    void = {"br", "img", "hr", "meta", "link", "input"}

    def __init__(self, gone):
        super().__init__(convert_charrefs=True)
        self.gone, self.article, self.skipped, self.blocks = gone, 0, [], [""]

    def handle_starttag(self, tag, attrs):
        if tag not in self.inline:
            self.blocks.append("")
        if tag in self.void:
            return
        if self.skipped:
            self.skipped.append(tag)
        elif tag in self.gone or dict(attrs).get("class") in self.gone:
            self.skipped = [tag]
        self.article += tag == "article"

    def handle_endtag(self, tag):
        if self.skipped and self.skipped[-1] == tag:
            self.skipped.pop()
        self.article -= tag == "article"
        if tag not in self.inline:
            self.blocks.append("")

    def handle_data(self, data):
        if self.article and not self.skipped:
            self.blocks[-1] += data


def article_text(html, gone=("nav", "header", "footer", "aside", "script", "style", "form")):
    parser = ArticleText(gone)
    parser.feed(html or "")
    parser.close()
    return " ".join(t for t in (" ".join(b.split()) for b in parser.blocks) if t)
