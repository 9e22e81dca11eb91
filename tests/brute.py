"""Slow answers by comparing everything with everything."""

import re
import unicodedata


def norm(text):
    out = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in (text or "").lower())
    return " ".join(out.split())


def grams(text, n):
    tokens = norm(text).split()
    return {" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}


def segments(text):
    return re.findall(r"[^.!?\n]+[.!?\n]*|[\n]+", text)


def best(segment, corpus, own=None):
    """``(doc_id, is_exact, score)`` over ``corpus`` as ``{id: text}``."""
    clean, found = norm(segment), (None, False, 0.0)
    mine = grams(clean, 2)
    for doc_id in sorted(corpus):
        if doc_id == own:
            continue
        other = norm(corpus[doc_id])
        if len(clean.split()) >= 5 and clean in other:
            return doc_id, True, 100.0
        theirs = grams(other, 2)
        if mine and theirs:
            inter = len(mine & theirs)
            score = inter / (len(mine) + len(theirs) - inter) * 100
            if score > found[2]:
                found = (doc_id, False, score)
    return found


def check(docs, corpus=None, exclude_self=True):
    corpus = docs if corpus is None else corpus
    rows = {}
    for src, text in docs.items():
        for pos, raw in enumerate(segments(text)):
            if len(norm(raw).split()) >= 3:
                rows[(src, pos)] = best(raw, corpus, src if exclude_self else None)
    return rows
