"""The keyword gate of the license scan passes every rule that matches."""

import itertools
import random
import re
from re import _parser as regex

from palimpsest.llm import licenses


def spelled(tree):
    """Strings matched by a parsed expression: every way of each part, the other parts as they come first."""
    parts = []
    for op, value in tree:
        if op is regex.LITERAL:
            parts.append([chr(value)])
        elif op is regex.IN:
            parts.append([chr(v) for o, v in value if o is regex.LITERAL] or ["x"])
        elif op is regex.SUBPATTERN:
            parts.append(spelled(value[3]))
        elif op is regex.BRANCH:
            parts.append([x for way in value[1] for x in spelled(way)])
        else:
            assert op is regex.MAX_REPEAT
            parts.append(([""] if value[0] == 0 else []) + spelled(value[2]))
    if len(ways := list(itertools.islice(itertools.product(*parts), 513))) <= 512:
        return ["".join(x) for x in ways]
    lead = [p[0] for p in parts]
    return ["".join([*lead[:i], x, *lead[i + 1 :]]) for i, p in enumerate(parts) for x in p]


def test_gate_passes_every_alternative():
    rules = licenses.hand_written()
    gated, whole = licenses.Scanner(rules), licenses.Scanner(rules)
    whole.gate = lambda text: list(range(len(rules)))
    told = 0
    for number, rule in enumerate(rules):
        for text in spelled(regex.parse(rule.pattern)):
            assert re.fullmatch(rule.pattern, text)
            assert number in gated.gate(f" {text} "), (rule.label, text)
            if number % 5 == 0 or rule.priority < 5:
                assert gated.scan(text.encode()) == whole.scan(text.encode())
            told += 1
    assert told > len(rules)


def test_labels_of_optional_words():
    scanner = licenses.Scanner(licenses.hand_written())
    for text, label in (
        ("for non-commercial use only", "non-commercial"), ("Not for commercial use.", "non-commercial"),
        ("for research use only", "research-only"), ("Unauthorized use of this material", "proprietary"),
        ("It may be copied freely.", "free-unknown"), ("released under the license", "license-reference"),
        ("see licence for details", "license-reference"), ("I hereby dedicate this work to the public domain", "public-domain"),
        ("Creative Commons Attribution-Non-Commercial", "cc-by-nc"),
        ("Creative Commons Attribution Share Alike", "cc-by-sa"),
    ):
        assert label in scanner.scan(text.encode())["labels"].split(","), text


def test_rules_without_keywords_always_run():
    rules = [licenses.Rule("any", r"(?:ab|cd)?\w+ x", 1, 0.5), licenses.Rule("either", "(?:first|second) grant", 1, 0.5)]
    scanner = licenses.Scanner(rules)
    assert scanner.scan(b"zz x")["labels"] == "any"
    assert scanner.scan(b"a second grant")["labels"] == "either"
    assert scanner.gate(" a third grant ") == [0]


def plain_scan(text, rules):
    """Labels and score by every rule on every text, and every detection against every other."""
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)
    flat = " " + " ".join(w.decode("latin-1") for w in words) + " "
    found = set()
    for number, rule in enumerate(rules):
        for match in re.finditer(f"(?<= ){rule.pattern}(?= )", flat):
            start = flat[: match.start()].count(" ") - 1
            found.add((start, start + 1 + match.group().count(" "), rule.priority, number))

    def first(a, b):  # the order in which equal intervals are settled
        return (-a[2], a[3]) < (-b[2], b[3])

    def loses(a):
        return any(b != a and b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2] and ((b[0], b[1]) != (a[0], a[1]) or first(b, a)) for b in found)

    left = [d for d in found if not loses(d)]
    base = [label for phrase, label in licenses.BASE.items() if f" {phrase} " in flat]
    labels = ",".join(sorted({rules[d[3]].label for d in left} | set(base)))
    return labels, max([rules[d[3]].weight for d in left] + [0.6] * bool(base), default=0.0)


def test_labels_and_score_equal_a_plain_scan():
    rules = licenses.hand_written()
    scanner, rng = licenses.Scanner(rules), random.Random(4)
    lines = [spelled(regex.parse(rng.choice(rules).pattern))[0] for _ in range(60)] + list(licenses.BASE)
    filler = ["The software is provided", "copyright (c) 2020 by them", "é ü 12-7", "licensed under the", "\n\n", "GNU, General; Public"]
    texts = ["", "12 !"] + [" ".join(rng.choice(lines if rng.random() < 0.5 else filler) for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    told = 0
    for text in texts:
        got = scanner.scan(text.encode())
        assert (got["labels"], got["score"]) == plain_scan(text, rules), text
        told += bool(got["labels"])
    assert told > 100
