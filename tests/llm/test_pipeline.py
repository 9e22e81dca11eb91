"""The pipeline against a plain Python version on small tables, and its language stage."""

import random
import re

import corpus_pipeline
from palimpsest.llm import binpack, pieces
from test_minhash import changed, components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def spoken(rows):
    """Without labels: texts with a letter."""
    return {i: t for i, t in rows.items() if t is not None and any(map(str.isalpha, t))}


def one_of_each(rows):
    found = components([(i, t) for i, t in rows.items()])
    return {i: t for i, t in rows.items() if found[i][1] == i}


def passages_cut(rows, size=13):
    seen, out = {}, {}
    for i, text in sorted(rows.items()):
        words = WORD.findall(text)
        for k in range(len(words) - size + 1):
            seen.setdefault(tuple(words[k : k + size]), i)
    for i, text in rows.items():
        words = WORD.findall(text)
        gone = set()
        for k in range(len(words) - size + 1):
            if seen[tuple(words[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = [w for k, w in enumerate(words) if k not in gone]
        if kept or not gone:
            out[i] = kept
    return out


def clean(rows, items, size=10):
    windows = set()
    for item in items:
        words = ALNUM.findall(item.lower())
        windows |= {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    out = {}
    for i, kept in rows.items():
        words = ALNUM.findall(" ".join(kept).lower())
        if not any(tuple(words[k : k + n]) in windows for n in {len(w) for w in windows} for k in range(len(words) - n + 1)):
            out[i] = kept
    return out


def packed(counts, capacities):
    """Plain best fit over all open bins (of equal room the one changed last): sorted lengths and final capacity of each."""
    bins = []  # [room, lengths, step of the last change]
    rest = sum(counts)
    for step, n in enumerate(sorted(counts, reverse=True)):
        rest -= n
        fits = [b for b in bins if b[0] >= n]
        if fits:
            best = min(fits, key=lambda b: (b[0], -b[2]))
        else:
            size = min((c for c in capacities if c >= n), key=lambda c: (binpack.cost(c) / min(c, n + rest), c))
            best = [size, [], 0]
            bins.append(best)
        best[0] -= n
        best[1].append(n)
        best[2] = step
    return sorted((sorted(b[1]), min(c for c in capacities if c >= sum(b[1]))) for b in bins)


def fixture():
    rng = random.Random(9)
    words = lambda n, k: [f"w{k}x{rng.randrange(400)}" for _ in range(n)]
    passage, leak = words(40, "p"), [f"question{i}" for i in range(12)]
    rows = {i: " ".join(words(rng.randrange(20, 300), i % 7)) for i in range(60)}
    rows |= {100 + i: " ".join(changed(rng, rows[i].split(), 1)) for i in range(0, 60, 4)}
    rows |= {200 + i: " ".join(words(30, i) + passage + words(30, i)) for i in range(6)}
    rows |= {300: " ".join(passage), 301: " ".join(words(20, 3) + leak + words(20, 3)), 302: "a b " + " ".join(leak[:9]),
             400: None, 401: "", 402: "12 !", 403: "x" * 5000, 404: "word " * 20000}
    return rows, [" ".join(leak).upper(), "", "tiny item"]


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows, items = fixture()
    held = [(i, t, None, "s", len(t or ""), "e") for i, t in rows.items()]
    held.append(held[5])  # a repeated row
    spark.createDataFrame(held, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = clean(passages_cut(one_of_each(spoken(rows))), items)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {}
    for r in found:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["n_tokens"]
    assert tokens == {i: len(kept) + 1 for i, kept in expected.items()}
    assert 301 not in tokens and 300 not in tokens and 302 in tokens and 200 in tokens
    bins = {}
    for r in found:
        bins.setdefault((r["bin_id"], r["bin_capacity"]), []).append(r["n_tokens"])
    top = max(binpack.CAPACITIES)
    pieces_ = [min(top, n - at) for n in tokens.values() for at in range(0, n, top)]
    assert sorted((sorted(b), c) for (_, c), b in bins.items()) == packed(pieces_, binpack.CAPACITIES)


def test_language_stage_decides_by_the_model(spark):
    rng = random.Random(3)
    en, de = ["the house and garden of her mother was there", "they have seen this other thing before"], ["das haus und der garten ist nicht hier", "wir haben dieses andere ding gesehen"]
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(6)), "en" if i % 2 else "de") for i in range(40)]
    rows += [(50, "Жили были дед и баба и была у них курочка ряба которая несла яйца " * 2, None), (51, "Жили", None),
             (52, "".join(rng.choice("qxzjkvw") for _ in range(80)), None), (53, "the garden and this house " * 20, None), (54, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = sorted(r.doc_id for r in pieces.speaking(docs, pieces.train(docs)).collect())
    assert kept == [*range(40), 51, 53]
