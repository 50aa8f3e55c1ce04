"""Features of the toxicity and quality operators against plain loops; hosts with user parts and repeated ids in the URL filter."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("memlattice.llm")
from memlattice.llm import quality, toxicity  # noqa: E402
from memlattice.llm.url_filter import filter_urls  # noqa: E402

LEARNED, BEGINS = frozenset({"blorp", "übel"}), frozenset({"grumb"})


def texts():
    rng = random.Random(2)
    words = ["You", "vous", "tú", "idiot", "1d10t", "$tupid", "s.h.i.t", "BLORP", "bl0rp,", "Übel!", "grumbling", "GRUMBLE", "fine", "fine", "day", "D4Y", "OK", "I", "中文", "...", "!!", "?", "#@", "don't", "x1", "42", "É"]
    made = [rng.choice([" ", "\t", "\n", "  ", " "]).join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(120)]
    return ["", " ", "a", "\n\t", "ab", "é", "you idiot", "x " * 5000 + "idiot you", *made, "same same same", "", "x"]


def loop_features(text):
    """What Features.of gives for one text, word by word and byte by byte."""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    looks = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""}
    told = []
    for w in words:
        runs = re.findall(r"[^\W\d_]+", w.lower())
        core = max(runs, key=len) if runs else ""
        edge = w.lower().strip(".,;:!?\"'()[]{}")
        odd = bool(edge) and not edge.isalpha()
        clear = "".join(looks.get(c, c) for c in edge)
        told.append({
            "lex": core in toxicity.INSULTS, "word": core in LEARNED, "begin": core[:5] in BEGINS, "person": core in toxicity.YOU,
            "hidden": odd and clear != core and (clear in toxicity.INSULTS or clear in LEARNED), "mixed": odd and any(c.isalpha() for c in edge), "caps": len(core) > 1 and w.isupper(),
        })
    hits = [i for i, t in enumerate(told) if t["lex"] or t["word"] or t["begin"] or t["hidden"]]
    close = sum(any(told[j]["person"] for j in range(max(0, i - 4), min(len(told), i + 5)) if j != i) for i in hits)
    raw = text.encode()
    n, size = len(words), len(raw)
    share = lambda v, of: v / (of + 20)
    of = lambda name: sum(t[name] for t in told)
    out = [math.log1p(n), math.log1p(size)]
    for name in ("lex", "word", "begin", "person", "hidden"):
        out += [math.log1p(of(name)), share(of(name), n)]
    out += [math.log1p(len(hits)), share(len(hits), n), math.log1p(close), share(close, n), share(of("caps"), n), share(of("mixed"), n)]
    marks = [b for b in raw if 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in "!?.,"]
    out += [share(sum(65 <= b <= 90 for b in raw), size), share(sum(b in b"!?" for b in raw), size), share(len(marks), size), share(sum(48 <= b <= 57 for b in raw), size)]
    return [*out, size / n if n else 0]


def test_toxicity_features_against_a_loop():
    docs = texts()
    made = toxicity.Features(LEARNED, BEGINS)
    got = made.of(pa.array(docs))
    assert got.shape == (len(docs), toxicity.FEATURES)
    want = np.array([loop_features(t) for t in docs])
    assert np.allclose(got, want) and (want[:, 2:] > 0).any(axis=0).all()  # each feature is met
    assert np.allclose(made.of(pa.array(docs[::-1])), want[::-1])  # words remembered from the last call


def test_quality_counts_against_a_loop():
    docs = texts()
    got = quality._counts(pa.array(docs))
    for row, text in zip(got, docs, strict=True):
        raw, want = text.encode(), np.zeros(quality.BUCKETS + 1)
        for i in range(len(raw) - 2):
            want[quality._TABLE[raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16]] += 1
        words = re.findall("[^\x20\x09-\x0d]+", text)
        want[-1] = quality.REPEAT * sum(a == b for a, b in zip(words, words[1:], strict=False))
        assert (row == want).all()
    assert got[:, -1].any()


def test_hosts_with_user_parts_and_repeated_or_null_pages(spark):
    """A user part stays in the host as the contract cuts it; each row of a repeated or null id is judged."""
    rows = [(1, "http://me@good.com/a"), (1, "http://me@good.com/a"), (None, "http://example.com/en/7"), (None, None), (2, "http://x.org/es/1"), (2, "http://ok.org/es/1?x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for good in ([(1, 1), (1, 0), (2, 0), (None, 1)], []):
        out = filter_urls(pages, spark.createDataFrame(good, "page_id long, good int")).collect()
        assert sorted((r["page_id"] or 0, r["host"], r["rule"] or "") for r in out) == sorted([(1, "me@good.com", ""), (1, "me@good.com", ""), (0, "example.com", "example.com/en/7"), (0, "", ""), (2, "x.org", "org/es/"), (2, "ok.org", "org/es/")])
        assert all(r["verdict"] in ("allow", "block") for r in out)
        assert len({r["verdict"] for r in out if r["host"] == "me@good.com"}) == 1
