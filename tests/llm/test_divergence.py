"""Source divergence: against a plain count, with digests so short that they collide, in small blocks, with odd rows."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from prefmine.llm import divergence
from prefmine.llm.words import slices
from tests.llm.brute import LOWER
from tests.llm.conftest import LONG

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, min_docs=10, top=10):
    """Rows of the audit of (lang, source, text) rows."""
    rows = [tuple(v or "" for v in r) for r in rows]
    count, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        words = TERM.findall(text.translate(LOWER))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in {r[0] for r in rows}:
        sources = {r[1] for r in rows if r[0] == lang}
        kept = [w for w, n in docs[lang].items() if n >= min_docs]
        whole = {w: sum(count[lang, s][w] for s in sources) for w in kept}
        shares = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}
        q, p = shares(whole), {s: shares(count[lang, s]) for s in sources}
        value = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(value(p[s][w], p[t][w]) for w in kept), t.encode(), t) for t in sources if t != s)
            terms = sorted((-value(p[s][w], q[w]), w.encode(), w) for w in kept if count[lang, s][w] and p[s][w] > q[w])[:top]
            out |= {(lang, s, "pair", t, -v, i) for i, (v, _, t) in enumerate(pairs, 1)} | {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(terms, 1)}
    return out


def audited(df, **more):
    rows = [tuple(r) for r in divergence.audit(df, **more).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    words = [a + b for a in ("ab", "ba", "É", "漢", "Zz", "q") for b in ("", "a", "b", "ba", "ü", "xyx", "yxx")]
    rows = []
    for n in range(400):
        lang, source = rng.choice(["x", "y", "y", "y"]), f"s{min(rng.randrange(30), 9)}"  # one source holds two thirds
        some = rng.sample(words, 12) if source != "s3" else words[:5]
        rows.append((lang, source, rng.choice([" ", "1", "\n"]).join(rng.choices(some, k=rng.choice([0, 1, 5, 60])))))
    return rows + [("z", "alone", "a b c"), ("z", "other", None), (None, None, "ab AB"), ("y", "empty", "12 34"), ("x", None, "ab " * 30)]


def test_audit(spark, made):
    df = spark.createDataFrame(made, "lang string, source string, text string").repartition(4)
    want = plain_audit(made)
    assert {r[2] for r in want} == {"pair", "term"} and ("z", "alone", "pair", "other", 0, 1) in want
    assert audited(df) == want


@pytest.mark.parametrize("bits", [3, 5])
def test_colliding_digests_are_split(spark, made, bits):
    df = spark.createDataFrame(made, "lang string, source string, text string").repartition(4)
    assert audited(df, bits=bits) == plain_audit(made)


def test_small_blocks_give_the_same_sums(spark, made):
    df = spark.createDataFrame(made, "lang string, source string, text string").repartition(2)
    assert audited(df, chunk=4, sources=3) == plain_audit(made)


def test_rows_of_a_task_are_emptied_when_they_grow(spark, made, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)
    df = spark.createDataFrame(made, "lang string, source string, text string").repartition(2)
    assert audited(df) == plain_audit(made)


def test_odd_rows(spark, odd, none):
    rows = [("l", "s", LONG), *[("l", f"s{i % 3}", f"tie{chr(97 + j)} ") for i in range(36) for j in range(14)], (None, "s", "x" * 50_000), ("l", "s", "")]
    df = spark.createDataFrame([(*r, None, 3) for r in rows], "lang string, source string, text string, digest string, n int").repartition(3)
    assert audited(df, min_docs=3, top=4) == plain_audit(rows, 3, 4)
    assert divergence.audit(df.limit(0)).count() == 0


def test_terms_of_bytes():
    texts = ["Ab1cÉd", "", "漢字 x", "A", "b-c"]
    found = []
    for part in slices(pa.array(texts)):
        doc, start, end, data = divergence.term_spans(part)
        found += [(int(part.first + d), data[s:e].tobytes().decode()) for d, s, e in zip(doc, start, end)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in TERM.findall(t.translate(LOWER))]
    assert len(np.unique(divergence.digests(*_all("a b c d e f g h"), 64))) == 8


def _all(text):
    part = next(slices(pa.array([text])))
    _, start, end, data = divergence.term_spans(part)
    return data, start, end
