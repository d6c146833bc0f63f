"""Cross-parsing: automata and phrase counts against plain search, predictions against a plain parse, odd rows."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from prefmine.llm import crossparse
from prefmine.llm.words import slices, text_array
from tests.llm.conftest import ODD


def plain_phrases(data, sample):
    """Longest matches one after the other, by searching the sample."""
    n = 0
    for first in range(0, len(data), crossparse.PIECE):
        piece, at = data[first : first + crossparse.PIECE], 0
        while at < len(piece):
            end = at + 1
            while end <= len(piece) and piece[at:end] in sample:
                end += 1
            at = max(at + 1, end - 1)
            n += 1
    return n


def plain_bytes(text):
    out = bytearray()
    for b in text.lower().encode():
        b = b if 97 <= b <= 122 or b >= 128 else 32
        if b != 32 or (out and out[-1] != 32):
            out.append(b)
    return bytes(out)


def plain_prediction(text, samples):
    if text is None or not any(c.isalpha() for c in text) or not samples.names:
        return "und", 0.0
    data = plain_bytes(text)
    spent = [plain_phrases(data, s) * math.log2(len(s) + 1) for s in samples.texts]
    order = sorted(range(len(spent)), key=lambda i: (spent[i], samples.names[i]))
    return samples.names[order[0]], spent[order[1]] / (spent[order[0]] + spent[order[1]]) if len(order) > 1 else 1.0


def test_the_automaton_knows_exactly_the_substrings():
    rng = random.Random(1)
    for _ in range(30):
        text = bytes(rng.choices(b"ab c", k=rng.randrange(1, 40)))
        states = crossparse.SuffixAutomaton(text).next
        assert len(states) <= 2 * len(text)
        known = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
        found, stack = set(), [(b"", 0)]
        while stack:
            word, at = stack.pop()
            found |= {word} - {b""}
            stack += [(word + bytes([b]), to) for b, to in states[at].items()]
        assert found == known


def test_phrases_equal_a_plain_search():
    rng = random.Random(2)
    samples = tuple(bytes(rng.choices(letters, k=n)) for letters, n in ((b"abc ", 300), (b"cde", 50), (b"a", 7)))
    texts = [bytes(rng.choices(b"abcdeZ \xc3", k=k)) for k in (0, 1, 2, 30, 1023, 1024, 1025, 5000, 0, 77)] + [b"a" * 3000]
    offsets = np.cumsum([0, *map(len, texts)])
    got = crossparse.Parser(samples).phrases(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert got.tolist() == [[plain_phrases(t, s) for t in texts] for s in samples]


def test_bytes_of_texts():
    texts = ["  A1b  Ç!", "", "x", " ", "漢 字—.\n\ny", "END"]
    found = []
    for part in slices(pc.utf8_lower(text_array(pa.array(texts)))):
        data, offsets = crossparse.normalised(part)
        found += [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
    assert found == [plain_bytes(t) for t in texts]


def test_predictions_equal_a_plain_parse(spark, rows, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 40").select("doc_id", "text", "lang")
    samples = crossparse.learn(docs, sample_rows=8, sample_bytes=2000)
    assert all(0 < len(t) <= 500 for t in samples.texts) and list(samples.names) == sorted(set(samples.names))
    for r in crossparse.predict(docs, samples).collect():
        lang, score = plain_prediction(r["text"], samples)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-12 and 0 < r["bits_per_byte"] < 20


def test_held_out_documents(query, spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = query("op11_languages")
    assert {r["doc_id"] for r in got} == set(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark, odd, none):
    labelled = spark.createDataFrame([("the cat and the dog", "en")] * 5 + [("el perro y el gato", "es"), (None, "es"), ("12 34", "fr"), ("words", None), ("", "en")], "text string, lang string")
    samples = crossparse.learn(labelled)
    assert samples.names == ("en", "es") and samples.texts[0].count(b"cat") == 1
    got = crossparse.predict(odd, samples)
    assert got.columns[: len(odd.columns) - 1] == [c for c in odd.columns if c != "score"]
    found = sorted((str(r["doc_id"]), str(r["text"]), r["lang_pred"], r["score"]) for r in got.collect())
    assert found == sorted((str(i), str(t), *plain_prediction(t, samples)) for i, t in ODD)
    assert crossparse.predict(none, samples).count() == 0
    nothing = crossparse.learn(labelled.limit(0))
    assert nothing == crossparse.Samples((), ()) and {r["lang_pred"] for r in crossparse.predict(odd, nothing).collect()} == {"und"}
    one = crossparse.learn(labelled.filter("lang = 'es'"))
    assert {(r["lang_pred"], r["score"]) for r in crossparse.predict(odd, one).collect()} == {("es", 1.0), ("und", 0.0)}
