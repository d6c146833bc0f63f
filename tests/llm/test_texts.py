"""Words, fingerprints, line rules, quality ranking."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefmine.llm import lines, quality, sketches, style, words
from tests.llm import brute
from tests.llm.conftest import LONG, ODD


def test_words_and_shingles(rows):
    texts = [t for _, t in rows] + [t for _, t in ODD]
    found = [s for part in words.slices(pa.array(texts)) for s in words.shingle_lists(part)]
    assert [len(s) for s in found] == [len(brute.shingles(t or "")) for t in texts]
    counts = np.concatenate([np.bincount(words.words_of(p).doc, minlength=len(p.offsets) - 1) for p in words.slices(pa.array(texts))])
    assert counts.tolist() == [len(brute.WORD.findall(t or "")) for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    (part,) = words.slices(pa.array(["alpha beta alpha", "", "beta Alpha"]))
    plain, lower = words.words_of(part).hash, words.words_of(part, lower=True).hash
    assert plain[0] == plain[2] and plain[1] == plain[3] and plain[0] != plain[4] and lower[0] == lower[4]


def test_sketch_estimates(rows):
    texts = [t for _, t in rows]
    found = sketches.sketches(pa.array(texts))
    sets = [brute.shingles(t) for t in texts]
    errors = []
    for i in range(len(texts) - 1):
        a, b = sets[i], sets[i] | sets[i + 1]
        merged = sketches.merge(found[i], found[i + 1])
        errors.append((sketches.resemblance(found[i], merged) - brute.jaccard(a, b), sketches.containment(found[i], merged) - 1, sketches.distinct_count(merged) / max(1, len(b)) - 1))
        assert (sketches.from_text(sketches.as_text(merged)) == merged).all()
    assert np.abs(errors).mean(0).max() < 0.05
    assert sketches.resemblance(found[0], found[0]) == 1.0


def test_edit_report(query, rows):
    got = {r["doc_id"]: r for r in query("op3_fingerprints")}
    assert len(got) == len(rows)
    ordered = sorted(rows, reverse=True)
    for (i, text), (_, follower) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follower[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - brute.jaccard(brute.shingles(text), brute.shingles(edited))) < 0.15
        assert abs(r["near_next"] - brute.jaccard(brute.shingles(text), brute.shingles(follower))) < 0.15


def test_fingerprints_of_odd_rows(odd, none):
    got = sketches.edit_report(odd).collect()
    assert len(got) == len(ODD)
    by_text = {}
    for r in got:
        text = next(t or "" for i, t in ODD if i == r["doc_id"])
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert next(r["n_chars"] for r in got if r["doc_id"] == 7) == len(LONG)
    assert sketches.edit_report(none).count() == 0
    assert sketches.fingerprints(none).columns[-1] == "sketch"


def test_merged_sketches(spark, rows):
    df = sketches.fingerprints(spark.createDataFrame(rows[:60], "doc_id long, text string")).withColumn("part", F.col("doc_id") % 3)
    got = {r["part"]: r["sketch"] for r in sketches.merged(df, ["part"]).collect()}
    found = sketches.sketches(pa.array([t for _, t in rows[:60]]))
    for part in range(3):
        want = np.unique(np.concatenate([s for (i, _), s in zip(rows[:60], found) if i % 3 == part]))[: sketches.K]
        assert got[part] == want.astype(np.int64).tolist()


def test_line_rules(query, rows, spark, sf_dir):
    got = {r["doc_id"]: r for r in query("op4_line_rules")}
    for i, text in rows:
        want = brute.form(text)
        assert tuple(got[i][c] for c in lines.COUNTS[:5]) == want, i
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = [got[r["doc_id"]] for r in labels if r["quality"] == 1]
    assert all(r["kept"] for r in good if not r["base_failed"])
    assert not any(got[r["doc_id"]]["kept"] for r in labels if r["quality"] == 0)


def test_failed_lines_are_judged_and_removed(spark):
    prose = " ".join(f"Word{n} and{n} another{n} one{n}." for n in range(30))
    nav = "Home | About | News | Contact"
    text = f"{prose}\n{nav}\nThis work is Licensed under the X License.\n\nno end here\nshort end."
    (r,) = lines.clean_lines(spark.createDataFrame([(text,)], "text string")).collect()
    assert r["clean_text"] == f"{prose}\n\nshort end." and r["n_lines_removed"] == 3 and r["kept"]
    (r,) = lines.clean_lines(spark.createDataFrame([(f"{prose}\n" + f"{nav}\n" * 40,)], "text string")).collect()
    assert not r["kept"] and r["clean_text"] == f"{prose}\n"


def test_line_rules_on_odd_rows(odd, none):
    got = lines.clean_lines(odd).collect()
    assert len(got) == len(ODD) and not any(r["kept"] for r in got if not r["text"])
    assert next(r["n_words"] for r in got if r["doc_id"] == 7) == 40_000
    assert lines.clean_lines(none).count() == 0


def test_form_of_texts_that_touch():
    texts = ["a.\n", "", "\n", "b c.", "", "d"]
    (part,) = words.slices(pa.array(texts))
    f = style.form_of(part)
    assert f.n_words.tolist() == [1, 0, 0, 2, 0, 1] and f.n_ends.tolist() == [1, 0, 0, 1, 0, 0]
    lines_of = [texts[d].split("\n") for d in range(len(texts))]
    assert np.bincount(f.line_doc).tolist() == [len(x) for x in lines_of]
    assert [int(n) for n in f.line_words] == [len(x.split()) for own in lines_of for x in own]


def test_quality_is_learned_and_holds_on_the_held_out_fold(query, spark, sf_dir):
    import zlib

    got = {r["doc_id"]: r for r in query("op5_quality")}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    held = [(r["quality"], got[r["doc_id"]]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([q == r["predicted"] for q, r in held]) > 0.95


def test_pairs_and_ranks():
    rng = np.random.default_rng(1)
    x, good = rng.normal(size=(400, len(quality.FEATURES))), rng.random(400) < 0.8
    x[good, 3] += 3
    better, worse = quality.preference_pairs(good, 3)
    assert len(better) == 3 * good.sum() and good[better].all() and not good[worse].any()
    ranker = quality.fit_ranker(x, good)
    assert np.mean((ranker.score(x) >= ranker.threshold) == good) > 0.85
    # the threshold is the quantile of the labelled share
    assert (ranker.score(x) < ranker.threshold).sum() == (~good).sum()
    with pytest.raises(ValueError):
        quality.fit_ranker(x, np.ones(400, bool))


def test_draws_of_any_share(spark):
    from prefmine.llm.tables import drawn

    df = spark.range(1000)
    for n in (1, 100, 832, 834, 900, 999, 1000, 2000):  # also where a fifth to spare takes all rows
        found = drawn(df, df["id"], n)
        assert min(n, 1000) * 0.9 - 10 <= found.count() <= 1.2 * n + 100 and found.orderBy("__order").limit(n).count() <= n


def test_quality_of_odd_rows(odd, none, spark):
    labelled = spark.createDataFrame([(i, "Good text of words. " * 9 if i % 2 else "a | b | c |" * 9, i % 2) for i in range(40)], "doc_id long, text string, quality int")
    ranker = quality.learn(labelled, max_labelled=30)
    got = quality.score(odd, ranker).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got) and quality.score(none, ranker).count() == 0
    assert all((r["score"] == 0) == (not (r["text"] or "").split()) for r in got)  # nothing to read is never good
    with pytest.raises(ValueError):
        quality.learn(labelled.limit(0))
