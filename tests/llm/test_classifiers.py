"""Quality rules, quality model and toxicity on small tables and by held-out accuracy."""

import random
import zlib

from brute import collected, frame, words_of

from barloom.llm import quality_rules as rules
from barloom.llm.quality_model import good, quality
from barloom.llm.toxicity import toxicity

SMALL = "/root/testdata/sf0.01"
#: The toxic texts of the smaller tables are too few to train on.
MIDDLE = "/root/testdata/sf0.1"


def _rules_by_loop(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    at: dict = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    hit = {i + k for found in at.values() if len(found) > 1 for i in found for k in range(8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_rules(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a", "bé", "c#", "dd|", "\n", "\t"]) for _ in range(rng.choice([0, 5, 19, 20, 25, 80, 300])))) for i in range(80)]
    rows += [(100, None), (101, ""), (None, "x y " * 30), (3, rows[3][1]), (102, "same line of words here\n" * 9), (103, "w " * 30000)]
    df = rules.quality_rules(frame(spark, rows))
    got = collected(df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == sorted(((d, *_rules_by_loop(t)) for d, t in rows), key=str)
    assert df.filter("base_failed and kept").count() == 0 and df.filter("kept and reason is not null").count() == 0
    assert rules.quality_rules(frame(spark, [])).count() == 0


def test_filter_above_rules(spark):
    """A filter on a count may be pushed below the projections without changing it."""
    df = rules.quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert df.filter("n_repeat_words > 0").count() == sum(r.n_repeat_words > 0 for r in df.collect())


def test_rules_keep_clean(spark):
    df = rules.quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet")).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id")
    rows = df.filter("n_words >= 20").select("kept", "quality").collect()
    assert sum(r.kept for r in rows if r.quality) / sum(1 for r in rows if r.quality) > 0.97
    assert sum(r.kept for r in rows if not r.quality) / sum(1 for r in rows if not r.quality) < 0.2


def test_order_never_changes_the_verdict(spark):
    base = rules.measures(spark.read.parquet(f"{SMALL}/documents.parquet"))
    conditions = rules.rules()
    seen = set()
    for order in (list(conditions), list(conditions)[::-1]):
        seen.add(base.withColumn("r", rules.cascade(order, conditions)).filter("r is null").count())
    assert len(seen) == 1


def _held_out(spark, operator, label, modulus, rest, folder=SMALL):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = operator(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    return [(r[label], r.predicted, r.score) for r in rows if r.held_out]


def test_quality(spark):
    rows = _held_out(spark, quality, "quality", 3, 1)
    assert sum(a == b for a, b, _ in rows) / len(rows) > 0.9


def test_toxicity(spark):
    rows = _held_out(spark, toxicity, "toxic", 5, 0, MIDDLE)
    pairs = [(a[2], b[2]) for a in rows if a[0] for b in rows if not b[0]]
    assert sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs) > 0.9


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "some text"), (3, "x" * 100000), (3, "x" * 100000), (4, " ".join(map(str, range(20000))))]
    labels = spark.createDataFrame([(1, 0, 1), (2, None, None), (3, 1, 0), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for operator in (quality, toxicity):
        assert operator(frame(spark, rows), labels).count() == len(rows)
        assert operator(frame(spark, rows), labels.limit(0)).count() == len(rows)
        assert operator(frame(spark, []), labels).count() == 0
    kept = good(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and kept.count() <= len(rows)
