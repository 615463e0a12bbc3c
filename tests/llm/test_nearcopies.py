"""The pipeline's near copies against all pairs."""

import random

import corpus_pipeline
from orrery.llm import nearcopies
from orrery.session import table
from tests.llm.test_operators import SF, odd, words  # noqa: F401


def _shingles(text: str | None) -> set:
    own = (text or "").lower().split()
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def heads(rows: list) -> set:
    """The least doc_id of each component of (doc_id, text) rows, by all pairs."""
    sets = {d: _shingles(t) for d, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if a < b and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(k) for k in sets}


def test_planted_near_copies_go(spark):
    rng, made = random.Random(4), []
    for g in range(30):
        base = words(300, 100 + g).split()
        made.append((1000 * (g + 1), " ".join(base)))
        for k in range(1, 4):
            own = list(base)
            for at in rng.sample(range(300), rng.randint(1, 6)):
                own[at] = f"new{rng.random()}"
            made.append((1000 * (g + 1) + k, " ".join(own)))
        made.append((1000 * (g + 1) + 9, " ".join(base[:150] + words(150, 900 + g).split())))
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = heads(rows)
    assert {1000 * (g + 1) + k for g in range(30) for k in (0, 9)} <= want and len(want) < len(rows) - 80
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()} == want


def test_odd_texts(spark, odd):  # noqa: F811
    kept = nearcopies.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, k) for k in (1, 3, 4, 7)] + [(True, 0)]
    assert nearcopies.one_of_each(odd.limit(0)).count() == 0


def test_links_that_no_key_shows(spark, monkeypatch):
    """Pairs at the threshold whose minimum hashes and fingerprints differ: one in 2,500 has no
    key in common, so here keys show nothing at all; frequent shingles come last."""
    rng, made = random.Random(8), []
    line = words(12, 5)
    for g in range(40):
        base = words(200, 3000 + g).split()
        made.append((100 * g, " ".join(base)))
        for k in range(1, 4):  # chains: each a near copy of the one before
            base = list(base)
            for at in rng.sample(range(0, 200, 10), 3):
                base[at] = f"new{rng.random()}"
            made.append((100 * g + k, " ".join(base)))
        made.append((100 * g + 9, f"{line} {words(4, 9000 + g)}"))
    made += [(9001, line), (9002, f"{line} one"), (9003, f"{line} one two"), (9004, None), (9005, " "), (9006, "a b"), (9007, "A  b")]
    monkeypatch.setattr(nearcopies, "candidates", lambda prints: _only_blank(prints))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    want = heads(made)
    assert {r.doc_id for r in nearcopies.one_of_each(docs).collect()} == want and len(want) < len(made) - 100


def _only_blank(prints):
    from pyspark.sql import functions as F

    from orrery.llm.common import saved

    blank = prints.where("size = 0").select("text_hash").distinct()
    low = blank.agg(F.min("text_hash").alias("a"))
    return saved(blank.select(F.col("text_hash").alias("b")).crossJoin(low).where("a < b").select("a", "b"), "pairs")


def test_texts_that_share_a_passage_form_no_pairs(spark, monkeypatch):
    """Many texts with one passage in common, which no sample shows, are not compared with each other."""
    made = [(k, f"{words(20, 77)} {words(40, 5000 + k)}") for k in range(200)]
    made += [(1000 + k, f"{t} more") for k, t in made[:20]]
    counts, write = [], nearcopies.saved

    def counted(df, name, *spent):
        out = write(df, name, *spent)
        if name == "pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(nearcopies, "FREQUENT", 0)
    monkeypatch.setattr(nearcopies, "saved", counted)
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert {r.doc_id for r in nearcopies.one_of_each(docs).collect()} == set(range(200))
    assert len(counts) == 2 and counts[1] <= 200
