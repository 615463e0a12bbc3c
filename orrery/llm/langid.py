"""Language identification by multilingual mixture inference.

Each language has probabilities of hashed letter trigrams, counted over all labelled
texts. A document is a mixture: expectation-maximisation finds the languages' shares
that make its trigrams likeliest, and languages are dropped as long as that raises the
penalised likelihood (each language costs ``PENALTY`` times log n; a letter is in three
trigrams, so the likelihood counts a third). The largest share names the language.

Languages beyond ``SLICE`` are taken slice by slice: the languages that a document kept so far
stand against those of the next slice, so a task holds one slice of the model, whatever
the number of languages.

Defined results: a null text or one without a letter is ``und`` with score 0, as is
every text where nothing was learned; ties go to the smaller name; repeated rows each
get a row; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import crc_of_id, discard, map_texts, saved, text_chunks

BUCKETS = 1 << 16
#: Added to each count; EM rounds; cost of a language; languages in a slice of the model.
SMOOTH, ROUNDS, PENALTY, SLICE = 0.5, 12, 2.0, 64
_LETTER = re.compile(r"[^\W\d_]")
_kept: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else a space."""
    global _kept
    if _kept is None:
        _kept = np.array([k if chr(k).isalpha() else 32 for k in range(0x110000)], np.uint32)
    return _kept


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of all texts, and where each text's end. Texts are in
    lower case with a space for whatever is not a letter, at both ends as well."""
    padded = [f" {(t or '').lower()} " for t in texts]
    ends = np.cumsum([len(t) for t in padded])
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = _letters()[points].astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    a, b, c = points[:-2], points[1:-1], points[2:]
    bucket = (((a * np.uint64(0x1F123BB5) + b) * np.uint64(0x1F123BB5) + c) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    use = (b != 32) | ((a != 32) & (c != 32))
    use &= ~((a == 32) & (b == 32)) & ~((b == 32) & (c == 32))
    use[ends[:-1] - 2] = False
    use[ends[:-1] - 1] = False
    upto = np.concatenate([[0], np.cumsum(use)])
    return bucket[use].astype(np.int64), upto[np.minimum(ends, len(use))]


def count(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of ``labelled`` (text, lang), summed in each task first."""

    def given(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], names=["lang", "bucket", "n"])
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in text_chunks(texts):
                found, ends = trigrams(texts[a:b])
                names, which = np.unique(np.array(langs[a:b], object).astype(str), return_inverse=True)
                owner = np.repeat(which, np.diff(ends, prepend=0))
                for k, name in enumerate(names.tolist()):
                    if len(sums) >= SLICE and name not in sums:
                        yield from given(sums)
                    row = np.bincount(found[owner == k], minlength=BUCKETS)
                    sums[name] = sums[name] + row if name in sums else row
        yield from given(sums)

    rows = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def table_of(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names in order and P(bucket | language) as a (BUCKETS, languages) table."""
    got = counts.toArrow()
    names, which = np.unique(np.array(got.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    table = np.full((BUCKETS, len(names)), SMOOTH)
    table[got.column("bucket").to_numpy(), which] += got.column("n").to_numpy()
    return names.tolist(), (table / table.sum(axis=0, keepdims=True)).astype(np.float32)


def fit(labelled: DataFrame) -> list[tuple[list[str], np.ndarray]]:
    """The model: tables of about ``SLICE`` languages or fewer, all of them together."""
    counts = saved(count(labelled), "trigrams")
    known = counts.agg(F.count_distinct("lang")).first()[0]
    slices = 1 if known <= SLICE else -(-2 * known // SLICE)
    model = [table_of(counts.where(F.pmod(F.xxhash64("lang"), F.lit(slices)) == k)) for k in range(slices)]
    discard(counts)
    return model


def _shares(chances: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM for the shares of the columns of ``chances``, and the log likelihood."""
    share = np.full(chances.shape[1], 1 / chances.shape[1], np.float32)
    total = weight.sum()
    for _ in range(rounds):
        part = (weight / (chances @ share)) @ chances
        share = (share * part / total).astype(np.float32)
    return share, float(np.log(chances @ share) @ weight)


def _hopeless(chances: np.ndarray, weight: np.ndarray, share: np.ndarray, cost: float) -> np.ndarray:
    """Columns that surely raise the penalised likelihood by going, one after another, the
    least share first: the other shares, scaled up to 1, lose at most what is summed here."""
    order = np.argsort(share, kind="stable")
    part = (chances * share)[:, order]
    less = np.minimum(np.cumsum(part, axis=1)[:, :-1] / part.sum(axis=1, keepdims=True), 1 - 1e-6)
    gone = np.minimum(np.cumsum(share[order])[:-1] / share.sum(), 1 - 1e-6)
    loss = weight @ -np.log1p(-less) + weight.sum() * np.log1p(-gone)
    stay = np.flatnonzero(np.diff(loss, prepend=0) > cost)
    return order[: stay[0] if len(stay) else len(loss)]


def mixture(chances: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, shares) of the language set with the best penalised likelihood; a row of
    ``chances`` is a trigram that occurs ``weight`` times (once without)."""
    weight = np.ones(len(chances), np.float32) if weight is None else weight
    live = np.arange(chances.shape[1])
    if len(live) == 1:
        return live, np.ones(1)
    cost = PENALTY * np.log(weight.sum() + 1) * 3
    share, value = _shares(chances, weight)
    drop = _hopeless(chances, weight, share, cost)
    if len(drop):
        live = np.setdiff1d(live, drop)
        share, value = _shares(chances[:, live], weight)
    while len(live) > 1:
        less = np.delete(live, int(share.argmin()))
        fewer, worse = _shares(chances[:, less], weight)
        if value - worse > cost:
            break
        live, share, value = less, fewer, worse
    return live, share / share.sum()


def predict(docs: DataFrame, model: list[tuple[list[str], np.ndarray]]) -> DataFrame:
    """(doc_id, lang_pred, score, mixture); mixture lists the languages with their shares."""
    rows, held, spent = docs, "text", ()
    for part in model[:-1]:
        kept = map_texts(rows, ["doc_id"], _HELD, _step(docs, part, False), text=held)
        rows = saved(kept.select("doc_id", F.struct("text", "names", "chances").alias("held")), "languages", *spent)
        held, spent = "held", (rows,)
    return map_texts(rows, ["doc_id"], "lang_pred string, score double, mixture string", _step(docs, model[-1], True), text=held)


_HELD = "text string, names array<string>, chances binary"


def _step(docs: DataFrame, part: tuple[list[str], np.ndarray], last: bool):
    """The languages of a slice against those kept before; ``chances`` holds the latters'
    probabilities of the text's distinct trigrams, so that their slice is not needed again."""
    shared = docs.sparkSession.sparkContext.broadcast(part)

    def work(held: list) -> list:
        names, table = shared.value
        held = [h if isinstance(h, dict) else {"text": h, "names": None, "chances": None} for h in held]
        texts = [h["text"] for h in held]
        found, ends = trigrams(texts)
        start, out = 0, []
        for h, end in zip(held, ends, strict=True):
            own, start = found[start:end], end
            if not len(own) or not _LETTER.search(h["text"] or ""):
                out.append(("und", 0.0, "") if last else (h["text"], None, None))
                continue
            own, times = np.unique(own, return_counts=True)
            known, chances = names, table[own]
            if h["names"]:
                chances = np.concatenate([np.frombuffer(h["chances"], np.float32).reshape(len(own), -1), chances], axis=1)
                known = h["names"] + names
                order = sorted(range(len(known)), key=known.__getitem__)
                known, chances = [known[k] for k in order], chances[:, order]
            if not known:
                out.append(("und", 0.0, ""))
                continue
            live, share = mixture(chances, times.astype(np.float32))
            if last:
                best = max(range(len(live)), key=lambda k: (share[k], -live[k]))
                out.append((known[live[best]], float(min(1.0, share[best])), ",".join(f"{known[c]}:{s:.4f}" for c, s in zip(live, share, strict=True))))
            else:
                out.append((h["text"], [known[c] for c in live], np.ascontiguousarray(chances[:, live]).tobytes()))
        kinds = (pa.string(), pa.float64(), pa.string()) if last else (pa.string(), pa.list_(pa.string()), pa.binary())
        return [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]

    return work


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod ``folds`` is not 0 and predict all."""
    held = crc_of_id() % folds == 0
    model = fit(docs.where(~held).select("text", "lang"))
    return predict(docs, model).withColumn("held_out", F.coalesce(held, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "mixture")
