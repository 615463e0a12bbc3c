"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` bytes. Each passage is described by the pairs
of adjacent character classes in it and the share of its 8-byte windows that repeat an
earlier one, and encoded by a learned layer; gated attention,
learned from the documents' labels alone, weighs the passages; a logistic unit scores
the weighted sum. It is fitted with Adam on at most ``LABELLED`` labelled documents,
those with the smallest hashes of doc_id, and ``PER`` passages of each, evenly spread; every
passage of every text is scored.

Defined results: null and empty texts are a bag of one empty passage; a document with
several labels counts as good if half of them are, and is fitted on one of its texts if it
has several (that with the smallest hash); null labels are ignored; without any label all scores are 0.5; repeated rows each get a row; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import OWN, crc_of_id, map_texts, trim

#: Bytes in a passage, labelled documents to fit on and passages of each, encoding and attention widths.
PASSAGE, LABELLED, PER, WIDTH, GATE = 1000, 4000, 16, 32, 16
STEPS, BATCH, RATE, DECAY, SEED = 600, 128, 0.01, 1e-4, 9
#: Character classes, slots that count distinct windows, features of a passage.
CLASSES, WINDOWS = 32, 2048
#: Added to a passage's pairs, so that a few characters say little.
FEW = 32
FEATURES = CLASSES**2 + 1


def _classes() -> np.ndarray:
    """Byte -> character class."""
    table = np.zeros(256, np.int64)
    table[128:] = 1
    groups = ["aeiou", "bcdfghjklmnpqrstvwxyz", string.ascii_uppercase, string.digits, " ", "\n", "\t\r\x0b\x0c"]
    groups += list(".,;:!?'\"()-_|#$%&*@/=<")
    for k, group in enumerate(groups):
        table[list(group.encode())] = k + 2
    return table


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x features) of all texts, and where each text's passages end. A row has the
    square roots of the relative frequencies of class pairs, and the share of repeats."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    many = np.maximum(1, -(-size // PASSAGE))
    ends = np.cumsum(many)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    kind = _classes()[flat]
    begin = np.cumsum(size) - size
    place = np.arange(len(kind)) - np.repeat(begin, size)
    passage = np.repeat(ends - many, size) + place // PASSAGE
    pair = kind[:-1] * CLASSES + kind[1:]
    inside = place[1:] > 0
    cell = passage[:-1][inside] * CLASSES**2 + pair[inside] if len(kind) > 1 else np.zeros(0, np.int64)
    found = np.bincount(cell, minlength=int(ends[-1]) * CLASSES**2 if len(ends) else 0).reshape(-1, CLASSES**2).astype(np.float32)
    total = found.sum(axis=1, keepdims=True)
    out = np.zeros((len(found), FEATURES), np.float32)
    out[:, :-1] = np.sqrt(found / (total + FEW))
    out[:, -1] = _repeats(flat, place, passage, len(found))
    return out, ends


def _repeats(flat: np.ndarray, place: np.ndarray, passage: np.ndarray, count: int) -> np.ndarray:
    """The share of a passage's 8-byte windows beyond the distinct ones that chance would
    leave in ``WINDOWS`` slots."""
    if len(flat) < 8:
        return np.zeros(count, np.float32)
    wide = flat.astype(np.uint64)
    for step in (1, 2, 4):
        wide = wide[:-step] << np.uint64(8 * step) | wide[step:]
    slot = ((wide * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int64)
    whole = place[7:] >= 7
    owner = passage[: len(slot)][whole]
    windows = np.bincount(owner, minlength=count)
    seen = np.bincount(owner * WINDOWS + slot[whole], minlength=count * WINDOWS).reshape(count, WINDOWS)
    expected = WINDOWS * (1 - np.exp(-windows / WINDOWS))
    return np.clip(1 - (seen > 0).sum(axis=1) / np.maximum(1, expected), 0, 1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(model: dict, rows: np.ndarray, ends: np.ndarray) -> dict:
    """Every step of the scores of the bags of rows that end at ``ends``."""
    begin, size = np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
    coded = np.tanh(rows @ model["code"] + model["code_bias"])
    up, gate = np.tanh(coded @ model["up"]), _sigmoid(coded @ model["gate"])
    raw = (up * gate) @ model["pick"]
    power = np.exp(raw - np.repeat(np.maximum.reduceat(raw, begin), size))
    weight = power / np.repeat(np.add.reduceat(power, begin), size)
    bag = np.add.reduceat(weight[:, None] * coded, begin, axis=0)
    return {"coded": coded, "up": up, "gate": gate, "weight": weight, "bag": bag, "score": _sigmoid(bag @ model["out"] + model["out_bias"]), "begin": begin, "size": size}


def _gradient(model: dict, rows: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> dict:
    f = _forward(model, rows, ends)
    error = (f["score"] - labels) / len(labels)
    of_bag = np.repeat(error[:, None] * model["out"][None, :], f["size"], axis=0)
    each = (of_bag * f["coded"]).sum(axis=1)
    of_raw = f["weight"] * (each - np.repeat(np.add.reduceat(f["weight"] * each, f["begin"]), f["size"]))
    of_up = of_raw[:, None] * model["pick"] * f["gate"] * (1 - f["up"] ** 2)
    of_gate = of_raw[:, None] * model["pick"] * f["up"] * f["gate"] * (1 - f["gate"])
    of_code = (f["weight"][:, None] * of_bag + of_up @ model["up"].T + of_gate @ model["gate"].T) * (1 - f["coded"] ** 2)
    return {
        "out": f["bag"].T @ error, "out_bias": error.sum(), "pick": (f["up"] * f["gate"]).T @ of_raw, "up": f["coded"].T @ of_up,
        "gate": f["coded"].T @ of_gate, "code": rows.T @ of_code, "code_bias": of_code.sum(axis=0),
    }


def train(rows: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> dict:
    """Adam on the log loss of the bags; the result does not depend on their origin's order."""
    rng = np.random.default_rng(SEED)
    model = {
        "code": rng.normal(0, 1.0, (FEATURES, WIDTH)) / 4, "code_bias": np.zeros(WIDTH), "up": rng.normal(0, 0.2, (WIDTH, GATE)),
        "gate": rng.normal(0, 0.2, (WIDTH, GATE)), "pick": rng.normal(0, 0.2, GATE), "out": rng.normal(0, 0.2, WIDTH), "out_bias": np.zeros(()),
    }
    model = {k: v.astype(np.float32) for k, v in model.items()}
    if not len(labels):
        return model | {"out": np.zeros(WIDTH, np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    begin = np.concatenate([[0], ends[:-1]])
    for step in range(1, STEPS + 1):
        bags = rng.choice(len(labels), min(BATCH, len(labels)), replace=False)
        size = ends[bags] - begin[bags]
        stop = np.cumsum(size)
        pick = np.arange(stop[-1]) + np.repeat(begin[bags] - (stop - size), size)
        found = _gradient(model, rows[pick], stop, labels[bags].astype(np.float32))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, g in found.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            model[k] = (model[k] - rate * (move + DECAY * model[k])).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> dict:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, target 0/1)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg((F.avg(target) >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def work(texts: list[str | None]) -> list:
        found, ends = passages(texts)
        bags = np.split(found, ends[:-1])
        spread = [x[np.linspace(0, len(x) - 1, min(PER, len(x))).astype(np.int64)] for x in bags]
        return [pa.array([x.astype(np.float16).tobytes() for x in spread], pa.binary())]

    # a row a label: at most LABELLED * PER * FEATURES numbers of two bytes come to the driver
    bags = map_texts(rows.withColumn(OWN, F.xxhash64("text")), ["doc_id", "label", OWN], "bag binary", work)
    one = bags.groupBy("doc_id", "label").agg(F.min(F.struct(OWN, "bag")).alias("first"))
    got = one.select("doc_id", "label", "first.bag").orderBy("doc_id").toArrow()
    ends = np.cumsum([x.as_buffer().size // (2 * FEATURES) for x in got.column("bag")]).astype(np.int64)
    x, start = None, 0
    whole = np.zeros((ends[-1] if len(ends) else 0, FEATURES), np.float32)
    for end, x in zip(ends, got.column("bag")):
        whole[start:end] = np.frombuffer(x.as_buffer(), np.float16).reshape(-1, FEATURES)
        start = end
    known = np.array(got.column("label").to_numpy())
    del got, x
    model = train(whole, ends, known)
    del whole
    pa.default_memory_pool().release_unused()
    trim()
    return model


def score(docs: DataFrame, keep: list[str], model: dict, name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` with the score of the column text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, keep, f"{name} double", lambda texts: [_forward(shared.value, *passages(texts))["score"].astype(np.float64)])


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a model of their own labels scores 0.5 or more."""
    return score(docs, docs.columns, fit(docs, labels), OWN).where(F.col(OWN) >= 0.5).drop(OWN)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learn from the labels of rows whose crc32(doc_id) mod ``folds`` is not ``held``; score all."""
    out = F.coalesce(crc_of_id() % folds == held, F.lit(False))
    model = fit(docs, labels.where(~out))
    return score(docs, ["doc_id"], model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
