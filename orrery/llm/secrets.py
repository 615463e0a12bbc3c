"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression yields a Boolean query: alternatives of literal runs
that every match must hold, cut into trigrams. The index has a posting (trigram, doc_id)
for each trigram that some rule asks for; postings of one alternative are intersected by
counting them per document, alternatives are united, and the rules found are verified on
the text. A rule without a mandatory trigram is run over every text.

Spans are in code points, end exclusive. Defined results: null text is empty and has no
span; repeated doc_ids share candidates, which are verified on each row's own text, so
every row gets its own result; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import saved

#: Fixed values: (kind, pattern, group whose length counts, least length, either case).
#: The first three are the base kinds; the others add spans.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, False),
    ("hex", r"[0-9a-f]+", 0, 16, False),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,255}", 0, 40, False),
)
BASE = ("assign", "access", "hex")
#: Patterns with the least length written in where that gives the same matches: a
#: match of these is a maximal run, so a failing one never hides a longer one.
RUNS = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
#: Alternatives beyond which a part of a pattern counts as unknown; smallest sets stay exact.
MOST = 16


def _alternatives(items) -> list[tuple[str | None, ...]]:
    """Each way to match, as literal characters with None for what is unknown."""
    ways: list[tuple] = [()]
    for kind, arg in items:
        if kind is op.LITERAL:
            step = [(chr(arg),)]
        elif kind is op.SUBPATTERN:
            step = _alternatives(arg[3])
        elif kind is op.BRANCH:
            step = [w for branch in arg[1] for w in _alternatives(branch)]
        elif kind is op.IN and all(k is op.LITERAL for k, _ in arg):
            step = [(chr(c),) for _, c in arg]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = arg
            if (least, most) == (0, 1):
                step = [(), *_alternatives(inner)]
            else:
                step = [w * least + (() if least == most else (None,)) for w in _alternatives(inner)] if least and least < 8 else [(None,)]
        else:
            step = [(None,)]
        if len(step) * len(ways) > MOST:
            step = [(None,)]
        ways = [a + b for a in ways for b in step]
    return ways


def trigram_query(pattern: str) -> list[list[str]] | None:
    """Alternatives of trigrams, in lower case, one of which every match holds in full;
    None if some way to match has no mandatory trigram."""
    found = set()
    for way in _alternatives(parser.parse(pattern)):
        runs = "".join("\0" if c is None else c for c in way).lower().split("\0")
        grams = frozenset(r[k : k + 3] for r in runs for k in range(len(r) - 2))
        if not grams:
            return None
        found.add(grams)
    return sorted(sorted(g) for g in found if not any(o < g for o in found))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id) for the grams of the list that a text holds, letters in either case."""
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(k)) for k, g in enumerate(grams)]))
    return docs.select("doc_id", F.lower("text").alias("low")).select("doc_id", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, rules): the positions of the rules whose trigram query a document meets."""
    queries = {k: q for k, (_, p, *_) in enumerate(rules) if (q := trigram_query(p)) is not None}
    grams = sorted({g for q in queries.values() for way in q for g in way})
    ways = [(rule, [grams.index(g) for g in way]) for rule, q in queries.items() for way in q]
    index = postings(docs, grams).distinct()
    asked = F.array(*[F.struct(F.lit(n).alias("way"), F.lit(rule).alias("rule"), F.lit(len(way)).alias("needs"), F.array(*map(F.lit, way)).alias("grams")) for n, (rule, way) in enumerate(ways)])
    met = index.select("doc_id", "gram", F.inline(asked)).where(F.array_contains("grams", F.col("gram")))
    both = met.groupBy("doc_id", "way").agg(F.count(F.lit(1)).alias("n"), F.first("needs").alias("needs"), F.first("rule").alias("rule")).where("n = needs")
    return both.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, order: int, kind: str, pattern: str, group: int, least: int, fold: bool) -> Column:
    """array<struct<start, ord, end, kind>> of a rule's matches in a text.

    The matches and the gaps between them come from the same scan of the expression, so
    running lengths give the places."""
    regex = ("(?i)" if fold else "") + RUNS.get(kind, pattern)
    found = F.regexp_extract_all(text, F.lit(f"({regex})"), F.lit(1))
    gaps = F.split(text, regex, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        held = F.length(F.regexp_extract(x["hit"], regex, group)) if group else F.length(x["hit"])
        one = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(held >= least, F.concat(state["all"], F.array(one))).otherwise(state["all"]).alias("all"))

    return F.when(F.rlike(text, F.lit(regex)), F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("all")), add, lambda s: s["all"])).otherwise(empty)


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, spans): array<struct<start, ord, end, kind>> by start, then kind as listed."""
    found = saved(candidates(docs, rules), "candidates")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    met = rows.join(found.withColumnRenamed("doc_id", "_id"), rows["doc_id"].eqNullSafe(F.col("_id")), "left")
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    parts = []
    for k, (kind, pattern, group, least, fold) in enumerate(rules):
        own = _spans(F.col("text"), k, kind, pattern, group, least, fold)
        parts.append(own if trigram_query(pattern) is None else F.when(F.array_contains("rules", k), own).otherwise(empty))
    return met.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of ``docs``."""
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def python_spans(text: str | None, rules=RULES) -> list[tuple[int, int, int, str]]:
    """The same spans by Python's regular expressions; the tests' yardstick."""
    out = []
    for k, (kind, pattern, group, least, fold) in enumerate(rules):
        for m in re.finditer(pattern, text or "", re.IGNORECASE | re.ASCII if fold else re.ASCII):
            if len(m[group]) >= least:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)
