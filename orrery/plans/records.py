"""Queries over content, ledgers, metadata, hashes and states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import bits, cube, mixing64
from orrery.operators import content, graph, grid, ledger, states, validate
from orrery.plans import sql
from orrery.plans.inputs import cells, d1, d2
from orrery.session import kept, scratch, table

QUERIES: dict = {}
SQL: dict = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return keep


def _digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"), F.length("text").cast("long").alias("size"))


_DIG = "d AS (SELECT doc_id, source, sha256(text) AS hash, length(text) AS size FROM documents)"


@query(f"WITH {_DIG} SELECT hash, count(*)::BIGINT AS refs, min(doc_id) AS doc_id, 'blobs/' || hash[1:2] || '/' || hash || '.zst' AS path FROM d GROUP BY hash")
def blob_dedup(spark, sf_dir):
    return content.distinct_blobs(_digests(spark, sf_dir), "hash", "doc_id").withColumn("path", content.blob_path(F.col("hash")))


@query(f"WITH {_DIG} SELECT DISTINCT hash FROM d WHERE doc_id % 2 = 0 AND hash NOT IN (SELECT hash FROM d WHERE source < 'src5')")
def need_closure_anti(spark, sf_dir):
    d = _digests(spark, sf_dir)
    return content.missing(d.where("doc_id % 2 = 0"), d.where("source < 'src5'"), "hash")


@query(f"WITH {_DIG} SELECT source || '/' || (doc_id % 10) AS path, count(DISTINCT hash)::BIGINT AS hashes, count(*)::BIGINT AS refs FROM d GROUP BY 1 HAVING count(DISTINCT hash) > 1")
def section_conflicts(spark, sf_dir):
    return content.conflicts(_digests(spark, sf_dir).select(F.concat_ws("/", "source", (F.col("doc_id") % 10).cast("string")).alias("path"), "hash"))


@query(f"""WITH {_DIG}, a AS (SELECT doc_id::VARCHAR AS path, hash FROM d WHERE doc_id % 3 <> 0), b AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 7 = 0 THEN upper(hash) ELSE hash END AS hash FROM d WHERE doc_id % 5 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash""")
def manifest_diff(spark, sf_dir):
    d = _digests(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string"))
    new = d.where("doc_id % 5 <> 0").withColumn("hash", F.when(F.col("doc_id") % 7 == 0, F.upper("hash")).otherwise(F.col("hash")))
    return content.manifest_diff(d.where("doc_id % 3 <> 0"), new)


@query(f"""WITH {sql.located(sql.D1, 6)}, k AS (SELECT id, id % 10 AS field, face::HUGEINT * 18446744073709551616 + i * 64 + j AS place, {sql.key("face", "i", "j", "6")} AS key FROM cells),
u AS (SELECT *, CASE WHEN key < 0 THEN key::HUGEINT + 18446744073709551616 ELSE key::HUGEINT END AS ukey FROM k)
SELECT id, field, key FROM u QUALIFY lag(ukey) OVER (PARTITION BY field ORDER BY id) >= ukey""")
def index_order_check(spark, sf_dir):
    k = cells(d1(spark, sf_dir), 6).select("id", (F.col("id") % 10).alias("field"), F.lit(6).alias("level"), cube.key(F.col("face"), F.col("i"), F.col("j"), 6).alias("key"))
    return content.order_breaks(k, "field", "id").select("id", "field", "key")


_PATHS = ["x\x7fy", "a/COM\u00b9.txt", "conin$", "CONOUT$", "CONOUT$.txt", "lpt\u00b3", "", "/a", "a//b", "a/./b", "a/../b", "a\\\\b", "a:b", "a/b ", "a/b.", "a/nul", "a/COM1.txt", "a/con/b", "ok/file.json", "ok/console", "a|b", "a?"]
_URL = "regexp_replace(url, '^[a-z]+://', '')"


@query(f"""WITH p AS (SELECT {_URL} AS path FROM pages UNION ALL SELECT * FROM (VALUES {", ".join(f"('{p.replace(chr(92) * 2, chr(92))}')" for p in _PATHS)}) AS v(path)),
c AS (SELECT path, string_split(path, '/') AS parts FROM p)
SELECT path, CASE WHEN path = '' THEN 'empty' WHEN path LIKE '/%' THEN 'absolute' WHEN contains(path, chr(92)) THEN 'backslash'
WHEN len(list_filter(parts, lambda x: x IN ('', '.', '..'))) > 0 THEN 'component' WHEN regexp_matches(path, '[<>:"|?*\\x00-\\x1f]') THEN 'character'
WHEN len(list_filter(parts, lambda x: x LIKE '% ' OR x LIKE '%.')) > 0 THEN 'trailing'
WHEN len(list_filter(parts, lambda x: regexp_matches(upper(x), '^(({content.DEVICES})([.].*)?|{content.CONSOLES})$'))) > 0 THEN 'device' END AS error FROM c""")
def path_grammar(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    made = spark.createDataFrame([(p.replace("\\\\", "\\"),) for p in _PATHS], "path string")
    return urls.unionByName(made).select("path", content.path_error(F.col("path")).alias("error"))


_TREE = "SELECT DISTINCT source || CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '/' || (doc_id % 20) ELSE '/' || (doc_id % 20) || '/x' END AS path FROM documents"


@query(f"WITH p AS (SELECT DISTINCT nfc_normalize(upper(path)) AS key FROM ({_TREE})) SELECT a.key, b.key AS below FROM p a JOIN p b ON starts_with(b.key, a.key || '/')")
def path_collision_prefix(spark, sf_dir):
    end = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/"), (F.col("doc_id") % 20).cast("string"))).otherwise(F.concat(F.lit("/"), (F.col("doc_id") % 20).cast("string"), F.lit("/x")))
    return content.prefix_collisions(table(spark, sf_dir, "documents").select(F.concat("source", end).alias("path")))


_ALIAS = "source || CASE doc_id % 3 WHEN 0 THEN '/é' WHEN 1 THEN '/É' ELSE '/e' || chr(769) END || (doc_id % 30)"


@query(f"WITH p AS (SELECT {_ALIAS} AS path FROM documents) SELECT nfc_normalize(upper(path)) AS key, count(DISTINCT path)::BIGINT AS paths, min(path) AS first FROM p GROUP BY 1 HAVING count(DISTINCT path) > 1")
def path_aliases(spark, sf_dir):
    """Paths that differ in case or in how letters are composed."""
    end = F.expr("CASE doc_id % 3 WHEN 0 THEN '/é' WHEN 1 THEN '/É' ELSE concat('/e', decode(unhex('CC81'), 'utf-8')) END")
    return content.aliases(table(spark, sf_dir, "documents").select(F.concat("source", end, (F.col("doc_id") % 30).cast("string")).alias("path")))


#: The text forms of identities.
_FORMS = {"hash": r"^b3:[0-9a-f]{64}$", "object": r"^obj:[0-9a-f]{32}$", "universe": r"^uni:b3:[0-9a-f]{64}$", "field": r"^0x[0-9a-f]{8}$"}
_TEXT = """CASE doc_id % 5 WHEN 0 THEN 'b3:' || {h} WHEN 1 THEN 'obj:' || {s32} WHEN 2 THEN 'uni:b3:' || {h} WHEN 3 THEN '0x' || {s8} ELSE 'b3:' || upper({h}) END"""


@query(f"WITH {_DIG}, t AS (SELECT {_TEXT.format(h='hash', s32='hash[1:32]', s8='hash[1:8]')} AS form FROM d) SELECT " + ", ".join(f"sum(CASE WHEN regexp_matches(form, '{p}') THEN 1 ELSE 0 END)::BIGINT AS n_{k}" for k, p in _FORMS.items()) + " FROM t")
def text_form_predicates(spark, sf_dir):
    d = _digests(spark, sf_dir).select(F.expr(_TEXT.format(h="hash", s32="substr(hash, 1, 32)", s8="substr(hash, 1, 8)")).alias("form"))
    return d.agg(*(F.sum(F.rlike("form", F.lit(p)).cast("long")).alias(f"n_{k}") for k, p in _FORMS.items()))


def _ledger(spark, sf_dir):
    """Events as true ledgers, one a user, built by appending; then some entries' members are
    changed: every 97th event's link, 89th's type, 83rd's payload."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("type"), F.col("props").alias("payload"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return kept(ledger.appended(e, "user_id", "event_id"), "ledger")


def _spoiled(entries):
    every = lambda n: F.col("event_id") % n == 0
    return entries.withColumns(
        {
            "prev": F.when(every(97), F.lit("f" * 64)).otherwise(F.col("prev")),
            "type": F.when(every(89), "").otherwise(F.col("type")),
            "payload": F.when(every(83), F.concat("payload", F.lit(" "))).otherwise(F.col("payload")),
        }
    )


def _content(prev: str) -> str:
    return f"sha256(payload || '|' || {prev} || '|' || seq || '|' || t || '|' || type)"


_LEDGER = f"""RECURSIVE e AS (SELECT user_id, event_id, event_type AS type, props AS payload, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
h AS (SELECT *, '{ledger.GENESIS}' AS prev, {_content(f"'{ledger.GENESIS}'")} AS hash FROM e WHERE seq = 0
UNION ALL SELECT e.*, h.hash, sha256(e.payload || '|' || h.hash || '|' || e.seq || '|' || e.t || '|' || e.type) FROM h JOIN e ON e.user_id = h.user_id AND e.seq = h.seq + 1)"""


@query(f"""WITH {_LEDGER}, s AS (SELECT user_id, event_id, seq, t, hash, prev AS before, CASE WHEN event_id % 97 = 0 THEN repeat('f', 64) ELSE prev END AS prev,
  CASE WHEN event_id % 89 = 0 THEN '' ELSE type END AS type, CASE WHEN event_id % 83 = 0 THEN payload || ' ' ELSE payload END AS payload FROM h),
v AS (SELECT user_id, seq, CASE WHEN type = '' THEN 'InvalidEntry' WHEN prev <> before THEN 'BrokenChain' WHEN hash <> {_content('prev')} THEN 'TamperedEntry' END AS error FROM s)
SELECT * FROM v WHERE error IS NOT NULL""")
def ledger_chain_verify(spark, sf_dir):
    """The entries of true ledgers that were changed afterwards, and how."""
    return ledger.violations(_spoiled(_ledger(spark, sf_dir)), "user_id")


@query(f"WITH {_LEDGER} SELECT user_id, count(*)::BIGINT AS count, max_by(hash, seq) AS head FROM h GROUP BY user_id")
def ledger_heads(spark, sf_dir):
    return ledger.heads(_ledger(spark, sf_dir), "user_id")


@query(f"WITH {_LEDGER} SELECT user_id, event_id, seq, prev, hash FROM h")
def ledger_append(spark, sf_dir):
    """Ledgers of the first two thirds of all events, to which the others are appended."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("type"), F.col("props").alias("payload"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    cut = e.agg(F.max("event_id")).first()[0] * 2 // 3
    first = kept(ledger.appended(e.where(F.col("event_id") <= cut), "user_id", "event_id"), "ledger")
    more = ledger.appended(e.where(F.col("event_id") > cut), "user_id", "event_id", ledger.heads(first, "user_id"))
    return first.unionByName(more).select("user_id", "event_id", "seq", "prev", "hash")


@query(f"WITH {_LEDGER}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM h) SELECT user_id, count(*) FILTER (NOT (user_id % 3 = 0 AND seq = n - 1))::BIGINT AS good, count(*) FILTER (user_id % 3 = 0 AND seq = n - 1)::BIGINT AS torn FROM n GROUP BY user_id")
def ledger_text_scan(spark, sf_dir):
    """Ledgers written as lines, many to a file, every third one's last line cut off, and read back."""
    rows = ledger.to_lines(_ledger(spark, sf_dir), "user_id")
    last = rows.groupBy("user_id").agg(F.max("seq").alias("last"))
    line = F.when((F.col("user_id") % 3 == 0) & (F.col("seq") == F.col("last")), F.substring("line", 1, 40)).otherwise(F.col("line"))
    path = scratch(spark, "lines")
    cut = rows.join(last, "user_id").select(F.col("user_id").alias("ledger"), "seq", line.alias("line"))
    ledger.whole(cut, "ledger").sortWithinPartitions("ledger", "seq").select(F.concat_ws("\t", "ledger", "line")).write.text(path)
    read = ledger.from_text(spark, path, named=True)
    checked = ledger.violations(read.where("not torn"), "ledger")
    sums = read.groupBy("ledger").agg(F.count_if(~F.col("torn")).alias("good"), F.count_if("torn").alias("torn"))
    bad = checked.groupBy("ledger").agg(F.count(F.lit(1)).alias("bad"))
    good = (F.col("good") - F.coalesce("bad", F.lit(0))).alias("good")
    return sums.join(bad, "ledger", "left").select(F.col("ledger").cast("long").alias("user_id"), good, "torn")


#: The capabilities that each capability requires.
REQUIRES = {"solid_surface": [], "topography": ["solid_surface"], "tectonics": ["solid_surface"], "ocean": ["solid_surface", "topography"], "climate": [], "surface_material": ["solid_surface"], "thermal_state": [], "stellar_structure": []}
#: Every part requires that of a third of its key, and some the next one, which requires them.
_EDGES = """SELECT p_partkey AS id, p_partkey // 3 AS needs FROM part WHERE p_partkey >= 3 UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 50 = 7 UNION SELECT p_partkey + 1, p_partkey FROM part WHERE p_partkey % 50 = 7"""


@query(f"""WITH RECURSIVE e AS ({_EDGES}), c(id, needs, depth) AS (SELECT id, needs, 1 FROM e UNION SELECT c.id, e.needs, c.depth + 1 FROM c JOIN e ON e.id = c.needs WHERE c.depth < 20)
SELECT id, needs, min(depth)::INT AS depth, id = needs AS cyclic FROM c GROUP BY id, needs""")
def capability_closure(spark, sf_dir):
    """What each part requires, directly or through others; a part that requires itself is on a cycle."""
    k, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    some = p.where(k % 50 == 7)
    edges = p.where(k >= 3).select(k.alias("id"), F.expr("p_partkey div 3").alias("needs")).unionByName(some.select(k.alias("id"), (k + 1).alias("needs"))).unionByName(some.select((k + 1).alias("id"), k.alias("needs")))
    return graph.closure(edges).withColumn("cyclic", F.col("id") == F.col("needs"))


#: A base's row lies at half the key; some rows are based on each other, some on none that is.
_BASES = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 90 = 5 THEN s_suppkey + 1 WHEN s_suppkey % 90 = 6 THEN s_suppkey - 1 WHEN s_suppkey % 77 = 0 THEN -s_suppkey WHEN s_suppkey > 1 THEN s_suppkey // 2 END AS base, s_acctbal AS v FROM supplier"""


@query(f"""WITH RECURSIVE s AS ({_BASES}), c(id, pos, total, steps) AS (SELECT id, id, 0e0, 0 FROM s UNION ALL SELECT c.id, s.base, c.total + s.v, c.steps + 1 FROM c JOIN s ON s.id = c.pos WHERE s.base IS NOT NULL AND c.steps < 40),
z AS (SELECT c.*, s.id IS NULL AS lost, s.base IS NULL AS done FROM c LEFT JOIN s ON s.id = c.pos), l AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY id ORDER BY steps DESC) = 1)
SELECT id, CASE WHEN lost THEN 'dangling' WHEN NOT done THEN 'cycle' END AS code, CASE WHEN done AND NOT lost THEN pos END AS "end", CASE WHEN done AND NOT lost THEN round(total, 4) END AS total, CASE WHEN done AND NOT lost THEN steps::BIGINT END AS steps FROM l""")
def surface_chain(spark, sf_dir):
    """Each surface's offset over the one that its chain of bases ends at."""
    base = F.expr("CASE WHEN s_suppkey % 90 = 5 THEN s_suppkey + 1 WHEN s_suppkey % 90 = 6 THEN s_suppkey - 1 WHEN s_suppkey % 77 = 0 THEN -s_suppkey WHEN s_suppkey > 1 THEN s_suppkey div 2 END")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), base.alias("base"), F.col("s_acctbal").alias("v"))
    return graph.chains(rows, "v").withColumn("total", F.round("total", 4))


@query("""WITH f AS (SELECT n_nationkey, n_name, r_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS ordinal FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, n_name, r_name, ordinal::INT AS ordinal FROM customer LEFT JOIN f ON c_nationkey = n_nationkey""")
def feature_ref_join(spark, sf_dir):
    """Values that refer to features, with the features' dense ordinals."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    f = n.join(r, n["n_regionkey"] == r["r_regionkey"]).withColumn("ordinal", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")))
    c = table(spark, sf_dir, "customer")
    return c.join(f, c["c_nationkey"] == f["n_nationkey"], "left").select("c_custkey", "n_name", "r_name", "ordinal")


@query(f"SELECT n_nationkey, row_number() OVER (ORDER BY ukey) AS ordinal FROM (SELECT n_nationkey, (n_nationkey::HUGEINT * 7046029254386353131) % 18446744073709551616 AS ukey FROM nation)")
def feature_ordinals_unsigned(spark, sf_dir):
    """Dense ranks by unsigned 64-bit ids that live in signed columns."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", bits.mul64(F.col("n_nationkey").cast("long"), 7046029254386353131).alias("id"))
    return content.numbered(n, "ordinal", bits.ukey(F.col("id"))).select("n_nationkey", "ordinal")


@query("SELECT lang, quality, count(*)::BIGINT AS n, avg(length(text)) AS mean_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, quality")
def vocab_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("mean_chars"))


@query("""WITH s AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type <> 'purchase' GROUP BY ALL)
SELECT q.event_id AS query_id, q.user_id, s.event_id AS state_id FROM (SELECT * FROM events WHERE event_type = 'purchase') q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.ts >= s.ts""")
def latest_state_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    asked = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("query_id"))
    known = e.where("event_type <> 'purchase'").select("user_id", "ts", F.col("event_id").alias("state_id"))
    return states.as_of(asked, known, "user_id", "ts", ["state_id"], F.unix_date(F.col("ts").cast("date"))).select("query_id", "user_id", "state_id")


@query("""WITH l AS (SELECT user_id % 50 AS grp, user_id, max_by(event_type, (ts, event_type = 'purchase')) AS last FROM events WHERE event_type IN ('purchase', 'click') GROUP BY ALL)
SELECT grp, count(*)::BIGINT AS members FROM l WHERE last = 'purchase' GROUP BY grp""")
def membership_fold(spark, sf_dir):
    """Members by their last joining (purchase) or leaving (click) event."""
    e = table(spark, sf_dir, "events").withColumn("grp", F.col("user_id") % 50)
    return states.members(e, "grp", "user_id", "ts", F.col("event_type") == "purchase", F.col("event_type") == "click")


_TYPES = {0: "u8", 1: "i8", 2: "u16", 3: "i16", 4: "u32", 5: "i32", 6: "f32"}
_WIDE = "(l_orderkey % 200 - 100) * power(10, l_linenumber)::BIGINT"


@query(f"""WITH r AS (SELECT {_WIDE} AS raw, CASE l_partkey % 7 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _TYPES.items())} END AS dtype FROM lineitem)
SELECT dtype, count(*)::BIGINT AS n, min(raw) AS low, max(raw) AS high FROM r WHERE NOT CASE dtype WHEN 'u8' THEN raw BETWEEN 0 AND 255 WHEN 'i8' THEN raw BETWEEN -128 AND 127 WHEN 'u16' THEN raw BETWEEN 0 AND 65535
WHEN 'i16' THEN raw BETWEEN -32768 AND 32767 WHEN 'i32' THEN raw BETWEEN -2147483648 AND 2147483647 ELSE raw BETWEEN 0 AND 4294967295 END GROUP BY dtype""")
def dtype_range_violations(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _TYPES.values())), (F.col("l_partkey") % 7 + 1).cast("int"))
    raw = (F.col("l_orderkey") % 200 - 100) * F.power(F.lit(10.0), "l_linenumber").cast("long")
    r = table(spark, sf_dir, "lineitem").select(raw.alias("raw"), kind.alias("dtype"))
    return r.where(~grid.dtype_fits(F.col("raw"), F.col("dtype"))).groupBy("dtype").agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high"))


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness_violations(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


_DECIMALS = ["1", "1.0", "-0", "0", "-12.50", "1e5", "1E5", "1e+5", "01", ".5", "5.", "1e-7", "12.5e3", "1e05", "-1e9999", "abc", "", "1e99999999999", "-3.00e-2"]
#: Fixed value: the grammar of decimal texts.
_DEC = r"^(-?)(0|[1-9][0-9]*)(?:\.([0-9]+))?(?:e(-?[1-9][0-9]*|0))?$"


@query(f"""WITH v AS (SELECT * FROM (VALUES {", ".join(f"('{d}')" for d in _DECIMALS)}) AS d(text)), p AS (SELECT text, regexp_matches(text, '{_DEC}') AS shaped, regexp_extract(text, '{_DEC}', 1) AS sign,
regexp_extract(text, '{_DEC}', 2) || regexp_extract(text, '{_DEC}', 3) AS coeff, length(regexp_extract(text, '{_DEC}', 3)) AS frac, try_cast(coalesce(nullif(regexp_extract(text, '{_DEC}', 4), ''), '0') AS BIGINT) AS e FROM v),
q AS (SELECT *, shaped AND e BETWEEN -2147483648 AND 2147483647 AND NOT (sign = '-' AND regexp_matches(coeff, '^0*$')) AS valid FROM p)
SELECT text, valid, CASE WHEN valid THEN sign = '-' END AS negative, CASE WHEN valid THEN coeff END AS coeff, CASE WHEN valid THEN e - frac END AS exp10,
CASE WHEN valid AND NOT isinf(try_cast(text AS DOUBLE)) THEN try_cast(text AS DOUBLE) END AS value FROM q""")
def decimal_parse(spark, sf_dir):
    """Exact decimal texts: sign, coefficient and exponent; values that overflow are null."""
    part = lambda k: F.regexp_extract("text", _DEC, k)
    v = spark.createDataFrame([(d,) for d in _DECIMALS], "text string").withColumns({"e": F.coalesce(F.nullif(part(4), F.lit("")), F.lit("0")).try_cast("long"), "coeff": F.concat(part(2), part(3)), "negative": part(1) == "-"})
    valid = F.coalesce(F.rlike("text", F.lit(_DEC)) & F.col("e").between(-(1 << 31), (1 << 31) - 1) & ~(F.col("negative") & F.rlike("coeff", F.lit("^0*$"))), F.lit(False))
    number = F.col("text").try_cast("double")
    v = v.withColumn("valid", valid)
    return v.select("text", "valid", F.when(valid, F.col("negative")).alias("negative"), F.when(valid, F.col("coeff")).alias("coeff"), F.when(valid, F.col("e") - F.length(part(3))).alias("exp10"), F.when(valid & (F.abs(number) < float("inf")), number).alias("value"))


_TIMES = ["0", "-0", "1", "-1", "01", "+1", "170141183460469231731687303715884105727", "170141183460469231731687303715884105728", "-170141183460469231731687303715884105728", "1.0", "", "x"]


@query(f"""WITH v AS (SELECT * FROM (VALUES {", ".join(f"('{d}')" for d in _TIMES)}) AS d(text)) SELECT text, coalesce(regexp_matches(text, '^(0|-?[1-9][0-9]*)$') AND try_cast(text AS HUGEINT) IS NOT NULL, false) AS valid,
CASE WHEN regexp_matches(text, '^(0|-?[1-9][0-9]{{0,17}})$') THEN text::BIGINT END AS nanos FROM v""")
def utime_parse(spark, sf_dir):
    """Canonical 128-bit nanosecond texts, compared as texts at the range's ends."""
    v = spark.createDataFrame([(d,) for d in _TIMES], "text string")
    digits = F.regexp_replace("text", "^-", "")
    most = F.when(F.startswith("text", F.lit("-")), "170141183460469231731687303715884105728").otherwise("170141183460469231731687303715884105727")
    fits = (F.length(digits) < 39) | ((F.length(digits) == 39) & (digits <= most))
    return v.select("text", (F.rlike("text", F.lit("^(0|-?[1-9][0-9]*)$")) & fits).alias("valid"), F.when(F.rlike("text", F.lit("^(0|-?[1-9][0-9]{0,17})$")), F.col("text").try_cast("long")).alias("nanos"))


_SIGNED = "CASE WHEN {0} >= 9223372036854775808 THEN ({0}::HUGEINT - 18446744073709551616)::BIGINT ELSE {0}::BIGINT END"


@query(f"WITH b AS (SELECT DISTINCT l_orderkey AS id, l_orderkey * 1000003 AS x FROM lineitem), {sql.mixed('x', 'f', 'b')} SELECT id, {_SIGNED.format('m')} AS mixed FROM f")
def mix64(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).distinct().withColumn("x", F.col("id") * 1000003)
    return mixing64.with_mix64(b, "x", "mixed").select("id", "mixed")


@query(
    f"WITH b AS (SELECT DISTINCT l_orderkey AS id, xor(l_orderkey * 1000003, 81985529216486895)::UBIGINT AS x, (l_orderkey % 4)::UHUGEINT AS q FROM lineitem), {sql.mixed('x', 'f', 'b')}, "
    f"g AS (SELECT id, (m + q * {mixing64.GOLDEN}::UHUGEINT) % 18446744073709551616::UHUGEINT AS y FROM f), {sql.mixed('y', 'h', 'g')} SELECT id, {_SIGNED.format('m')} AS detail FROM h"
)
def detail_hash(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).distinct().withColumns({"x": F.col("id") * 1000003, "q": F.col("id") % 4})
    return mixing64.with_detail_hash(b, 81985529216486895, "x", "q", "detail").select("id", "detail")


@query("""SELECT DISTINCT l_orderkey AS id, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS zig, v AS back, '0x' || lpad(lower(to_hex(256 + l_partkey % 49)), 4, '0') || lpad(lower(to_hex(l_suppkey)), 4, '0') AS field_id
FROM (SELECT *, l_orderkey * (CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END) AS v FROM lineitem)""")
def zigzag_fieldid(spark, sf_dir):
    v = F.col("l_orderkey") * F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1)
    l = table(spark, sf_dir, "lineitem").withColumn("zig", bits.zigzag(v.cast("long")))  # noqa: E741
    field = F.shiftleft(256 + F.col("l_partkey") % 49, 16).bitwiseOR(F.col("l_suppkey"))
    return l.select(F.col("l_orderkey").alias("id"), "zig", bits.unzigzag(F.col("zig")).alias("back"), F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(field), 8, "0"))).alias("field_id")).distinct()


@query("SELECT c_custkey AS id, CASE WHEN e < -1e-9 THEN 'bound' WHEN e > 1e-9 THEN 'unbound' ELSE 'escaping' END AS orbit FROM (SELECT c_custkey, c_acctbal * c_acctbal / 2e6 - 398600.4418e0 / (6371e0 + c_custkey) AS e FROM customer)")
def orbit_energy_class(spark, sf_dir):
    """Specific orbital energy from speed and distance, by its sign."""
    e = F.expr("c_acctbal * c_acctbal / 2e6 - 398600.4418e0 / (6371e0 + c_custkey)")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(e < -1e-9, "bound").when(e > 1e-9, "unbound").otherwise("escaping").alias("orbit"))


@query("""SELECT o_orderkey AS id, round(cos(a), 7) + 0e0 AS qw, round(sin(a), 7) + 0e0 AS qz FROM (SELECT o_orderkey, pi() * ((epoch_us(o_orderdate) % 86164090531) / 86164090531e0) AS a FROM orders)""")
def uniform_rotation(spark, sf_dir):
    """Orientation at a time: a turn about the z axis by the phase of its period."""
    phase = F.pmod(F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.lit(86164090531)) / F.lit(86164090531.0)
    half = F.pi() * phase
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.round(F.cos(half), 7) + 0.0).alias("qw"), (F.round(F.sin(half), 7) + 0.0).alias("qz"))


#: Every part becomes a field; some are spoiled by their keys, so that each rule has breaches.
_FIELD = {
    "id": "concat('', p_partkey % 1900)",
    "capability": "CASE WHEN p_partkey % 11 = 0 THEN 'nothing' ELSE 'topography' END",
    "domain": "CASE p_partkey % 13 WHEN 0 THEN 'lost' WHEN 1 THEN 'shells' ELSE 'faces' END",
    "semantic": "CASE WHEN p_partkey % 17 = 0 THEN 'vector.wind' ELSE 'scalar.height' END",
    "persistence": "CASE WHEN p_partkey % 19 = 0 THEN 'dynamic' ELSE 'invariant' END",
    "dtype": "CASE WHEN p_partkey % 23 = 0 THEN 'f64' ELSE 'i16' END",
    "scale": "CASE p_partkey % 7 WHEN 0 THEN '0.0' WHEN 1 THEN '-1' ELSE '0.5' END",
    "nodata": "CASE WHEN p_partkey % 5 = 0 THEN p_partkey * 100 END",
    "interp": "CASE WHEN p_partkey % 3 = 0 THEN 'linear' ELSE 'bilinear' END",
    "downsample": "CASE WHEN p_partkey % 29 = 0 THEN 'median' ELSE 'mean' END",
    "native_level": "p_partkey % 12",
    "slices": "p_size * 1500",
    "compat": "CASE WHEN p_partkey % 4 = 0 THEN 'ancillary' ELSE 'critical' END",
}
_FIELD_SQL = "SELECT " + ", ".join(f"{x} AS {c}" for c, x in _FIELD.items()) + " FROM part"
_DOMAINS = "(VALUES ('faces', 'cube', 10), ('shells', 'radial', 8)) AS d(id, topology, max_level)"


@query(f"""WITH f AS ({_FIELD_SQL}), c AS (SELECT f.*, d.topology, d.max_level FROM f LEFT JOIN {_DOMAINS} ON f.domain = d.id WHERE compat = 'critical')
SELECT 'field-semantic' AS code, id AS subject FROM c WHERE NOT regexp_matches(semantic, '^(scalar\\.[a-z_]+|category|feature_ref|flags)$') UNION ALL
SELECT 'field-persistence', id FROM c WHERE persistence NOT IN ('invariant', 'periodic_mean', 'initial_state') UNION ALL SELECT 'field-dtype', id FROM c WHERE dtype = 'f64' UNION ALL
SELECT 'field-scale', id FROM c WHERE scale IN ('0.0', '-1') UNION ALL SELECT 'field-nodata', id FROM c WHERE nodata IS NOT NULL AND (dtype = 'f64' OR nodata NOT BETWEEN -32768 AND 32767) UNION ALL
SELECT 'field-interp', id FROM c WHERE CASE WHEN topology = 'radial' THEN interp <> 'linear' ELSE interp <> 'bilinear' END UNION ALL SELECT 'field-downsample', id FROM c WHERE downsample = 'median' UNION ALL
SELECT 'field-level', id FROM c WHERE native_level > max_level UNION ALL SELECT 'field-temporal', id FROM c WHERE slices < 1 OR slices > 65535 UNION ALL
SELECT 'field-duplicate', id FROM f GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'field-domain', id FROM c WHERE domain = 'lost' UNION ALL SELECT 'field-capability', id FROM c WHERE capability = 'nothing'""")
def metadata_violations(spark, sf_dir):
    """Every breach of the registry's rules, as rows."""
    p = table(spark, sf_dir, "part").select(*(F.expr(x).alias(c) for c, x in _FIELD.items()))
    domains = spark.sql(f"SELECT * FROM {_DOMAINS}")
    known = spark.createDataFrame([(c,) for c in REQUIRES], "id string")
    return validate.fields(p, domains, known)


@query("""WITH o AS (SELECT o_orderkey AS id, (o_orderkey % 90) / 100e0 AS k, (o_custkey % 6283) / 1000e0 AS m FROM orders),
e AS (SELECT id, k, m, list_reduce(list_concat([m + k * sin(m)], [0e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0]), lambda a, b: a - (a - k * sin(a) - m) / (1 - k * cos(a))) AS e FROM o)
SELECT id, round(e, 6) AS anomaly, round(1 - k * cos(e), 6) AS radius FROM e""")
def kepler_propagation(spark, sf_dir):
    """Elliptic orbits at a mean anomaly: eccentric anomaly by twelve Newton steps, and radius."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("(o_orderkey % 90) / 100e0").alias("k"), F.expr("(o_custkey % 6283) / 1000e0").alias("m"))
    step = lambda a, _: a - (a - F.col("k") * F.sin(a) - F.col("m")) / (1 - F.col("k") * F.cos(a))
    e = o.withColumn("e", F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.col("m") + F.col("k") * F.sin("m"), step))
    return e.select("id", F.round("e", 6).alias("anomaly"), F.round(1 - F.col("k") * F.cos("e"), 6).alias("radius"))


@query("SELECT c_custkey AS id, (c_custkey::HUGEINT * 1000000000000 + 123456789012345678901::HUGEINT)::VARCHAR AS x FROM customer")
def exact_frame_change(spark, sf_dir):
    """Positions in integer micrometres moved by an exact offset beyond 64 bits."""
    x = F.col("c_custkey").cast("decimal(38,0)") * F.lit("1000000000000").cast("decimal(19,0)") + F.lit("123456789012345678901").cast("decimal(38,0)")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), x.cast("decimal(38,0)").cast("string").alias("x"))
