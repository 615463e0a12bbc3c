"""Ledgers where joins change while they run."""

import pytest

from orrery.operators import ledger


@pytest.fixture
def turning(spark):
    """Joins are planned as sorted ones and become broadcasts once their sizes are known."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_appending_behind_heads(spark, turning):
    e = spark.range(0, 3000, 1, 8).selectExpr("id * 7 % 50 as who", "id as n", "'x' as type", "concat('p', id) as payload", "id * 1000 as t")
    first = ledger.appended(e.where("n < 2000"), "who", "n")
    more = ledger.appended(e.where("n >= 2000"), "who", "n", ledger.heads(first, "who"))
    got = sorted((r.who, r.seq, r.n, r.prev, r.hash) for r in first.unionByName(more).collect())
    assert got == sorted((r.who, r.seq, r.n, r.prev, r.hash) for r in ledger.appended(e, "who", "n").collect())
    assert [s for _, s, *_ in got] == [*range(60)] * 50
    assert ledger.violations(first.unionByName(more), "who").count() == 0


@pytest.mark.parametrize("bad", [("", "p", 1), ("x", None, 1), ("x", "p", None)])
def test_entries_without_members_are_refused(spark, bad):
    e = spark.createDataFrame([(1, 1, *bad)], "who long, n long, type string, payload string, t long")
    with pytest.raises(Exception, match="no type, payload or time"):
        ledger.appended(e, "who", "n").collect()


def test_many_ledgers_in_few_files(spark, tmp_path):
    e = spark.range(0, 600, 1, 4).selectExpr("id * 7 % 50 as who", "id as n", "'x' as type", "concat('p\t', id) as payload", "id * 1000 as t")
    lines = ledger.to_lines(ledger.appended(e, "who", "n"), "who")
    cut = lines.selectExpr("who", "seq", "concat(who, '\t', if(who % 3 = 0 and seq = 11, substr(line, 1, 30), line)) as line")
    ledger.whole(cut, "who").sortWithinPartitions("who", "seq").select("line").write.text(f"{tmp_path}/lines")
    read = ledger.from_text(spark, f"{tmp_path}/lines", named=True)
    assert {r.ledger for r in read.where("torn").collect()} == {str(k) for k in range(0, 50, 3)} and read.count() == 600
    assert ledger.violations(read.where("not torn"), "ledger").count() == 0
    assert len(list(tmp_path.glob("lines/part-*"))) <= 8
