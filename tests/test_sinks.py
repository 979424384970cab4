"""Archives read as one ledger; runs that replace some engagements' results, also when one fails."""

import pathlib
import zipfile

import pytest

from auditlake.sources import results
from auditlake.sources.ledger import read_gl

SCHEMA = "engagement_id int, rule_code string, amount double"


def test_members_of_three_archives_are_one_ledger(spark, tmp_path):
    files = {"a.zip": {"x/one.csv": "entry_no,user\n1,kim\n2,\n\n", "two.txt": "entry_no\tamount\n3\t5,5\n", "__MACOSX/x/one.csv": "junk\n1\n", "note.pdf": "no"}, "b.zip": {"three.CSV": '﻿entry_no,"text"\n4,"line one\nline two"\n5\n'}, "c.zip": {"empty.csv": "", "big.csv": "entry_no\n" + "\n".join(map(str, range(100, 25_100))) + "\n"}}
    for name, held in files.items():
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for member, body in held.items():
                z.writestr(member, body)
    df = read_gl(spark, [str(tmp_path / "a.zip"), f"file://{tmp_path}/b.zip", str(tmp_path / "c.zip")], "zip")
    assert df.columns == ["entry_no", "amount", "user", "text"] and df.rdd.getNumPartitions() == 5  # a task a member
    rows = sorted((tuple(r) for r in df.collect() if int(r.entry_no) < 100), key=lambda r: int(r[0]))
    assert rows == [("1", None, "kim", None), ("2", None, None, None), ("3", "5,5", None, None), ("4", None, None, "line one\nline two"), ("5", None, None, None)]
    assert df.count() == 25_005


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet") if "_manifest" not in str(p)}


def test_a_second_run_replaces_its_engagements_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    read = lambda: sorted(map(tuple, results.read_results(spark, path, SCHEMA).select("engagement_id", "rule_code", "amount").collect()))
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert read() == []
    results.replace_results(frame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (3, "c", 4.0)]), path)
    before = files_of(path)
    results.replace_results(frame([(1, "a", 9.0)]), path, frame([(1, "", 0.0), (3, "", 0.0)]))  # 1 has one rule less, 3 none
    want = [(1, "a", 9.0), (2, "a", 3.0)]
    assert read() == want
    assert before.items() <= files_of(path).items()  # nothing of the first run was touched
    # a run that fails while it writes its rows
    bad = frame([(2, "a", 7.0)]).selectExpr("engagement_id", "rule_code", "assert_true(engagement_id > 5) is null as amount").selectExpr("engagement_id", "rule_code", "cast(amount as double) as amount")
    with pytest.raises(Exception):
        results.replace_results(bad, path)
    assert read() == want
    # one that fails between rows and manifest, and one that leaves half a manifest behind
    frame([(2, "a", 8.0)]).write.partitionBy("engagement_id", "rule_code").parquet(f"{path}/_run=lost")
    frame([]).selectExpr("engagement_id", "'lost' as _run").write.parquet(f"{path}/_manifest/v=2")
    pathlib.Path(f"{path}/_manifest/v=2/_SUCCESS").unlink()
    assert read() == want
    results.replace_results(frame([(3, "z", 5.0)]), path)
    assert read() == [*want, (3, "z", 5.0)]
