import bz2
import json
import sys

import pytest
from pyspark.sql import functions as F

from orrery.operators.assertions import CheckFailed
from orrery.operators.runs import StageTimer, ids_in, parse_counters, summarize_runs, timed_command
from orrery.sources import readers as R
from orrery.sources import sinks as K
from orrery.sources import xmlpages as X
from orrery.streaming.counts import running_totals, running_word_count, stream_table


def test_raw_facts_keep_quotes_and_tabs(spark, tmp_path):
    (tmp_path / "p.tsv").write_text('record_id\tdimension_key\tword_count\ttext_bytes\ttext\n1\t0\t2\t5\t"quoted start\twith tab\n')
    row = R.read_raw_facts(spark, str(tmp_path / "p.tsv")).first()
    assert row["text"] == '"quoted start\twith tab' and row["word_count"] == 2
    (tmp_path / "bad.tsv").write_text("1\t0\t2\n")
    with pytest.raises(Exception, match="malformed record"):
        R.read_raw_facts(spark, str(tmp_path / "bad.tsv")).collect()


def test_quoted_round_trip_and_immutability(spark, tmp_path):
    df = spark.createDataFrame([("U", "u-1", "t", "CDR", 2, 'say "hi"\tnow')], R.UTTERANCES)
    K.write_quoted(df, str(tmp_path / "q"))
    assert R.read_quoted(spark, str(tmp_path / "q"), R.UTTERANCES).collect() == df.collect()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        K.write_quoted(df, str(tmp_path / "q"))
    K.write_raw(df.select("utterance_id", "word_count"), str(tmp_path / "r"))
    assert [tuple(r) for r in R.read_parts(spark, str(tmp_path / "r"), "i string, n bigint").collect()] == [("u-1", 2)]
    assert K.write_counted(df, str(tmp_path / "c"), 1) == 1
    with pytest.raises(CheckFailed):
        K.write_counted(df, str(tmp_path / "d"), 5)
    K.write_report({"a": 1}, str(tmp_path / "m.json"))
    with pytest.raises(FileExistsError):
        K.write_report({"a": 1}, str(tmp_path / "m.json"))


def test_dimensions(spark, tmp_path):
    (tmp_path / "d").write_text("dimension_key\tcategory\n0\t(main)\n0\tagain\n")
    with pytest.raises(CheckFailed, match="duplicate"):
        R.read_dimensions(spark, str(tmp_path / "d"))
    (tmp_path / "e").write_text("dimension_key\tcategory\n")
    with pytest.raises(CheckFailed, match="empty"):
        R.read_dimensions(spark, str(tmp_path / "e"))


def test_tagged_input(spark, tmp_path):
    (tmp_path / "u").write_text("record_type\tutterance_id\nU\tu-1\tt\tCDR\t2\thi\n\n")
    (tmp_path / "s").write_text("S\tCDR\tcrew\tCommander\n")
    got = R.read_tagged(spark, str(tmp_path / "u"), str(tmp_path / "s"))
    assert got["U"].count() == 1 and got["S"].first()["category"] == "crew"
    (tmp_path / "x").write_text("U\tu-1\n")
    with pytest.raises(ValueError, match="malformed"):
        R.read_tagged(spark, str(tmp_path / "x"))


def test_dump_status_and_manifest(spark, tmp_path):
    name = "x-pages-articles-multistream{}.xml-p{}p{}.bz2"
    files = {name.format(2, 3, 4): {"url": "/b", "size": 60, "sha1": "b"}, name.format(1, 10, 20): {"url": "/c", "size": 60}, name.format(1, 1, 2): {"url": "/a", "size": 50}, "index.txt": {"url": "/i", "size": 2}}
    (tmp_path / "s.json").write_text(json.dumps({"jobs": {"articles": {"files": files}, "other": {}}}))
    got = R.read_dump_status(spark, str(tmp_path / "s.json"), "https://dumps.example.org/").orderBy("part", "first").collect()
    assert [(r["part"], r["first"], r["bytes"], r["url"]) for r in got][0] == (1, 1, 50, "https://dumps.example.org/a") and len(got) == 3
    (tmp_path / "m.json").write_text(json.dumps({"parts": [{"name": "n", "url": "u", "bytes": 5, "sha1": "s"}]}))
    assert R.read_manifest(spark, str(tmp_path / "m.json"), 5).count() == 1
    with pytest.raises(CheckFailed):
        R.read_manifest(spark, str(tmp_path / "m.json"), 4)


XML = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/"><siteinfo><namespaces><namespace key="0" case="first-letter" /><namespace key="10" case="first-letter">Template</namespace></namespaces></siteinfo>
<page><title>A</title><ns>0</ns><id>1</id><revision><id>7</id><text>Hello
Moon café</text></revision></page>
<page><title>B</title><ns>10</ns><id>2</id><revision><id>8</id><text>One\ttwo three</text></revision></page>
<page><title>C</title><ns>0</ns><revision><id>9</id><text>lost</text></revision></page></mediawiki>"""


@pytest.mark.parametrize("packed", [False, True])
def test_xml_pages(spark, tmp_path, packed):
    at = tmp_path / ("d.xml.bz2" if packed else "d.xml")
    at.write_bytes(bz2.compress(XML.encode()) if packed else XML.encode())
    pages = X.read_pages(spark, str(at))
    assert sorted((r["record_id"], r["text"], r["word_count"], r["text_bytes"]) for r in X.facts_of(pages).collect()) == [("1", "Hello Moon café", 3, 16), ("2", "One two three", 3, 13)]
    assert pages.where("not well_formed").count() == 1
    assert [tuple(r) for r in X.read_namespaces(spark, str(at)).collect()] == [("0", "(main)"), ("10", "Template")]


def test_broken_xml(spark, tmp_path):
    (tmp_path / "e.xml").write_text("")
    with pytest.raises(CheckFailed):
        X.read_pages(spark, str(tmp_path / "e.xml"))
    (tmp_path / "t.xml").write_text("<mediawiki><page>")
    with pytest.raises(Exception):
        X.read_pages(spark, str(tmp_path / "t.xml")).collect()


def test_run_records(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    say = "print('application_123_0001'); print('CPU time spent (ms)=17'); print('   Map input records=3')"
    assert timed_command([sys.executable, "-c", say], str(tmp_path / "deep/a.json"), label="x", engine="e", dataset_id="d", output_rows=1) == 0
    assert timed_command([sys.executable, "-c", "raise SystemExit(7)"], str(tmp_path / "b.json"), label="x", engine="e", dataset_id="d") == 7
    (tmp_path / "c.json").write_text("{broken")
    one = json.loads((tmp_path / "deep/a.json").read_text())
    assert one["application_ids"] == ["application_123_0001"] and one["hadoop_counters"] == {"cpu_time_ms": 17, "map_input_records": 3}
    row = summarize_runs(R.read_run_records(spark, str(tmp_path))).first()
    assert (row["attempts"], row["successful_attempts"]) == (2, 1) and row["median_success_seconds"] == one["elapsed_seconds"]
    logs = spark.createDataFrame([("r", 1, " Map input records = 3"), ("r", 2, "Map input records=4"), ("r", 3, "x")], "run string, n int, line string")
    assert [tuple(r) for r in parse_counters(logs, "run", "n", "line").collect()] == [("r", "map_input_records", 4)]
    ids = logs.select(ids_in(F.lit("job_2_1 job_1_9 job_2_1"), "job").alias("i")).first()["i"]
    assert ids == ["job_1_9", "job_2_1"]
    timer = StageTimer()
    assert timer.run("s", lambda: 3) == 3 and timer.steps[0]["step"] == "s"


def test_digests_and_signatures(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert R.file_digests(spark, str(tmp_path / "f.bin")).first()["sha1"] == "a9993e364706816aba3e25717850c26c9cd0d89d"
    (tmp_path / "sig").write_text("w1\t1 2 3\n")
    assert R.read_signatures(spark, str(tmp_path / "sig")).first()["sig"] == [1, 2, 3]


def test_streams(spark, tmp_path):
    facts = spark.createDataFrame([("0", 2, 5, "go go"), ("9", 1, 1, "x")], "dimension_key string, word_count bigint, text_bytes bigint, text string")
    facts.write.parquet(str(tmp_path / "in"))
    s = stream_table(spark, str(tmp_path / "in"), facts.schema)
    running_word_count(s, "text", "words_so_far", str(tmp_path / "c1")).awaitTermination(60)
    assert {r["word"]: r["total"] for r in spark.table("words_so_far").collect()} == {"go": 2, "x": 1}
    dims = spark.createDataFrame([("0", "(main)")], "dimension_key string, category string")
    running_totals(s, dims, "dimension_key", "totals_so_far", str(tmp_path / "c2")).awaitTermination(60)
    assert [tuple(r) for r in spark.table("totals_so_far").collect()] == [("(main)", 1, 2, 5)]


def test_entry_needs_no_session():
    import subprocess
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
