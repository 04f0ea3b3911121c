import gzip
import json

import pytest

from cladeworks.sources import formats
from cladeworks.streaming.counts import running_counts


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(b">x first one\nACGT\nAC\n>y\n\n>z  c\nGG-T\n"))
    got = [tuple(r) for r in formats.read_fasta(spark, str(tmp_path / "a.fa.gz")).collect()]
    assert got == [("x", "first one", "ACGTAC"), ("y", "", ""), ("z", "c", "GG-T")]
    rows = spark.createDataFrame([("x", "A" * 120), ("y", "C" * 50)], "name string, seq string")
    formats.write_fasta(rows, str(tmp_path / "out"))
    assert sorted(tuple(r)[::2] for r in formats.read_fasta(spark, str(tmp_path / "out")).collect()) == [("x", "A" * 120), ("y", "C" * 50)]


def test_stockholm(spark, tmp_path):
    (tmp_path / "a.stock").write_text("# STOCKHOLM 1.0\n#=GF ID one\n#=GS x DE text here\nx AC\ny A-\n#=GC SS ..\n\nx GT\ny -T\n//\n# STOCKHOLM 1.0\nx A\n//\n")
    rows, notes = formats.read_stockholm(spark, str(tmp_path / "a.stock"))
    assert sorted((r["name"], r.gapped) for r in rows.collect()) == [("x", "A"), ("x", "ACGT"), ("y", "A--T")]
    assert sorted((r.kind, r.tag, r["name"], r.value) for r in notes.collect()) == [("GC", "SS", "", ".."), ("GF", "ID", "", "one"), ("GS", "DE", "x", "text here")]


def test_newick_and_nexus(spark, tmp_path):
    (tmp_path / "t.nh").write_text("(a:1,b:2)r;\n((c:1,d:1):2,e:3);\n")
    assert formats.read_newick(spark, str(tmp_path / "t.nh")).groupBy("ds").count().select("count").toPandas()["count"].tolist() == [3, 5]
    text = formats.nexus([("a", "AC*-"), ("b", "ACGT")], "(a:1,b:2);")
    assert formats.parse_nexus(text) == ({"a": "AC*-", "b": "ACGT"}, "(a:1,b:2);")
    with pytest.raises(ValueError):
        formats.parse_nexus(text.replace("TREE tree", "tree x = (a,b);\nTREE tree"))


def test_running_counts(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.json").write_text("".join(json.dumps({"cpt": 0, "kind": "sub", "i": "A", "j": j, "value": v}) + "\n" for j, v in (("C", 1.5), ("G", 2.0))))
    q = running_counts(spark, str(tmp_path)).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    assert sorted((r.j, r.value) for r in spark.sql("SELECT * FROM sums").collect()) == [("C", 3.0), ("G", 4.0)]
    q.stop()
