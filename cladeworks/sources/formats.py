"""Readers and writers of sequence formats as DataFrame plans; Spark's text source does the splitting and the decompression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import sequences as sq
from ..kernels import trees


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, comment, seq): records split at '>', so that a large file is read in parallel; characters that don't print are dropped."""
    rec = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("r")).where(F.trim("r") != "")
    head = F.regexp_extract("r", r"^([^\n]*)", 1)
    return rec.select(
        F.regexp_extract(head, r"^\s*(\S*)", 1).alias("name"), F.trim(F.regexp_extract(head, r"^\s*\S*(.*)", 1)).alias("comment"), F.regexp_replace(F.regexp_extract("r", r"(?s)^[^\n]*\n?(.*)$", 1), r"[^\x21-\x7E]", "").alias("seq")
    )


def write_fasta(seqs: DataFrame, path: str, width: int = 50) -> None:
    """(name, seq) as records with lines of width symbols."""
    text = F.regexp_replace(sq.fasta(F.col("name"), F.col("seq"), width), r"\n$", "")
    seqs.select(text.alias("value")).write.text(path)


def read_stockholm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Alignments split at '//': gapped rows (ds, name, gapped), repeated names joined in order, and annotation (ds, kind, tag, name, value).
    ds numbers the alignments of a file in order, not densely."""
    blocks = spark.read.text(path, lineSep="\n//").select(F.monotonically_increasing_id().alias("ds"), "value")
    lines = blocks.select("ds", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).where(F.trim("line") != "")
    row = lines.where(~F.col("line").startswith("#")).select("ds", "n", F.regexp_extract("line", r"^(\S+)\s+(\S+)\s*$", 1).alias("name"), F.regexp_extract("line", r"^(\S+)\s+(\S+)\s*$", 2).alias("part")).where("name <> ''")
    rows = row.groupBy("ds", "name").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("parts")).select("ds", "name", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("gapped"))
    note = lines.where(F.col("line").rlike("^#=G[FCRS] "))
    kind = F.substring("line", 3, 2)
    of_row = kind.isin("GR", "GS")
    part: Column = F.when(of_row, F.regexp_extract("line", r"^#=G.\s+(\S+)\s+(\S+)\s+(.*)$", 3)).otherwise(F.regexp_extract("line", r"^#=G.\s+(\S+)\s+(.*)$", 2))
    notes = note.select("ds", "n", kind.alias("kind"), F.when(of_row, F.regexp_extract("line", r"^#=G.\s+\S+\s+(\S+)", 1)).otherwise(F.regexp_extract("line", r"^#=G.\s+(\S+)", 1)).alias("tag"), F.when(of_row, F.regexp_extract("line", r"^#=G.\s+(\S+)", 1)).otherwise("").alias("name"), part.alias("value"))
    return rows, notes.select("ds", "kind", "tag", "name", "value")


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """Trees, one a ';', as node rows (ds, node, parent, name, blen) in postorder."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for ds, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = trees.parse_newick(text)
                yield pa.RecordBatch.from_arrays([pa.array([ds] * len(t)), pa.array(range(len(t)), pa.int64()), pa.array([n.parent for n in t]), pa.array([n.name for n in t]), pa.array([n.blen for n in t])], ["ds", "node", "parent", "name", "blen"])

    text = spark.read.text(path, lineSep=";").select(F.monotonically_increasing_id().alias("ds"), "value").where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    return text.mapInArrow(run, "ds long, node long, parent long, name string, blen double")


def nexus(rows: list[tuple[str, str]], newick: str) -> str:
    """DATA and TREES blocks of one alignment; unknown residues '*' are '?' there."""
    width = max((len(g) for _, g in rows), default=0)
    matrix = "\n".join(f" {n} {g.replace('*', '?')}" for n, g in rows)
    return f"#NEXUS\nBEGIN DATA;\nDIMENSIONS NTAX={len(rows)} NCHAR={width};\nFORMAT DATATYPE=PROTEIN MISSING=? GAP=-;\nMATRIX\n{matrix}\n;\nEND;\nBEGIN TREES;\nTREE tree = {newick}\nEND;\n"


def parse_nexus(text: str) -> tuple[dict[str, str], str]:
    """Gapped rows (interleaved blocks joined) and the one tree; comments in brackets and behind '#' are dropped."""
    import re

    text = re.sub(r"\[[^\]]*\]", "", re.sub(r"#[^\n]*", "", text))
    rows: dict[str, str] = {}
    matrix = re.search(r"(?is)\bmatrix\b(.*?);", text)
    for line in (matrix[1] if matrix else "").splitlines():
        parts = line.split()
        if len(parts) > 1:
            rows[parts[0]] = rows.get(parts[0], "") + "".join(parts[1:]).replace("?", "*")
    found = re.findall(r"(?is)\btree\b\s+[^=;]*=\s*([^;]*;)", text)
    if len(found) != 1:
        raise ValueError(f"{len(found)} trees; one is needed")
    return rows, found[0].strip()
