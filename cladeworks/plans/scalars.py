"""Queries on formats, scalar functions and k-mers, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import sequences as sq
from ..operators import pairs
from . import base as b

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


#: documents and pages as the contents of files of several kinds
FILES_SQL = """files AS (SELECT doc_id AS id, CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN '>' || source || chr(10) || text WHEN 1 THEN chr(10) || '# STOCKHOLM 1.0' || chr(10) || text WHEN 2 THEN '#nexus' || chr(10) || text
 WHEN 3 THEN '(a:1,b:2);' WHEN 4 THEN '{"alphabet": "acgt"}' WHEN 5 THEN '>a' || chr(10) || 'AC-GT' ELSE text END AS content FROM documents)"""


def _files(spark, d):
    x, nl = F.col("doc_id") % 7, F.lit("\n")
    content = (
        F.when(x == 0, F.concat(F.lit(">"), "source", nl, "text")).when(x == 1, F.concat(nl, F.lit("# STOCKHOLM 1.0"), nl, "text")).when(x == 2, F.concat(F.lit("#nexus"), nl, "text"))
        .when(x == 3, F.lit("(a:1,b:2);")).when(x == 4, F.lit('{"alphabet": "acgt"}')).when(x == 5, F.lit(">a\nAC-GT")).otherwise(F.col("text"))
    )
    return b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), content.alias("content"))


@query("src09_detect_format", f"""WITH {FILES_SQL}, l AS (SELECT id, content, regexp_extract(content, '^\\s*([^\\n]*)', 1) AS line FROM files)
SELECT id, CASE WHEN regexp_matches(line, '^# *STOCKHOLM') THEN 'stockholm' WHEN regexp_matches(upper(line), '^#NEXUS') THEN 'nexus' WHEN line[1] = '(' THEN 'newick' WHEN line[1] = '{{' THEN 'json'
 WHEN line[1] = '>' THEN CASE WHEN regexp_matches(content, '\\n[^>\\n]*[-.]') THEN 'gapped_fasta' ELSE 'fasta' END WHEN line[1] = '@' THEN 'fastq' ELSE 'unknown' END AS format FROM l""")
def _(spark, d):
    return _files(spark, d).select("id", sq.detect_format(F.col("content")).alias("format"))


@query("snk01_fasta", f"""WITH {b.SEQS_SQL}, r AS (SELECT row, '>doc' || row || chr(10) || regexp_replace(regexp_replace(seq, '(.{{50}})', '\\1' || chr(10), 'g'), '\\n$', '') || chr(10) AS rec FROM seqs)
SELECT row, md5(rec) AS record_md5, CAST(length(rec) - length(replace(rec, chr(10), '')) AS BIGINT) AS n_lines FROM r""")
def _(spark, d):
    rec = b.sequences(spark, d).select("row", sq.fasta(F.concat(F.lit("doc"), F.col("row")), F.col("seq")).alias("rec"))
    return rec.select("row", F.md5(F.col("rec").cast("binary")).alias("record_md5"), (F.length("rec") - F.length(F.replace("rec", F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"))


@query("snk09_convert_wildcards", "SELECT doc_id AS row, md5(translate(coalesce(text, ''), '?x', '*n')) AS text_md5 FROM documents")
def _(spark, d):
    return b.table(spark, d, "documents").select(F.col("doc_id").alias("row"), F.md5(sq.convert_wildcards(F.coalesce("text", F.lit("")), "?x", "*n").cast("binary")).alias("text_md5"))


@query("scl01_tokenize", "SELECT token, CAST(count(*) AS BIGINT) AS n, CAST(sum(row) AS BIGINT) AS rows_sum FROM (SELECT doc_id AS row, CASE WHEN instr('acgt', c) > 0 THEN instr('acgt', c) - 1 WHEN instr('ACGT', c) > 0 THEN instr('ACGT', c) - 1 ELSE -1 END AS token FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), '')) AS c FROM documents)) GROUP BY 1")
def _(spark, d):
    t = b.table(spark, d, "documents").select(F.col("doc_id").alias("row"), F.explode(sq.tokenize(F.coalesce("text", F.lit("")), "acgt")).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"), F.sum("row").alias("rows_sum"))


@query("scl02_validated_tokens", f"""WITH {b.FAMILY_SQL}, c AS (SELECT row, unnest(string_split(seq, '')) AS ch FROM fam), t AS (SELECT row, instr('acg', ch) - 1 AS t FROM c),
n AS (SELECT row, t, count(*) AS n FROM t WHERE t >= 0 GROUP BY 1, 2), m AS (SELECT row, t AS mode FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY n DESC, t) AS k FROM n) WHERE k = 1)
SELECT row, CASE WHEN t >= 0 THEN t ELSE mode END AS token, CAST(count(*) AS BIGINT) AS n FROM t JOIN m USING (row) GROUP BY 1, 2""")
def _(spark, d):
    return b.family(spark, d).select("row", F.explode(sq.validated(sq.tokenize(F.col("seq"), "acg"), 3)).alias("token")).groupBy("row", "token").agg(F.count("*").alias("n"))


@query("scl03_detokenize", f"WITH {b.SEQS_SQL} SELECT row, md5(upper(seq)) AS seq_md5 FROM seqs")
def _(spark, d):
    return b.sequences(spark, d).select("row", F.md5(sq.detokenize(sq.tokenize(F.col("seq"), "acgt"), "ACGT").cast("binary")).alias("seq_md5"))


_CODON_SQL = "codons AS (SELECT substr('TCAG', a, 1) || substr('TCAG', b, 1) || substr('TCAG', c, 1) AS codon, CAST((a - 1) * 16 + (b - 1) * 4 + c - 1 AS INT) AS token, substr('" + sq.GENETIC_CODE + "', CAST((a - 1) * 16 + (b - 1) * 4 + c AS INT), 1) AS aa FROM range(1, 5) x(a), range(1, 5) y(b), range(1, 5) z(c))"


@query("scl05_codon_tokens", f"""WITH {b.SEQS_SQL}, {_CODON_SQL}, s AS (SELECT row, upper(seq) AS s, length(seq) // 3 AS n FROM seqs), i AS (SELECT row, s, n, unnest(range(0, n)) AS i FROM s),
t AS (SELECT i.row, i, n, token, aa FROM i JOIN codons ON codon = substr(s, 3 * i + 1, 3)) SELECT token, CAST(count(*) AS BIGINT) AS n, CAST(sum(i) AS BIGINT) AS places FROM t WHERE NOT (aa = '*' AND i = n - 1) GROUP BY 1""")
def _(spark, d):
    return b.sequences(spark, d).select(F.posexplode(sq.codon_tokens(F.col("seq"))).alias("i", "token")).groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("i").cast("long")).alias("places"))


@query("scl06_codon_detokenize", f"""WITH {b.SEQS_SQL}, s AS (SELECT row, upper(substr(seq, 1, 3 * (length(seq) // 3))) AS s FROM seqs)
SELECT row, md5(CASE WHEN right(s, 3) IN ('TAA', 'TAG', 'TGA') THEN left(s, length(s) - 3) ELSE s END) AS seq_md5 FROM s""")
def _(spark, d):
    return b.sequences(spark, d).select("row", F.md5(sq.codon_detokenize(sq.codon_tokens(F.col("seq"))).cast("binary")).alias("seq_md5"))


@query("scl07_codon_alphabet", f"WITH {_CODON_SQL} SELECT token, codon, aa FROM codons")
def _(spark, d):
    base = spark.range(4).select((F.col("id") + 1).cast("int").alias("i"), F.substring(F.lit(sq.BASES), (F.col("id") + 1).cast("int"), F.lit(1)).alias("x"))
    three = [base.select(F.col("i").alias(f"i{k}"), F.col("x").alias(f"x{k}")) for k in range(3)]
    token = (F.col("i0") - 1) * 16 + (F.col("i1") - 1) * 4 + F.col("i2") - 1
    return three[0].join(three[1]).join(three[2]).select(token.alias("token"), F.concat("x0", "x1", "x2").alias("codon"), F.substring(F.lit(sq.GENETIC_CODE), token + 1, F.lit(1)).alias("aa"))


@query("scl08_translate", f"""WITH {b.SEQS_SQL}, {_CODON_SQL}, f AS (SELECT row, frame, upper(substr(CASE WHEN frame < 0 THEN reverse(translate(seq, 'acgt', 'tgca')) ELSE seq END, CAST(CASE WHEN frame < 0 THEN -frame ELSE frame + 1 END AS INT))) AS s FROM seqs, range(-3, 3) r(frame)),
i AS (SELECT row, frame, s, unnest(range(0, length(s) // 3)) AS i FROM f)
SELECT row, frame, md5(string_agg(aa, '' ORDER BY i)) AS protein_md5, CAST(count(*) AS BIGINT) AS n FROM i JOIN codons ON codon = substr(s, 3 * i + 1, 3) GROUP BY 1, 2""")
def _(spark, d):
    frames = F.array(*[F.struct(F.lit(f).cast("long").alias("frame"), sq.translated(F.col("seq"), f).alias("p")) for f in range(-3, 3)])
    rows = b.sequences(spark, d).select("row", F.explode(frames).alias("x")).select("row", "x.*").where("p <> ''")
    return rows.select("row", "frame", F.md5(F.col("p").cast("binary")).alias("protein_md5"), F.length("p").cast("long").alias("n"))


@query("scl09_gaps", "SELECT doc_id AS row, CAST(length(text) - length(replace(replace(text, '-', ''), '.', '')) AS BIGINT) AS gaps, CAST(length(text) - length(replace(text, '*', '')) AS BIGINT) AS wildcards FROM documents")
def _(spark, d):
    return b.table(spark, d, "documents").select(F.col("doc_id").alias("row"), (F.length("text") - F.length(sq.ungap(F.col("text")))).cast("long").alias("gaps"), (F.length("text") - F.length(F.replace("text", F.lit("*"), F.lit("")))).cast("long").alias("wildcards"))


@query("src04_nexus_rows", "SELECT doc_id AS row, md5(translate(coalesce(text, ''), '?', '*')) AS internal_md5, md5(translate(coalesce(text, ''), '*', '?')) AS nexus_md5 FROM documents")
def _(spark, d):
    text = F.coalesce("text", F.lit(""))
    return b.table(spark, d, "documents").select(F.col("doc_id").alias("row"), F.md5(sq.nexus_to_internal(text).cast("binary")).alias("internal_md5"), F.md5(sq.internal_to_nexus(text).cast("binary")).alias("nexus_md5"))


_WORDS = ["a", "an", "and", "the", "th", "e", "er", " ", "ing"]


@query("scl04_extended_tokens", "SELECT c.token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '(?s) |a|e|th|ing|.')) AS t FROM benchmark) x JOIN (SELECT * FROM (VALUES ('a', 0), ('th', 4), ('e', 5), (' ', 7), ('ing', 8)) v(s, token)) c ON c.s = x.t GROUP BY 1")
def _(spark, d):
    t = b.table(spark, d, "benchmark").select(F.explode(sq.extended_tokens(F.coalesce("text", F.lit("")), _WORDS)).alias("token"))
    return t.where("token >= 0").groupBy("token").agg(F.count("*").alias("n"))


@query("scl10_alphabet_check", """WITH c AS (SELECT doc_id AS row, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lower(source), '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1, 2)
SELECT d.doc_id AS row, CAST(length(source) AS BIGINT) AS n, coalesce(string_agg(ch, '' ORDER BY ch) FILTER (n > 1 OR ch IN ('-', '.')), '') AS problems, coalesce(count(ch) FILTER (n > 1 OR ch IN ('-', '.')), 0) = 0 AS valid
FROM documents d LEFT JOIN c ON c.row = d.doc_id WHERE source IS NOT NULL GROUP BY d.doc_id, source""")
def _(spark, d):
    wrong = sq.alphabet_problems(F.lower("source"))
    return b.table(spark, d, "documents").where("source IS NOT NULL").select(F.col("doc_id").alias("row"), F.length("source").cast("long").alias("n"), F.array_join(wrong, "").alias("problems"), (F.size(wrong) == 0).alias("valid"))


@query("scl11_kmer_codes", f"""WITH {b.SEQS_SQL}, p AS (SELECT seq, unnest(range(1, length(seq) - 4)) AS p FROM seqs), k AS (SELECT substr(seq, p, 6) AS k FROM p WHERE p <= length(seq) - 5), n AS (SELECT k, count(*) AS n FROM k GROUP BY 1)
SELECT k AS kmer, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(instr('acgt', c) - 1 AS BIGINT))), lambda a, t: a * 4 + t) AS BIGINT) AS code, CAST(n AS BIGINT) AS n FROM n""")
def _(spark, d):
    k = b.sequences(spark, d).select(F.explode(sq.kmers(F.col("seq"), 6)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    return k.withColumn("code", sq.kmer_code(F.col("kmer"), "acgt")).where(sq.kmer_text(F.col("code"), 6, "acgt") == F.col("kmer")).select("kmer", "code", "n")


@query("scl12_log_sum_exp", "SELECT l_orderkey AS k, round(max(-l_quantity) + ln(sum(exp(-l_quantity - m))), 6) AS lse FROM (SELECT l_orderkey, l_quantity, max(-l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY 1, m")
def _(spark, d):
    rows = b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(-F.col("l_quantity")).alias("xs"))
    return rows.select("k", F.round(sq.log_sum_exp(F.col("xs")), 6).alias("lse"))


@query("scl13_log_inner_product", "SELECT l_orderkey AS k, round(ln(sum(exp(-l_discount) * exp(-l_tax) * exp(-l_quantity / 50))), 6) AS lip FROM lineitem GROUP BY 1")
def _(spark, d):
    lists = [F.collect_list(-F.col(n) / k).alias(n) for n, k in (("l_discount", 1), ("l_tax", 1), ("l_quantity", 50))]
    rows = b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(*lists)
    return rows.select("k", F.round(sq.log_inner_product(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")), 6).alias("lip"))


@query("scl15_xlogy", "SELECT l_orderkey AS k, round(sum(CASE WHEN l_tax = 0 THEN 0 ELSE l_tax * ln(l_quantity) END), 6) AS v FROM lineitem GROUP BY 1")
def _(spark, d):
    return b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum(sq.xlogy(F.col("l_tax"), F.col("l_quantity"))), 6).alias("v"))


@query("scl16_quality", "SELECT q AS score, CAST(count(*) AS BIGINT) AS n FROM (SELECT greatest(0, least(93, ascii(c) - 33)) AS q FROM (SELECT unnest(string_split(text, '')) AS c FROM benchmark)) GROUP BY 1")
def _(spark, d):
    return b.table(spark, d, "benchmark").select(F.explode(sq.symbols(F.col("text"))).alias("c")).groupBy(sq.quality_score(F.col("c")).alias("score")).agg(F.count("*").alias("n"))


@query("scl18_ungap", "SELECT doc_id AS row, md5(regexp_replace(coalesce(text, ''), '[-.]', '', 'g')) AS residues_md5 FROM documents")
def _(spark, d):
    return b.table(spark, d, "documents").select(F.col("doc_id").alias("row"), F.md5(sq.ungap(F.coalesce("text", F.lit(""))).cast("binary")).alias("residues_md5"))


@query("scl19_regap", "SELECT item_id AS row, md5(replace(text, '.', '-')) AS gapped_md5 FROM benchmark")
def _(spark, d):
    return b.table(spark, d, "benchmark").select(F.col("item_id").alias("row"), F.md5(sq.regap(sq.ungap(F.col("text")), sq.presence(F.col("text"))).cast("binary")).alias("gapped_md5"))


@query("scl20_reverse_complement", f"WITH {b.SEQS_SQL} SELECT row, md5(reverse(translate(seq, 'acgt', 'tgca'))) AS rc_md5 FROM seqs")
def _(spark, d):
    return b.sequences(spark, d).select("row", F.md5(sq.reverse_complement(F.col("seq")).cast("binary")).alias("rc_md5"))


@query("scl21_path_string", "SELECT item_id AS row, md5(regexp_replace(replace(replace(regexp_replace(text, '[^-.]', 'x', 'gs'), '.', '-'), 'x', '*'), ' ', '', 'g')) AS path_md5 FROM benchmark")
def _(spark, d):
    return b.table(spark, d, "benchmark").select(F.col("item_id").alias("row"), F.md5(sq.path_string(sq.presence(F.col("text"))).cast("binary")).alias("path_md5"))


@query("pair01_kmer_index", f"""WITH {b.SEQS_SQL}, p AS (SELECT row, seq, unnest(range(1, length(seq) - 6)) AS p FROM seqs), k AS (SELECT row, p - 1 AS pos, substr(seq, p, 8) AS kmer FROM p WHERE p <= length(seq) - 7)
SELECT kmer, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT row) AS BIGINT) AS n_rows, CAST(min(pos) AS BIGINT) AS first FROM k GROUP BY 1""")
def _(spark, d):
    by_row = pairs.kmer_index(b.sequences(spark, d), 8).groupBy("kmer", "row").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return by_row.groupBy("kmer").agg(F.sum("n").alias("n"), F.count("*").alias("n_rows"), F.min("first").cast("long").alias("first"))


_HITS_SQL = f"""{b.FAMILY_SQL}, p AS (SELECT row, seq, unnest(range(1, length(seq) - 4)) AS p FROM fam), k AS (SELECT row, p, substr(seq, p, 6) AS kmer FROM p WHERE p <= length(seq) - 5),
hits AS (SELECT x.row AS row1, y.row AS row2, x.p - y.p AS diag, count(*) AS hits FROM k x JOIN k y ON x.kmer = y.kmer AND x.row < y.row GROUP BY 1, 2, 3)"""


def _hits(spark, d):
    return pairs.diagonal_hits(pairs.kmer_index(b.family(spark, d), 6))


@query("pair02_diagonal_hits", f"WITH {_HITS_SQL} SELECT row1, row2, CAST(diag AS BIGINT) AS diag, CAST(hits AS BIGINT) AS hits FROM hits")
def _(spark, d):
    return _hits(spark, d).select("row1", "row2", F.col("diag").cast("long").alias("diag"), "hits")


@query("pair03_thresholds", f"""WITH {_HITS_SQL}, l AS (SELECT row, length(seq) AS len FROM fam), g AS (SELECT row1, row2, hits, count(*) AS n FROM hits GROUP BY 1, 2, 3),
c AS (SELECT *, sum(n) OVER (PARTITION BY row1, row2 ORDER BY hits DESC) AS total FROM g)
SELECT row1, row2, CAST(min(hits) AS BIGINT) AS threshold, CAST(max(total) AS BIGINT) AS diagonals FROM c JOIN l a ON a.row = row1 JOIN l b ON b.row = row2 WHERE total * 21 * least(a.len, b.len) <= 60000 GROUP BY 1, 2""")
def _(spark, d):
    lengths = b.family(spark, d).select("ds", "row", F.length("seq").alias("len"))
    return pairs.thresholds(_hits(spark, d), lengths, 10, 60000).select("row1", "row2", "threshold", "diagonals")


@query("pair04_bands", f"WITH {_HITS_SQL} SELECT row1, row2, CAST(count(DISTINCT d) AS BIGINT) AS n_diagonals FROM (SELECT row1, row2, unnest(range(diag - 5, diag + 6)) AS d FROM hits WHERE hits >= 2) GROUP BY 1, 2")
def _(spark, d):
    return pairs.bands(_hits(spark, d), 2, 5).groupBy("row1", "row2").agg(F.count("*").alias("n_diagonals"))


@query("pair09_all_pairs", "SELECT a.item_id AS row1, b.item_id AS row2 FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id")
def _(spark, d):
    return pairs.all_pairs(b.family(spark, d)).select("row1", "row2")


@query("pair10_sparse_pairs", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(least(count(*) * (count(*) - 1) // 2, ceil(count(*) * log2(count(*)))) AS BIGINT) AS n_pairs, true AS connected FROM benchmark")
def _(spark, d):
    """The random graph itself has no SQL: what is compared is its size, and that the tree of its pairs reaches every row."""
    rows = b.family(spark, d)
    n = rows.withColumn("row", F.row_number().over(Window.partitionBy("ds").orderBy("row")).cast("long"))
    edges = pairs.sparse_pairs(n, 7)
    tree = pairs.spanning_trees(edges.withColumn("score", F.lit(1.0)))
    size = edges.agg(F.count("*").alias("n_pairs"))
    return rows.agg(F.count("*").alias("n_rows")).join(size).join(tree.agg(F.count("*").alias("n_edges"))).select("n_rows", "n_pairs", (F.col("n_edges") == F.col("n_rows") - 1).alias("connected"))
