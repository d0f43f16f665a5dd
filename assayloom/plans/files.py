"""Readers and writers: files are made of driver tables in the shared folder and read back."""

from __future__ import annotations

import re
import sqlite3
from pathlib import Path

from pyspark.sql import functions as F

from assayloom.functions import strings
from assayloom.operators import catalog as K
from assayloom.operators import plates
from assayloom.plans.registry import query
from assayloom.session import scratch_path
from assayloom.sources import sqlite as db
from assayloom.sources import text as X

HEX, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"
SEQ = "translate(md5({k}::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def letters(key: str, n: int = 32):
    return F.translate(F.substring(F.md5(F.col(key).cast("string")), 1, n), HEX, BASES)


def written(t, df, name, suffix=""):
    """The rows' text in a folder of the shared place."""
    path = scratch_path(t.spark, name) + suffix
    df.write.text(path)
    return path


def placed(t, name, file, content):
    """One small file there."""
    return X.put_file(t.spark, f"{scratch_path(t.spark, name)}/{file}", content)


# --- Tables -----------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, p_size, true AS named FROM part")
def csv_scan(t):
    path = scratch_path(t.spark, "csv")
    t.part.select("p_partkey", "p_name", "p_size").write.option("header", True).csv(path)
    out = X.scan_csv(t.spark, path, schema="p_partkey long, p_name string, p_size int")
    return out.withColumn("named", F.col("plate").startswith("part-")).drop("plate")


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name, 'plate7' AS plate FROM nation")
def csv_scan_skip(t):
    rows = t.nation.orderBy("n_nationkey").collect()  # a table of fixed size
    path = placed(t, "csv", "plate7.csv", "made by a reader\n\nkey,name\n" + "".join(f"{r.n_nationkey},{r.n_name}\n" for r in rows))
    return X.scan_csv(t.spark, path, skip=2)


@query("SELECT s_suppkey::VARCHAR AS k, s_nationkey::VARCHAR AS v FROM supplier")
def table_scan(t):
    rows = t.supplier.select(F.explode(F.array(F.lit("# made here"), F.concat(F.lit("  "), "s_suppkey", F.lit("  \t "), "s_nationkey", F.lit(" ")), F.lit("  "))).alias("value"))
    return X.scan_table(t.spark, written(t, rows, "table"), ["k", "v"])


GRID = "g AS (SELECT 'sheet' || (p_size % 3) AS sheet, ((p_partkey % 96) // 12 + 1)::INTEGER AS r, (p_partkey % 12 + 1)::INTEGER AS c, min(p_name) AS v FROM part GROUP BY 1, 2, 3)"


def grid(t):
    k = F.col("p_partkey")
    return t.part.groupBy(F.concat(F.lit("sheet"), F.col("p_size") % 3).alias("sheet"), (F.floor(k % 96 / 12) + 1).cast("int").alias("row"), (k % 12 + 1).cast("int").alias("col")).agg(F.min("p_name").alias("value"))


@query(f"WITH {GRID} SELECT sheet, chr((64 + r)::INTEGER) || c AS well, v AS value FROM g")
def plate_layout_long(t):
    return plates.plate_layout(grid(t), "long")


@query(f"WITH {GRID} SELECT chr((64 + r)::INTEGER) || c AS well, max(v) FILTER (sheet = 'sheet0') AS m_sheet0, max(v) FILTER (sheet = 'sheet1') AS m_sheet1, max(v) FILTER (sheet = 'sheet2') AS m_sheet2, 'run1' AS directory FROM g GROUP BY 1")
def plate_info(t):
    return plates.read_plate_info(grid(t), "run1", "m_")


@query(f"WITH {GRID} SELECT chr((64 + r)::INTEGER) || c AS well, sheet AS name, v AS value FROM g")
def plate_info_2(t):
    return plates.read_plate_info_2(grid(t))


@query("""WITH g AS (SELECT 'p' || (p_size % 3) AS sheet, ((p_partkey % 96) // 12)::INTEGER AS r, (p_partkey % 12)::INTEGER AS c, max(p_retailprice) AS v FROM part GROUP BY 1, 2, 3)
SELECT 'plain' AS side, sheet, chr(65 + r) || (c + 1) AS well, v AS value FROM g UNION ALL SELECT 'turned', sheet, chr(72 - r) || (12 - c), v FROM g""", ["value"])
def reader_blocks(t):
    k = F.col("p_partkey")
    sheet = F.concat(F.lit("p"), F.col("p_size") % 3).alias("sheet")
    v = t.part.groupBy(sheet, F.floor(k % 96 / 12).cast("int").alias("r"), (k % 12).cast("int").alias("c")).agg(F.max("p_retailprice").alias("v"))
    cells = v.select("sheet", (F.col("r") + 5).alias("r"), (F.col("c") + 2).alias("c"), F.col("v").cast("string").alias("cell"))
    heads = v.select("sheet", (F.col("r") + 5).alias("r"), F.lit(1).alias("c"), F.char(F.lit(65) + F.col("r")).alias("cell")).distinct()
    cells = cells.unionByName(heads).unionByName(v.select("sheet", F.lit(40).alias("r"), F.lit(1).alias("c"), F.lit("A").alias("cell")).distinct())
    both = [plates.reader_block(cells, 96, invert=turned).select(F.lit(name).alias("side"), "sheet", "well", "value") for name, turned in (("plain", False), ("turned", True))]
    return both[0].unionByName(both[1])


# --- SQLite -----------------------------------------------------------------------------------------------------------


def database(t, name, tables):
    """A database of small tables in the shared folder, which must be a mounted one."""
    path = scratch_path(t.spark, name)
    if re.match("(?!file:)[a-z0-9]+:", path):
        raise ValueError("databases are read from a mounted folder")
    file = Path(re.sub("^file:/*", "/", path)).with_suffix(".db")
    file.parent.mkdir(parents=True, exist_ok=True)
    with sqlite3.connect(file) as con:
        for table, (columns, rows) in tables.items():
            con.execute(f'CREATE TABLE "{table}" ({columns})')
            con.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(columns.split(",")))})', rows)
    return str(file)


@query("SELECT 'nation' AS source, n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region")
def sqlite_tables(t):
    nation, region = ([tuple(r) for r in df.collect()] for df in (t.nation.select("n_nationkey", "n_name", F.lit("x")), t.region.select("r_regionkey", "r_name")))  # tables of fixed size
    path = database(t, "sqlite", {"nation": ("k INTEGER, name TEXT, constant TEXT", nation), "region": ("k INTEGER, name TEXT", region), "other": ("k INTEGER", [(1,)])})
    found = db.read_all(t.spark, path, skip=("other",))
    out = [found[name].select(F.lit(name).alias("source"), *[F.col(c).cast("int") if c == "k" else F.col(c) for c in found[name].columns]) for name in ("nation", "region")]
    return out[0].unionByName(out[1])


@query("""WITH o AS (SELECT n_nationkey AS k, n_nationkey / 1000.0::DOUBLE AS m FROM nation) SELECT k::BIGINT AS "ImageNumber", round_even(m * 65535, 0) AS "Intensity_MeanIntensity_ch1", (k + 1 + k + 3) / 2 AS "Texture_Contrast_ch1_3_256", 'class' || (k % 3) AS class FROM o""", ["Texture_Contrast_ch1_3_256"])
def sqlite_objects(t):
    rows = [(r.n_nationkey, r.n_nationkey / 1000.0, r.n_nationkey + 1.0, r.n_nationkey + 3.0, 0.5) for r in t.nation.collect()]
    columns = 'ImageNumber INTEGER, Cells_Intensity_MeanIntensity_ch1 REAL, Cells_Texture_Contrast_ch1_3_00_256 REAL, Cells_Texture_Contrast_ch1_3_01_256 REAL, Cells_AreaShape_Zernike_1 REAL'
    classes = t.nation.select(F.col("n_nationkey").cast("long").alias("ImageNumber"), F.concat(F.lit("class"), F.col("n_nationkey") % 3).alias("class"))
    return db.read_objects(t.spark, database(t, "objects", {"Per_Cells": (columns, rows)}), "Per_Cells", drop=["Zernike"], prefix="Cells_", classes=classes, key=["ImageNumber"])


# --- Sequence files ---------------------------------------------------------------------------------------------------

READS = f"r AS (SELECT p_partkey AS k, '@run7:' || p_partkey || '/1 x' AS header, substr({SEQ.format(k='p_partkey')}, 1, 8 + (p_partkey % 24)::INTEGER) AS seq, '+' AS plus FROM part)"


def reads(t, mate=1):
    s = F.expr("substring(translate(md5(CAST(p_partkey AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, CAST(8 + p_partkey % 24 AS INT))")
    head = F.concat(F.lit("@run7:"), "p_partkey", F.lit(f"/{mate} x"))
    return t.part.select("p_partkey", head.alias("header"), s.alias("seq"), F.lit("+").alias("plus")).withColumn("qual", F.regexp_replace("seq", ".", "@"))


@query(f"WITH {READS} SELECT header, seq, plus, regexp_replace(seq, '.', '@', 'g') AS qual FROM r")
def fastq_scan(t):
    path = written(t, reads(t).select(F.concat_ws("\n", "header", "seq", "plus", "qual").alias("value")), "reads")
    return X.scan_fastq(t.spark, path).drop("file", "n")


@query(f"WITH {READS} SELECT (k % 3)::INTEGER AS rep, header, seq, count(*) OVER (PARTITION BY k % 3) AS n_rep FROM r")
def fastq_replicates(t):
    from pyspark.sql import Window

    path = scratch_path(t.spark, "replicates")
    X.write_fastq(reads(t).withColumn("rep", (F.col("p_partkey") % 3).cast("int")), path, "rep")
    out = [X.scan_fastq(t.spark, f"{path}/rep={k}").withColumn("rep", F.lit(k)) for k in range(3)]
    out = out[0].unionByName(out[1]).unionByName(out[2])
    return out.select("rep", "header", "seq", F.count(F.lit(1)).over(Window.partitionBy("rep")).alias("n_rep"))


@query(f"SELECT 'p' || p_partkey AS name, 'p' || p_partkey || ' ' || p_name AS header, {SEQ.format(k='p_partkey')} AS seq FROM part")
def fasta_scan(t):
    df = t.part.select(F.concat(F.lit("p"), "p_partkey", F.lit(" "), "p_name").alias("name"), letters("p_partkey").alias("seq"))
    path = scratch_path(t.spark, "fasta")
    X.write_fasta(df, path, wrap=10)
    return X.scan_fasta(t.spark, path).drop("file")


@query("SELECT 'p' || p_partkey AS id FROM part")
def fasta_ids(t):
    df = t.part.select(F.concat(F.lit("p"), "p_partkey", F.lit(" "), "p_name").alias("name"), letters("p_partkey").alias("seq"))
    path = scratch_path(t.spark, "fasta")
    X.write_fasta(df, path, wrap=None)
    return X.fasta_ids(t.spark, path)


@query(f"SELECT 'n' || n_nationkey AS name, {SEQ.format(k='n_nationkey')} AS seq FROM nation UNION ALL SELECT 'r' || r_regionkey, {SEQ.format(k='r_regionkey')} FROM region")
def fasta_merge(t):
    paths = []
    for df, key, mark in ((t.nation, "n_nationkey", "n"), (t.region, "r_regionkey", "r")):
        paths.append(scratch_path(t.spark, "fasta"))
        X.write_fasta(df.select(F.concat(F.lit(mark), key).alias("name"), letters(key).alias("seq")), paths[-1], wrap=7)
    return X.merge_fasta(t.spark, paths).select("name", "seq")


@query("""SELECT 'sub_' || n_nationkey || '_' || s AS id, (n_nationkey * 10 + s) / 1000 AS score, s / 4 AS seq_recovery, translate(substr(md5(n_nationkey || ':' || s), 1, 12), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS sequence FROM nation, (SELECT unnest(range(1, 4)) AS s)""", ["score", "seq_recovery"])
def mpnn_parse(t):
    """Designed sequences: a file of blocks, one for each backbone."""
    rows, alphabet = t.nation.orderBy("n_nationkey").collect(), str.maketrans(HEX, "ACDEFGHIKLMNPQRS")
    import hashlib

    content = ""
    for r in rows:  # a table of fixed size
        content += f">sub_{r.n_nationkey}, score=1.5, fixed_chains=['B']\nMMMM\n"
        for s in (1, 2, 3):
            seq = hashlib.md5(f"{r.n_nationkey}:{s}".encode()).hexdigest()[:12].translate(alphabet)
            content += f">T=0.1, sample={s}, score={(r.n_nationkey * 10 + s) / 1000}, global_score=9.9, seq_recovery={s / 4}\n{seq}\n"
    return X.parse_mpnn(t.spark, placed(t, "mpnn", "designs.fa", content)).drop("file")


A3M = "a AS (SELECT s_suppkey, 'h' || s_suppkey AS name, (s_suppkey % 50) / 10 AS score, translate(upper(substr(md5(s_suppkey::VARCHAR), 1, 8)), '0123456789ABCDEF', 'ACDEFGHIKLMNPQRS') AS s FROM supplier)"


def alignments(t):
    s = F.translate(F.upper(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 8)), "0123456789ABCDEF", "ACDEFGHIKLMNPQRS")
    record = F.concat(F.lit(">query 99\nMMMMMMMM\n>h"), "s_suppkey", F.lit(" "), F.format_string("%.1f", F.col("s_suppkey") % 50 / 10), F.lit("\n"), F.substring(s, 1, 4), F.lit("ab\nc"), F.substring(s, 5, 4), F.lit("\n"))
    return t.supplier.select("s_suppkey", record.alias("text"))


@query(f"WITH {A3M} SELECT name, s AS sequence, score FROM a", ["score"])
def a3m_parse(t):
    return X.parse_a3m(alignments(t)).where("name <> 'query'").select("name", "sequence", "score")


@query(f"WITH {A3M}, b AS (SELECT s AS sequence, arg_max(name, (score, name)) AS name, max(score) AS score FROM a GROUP BY 1) SELECT name, sequence, score FROM b UNION ALL SELECT 'query', 'MMMMMMMM', 99", ["score"])
def msa_merge(t):
    found = X.parse_a3m(alignments(t)).select("name", "sequence", "score")
    return X.merge_msa([found, found], "query")


@query("SELECT s_nationkey, bool_and(s_suppkey % 7 <> 0) AS valid, count(*) * 2 AS lines FROM supplier GROUP BY 1")
def a3m_valid(t):
    def check(key):
        rows = t.supplier.where(F.col("s_nationkey") == key).withColumn("k", F.row_number().over(_by("s_suppkey")))
        seq = F.when(F.col("s_suppkey") % 7 == 0, "AC 1").otherwise("ACab-*")
        lines = rows.select(F.inline(F.array(F.struct((2 * F.col("k") - 1).alias("n"), F.concat(F.lit(">"), "s_name").alias("line")), F.struct((2 * F.col("k")).alias("n"), seq.alias("line")))))
        return X.valid_a3m(lines).select(F.lit(key).alias("s_nationkey"), "valid", "lines")

    keys = [{"k": r[0]} for r in t.supplier.select("s_nationkey").distinct().orderBy("s_nationkey").collect()]  # at most 25 nations
    sheet = t.spark.createDataFrame([(k["k"],) for k in keys], "k int")
    return X.for_each_sample(sheet, lambda row: check(row["k"]))


def _by(*cols):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1)).orderBy(*cols)


@query(f"""WITH {READS} SELECT 's' || (k % 2) AS sample, header, seq FROM r""")
def fastq_merge(t):
    """Two runs for each of two samples."""
    sheet = []
    for run in range(4):
        part = reads(t).where(F.col("p_partkey") % 4 == run)
        sheet.append((f"s{run % 2}", written(t, part.select(F.concat_ws("\n", "header", "seq", "plus", "qual").alias("value")), "run")))
    return X.merge_reads(t.spark, t.spark.createDataFrame(sheet, "sample string, path string")).select("sample", "header", "seq")


# --- Structures -------------------------------------------------------------------------------------------------------

NAMES = ["ALA", "GLY", "LEU", "XXX", "TRP"]


def pdb_lines(t):
    k = F.col("n_nationkey")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (k % 5 + 1).cast("int"))
    chain = F.when(F.col("n_regionkey") < 3, "A").otherwise("B")
    line = X.pdb_line(k.cast("int") + 1, F.lit("CA"), name, chain, k.cast("int") + 10, k * 1.5, -k * 2.0, k * k / 8.0)
    return t.nation.select(F.explode(F.array(line, F.when(k == 24, "TER"), F.when(k == 24, "END"))).alias("value")).where("value IS NOT NULL")


ATOMS = "atoms AS (SELECT n_nationkey AS k, ['ALA', 'GLY', 'LEU', 'XXX', 'TRP'][n_nationkey % 5 + 1] AS resname, ['A', 'G', 'L', 'X', 'W'][n_nationkey % 5 + 1] AS one, CASE WHEN n_regionkey < 3 THEN 'A' ELSE 'B' END AS chain FROM nation)"


@query(f"WITH {ATOMS} SELECT (k + 1)::INTEGER AS serial, 'CA' AS atom, resname, chain, (k + 10)::INTEGER AS resnum, k * 1.5::DOUBLE AS x, k * -2.0::DOUBLE AS y, round(k * k / 8, 3) AS z FROM atoms", ["x", "y", "z"])
def pdb_scan(t):
    return X.scan_pdb(t.spark, written(t, pdb_lines(t), "pdb")).drop("file", "record")


@query(f"WITH {ATOMS} SELECT chain, string_agg(one, '' ORDER BY k) AS sequence FROM atoms GROUP BY 1")
def pdb_sequence(t):
    atoms = X.scan_pdb(t.spark, written(t, pdb_lines(t), "pdb")).withColumn("file", F.lit("one"))
    return X.chain_sequence(atoms).select("chain", "sequence")


@query("SELECT CASE WHEN n_nationkey % 3 = 0 THEN repeat('x', 76) ELSE 'ATOM ' || n_nationkey END AS line, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT 'REMARK a', 1 UNION ALL SELECT 'REMARK b', 1")
def pdb_clean(t):
    k = F.col("n_nationkey")
    lines = t.nation.select(F.explode(F.array(F.when(k % 3 == 0, F.lit("x" * 90)).otherwise(F.concat(F.lit("ATOM "), k)), F.lit("TER 7"), F.lit("END"))).alias("value"))
    found = X.clean_pdb(X.ordered_lines(t.spark, written(t, lines, "pdb")), ["b", "a"])
    return found.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_regionkey::BIGINT AS timestep, n_nationkey::BIGINT AS id, (n_nationkey % 2 + 1)::INTEGER AS type, n_nationkey / 100 * (10 + n_regionkey) AS x, n_nationkey * 2.0::DOUBLE AS y, n_nationkey / 100 * 10 - 5 AS z FROM nation", ["x", "y", "z"])
def trajectory_scan(t):
    """A frame for each region, its nations are the atoms; x and z are scaled, y is not."""
    k = F.col("n_nationkey")
    atom = F.concat_ws(" ", k, k % 2 + 1, k / 100.0, k * 2.0, k / 100.0)
    frames = t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(atom)), "\n").alias("atoms"), F.count(F.lit(1)).alias("n"))
    head = F.concat(F.lit("ITEM: TIMESTEP\n"), "n_regionkey", F.lit("\nITEM: NUMBER OF ATOMS\n"), "n", F.lit("\nITEM: BOX BOUNDS pp pp pp\n0 "), F.col("n_regionkey") + 10, F.lit("\n0 20\n-5 5.0\nITEM: ATOMS id type xs y zs\n"))
    return X.scan_lammps(t.spark, written(t, frames.select(F.concat(head, "atoms").alias("value")), "frames")).drop("file")


@query("SELECT 'lig' || n_nationkey AS ligand, -5 - n_nationkey / 10 AS affinity FROM nation", ["affinity"])
def docking_best(t):
    path = scratch_path(t.spark, "docking")
    for r in t.nation.collect():  # a table of fixed size
        X.put_file(t.spark, f"{path}/lig{r.n_nationkey}.pdbqt", f"MODEL 1\nREMARK VINA RESULT:    {-5 - r.n_nationkey / 10}      0.000      0.000\nREMARK VINA RESULT:    -1.0  2 3\n")
    return X.docking_best(t.spark, path)


# --- Genomics ---------------------------------------------------------------------------------------------------------


@query("SELECT 'chr' || (p_size % 5) AS chrom, p_partkey + 1 AS \"start\", p_partkey + 50 AS \"end\", p_name AS name, p_size::DOUBLE AS score, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part")
def bed_round_trip(t):
    k = F.col("p_partkey")
    df = t.part.select(F.concat(F.lit("chr"), F.col("p_size") % 5).alias("chrom"), (k + 1).alias("start"), (k + 50).alias("end"), F.col("p_name").alias("name"), F.col("p_size").alias("score"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"))
    path = scratch_path(t.spark, "bed")
    X.write_bed(df, path, tuple(df.columns))
    return X.scan_bed(t.spark, path)


@query("SELECT 'chr1' AS chrom, s_suppkey + 1 AS \"start\", s_suppkey + 100 AS \"end\", s_name AS name, 5.0::DOUBLE AS score, '.' AS strand, s_acctbal AS signal, 3.5::DOUBLE AS pvalue, 2.5::DOUBLE AS qvalue, s_suppkey % 90 AS summit FROM supplier", ["signal"])
def narrow_peaks(t):
    rows = t.supplier.select(F.explode(F.array(F.lit("track name=x"), F.concat_ws("\t", F.lit("chr1"), "s_suppkey", F.col("s_suppkey") + 100, "s_name", F.lit("5"), F.lit("."), "s_acctbal", F.lit("3.5"), F.lit("2.5"), F.col("s_suppkey") % 90))).alias("value"))
    return X.scan_bed(t.spark, written(t, rows, "peaks"), "narrowPeak")


def gtf(t):
    k = F.col("n_nationkey")
    attr = lambda extra: F.concat(F.lit('gene_id "g'), k, F.lit('.2"; '), extra, F.lit('gene_name "'), "n_name", F.lit('"; gene_type "t'), k % 3, F.lit('";'))
    line = lambda what, extra: F.concat_ws("\t", F.concat(F.lit("chr"), F.col("n_regionkey")), F.lit("src"), F.lit(what), k * 100 + 1, k * 100 + 90, F.lit("."), F.when(k % 2 == 0, "+").otherwise("-"), F.lit("."), attr(extra))
    rows = t.nation.select(F.explode(F.array(F.lit("#!version"), line("gene", F.lit("")), line("transcript", F.concat(F.lit('transcript_id "t'), k, F.lit('a"; '))), line("exon", F.concat(F.lit('transcript_id "t'), k, F.lit('a"; '))))).alias("value"))
    return X.scan_gtf(t.spark, written(t, rows, "gtf"))


GENES = "SELECT 'chr' || n_regionkey AS chrom, 'src' AS source, {what} AS feature, (n_nationkey * 100 + 1)::BIGINT AS \"start\", (n_nationkey * 100 + 90)::BIGINT AS \"end\", '.' AS score, CASE WHEN n_nationkey % 2 = 0 THEN '+' ELSE '-' END AS strand, '.' AS frame, 'g' || n_nationkey || '.2' AS gene_id, {tx} AS transcript_id, n_name AS gene_name, 't' || (n_nationkey % 3) AS gene_type FROM nation"


@query(" UNION ALL ".join(GENES.format(what=f"'{w}'", tx="NULL::VARCHAR" if w == "gene" else "'t' || n_nationkey || 'a'") for w in ("gene", "transcript", "exon")))
def gtf_scan(t):
    return gtf(t)


@query("SELECT 't' || n_nationkey || 'a' AS transcript_id, 'g' || n_nationkey || '.2' AS gene_id FROM nation")
def transcript_map(t):
    return X.transcript_map(gtf(t))


@query("SELECT 'chr' || n_regionkey AS chrom, (n_nationkey * 100 + 1)::BIGINT AS \"start\", (n_nationkey * 100 + 90)::BIGINT AS \"end\", 'g' || n_nationkey || '.2' AS name, 0 AS score, CASE WHEN n_nationkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 't' || (n_nationkey % 3) AS biotype FROM nation")
def biotype_beds(t):
    path = scratch_path(t.spark, "biotypes")
    X.biotype_beds(gtf(t)).write.partitionBy("biotype").parquet(path)
    return t.spark.read.parquet(path).withColumn("biotype", F.col("biotype").cast("string"))


@query("SELECT 'g' || (n_nationkey % 10) AS gene, 'S' || s AS sample, sum(n_nationkey * s)::DOUBLE AS count, sum(n_nationkey + 0.5)::DOUBLE AS tpm FROM nation, (SELECT unnest([1, 2]) AS s) GROUP BY 1, 2", ["count", "tpm"])
def salmon_scan(t):
    rows, base = t.nation.collect(), scratch_path(t.spark, "salmon")  # a table of fixed size
    for s in (1, 2):
        X.put_file(t.spark, f"{base}/S{s}/quant.sf", "Name\tLength\tEffectiveLength\tTPM\tNumReads\n" + "".join(f"t{r.n_nationkey}.3\t100\t90.5\t{r.n_nationkey + 0.5}\t{r.n_nationkey * s}\n" for r in rows))
    t2g = t.nation.select(F.concat(F.lit("t"), "n_nationkey", F.lit(".1")).alias("transcript_id"), F.concat(F.lit("g"), F.col("n_nationkey") % 10).alias("gene_id"))
    return X.scan_salmon(t.spark, f"{base}/*/quant.sf", t2g)


@query("SELECT 'g' || p_partkey AS ensembl_id, p_size::BIGINT AS length, p_partkey % 100 AS s1, p_partkey % 7 AS s2 FROM part")
def feature_counts(t):
    k = F.col("p_partkey")
    path = scratch_path(t.spark, "counts")
    rows = t.part.select(F.concat(F.lit("g"), k, F.lit(".4")).alias("Geneid"), F.lit("chr1").alias("Chr"), k.alias("Start"), k.alias("End"), F.lit("+").alias("Strand"), F.col("p_size").alias("Length"), (k % 100).alias("/run/s1.sorted.bam"), (k % 7).alias("/run/s2.bam"))
    rows.write.options(header=True, sep="\t").csv(path)
    return X.scan_feature_counts(t.spark, path)


@query("SELECT 'plate' || n_regionkey AS section, 'ch' || n_nationkey AS channel, n_name AS name FROM nation")
def channel_names(t):
    rows = t.nation.orderBy("n_regionkey", "n_nationkey").collect()  # a table of fixed size
    content, last = "", None
    for r in rows:
        content += f"[plate{r.n_regionkey}]\n" if r.n_regionkey != last else ""
        content += f"ch{r.n_nationkey} = {r.n_name}\n"
        last = r.n_regionkey
    return X.read_channels(X.ordered_lines(t.spark, placed(t, "channels", "channels.txt", content)))


@query("SELECT s_suppkey AS \"PositionID\", 'A' || s_suppkey || '#1' AS name, s_suppkey * 0.5::DOUBLE AS x, s_acctbal AS y, 7.25::DOUBLE AS z FROM supplier", ["x", "y"])
def positions_xml(t):
    df = t.supplier.select(F.col("s_suppkey").alias("PositionID"), F.concat(F.lit("A"), "s_suppkey", F.lit("#1")).alias("name"), (F.col("s_suppkey") * 0.5).alias("x"), F.col("s_acctbal").alias("y"), F.lit(7.25).alias("z"))
    path = scratch_path(t.spark, "positions")
    X.write_positions_xml(df, path)
    return X.read_positions_xml(t.spark, path)


@query("SELECT s_suppkey, (s_suppkey * 10)::DOUBLE AS total, (s_suppkey * 9)::DOUBLE AS mapped, (s_suppkey * 8)::DOUBLE AS paired, 0::DOUBLE AS duplicates, CASE WHEN s_suppkey % 2 = 0 THEN 88.5 ELSE 0 END::DOUBLE AS unique_pct, 0::DOUBLE AS input_reads, 0::DOUBLE AS unique_reads, (s_suppkey * 2)::DOUBLE AS multi_reads, 0::DOUBLE AS unmapped_pct FROM supplier")
def log_numbers(t):
    k = F.col("s_suppkey")
    log = F.concat(k * 10, F.lit(" + 0 in total (QC-passed)\n"), k * 9, F.lit(" + 0 mapped (90%)\n"), k * 8, F.lit(" + 0 properly paired\n"), F.when(k % 2 == 0, "Uniquely mapped reads % |\t88.5%\n").otherwise(""), F.lit("Number of reads mapped to multiple loci |\t"), k * 2)
    x = X.log_metrics(t.supplier.select("s_suppkey", log.alias("text"), log.alias("copy")), X.FLAGSTAT)
    return X.log_metrics(x, X.STAR, "copy")


@query("SELECT s_suppkey::VARCHAR AS sample, (s_suppkey % 10)::VARCHAR AS reads FROM supplier")
def statistics_append(t):
    path = scratch_path(t.spark, "statistics")
    for half in (0, 1):
        X.append_statistics(t.supplier.where(F.col("s_suppkey") % 2 == half).select(F.col("s_suppkey").alias("sample"), (F.col("s_suppkey") % 10).alias("reads")), path)
    return t.spark.read.option("header", True).csv(path)


@query("SELECT 'nation' AS sheet, n_nationkey::VARCHAR AS k, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey::VARCHAR, r_name FROM region")
def table_sinks(t):
    path = scratch_path(t.spark, "sheets")
    X.write_tables({"nation": t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), "region": t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))}, path, "csv")
    found = X.read_tables(t.spark, path, ["nation", "region"], "csv")
    return found["nation"].withColumn("sheet", F.lit("nation")).unionByName(found["region"].withColumn("sheet", F.lit("region")))


@query("SELECT r_name AS region, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def sheet_loop(t):
    """A call for each row of a sheet."""
    return X.for_each_sample(t.region, lambda row: t.nation.where(F.col("n_regionkey") == row["r_regionkey"]).agg(F.count(F.lit(1)).alias("nations")).select(F.lit(row["r_name"]).alias("region"), "nations"))


@query("SELECT 'S' || s_suppkey AS sample, '/d/S' || s_suppkey || '_R1.fastq.gz' AS fq1, CASE WHEN s_suppkey % 3 = 0 THEN 'NA' ELSE '/d/S' || s_suppkey || '_R2.fastq.gz' END AS fq2 FROM supplier")
def sample_sheet(t):
    k = F.col("s_suppkey")
    files = t.supplier.select(F.explode(F.array(F.concat(F.lit("/d/S"), k, F.lit("_R1.fastq.gz")), F.when(k % 3 != 0, F.concat(F.lit("/d/S"), k, F.lit("_R2.fastq.gz"))))).alias("path")).where("path IS NOT NULL")
    return K.sample_sheet(files)


@query("SELECT s_name AS \"ID\", CASE WHEN s_suppkey % 2 = 0 THEN 'none' ELSE 'IgG' END AS \"ANTIBODY\", 'g' || s_nationkey AS \"GROUP\", 'black' AS \"COLOR\" FROM supplier")
def spike_free_table(t):
    sheet = t.supplier.select(F.col("s_name").alias("sample"), F.concat(F.lit("g"), "s_nationkey").alias("group"), F.when(F.col("s_suppkey") % 2 == 1, "IgG").alias("control"))
    return X.spike_free_table(sheet)


@query("SELECT s_nationkey || '' AS sample, string_agg('f' || s_suppkey, ',' ORDER BY 'f' || s_suppkey) FILTER (s_suppkey % 4 <> 0) AS paths, count(*) FILTER (s_suppkey % 4 = 0)::BIGINT AS missing_files FROM supplier GROUP BY 1")
def runs_by_sample(t):
    k = F.col("s_suppkey")
    runs = t.supplier.where(k % 4 != 0).select(k.alias("run"), F.concat(F.lit("f"), k).alias("path"))
    out = X.merge_samples(runs, t.supplier.select(k.alias("run"), F.col("s_nationkey").cast("string").alias("sample")))
    return out.withColumn("paths", F.when(F.size("paths") > 0, F.array_join("paths", ",")))


@query(f"WITH {READS} SELECT count(*) AS reads1, count(*) FILTER (k % 50 <> 0) AS reads2, count(*) FILTER (k % 50 <> 0) AS paired, 0::BIGINT AS wrong1, 0::BIGINT AS wrong2, (count(*) FILTER (k % 50 <> 0)) / count(*) AS rate, false AS valid FROM r", ["rate"])
def fastq_pairs(t):
    from assayloom.operators import design as D

    number = lambda df: df.withColumn("n", F.col("p_partkey"))
    out = D.validate_pairs(number(reads(t)), number(reads(t, 2).where("p_partkey % 50 <> 0")))
    return out.select("reads1", "reads2", "paired", "wrong1", "wrong2", "rate", "valid")


@query("SELECT n_nationkey, 'NATION' AS kind, CASE WHEN n_nationkey % 2 = 0 THEN '/mnt/c/data/' || n_name ELSE '/data/' || n_name END AS path FROM nation")
def path_norm(t):
    k = F.col("n_nationkey")
    p = F.when(k % 2 == 0, F.concat(F.lit("C:\\data\\"), "n_name")).otherwise(F.concat(F.lit("\\data\\"), "n_name"))
    return t.nation.select("n_nationkey", F.split("n_name", "_")[0].alias("kind"), strings.norm_path(p).alias("path"))
