"""Readers and writers of laboratory text formats over Spark's text source.

All files are read in splits. Records that begin with a mark of their own (FASTA, trajectory frames) are cut by it, as the
source's line separator. Where lines depend on each other (FASTQ, lines before a header, sections) they are numbered: each
split's lines are counted, and the counts before it make its first number, so a file needn't fit into a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayloom.functions.dna import one_letter
from assayloom.functions.strings import stem
from assayloom.session import materialize


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file (base name) and text, a row for each file: for logs and other small files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n (1-based), line, of plain or gzipped files. An empty file has none; a line feed at the end begins no line.

    A split's lines come one after another, so the running number of a line within its split follows from the written
    table; what is joined to it is a row for each split.
    """
    text = spark.read.text(path).select("_metadata.file_path", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"\r$", "").alias("line"))
    lines = materialize(text, "lines")
    blocks = lines.groupBy("file_path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    return lines.join(blocks, ["file_path", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("n"), "line")


def marked_records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """file and record (text without the mark) of files whose records begin with a mark, cut there by the reader."""
    rows = spark.read.option("lineSep", mark).text(path)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("record"))


def scan_csv(spark: SparkSession, path: str, skip: int = 0, sep: str = ",", schema: str | None = None, name: str = "plate") -> DataFrame:
    """Delimited files with lines before the header; the file's stem becomes a column."""
    if not skip:
        reader = spark.read.options(header=True, sep=sep)
        df = (reader.schema(schema) if schema else reader).csv(path)
        return df.withColumn(name, stem(F.col("_metadata.file_name")))
    lines = ordered_lines(spark, path)
    head = lines.where(F.col("n") == skip + 1).first()["line"]
    names = [c.strip().strip('"') for c in head.split(sep)]
    ddl = schema or ", ".join(f"`{c}` STRING" for c in names)
    rows = lines.where((F.col("n") > skip + 1) & (F.trim("line") != "")).select(F.from_csv("line", ddl, {"sep": sep}).alias("r"), stem(F.col("file")).alias(name))
    return rows.select("r.*", name)


def scan_table(spark: SparkSession, path: str, names: list[str], comment: str = "#", skip: int = 0) -> DataFrame:
    """Columns parted by white space; comment lines go."""
    lines = ordered_lines(spark, path).where(F.col("n") > skip) if skip else spark.read.text(path).withColumnRenamed("value", "line")
    parts = F.split(F.trim("line"), r"\s+")
    return lines.where((F.trim("line") != "") & ~F.col("line").startswith(comment)).select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(names)])


# --- Sequences --------------------------------------------------------------------------------------------------------


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, name (first word), header, seq; records may span lines. A mark stands only at the start of a line."""
    recs = marked_records(spark, path, "\n>").withColumn("r", F.regexp_replace("record", "^>", "")).where(F.trim("r") != "")
    head = F.regexp_extract("r", r"^([^\r\n]*)", 1)
    return recs.select("file", F.regexp_extract(head, r"^(\S+)", 1).alias("name"), head.alias("header"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def fasta_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.nullif(F.regexp_extract("value", r"^>(\S+)", 1), F.lit("")).alias("id")).where("id IS NOT NULL")


def fasta_record(name: str, seq: str, wrap: int | None = 80) -> Column:
    body = F.rtrim(F.regexp_replace(F.col(seq), f"(.{{{wrap}}})", "$1\n")) if wrap else F.col(seq)
    return F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.regexp_replace(body, r"\n$", ""))


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", wrap: int | None = 80) -> None:
    df.select(fasta_record(name, seq, wrap).alias("value")).write.text(path)


def merge_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    out = None
    for p in paths:
        one = scan_fasta(spark, p)
        out = one if out is None else out.unionByName(one)
    return out


def scan_fastq(spark: SparkSession, path: str) -> DataFrame:
    """file, n (record number from 1), header, seq, plus, qual; plain or gzipped; an unfinished record at the end goes.

    Records whose four lines stand in one batch are cut there; only the lines of others, a few at the ends of batches,
    are shuffled to be joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).to_numpy() - 1
            file = pc.dictionary_encode(b.column(0)).indices.to_numpy()
            first = np.flatnonzero(n[:-3] % 4 == 0) if len(n) > 3 else np.zeros(0, np.int64)
            first = first[(n[first + 3] == n[first] + 3) & (file[first + 3] == file[first])]
            alone = np.ones(len(n), bool)
            alone[(first[:, None] + np.arange(4)).ravel()] = False
            rest = np.flatnonzero(alone)
            at = np.concatenate([first, rest])
            lines = [b.column(2).take(pa.array(first + i)) for i in range(4)]
            none = pa.nulls(len(rest), pa.string())
            columns = [pa.concat_arrays([x, none]) for x in lines]
            place = pa.concat_arrays([pa.nulls(len(first), pa.int32()), pa.array((n[rest] % 4).astype(np.int32))])
            line = pa.concat_arrays([pa.nulls(len(first), pa.string()), b.column(2).take(pa.array(rest))])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(n[at] // 4 + 1), *columns, place, line], names)

    names = ["file", "n", "header", "seq", "plus", "qual", "place", "line"]
    schema = "file string, n long, header string, seq string, plus string, qual string, place int, line string"
    found = materialize(ordered_lines(spark, path).mapInArrow(run, schema), "records")
    parts = ("header", "seq", "plus", "qual")
    whole = found.where("place IS NULL").select("file", "n", *parts)
    joined = found.where("place IS NOT NULL").groupBy("file", "n").agg(*[F.max(F.when(F.col("place") == i, F.col("line"))).alias(c) for i, c in enumerate(parts)])
    return whole.unionByName(joined.where("qual IS NOT NULL"))


def write_fastq(df: DataFrame, path: str, rep: str | None = None, compress: bool = True) -> None:
    """Records as text, in a folder for each replicate if asked, gzipped by default."""
    rows = df.select(F.concat_ws("\n", "header", "seq", "plus", "qual").alias("value"), *([rep] if rep else []))
    w = rows.write.option("compression", "gzip" if compress else "none")
    (w.partitionBy(rep) if rep else w).text(path)


def replicate_name(base: str, rep: int, pair: int | None = None, gz: bool = True) -> str:
    return f"{base}_rep{rep}" + (f"_{pair}" if pair else "") + (".fq.gz" if gz else ".fq")


def parse_mpnn(spark: SparkSession, path: str) -> DataFrame:
    """id (template and running sample), score, seq_recovery, sequence: a header '>name' starts a template, later headers
    with 'sample=' its samples; the sequence is on the next line."""
    w = Window.partitionBy("file").orderBy("n")
    x = ordered_lines(spark, path).withColumn("_seq", F.lead("line").over(w)).where("line LIKE '>%'")
    x = x.withColumns({"_first": ~F.col("line").contains("sample="), "_name": F.when(~F.col("line").contains("sample="), F.regexp_extract("line", r"^>([^,\s]+)", 1))})
    x = x.withColumn("_sub", F.last("_name", ignorenulls=True).over(w))
    x = x.withColumn("_k", F.sum((~F.col("_first")).cast("int")).over(Window.partitionBy("file", "_sub").orderBy("n")))
    field = lambda f: F.regexp_extract("line", rf"{f}=\s*([-0-9.eE]+)", 1).try_cast("double")
    return x.where("NOT _first").select("file", F.concat_ws("_", "_sub", "_k").alias("id"), field("(?<![a-z_])score").alias("score"), field("seq_recovery").alias("seq_recovery"), F.trim("_seq").alias("sequence"))


def parse_a3m(df: DataFrame, text: str = "text", n: int | None = None) -> DataFrame:
    """Records of an alignment: name, aligned sequence without insertions (lower case), score from the header's second
    field; the first n."""
    recs = df.select(F.posexplode(F.split(text, r"(?:^|\n)>")).alias("k", "r")).where(F.trim("r") != "")
    head = F.regexp_extract("r", r"^([^\r\n]*)", 1)
    out = recs.select("k", F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"[a-z\s]", "").alias("sequence"), F.split(head, r"\s+")[1].try_cast("double").alias("score"))
    return out.where(F.col("k") <= n) if n else out


def merge_msa(parts: list[DataFrame], query: str) -> DataFrame:
    """All records, the query first, then by falling score; repeated sequences once."""
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    best = out.groupBy("sequence").agg(F.max(F.struct("score", "name")).alias("_b")).select(F.col("_b.name").alias("name"), "sequence", F.col("_b.score").alias("score"))
    return best.orderBy((F.col("name") != query), F.col("score").desc_nulls_last(), "name")


def valid_a3m(lines: DataFrame) -> DataFrame:
    """One row: whether headers and sequences alternate and all letters are allowed."""
    odd = F.col("n") % 2 == 1
    ok = F.when(odd, F.col("line").startswith(">")).otherwise(F.col("line").rlike("^[A-Za-z.*-]+$"))
    return lines.where(F.trim("line") != "").agg(F.bool_and(ok).alias("valid"), F.count(F.lit(1)).alias("lines"))


# --- Structures -------------------------------------------------------------------------------------------------------


def scan_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms by the fixed columns: file, serial, atom, resname, chain, resnum, x, y, z."""
    v = F.col("value")
    cut = lambda a, n: F.trim(F.substring(v, a, n))
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(v.startswith("ATOM") | v.startswith("HETATM")).select(
        "file", F.substring(v, 1, 6).alias("record"), cut(7, 5).try_cast("int").alias("serial"), cut(13, 4).alias("atom"), cut(18, 3).alias("resname"), cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("resnum"),
        cut(31, 8).try_cast("double").alias("x"), cut(39, 8).try_cast("double").alias("y"), cut(47, 8).try_cast("double").alias("z"),
    )


def chain_sequence(atoms: DataFrame) -> DataFrame:
    """One letter per residue by number, X where the name is unknown: file, chain, sequence."""
    res = atoms.where("record LIKE 'ATOM%'").groupBy("file", "chain", "resnum").agg(F.min("resname").alias("resname"))
    return res.groupBy("file", "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("resnum", one_letter(F.col("resname")).alias("a")))), lambda s: s["a"]), "").alias("sequence"))


def pdb_line(serial: Column, atom: Column, resname: Column, chain: Column, resnum: Column, x: Column, y: Column, z: Column) -> Column:
    """An ATOM line of fixed columns."""
    return F.format_string("ATOM  %5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f", serial, F.when(F.length(atom) < 4, F.concat(F.lit(" "), atom)).otherwise(atom), resname, chain, resnum, x, y, z)


def clean_pdb(lines: DataFrame, remarks: list[str] = ()) -> DataFrame:
    """Lines without TER and END, cut to 76 columns, then sorted REMARK lines: n, line."""
    kept = lines.where(~F.col("line").rlike("^(TER|END)")).select("n", F.substring("line", 1, 76).alias("line"))
    extra = lines.sparkSession.createDataFrame([(1 << 40 | i, f"REMARK {r}") for i, r in enumerate(sorted(remarks))], "n long, line string")
    return kept.withColumn("n", F.col("n").cast("long")).unionByName(extra)


def scan_lammps(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of all frames: file, timestep, id, type, x, y, z; scaled coordinates are stretched to the box. Frames without
    atoms have none; a type that isn't listed is 0."""
    frames = marked_records(spark, path, "ITEM: TIMESTEP").where(F.trim("record") != "")
    step = F.regexp_extract("record", r"^\s*(\d+)", 1).try_cast("long")
    number = r"([-+0-9.eE]+)"
    box = rf"ITEM: BOX BOUNDS[^\n]*\n\s*{number}\s+{number}[^\n]*\n\s*{number}\s+{number}[^\n]*\n\s*{number}\s+{number}"
    bounds = [F.regexp_extract("record", box, i).try_cast("double").alias(f"b{i}") for i in range(1, 7)]
    names = F.split(F.trim(F.regexp_extract("record", r"ITEM: ATOMS([^\n]*)", 1)), r"\s+").alias("names")
    atoms = F.split(F.trim(F.regexp_extract("record", r"(?s)ITEM: ATOMS[^\n]*\n(.*)", 1)), r"\s*\n\s*")
    rows = frames.select("file", step.alias("timestep"), *bounds, names, F.explode(atoms).alias("line")).where("line <> ''")
    rows = rows.select("*", F.map_from_arrays("names", F.slice(F.split("line", r"\s+"), F.lit(1), F.size("names"))).alias("v"))
    value = lambda c: F.get(F.map_values(F.map_filter("v", lambda k, _: k == F.lit(c))), F.lit(0)).try_cast("double")

    def axis(i: int, c: str) -> Column:
        low, high = F.col(f"b{2 * i + 1}"), F.col(f"b{2 * i + 2}")
        return F.coalesce(value(c), value(f"{c}s") * (high - low) + low).alias(c)

    return rows.select("file", "timestep", value("id").cast("long").alias("id"), F.coalesce(value("type"), F.lit(0.0)).cast("int").alias("type"), *[axis(i, c) for i, c in enumerate("xyz")])


def docking_best(spark: SparkSession, path: str) -> DataFrame:
    """ligand and its best affinity: the first result line of each file, best first."""
    line = F.regexp_extract("text", r"REMARK VINA RESULT:\s*(\S+)", 1)
    return whole_files(spark, path).select(stem(F.col("file")).alias("ligand"), line.try_cast("double").alias("affinity")).where("affinity IS NOT NULL").orderBy("affinity", "ligand")


# --- Genomics ---------------------------------------------------------------------------------------------------------

BED = ("chrom", "start", "end", "name", "score", "strand")
PEAK = (*BED, "signal", "pvalue", "qvalue", "summit")


def scan_bed(spark: SparkSession, path: str, kind: str = "bed") -> DataFrame:
    """BED, narrowPeak or broadPeak, in closed 1-based coordinates."""
    names = {"bed": BED, "narrowPeak": PEAK, "broadPeak": PEAK[:-1]}[kind]
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser|$)")).select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(names)])
    numbers = {}
    for c in names:
        if c in ("score", "signal", "pvalue", "qvalue"):
            numbers[c] = F.col(c).try_cast("double")
        elif c == "summit":
            numbers[c] = F.col(c).try_cast("long")
    return rows.withColumns({"start": F.col("start").try_cast("long") + 1, "end": F.col("end").try_cast("long"), **numbers})


def write_bed(df: DataFrame, path: str, cols: tuple[str, ...] = ("chrom", "start", "end")) -> None:
    """Half-open 0-based coordinates again."""
    df.select(*[(F.col(c) - 1).alias(c) if c == "start" else F.col(c) for c in cols]).write.csv(path, sep="\t", header=False)


def scan_gtf(spark: SparkSession, path: str, attributes: tuple[str, ...] = ("gene_id", "transcript_id", "gene_name", "gene_type")) -> DataFrame:
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#"))
    names = ("chrom", "source", "feature", "start", "end", "score", "strand", "frame")
    attr = lambda a: F.nullif(F.regexp_extract(F.get(parts, F.lit(8)), rf'(?:^|[ ;]){a}[ =]"?([^";]+)', 1), F.lit(""))
    out = rows.select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(names)], *[attr(a).alias(a) for a in attributes])
    return out.withColumns({"start": F.col("start").try_cast("long"), "end": F.col("end").try_cast("long")})


def transcript_map(gtf: DataFrame) -> DataFrame:
    return gtf.where("feature = 'transcript'").select("transcript_id", "gene_id").where("transcript_id IS NOT NULL").distinct()


def biotype_beds(gtf: DataFrame, biotype: str = "gene_type") -> DataFrame:
    """Genes as BED rows with their biotype, to be written by ``partitionBy``."""
    return gtf.where("feature = 'gene'").select("chrom", "start", "end", F.col("gene_id").alias("name"), F.lit(0).alias("score"), "strand", F.coalesce(biotype, F.lit("unknown")).alias("biotype"))


def scan_salmon(spark: SparkSession, pattern: str, t2g: DataFrame | None = None) -> DataFrame:
    """quant.sf files of sample folders: gene, sample, count, tpm; transcripts are summed by gene."""
    rows = spark.read.options(header=True, sep="\t").schema("Name string, Length long, EffectiveLength double, TPM double, NumReads double").csv(pattern)
    rows = rows.select(F.split("Name", "[.]")[0].alias("gene"), F.regexp_extract("_metadata.file_path", r"([^/]+)/quant\.sf(?:/[^/]*)?$", 1).alias("sample"), F.col("NumReads").alias("count"), F.col("TPM").alias("tpm"))
    if t2g is not None:
        rows = rows.join(t2g.select(F.split("transcript_id", "[.]")[0].alias("gene"), F.col("gene_id").alias("_g")), "gene").withColumn("gene", F.col("_g"))
    return rows.groupBy("gene", "sample").agg(F.sum("count").alias("count"), F.sum("tpm").alias("tpm"))


def scan_feature_counts(spark: SparkSession, path: str) -> DataFrame:
    """ensembl_id, length, and a column per sample named by its file."""
    df = spark.read.options(header=True, sep="\t", comment="#").csv(path)
    samples = [c for c in df.columns if c not in ("Geneid", "Chr", "Start", "End", "Strand", "Length")]
    return df.select(F.split("Geneid", "[.]")[0].alias("ensembl_id"), F.col("Length").cast("long").alias("length"), *[F.col(f"`{c}`").cast("long").alias(re.sub(r"(\.sorted)?\.bam$", "", c.rsplit("/", 1)[-1])) for c in samples])


def log_metrics(df: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """Numbers from log texts by patterns with one group; 0 where missing."""
    return df.withColumns({n: F.coalesce(F.regexp_extract(text, p, 1).try_cast("double"), F.lit(0.0)) for n, p in patterns.items()}).drop(text)


#: Where the usual logs hold their numbers.
FLAGSTAT = {"total": r"(\d+) \+ \d+ in total", "mapped": r"(\d+) \+ \d+ mapped", "paired": r"(\d+) \+ \d+ properly paired", "duplicates": r"(\d+) \+ \d+ duplicates"}
SALMON = {"mapping_rate": r"Mapping rate = ([0-9.]+)%"}
SALMON_META = {"processed": r'"num_processed":\s*(\d+)', "mapped": r'"num_mapped":\s*(\d+)', "percent_mapped": r'"percent_mapped":\s*([0-9.]+)'}
STAR = {"input_reads": r"Number of input reads \|\s*(\d+)", "unique_reads": r"Uniquely mapped reads number \|\s*(\d+)", "unique_pct": r"Uniquely mapped reads % \|\s*([0-9.]+)%", "multi_reads": r"Number of reads mapped to multiple loci \|\s*(\d+)", "unmapped_pct": r"% of reads unmapped: too short \|\s*([0-9.]+)%"}


def append_statistics(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def read_channels(lines: DataFrame) -> DataFrame:
    """Sectioned text ('[file]' lines, then 'channel = name'): file section, channel, name."""
    w = Window.partitionBy("file").orderBy("n")
    x = lines.withColumn("section", F.last(F.nullif(F.regexp_extract("line", r"^\[(.+)\]$", 1), F.lit("")), ignorenulls=True).over(w))
    return x.where("line LIKE '%=%'").select("section", F.trim(F.regexp_extract("line", "^([^=]+)=", 1)).alias("channel"), F.trim(F.regexp_extract("line", "=(.*)$", 1)).alias("name"))


def positions_xml(df: DataFrame) -> DataFrame:
    """Stage positions as XML rows (root element Point)."""
    return df.select(F.to_xml(F.struct("PositionID", "name", "x", "y", "z"), {"rowTag": "Point"}).alias("value"))


def write_positions_xml(df: DataFrame, path: str) -> None:
    """Files with a root each, as readers of XML need one."""
    df.select("PositionID", "name", "x", "y", "z").write.options(rootTag="Points", rowTag="Point").xml(path)


def read_positions_xml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(rowTag="Point").schema("PositionID long, name string, x double, y double, z double").xml(path)


def sample_rows(df: DataFrame, most: int = 10_000) -> list[dict]:
    """A sample sheet as dictionaries, for a driver's loop; raises beyond so many rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a sample sheet of more than {most} rows")
    return [r.asDict() for r in rows]


def for_each_sample(sheet: DataFrame, call: Callable[[dict], DataFrame]) -> DataFrame | None:
    """What a call gives for each row of a sample sheet, put together; none for an empty sheet."""
    found = [call(row) for row in sample_rows(sheet)]
    return reduce(DataFrame.unionByName, found) if found else None


def merge_reads(spark: SparkSession, sheet: DataFrame) -> DataFrame:
    """Records of all FASTQ files of each sample of a sheet (sample, path): sample, then the columns of ``scan_fastq``."""
    names: dict[str, list[str]] = {}
    for row in sample_rows(sheet.select("sample", "path").distinct().orderBy("sample", "path")):
        names.setdefault(row["sample"], []).append(row["path"])
    found = [scan_fastq(spark, path).withColumn("sample", F.lit(sample)) for sample, paths in names.items() for path in paths]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "file string, n long, header string, seq string, plus string, qual string, sample string")


def write_tables(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """A folder for each named table, as the sheets of a workbook; replaces those of the same name."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.option("header", True) if kind == "csv" else w).format(kind).save(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: list[str], kind: str = "parquet") -> dict[str, DataFrame]:
    return {n: spark.read.options(**({"header": True} if kind == "csv" else {})).format(kind).load(f"{path}/{n}") for n in names}


def put_file(spark: SparkSession, path: str, content: str) -> str:
    """A small file in any file system that Spark knows."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    return path


def spike_free_table(sheet: DataFrame, columns: tuple[str, str] = ("sample", "group"), control: str = "control") -> DataFrame:
    """ID, group and antibody of a sample sheet, with a constant column for the colour."""
    return sheet.select(F.col(columns[0]).alias("ID"), F.coalesce(control, F.lit("none")).alias("ANTIBODY"), F.col(columns[1]).alias("GROUP"), F.lit("black").alias("COLOR"))


def merge_samples(runs: DataFrame, sheet: DataFrame, key: str = "run") -> DataFrame:
    """Files of each sample in order, and whether runs are missing from the sheet or without files."""
    j = sheet.join(runs, key, "full")
    return j.groupBy(F.coalesce("sample", F.lit("?")).alias("sample")).agg(F.array_sort(F.collect_list("path")).alias("paths"), F.sum(F.col("path").isNull().cast("int")).alias("missing_files"))
