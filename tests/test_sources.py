"""Text formats, SQLite, incremental streams: round trips and hand-made files."""

import sqlite3

from pyspark.sql import functions as F

from assayloom.sources import sqlite as source
from assayloom.sources import text
from assayloom.streaming import incremental


def put(path, content):
    path.write_text(content)
    return f"file://{path}"


def test_delimited(spark, tmp_path):
    p = put(tmp_path / "plate7.csv", "made by x\n\nwell,value\nA1,1.5\nB2,\n")
    assert [tuple(r) for r in text.scan_csv(spark, p, 2).collect()] == [("A1", "1.5", "plate7"), ("B2", None, "plate7")]
    p = put(tmp_path / "t.txt", "# c\n a  1\nb\t2\n")
    assert [tuple(r) for r in text.scan_table(spark, p, ["k", "v"]).collect()] == [("a", "1"), ("b", "2")]


def test_fasta_and_fastq(spark, tmp_path):
    p = put(tmp_path / "x.fasta", ">s1 first\nACGT\nAC\n>s2\nGG")
    got = [(r.name, r.header, r.seq) for r in text.scan_fasta(spark, p).collect()]
    assert got == [("s1", "s1 first", "ACGTAC"), ("s2", "s2", "GG")] and [r.id for r in text.fasta_ids(spark, p).collect()] == ["s1", "s2"]
    text.write_fasta(text.scan_fasta(spark, p), f"file://{tmp_path}/out.fa", wrap=4)
    assert sorted((r.name, r.seq) for r in text.scan_fasta(spark, f"file://{tmp_path}/out.fa").collect()) == [("s1", "ACGTAC"), ("s2", "GG")]
    q = put(tmp_path / "r_1.fq", "@r1/1\nAC\n+\nII\n@r2/1\nGT\n+\nJJ\n")
    reads = text.scan_fastq(spark, q)
    assert [(r.n, r.header, r.seq, r.qual) for r in reads.collect()] == [(1, "@r1/1", "AC", "II"), (2, "@r2/1", "GT", "JJ")]
    text.write_fastq(reads.withColumn("rep", F.lit(1)), f"file://{tmp_path}/fq", "rep")
    assert text.scan_fastq(spark, f"file://{tmp_path}/fq/rep=1").count() == 2 and text.replicate_name("a", 2, 1) == "a_rep2_1.fq.gz"


def test_designed_sequences(spark, tmp_path):
    p = put(tmp_path / "m.fa", ">sub_1, score=1.2\nAAAA\n>T=0.1, sample=1, score=0.9, seq_recovery=0.5\nACDE\n>T=0.1, sample=2, score=0.8, seq_recovery=0.4\nACDF\n")
    assert [tuple(r)[1:] for r in text.parse_mpnn(spark, p).orderBy("id").collect()] == [("sub_1_1", 0.9, 0.5, "ACDE"), ("sub_1_2", 0.8, 0.4, "ACDF")]
    a3m = spark.createDataFrame([(">q 9.0\nAC-D\n>h1 3.5\nACaaGD\n",)], "text string")
    recs = text.parse_a3m(a3m)
    assert [(r.name, r.sequence, r.score) for r in recs.collect()] == [("q", "AC-D", 9.0), ("h1", "ACGD", 3.5)]
    assert [r.name for r in text.merge_msa([recs.select("name", "sequence", "score"), spark.createDataFrame([("z", "AAAA", 99.0)], "name string, sequence string, score double")], "q").collect()] == ["q", "z", "h1"]
    lines = spark.createDataFrame([(1, ">a"), (2, "AC-"), (3, ">b"), (4, "A1")], "n int, line string")
    assert text.valid_a3m(lines.where("n < 3")).first().valid and not text.valid_a3m(lines).first().valid


def test_structures(spark, tmp_path):
    row = spark.range(1).select(text.pdb_line(F.lit(1), F.lit("CA"), F.lit("ALA"), F.lit("A"), F.lit(7), F.lit(1.5), F.lit(-2.0), F.lit(3.25)).alias("l")).first().l
    p = put(tmp_path / "s.pdb", row + "\n" + row.replace("ALA A   7", "XXX A   8") + "\nTER\nEND\n")
    atoms = text.scan_pdb(spark, p)
    assert tuple(atoms.select("atom", "resname", "chain", "resnum", "x", "y", "z").first()) == ("CA", "ALA", "A", 7, 1.5, -2.0, 3.25)
    assert text.chain_sequence(atoms).first().sequence == "AX"
    assert [r.line[:6] for r in text.clean_pdb(text.ordered_lines(spark, p), ["b", "a"]).orderBy("n").collect()] == ["ATOM  ", "ATOM  ", "REMARK", "REMARK"]
    box = "ITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 20\n-5 5\n"
    p = put(tmp_path / "t.lammpstrj", f"ITEM: TIMESTEP\n0\n{box}ITEM: ATOMS id type xs ys zs\n1 2 0.5 0.5 0.5\nITEM: TIMESTEP\n10\n{box}ITEM: ATOMS id type x y z\n1 2 1 2 3\n")
    assert [tuple(r)[1:] for r in text.scan_lammps(spark, p).orderBy("timestep").collect()] == [(0, 1, 2, 5.0, 10.0, 0.0), (10, 1, 2, 1.0, 2.0, 3.0)]
    p = put(tmp_path / "lig.pdbqt", "REMARK VINA RESULT:    -7.5  0 0\nREMARK VINA RESULT:    -6.1 0 0\n")
    assert tuple(text.docking_best(spark, p).first()) == ("lig", -7.5)


def test_genomics(spark, tmp_path):
    p = put(tmp_path / "a.narrowPeak", "track x\nchr1\t9\t20\tp1\t5\t.\t1.5\t2\t3\t4\n")
    peak = text.scan_bed(spark, p, "narrowPeak").first()
    assert (peak.start, peak.end, peak.signal, peak.summit) == (10, 20, 1.5, 4)
    text.write_bed(text.scan_bed(spark, p, "narrowPeak"), f"file://{tmp_path}/o.bed")
    assert text.scan_bed(spark, f"file://{tmp_path}/o.bed").first().start == 10
    gtf = put(tmp_path / "a.gtf", '#!x\nchr1\ts\tgene\t1\t9\t.\t+\t.\tgene_id "g1"; gene_type "coding";\nchr1\ts\ttranscript\t1\t9\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\n')
    g = text.scan_gtf(spark, gtf)
    assert tuple(text.transcript_map(g).first()) == ("t1", "g1") and text.biotype_beds(g).first().biotype == "coding"
    d = tmp_path / "smp"
    d.mkdir()
    (d / "quant.sf").write_text("Name\tLength\tEffectiveLength\tTPM\tNumReads\nt1.3\t10\t9.0\t2.0\t4.0\n")
    assert tuple(text.scan_salmon(spark, f"file://{tmp_path}/*/quant.sf", text.transcript_map(g)).first()) == ("g1", "smp", 4.0, 2.0)
    fc = put(tmp_path / "fc.txt", "# p\nGeneid\tChr\tStart\tEnd\tStrand\tLength\t/x/a.bam\ng1.2\tc\t1\t2\t+\t100\t7\n")
    assert text.scan_feature_counts(spark, fc).columns == ["ensembl_id", "length", "a"]
    logs = spark.createDataFrame([("s", "10 + 0 in total\n8 + 0 mapped")], "sample string, text string")
    m = text.log_metrics(logs, text.FLAGSTAT).first()
    assert (m.total, m.mapped, m.duplicates) == (10.0, 8.0, 0.0)


def test_small_texts(spark, tmp_path):
    ch = text.read_channels(text.ordered_lines(spark, put(tmp_path / "c.txt", "[f1]\nch1 = DAPI\n[f2]\nch1=GFP\n")))
    assert [tuple(r) for r in ch.orderBy("section").collect()] == [("f1", "ch1", "DAPI"), ("f2", "ch1", "GFP")]
    pos = spark.createDataFrame([(0, "A1#1", 1.0, 2.0, 0.0)], "PositionID long, name string, x double, y double, z double")
    xml = "<r>" + text.positions_xml(pos).first().value + "</r>"
    assert tuple(text.read_positions_xml(spark, put(tmp_path / "p.xml", xml)).first()) == (0, "A1#1", 1.0, 2.0, 0.0)
    sheet = spark.createDataFrame([("r1", "s"), ("r2", "s")], "run string, sample string")
    got = text.merge_samples(spark.createDataFrame([("r1", "a.fq"), ("r9", "z.fq")], "run string, path string"), sheet).orderBy("sample").collect()
    assert [(r.sample, r.paths, r.missing_files) for r in got] == [("?", ["z.fq"], 0), ("s", ["a.fq"], 1)]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE Per_Cell (id INTEGER, Cell_Intensity_MeanIntensity_a REAL, same INTEGER, name TEXT)")
        con.executemany("INSERT INTO Per_Cell VALUES (?, ?, 1, ?)", [(i, i / 10, f"n{i}") for i in range(50)])
    assert source.read_table(spark, path, "Per_Cell", 4).count() == 50
    assert source.read_all(spark, path)["Per_Cell"].columns == ["id", "Cell_Intensity_MeanIntensity_a", "name"]
    obj = source.read_objects(spark, path, "Per_Cell", drop=["same"], prefix="Cell_")
    assert obj.columns == ["id", "name", "Intensity_MeanIntensity_a"] or set(obj.columns) == {"id", "name", "Intensity_MeanIntensity_a"}
    assert obj.where("id = 10").first().Intensity_MeanIntensity_a == 65535.0


def test_streams(spark, tmp_path):
    src, sink, check = (f"file://{tmp_path}/{n}" for n in ("src", "sink", "check"))
    events = spark.createDataFrame([(1, "a", 2.0)], "event_id long, event_type string, value double")
    events.write.parquet(src)
    for expected in (1, 1, 2):
        if expected == 2:
            events.write.mode("append").parquet(src)
        incremental.available_now(spark, src, events.schema, sink, check).awaitTermination()
        assert spark.read.parquet(sink).count() == expected


def test_files_of_many_splits(spark, tmp_path):
    """Line numbers, FASTQ and FASTA records and frames don't depend on where a file is split."""
    reads = [(f"@r{i}/1 {'x' * (i % 37)}", "ACGT" * (i % 9 + 1), "+", "@I+>" * (i % 9 + 1)) for i in range(700)]
    q = put(tmp_path / "a_1.fq", "".join("\n".join(r) + "\n" for r in reads))
    put(tmp_path / "b_1.fq", "@z\nAC\n+\nII\n@unfinished\nAC\n")
    names = [(f"s{i}", "ACGT" * (i % 50 + 1)) for i in range(300)]
    f = put(tmp_path / "x.fasta", "".join(f">{n} d\n{s[:7]}\n{s[7:]}\n" for n, s in names))
    box = "ITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n0 1e1\n0 20\n-5 5\n"
    t = put(tmp_path / "t.lammpstrj", "".join(f"ITEM: TIMESTEP\n{i}\n{box}ITEM: ATOMS id type xs y z\n1 2 0.5 {i} 3\n2 1 0.25 0 0\n" for i in range(200)))
    old, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = text.ordered_lines(spark, q)
        assert [r.line for r in lines.orderBy("n").collect()] == [x for r in reads for x in r] and lines.selectExpr("min(n)", "max(n)").first() == (1, 2800)
        got = text.scan_fastq(spark, f"file://{tmp_path}/*.fq").orderBy("file", "n").collect()
        assert [tuple(r)[2:] for r in got] == [*reads, ("@z", "AC", "+", "II")] and [r.n for r in got] == [*range(1, 701), 1]
        assert sorted((r.name, r.seq) for r in text.scan_fasta(spark, f).collect()) == sorted(names)
        atoms = text.scan_lammps(spark, t)
        assert atoms.count() == 400 and sorted((r.timestep, r.x, r.y) for r in atoms.where("id = 1").collect()) == [(i, 5.0, float(i)) for i in range(200)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
