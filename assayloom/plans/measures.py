"""Columns, scalar functions, summaries, windows and tests that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions import dna, maths, strings
from assayloom.operators import aggregate as A
from assayloom.operators import columns as C
from assayloom.operators import plates
from assayloom.operators import relational as R
from assayloom.operators import stats as S
from assayloom.operators import windows as W
from assayloom.plans.registry import query

SEQ = "translate(substr(md5({k}::VARCHAR), 1, {n}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def letters(key: str, n: int = 32):
    return F.translate(F.substring(F.md5(F.col(key).cast("string")), 1, n), "0123456789abcdef", "ACGTACGTACGTACGT")


# --- Columns ----------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def select_roles(t):
    return C.select_roles(t.lineitem, keep=["^l_order", "linenumber$", "price"], drop=["status"])


@query("SELECT p_partkey AS partkey, p_name AS name, p_size AS \"size_DAPI\" FROM part")
def rename_roles(t):
    x = C.strip_prefix(t.part.select("p_partkey", "p_name", F.col("p_size").alias("p_size_ch1")), "p_")
    return C.rename_with(C.rename_channels(x, {"ch1": "DAPI"}), lambda c: c.removesuffix("_"), ["name"])


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_tax, sqrt(l_quantity) AS l_quantity_root, sqrt(l_tax) AS l_tax_root FROM lineitem", ["l_quantity_root", "l_tax_root"])
def across_columns(t):
    return C.across(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"], F.sqrt, "_root")


@query("SELECT p_size, p_partkey, p_name FROM part")
def relocate_columns(t):
    x = C.relocate(t.part.select("p_partkey", "p_name", "p_size"), "p_size")
    return x if x.columns[0] == "p_size" else x.limit(0)


@query("SELECT p_partkey FROM part WHERE p_size < 5 OR p_partkey < 50")
def filter_any(t):
    x = t.part.select("p_partkey", (F.col("p_size") * 10).alias("a"), F.col("p_partkey").alias("b"))
    return C.filter_any(x, ["a", "b"], lambda c: c < 50).select("p_partkey")


@query("SELECT p_partkey, 'chr' || c AS chrom FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'X' WHEN 1 THEN 'MT' WHEN 2 THEN '7' WHEN 3 THEN 'KI270728.1' ELSE '12' END AS c FROM part) WHERE c IN ('X', '7', '12')")
def standard_chromosomes(t):
    s = F.col("p_size") % 5
    chrom = F.when(s == 0, "X").when(s == 1, "chrMT").when(s == 2, "7").when(s == 3, "KI270728.1").otherwise("chr12")
    return C.standard_chromosomes(t.part.select("p_partkey", chrom.alias("chrom")))


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, -1) AS bal, coalesce(CASE WHEN c_nationkey > 3 THEN c_name END, 'none') AS name FROM customer")
def replace_na(t):
    x = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"), F.when(F.col("c_nationkey") > 3, F.col("c_name")).alias("name"))
    return C.replace_na(x, {"bal": -1.0, "name": "none"})


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity + l_tax + l_discount) / 3 AS \"Cells_Texture_Contrast_ch1_3_256\", CASE WHEN l_tax > 0.04 THEN l_tax END AS \"Texture_Entropy_ch2_5_64\" FROM lineitem", ["Cells_Texture_Contrast_ch1_3_256", "Texture_Entropy_ch2_5_64"])
def average_directions(t):
    """Four directions, one missing; the second measure has one direction and a null in the other."""
    x = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("Cells_Texture_Contrast_ch1_3_00_256"), F.col("l_tax").alias("Cells_Texture_Contrast_ch1_3_01_256"), F.lit(None).cast("double").alias("Cells_Texture_Contrast_ch1_3_02_256"), F.col("l_discount").alias("Cells_Texture_Contrast_ch1_3_03_256"),
        F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("Texture_Entropy_ch2_5_00_64"), F.lit(None).cast("double").alias("Texture_Entropy_ch2_5_01_64"),
    )
    return C.average_directions(x)


@query("SELECT p_partkey, p_name AS best, p_brand AS first FROM part")
def best_match(t):
    return t.part.select("p_partkey", F.col(strings.best_match(t.part.columns, ["nothing", "^p_name$", "brand"])).alias("best"), F.col(strings.best_match(["p_brand", "p_type"], ["nothing"])).alias("first"))


@query("SELECT c.c_custkey, c.c_name, p.p_partkey FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS k FROM customer WHERE c_custkey <= 1000) c JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_partkey <= 1000) p USING (k)")
def bind_columns(t):
    """Two lists of one length (the first thousand keys, which both tables have at every scale here)."""
    a, b = t.customer.where("c_custkey <= 1000").select("c_custkey", "c_name", "c_acctbal"), t.part.where("p_partkey <= 1000").select("p_partkey", (-F.col("p_retailprice")).alias("price"))
    return R.bind_columns(a, ["c_acctbal", "c_custkey"], b, ["price", "p_partkey"]).select("c_custkey", "c_name", "p_partkey")


@query("SELECT event_type, max(value) AS top, count(*) AS n FROM events GROUP BY 1", ["top"])
def split_parts(t):
    return R.split_apply(t.events, "event_type", lambda part: part.groupBy("event_type").agg(F.max("value").alias("top"), F.count(F.lit(1)).alias("n")))


@query("SELECT s_suppkey AS n, s_name AS a, n_name AS b FROM supplier JOIN nation ON s_suppkey = n_nationkey")
def zip_files(t):
    """Records with equal numbers; stops at the shorter table."""
    return R.zip_rows(t.supplier.select(F.col("s_suppkey").alias("n"), F.col("s_name").alias("a")), t.nation.select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_name").alias("b")), "n")


# --- Scalar functions -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, lpad(p_brand, greatest(12, length(p_brand))::INTEGER, '0') AS l, rpad(p_brand, greatest(3, length(p_brand))::INTEGER, 'x') AS r, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS s, upper(p_type) AS u, length(p_name) AS n, split_part(p_name, ' ', 1) AS first, regexp_extract(p_brand, '([0-9]+)', 1) AS num, p_name LIKE '%a%' AS has, p_brand || '/' || p_size AS c FROM (SELECT *, '  ' || p_type || chr(9) || '  ' || p_brand || ' ' AS s FROM part)")
def string_tools(t):
    s = F.concat(F.lit("  "), "p_type", F.lit("\t  "), "p_brand", F.lit(" "))
    b = F.col("p_brand")
    return t.part.select("p_partkey", strings.pad(b, 12, "0").alias("l"), strings.pad(b, 3, "x", left=False).alias("r"), strings.squish(s).alias("s"), F.upper("p_type").alias("u"), F.length("p_name").cast("long").alias("n"), F.split("p_name", " ")[0].alias("first"), F.regexp_extract(b, "([0-9]+)", 1).alias("num"), F.col("p_name").contains("a").alias("has"), F.concat_ws("/", b, "p_size").alias("c"))


@query("SELECT p_partkey, 'ENSG' || p_partkey AS gene, p_size / 50 AS share, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS title, 'HALLMARK' AS category, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' set' AS description FROM part", ["share"])
def identifiers(t):
    category, description = strings.collection_parts(F.concat(F.lit("HALLMARK_"), F.upper("p_type"), F.lit("_SET")))
    return t.part.select("p_partkey", strings.unversioned(F.concat(F.lit("ENSG"), "p_partkey", F.lit(".12"))).alias("gene"), strings.fraction(F.concat("p_size", F.lit("/50"))).alias("share"), strings.sentence_case(F.col("p_type")).alias("title"), category.alias("category"), description.alias("description"))


@query("SELECT p_partkey, 'run7:' || p_partkey AS id, CASE p_size % 4 WHEN 3 THEN NULL ELSE p_size % 2 + 1 END AS mate FROM part")
def read_names(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    end = F.when(s % 4 == 0, "/1").when(s % 4 == 1, " 2:N:0:ACGT").when(s % 4 == 2, "_1").otherwise("")
    h = F.concat(F.lit("@run7:"), k, end)
    return t.part.select("p_partkey", strings.read_id(h).alias("id"), strings.read_mate(h).alias("mate"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'S' || s_suppkey || '_R2_001.fastq.gz' WHEN 1 THEN 'S' || s_suppkey || '_2.fq' END AS mate, 'S' || s_suppkey || '_rep2_1.fq.gz' AS name FROM supplier")
def mate_files(t):
    from assayloom.sources.text import replicate_name

    k = F.col("s_suppkey")
    f = F.concat(F.lit("S"), k, F.when(k % 3 == 0, "_R1_001.fastq.gz").when(k % 3 == 1, "_1.fq").otherwise(".bam"))
    return t.supplier.select("s_suppkey", strings.mate_file(f).alias("mate"), F.concat(F.lit("S"), k, F.lit(replicate_name("", 2, 1))).alias("name"))


@query("SELECT p_partkey, CASE WHEN v < 0.01 THEN printf('%.2e', v) ELSE printf('%.2f', v) END AS txt FROM (SELECT p_partkey, p_size / 1024 AS v FROM part)")
def format_auto(t):
    return t.part.select("p_partkey", strings.format_auto(F.col("p_size") / 1024, 0.01).alias("txt"))


def rc(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


@query(f"""SELECT p_partkey, coalesce(list_max([l FOR l IN range(1, 13) IF len([i FOR i IN range(1, 14 - l) IF contains({rc('s')}, substr(s, i, l))]) > 0]), 0)::INTEGER AS hairpin,
len([i FOR i IN range(0, 10) IF list_sum([(substr(s, i + j, 1) <> substr('ATG', j, 1))::INTEGER FOR j IN range(1, 4)]) <= 1]) > 0 AS near_atg FROM (SELECT p_partkey, {SEQ.format(k='p_partkey', n=12)} AS s FROM part)""")
def seq_motifs(t):
    x = t.part.select("p_partkey", letters("p_partkey", 12).alias("s"))
    return x.select("p_partkey", dna.hairpin("s").alias("hairpin"), dna.fuzzy("s", "ATG").alias("near_atg"))


@query(f"SELECT p_partkey, list_aggregate([substr('ACGT', ((p_partkey * 977) // (4 ** i)::BIGINT % 4 + 1)::INTEGER, 1) FOR i IN range(0, 8)], 'string_agg', '') AS s, p_partkey & 3 AS low, p_partkey >> 2 AS rest FROM part")
def seq_codes(t):
    x = t.part.select("p_partkey", (F.col("p_partkey") * 977).alias("code"))
    return x.select("p_partkey", dna.from_int("code", 8).alias("s"), F.col("p_partkey").bitwiseAND(3).alias("low"), F.shiftright("p_partkey", 2).alias("rest"))


@query("SELECT p_partkey, coalesce(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in dna.RESIDUES.items()) + "}[r], 'X') AS one, n FROM (SELECT p_partkey, ['ALA', 'GLY', 'Trp', 'XYZ', 'SEC'][p_size % 5 + 1] AS raw, upper(['ALA', 'GLY', 'Trp', 'XYZ', 'SEC'][p_size % 5 + 1]) AS r, length(p_name) AS n FROM part)")
def residue_letters(t):
    r = F.element_at(F.array(*[F.lit(x) for x in ("ALA", "GLY", "Trp", "XYZ", "SEC")]), F.col("p_size") % 5 + 1)
    return t.part.select("p_partkey", dna.one_letter(r).alias("one"), F.length("p_name").cast("long").alias("n"))


@query(f"""SELECT p_partkey, CASE WHEN n = 1 THEN substr(s, 1, instr(s, 'ACG') - 1) END AS l, CASE WHEN n = 1 THEN substr(s, instr(s, 'ACG') + 3) END AS r, n = 1 AS once,
CASE WHEN e = 1 THEN substr(x, 1, instr(x, 'GAATTC')) END AS cut_l, CASE WHEN e = 1 THEN substr(x, instr(x, 'GAATTC') + 1) END AS cut_r
FROM (SELECT *, (length(s) - length(replace(s, 'ACG', ''))) / 3 AS n, (length(x) - length(replace(x, 'GAATTC', ''))) / 6 AS e FROM (SELECT p_partkey, {SEQ.format(k='p_partkey', n=16)} AS s, {SEQ.format(k='p_partkey', n=5)} || CASE WHEN p_size % 3 > 0 THEN 'GAATTC' ELSE 'T' END || 'AC' || CASE WHEN p_size % 3 = 2 THEN 'GAATTC' ELSE '' END AS x FROM part))""")
def dna_cuts(t):
    s, k = letters("p_partkey", 16), F.col("p_size") % 3
    x = F.concat(letters("p_partkey", 5), F.when(k > 0, "GAATTC").otherwise("T"), F.lit("AC"), F.when(k == 2, "GAATTC").otherwise(""))
    left, right, once = dna.split_by_sequence(F.col("s"), "acg")
    cut_l, cut_r = dna.split_by_enzyme(F.col("x"), "EcoRI")
    return t.part.select("p_partkey", s.alias("s"), x.alias("x")).select("p_partkey", left.alias("l"), right.alias("r"), once.alias("once"), cut_l.alias("cut_l"), cut_r.alias("cut_r"))


CODONS = "MAP {" + ", ".join(f"'{aa}': [{', '.join(repr(c) for c, _ in codons)}]" for aa, codons in sorted(dna.even_codons().items())) + "}"


@query(f"""SELECT k, string_agg({CODONS}[a][1 + least(floor((('0x' || substr(md5(k || ':' || i), 1, 8))::BIGINT::DOUBLE / 4294967296.0 - 1e-12) * len({CODONS}[a])), len({CODONS}[a]) - 1)::INTEGER], '' ORDER BY i) AS dna, p
FROM (SELECT k, p, unnest(string_split(p, '')) AS a, unnest(range(0, 8)) AS i FROM (SELECT p_partkey AS k, translate(substr(md5(p_partkey::VARCHAR), 1, 8), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS p FROM part)) GROUP BY k, p""")
def reverse_translation(t):
    p = F.translate(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 8), "0123456789abcdef", "ACDEFGHIKLMNPQRS")
    x = t.part.select(F.col("p_partkey").alias("k"), p.alias("p"))
    return x.select("k", dna.reverse_translate("p", "k", dna.even_codons()).alias("dna"), "p")


@query(f"""WITH RECURSIVE q AS (SELECT n_nationkey AS k, r_regionkey AS j, {SEQ.format(k='n_nationkey', n=5)} AS a, {SEQ.format(k="('r' || r_regionkey)", n=4)} AS b FROM nation, region),
w AS (SELECT k, j, a, b, 0 AS x, 0 AS y, 'm' AS last, 0::DOUBLE AS s FROM q
  UNION ALL SELECT k, j, a, b, x + dx, y + dy, m, s + CASE WHEN m = 'm' THEN CASE WHEN substr(a, x + 1, 1) = substr(b, y + 1, 1) THEN 2 ELSE -1 END WHEN last = m THEN -0.1 ELSE -0.5 END
  FROM w, (VALUES ('m', 1, 1), ('x', 1, 0), ('y', 0, 1)) AS step(m, dx, dy) WHERE x + dx <= length(a) AND y + dy <= length(b) AND NOT (last = 'y' AND m = 'x'))
SELECT k, j, max(s) AS score FROM w WHERE x = length(a) AND y = length(b) GROUP BY 1, 2""", ["score"])
def alignment_scores(t):
    """Global alignments with affine gaps, against all paths written out."""
    a = t.nation.select(F.col("n_nationkey").alias("k"), letters("n_nationkey", 5).alias("a"))
    b = t.region.select(F.col("r_regionkey").alias("j"), F.translate(F.substring(F.md5(F.concat(F.lit("r"), "r_regionkey")), 1, 4), "0123456789abcdef", "ACGTACGTACGTACGT").alias("b"))
    return R.expand_grid(a, b).select("k", "j", dna.alignment_score("a", "b").alias("score"))


PIX = "p AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x < 0 THEN 0 ELSE x::DOUBLE END) AS v FROM embeddings), n AS (SELECT vec_id, v, list_filter(v, lambda x: x <> 0) AS z FROM p)"


@query(f"WITH {PIX} SELECT vec_id, 'scale' AS method, list_sum(list_transform(v, lambda x: x / list_max(z))) AS total, v[1] / list_max(z) AS first FROM n UNION ALL SELECT vec_id, 'minmax', list_sum(list_transform(v, lambda x: (x - list_min(z)) / (list_max(z) - list_min(z)))), (v[1] - list_min(z)) / (list_max(z) - list_min(z)) FROM n UNION ALL SELECT vec_id, 'percentile', list_sum(list_transform(v, lambda x: (x - lo) / (hi - lo))), (v[1] - lo) / (hi - lo) FROM (SELECT *, list_aggregate(z, 'quantile_cont', 0.001) AS lo, list_aggregate(z, 'quantile_cont', 0.999) AS hi FROM n)", ["total", "first"])
def pixel_norms(t):
    x = t.embeddings.select("vec_id", F.expr("transform(embedding, x -> IF(x < 0, 0D, CAST(x AS DOUBLE)))").alias("v"))
    out = None
    for method in ("scale", "minmax", "percentile"):
        one = x.withColumn("v", maths.pixel_normalizer(method)(F.col("v"))).select("vec_id", F.lit(method).alias("method"), F.expr("aggregate(v, 0D, (s, x) -> s + x)").alias("total"), F.col("v")[0].alias("first"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT n_nationkey, i AS point, exp(ln((n_nationkey + 1) * 0.8) + i * (ln((n_nationkey + 10) * 1.2) - ln((n_nationkey + 1) * 0.8)) / 199) AS x FROM nation, (SELECT unnest(range(0, 200))::INTEGER AS i)", ["x"])
def log_grid(t):
    x = t.nation.select("n_nationkey", (F.col("n_nationkey") + 1.0).alias("low"), (F.col("n_nationkey") + 10.0).alias("high"))
    return x.select("n_nationkey", F.posexplode(maths.log_grid("low", "high")).alias("point", "x"))


# --- Plates -----------------------------------------------------------------------------------------------------------

OFFSETS = "o AS (SELECT i * 600.0::DOUBLE AS dx, j * 600.0::DOUBLE AS dy FROM (SELECT unnest(range(-5, 6)) AS i), (SELECT unnest(range(-5, 6)) AS j)), f AS (SELECT row_number() OVER (ORDER BY sqrt(dx * dx + dy * dy), dy, dx) AS field, dx, dy FROM o WHERE sqrt(dx * dx + dy * dy) + 300 <= 3000 ORDER BY 1 LIMIT 9)"


@query(f"WITH {OFFSETS} SELECT r_regionkey, field, dx, dy FROM f, region")
def field_offsets(t):
    return R.expand_grid(t.region.select("r_regionkey"), plates.field_offsets(t.spark, 9, 600.0, 6000.0)).withColumn("field", F.col("field").cast("long"))


@query(f"""WITH {OFFSETS}, w AS (SELECT r, c, row_number() OVER (ORDER BY r, CASE WHEN r % 2 = 0 THEN -c ELSE c END) AS visit FROM (SELECT unnest(range(1, 9)) AS r), (SELECT unnest(range(1, 13)) AS c))
SELECT r_regionkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY visit, field) - 1 AS "PositionID", chr((64 + r)::INTEGER) || c || '#' || field AS name, 96290 - (c - 1) * 9000 + dx AS x, 5089 + (r - 1) * 9000 + dy AS y, 5334::DOUBLE AS z FROM w, f, region""", ["x", "y"])
def stage_positions(t):
    found = plates.stage_positions(t.spark, "CellVis_P96", 9, 600.0).withColumn("PositionID", F.col("PositionID").cast("long"))
    return R.expand_grid(t.region.select("r_regionkey"), found)


@query("SELECT r_regionkey, 'CellVis_C18' AS name, 3 AS n_row, 6 AS n_col, 7560::DOUBLE AS dx, 7140::DOUBLE AS dy, 5650::DOUBLE AS diameter, 98195::DOUBLE AS a1_x, 9::BIGINT AS types FROM region")
def plate_types(t):
    k = plates.plate_types(t.spark)
    one = k.where("name = 'CellVis_C18'").select("name", "n_row", "n_col", F.col("well_interval_x").alias("dx"), F.col("well_interval_y").alias("dy"), F.col("well_diameter").alias("diameter"), "a1_x")
    return R.expand_grid(t.region.select("r_regionkey"), one).crossJoin(k.agg(F.count(F.lit(1)).alias("types")))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY c, CASE WHEN c % 2 = 1 THEN -y ELSE y END, p_partkey) AS visit FROM (SELECT p_partkey, p_brand, p_partkey * 10 + p_size AS y, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size % 7) AS c FROM part)")
def snake_fields(t):
    x = t.part.select("p_partkey", "p_brand", (F.col("p_size") % 7).alias("x"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("y"))
    return W.snake_fields(x, ["p_brand"]).select("p_partkey", F.col("visit").cast("long").alias("visit"))


VISITS = {"ll": "r, c", "tb": "c, CASE WHEN c % 2 = 0 THEN -r ELSE r END", "tt": "c, r"}


@query("WITH w AS (SELECT DISTINCT (p_partkey % 96) // 12 + 1 AS r, p_partkey % 12 + 1 AS c FROM part) SELECT r::INTEGER AS row, c::INTEGER AS col, " + ", ".join(f"row_number() OVER (ORDER BY {o}) AS {k}" for k, o in VISITS.items()) + " FROM w")
def serpentine_orders(t):
    k = F.col("p_partkey")
    x = t.part.select((F.floor(k % 96 / 12) + 1).cast("int").alias("row"), (k % 12 + 1).cast("int").alias("col")).distinct()
    for by in VISITS:
        x = W.serpentine(x, "row", "col", by, by).withColumn(by, F.col(by).cast("long"))
    return x


# --- Summaries and windows --------------------------------------------------------------------------------------------

TRIMMED = "(SELECT l_returnflag, l_linestatus, l_discount, l_tax, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_discount, l_orderkey, l_linenumber) AS k, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_tax, l_orderkey, l_linenumber) AS j, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem)"


@query(f"SELECT l_returnflag, l_linestatus, cell_count, a.m AS l_discount, b.m AS l_tax, l_quantity FROM (SELECT l_returnflag, l_linestatus, count(*) AS cell_count, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) JOIN (SELECT l_returnflag, l_linestatus, avg(l_discount) AS m FROM {TRIMMED} WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.1) GROUP BY 1, 2) a USING (l_returnflag, l_linestatus) JOIN (SELECT l_returnflag, l_linestatus, avg(l_tax) AS m FROM {TRIMMED} WHERE j > floor(n * 0.1) AND j <= n - floor(n * 0.1) GROUP BY 1, 2) b USING (l_returnflag, l_linestatus)", ["l_discount", "l_tax", "l_quantity"])
def summarize_field_trimmed(t):
    return A.summarize_field(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_discount", "l_tax"], ["l_quantity", "not_there"], trim=0.1)


@query("""WITH k AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, round(avg(p_size) FILTER (k > floor(n * 0.2) AND k <= n - floor(n * 0.2)), 3) AS p_size_mean, round(stddev_samp(p_size), 3) AS p_size_sd, round(stddev_samp(p_size) / sqrt(count(*)), 3) AS p_size_se FROM k GROUP BY 1""", ["p_size_mean", "p_size_sd", "p_size_se"])
def mean_sd_trimmed(t):
    return A.mean_sd(t.part, ["p_brand"], ["p_size"], trim=0.2, digits=3)


@query("SELECT c_mktsegment, stddev_samp(c_acctbal) / sqrt(count(c_acctbal)) AS se_n, stddev_samp(c_acctbal) / sqrt(count(*) - 1) AS se_length FROM (SELECT c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal FROM customer) GROUP BY 1", ["se_n", "se_length"])
def standard_errors(t):
    x = t.customer.select("c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("b"))
    return x.groupBy("c_mktsegment").agg(A.se(F.col("b")).alias("se_n"), A.se(F.col("b"), "length").alias("se_length"))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER w + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice)) SELECT l_orderkey, l_linenumber, l_partkey, r AS rank, CASE WHEN r <= 100 THEN 'neg' WHEN r > n - 100 THEN 'pos' ELSE 'ns' END AS label FROM r", ["rank"])
def label_ends(t):
    return W.label_ends(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "rank", "label")


# The normal quantile by another rational form than the operator's (relative error below 1.2e-9).
ACKLAM = """CASE WHEN p < 0.02425 THEN (((((-7.784894002430293e-03 * q + -3.223964580411365e-01) * q + -2.400758277161838) * q + -2.549732539343734) * q + 4.374664141464968) * q + 2.938163982698783) / ((((7.784695709041462e-03 * q + 3.224671290700398e-01) * q + 2.445134137142996) * q + 3.754408661907416) * q + 1)
WHEN p <= 0.97575 THEN (((((-3.969683028665376e+01 * r + 2.209460984245205e+02) * r + -2.759285104469687e+02) * r + 1.383577518672690e+02) * r + -3.066479806614716e+01) * r + 2.506628277459239) * (p - 0.5) / (((((-5.447609879822406e+01 * r + 1.615858368580409e+02) * r + -1.556989798598866e+02) * r + 6.680131188771972e+01) * r + -1.328068155288572e+01) * r + 1)
ELSE -(((((-7.784894002430293e-03 * u + -3.223964580411365e-01) * u + -2.400758277161838) * u + -2.549732539343734) * u + 4.374664141464968) * u + 2.938163982698783) / ((((7.784695709041462e-03 * u + 3.224671290700398e-01) * u + 2.445134137142996) * u + 3.754408661907416) * u + 1) END"""


@query(f"""WITH r AS (SELECT c_custkey, (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0::DOUBLE - 0.5::DOUBLE) / count(*) OVER (PARTITION BY c_mktsegment) AS p FROM customer),
v AS (SELECT c_custkey, p::DOUBLE AS p, sqrt(-2 * ln(p)) AS q, (p - 0.5) * (p - 0.5) AS r, sqrt(-2 * ln(1 - p)) AS u FROM r) SELECT c_custkey, {ACKLAM} AS "int" FROM v""", ["int"])
def inverse_normal(t):
    return W.inverse_normal(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", ["c_mktsegment"]).select("c_custkey", "int")


# --- Tests ------------------------------------------------------------------------------------------------------------


def t_tail(t: str, df: str) -> str:
    """Two-sided tail of Student's t by Simpson's rule on the density."""
    c = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi())"
    h = f"(abs({t}) / 2000)"
    return f"1 - 2 * {c} * {h} / 3 * list_sum([(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * (1 + (i * {h}) ** 2 / {df}) ** (-({df} + 1) / 2) FOR i IN range(0, 2001)])"


def normal_tail(z: str) -> str:
    """erfc(|z| / sqrt 2) by a series with positive terms."""
    x = f"(abs({z}) / sqrt(2))"
    return f"CASE WHEN {z} = 0 THEN 1 WHEN abs({z}) > 8 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum([exp(-{x} * {x} + 2 * n * ln(2) + (2 * n + 1) * ln({x}) + lgamma(n + 1) - lgamma(2 * n + 2)) FOR n IN range(0, 200)]) END"


WELCH = """m AS (SELECT {by}, l_returnflag, count(*) AS n, avg({x}) AS m, var_samp({x}) AS v FROM lineitem GROUP BY 1, 2), c AS (SELECT {by}, n AS n0, m AS m0, v AS v0 FROM m WHERE l_returnflag = 'N'),
w AS (SELECT {by}, l_returnflag, (m - m0) / sqrt(v / n + v0 / n0) AS t, (v / n + v0 / n0) ** 2 / ((v / n) ** 2 / (n - 1) + (v0 / n0) ** 2 / (n0 - 1)) AS df FROM m JOIN c USING ({by}) WHERE l_returnflag <> 'N')"""


@query(f"WITH {WELCH.format(by='l_suppkey', x='l_quantity')} SELECT l_suppkey, l_returnflag, t, df, {t_tail('t', 'df')} AS pvalue FROM w", ["t", "df", "pvalue"])
def welch_pvalue(t):
    return S.welch(t.lineitem, ["l_suppkey"], "l_returnflag", "N", "l_quantity")


def signif(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0 ELSE round({x} * 10.0::DOUBLE ** (3 - floor(log10(abs({x}))))) / 10.0::DOUBLE ** (3 - floor(log10(abs({x})))) END"


@query(f"WITH {WELCH.format(by='l_suppkey', x='l_quantity')}, q AS (SELECT l_suppkey, l_returnflag, median(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2), p AS (SELECT *, {t_tail('t', 'df')} AS p FROM w) SELECT l_suppkey, l_returnflag, l_quantity, {signif('t')} AS l_quantity_statistic, {signif('p')} AS l_quantity_pvalue FROM p JOIN q USING (l_suppkey, l_returnflag)", ["l_quantity_statistic", "l_quantity_pvalue"])
def level_pvalues(t):
    return S.level_pvalues(t.lineitem, ["l_suppkey"], "l_returnflag", "N", ["l_quantity"], use_median=True)


VC = "v AS (SELECT user_id % 10 AS grp, value, event_type = 'view' AS f FROM events WHERE event_type IN ('view', 'click'))"


def views_and_clicks(t):
    return t.events.where(F.col("event_type").isin("view", "click")).select((F.col("user_id") % 10).alias("grp"), "value", (F.col("event_type") == "view").alias("f"))


@query(f"""WITH {VC}, g AS (SELECT grp, value, sum(f::INTEGER) AS a, sum((NOT f)::INTEGER) AS b FROM v GROUP BY 1, 2),
c AS (SELECT grp, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY grp) AS na, sum(b) OVER (PARTITION BY grp) AS nb FROM g WINDOW w AS (PARTITION BY grp ORDER BY value)),
d AS (SELECT grp, max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)) AS D, max(na)::BIGINT AS n1, max(nb)::BIGINT AS n2 FROM c GROUP BY 1), l AS (SELECT *, sqrt(n1 * n2 / (n1 + n2)::DOUBLE) * D AS l FROM d)
SELECT grp, D, n1, n2, CASE WHEN l < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum([(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * l * l) FOR k IN range(1, 101)]))) END AS pvalue FROM l""", ["D", "pvalue"])
def ks_pvalue(t):
    return S.ks_two_sample(views_and_clicks(t), ["grp"], "value", F.col("f"))


RANKS = f"""{VC}, r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY value) + (count(*) OVER (PARTITION BY grp, value) - 1) / 2.0::DOUBLE AS r FROM v), ties AS (SELECT grp, sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT grp, value, count(*)::DOUBLE AS t FROM v GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT grp, any_value(ties) AS ties, sum(r) FILTER (f) AS s, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2 FROM r JOIN ties USING (grp) GROUP BY 1),
z AS (SELECT grp, n1, n2, s - n1 * (n1 + 1) / 2 AS U, (s - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s)"""


@query(f"WITH {RANKS} SELECT grp, n1, n2, U, z, {normal_tail('z')} AS pvalue FROM z", ["U", "z", "pvalue"])
def rank_sum_pvalue(t):
    x = views_and_clicks(t).withColumn("value", F.col("value"))
    return S.rank_sum(x, ["grp"], "value", F.col("f"))


@query("SELECT s.k, s.a, s.b, round((s.a + 1) / nullif(c.a + 1, 0), 3) AS a_enrich, round((s.b + 1) / nullif(c.b + 1, 0), 3) AS b_enrich FROM (SELECT l_partkey AS k, sum(l_tax) AS a, sum(l_discount) AS b FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) s LEFT JOIN (SELECT l_partkey AS k, sum(l_tax) AS a, sum(l_discount) AS b FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) c USING (k)", ["a", "b", "a_enrich", "b_enrich"])
def enrich_fold(t):
    part = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_tax").alias("a"), F.sum("l_discount").alias("b"))
    return S.enrich_fold(part("A"), part("N"), ["k"], ["a", "b"])


FC = """WITH m AS (SELECT l_linestatus, median(l_quantity) AS m FROM lineitem GROUP BY 1), k AS (SELECT l_linestatus, l_tax, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_tax, l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_linestatus) AS n FROM lineitem WHERE l_returnflag = 'N'),
c AS (SELECT l_linestatus, avg(l_tax) AS c FROM k WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.1) GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / m AS by_median, l_tax / c + 0.5::DOUBLE AS by_trim FROM lineitem JOIN m USING (l_linestatus) JOIN c USING (l_linestatus)"""


@query(FC, ["by_median", "by_trim"])
def fold_change_modes(t):
    """Over the median of all rows; over the trimmed mean of the controls with a constant added to the ratio."""
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_returnflag", "l_quantity", "l_tax")
    a = S.fold_change(x, ["l_linestatus"], ["l_quantity"], F.col("l_returnflag") == "N", use_median=True)
    b = S.fold_change(a, ["l_linestatus"], ["l_tax"], F.col("l_returnflag") == "N", trim=0.1, const=0.5, const_on="ratio")
    return b.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity_FC").alias("by_median"), F.col("l_tax_FC").alias("by_trim"))


# --- Dose response ----------------------------------------------------------------------------------------------------

DOSES = [0.0, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0]


def exact_curves(t):
    """Points of one curve for each nation: upper 90 + k, half way at 1 + k / 5, slope 1 + k / 50, lower k / 3."""
    k = F.col("n_nationkey")
    x = t.nation.select("n_nationkey", (k + 90.0).alias("upper"), (k / 5 + 1).alias("ic50"), (k / 50 + 1).alias("slope"), (k / 3).alias("lower"), F.explode(F.array(*[F.lit(d) for d in DOSES])).alias("dose"))
    return x.withColumn("response", F.expr("IF(dose = 0, upper, lower + (upper - lower) / (1 + power(dose / ic50, slope)))"))


@query("SELECT n_nationkey, n_nationkey + 90.0::DOUBLE AS upper, n_nationkey / 5 + 1 AS ic50, n_nationkey / 50 + 1 AS slope, n_nationkey / 3 AS lower, true AS converged, robust, 11::BIGINT AS n FROM nation, (SELECT unnest(['none', 'huber']) AS robust)", ["upper", "ic50", "slope", "lower"])
def dose_fit_recovery(t):
    """Fits recover the parameters of exact curves, plain and robust."""
    x = exact_curves(t).select("n_nationkey", "dose", "response")
    both = S.fit_dose_response(x, ["n_nationkey"]).unionByName(S.fit_dose_response(x, ["n_nationkey"], robust=True))
    return both.select("n_nationkey", "upper", "ic50", "slope", "lower", "converged", "robust", "n")


@query("SELECT n_nationkey, (n_nationkey / 5 + 1) * (10 / 90.0::DOUBLE) ** (1 / (n_nationkey / 50 + 1)) AS ic10, (n_nationkey / 5 + 1) * 9.0::DOUBLE ** (1 / (n_nationkey / 50 + 1)) AS ic90 FROM nation", ["ic10", "ic90"])
def inhibition_doses(t):
    return S.inhibition_dose(S.fit_dose_response(exact_curves(t), ["n_nationkey"])).select("n_nationkey", "ic10", "ic90")


@query("WITH c AS (SELECT n_nationkey AS k, n_nationkey + 90.0::DOUBLE AS u, n_nationkey / 5 + 1 AS m, n_nationkey / 50 + 1 AS h, n_nationkey / 3 AS l FROM nation), g AS (SELECT *, exp(ln(0.008) + i * (ln(360) - ln(0.008)) / 199) AS x FROM c, (SELECT unnest(range(0, 200)) AS i)) SELECT k AS n_nationkey, x, l + (u - l) / (1 + (x / m) ** h) AS y FROM g", ["x", "y"])
def dose_curves(t):
    fit = S.fit_dose_response(exact_curves(t), ["n_nationkey"]).withColumns({"low": F.lit(0.01), "high": F.lit(300.0)})
    return S.predict_curve(fit, ["n_nationkey"])


@query("SELECT user_id, floor(value / 20)::BIGINT AS temperature, avg(value) AS fluorescence FROM events GROUP BY 1, 2", ["fluorescence"])
def average_curves(t):
    return S.average_curves(t.events.select("user_id", F.floor(F.col("value") / 20).cast("long").alias("temperature"), F.col("value").alias("fluorescence")), ["user_id"], "temperature", "fluorescence")


@query("SELECT n_nationkey, (40 + n_nationkey)::DOUBLE AS melting FROM nation")
def melting_points(t):
    """The extreme of the smoothed derivative, to the nearest degree, of curves whose middle is known."""
    x = t.nation.select("n_nationkey", F.explode(F.sequence(F.lit(20), F.lit(85))).alias("temperature")).withColumn("temperature", F.col("temperature").cast("double"))
    x = x.withColumn("f", F.expr("100D / (1 + exp(-(temperature - 40 - n_nationkey) / 2))"))
    d = S.curve_derivative(x, ["n_nationkey"], "temperature", "f", penalty=1e-3)
    return d.groupBy("n_nationkey").agg(F.round(F.max_by("temperature", "derivative")).alias("melting"))
