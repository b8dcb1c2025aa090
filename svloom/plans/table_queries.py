"""Every operator applied to the driver's tables, each with its SQL: name -> (query, SQL or None).

The tables are not genomic, so each query first projects a genomic view of one of them with whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bnd, sequence, stats
from ..functions import cigar as cg
from ..operators import annotate, cluster, evidence, integrate, intervals, merge, subset, support

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """A SELECT over tables of the folder."""
    for n in names:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def alias_all(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.expr(v).alias(k) for k, v in names.items()])


# --- breakend pairs from orders

PAIRS = """SELECT concat('S', CAST(o_custkey % 5 AS STRING)) AS sample, o_orderkey * 2 AS id, o_orderkey * 2 + 1 AS mid,
 CAST(o_custkey % 3 AS STRING) AS chr1, (o_custkey * 37 + o_orderkey % 11) % 200000 AS st1, (o_custkey * 37 + o_orderkey % 11) % 200000 + 1 AS end1, CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END AS f1,
 CAST((o_custkey + 1) % 3 AS STRING) AS chr2, (o_custkey * 53 + o_orderkey % 7) % 200000 AS st2, (o_custkey * 53 + o_orderkey % 7) % 200000 + 1 AS end2, CASE WHEN o_orderpriority < '3' THEN '-' ELSE '+' END AS f2 FROM orders"""
EVENTS = f"""WITH half AS ({PAIRS}), bnd AS (SELECT sample, id, mid, chr1, st1, end1, f1, chr2, st2, end2, f2 FROM half
 UNION ALL SELECT sample, mid, id, chr2, st2, end2, f2, chr1, st1, end1, f1 FROM half)"""


def islands_sql(source: str, keys: str, start: str, end: str, distance: int, first: str, last: str, tie: str) -> str:
    """A SELECT that adds the gap cluster's range, by three windows over all rows."""
    return f"""SELECT * EXCLUDE (g, n), min({start}) OVER (PARTITION BY {keys}, n) AS {first}, max({end}) OVER (PARTITION BY {keys}, n) AS {last} FROM (
 SELECT *, sum(g) OVER (PARTITION BY {keys} ORDER BY {start}, {tie} ROWS UNBOUNDED PRECEDING) AS n FROM (
  SELECT *, CASE WHEN {start} - max({end}) OVER (PARTITION BY {keys} ORDER BY {start}, {tie} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {distance} THEN 0 ELSE 1 END AS g FROM {source}))"""


KEY = ", ".join(cluster.KEY)
CHAIN = f"""{EVENTS}, first AS ({islands_sql("bnd", "chr1", "st1", "end1", 20, "r1_start", "r1_end", "id")}),
 pairs AS (SELECT f.*, m.r1_start AS r2_start, m.r1_end AS r2_end FROM first f JOIN first m ON m.id = f.mid AND m.sample = f.sample),
 one AS ({islands_sql("pairs", KEY, "st1", "end1", 10, "n1_start", "n1_end", "id")}),
 two AS ({islands_sql("one", KEY, "st2", "end2", 10, "n2_start", "n2_end", "id")}),
 refined AS (SELECT sample, id, mid, chr1, n1_start AS r1_start, n1_end + 1 AS r1_end, f1, chr2, n2_start AS r2_start, n2_end + 1 AS r2_end, f2 FROM two)"""


def summary_sql(source: str, keys: str) -> str:
    return f"SELECT {keys}, string_agg(concat(sample, ':', id), ';' ORDER BY concat(sample, ':', id)) || ';' AS members, count(*) AS score FROM {source} GROUP BY {keys}"


def pairs_of(spark, d) -> DataFrame:
    return table(spark, d, PAIRS, "orders")


def events_of(spark, d) -> DataFrame:
    return cluster.oriented(pairs_of(spark, d))


@query("gap_cluster", f"""{EVENTS} SELECT chr1, island_start, island_end, count(*) AS n FROM ({islands_sql("bnd", "chr1", "st1", "end1", 20, "island_start", "island_end", "id")}) GROUP BY ALL""")
def gap_cluster(spark, d):
    return intervals.island_ranges(events_of(spark, d), ["chr1"], "st1", "end1", 20)


INDELS = "SELECT concat('S', CAST(l_suppkey % 4 AS STRING)) AS sample, l_orderkey * 10 + l_linenumber AS id, CAST(l_suppkey % 7 AS STRING) AS chr, (l_partkey * 9973 + l_orderkey * 31) % 10000000 AS st, (l_partkey * 9973 + l_orderkey * 31) % 10000000 + CAST(l_quantity AS BIGINT) AS end_, CASE WHEN l_returnflag = 'R' THEN 'DEL' ELSE 'INS' END AS sv_type FROM lineitem"


@query("gap_cluster_by_type", f"""SELECT chr, sv_type, island_start, island_end, count(*) AS n FROM ({islands_sql("(" + INDELS + ")", "chr, sv_type", "st", "end_", 50, "island_start", "island_end", "id")}) GROUP BY ALL""")
def gap_cluster_by_type(spark, d):
    return intervals.island_ranges(table(spark, d, INDELS, "lineitem"), ["chr", "sv_type"], "st", "end_", 50)


@query("indel_clusters", f"""SELECT chr, start, stop, sv_type, string_agg(concat(sample, ':', id), ';' ORDER BY concat(sample, ':', id)) || ';' AS members, count(*) AS score FROM ({islands_sql("(" + INDELS + ")", "chr, sv_type", "st", "end_", 50, "start", "stop", "id")}) GROUP BY ALL HAVING count(*) > 1""")
def indel_clusters(spark, d):
    return cluster.indel_clusters(table(spark, d, INDELS, "lineitem").withColumnRenamed("end_", "end"), 50, multi_only=True)


@query("cluster_pairs", f"{CHAIN} SELECT sample, id, mid, {KEY} FROM pairs")
def cluster_pairs(spark, d):
    return cluster.cluster_pairs(events_of(spark, d), 20).select("sample", "id", "mid", *cluster.KEY)


def refined(spark, d, events=None) -> DataFrame:
    return cluster.refine(cluster.cluster_pairs(events_of(spark, d) if events is None else events, 20), 10)


@query("cluster_refine", f"{CHAIN} {summary_sql('refined', KEY)}")
def cluster_refine(spark, d):
    return cluster.summarised(refined(spark, d))


COLLAPSED = "SELECT c.* FROM c WHERE (chr1, r1_start, r1_end, f1) <= (chr2, r2_start, r2_end, f2) AND EXISTS (SELECT 1 FROM c m WHERE m.chr1 = c.chr2 AND m.r1_start = c.r2_start AND m.r1_end = c.r2_end AND m.f1 = c.f2 AND m.chr2 = c.chr1 AND m.r2_start = c.r1_start AND m.r2_end = c.r1_end AND m.f2 = c.f1)"
BEDPE = "SELECT chr1, r1_start AS s1, r1_end - 1 AS e1, chr2, r2_start AS s2, r2_end - 1 AS e2, members AS name, score, f1 AS strand1, f2 AS strand2, 'BND_PAIR' AS type"


@query("cluster_collapse", f"{CHAIN}, c AS ({summary_sql('refined', KEY)}) {BEDPE} FROM ({COLLAPSED})")
def cluster_collapse(spark, d):
    return cluster.bedpe_pairs(cluster.collapse(cluster.summarised(refined(spark, d))))


@query("cluster_purge", f"{CHAIN}, last AS (SELECT {KEY}, sample, max(id) AS id FROM refined GROUP BY {KEY}, sample) {summary_sql('last', KEY)}")
def cluster_purge(spark, d):
    return cluster.summarised(refined(spark, d), purge=True)


@query("cluster_multi_only", f"{CHAIN} SELECT * FROM ({summary_sql('refined', KEY)}) WHERE score > 1")
def cluster_multi_only(spark, d):
    return cluster.summarised(refined(spark, d), multi_only=True)


@query("cluster_unidir", f"{CHAIN.replace('bnd AS (SELECT sample, id, mid, chr1, st1, end1, f1, chr2, st2, end2, f2 FROM half', 'bnd_ AS (SELECT sample, id, mid, chr1, st1, end1, f1, chr2, st2, end2, f2 FROM half').replace('FROM half), first', 'FROM half), bnd AS (SELECT * REPLACE (chr(46) AS f1, chr(46) AS f2) FROM bnd_), first')} {summary_sql('refined', KEY)}")
def cluster_unidir(spark, d):
    return cluster.summarised(refined(spark, d, cluster.without_direction(events_of(spark, d))))


# --- CIGAR strings from lineitem

CIGARS = """SELECT DISTINCT CASE l_linenumber % 4 WHEN 0 THEN concat(CAST(l_partkey % 300 + 1 AS STRING), 'S', CAST(CAST(l_quantity AS BIGINT) * 10 AS STRING), 'M', CAST(l_linenumber AS STRING), 'D', CAST(l_suppkey % 50 + 1 AS STRING), 'M')
 WHEN 1 THEN concat(CAST(CAST(l_quantity AS BIGINT) * 10 AS STRING), 'M', CAST(l_suppkey % 9 + 1 AS STRING), 'N', CAST(l_partkey % 70 + 1 AS STRING), '=', CAST(l_partkey % 300 + 1 AS STRING), 'H')
 WHEN 2 THEN concat(CAST(l_suppkey % 30 + 1 AS STRING), 'S', CAST(CAST(l_quantity AS BIGINT) * 10 AS STRING), '=', CAST(l_linenumber AS STRING), 'X', CAST(l_linenumber AS STRING), 'I', CAST(l_partkey % 300 + 1 AS STRING), 'M', CAST(l_suppkey % 25 + 1 AS STRING), 'S')
 ELSE concat(CAST(CAST(l_quantity AS BIGINT) AS STRING), 'M', CAST(l_partkey % 90 + 1 AS STRING), 'D', CASE WHEN l_suppkey % 2 = 0 THEN concat(CAST(l_suppkey % 40 + 1 AS STRING), 'S') ELSE '' END) END AS cigar,
 CAST(l_linenumber % 3 AS BIGINT) AS nm, (l_orderkey * 7) % 100000 AS start, CASE WHEN l_returnflag = 'R' THEN '-' WHEN l_returnflag = 'A' THEN '+' ELSE '.' END AS strand FROM lineitem"""


def sum_sql(c: str, ops: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform(regexp_extract_all({c}, '([0-9]+)[{ops}]', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT)"


def count_sql(c: str, ops: str) -> str:
    return f"CAST(len(regexp_extract_all({c}, '([0-9]+)[{ops}]', 1)) AS BIGINT)"


def clip_sql(c: str) -> tuple[str, str]:
    return tuple(f"coalesce(TRY_CAST(regexp_extract({c}, '{p}', 1) AS BIGINT), 0)" for p in ("^(\\d+)[HS]", "(\\d+)[HS]$"))


def evaluated_sql(source: str, cigar: str, nm: str, start: str, strand: str, prefix: str = "") -> str:
    """A SELECT of source's columns and the evaluation's, each with the prefix; rows without a breakpoint have null fp_target. The similarity is
    a number of single precision, as operators and their cut-offs have it."""
    up, down = clip_sql(cigar)
    p = prefix
    return f"""SELECT *, CASE WHEN {p}bt IS NOT NULL AND {p}bq IS NOT NULL AND {cigar} <> '*' AND {p}nmatch > 0 THEN {p}bt END AS {p}fp_target, CASE WHEN {p}bt IS NOT NULL THEN {p}bq END AS {p}fp_query, {start} + {p}match_length_s - 1 AS {p}aln_end FROM (
 SELECT *, CASE WHEN {start} + {p}seq_length > {p}upstream + {p}downstream THEN CASE WHEN {p}upstream > {p}downstream THEN {start} WHEN {p}upstream < {p}downstream THEN {start} + {p}match_length_s - 1 END END AS {p}bt,
  CASE WHEN {strand} = '+' AND {p}upstream > {p}downstream THEN {p}upstream WHEN {strand} = '+' AND {p}upstream < {p}downstream THEN {p}seq_length - {p}downstream - 1
   WHEN {strand} = '-' AND {p}upstream > {p}downstream THEN {p}seq_length - {p}upstream - 1 WHEN {strand} = '-' AND {p}upstream < {p}downstream THEN {p}downstream END AS {p}bq FROM (
  SELECT *, {up} AS {p}upstream, {down} AS {p}downstream, {sum_sql(cigar, 'HSMIX=')} AS {p}seq_length, {sum_sql(cigar, 'MX=')} AS {p}match_length, {sum_sql(cigar, 'MNDX=')} AS {p}match_length_s, {count_sql(cigar, 'M=')} AS {p}nmatch,
   CAST(100.0 * (CASE WHEN {count_sql(cigar, 'M')} > 0 THEN {sum_sql(cigar, 'M')} ELSE {sum_sql(cigar, '=')} END - {nm}) / nullif({sum_sql(cigar, 'MDIX=')} - {count_sql(cigar, 'DI')}, 0) AS FLOAT)::DOUBLE AS {p}sim FROM {source}))"""


@query("cigar_eval", f"""SELECT cigar, nm, start, strand, fp_target, upstream, downstream, round(sim, 3) AS similarity, seq_length, match_length, match_length_s, fp_query, aln_end FROM ({evaluated_sql("(" + CIGARS + ")", "cigar", "nm", "start", "strand")}) WHERE fp_target IS NOT NULL""")
def cigar_eval(spark, d):
    df = table(spark, d, CIGARS, "lineitem")
    df = cg.evaluated(df, "e", F.col("cigar"), F.col("nm"), F.col("start"), F.col("strand")).where("e IS NOT NULL")
    kept = ["fp_target", "upstream", "downstream", "seq_length", "match_length", "match_length_s", "fp_query", "aln_end"]
    return df.select("cigar", "nm", "start", "strand", *[F.col(f"e.{c}").alias(c) for c in kept], F.round(F.col("e.similarity").cast("double"), 3).alias("similarity"))


@query("cigar_similarity", f"""SELECT cigar, nm, round(sim, 3) AS similarity FROM ({evaluated_sql("(" + CIGARS + ")", "cigar", "nm", "start", "strand")})""")
def cigar_similarity(spark, d):
    df = table(spark, d, CIGARS, "lineitem")
    m, x = cg.op_sum(F.col("cigar"), "M"), cg.op_sum(F.col("cigar"), "X")
    matches = F.when(cg.op_count(F.col("cigar"), "M") > 0, m).otherwise(cg.op_sum(F.col("cigar"), "=")) + x
    return df.select("cigar", "nm", F.round(cg.similarity(F.col("cigar"), matches, F.col("nm") + x).cast("double"), 3).alias("similarity"))


FIXED = f"""SELECT *, CASE WHEN {sum_sql('f', 'HSMIX=')} > limit_ THEN regexp_replace(f, '[0-9]+H$', '') ELSE f END AS fixed FROM (
 SELECT *, CASE WHEN regexp_matches(cigar, '\\d+D\\d+[HS]$') THEN concat(regexp_extract(cigar, '^(.*?)(\\d+)D(\\d+)([HS])$', 1), CAST(CAST(regexp_extract(cigar, '^(.*?)(\\d+)D(\\d+)([HS])$', 2) AS BIGINT) + CAST(regexp_extract(cigar, '^(.*?)(\\d+)D(\\d+)([HS])$', 3) AS BIGINT) AS VARCHAR), regexp_extract(cigar, '^(.*?)(\\d+)D(\\d+)([HS])$', 4))
  WHEN regexp_matches(cigar, '\\d+D$') THEN regexp_replace(cigar, 'D$', 'H') ELSE cigar END AS f FROM (SELECT DISTINCT cigar, CAST(60 AS BIGINT) AS limit_ FROM ({CIGARS})))"""


@query("cigar_fix", f"SELECT cigar, fixed FROM ({FIXED})")
def cigar_fix(spark, d):
    return table(spark, d, CIGARS, "lineitem").select("cigar").distinct().select("cigar", cg.repair(F.col("cigar"), F.lit(60).cast("long")).alias("fixed"))


GEOMETRY = "SELECT DISTINCT CAST(l_partkey % 40 AS BIGINT) AS clip5, CAST(l_suppkey % 40 AS BIGINT) AS clip3, CAST(l_quantity AS BIGINT) + 80 AS slength, CAST(l_quantity AS BIGINT) * 3 AS spliced, l_orderkey % 1000 AS start, CASE WHEN l_linestatus = 'O' THEN '-' ELSE '+' END AS strand FROM lineitem"


@query("breakpoint_geometry", f"""SELECT * FROM (SELECT *, CASE WHEN start + slength > clip5 + clip3 THEN CASE WHEN (clip5 <> 0 AND clip3 = 0) OR (clip5 > clip3 AND clip3 / clip5 < 0.5) THEN start WHEN (clip3 <> 0 AND clip5 = 0) OR (clip3 > clip5 AND clip5 / clip3 < 0.5) THEN start + spliced - 1 END END AS break_target,
 CASE WHEN strand = '+' AND clip5 > clip3 THEN clip5 WHEN strand = '+' AND clip5 < clip3 THEN slength - clip3 - 1 WHEN strand = '-' AND clip5 > clip3 THEN slength - clip5 - 1 WHEN strand = '-' AND clip5 < clip3 THEN clip3 END AS break_query FROM ({GEOMETRY})) WHERE break_target IS NOT NULL AND break_query IS NOT NULL""")
def breakpoint_geometry(spark, d):
    df = table(spark, d, GEOMETRY, "lineitem")
    df = df.withColumn("g", cg.geometry(*[F.col(c) for c in ("clip5", "clip3", "slength", "spliced", "start", "strand")], 0.5)).where("g IS NOT NULL")
    return df.select("clip5", "clip3", "slength", "spliced", "start", "strand", F.col("g.break_target").alias("break_target"), F.col("g.break_query").alias("break_query"))


# --- split alignments from orders: two records for each order, which name each other in their SA tags

CLIP = "(40 + o_custkey % 60)"
NOISE = "(o_orderkey % 4)"
RECORDS = f"""SELECT o_orderkey * 2 AS rec_idx, concat('r', CAST(o_orderkey AS STRING)) AS qname, CASE WHEN o_orderstatus = 'F' THEN 16 ELSE 0 END + CASE WHEN o_orderkey % 50 = 0 THEN 256 ELSE 0 END AS flag, concat('c', CAST(o_custkey % 3 AS STRING)) AS rname, (o_custkey * 371) % 2000000 AS pos, CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE 60 END AS mapq,
  concat(CAST({CLIP} AS STRING), 'S', CAST(150 - {CLIP} AS STRING), 'M') AS cigar, concat('c', CAST((o_custkey + o_orderkey % 2) % 3 AS STRING), ',', CAST((o_custkey * 533) % 2000000 + 1 AS STRING), ',', CASE WHEN o_orderpriority < '3' THEN '-' ELSE '+' END, ',', CAST({CLIP} + {NOISE} AS STRING), 'M', CAST(150 - {CLIP} - {NOISE} AS STRING), 'S,60,1;') AS sa, o_orderkey % 3 AS nm FROM orders
 UNION ALL SELECT o_orderkey * 2 + 1, concat('r', CAST(o_orderkey AS STRING)), CASE WHEN o_orderpriority < '3' THEN 16 ELSE 0 END, concat('c', CAST((o_custkey + o_orderkey % 2) % 3 AS STRING)), (o_custkey * 533) % 2000000, 60,
  concat(CAST({CLIP} + {NOISE} AS STRING), 'M', CAST(150 - {CLIP} - {NOISE} AS STRING), 'S'), concat('c', CAST(o_custkey % 3 AS STRING), ',', CAST((o_custkey * 371) % 2000000 + 1 AS STRING), ',', CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END, ',', CAST({CLIP} AS STRING), 'S', CAST(150 - {CLIP} AS STRING), 'M,60,0;', CASE WHEN o_orderkey % 5 = 0 THEN concat('c9,', CAST(o_custkey AS STRING), ',+,', CAST({CLIP} AS STRING), 'S', CAST(150 - {CLIP} AS STRING), 'M,60,0;') ELSE '' END), 0 FROM orders"""
ALIGNED = f"SELECT *, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand FROM ({RECORDS}) WHERE flag & 261 = 0 AND mapq > 0"
PR = f"SELECT * FROM ({evaluated_sql('(' + ALIGNED + ')', 'cigar', 'nm', 'pos', 'strand')}) WHERE fp_target IS NOT NULL AND sim >= 98.0"
ELEMENTS = f"SELECT *, sa_idx - 1 AS i, split_part(e, ',', 1) AS x_chrom, CAST(split_part(e, ',', 2) AS BIGINT) - 1 AS x_start, split_part(e, ',', 3) AS x_strand, split_part(e, ',', 4) AS x_cigar, CAST(split_part(e, ',', 6) AS BIGINT) AS x_nm FROM (SELECT *, unnest(list_filter(string_split(sa, ';'), lambda x: x <> '')) AS e, generate_subscripts(list_filter(string_split(sa, ';'), lambda x: x <> ''), 1) AS sa_idx FROM ({PR}))"
BOTH = f"SELECT * FROM ({evaluated_sql('(' + ELEMENTS + ')', 'x_cigar', 'x_nm', 'x_start', 'x_strand', 's_')}) WHERE s_fp_target IS NOT NULL"
EVIDENCE = f"""SELECT rec_idx, i AS sa_idx, qname AS query_name, seq_length AS query_length, cigar AS cigar_pr, x_cigar AS cigar_sa, rname AS chrom_pr, x_chrom AS chrom_sa, CASE WHEN pu THEN fp_target WHEN strand = '+' THEN pos ELSE aln_end END AS target_break_pr, CASE WHEN su THEN CASE WHEN x_strand = '+' THEN s_aln_end ELSE x_start END ELSE s_fp_target END AS target_break_sa,
 fp_query AS query_break_pr, s_fp_query AS query_break_sa, strand AS strand_pr, x_strand AS strand_sa, pu AS up_pr, su AS up_sa, pos AS aln_start_pr, x_start AS aln_start_sa FROM (
 SELECT *, (u > w AND strand = '+') OR (u < w AND strand = '-') AS pu, (su_ > sd_ AND x_strand = '+') OR (su_ < sd_ AND x_strand = '-') AS su FROM (SELECT *, abs(upstream - s_match_length) AS u, abs(downstream - s_match_length) AS w, abs(s_upstream - match_length) AS su_, abs(s_downstream - match_length) AS sd_ FROM ({BOTH})) WHERE u <> w AND su_ <> sd_) WHERE pu <> su"""


def records_of(spark, d) -> DataFrame:
    return table(spark, d, RECORDS, "orders")


def evidence_of(spark, d) -> DataFrame:
    return evidence.oriented_evidence(evidence.split_pairs(evidence.passing(records_of(spark, d), "fragment"), 98.0))


@query("fragment_filter", f"SELECT rec_idx, qname FROM ({RECORDS}) WHERE flag & 261 = 0 AND mapq > 0 AND qname NOT IN (SELECT concat('r', CAST(c_custkey * 3 AS STRING)) FROM customer)")
def fragment_filter(spark, d):
    black = table(spark, d, "SELECT concat('r', CAST(c_custkey * 3 AS STRING)) AS id FROM customer", "customer")
    return evidence.passing(records_of(spark, d), "fragment", blacklist=black).select("rec_idx", "qname")


@query("sa_explode", f"SELECT rec_idx, i AS sa_idx, x_chrom, x_start, x_strand, x_cigar, x_nm FROM ({ELEMENTS})")
def sa_explode(spark, d):
    rows = evidence.passing(records_of(spark, d), "fragment")
    rows = cg.evaluated(rows, "pr", F.col("cigar"), F.col("nm"), F.col("pos"), evidence.strand_of(F.col("flag"))).where("pr IS NOT NULL AND pr.similarity >= 98.0")
    rows = rows.select("rec_idx", F.posexplode(cg.supplementary(F.col("sa"))).alias("sa_idx", "x"))
    return rows.select("rec_idx", "sa_idx", F.col("x.chrom").alias("x_chrom"), F.col("x.start").alias("x_start"), F.col("x.strand").alias("x_strand"), F.col("x.cigar").alias("x_cigar"), F.col("x.nm").alias("x_nm"))


@query("evidence_orientation", EVIDENCE)
def evidence_orientation(spark, d):
    return evidence_of(spark, d)


SIDES = ["chrom", "target_break", "query_break", "strand", "up", "aln_start"]
PRUNED = f"""WITH e AS ({EVIDENCE}), m AS (
 SELECT a.query_name, a.rec_idx, a.sa_idx, a.query_length, a.cigar_pr, b.cigar_pr AS cigar_sa, {', '.join(f'a.{c}_pr' for c in SIDES)}, {', '.join(f'b.{c}_pr AS {c}_sa' for c in SIDES)}, abs(a.query_break_pr - b.query_break_pr) // 2 AS precision, 1 AS support
  FROM e a JOIN e b ON a.query_name = b.query_name AND a.chrom_pr = b.chrom_sa AND a.chrom_sa = b.chrom_pr AND a.cigar_pr <> b.cigar_pr AND a.rec_idx < b.rec_idx
 UNION ALL SELECT query_name, rec_idx, sa_idx, query_length, cigar_pr, cigar_sa, {', '.join(f'{c}_pr' for c in SIDES)}, {', '.join(f'{c}_sa' for c in SIDES)}, NULL, 0
  FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE a.query_name = b.query_name AND a.chrom_pr = b.chrom_sa AND a.chrom_sa = b.chrom_pr AND a.cigar_pr <> b.cigar_pr)),
 k AS (SELECT * FROM (SELECT *, min(precision) OVER (PARTITION BY query_name) AS best FROM m) WHERE precision IS NULL OR precision <= best),
 pruned AS (SELECT * EXCLUDE (n, best) FROM (SELECT *, row_number() OVER (PARTITION BY query_name, least(cigar_pr, cigar_sa), greatest(cigar_pr, cigar_sa) ORDER BY rec_idx, sa_idx, precision NULLS LAST, cigar_sa, target_break_sa) AS n FROM k) WHERE n = 1)"""


@query("evidence_prune", f"{PRUNED} SELECT * REPLACE (CAST(coalesce(precision, -1) AS BIGINT) AS precision, CAST(support AS BIGINT) AS support) FROM pruned")
def evidence_prune(spark, d):
    return evidence.pruned(evidence_of(spark, d)).withColumn("precision", F.coalesce("precision", F.lit(-1)))


CALLED = """laid AS (SELECT *, CASE WHEN up_pr THEN chrom_pr ELSE chrom_sa END AS a_chrom, CASE WHEN up_pr THEN ps ELSE ss END AS a_start, CASE WHEN up_pr THEN pe ELSE se END AS a_end, CASE WHEN up_pr THEN strand_pr ELSE strand_sa END AS a_strand,
 CASE WHEN up_pr THEN chrom_sa ELSE chrom_pr END AS b_chrom, CASE WHEN up_pr THEN ss ELSE ps END AS b_start, CASE WHEN up_pr THEN se ELSE pe END AS b_end, CASE WHEN up_pr THEN strand_sa ELSE strand_pr END AS b_strand
 FROM (SELECT *, least(aln_start_pr, target_break_pr) AS ps, greatest(aln_start_pr, target_break_pr) AS pe, least(aln_start_sa, target_break_sa) AS ss, greatest(aln_start_sa, target_break_sa) AS se FROM pruned)),
 calls AS (SELECT query_name, query_length AS length, (query_break_pr + query_break_sa) // 2 AS fusion_point, concat(chrom_sa, '--', chrom_pr) AS genes, CAST(precision AS BIGINT) AS fp_fuzzy, CAST(support AS BIGINT) AS support, CASE WHEN a_chrom = b_chrom THEN greatest(a_start, b_start) - least(a_end, b_end) END AS fusion_distance,
 a_chrom, a_start, a_end, CASE WHEN a_strand = '-' THEN a_start ELSE a_end END AS a_fp, a_strand, b_chrom, b_start, b_end, CASE WHEN b_strand = '-' THEN b_end ELSE b_start END AS b_fp, b_strand
 FROM laid WHERE a_chrom <> b_chrom OR greatest(a_start, b_start) - least(a_end, b_end) > 10000)"""


def calls_of(spark, d) -> DataFrame:
    return evidence.fragment_calls(evidence.pruned(evidence_of(spark, d)))


@query("fragment_calls", f"{PRUNED}, {CALLED} SELECT * REPLACE (coalesce(fp_fuzzy, -1) AS fp_fuzzy, coalesce(fusion_distance, -1) AS fusion_distance), CASE WHEN fp_fuzzy IS NULL OR fp_fuzzy > 10 THEN 'FAILED' ELSE '.' END AS filter FROM calls")
def fragment_calls(spark, d):
    calls = calls_of(spark, d).withColumn("filter", evidence.quality_flag(F.col("fp_fuzzy")))
    return calls.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("fp_fuzzy", "fusion_distance")})


@query("fusion_chroms", f"{PRUNED}, {CALLED} SELECT DISTINCT p_partkey FROM (SELECT p_partkey, concat('c', CAST(p_partkey % 7 AS STRING)) AS c FROM part) WHERE c IN (SELECT a_chrom FROM calls UNION SELECT b_chrom FROM calls)")
def fusion_chroms(spark, d):
    parts = table(spark, d, "SELECT p_partkey, concat('c', CAST(p_partkey % 7 AS STRING)) AS chrom FROM part", "part")
    return annotate.used_features(parts, calls_of(spark, d)).select("p_partkey")


# --- annotation: lineitem calls, part features

SPANS = "SELECT l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS span, l_suppkey % 7 AS chrom, (l_partkey * 9973 + l_orderkey * 31) % 1000000 AS s, (l_partkey * 9973 + l_orderkey * 31) % 1000000 + CAST(l_quantity AS BIGINT) * 20 AS e, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand FROM lineitem"
FEATURES = "SELECT p_partkey % 7 AS chrom, (p_partkey * 4999) % 1000000 AS f_start, (p_partkey * 4999) % 1000000 + p_size * 400 AS f_end, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS f_strand, p_brand AS name FROM part"
SCORE = "(CASE WHEN strand = f_strand THEN 10 ELSE 0 END + CASE WHEN s = f_start THEN 10 ELSE 1 END + CASE WHEN e = f_end THEN 10 WHEN e < f_end THEN 5 ELSE 1 END)"
NEAR = f"SELECT c.*, f.* EXCLUDE (chrom), least(e, f_end) - greatest(s, f_start) AS match_length, {SCORE} AS score FROM ({SPANS}) c JOIN ({FEATURES}) f ON c.chrom = f.chrom AND s < f_end AND f_start < e"


def spans_of(spark, d):
    return table(spark, d, SPANS, "lineitem"), table(spark, d, FEATURES, "part")


@query("annot_overlap_score", f"SELECT chrom, name, count(*) AS n, CAST(sum(match_length) AS BIGINT) AS match_length, CAST(sum(score) AS BIGINT) AS score FROM ({NEAR}) GROUP BY chrom, name")
def annot_overlap_score(spark, d):
    return annotate.overlap_totals(*spans_of(spark, d), True)


@query("annot_best_gene", f"SELECT span, string_agg(DISTINCT name, ';' ORDER BY name) AS names FROM (SELECT span, name, score, max(score) OVER (PARTITION BY span) AS top FROM ({NEAR})) WHERE score = top GROUP BY span")
def annot_best_gene(spark, d):
    return annotate.best_features(*spans_of(spark, d), True).select("span", F.array_join("names", ";").alias("names"))


@query("annotated_calls", f"""{PRUNED}, {CALLED}, f AS (SELECT concat('c', CAST(chrom AS STRING)) AS chrom, f_start * 2 AS f_start, f_end * 2 AS f_end, f_strand, name FROM ({FEATURES})),
 ra AS (SELECT query_name, fp_fuzzy, fusion_point, a_fp, name, (CASE WHEN a_start = f_start THEN 10 ELSE 1 END + CASE WHEN a_end = f_end THEN 10 WHEN a_end < f_end THEN 5 ELSE 1 END) AS score FROM calls JOIN f ON chrom = a_chrom AND a_start < f_end AND f_start < a_end),
 rb AS (SELECT query_name, fp_fuzzy, fusion_point, a_fp, name, (CASE WHEN b_start = f_start THEN 10 ELSE 1 END + CASE WHEN b_end = f_end THEN 10 WHEN b_end < f_end THEN 5 ELSE 1 END) AS score FROM calls JOIN f ON chrom = b_chrom AND b_start < f_end AND f_start < b_end),
 na AS (SELECT DISTINCT query_name, fusion_point, a_fp, name FROM (SELECT *, max(score) OVER (PARTITION BY query_name, fusion_point, a_fp) AS top FROM ra) WHERE score = top),
 nb AS (SELECT DISTINCT query_name, fusion_point, a_fp, name FROM (SELECT *, max(score) OVER (PARTITION BY query_name, fusion_point, a_fp) AS top FROM rb) WHERE score = top)
 SELECT query_name, fusion_point, a_fp, string_agg(concat(coalesce(na.name, 'NA'), '--', coalesce(nb.name, 'NA')), ';' ORDER BY coalesce(na.name, 'NA'), coalesce(nb.name, 'NA')) AS fusion_genes FROM calls LEFT JOIN na USING (query_name, fusion_point, a_fp) LEFT JOIN nb USING (query_name, fusion_point, a_fp) GROUP BY query_name, fusion_point, a_fp""")
def annotated_calls(spark, d):
    _, features = spans_of(spark, d)
    features = features.select(F.concat(F.lit("c"), F.col("chrom").cast("string")).alias("chrom"), (F.col("f_start") * 2).alias("f_start"), (F.col("f_end") * 2).alias("f_end"), "f_strand", "name")
    calls = calls_of(spark, d).withColumn("call", F.concat_ws("|", "query_name", "fusion_point", "a_fp"))
    return annotate.annotated(calls, features).select("query_name", "fusion_point", "a_fp", F.array_join("fusion_genes", ";").alias("fusion_genes"))


ATTRIBUTES = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS n1, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS n2, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS n3 FROM part"


@query("gene_name_fallback", f"SELECT p_partkey, coalesce(n1, n2, n3, 'NA') AS gene FROM ({ATTRIBUTES})")
def gene_name_fallback(spark, d):
    rows = table(spark, d, ATTRIBUTES, "part")
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("gene_name", "n1"), ("geneID", "n2"), ("gene_id", "n3"))]), lambda x: x["value"].isNotNull())
    return rows.select("p_partkey", annotate.gene_name(F.map_from_entries(pairs)).alias("gene"))


# --- ALT strings from orders

ALTS = "SELECT id, chr1, st1, f1, chr2, st2, f2, CASE WHEN f1 = '+' THEN concat('G', b, chr2, ':', CAST(st2 + 1 AS STRING), b) ELSE concat(b, chr2, ':', CAST(st2 + 1 AS STRING), b, 'G') END AS alt FROM (SELECT *, CASE WHEN f2 = '+' THEN ']' ELSE '[' END AS b FROM (" + PAIRS + ") AS h) AS g"


@query("bnd_alt_parse", f"SELECT id, 'G' AS nucleotide, chr2 AS chr, st2 AS pos, f1 AS dir1, f2 AS dir2 FROM ({ALTS})")
def bnd_alt_parse(spark, d):
    return table(spark, d, ALTS, "orders").select("id", bnd.parse_alt(F.col("alt")).alias("x")).select("id", "x.*")


@query("bnd_alt_format", f"SELECT id, alt FROM ({ALTS})")
def bnd_alt_format(spark, d):
    return pairs_of(spark, d).select("id", bnd.format_alt(F.lit("G"), F.col("chr2"), F.col("st2"), F.col("f1"), F.col("f2")).alias("alt"))


@query("bnd_fix_mate_dir", f"SELECT id, CASE WHEN f1 = '+' THEN concat('G', b, chr2, ':', CAST(st2 + 1 AS STRING), b) ELSE concat(b, chr2, ':', CAST(st2 + 1 AS STRING), b, 'G') END AS alt FROM (SELECT *, CASE WHEN f2 = '+' THEN ']' ELSE '[' END AS b FROM ({PAIRS})) UNION ALL SELECT mid, CASE WHEN f2 = '+' THEN concat('C', b, chr1, ':', CAST(st1 + 1 AS STRING), b) ELSE concat(b, chr1, ':', CAST(st1 + 1 AS STRING), b, 'C') END FROM (SELECT *, CASE WHEN f1 = '+' THEN ']' ELSE '[' END AS b FROM ({PAIRS}))")
def bnd_fix_mate_dir(spark, d):
    from .programs import corrected_mates

    p = pairs_of(spark, d)
    wrong = F.lit("+")  # every record says that its mate is forward
    rows = p.select("id", F.col("mid").alias("mate_id"), bnd.format_alt(F.lit("G"), F.col("chr2"), F.col("st2"), F.col("f1"), wrong).alias("alt")).unionByName(p.select(F.col("mid").alias("id"), F.col("id").alias("mate_id"), bnd.format_alt(F.lit("C"), F.col("chr1"), F.col("st1"), F.col("f2"), wrong).alias("alt")))
    return corrected_mates(rows).select("id", "alt")


@query("natural_sort_key", "SELECT o_orderkey, concat('v', lpad(CAST(o_orderkey AS VARCHAR), 20, '0'), '_x', lpad(CAST(o_custkey AS VARCHAR), 20, '0')) AS key FROM orders")
def natural_sort_key(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", bnd.natural_key(F.concat(F.lit("v"), F.col("o_orderkey").cast("string"), F.lit("_x"), F.col("o_custkey").cast("string"))).alias("key"))


@query("pair_key", "SELECT o_orderkey, regexp_replace(concat('id_', CAST(o_orderkey AS VARCHAR)), '[12]+$', '') AS key FROM orders")
def pair_key(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", bnd.pair_key(F.concat(F.lit("id_"), F.col("o_orderkey").cast("string"))).alias("key"))


# --- subsets: orders against region pairs from supplier

REGIONS = "SELECT CAST(s_suppkey % 3 AS STRING) AS rchr1, (s_suppkey * 9001) % 150000 AS s1, (s_suppkey * 9001) % 150000 + 60000 AS e1, CASE s_suppkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS strand1, CAST((s_suppkey + 1 + s_suppkey % 2) % 3 AS STRING) AS rchr2, (s_suppkey * 7001) % 150000 AS s2, (s_suppkey * 7001) % 150000 + 50000 AS e2, CASE s_suppkey % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS strand2, s_nationkey AS score FROM supplier"


def subset_sql(score: int, negate: str) -> str:
    fit = lambda d, s: f"({s} = '.' OR {s} = {d})"
    def inside(a, b):  # noqa: E306
        return f"(p.chr1 = r.rchr{a} AND p.st1 >= r.s{a} AND p.st1 < r.e{a} AND p.chr2 = r.rchr{b} AND p.st2 >= r.s{b} AND p.st2 < r.e{b})"
    turned = f"(({fit('p.f1', 'r.strand1')} AND {fit('p.f2', 'r.strand2')}) OR ({fit('p.f1', 'r.strand2')} AND {fit('p.f2', 'r.strand1')}))"
    return f"SELECT p.id FROM ({PAIRS}) p WHERE {negate} EXISTS (SELECT 1 FROM ({REGIONS}) r WHERE r.score >= {score} AND ({inside(1, 2)} OR {inside(2, 1)}) AND {turned})"


def subset_of(spark, d, **options):
    p = pairs_of(spark, d).withColumnsRenamed({"st1": "pos1", "st2": "pos2"})
    return subset.by_region_pairs(p, table(spark, d, REGIONS, "supplier"), **options).select("id")


@query("bedpe_subset", subset_sql(-1, ""))
def bedpe_subset(spark, d):
    return subset_of(spark, d)


@query("bedpe_subset_inverse", subset_sql(-1, "NOT"))
def bedpe_subset_inverse(spark, d):
    return subset_of(spark, d, inverse=True)


@query("bedpe_score_filter", subset_sql(12, ""))
def bedpe_score_filter(spark, d):
    return subset_of(spark, d, min_score=12)


CHROM_RECORDS = f"SELECT id, chr1 AS chrom, CASE WHEN id % 10 = 0 THEN NULL ELSE mid END AS mate_id FROM ({PAIRS}) AS h"
CHROMS = "SELECT DISTINCT CAST(r_regionkey AS STRING) AS chrom FROM region WHERE r_regionkey < 2"
BOTH_RECORDS = f"SELECT id, CASE WHEN id % 3 = 0 THEN concat('x', chr1) ELSE chr1 END AS chrom, mid AS mate_id FROM ({PAIRS}) AS h UNION ALL SELECT mid, chr2, id FROM ({PAIRS}) AS g"


def chrom_sql(negate: str) -> str:
    return f"WITH v AS ({BOTH_RECORDS}), u AS (SELECT * FROM v WHERE chrom {negate} IN ({CHROMS})), g AS (SELECT id FROM u UNION SELECT mate_id FROM u) SELECT id, chrom FROM v WHERE id NOT IN (SELECT id FROM g)"


def chrom_of(spark, d, remove):
    return subset.by_chromosome(table(spark, d, BOTH_RECORDS, "orders"), table(spark, d, CHROMS, "region"), remove).select("id", "chrom")


@query("chrom_keep", chrom_sql("NOT"))
def chrom_keep(spark, d):
    return chrom_of(spark, d, False)


@query("chrom_remove_mate_aware", chrom_sql(""))
def chrom_remove_mate_aware(spark, d):
    return chrom_of(spark, d, True)


@query("blacklist_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def blacklist_anti(spark, d):
    black = table(spark, d, "SELECT l_orderkey AS id FROM lineitem WHERE l_quantity > 45", "lineitem")
    return subset.without_ids(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), "o_orderkey", black)


INFO = "SELECT o_orderkey, concat('SVTYPE=BND;FL=', CAST(o_custkey AS STRING), ';length=3;SR=', CAST(o_custkey % 7 AS STRING)) AS info FROM orders"


@query("info_scrub", "SELECT o_orderkey, concat('SR=', CAST(o_custkey % 7 AS VARCHAR), ';SVTYPE=BND') AS info FROM orders")
def info_scrub(spark, d):
    info = subset.scrub_info(F.expr("str_to_map(info, ';', '=')"))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(info), lambda x: F.concat_ws("=", x["key"], x["value"]))), ";")
    return table(spark, d, INFO, "orders").select("o_orderkey", text.alias("info"))


# --- merging: call sets A and B from orders

SET_A = f"SELECT id AS a_id, chr1 AS a_chr1, st1 AS a_fp1, chr2 AS a_chr2, st2 AS a_fp2, id % 3 = 0 AS a_failed FROM ({PAIRS}) AS h WHERE id % 4 = 0"
SET_B = f"SELECT id AS b_id, chr1 AS b_chr1, st1 AS b_fp1, chr2 AS b_chr2, st2 AS b_fp2, id % 5 = 0 AS b_failed, id AS b_idx, id % 50 + id % 13 AS sdp, id % 50 AS sp, id % 13 AS sr, CAST(id % 9 AS DOUBLE) / 8 AS fr FROM ({PAIRS}) AS h WHERE id % 4 <> 0"
MATCHES = f"WITH a AS ({SET_A}), b AS ({SET_B}), m AS (SELECT * FROM a JOIN b ON a_chr1 = b_chr1 AND a_chr2 = b_chr2 AND b_fp1 >= greatest(a_fp1 - 30, 0) AND b_fp1 < a_fp1 + 30 AND b_fp2 >= greatest(a_fp2 - 30, 0) AND b_fp2 < a_fp2 + 30), best AS (SELECT a_id, arg_max(b_id, (sr, b_idx)) AS topread, arg_max(sdp, (sr, b_idx)) AS sdp, arg_max(sp, (sr, b_idx)) AS sp, arg_max(sr, (sr, b_idx)) AS sr, arg_max(fr, (sr, b_idx)) AS fr, arg_max(b_failed, b_idx) AS last_failed, count(*) AS n_b FROM m GROUP BY a_id)"


def sets_of(spark, d):
    return table(spark, d, SET_A, "orders"), table(spark, d, SET_B, "orders")


@query("merge_best_b", f"{MATCHES} SELECT * FROM best")
def merge_best_b(spark, d):
    return merge.best_partner(merge.near(*sets_of(spark, d), 30))


@query("bnd_merge_full", f"""{MATCHES} SELECT * REPLACE (coalesce(topread, -1) AS topread, coalesce(sdp, -1) AS sdp, coalesce(sp, -1) AS sp, coalesce(sr, -1) AS sr, coalesce(fr, -1) AS fr) FROM (SELECT 'A' AS source, a_id AS id, a_chr1 AS chr1, a_fp1 AS fp1, a_chr2 AS chr2, a_fp2 AS fp2, CASE WHEN topread IS NOT NULL THEN 'PASS' WHEN a_failed THEN 'FAILED' ELSE '.' END AS filter, topread, sdp, sp, sr, fr, CASE WHEN topread IS NOT NULL AND a_failed AND last_failed THEN 'MED' WHEN topread IS NOT NULL THEN 'HIGH' WHEN a_failed THEN 'LOW' ELSE 'MED' END AS evidence FROM a LEFT JOIN best USING (a_id)
 UNION ALL SELECT 'B', b_id, b_chr1, b_fp1, b_chr2, b_fp2, CASE WHEN b_failed THEN 'FAILED' ELSE '.' END, NULL, sdp, sp, sr, fr, CASE WHEN b_failed THEN 'LOW' ELSE 'MED' END FROM b WHERE b_id NOT IN (SELECT b_id FROM m))""")
def bnd_merge_full(spark, d):
    out = merge.merged(*sets_of(spark, d), 30)
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("topread", "sdp", "sp", "sr", "fr")})


@query("bnd_merge_simple_flag", f"{MATCHES} SELECT a_id, CAST(a_id IN (SELECT a_id FROM m) AS INTEGER) AS supported FROM a")
def bnd_merge_simple_flag(spark, d):
    return merge.supported(*sets_of(spark, d), 30).select("a_id", "supported")


# --- medians, precision, coverage

@query("upper_median", "SELECT l_suppkey, list_sort(list(l_partkey))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY l_suppkey")
def upper_median(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_suppkey").agg(stats.upper_median("l_partkey").alias("median"))


@query("precision_stddev", "SELECT o_custkey, CASE WHEN count(*) > 2 THEN CAST(round(stddev_samp(o_orderkey % 97)) AS BIGINT) ELSE -1 END AS precision FROM orders GROUP BY o_custkey")
def precision_stddev(spark, d):
    got = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.col("o_orderkey") % 97)).alias("x"))
    return got.select("o_custkey", F.coalesce(stats.precision(F.col("x")), F.lit(-1)).alias("precision"))


READS = "SELECT concat('q', CAST(l_orderkey AS STRING)) AS qname, CAST(l_suppkey % 3 AS STRING) AS chrom, (l_partkey * 9973 + l_orderkey * 31) % 400000 AS aln_start, (l_partkey * 9973 + l_orderkey * 31) % 400000 + CAST(l_quantity AS BIGINT) * 4 AS aln_end, CASE WHEN l_linenumber % 6 = 0 THEN 9 ELSE 1 END AS flag, CAST((l_suppkey + 1 + l_linenumber % 2) % 3 AS STRING) AS mate_rname FROM lineitem"
POSITIONS = f"SELECT id AS pos, chr1 AS chrom_pr, st1 * 2 AS target_break_pr, f1 AS strand_pr, id % 4 = 0 AS up_pr, chr2 AS chrom_sa, st2 * 2 AS target_break_sa, f2 AS strand_sa, id % 4 <> 0 AS up_sa FROM ({PAIRS}) AS h"
W_CTES = """w AS (SELECT pos, 'pr' AS side, chrom_pr AS chrom, chrom_sa AS other, CASE WHEN up_pr = (strand_pr = '+') THEN greatest(target_break_pr - 500, 0) ELSE target_break_pr END AS w_start, CASE WHEN up_pr = (strand_pr = '+') THEN target_break_pr ELSE target_break_pr + 500 END AS w_end FROM c
 UNION ALL SELECT pos, 'sa', chrom_sa, chrom_pr, CASE WHEN up_sa = (strand_sa = '+') THEN greatest(target_break_sa - 500, 0) ELSE target_break_sa END, CASE WHEN up_sa = (strand_sa = '+') THEN target_break_sa ELSE target_break_sa + 500 END FROM c),
 o AS (SELECT w.*, al.* EXCLUDE (chrom) FROM w JOIN al ON w.chrom = al.chrom AND w_start < aln_end AND aln_start < w_end WHERE w_start < w_end),
 sp AS (SELECT pos, count(*) AS support_sp FROM (SELECT pos, qname FROM o WHERE flag & 8 = 0 AND mate_rname = other GROUP BY pos, qname HAVING count(DISTINCT side) = 2) GROUP BY pos),
 dep AS (SELECT pos, side, list_sort(list(n))[count(*) // 2 + 1] AS depth FROM (SELECT pos, side, p, count(*) AS n FROM (SELECT pos, side, unnest(range(greatest(aln_start, w_start), least(aln_end, w_end))) AS p FROM o) GROUP BY pos, side, p) GROUP BY pos, side),
 ratios AS (SELECT c.pos, coalesce(support_sp, 0) AS support_sp, least(CASE WHEN coalesce(p.depth, 0) > 0 THEN coalesce(support_sp, 0) / p.depth ELSE 0.0 END, CASE WHEN coalesce(s.depth, 0) > 0 THEN coalesce(support_sp, 0) / s.depth ELSE 0.0 END) AS sp_ratio FROM c LEFT JOIN sp ON c.pos = sp.pos LEFT JOIN dep p ON p.pos = c.pos AND p.side = 'pr' LEFT JOIN dep s ON s.pos = c.pos AND s.side = 'sa')"""
WINDOWS = f"WITH c AS ({POSITIONS}), al AS ({READS}), {W_CTES}"


def reads_of(spark, d):
    return table(spark, d, POSITIONS, "orders"), table(spark, d, READS, "lineitem")


@query("sp_support", f"{WINDOWS} SELECT * FROM sp")
def sp_support(spark, d):
    spots, reads = reads_of(spark, d)
    return support.split_pair_support(spots, reads)


@query("coverage_median", f"{WINDOWS} SELECT * FROM dep")
def coverage_median(spark, d):
    spots, reads = reads_of(spark, d)
    return support.median_depth(support.windows(spots), reads)


@query("sp_ratio", f"{WINDOWS} SELECT pos, support_sp, round(sp_ratio, 6) AS sp_ratio FROM ratios")
def sp_ratio(spark, d):
    return support.with_support(*reads_of(spark, d)).select("pos", "support_sp", F.round("sp_ratio", 6).alias("sp_ratio"))


# the collapse row by row, as it is defined: the state is the list of positions found so far
JOINS = "(4 - (x.s1 <> t.strand_pr)::INT - (x.s2 <> t.strand_sa)::INT - (x.u1 <> t.up_pr)::INT - (x.u2 <> t.up_sa)::INT) IN (0, 4) AND abs(t.target_break_pr - list_sort(x.bp)[len(x.bp) // 2 + 1]) < 5 AND abs(t.target_break_sa - list_sort(x.bs)[len(x.bs) // 2 + 1]) < 5"
NEW = "{'s1': t.strand_pr, 's2': t.strand_sa, 'u1': t.up_pr, 'u2': t.up_sa, 'bp': [t.target_break_pr], 'bs': [t.target_break_sa], 'ap': [t.aln_start_pr], 'a_s': [t.aln_start_sa]}"
MORE = "{'s1': x.s1, 's2': x.s2, 'u1': x.u1, 'u2': x.u2, 'bp': list_append(x.bp, t.target_break_pr), 'bs': list_append(x.bs, t.target_break_sa), 'ap': list_append(x.ap, t.aln_start_pr), 'a_s': list_append(x.a_s, t.aln_start_sa)}"
COLLAPSE = f"""{PRUNED.replace("WITH e AS", "WITH RECURSIVE e AS", 1)},
 turn AS (SELECT *, row_number() OVER (PARTITION BY chrom_pr, chrom_sa ORDER BY rec_idx, sa_idx, target_break_pr, target_break_sa) AS i FROM pruned),
 walk(chrom_pr, chrom_sa, i, found) USING KEY (chrom_pr, chrom_sa) AS (SELECT chrom_pr, chrom_sa, i, [{NEW}] FROM turn t WHERE i = 1
  UNION SELECT w.chrom_pr, w.chrom_sa, t.i, CASE WHEN len(list_filter(w.found, lambda x: {JOINS})) > 0 THEN list_transform(w.found, lambda x: CASE WHEN {JOINS} THEN {MORE} ELSE x END) ELSE list_append(w.found, {NEW}) END FROM walk w JOIN turn t ON t.chrom_pr = w.chrom_pr AND t.chrom_sa = w.chrom_sa AND t.i = w.i + 1),
 c AS (SELECT row_number() OVER () AS pos, chrom_pr, chrom_sa, list_sort(x.bp)[len(x.bp) // 2 + 1] AS target_break_pr, list_sort(x.bs)[len(x.bs) // 2 + 1] AS target_break_sa, x.s1 AS strand_pr, x.s2 AS strand_sa, x.u1 AS up_pr, x.u2 AS up_sa, CAST(len(x.bp) AS BIGINT) AS support_sr, list_sort(x.ap)[len(x.ap) // 2 + 1] AS aln_start_pr, list_sort(x.a_s)[len(x.a_s) // 2 + 1] AS aln_start_sa, x.bp AS bp, x.bs AS bs
  FROM (SELECT chrom_pr, chrom_sa, unnest(found) AS x FROM walk))"""


@query("sr_collapse", f"{COLLAPSE} SELECT chrom_pr, chrom_sa, target_break_pr, target_break_sa, strand_pr, strand_sa, support_sr FROM c")
def sr_collapse(spark, d):
    got = support.collapsed(evidence.pruned(evidence_of(spark, d)), 5)
    return got.select("chrom_pr", "chrom_sa", "target_break_pr", "target_break_sa", "strand_pr", "strand_sa", "support_sr")


SPREAD = "list_concat(list_transform(bp, lambda y: abs(y - target_break_pr)), list_transform(bs, lambda y: abs(y - target_break_sa)))"
POSITION_CALLS = f"""{COLLAPSE}, al AS (SELECT * REPLACE (concat('c', chrom) AS chrom, concat('c', mate_rname) AS mate_rname) FROM ({READS})), {W_CTES},
 flat AS (SELECT c.*, support_sp, sp_ratio, CASE WHEN len({SPREAD}) > 2 THEN CAST(round(list_aggregate(list_transform({SPREAD}, lambda y: CAST(y AS DOUBLE)), 'stddev_samp')) AS BIGINT) END AS precision FROM c JOIN ratios USING (pos)),
 laid AS ({CALLED[CALLED.index("SELECT *, CASE WHEN up_pr THEN chrom_pr"):CALLED.index("FROM pruned)),")]}FROM flat)),
 called AS (SELECT CASE WHEN up_pr THEN 'NA--NA' ELSE concat(chrom_sa, '--', chrom_pr) END AS genes, precision AS fp_fuzzy, support_sr, support_sp, sp_ratio, CASE WHEN a_chrom = b_chrom THEN greatest(a_start, b_start) - least(a_end, b_end) END AS fusion_distance, a_chrom, a_start, a_end, CASE WHEN a_strand = '-' THEN a_start ELSE a_end END AS a_fp, a_strand, b_chrom, b_start, b_end, CASE WHEN b_strand = '-' THEN b_end ELSE b_start END AS b_fp, b_strand
  FROM laid WHERE a_chrom <> b_chrom OR greatest(a_start, b_start) - least(a_end, b_end) > 10000)
 SELECT * REPLACE (coalesce(fp_fuzzy, -1) AS fp_fuzzy, coalesce(fusion_distance, -1) AS fusion_distance, round(sp_ratio, 6) AS sp_ratio), CASE WHEN fp_fuzzy IS NULL OR fp_fuzzy > 10 OR support_sr + support_sp = 1 OR sp_ratio < 0.1 THEN 'FAILED' ELSE '.' END AS filter FROM called"""


@query("position_calls", POSITION_CALLS)
def position_calls(spark, d):
    positions = support.collapsed(evidence.pruned(evidence_of(spark, d)), 5)
    _, reads = reads_of(spark, d)
    reads = reads.withColumns({"chrom": F.concat(F.lit("c"), "chrom"), "mate_rname": F.concat(F.lit("c"), "mate_rname")})
    calls = evidence.position_calls(support.with_support(positions, reads))
    calls = calls.withColumn("filter", evidence.quality_flag(F.col("fp_fuzzy"), F.col("support_sr") + F.col("support_sp"), F.col("sp_ratio")))
    return calls.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("fp_fuzzy", "fusion_distance")} | {"sp_ratio": F.round("sp_ratio", 6)})


# --- sequences, integration sites, linking reads

@query("revcomp", "SELECT doc_id, reverse(translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), 'ACGTacgt', 'TGCAtgca')) AS seq FROM documents")
def revcomp(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", sequence.reverse_complement(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))


CONTIGS = "SELECT CAST(doc_id AS STRING) AS contig, regexp_replace(text, '[^A-Za-z]', '') AS seq FROM documents"
JUNCTIONS = "SELECT concat('j', CAST(doc_id AS STRING), '.1') AS id1, concat('j', CAST(doc_id AS STRING), '.2') AS id2, CAST(doc_id AS STRING) AS chr1, 40 + n_chars % 50 AS p1, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS d1, CAST(doc_id - 1 AS STRING) AS chr2, 30 + n_chars % 70 AS p2, CASE WHEN doc_id % 3 = 0 THEN '+' ELSE '-' END AS d2 FROM documents WHERE doc_id > 0"


def part_sql(seq: str, start: str, end: str, turn: str) -> str:
    got = f"substring({seq}, CAST({start} AS BIGINT) + 1, CAST({end} - ({start}) AS BIGINT))"
    return f"CASE WHEN {turn} THEN reverse(translate({got}, 'ACGTacgt', 'TGCAtgca')) ELSE {got} END"


@query("junction_sequence", f"""WITH c AS ({CONTIGS.replace("'[^A-Za-z]', ''", "'[^A-Za-z]', '', 'g'")}), j AS ({JUNCTIONS}) SELECT id1, id2, concat(upper({part_sql('a.seq', "(CASE WHEN d1 = '+' THEN greatest(p1 - 60, 0) + 1 ELSE p1 END)", "(CASE WHEN d1 = '+' THEN p1 + 1 ELSE p1 + 60 END)", "d1 = '-'")}), lower({part_sql('b.seq', "(CASE WHEN d2 = '-' THEN greatest(p2 - 60, 0) + 1 ELSE p2 END)", "(CASE WHEN d2 = '-' THEN p2 + 1 ELSE p2 + 60 END)", "d2 = '-'")})) AS sequence
 FROM j JOIN c a ON a.contig = chr1 JOIN c b ON b.contig = chr2 WHERE length(a.seq) > CASE WHEN d1 = '+' THEN greatest(p1 - 60, 0) + 1 ELSE p1 END AND length(b.seq) > CASE WHEN d2 = '-' THEN greatest(p2 - 60, 0) + 1 ELSE p2 END""")
def junction_sequence(spark, d):
    contigs = table(spark, d, CONTIGS, "documents")
    pieces = contigs.select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.length("seq") / 64))).alias("k"), "seq").select("contig", (F.col("k") * 64).cast("long").alias("offset"), (F.col("k") * 64 + 64).cast("long").alias("offset_end"), F.expr("substring(seq, CAST(k * 64 + 1 AS INT), 64)").alias("seq")).where("seq <> ''")
    pieces = pieces.withColumn("offset_end", F.col("offset") + F.length("seq"))
    return integrate.junction_sequences(table(spark, d, JUNCTIONS, "documents"), pieces, 60)


LINES = "SELECT o_orderkey * 2 AS rec_idx, concat('r', CAST(o_orderkey AS STRING)) AS read, o_custkey % 3 AS start, 1000 + o_custkey % 9 AS end, CASE WHEN o_orderkey % 2 = 0 THEN 'human' ELSE 'virus' END AS label, CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END AS strand, CASE WHEN o_orderkey % 2 = 0 THEN concat('chr', CAST(o_custkey % 5 AS STRING), '@', CAST(o_custkey AS STRING), '-', CAST(o_custkey + 1000 AS STRING)) ELSE '.' END AS target FROM orders UNION ALL SELECT o_orderkey * 2 + 1, concat('r', CAST(o_orderkey AS STRING)), 995 + o_custkey % 9, 3000, CASE WHEN o_orderkey % 2 = 0 THEN 'virus' ELSE 'human' END, CASE WHEN o_orderpriority < '3' THEN '-' ELSE '+' END, CASE WHEN o_orderkey % 2 = 0 THEN '.' ELSE concat('chr', CAST(o_custkey % 5 AS STRING), '@', CAST(o_custkey AS STRING), '-', CAST(o_custkey + 1000 AS STRING)) END FROM orders"


@query("integration_site", """WITH o AS (SELECT *, o_orderkey % 2 = 0 AS hf, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END ELSE CASE WHEN o_orderpriority < '3' THEN '-' ELSE '+' END END AS strand FROM orders WHERE 995 + o_custkey % 9 + 2 >= 1000 + o_custkey % 9)
 SELECT concat('r', CAST(o_orderkey AS VARCHAR)) AS read, concat('chr', CAST(o_custkey % 5 AS VARCHAR)) AS chrom, CASE WHEN hf = (strand = '+') THEN o_custkey + 1000 ELSE o_custkey END AS site, CASE WHEN hf = (strand = '+') THEN '+' ELSE '-' END AS direction FROM o
 UNION ALL SELECT 'none', 'none', 0, '+' WHERE false""".replace("995 + o_custkey % 9 + 2 >=", "995 + o_custkey % 9 + 6 >="))
def integration_site(spark, d):
    return integrate.integration_sites(table(spark, d, LINES, "orders"), "human", "virus", 6).select("read", "chrom", "site", "direction")


TRANSCRIPTS = "SELECT concat('q', CAST(o_orderkey AS STRING)) AS qname, CASE WHEN o_orderkey % 7 = 0 THEN 9 ELSE 1 END AS flag, concat('CHS.', CAST(o_custkey % 50 AS STRING), '.1') AS rname, concat('CHS.', CAST((o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 50 AS STRING), '.2') AS mate_rname, CASE WHEN o_orderkey % 3 = 0 THEN concat('CHS.', CAST((o_custkey + o_orderkey % 2) % 50 AS STRING), '.3,10,+,50S100M,60,', CAST(o_orderkey % 4 AS STRING), ';') END AS sa FROM orders"


@query("fusion_read_ids", f"SELECT DISTINCT qname FROM ({TRANSCRIPTS}) WHERE (sa IS NOT NULL AND CAST(100.0 * (100 - CAST(regexp_extract(sa, ',(\\d+);', 1) AS BIGINT)) / 100 AS FLOAT) >= 98.0 AND regexp_extract(sa, '^(CHS\\.[0-9]+)', 1) <> regexp_extract(rname, '^(CHS\\.[0-9]+)', 1)) OR (flag & 8 = 0 AND regexp_extract(mate_rname, '^(CHS\\.[0-9]+)', 1) <> regexp_extract(rname, '^(CHS\\.[0-9]+)', 1))")
def fusion_read_ids(spark, d):
    return integrate.linking_reads(table(spark, d, TRANSCRIPTS, "orders"))
