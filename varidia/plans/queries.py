"""The registered queries over the derived inputs, and the same results in DuckDB SQL.

The SQL computes transcript statistics directly, for every sample and coding base, so it is another algorithm
than the operators'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codons import AMINO_ACIDS, codon_pairs, codon_sites, codon_translation
from ..operators import cds, coding, diversity, fst, pileup, windows
from ..sources import readers, writers
from ..sources.shared import shared_path, stored
from . import analysis, derived, reports

Query = Callable[[SparkSession, str], DataFrame]
#: transitions twice as likely as transversions
RATES = {(a, b): 2.0 if {a, b} in ({"A", "G"}, {"C", "T"}) else 1.0 for a in "ACGT" for b in "ACGT" if a != b}
DIGITS = 8


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(n), DIGITS).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def _counts(spark, sf) -> DataFrame:
    """Filtered counts, computed once: what follows reads them several times."""
    return stored(derived.filtered(spark, sf), "counts")


def _exons(spark, sf) -> DataFrame:
    return stored(derived.exons(spark, sf), "exons")


def _stats(spark, sf, **options) -> DataFrame:
    return coding.transcript_statistics(_counts(spark, sf), _exons(spark, sf), derived.reference(spark, sf), **options)


def _sites(spark, sf) -> DataFrame:
    return pileup.site_diversity(derived.filtered(spark, sf))


def _reports(spark, sf) -> analysis.Diversity:
    """All reports, from counts and transcript statistics that are computed once."""
    return analysis.diversity(derived.pileup(spark, sf), derived.reference(spark, sf), derived.contigs(spark, sf), _exons(spark, sf), derived.MAF, chunk_size=20, store=True)


def _first(spark, sf) -> DataFrame:
    return reports.first_transcripts(_stats(spark, sf), derived.contigs(spark, sf))


def _chunk_weighted(spark, sf) -> DataFrame:
    """Averages of chunks of 10 bases, weighted by their lengths."""
    contigs, sites = derived.contigs(spark, sf), _sites(spark, sf)
    chunks = contigs.select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(10).cast("long"))).alias("start"), "length")
    chunks = chunks.select("contig", "start", F.least(F.lit(10), F.col("length") - F.col("start")).alias("size")).crossJoin(sites.select("sample_id").distinct())
    sums = sites.groupBy("sample_id", "contig", (F.floor(F.col("pos") / 10) * 10).cast("long").alias("start")).agg(F.sum("pi").alias("s"))
    parts = chunks.join(sums, ["sample_id", "contig", "start"], "left")
    return diversity.weighted_pi(parts.select("sample_id", (F.coalesce("s", F.lit(0.0)) / F.col("size")).alias("pi"), F.col("size").alias("length")))


def _pooled(spark, sf) -> DataFrame:
    pairs = pileup.pooled_pairs(derived.filtered(spark, sf))
    sites = pairs.select("sample_1", "sample_2", "contig", "pos", pileup.site_pi().alias("pi"))
    return sites.groupBy("sample_1", "sample_2").agg(F.sum("pi").alias("pi_sum"), F.count("*").alias("n_sites"))


def _sync_back(spark, sf) -> DataFrame:
    return readers.parse_sync(writers.to_sync(derived.pileup(spark, sf), derived.reference(spark, sf), SAMPLES), SAMPLES)


SAMPLES = [f"s{i}" for i in range(5)]


def _file(spark, write: Callable[[str], None]) -> str:
    """A path in the folder that driver and executors share, with what was written there."""
    path = shared_path(spark, "text")
    write(path)
    return path


def _fasta(spark, sf) -> DataFrame:
    """The derived genome, written as FASTA and read back."""
    blocks, contigs = readers.read_fasta(spark, _file(spark, lambda p: writers.write_fasta(derived.reference(spark, sf), p)))
    return blocks.join(contigs, "contig").select("contig", "block", "length", "seq")


def _gtf(spark, sf) -> DataFrame:
    return readers.read_gtf(spark, _file(spark, lambda p: writers.write_gtf(derived.exons(spark, sf), p))).drop("exon_ord")


def _vcf_file(spark, sf) -> str:
    return _file(spark, lambda p: writers.write_vcf(derived.pileup(spark, sf), derived.reference(spark, sf), SAMPLES, p, "gzip"))


def _codons(spark, sf) -> DataFrame:
    """Codons of the derived contigs, from their first base on."""
    at = (F.col("pos") % 3).cast("int")
    three = [F.max(F.when(at == i, F.col("base"))) for i in range(3)]
    rows = derived.reference(spark, sf).groupBy("contig", F.floor(F.col("pos") / 3).cast("long").alias("codon_idx")).agg(F.concat(*three).alias("codon"))
    return rows.filter("codon IS NOT NULL")


def _codon_sites(spark, sf, **options) -> DataFrame:
    """Sites of each base of the contigs, in the codon it stands in."""
    rows = _codons(spark, sf).join(F.broadcast(codon_sites(spark, **options)), "codon").filter(F.substr("codon", F.col("codon_pos") + 1, F.lit(1)) == F.col("nuc"))  # 768 rows
    return rounded(rows.select("contig", "codon_idx", "codon_pos", "nuc", "s_sites", "n_sites"))


def _fst(spark, sf, by_contig: bool = False, coding_sites: bool = False, block: int = fst.BLOCK) -> DataFrame:
    classes = coding.pair_classes(derived.exons(spark, sf), derived.reference(spark, sf)) if coding_sites else None
    return rounded(fst.fst(_counts(spark, sf), classes, by_contig=by_contig, block=block))


def _coding_windows(spark, sf) -> DataFrame:
    counts = _counts(spark, sf)
    values = coding.coding_site_values(counts, coding.gene_exons(_exons(spark, sf)), derived.reference(spark, sf))
    return rounded(windows.sliding_coding(*values, counts.select("sample_id").distinct(), derived.contigs(spark, sf), 24, 10))


STATS = ["sample_id", "contig", "transcript_id"]

QUERIES: dict[str, Query] = {
    "pileup_counts": derived.pileup,
    "maf_filter": derived.filtered,
    "depth_freq": lambda s, d: rounded(pileup.frequencies(derived.filtered(s, d), derived.reference(s, d))),
    "pi_math": lambda s, d: pileup.pi_math(derived.filtered(s, d)),
    "site_pi": lambda s, d: rounded(_sites(s, d)),
    "sample_pi": lambda s, d: rounded(diversity.sample_pi(_sites(s, d), derived.contigs(s, d))),
    "contig_pi": lambda s, d: rounded(diversity.contig_pi(_sites(s, d), derived.contigs(s, d))),
    "chunk_weighted_pi": lambda s, d: rounded(_chunk_weighted(s, d)),
    "window_pi": lambda s, d: rounded(diversity.window_pi(_sites(s, d), derived.contigs(s, d), 30)),
    "window_sliding_pi": lambda s, d: rounded(windows.sliding_pi(_sites(s, d), derived.contigs(s, d), 30, 7, block=4)),
    "window_coding": _coding_windows,
    "consensus": lambda s, d: pileup.consensus_bases(derived.filtered(s, d), derived.reference(s, d)),
    "consensus_seq_per_contig": lambda s, d: pileup.consensus_sequences(derived.filtered(s, d), derived.reference(s, d)),
    "consensus_blocks": lambda s, d: pileup.consensus_blocks(derived.filtered(s, d), derived.reference(s, d), 16),
    "region_filter": lambda s, d: pileup.in_region(derived.filtered(s, d), "ctg1", 10, 50),
    "cds_positions": lambda s, d: cds.cds_positions(derived.exons(s, d)),
    "exon_offsets": lambda s, d: cds.exon_offsets(derived.exons(s, d)),
    "reading_frames": lambda s, d: cds.reading_frames(derived.exons(s, d)),
    "oof_overlaps": lambda s, d: cds.overlapping_positions(derived.exons(s, d)),
    "overlap_intervals": lambda s, d: cds.overlap_intervals(derived.exons(s, d)),
    "variants_in_exons": lambda s, d: cds.variants_in_exons(derived.filtered(s, d), derived.exons(s, d)),
    "overlapping_transcripts": lambda s, d: cds.overlapping_transcripts(derived.exons(s, d)),
    "transcripts_in_regions": lambda s, d: cds.transcripts_in_regions(derived.exons(s, d), cds.chunks(derived.exons(s, d), derived.contigs(s, d), 20)).select("contig", "transcript_id", "first_pos", "last_pos", "chunk_id"),
    "chunk_ranges": lambda s, d: cds.chunks(derived.exons(s, d), derived.contigs(s, d), 20),
    "codon_translate": lambda s, d: _codons(s, d).join(F.broadcast(codon_translation(s)), "codon").select("contig", "codon_idx", "codon", "aa"),
    "codon_sites": _codon_sites,
    "codon_sites_stop": lambda s, d: _codon_sites(s, d, include_stops=True),
    "codon_sites_rates": lambda s, d: _codon_sites(s, d, rates=RATES),
    "codon_pair_class": lambda s, d: _codons(s, d).join(F.broadcast(codon_pairs(s)), "codon").drop("codon"),
    "transcript_pi": lambda s, d: rounded(_stats(s, d).select(*STATS, "transcript_len", "pi")),
    "transcript_sites": lambda s, d: rounded(_stats(s, d).select(*STATS, "N_sites", "S_sites")),
    "transcript_sites_stop": lambda s, d: rounded(_stats(s, d, include_stops=True).select(*STATS, "N_sites", "S_sites")),
    "transcript_sites_rates": lambda s, d: rounded(_stats(s, d, rates=RATES).select(*STATS, "N_sites", "S_sites")),
    "transcript_pin_pis": lambda s, d: rounded(_stats(s, d).select(*STATS, "piN", "piS")),
    "transcript_no_overlap": lambda s, d: rounded(_stats(s, d).select(*STATS, "transcript_len_no_overlap", *coding.NO_OVERLAP)),
    "bad_length_transcripts": lambda s, d: coding.rejected_transcripts(derived.exons(s, d)),
    "first_transcript": lambda s, d: _first(s, d).select("sample_id", "contig", "gene_id", "transcript_id"),
    "gene_report": lambda s, d: rounded(_reports(s, d).genes),
    "sample_report": lambda s, d: rounded(_reports(s, d).samples),
    "contig_report": lambda s, d: rounded(_reports(s, d).contigs),
    "site_long": lambda s, d: rounded(reports.sites_report(_sites(s, d))),
    "site_wide": lambda s, d: rounded(reports.wide_sites(_sites(s, d), "ctg0", list(range(100)))),
    "record_counts": lambda s, d: pileup.record_counts(derived.pileup(s, d)),
    "pairwise_pooled_pi": lambda s, d: rounded(_pooled(s, d)),
    "fst_pairs": _fst,
    "fst_contigs": lambda s, d: _fst(s, d, by_contig=True, block=2),
    "fst_coding": lambda s, d: _fst(s, d, coding_sites=True),
    "sync_format": lambda s, d: writers.to_sync(derived.pileup(s, d), derived.reference(s, d), SAMPLES),
    "sync_parse": _sync_back,
    "fasta_parse": _fasta,
    "gtf_parse": _gtf,
    "vcf_record_counts": lambda s, d: readers.vcf_record_counts(s, _vcf_file(s, d)),
    "vcf_parse": lambda s, d: readers.read_vcf(s, _vcf_file(s, d)),
}

_EXONS = ", ".join(f"('{t}', '{g}', '{st}', {a}, {b}, {o})" for t, g, st, a, b, o in derived.EXONS)
_CODE = f"""code AS (SELECT x || y || z AS codon, substr('{AMINO_ACIDS}', 16 * i + 4 * j + k + 1, 1) AS aa
  FROM (SELECT unnest(['T','C','A','G']) AS x, unnest(range(4)) AS i), (SELECT unnest(['T','C','A','G']) AS y, unnest(range(4)) AS j), (SELECT unnest(['T','C','A','G']) AS z, unnest(range(4)) AS k)),
nucs AS (SELECT unnest(['A','C','G','T']) AS nuc), three AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS codon_pos),
mut AS (SELECT codon, aa, codon_pos, nuc, substr(codon, codon_pos + 1, 1) AS own, substr(codon, 1, codon_pos) || nuc || substr(codon, codon_pos + 2) AS new FROM code, three, nucs)"""


def _site_sql(stops: bool = False, rates: bool = False) -> str:
    keep = "true" if stops else "m.aa <> '*' AND n.aa <> '*'"
    weight = "CASE WHEN m.own || m.nuc IN ('AG','GA','CT','TC') THEN 2e0 ELSE 1e0 END" if rates else "1e0 / 3e0"
    dead = "false" if stops else "m.aa = '*'"
    return f"""{_CODE},
w AS (SELECT m.codon, m.codon_pos, coalesce(sum(CASE WHEN n.aa = m.aa THEN {weight} END), 0e0) AS s, coalesce(sum(CASE WHEN n.aa <> m.aa THEN {weight} END), 0e0) AS n
  FROM mut m JOIN code n ON n.codon = m.new WHERE m.nuc <> m.own AND {keep} GROUP BY 1, 2),
sites AS (SELECT m.codon, m.codon_pos, m.nuc, CASE WHEN {dead} THEN 0e0 ELSE coalesce(w.s / (w.s + w.n), 0e0) END AS s_sites, CASE WHEN {dead} THEN 0e0 ELSE coalesce(w.n / (w.s + w.n), 0e0) END AS n_sites
  FROM mut m LEFT JOIN w ON w.codon = m.new AND w.codon_pos = m.codon_pos)"""


_PAIRS_SQL = """pairs AS (SELECT unnest(['ac','ag','at','cg','ct','gt']) AS pair),
classes AS (SELECT m.codon, m.codon_pos, p.pair, CAST(max(CASE WHEN n1.aa = n2.aa AND m.own IN (upper(p.pair[1]), upper(p.pair[2])) THEN 1 ELSE 0 END) AS INTEGER) AS is_syn,
  CAST(max(CASE WHEN n1.aa <> n2.aa AND m.own IN (upper(p.pair[1]), upper(p.pair[2])) THEN 1 ELSE 0 END) AS INTEGER) AS is_nonsyn
  FROM pairs p, (SELECT DISTINCT codon, codon_pos, own FROM mut) m JOIN mut m1 ON m1.codon = m.codon AND m1.codon_pos = m.codon_pos JOIN code n1 ON n1.codon = m1.new
  JOIN mut m2 ON m2.codon = m.codon AND m2.codon_pos = m.codon_pos JOIN code n2 ON n2.codon = m2.new
  WHERE m1.nuc = upper(p.pair[1]) AND m2.nuc = upper(p.pair[2]) GROUP BY 1, 2, 3)"""

_BASE = f"""ref AS (SELECT CAST(p_partkey AS BIGINT) AS gpos, 'ctg' || CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS VARCHAR) AS contig, CAST(p_partkey % 100 AS BIGINT) AS pos,
  CAST((p_partkey * 7 + CAST(floor(p_partkey / 4) AS BIGINT)) % 4 AS INT) AS ri, (p_partkey * 13 + CAST(floor(p_partkey / 3) AS BIGINT)) % 3 = 0 AS is_var FROM part),
base AS (SELECT contig, pos, ['A','C','G','T'][ri + 1] AS base FROM ref),
reads AS (SELECT 's' || CAST(l_suppkey % 5 AS VARCHAR) AS sample_id, r.contig, r.pos, CASE WHEN l_returnflag = 'R' THEN (r.ri + 1 + l_linenumber % 3) % 4 ELSE r.ri END AS ni, CAST(l_quantity AS BIGINT) AS q
  FROM lineitem JOIN ref r ON l_partkey = r.gpos WHERE r.is_var),
raw AS (SELECT sample_id, contig, pos, {", ".join(f"CAST(coalesce(sum(q) FILTER (ni = {i}), 0) AS BIGINT) AS {b}" for i, b in enumerate("acgt"))} FROM reads GROUP BY 1, 2, 3),
pile AS (SELECT sample_id, contig, pos, {", ".join(f"CASE WHEN {b} < 0.1e0 * (a + c + g + t) THEN 0 ELSE {b} END AS {b}" for b in "acgt")} FROM raw),
site AS (SELECT *, a + c + g + t AS depth, CASE WHEN a + c + g + t > 1 THEN CAST(a*c + a*g + a*t + c*g + c*t + g*t AS DOUBLE) / ((a + c + g + t) * (a + c + g + t - 1) / 2e0) ELSE 0e0 END AS pi FROM pile),
samples AS (SELECT DISTINCT sample_id FROM pile),
contigs AS (SELECT contig, count(*) AS length FROM ref GROUP BY 1),
exons AS (SELECT contig, contig || e.t AS transcript_id, contig || e.g AS gene_id, e.strand, CAST(e.o AS INTEGER) AS exon_ord, CAST(e.a AS BIGINT) AS "start", CAST(e.b AS BIGINT) AS "end"
  FROM contigs, (VALUES {_EXONS}) e(t, g, strand, a, b, o)),
offs AS (SELECT *, CAST(coalesce(sum("end" - "start") OVER (PARTITION BY contig, transcript_id ORDER BY exon_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cds_offset FROM exons),
cdspos AS (SELECT contig, transcript_id, strand, cds_offset + i AS cds_idx, CASE WHEN strand = '-' THEN "end" - 1 - i ELSE "start" + i END AS pos FROM (SELECT *, unnest(range("end" - "start")) AS i FROM offs)),
frames AS (SELECT *, CAST(CASE WHEN strand = '-' THEN "end" % 3 + 3 ELSE "start" % 3 END AS INTEGER) AS frame FROM exons),
over AS (SELECT contig, pos FROM (SELECT contig, frame, unnest(range("start", "end")) AS pos FROM frames) GROUP BY 1, 2 HAVING count(DISTINCT frame) > 1),
tr AS (SELECT contig, transcript_id, min(gene_id) AS gene_id, CAST(sum("end" - "start") AS BIGINT) AS len, min("start") AS s, max("end") AS e, min(exon_ord) AS o FROM exons GROUP BY 1, 2)"""


def _call(base: str) -> str:
    return f"CASE WHEN a + c + g + t = 0 THEN {base} WHEN a >= c AND a >= g AND a >= t THEN 'A' WHEN c >= g AND c >= t THEN 'C' WHEN g >= t THEN 'G' ELSE 'T' END"


def _coding_sql(stops: bool = False, rates: bool = False) -> str:
    return f"""{_BASE}, {_site_sql(stops, rates)}, {_PAIRS_SQL},
varsite AS (SELECT DISTINCT contig, pos FROM pile),
x AS (SELECT s.sample_id, p.contig, p.transcript_id, p.strand, p.pos, p.cds_idx // 3 AS ci, CAST(p.cds_idx % 3 AS INTEGER) AS codon_pos, b.base,
  coalesce(l.a, 0) AS a, coalesce(l.c, 0) AS c, coalesce(l.g, 0) AS g, coalesce(l.t, 0) AS t, v.pos IS NOT NULL AND o.pos IS NOT NULL AS out
  FROM cdspos p JOIN tr ON tr.contig = p.contig AND tr.transcript_id = p.transcript_id AND tr.len % 3 = 0 CROSS JOIN samples s JOIN base b ON b.contig = p.contig AND b.pos = p.pos
  LEFT JOIN pile l ON l.sample_id = s.sample_id AND l.contig = p.contig AND l.pos = p.pos LEFT JOIN varsite v ON v.contig = p.contig AND v.pos = p.pos LEFT JOIN over o ON o.contig = p.contig AND o.pos = p.pos),
y AS (SELECT *, {_call("base")} AS called FROM x),
z AS (SELECT sample_id, contig, transcript_id, pos, ci, codon_pos, out, CASE WHEN strand = '-' THEN translate(called, 'ACGT', 'TGCA') ELSE called END AS called, CASE WHEN strand = '-' THEN translate(base, 'ACGT', 'TGCA') ELSE base END AS base,
  CASE WHEN strand = '-' THEN t ELSE a END AS a, CASE WHEN strand = '-' THEN g ELSE c END AS c, CASE WHEN strand = '-' THEN c ELSE g END AS g, CASE WHEN strand = '-' THEN a ELSE t END AS t FROM y),
cod AS (SELECT *, string_agg(called, '') OVER (PARTITION BY sample_id, contig, transcript_id, ci ORDER BY codon_pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS codon, CAST(a + c + g + t AS DOUBLE) AS d FROM z),
fs AS (SELECT cod.*, n.nuc, CASE WHEN d > 0 THEN CASE n.nuc WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END / d ELSE CASE WHEN n.nuc = base THEN 1e0 ELSE 0e0 END END AS f FROM cod, nucs n),
ns AS (SELECT fs.sample_id, fs.contig, fs.transcript_id, sum(f * n_sites) AS n, sum(f * s_sites) AS s, coalesce(sum(f * n_sites) FILTER (out), 0) AS n_out, coalesce(sum(f * s_sites) FILTER (out), 0) AS s_out
  FROM fs JOIN sites ON sites.codon = fs.codon AND sites.codon_pos = fs.codon_pos AND sites.nuc = fs.nuc GROUP BY 1, 2, 3),
ps AS (SELECT cod.*, k.is_syn, k.is_nonsyn, CASE WHEN d > 1 THEN CAST(CASE k.pair WHEN 'ac' THEN a*c WHEN 'ag' THEN a*g WHEN 'at' THEN a*t WHEN 'cg' THEN c*g WHEN 'ct' THEN c*t ELSE g*t END AS DOUBLE) / (d * (d - 1) / 2e0) ELSE 0e0 END AS p
  FROM cod JOIN classes k ON k.codon = cod.codon AND k.codon_pos = cod.codon_pos),
pp AS (SELECT sample_id, contig, transcript_id, sum(p) AS p, sum(p * is_nonsyn) AS pn, sum(p * is_syn) AS ps, coalesce(sum(p) FILTER (out), 0) AS p_out, coalesce(sum(p * is_nonsyn) FILTER (out), 0) AS pn_out, coalesce(sum(p * is_syn) FILTER (out), 0) AS ps_out,
  CAST(count(*) FILTER (out) AS BIGINT) // 6 AS l_out FROM ps GROUP BY 1, 2, 3),
st AS (SELECT s.sample_id, tr.contig, tr.transcript_id, tr.gene_id, tr.len AS transcript_len, tr.len - coalesce(l_out, 0) AS transcript_len_no_overlap, p / tr.len AS pi, pn / nullif(n, 0) AS "piN", ps / nullif(ns.s, 0) AS "piS", n AS "N_sites", ns.s AS "S_sites",
  (p - p_out) / nullif(tr.len - l_out, 0) AS pi_no_overlap, (pn - pn_out) / nullif(n - n_out, 0) AS "piN_no_overlap", (ps - ps_out) / nullif(ns.s - s_out, 0) AS "piS_no_overlap", n - n_out AS "N_sites_no_overlap", ns.s - s_out AS "S_sites_no_overlap", tr.s AS first_pos, tr.o AS file_ord
  FROM tr CROSS JOIN samples s LEFT JOIN ns ON ns.sample_id = s.sample_id AND ns.contig = tr.contig AND ns.transcript_id = tr.transcript_id LEFT JOIN pp ON pp.sample_id = s.sample_id AND pp.contig = tr.contig AND pp.transcript_id = tr.transcript_id),
fst AS (SELECT * FROM st WHERE pi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY contig, gene_id, sample_id ORDER BY first_pos, file_ord, transcript_id) = 1)"""


_FST_SQL = f"""{_BASE}, {_CODE}, {_PAIRS_SQL},
cd AS (SELECT p.contig, p.transcript_id, p.strand, p.pos, CAST(cds_idx % 3 AS INTEGER) AS cp, string_agg(CASE WHEN p.strand = '-' THEN translate(base, 'ACGT', 'TGCA') ELSE base END, '') OVER (PARTITION BY p.contig, p.transcript_id, cds_idx // 3 ORDER BY cds_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS codon
  FROM cdspos p JOIN tr ON tr.contig = p.contig AND tr.transcript_id = p.transcript_id AND tr.len % 3 = 0 JOIN base b ON b.contig = p.contig AND b.pos = p.pos),
pk AS (SELECT * FROM cd QUALIFY row_number() OVER (PARTITION BY contig, pos ORDER BY transcript_id) = 1),
two AS (SELECT pair, upper(pair[1]) AS x, upper(pair[2]) AS y FROM pairs),
cls AS (SELECT pk.contig, pk.pos, two.pair, k.is_syn, k.is_nonsyn FROM pk, two JOIN classes k ON k.codon = pk.codon AND k.codon_pos = pk.cp
  AND k.pair = CASE WHEN pk.strand = '-' THEN CASE two.pair WHEN 'ac' THEN 'gt' WHEN 'ag' THEN 'ct' WHEN 'ct' THEN 'ag' WHEN 'gt' THEN 'ac' ELSE two.pair END ELSE two.pair END),
ln AS (SELECT sample_id, contig, pos, CAST(depth AS DOUBLE) AS d, unnest(['A','C','G','T']) AS nuc, CAST(unnest([a, c, g, t]) AS DOUBLE) AS n FROM site WHERE depth > 1),
wd AS (SELECT l.sample_id, l.contig, l.pos, two.pair, l.d, l.n AS nx, r.n AS ny FROM two JOIN ln l ON l.nuc = two.x JOIN ln r ON r.nuc = two.y AND r.sample_id = l.sample_id AND r.contig = l.contig AND r.pos = l.pos),
both2 AS (SELECT p.sample_id AS sample_1, q.sample_id AS sample_2, p.contig, p.pos, p.pair, (2 * p.nx * p.ny / (p.d * (p.d - 1)) + 2 * q.nx * q.ny / (q.d * (q.d - 1))) / 2 AS w, (p.nx * q.ny + p.ny * q.nx) / (p.d * q.d) AS b
  FROM wd p JOIN wd q ON q.contig = p.contig AND q.pos = p.pos AND q.pair = p.pair AND q.sample_id > p.sample_id),
kinds AS (SELECT sample_1, sample_2, contig, pos, 'all' AS kind, w, b FROM both2 UNION ALL SELECT sample_1, sample_2, b.contig, b.pos, u.kind, w, b.b FROM both2 b JOIN cls USING (contig, pos, pair), (VALUES ('N'), ('S')) u(kind)
  WHERE CASE u.kind WHEN 'N' THEN is_nonsyn ELSE is_syn END = 1)"""
_FST = "CAST(count(DISTINCT contig || ':' || pos) AS BIGINT) AS n_sites, round(CASE WHEN sum(b) > 1e-12 THEN 1 - sum(w) / sum(b) END, 8) AS fst FROM kinds"


_CODONS_SQL = "codons AS (SELECT contig, CAST(pos // 3 AS BIGINT) AS codon_idx, string_agg(base, '' ORDER BY pos) AS codon FROM base GROUP BY 1, 2 HAVING count(*) = 3)"


def _codon_sites_sql(**options) -> str:
    return f"WITH {_BASE}, {_site_sql(**options)}, {_CODONS_SQL} SELECT contig, codon_idx, codon_pos, nuc, {_r('s_sites', 'n_sites')} FROM codons JOIN sites USING (codon) WHERE nuc = substr(codon, codon_pos + 1, 1)"


def _r(*names: str) -> str:
    return ", ".join(f'round("{n}", {DIGITS}) AS "{n}"' for n in names)


def _rolled(by: str) -> str:
    return ", ".join([by, *(f'sum("pi{k}_no_overlap" * "{k}_sites_no_overlap") / nullif(sum("{k}_sites_no_overlap") FILTER ("pi{k}_no_overlap" IS NOT NULL), 0) AS "pi{k}"' for k in "NS"), *(f'sum("{k}_sites_no_overlap") AS "{k}_sites"' for k in "NS")])


_SAMPLE_PI = "(SELECT sample_id, sum(pi) / (SELECT count(*) FROM ref) AS pi FROM site GROUP BY 1)"
_CONTIG_PI = "(SELECT s.sample_id, c.contig, c.length AS contig_length, coalesce(sum(site.pi), 0e0) / c.length AS pi FROM samples s CROSS JOIN contigs c LEFT JOIN site ON site.sample_id = s.sample_id AND site.contig = c.contig GROUP BY 1, 2, 3)"
_CHUNKS = """(WITH isl AS (SELECT contig, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN reach > s THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY s, e, transcript_id) AS k
  FROM (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e, transcript_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM tr)) GROUP BY contig, k),
 cut AS (SELECT DISTINCT c.contig, c.length, coalesce((SELECT max(e) FROM isl WHERE isl.contig = c.contig AND x > isl.s AND x < isl.e), x) AS "start" FROM (SELECT contig, length, unnest(range(0, length, 20)) AS x FROM contigs) c)
 SELECT contig, CAST(row_number() OVER w - 1 AS BIGINT) AS chunk_id, CAST("start" AS BIGINT) AS "start", CAST(coalesce(lead("start") OVER w, length) AS BIGINT) AS "end" FROM cut WHERE "start" < length WINDOW w AS (PARTITION BY contig ORDER BY "start"))"""
_WITH = f"WITH {_BASE} "
_SYNC = ", ".join(f"coalesce(max(a || ':' || t || ':' || c || ':' || g || ':0:0') FILTER (sample_id = 's{i}'), '0:0:0:0:0:0') AS s{i}" for i in range(5))


def _coded(select: str, **options) -> str:
    return f"WITH {_coding_sql(**options)} {select}"


ORACLES: dict[str, str] = {
    "pileup_counts": _WITH + "SELECT * FROM raw",
    "maf_filter": _WITH + "SELECT * FROM pile",
    "depth_freq": _WITH + f"SELECT sample_id, contig, pos, depth, {', '.join(f'round(CASE WHEN depth > 0 THEN CAST({b} AS DOUBLE) / depth WHEN base = {chr(39)}{b.upper()}{chr(39)} THEN 1e0 ELSE 0e0 END, {DIGITS}) AS f{b}' for b in 'acgt')} FROM site JOIN base USING (contig, pos)",
    "pi_math": _WITH + "SELECT sample_id, contig, pos, depth, a*c AS ac, a*g AS ag, a*t AS at, c*g AS cg, c*t AS ct, g*t AS gt FROM site",
    "site_pi": _WITH + f"SELECT sample_id, contig, pos, {_r('pi')} FROM site",
    "sample_pi": _WITH + f"SELECT sample_id, {_r('pi')} FROM {_SAMPLE_PI}",
    "contig_pi": _WITH + f"SELECT sample_id, contig, contig_length, {_r('pi')} FROM {_CONTIG_PI}",
    "chunk_weighted_pi": _WITH + f"SELECT sample_id, {_r('pi')} FROM {_SAMPLE_PI}",
    "window_pi": _WITH + f"SELECT sample_id, contig, start, least(30, length - start) AS window_length, round(s / least(30, length - start), {DIGITS}) AS pi FROM (SELECT sample_id, contig, pos // 30 * 30 AS start, sum(pi) AS s FROM site GROUP BY 1, 2, 3) JOIN contigs USING (contig)",
    "window_sliding_pi": _WITH + f"""SELECT sample_id, contig, k * 7 AS start, least(30, any_value(length) - k * 7) AS window_length, CAST(count(*) AS BIGINT) AS n_sites, round(sum(pi) / least(30, any_value(length) - k * 7), {DIGITS}) AS pi
  FROM (SELECT *, unnest(range(greatest(0, CAST(floor((pos - 30) / 7e0) AS BIGINT) + 1), pos // 7 + 1)) AS k FROM site) JOIN contigs USING (contig) GROUP BY sample_id, contig, k""",
    "window_coding": _coded(f"""SELECT sample_id, contig, k * 10 AS start, least(24, any_value(length) - k * 10) AS window_length, CAST(count(*) AS BIGINT) AS coding_bases, round(CASE WHEN sum(n) > 1e-12 THEN sum(pn) / sum(n) END, {DIGITS}) AS "piN",
  round(CASE WHEN sum(s) > 1e-12 THEN sum(ps) / sum(s) END, {DIGITS}) AS "piS", round(sum(n), {DIGITS}) AS "N_sites", round(sum(s), {DIGITS}) AS "S_sites"
  FROM (SELECT *, unnest(range(greatest(0, CAST(floor((pos - 24) / 1e1) AS BIGINT) + 1), pos // 10 + 1)) AS k FROM sv) JOIN contigs USING (contig) GROUP BY sample_id, contig, k""".replace("FROM sv", """FROM (SELECT f.sample_id, f.contig, f.pos, f.n, f.s, q.pn, q.ps
  FROM (SELECT fs.sample_id, fs.contig, fs.transcript_id, fs.pos, sum(f * n_sites) AS n, sum(f * s_sites) AS s FROM fs JOIN sites ON sites.codon = fs.codon AND sites.codon_pos = fs.codon_pos AND sites.nuc = fs.nuc GROUP BY 1, 2, 3, 4) f
  JOIN (SELECT sample_id, contig, transcript_id, pos, sum(p * is_nonsyn) AS pn, sum(p * is_syn) AS ps FROM ps GROUP BY 1, 2, 3, 4) q USING (sample_id, contig, transcript_id, pos)
  JOIN (SELECT contig, transcript_id FROM tr WHERE len % 3 = 0 QUALIFY row_number() OVER (PARTITION BY contig, gene_id ORDER BY s, o, transcript_id) = 1) USING (contig, transcript_id))""")),
    "consensus": _WITH + f"SELECT sample_id, contig, pos, {_call('base')} AS base FROM pile JOIN base USING (contig, pos)",
    "consensus_seq_per_contig": _WITH + f"SELECT s.sample_id, b.contig, string_agg(CASE WHEN p.pos IS NULL THEN b.base ELSE {_call('b.base')} END, '' ORDER BY b.pos) AS seq FROM samples s CROSS JOIN base b LEFT JOIN pile p ON p.sample_id = s.sample_id AND p.contig = b.contig AND p.pos = b.pos GROUP BY 1, 2",
    "consensus_blocks": _WITH + f"SELECT sample_id, contig, CAST(pos // 16 AS BIGINT) AS block, string_agg(own, '' ORDER BY pos) AS seq FROM (SELECT s.sample_id, b.contig, b.pos, b.base, CASE WHEN p.pos IS NULL THEN b.base ELSE {_call('b.base')} END AS own FROM samples s CROSS JOIN base b LEFT JOIN pile p ON p.sample_id = s.sample_id AND p.contig = b.contig AND p.pos = b.pos) GROUP BY 1, 2, 3 HAVING bool_or(own <> base)",
    "region_filter": _WITH + "SELECT * FROM pile WHERE contig = 'ctg1' AND pos BETWEEN 10 AND 49",
    "cds_positions": _WITH + "SELECT * FROM cdspos",
    "exon_offsets": _WITH + "SELECT * FROM offs",
    "reading_frames": _WITH + "SELECT * FROM frames",
    "oof_overlaps": _WITH + "SELECT * FROM over",
    "overlap_intervals": _WITH + """SELECT contig, CAST(min(pos) AS BIGINT) AS "start", CAST(max(pos) + 1 AS BIGINT) AS "end" FROM (SELECT contig, pos, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS g FROM over) GROUP BY contig, g""",
    "variants_in_exons": _WITH + "SELECT p.contig, p.transcript_id, p.strand, p.pos, p.cds_idx FROM cdspos p JOIN (SELECT DISTINCT contig, pos FROM pile) v ON v.contig = p.contig AND v.pos = p.pos",
    "overlapping_transcripts": _WITH + "SELECT DISTINCT a.contig, a.transcript_id, b.transcript_id AS other_transcript_id FROM cdspos a JOIN cdspos b ON a.contig = b.contig AND a.pos = b.pos AND a.transcript_id < b.transcript_id",
    "transcripts_in_regions": _WITH + f'SELECT contig, transcript_id, s AS first_pos, e AS last_pos, chunk_id FROM tr JOIN {_CHUNKS} k USING (contig) WHERE s >= k."start" AND s < k."end"',
    "chunk_ranges": _WITH + f"SELECT * FROM {_CHUNKS}",
    "codon_translate": f"WITH {_BASE}, {_CODE}, {_CODONS_SQL} SELECT contig, codon_idx, codon, aa FROM codons JOIN code USING (codon)",
    "codon_sites": _codon_sites_sql(),
    "codon_sites_stop": _codon_sites_sql(stops=True),
    "codon_sites_rates": _codon_sites_sql(rates=True),
    "codon_pair_class": f"WITH {_BASE}, {_CODE}, {_PAIRS_SQL}, {_CODONS_SQL} SELECT contig, codon_idx, codon_pos, pair, is_syn, is_nonsyn FROM codons JOIN classes USING (codon)",
    "transcript_pi": _coded(f"SELECT sample_id, contig, transcript_id, transcript_len, {_r('pi')} FROM st"),
    "transcript_sites": _coded(f"SELECT sample_id, contig, transcript_id, {_r('N_sites', 'S_sites')} FROM st"),
    "transcript_sites_stop": _coded(f"SELECT sample_id, contig, transcript_id, {_r('N_sites', 'S_sites')} FROM st", stops=True),
    "transcript_sites_rates": _coded(f"SELECT sample_id, contig, transcript_id, {_r('N_sites', 'S_sites')} FROM st", rates=True),
    "transcript_pin_pis": _coded(f"SELECT sample_id, contig, transcript_id, {_r('piN', 'piS')} FROM st"),
    "transcript_no_overlap": _coded(f"SELECT sample_id, contig, transcript_id, transcript_len_no_overlap, {_r(*coding.NO_OVERLAP)} FROM st"),
    "bad_length_transcripts": _WITH + "SELECT contig, transcript_id, len AS transcript_len FROM tr WHERE len % 3 <> 0",
    "first_transcript": _coded("SELECT sample_id, contig, gene_id, transcript_id FROM fst"),
    "gene_report": _coded(f"SELECT sample_id, contig, chunk_id, transcript_id, transcript_id AS transcript, gene_id, gene_id AS gene_symbol, transcript_len, transcript_len_no_overlap, {_r(*coding.STATS, *coding.NO_OVERLAP)} FROM st JOIN {_CHUNKS} k USING (contig) WHERE first_pos >= k.start AND first_pos < k.end"),
    "sample_report": _coded(f"SELECT sample_id, {_r(*coding.STATS)} FROM {_SAMPLE_PI} LEFT JOIN (SELECT {_rolled('sample_id')} FROM fst GROUP BY 1) USING (sample_id)"),
    "contig_report": _coded(f"SELECT sample_id, contig, contig_length, {_r(*coding.STATS)} FROM {_CONTIG_PI} LEFT JOIN (SELECT {_rolled('sample_id, contig')} FROM fst GROUP BY 1, 2) USING (sample_id, contig)"),
    "site_long": _WITH + f"SELECT sample_id, contig, pos, 'pi' AS stat_name, round(pi, {DIGITS}) AS value FROM site",
    "site_wide": _WITH + f"SELECT sample_id, contig, 'pi' AS stat_name, {', '.join(f'max(CASE WHEN pos = {i} THEN round(pi, {DIGITS}) END) AS {chr(34)}{i}{chr(34)}' for i in range(100))} FROM site WHERE contig = 'ctg0' GROUP BY 1, 2",
    "record_counts": _WITH + "SELECT contig, count(DISTINCT pos) AS n_records FROM raw GROUP BY 1",
    "pairwise_pooled_pi": _WITH + f"""SELECT sample_1, sample_2, round(sum(CASE WHEN d > 1 THEN CAST(a*c + a*g + a*t + c*g + c*t + g*t AS DOUBLE) / (d * (d - 1) / 2e0) ELSE 0e0 END), {DIGITS}) AS pi_sum, count(*) AS n_sites FROM (
  SELECT s1.sample_id AS sample_1, s2.sample_id AS sample_2, v.contig, v.pos, {", ".join(f"coalesce(p1.{b}, 0) + coalesce(p2.{b}, 0) AS {b}" for b in "acgt")}, {" + ".join(f"coalesce(p1.{b}, 0) + coalesce(p2.{b}, 0)" for b in "acgt")} AS d
  FROM samples s1 CROSS JOIN samples s2 CROSS JOIN (SELECT DISTINCT contig, pos FROM pile) v LEFT JOIN pile p1 ON p1.sample_id = s1.sample_id AND p1.contig = v.contig AND p1.pos = v.pos
  LEFT JOIN pile p2 ON p2.sample_id = s2.sample_id AND p2.contig = v.contig AND p2.pos = v.pos WHERE p1.pos IS NOT NULL OR p2.pos IS NOT NULL) GROUP BY 1, 2""",
    "fst_pairs": f"WITH {_FST_SQL} SELECT sample_1, sample_2, kind, {_FST} WHERE kind = 'all' GROUP BY 1, 2, 3",
    "fst_contigs": f"WITH {_FST_SQL} SELECT sample_1, sample_2, contig, kind, {_FST} WHERE kind = 'all' GROUP BY 1, 2, 3, 4",
    "fst_coding": f"WITH {_FST_SQL} SELECT sample_1, sample_2, kind, {_FST} GROUP BY 1, 2, 3",
    "sync_format": _WITH + f'SELECT contig AS "Contig", pos + 1 AS "Position", base AS "Ref", {_SYNC} FROM raw JOIN base USING (contig, pos) GROUP BY 1, 2, 3',
    "sync_parse": _WITH + "SELECT s.sample_id, v.contig, v.pos, coalesce(a, 0) AS a, coalesce(c, 0) AS c, coalesce(g, 0) AS g, coalesce(t, 0) AS t FROM samples s CROSS JOIN (SELECT DISTINCT contig, pos FROM raw) v LEFT JOIN raw r ON r.sample_id = s.sample_id AND r.contig = v.contig AND r.pos = v.pos",
    "fasta_parse": _WITH + "SELECT contig, CAST(pos // 10000 AS BIGINT) AS block, CAST(any_value(length) AS BIGINT) AS length, string_agg(base, '' ORDER BY pos) AS seq FROM base JOIN contigs USING (contig) GROUP BY 1, 2",
    "gtf_parse": _WITH + 'SELECT contig, transcript_id, gene_id, strand, "start", "end" FROM exons',
    "vcf_record_counts": _WITH + "SELECT contig, count(DISTINCT pos) AS n_records FROM raw GROUP BY 1",
    "vcf_parse": _WITH + "SELECT s.sample_id, v.contig, v.pos, coalesce(a, 0) AS a, coalesce(c, 0) AS c, coalesce(g, 0) AS g, coalesce(t, 0) AS t FROM samples s CROSS JOIN (SELECT DISTINCT contig, pos FROM raw) v LEFT JOIN raw r ON r.sample_id = s.sample_id AND r.contig = v.contig AND r.pos = v.pos",
}
