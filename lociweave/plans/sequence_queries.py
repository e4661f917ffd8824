"""Sequences, symbols and motifs, with document texts as DNA."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.functions import pwm
from lociweave.functions import sequence as S
from lociweave.operators.scale import spread
from lociweave.plans.registry import query, table

SEQ = "seqs AS (SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', 'N', 'g')) AS seq FROM documents)"
MOTIF = np.array([[6, 1, 1, 2], [1, 7, 1, 1], [2, 1, 1, 6]], float)
PARTNER = np.array([[1, 1, 7, 1], [5, 3, 1, 1]], float)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.canonical(F.col("text")).alias("seq"))


_RC = "reverse(translate(seq, 'ACGTN', 'TGCAN'))"


@query(f"WITH {SEQ} SELECT doc_id, {_RC} AS rc, least(seq, {_RC}) AS invariant FROM seqs")
def q12_revcomp(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", S.reverse_complement(F.col("seq")).alias("rc"), S.strand_invariant(F.col("seq")).alias("invariant"))


@query(f"""WITH {SEQ} SELECT doc_id, round(gc / greatest(acgt, 1), 9) AS gc_fraction, round(100.0::DOUBLE * cpg / greatest(n - 1, 1), 9) AS cpg_per_100bp, round((n - acgt) / greatest(n, 1), 9) AS n_fraction
 FROM (SELECT doc_id, length(seq)::DOUBLE AS n, length(regexp_replace(seq, '[^GC]', '', 'g'))::DOUBLE AS gc, length(regexp_replace(seq, '[^ACGT]', '', 'g'))::DOUBLE AS acgt,
   ((length(seq) - length(replace(seq, 'CG', ''))) / 2)::DOUBLE AS cpg FROM seqs)""")
def q13_seq_covariates(spark, sf_dir):
    s = F.col("seq")
    return sequences(spark, sf_dir).select("doc_id", *[F.round(f(s), 9).alias(n) for n, f in (("gc_fraction", S.gc_fraction), ("cpg_per_100bp", S.cpg_per_100bp), ("n_fraction", S.n_fraction))])


@query(f"WITH {SEQ} SELECT doc_id, list_max(list_transform(string_split_regex(seq, '[^ACGT]+'), lambda x: length(x)))::BIGINT AS longest_run FROM seqs")
def q14_longest_run(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", S.longest_canonical_run(F.col("seq")).cast("long").alias("longest_run"))


@query(r"""SELECT p_partkey, CASE s WHEN 'BRAND11' THEN 'ALIAS' WHEN 'RFX5' THEN 'OWN' WHEN 'RFXDC2' THEN 'RFX7' ELSE s END AS symbol FROM (
 SELECT p_partkey, replace(regexp_replace(regexp_replace(replace(upper(trim(' hs_' || CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Rfxdc2' ELSE 'rfx 5' END || '-dbd ')), ' ', ''), '^(HUMAN|HS)[_:.-]', ''),
  '[-_](FULL|EDBD|DBD|ISOFORM[0-9]+)$', ''), '#', '') AS s FROM part)""")
def q15_normalize_symbol(spark, sf_dir):
    """Given aliases stand beside the built-in ones, and before them."""
    k = F.col("p_partkey") % 3
    raw = F.concat(F.lit(" hs_"), F.replace(F.when(k == 0, F.col("p_brand")).when(k == 1, "Rfxdc2").otherwise("rfx 5"), F.lit("#"), F.lit("")), F.lit("-dbd "))
    return table(spark, sf_dir, "part").select("p_partkey", S.normalize_symbol(raw, {"BRAND11": "ALIAS", "RFX5": "OWN"}).alias("symbol"))


@query("""SELECT page_id, len(regexp_extract_all(html, '([a-z]+)="([^"]*)"'))::BIGINT AS n_attributes,
 list_last(regexp_extract_all(html, 'lang="([^"]*)"', 1)) AS lang, list_last(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS class FROM pages""")
def q16_gtf_attributes(spark, sf_dir):
    pattern = '([a-z]+)="([^"]*)"'
    p = table(spark, sf_dir, "pages").withColumn("a", S.attributes(F.col("html"), pattern))
    return p.select(
        "page_id", F.size(F.regexp_extract_all("html", F.lit(pattern), 1)).cast("long").alias("n_attributes"),
        F.try_element_at("a", F.lit("lang")).alias("lang"), F.try_element_at("a", F.lit("class")).alias("class"),
    )


@query("""SELECT conv_id, unnest(string_split(roles, ';')) AS role, unnest(string_split(lens, ';')) AS n FROM (
 SELECT conv_id, string_agg(role, ';' ORDER BY turn) AS roles, string_agg(length(text)::VARCHAR, ';' ORDER BY turn) AS lens FROM conversations GROUP BY conv_id)""")
def q17_parallel_lists(spark, sf_dir):
    from lociweave.sources.text import zip_lists

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce(F.length("text").cast("string"), F.lit("")).alias("n"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "n")))
    lists = rows.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", *[F.array_join(F.col(f"t.{c}"), ";").alias(a) for a, c in (("roles", "role"), ("lens", "n"))])
    return zip_lists(lists, ["roles", "lens"], ["role", "n"]).select("conv_id", "role", "n")


def _matrix_sql(m: np.ndarray, name: str) -> str:
    """VALUES of strand, offset, base and score of both strands."""
    odds = pwm.log_odds(pwm.probabilities(m))
    rows = [f"({s}, {j}, '{b}', {float(v)!r}::DOUBLE)" for s, o in enumerate((odds, odds[::-1, ::-1])) for j, row in enumerate(o) for b, v in zip("ACGT", row)]
    return f"{name}(strand, j, base, w) AS (VALUES {', '.join(rows)})"


_SCAN = f"""WITH {SEQ}, {_matrix_sql(MOTIF, 'm')}, letters AS (
  SELECT doc_id, i - 1 AS i, seq[i] AS base FROM seqs, LATERAL (SELECT unnest(range(1, length(seq) + 1)) AS i) u),
 scores AS (SELECT l.doc_id, strand, l.i - m.j AS at, sum(w) AS s FROM letters l JOIN m ON l.base = m.base GROUP BY ALL HAVING count(*) = {len(MOTIF)})
SELECT q.doc_id, coalesce(round(max(s), 6), '-infinity'::DOUBLE) AS score FROM seqs q LEFT JOIN scores c ON q.doc_id = c.doc_id GROUP BY q.doc_id"""


@query(_SCAN)
def q24_pwm_max_scan(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", F.round(pwm.best_column(F.col("seq"), pwm.probabilities(MOTIF)), 6).alias("score"))


@query(_SCAN)
def q24b_pwm_panel_scan(spark, sf_dir):
    scores = pwm.scan_column(F.col("seq"), {"m": pwm.probabilities(MOTIF), "p": pwm.probabilities(PARTNER)})
    return sequences(spark, sf_dir).select("doc_id", scores.alias("s")).select("doc_id", F.round(F.col("s")["m"], 6).alias("score"))


_GAPS = (0, 2, 5)


@query(f"""WITH {SEQ}, {_matrix_sql(MOTIF, 'a')}, {_matrix_sql(PARTNER, 'b')}, letters AS (
  SELECT doc_id, i - 1 AS i, seq[i] AS base FROM seqs, LATERAL (SELECT unnest(range(1, length(seq) + 1)) AS i) u),
 sa AS (SELECT doc_id, strand, i - j AS at, sum(w) AS s FROM letters l JOIN a ON l.base = a.base GROUP BY ALL HAVING count(*) = {len(MOTIF)}),
 sb AS (SELECT doc_id, strand, i - j AS at, sum(w) AS s FROM letters l JOIN b ON l.base = b.base GROUP BY ALL HAVING count(*) = {len(PARTNER)}),
 both_ AS (SELECT sa.doc_id, sa.s + sb.s AS s FROM sa JOIN sb ON sa.doc_id = sb.doc_id AND sb.at - sa.at - {len(MOTIF)} IN {_GAPS})
SELECT q.doc_id, coalesce(round(max(s), 6), '-infinity'::DOUBLE) AS score FROM seqs q LEFT JOIN both_ c ON q.doc_id = c.doc_id GROUP BY q.doc_id""")
def q25_spaced_pair_scan(spark, sf_dir):
    score = pwm.spaced_column(F.col("seq"), pwm.probabilities(MOTIF), pwm.probabilities(PARTNER), _GAPS)
    return sequences(spark, sf_dir).select("doc_id", F.round(score, 6).alias("score"))


@query("""WITH p AS (SELECT p_partkey, regexp_replace(upper(p_name || p_type), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM part)
SELECT p_partkey, k AS kmer, round(count(*)::DOUBLE / any_value(n), 9) AS share FROM (
 SELECT p_partkey, substring(s, i, 2) AS k, length(s) - 1 AS n FROM p, LATERAL (SELECT unnest(range(1, length(s))) AS i) u) GROUP BY p_partkey, k""")
def q26_kmer_vector(spark, sf_dir):
    v = pwm.kmer_columns(F.concat("p_name", "p_type"))
    # explode would have the optimizer work out the map once more, for a filter on its size
    return spread(table(spark, sf_dir, "part")).select("p_partkey", F.explode_outer(v).alias("kmer", "share")).filter("kmer IS NOT NULL").withColumn("share", F.round("share", 9))




@query("""WITH counts AS (SELECT p_partkey % 6 AS j, count_if(p_size % 4 = 0)::DOUBLE AS a, count_if(p_size % 4 = 1)::DOUBLE AS c, count_if(p_size % 4 = 2)::DOUBLE AS g, count_if(p_size % 4 = 3)::DOUBLE AS t FROM part GROUP BY 1),
 p AS (SELECT j, [(a + 1e-6) / n, (c + 1e-6) / n, (g + 1e-6) / n, (t + 1e-6) / n] AS q FROM (SELECT *, a + c + g + t + 4e-6 AS n FROM counts))
SELECT round(sum(2 + list_sum(list_transform(q, lambda x: x * log2(x)))), 6) AS bits, string_agg(substring('ACGT', list_position(q, list_max(q))::BIGINT, 1), '' ORDER BY j) AS consensus, count(*)::BIGINT AS positions FROM p""")
def q61_pwm_algebra(spark, sf_dir):
    """The matrix of counts by place and base, of which there are six, from all parts."""
    base = F.col("p_size") % 4
    rows = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 6).alias("j")).agg(*[F.count_if(base == k).cast("double").alias(b) for k, b in enumerate("ACGT")]).orderBy("j").collect()
    m = pwm.probabilities(np.array([[r[b] for b in "ACGT"] for r in rows]))
    return spark.createDataFrame([(round(float(pwm.information_bits(m)), 6), pwm.consensus(m), len(m))], "bits double, consensus string, positions long")


@query(f"""WITH {SEQ} SELECT doc_id, substring(seq, 1, 20) || 'CCGCGNGG' || substring(seq, 29) AS implanted, (doc_id % 37) % 10 IN (0, 1, 9) AS positive FROM seqs WHERE length(seq) >= 40""")
def q62_implant(spark, sf_dir):
    s = sequences(spark, sf_dir).filter(F.length("seq") >= 40)
    return s.select("doc_id", S.implant(F.col("seq"), F.lit("CCGCGNGG"), 20).alias("implanted"), S.rule_is_positive(F.col("doc_id") % 37).alias("positive"))


@query(f"WITH {SEQ} SELECT doc_id, sha256(seq) AS digest FROM seqs")
def q63_digest(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", S.digest(F.col("seq")).alias("digest"))
