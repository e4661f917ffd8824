"""Panels of pairs, nested models, splits, manifests and generated pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lociweave.functions import pwm
from lociweave.functions import sequence as S
from lociweave.operators import audit, intervals, metrics, models, pairs, panel, synth
from lociweave.operators.scale import kept
from lociweave.plans.interval_queries import A, LIFTED, _parts, chain_rows
from lociweave.plans.model_queries import _FOLDS, PAIRS, ROWS, _rows, nation_pairs
from lociweave.plans.registry import query, table
from lociweave.plans.sequence_queries import _GAPS, MOTIF, PARTNER, SEQ, _matrix_sql, sequences
from lociweave.sources import binary, writers

_RIDGE_ROWS = f"""{ROWS}, r AS (SELECT *, g / 10000 AS a, m AS b, d AS c, g / 10000 + d * 3 + m * t AS y FROM x),
 f AS (SELECT fold, count(*)::DOUBLE AS n, sum(a) AS sa, sum(b) AS sb, sum(c) AS sc, sum(y) AS sy, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(a * y) AS ay, sum(b * y) AS by_, sum(c * y) AS cy, sum(y * y) AS yy FROM r GROUP BY fold),
 t0 AS (SELECT i.k, sum(n) AS n, sum(sa) / sum(n) AS ma, sum(sb) / sum(n) AS mb, sum(sc) / sum(n) AS mc, sum(sy) / sum(n) AS my, sum(aa) AS aa, sum(ab) AS ab, sum(ac) AS ac, sum(bb) AS bb, sum(bc) AS bc, sum(cc) AS cc, sum(ay) AS ay, sum(by_) AS by_, sum(cy) AS cy
   FROM f, range(5) i(k) WHERE f.fold NOT IN (i.k, (i.k + 1) % 5) GROUP BY i.k),
 t1 AS (SELECT k, n, ma, mb, mc, my, sqrt((aa - n * ma * ma) / n) AS da, sqrt((bb - n * mb * mb) / n) AS db, sqrt((cc - n * mc * mc) / n) AS dc, ab - n * ma * mb AS ab, ac - n * ma * mc AS ac, bc - n * mb * mc AS bc, ay - n * ma * my AS ay, by_ - n * mb * my AS by_, cy - n * mc * my AS cy FROM t0),
 t2 AS (SELECT k, n, ma, mb, mc, my, da, db, dc, ab / (da * db) AS p, ac / (da * dc) AS q, bc / (db * dc) AS s, ay / da AS u, by_ / db AS v, cy / dc AS w, alpha, n + alpha AS e FROM t1, (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (1.0::DOUBLE), (10.0::DOUBLE), (100.0::DOUBLE)) z(alpha)),
 c0 AS (SELECT *, (e * u - p * v) / (e * e - p * p) AS x1, (e * v - p * u) / (e * e - p * p) AS x2, 0.0::DOUBLE AS x3, 'p0' AS model FROM t2),
 c1 AS (SELECT *, ((e * e - s * s) * u + (q * s - p * e) * v + (p * s - q * e) * w) / det AS x1, ((q * s - p * e) * u + (e * e - q * q) * v + (p * q - e * s) * w) / det AS x2, ((p * s - q * e) * u + (p * q - e * s) * v + (e * e - p * p) * w) / det AS x3, 'p1' AS model
   FROM (SELECT *, e * (e * e - s * s) - p * (p * e - q * s) + q * (p * s - q * e) AS det FROM t2)),
 co AS (SELECT model, k, alpha, x1 / da AS k1, x2 / db AS k2, CASE WHEN model = 'p0' THEN 0 ELSE x3 / dc END AS k3, x3, my - x1 / da * ma - x2 / db * mb - CASE WHEN model = 'p0' THEN 0 ELSE x3 / dc * mc END AS k0
   FROM (SELECT model, k, alpha, x1, x2, x3, da, db, dc, ma, mb, mc, my FROM c0 UNION ALL SELECT model, k, alpha, x1, x2, x3, da, db, dc, ma, mb, mc, my FROM c1)),
 loss AS (SELECT co.*, (yy - 2 * (k1 * ay + k2 * by_ + k3 * cy) + k1 * k1 * aa + k2 * k2 * bb + k3 * k3 * cc + 2 * (k1 * k2 * ab + k1 * k3 * ac + k2 * k3 * bc) - 2 * k0 * (sy - k1 * sa - k2 * sb - k3 * sc) + n * k0 * k0) / n AS mse FROM co JOIN f ON f.fold = (co.k + 1) % 5),
 best AS (SELECT * FROM loss QUALIFY row_number() OVER (PARTITION BY model, k ORDER BY mse, alpha) = 1),
 pr AS (SELECT r.*, z.k0 + z.k1 * a + z.k2 * b AS p0, o.k0 + o.k1 * a + o.k2 * b + o.k3 * c AS p1 FROM r JOIN best z ON z.model = 'p0' AND z.k = r.fold JOIN best o ON o.model = 'p1' AND o.k = r.fold)"""


def _ridge_rows(spark, sf_dir):
    return _rows(spark, sf_dir).withColumns({"a": F.col("g") / 10_000, "y": F.col("g") / 10_000 + F.col("d") * 3 + F.col("m") * F.col("t")})


def _nested(spark, sf_dir):
    return models.nested_continuous(_ridge_rows(spark, sf_dir), "fold", ["a", "m"], ["d"], "y")


@query(f"WITH {_RIDGE_ROWS} SELECT l_orderkey, l_partkey, line, round(p0, 5) AS p0, round(p1, 5) AS p1, round((SELECT 1 - sum((y - p1) * (y - p1)) / sum((y - p0) * (y - p0)) FROM pr), 7) AS partial_r2 FROM pr")
def q38_nested_ridge(spark, sf_dir):
    predicted, summary = _nested(spark, sf_dir)
    return predicted.select("l_orderkey", "l_partkey", "line", F.round("p0", 5).alias("p0"), F.round("p1", 5).alias("p1"), F.lit(round(summary["partial_r2"], 7)).alias("partial_r2"))


@query(f"WITH {_RIDGE_ROWS} SELECT 'd' AS feature, count(*)::BIGINT AS folds, round(median(x3), 6) AS median, bool_and(x3 > 0) AS all_positive FROM best WHERE model = 'p1'")
def q100_coefficient_summary(spark, sf_dir):
    _, summary = _nested(spark, sf_dir)
    rows = [(k, "d", float(c[0])) for k, c in enumerate(summary["added_coefficients"])]
    out = models.coefficient_summary(spark.createDataFrame(rows, "fold int, feature string, coefficient double"))
    return out.withColumn("median", F.round("median", 6))


_DRAWS = np.random.default_rng(11).integers(0, 22, (100, 22))
_DRAWN = "(VALUES " + ", ".join(f"({b}, {int(j)})" for b, row in enumerate(_DRAWS) for j in row) + ") w(b, j)"


@query(f"""WITH {ROWS}, e AS (SELECT (row_number() OVER (ORDER BY chrom)) - 1 AS j, sum((g - 1000 * m) * (g - 1000 * m)) AS s0, sum((g - 1500 * m) * (g - 1500 * m)) AS s1 FROM (SELECT g, m, 'chr' || (1 + l_orderkey % 22) AS chrom FROM x) GROUP BY chrom),
 r AS (SELECT b, 1 - sum(s1) / sum(s0) AS r2 FROM {_DRAWN} JOIN e USING (j) GROUP BY b)
SELECT round(quantile_cont(r2, 0.025), 8) AS low, round(quantile_cont(r2, 0.5), 8) AS median, round(quantile_cont(r2, 0.975), 8) AS high FROM r""")
def q101_block_bootstrap(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumns({"p0": 1000 * F.col("m"), "p1": 1500 * F.col("m"), "chrom": F.concat(F.lit("chr"), (1 + F.col("l_orderkey") % 22).cast("string"))})
    found = models.block_bootstrap(rows, "chrom", "g", 100, 11)
    return spark.createDataFrame([tuple(round(found[k], 8) for k in ("low", "median", "high"))], "low double, median double, high double")


@query(f"""WITH {ROWS}, e AS (SELECT g AS y, 1500 * m AS p FROM x) SELECT count(*)::BIGINT AS n, round(avg((y - p) ** 2), 3) AS mse, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(1 - avg((y - p) ** 2) / var_pop(y), 8) AS r2, round(corr(y, p), 8) AS pearson FROM e""")
def q102_continuous_metrics(spark, sf_dir):
    out = metrics.continuous(_rows(spark, sf_dir).select(F.col("g").alias("y"), (1500 * F.col("m")).alias("p")), "y", "p")
    return out.select("n", F.round("mse", 3).alias("mse"), *[F.round(c, 6).alias(c) for c in ("rmse", "mae")], *[F.round(c, 8).alias(c) for c in ("r2", "pearson")])


@query(f"""WITH {PAIRS} SELECT (SELECT count(*) FROM pr)::BIGINT AS rows, (SELECT sum(cooperative_signal) FROM pr)::BIGINT AS positives, (SELECT count(DISTINCT t) FROM (SELECT bait AS t FROM pr UNION SELECT prey FROM pr))::BIGINT AS unique_tfs,
 (SELECT count(*) FROM pr a JOIN pr b ON a.bait = b.prey AND a.prey = b.bait WHERE a.bait < a.prey AND a.cooperative_signal <> b.cooperative_signal)::BIGINT AS directed_asymmetries""")
def q103_pair_summary(spark, sf_dir):
    return pairs.pair_summary(nation_pairs(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT prey, count(*)::BIGINT AS n FROM pr WHERE cooperative_signal = 1 GROUP BY prey")
def q104_partner_frequency(spark, sf_dir):
    return pairs.partner_frequency(nation_pairs(spark, sf_dir), "cooperative_signal")


@query(f"""WITH {PAIRS}, t AS (SELECT DISTINCT tf FROM (SELECT bait AS tf FROM pr UNION SELECT prey FROM pr)), held AS (SELECT tf FROM t ORDER BY md5(tf || '|5'), tf LIMIT (SELECT greatest(1, round_even(count(*) * 0.2, 0)::BIGINT) FROM t))
SELECT bait, prey, CASE WHEN bait IN (SELECT tf FROM held) OR prey IN (SELECT tf FROM held) THEN 'test' ELSE 'train' END AS split FROM pr""")
def q105_assign_split(spark, sf_dir):
    return pairs.assign_split(nation_pairs(spark, sf_dir).select("bait", "prey"), "tf", 0.2, 5)


@query("""WITH u AS (SELECT o_orderkey, ('0x' || substring(md5(o_orderkey::VARCHAR || '|3'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM orders)
SELECT o_orderkey, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.85::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM u""")
def q106_random_split(spark, sf_dir):
    return pairs.random_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", seed=3)


@query("""SELECT o_orderkey AS bait, o_custkey AS prey, o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS positive FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey <> o_custkey AND (o_orderkey = 17 OR o_custkey = 17 OR o_orderkey % 2 = 0)""")
def q107_evaluable_positive(spark, sf_dir):
    k = F.col("o_orderkey")
    cells = table(spark, sf_dir, "orders").select(k.alias("bait"), F.col("o_custkey").alias("prey"), (k % 3 != 0).alias("tested"), (k % 5 == 0).alias("composite"), F.when(k % 7 == 0, True).alias("spacing"))
    own = pairs.evaluable(cells).withColumn("positive", pairs.is_positive(F.col("composite"), F.col("spacing"))).select("bait", "prey", "positive")
    return pairs.with_factor(own.filter("bait % 2 <> 0"), 17).unionByName(own.filter("bait % 2 = 0"))


@query("""WITH x AS (SELECT p_partkey, upper(split_part(p_name, ' ', 1)) AS a, upper(replace(substring(p_name, length(split_part(p_name, ' ', 1)) + 2), ' ', '_')) AS b FROM part)
SELECT p_partkey, a AS first, b AS second, least(a, b) || '_' || greatest(a, b) AS pair FROM x""")
def q108_pair_members(spark, sf_dir):
    raw = F.translate("p_name", " ", "_")
    m = S.pair_members(raw)
    return table(spark, sf_dir, "part").select("p_partkey", m[0].alias("first"), m[1].alias("second"), S.ordered_pair(raw).alias("pair"))


@query(f"""WITH {SEQ}, s AS (SELECT doc_id, replace(seq, 'N', '') AS s FROM seqs) SELECT doc_id, coalesce(array_to_string(list_transform(string_split(s, ''), lambda c: CASE c WHEN 'A' THEN '1000' WHEN 'C' THEN '0100' WHEN 'G' THEN '0010' WHEN 'T' THEN '0001' END), ''), '') AS code FROM s""")
def q109_one_hot(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("s", F.replace("seq", F.lit("N"), F.lit("")))
    return s.select("doc_id", S.one_hot_text(F.col("s")).alias("code"))


_LETTERS = "letters AS (SELECT doc_id, i - 1 AS i, seq[i] AS base FROM seqs, LATERAL (SELECT unnest(range(1, length(seq) + 1)) AS i) u)"


def _scan_sql(name: str, matrix: str, n: int) -> str:
    return f"{name} AS (SELECT doc_id, strand, l.i - j AS at, sum(w) AS s FROM letters l JOIN {matrix} ON l.base = {matrix}.base GROUP BY ALL HAVING count(*) = {n})"


def _pair_sql(a: str, b: str, gaps: tuple, strands: str = "true") -> str:
    return f"SELECT {a}.doc_id, max({a}.s + {b}.s) AS s FROM {a} JOIN {b} ON {a}.doc_id = {b}.doc_id AND {b}.at - {a}.at - {len(MOTIF)} IN ({', '.join(map(str, gaps))}) WHERE {strands} GROUP BY 1"


@query(f"""WITH {SEQ}, {_matrix_sql(MOTIF, 'a')}, {_matrix_sql(PARTNER, 'b')}, {_LETTERS}, {_scan_sql('sa', 'a', len(MOTIF))}, {_scan_sql('sb', 'b', len(PARTNER))}, near AS ({_pair_sql('sa', 'sb', _GAPS)}), far AS ({_pair_sql('sa', 'sb', (1, 4), 'sa.strand = 0 AND sb.strand = 1')})
SELECT q.doc_id, coalesce(round(near.s, 6), '-infinity'::DOUBLE) AS near, coalesce(round(far.s, 6), '-infinity'::DOUBLE) AS far FROM seqs q LEFT JOIN near ON near.doc_id = q.doc_id LEFT JOIN far ON far.doc_id = q.doc_id""")
def q110_grammar_matrix(spark, sf_dir):
    a, b = pwm.probabilities(MOTIF), pwm.probabilities(PARTNER)
    scores = pwm.grammar_matrix(F.col("seq"), [pwm.GrammarProfile("near", a, b, _GAPS), pwm.GrammarProfile("far", a, b, (1, 4), ("FR",))])
    return sequences(spark, sf_dir).select("doc_id", scores.alias("s")).select("doc_id", *[F.round(F.col("s")[n], 6).alias(n) for n in ("near", "far")])


@query(f"""WITH {SEQ}, {_matrix_sql(MOTIF, 'a')}, {_matrix_sql(PARTNER, 'b')}, {_LETTERS}, {_scan_sql('sa', 'a', len(MOTIF))}, {_scan_sql('sb', 'b', len(PARTNER))}, ma AS (SELECT doc_id, max(s) AS s FROM sa GROUP BY 1), mb AS (SELECT doc_id, max(s) AS s FROM sb GROUP BY 1)
SELECT doc_id, round((greatest(ma.s, mb.s) + (ma.s + mb.s) / 2) / 2, 6) AS score FROM ma JOIN mb USING (doc_id)""")
def q111_panel_scores(spark, sf_dir):
    """Pair P has the better of both models by one mechanism; pair Q has a model by each of two."""
    a, b = pwm.probabilities(MOTIF), pwm.probabilities(PARTNER)
    scores = sequences(spark, sf_dir).select("doc_id", pwm.scan_column(F.col("seq"), {"a": a, "b": b}).alias("s")).select("doc_id", *[F.col("s")[m].alias(n) for n, m in (("a1", "a"), ("b1", "b"), ("a2", "a"), ("b2", "b"))])
    kinds = {"a1": ("P", "composite"), "b1": ("P", "composite"), "a2": ("Q", "composite"), "b2": ("Q", "spacing")}
    out = panel.pair_balanced(panel.profile_scores(scores, "doc_id", kinds), "doc_id")
    return out.filter(metrics.finite(F.col("score"))).select("doc_id", F.round("score", 6).alias("score"))


_LN = 0.6931471805599453


@query(f"""WITH {SEQ}, {_matrix_sql(MOTIF, 'a')}, {_matrix_sql(PARTNER, 'b')}, {_LETTERS}, {_scan_sql('sa', 'a', len(MOTIF))}, {_scan_sql('sb', 'b', len(PARTNER))}, ma AS (SELECT doc_id, max(s) * {_LN} AS s FROM sa GROUP BY 1), mb AS (SELECT doc_id, max(s) * {_LN} AS s FROM sb GROUP BY 1),
 p AS (SELECT doc_id, least(ma.s, mb.s) AS s FROM ma JOIN mb USING (doc_id)), c AS (SELECT median(s) AS c FROM p), d AS (SELECT c, greatest(1.4826::DOUBLE * median(abs(s - c)), 1e-6) AS w FROM p, c GROUP BY c)
SELECT doc_id, round(s, 5) AS score, round(1 / (1 + exp(-greatest(least((s - c) / w, 30), -30))), 5) AS p FROM p, d""")
def q112_presence(spark, sf_dir):
    a, b = pwm.probabilities(MOTIF), pwm.probabilities(PARTNER)
    scored = kept(pwm.presence_scores(sequences(spark, sf_dir), "seq", a, b).filter(metrics.finite(F.col("score"))).select("doc_id", "score"))
    scale = metrics.robust_scale(scored, "score").first()
    z = F.least(F.greatest((F.col("score") - scale.center) / scale.scale, F.lit(-30.0)), F.lit(30.0))
    return scored.select("doc_id", F.round("score", 5).alias("score"), F.round(1 / (1 + F.exp(-z)), 5).alias("p"))


@query(f"""WITH {ROWS}, {_FOLDS}, h AS (SELECT l_orderkey, l_partkey, line, g, g - coalesce(mean, overall) AS r FROM b LEFT JOIN means USING (k, b1, b2) WHERE fold = k),
 bt AS (SELECT x.*, k, len(list_filter(qm[2:len(qm) - 1], lambda e: e <= m)) AS b1 FROM x, q), qt AS (SELECT k, avg(t) AS overall FROM folds, x WHERE fold <> k GROUP BY k),
 q2 AS (SELECT k, list_sort(list_distinct(quantile_cont(g, [0, 0.25, 0.5, 0.75, 1]))) AS qg FROM folds, x WHERE fold <> k GROUP BY k), b3 AS (SELECT bt.*, len(list_filter(qg[2:len(qg) - 1], lambda e: e <= g)) AS b2 FROM bt JOIN q2 USING (k)),
 m3 AS (SELECT k, b1, b2, avg(t) AS mean FROM b3 WHERE fold <> k GROUP BY ALL), h2 AS (SELECT l_orderkey, l_partkey, line, g, t - coalesce(mean, overall) AS r FROM b3 LEFT JOIN m3 USING (k, b1, b2) JOIN qt USING (k) WHERE fold = k)
SELECT h.l_orderkey, h.l_partkey, h.line, round((h.r + h2.r) / 2, 4) AS grammar_score FROM h JOIN h2 USING (l_orderkey, l_partkey, line, g) GROUP BY ALL""")
def q113_grammar_score(spark, sf_dir):
    out = panel.grammar_score(_rows(spark, sf_dir), ["g", "t"], "m", ["d", "g"], "fold", 4)
    return out.select("l_orderkey", "l_partkey", "line", F.round("grammar_score", 4).alias("grammar_score")).distinct()


@query("""SELECT p_partkey::VARCHAR AS gene, 'chr' || (1 + p_partkey % 22) AS chrom, p_retailprice AS score, ln(p_size - 10) AS gcm1_dependence, ((p_partkey % 22) % 5)::INTEGER AS fold FROM part WHERE p_size > 10 AND p_partkey % 3 <> 0""")
def q114_continuous_frame(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    genes = part.select(F.col("p_partkey").cast("string").alias("gene"), F.concat(F.lit("chr"), (1 + F.col("p_partkey") % 22).cast("string")).alias("chrom"), F.col("p_retailprice").alias("score"))
    outcome = F.when(F.col("p_size") > 10, F.log(F.col("p_size") - 10)).when(F.col("p_size") == 10, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    results = part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("gene"), outcome.alias("gcm1_dependence"))
    return panel.continuous_frame(genes, results, "score").select("gene", "chrom", "score", "gcm1_dependence", "fold")


@query("""WITH p AS (SELECT p_partkey, regexp_replace(upper(p_name), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS a, regexp_replace(upper(p_type), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS b FROM part),
 ka AS (SELECT p_partkey, substring(a, i, 2) AS k, count(*) / any_value(length(a) - 1.0::DOUBLE) AS v FROM p, LATERAL (SELECT unnest(range(1, length(a))) AS i) u GROUP BY 1, 2), kb AS (SELECT p_partkey, substring(b, i, 2) AS k, count(*) / any_value(length(b) - 1.0::DOUBLE) AS v FROM p, LATERAL (SELECT unnest(range(1, length(b))) AS i) u GROUP BY 1, 2),
 j AS (SELECT coalesce(ka.p_partkey, kb.p_partkey) AS p_partkey, coalesce(ka.k, kb.k) AS k, coalesce(ka.v, 0) AS a, coalesce(kb.v, 0) AS b FROM ka FULL JOIN kb ON ka.p_partkey = kb.p_partkey AND ka.k = kb.k)
SELECT p_partkey, unnest(['a:' || k, 'b:' || k, 'd:' || k, 'p:' || k]) AS feature, round(unnest([a, b, abs(a - b), a * b]), 9) AS value FROM j""")
def q115_protein_features(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("bait_sequence"), F.col("p_type").alias("prey_sequence"))
    # explode would have the optimizer work out the map once more, for a filter on its size
    return pairs.protein_features(rows, 2).select("p_partkey", F.explode_outer("kmers").alias("feature", "value")).filter("feature IS NOT NULL").withColumn("value", F.round("value", 9))


@query("SELECT 'n' || n_nationkey || '.txt' AS name, octet_length(encode(n_name || n_regionkey))::BIGINT AS size_bytes, sha256(n_name || n_regionkey) AS sha256 FROM nation")
def q116_asset_manifest(spark, sf_dir):
    """A file of each nation, made by tasks, against what is expected of it."""
    text = F.concat("n_name", F.col("n_regionkey").cast("string"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", text.alias("text"))
    found = audit.asset_manifest(spark, writers.made_files(nation, ["n_nationkey"], lambda frame: frame["text"].iloc[0].encode(), "assets/n{}.txt"))
    wanted = nation.select(F.format_string("n%s.txt", "n_nationkey").alias("name"), F.length(F.col("text").cast("binary")).cast("long").alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    return audit.verify_manifest(found, wanted)


_NIBBLE = "(strpos('0123456789abcdef', substring(h, {0}, 1)) - 1)"


@query(f"""WITH x AS (SELECT n_nationkey, sha256('7::pair::' || n_nationkey) AS h FROM nation) SELECT n_nationkey, ({' + '.join(f'(({_NIBBLE.format(2 * i + 1)}) * 16 + {_NIBBLE.format(2 * i + 2)}) * {256**i}' for i in range(4))})::BIGINT AS seed FROM x""")
def q117_derive_seed(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", synth.seed_column(7, "pair", F.col("n_nationkey")).alias("seed"))


@query("SELECT n_nationkey::BIGINT AS pair_id, true AS valid FROM nation")
def q118_matched_pairs(spark, sf_dir):
    """As many generated pairs as there are nations: each keeps all controlled fields, and its labels obey the rule."""
    n = table(spark, sf_dir, "nation").count()
    made = synth.matched_pairs(spark, pwm.probabilities(MOTIF), pwm.probabilities(PARTNER), n, seed=4)
    right = made.groupBy("pair_id").agg(F.bool_and((F.col("label") == 1) == S.rule_is_positive(F.col("gap"))).alias("rule"))
    return synth.validate_pairs(made).join(right, "pair_id").select("pair_id", (F.col("valid") & F.col("rule")).alias("valid"))


@query(f"WITH {A}, {LIFTED}")
def q119_read_chain(spark, sf_dir):
    """Chain files written by a job, a record for each chain, and read again in splits."""
    size = 100_000_000
    rows = chain_rows(spark, sf_dir).groupBy("chain_id", "chrom", "to_chrom", "strand", "score").agg(F.array_sort(F.collect_list(F.struct("b_start", "b_end", "to_start"))).alias("b"))
    # on the reverse strand places count from the chromosome's end, so that they rise along the chain
    q = lambda x: F.when(F.col("strand") == "-", size - x["to_start"] - (x["b_end"] - x["b_start"])).otherwise(x["to_start"])
    first, last = F.col("b")[0], F.element_at("b", -1)
    end = lambda x: q(x) + x["b_end"] - x["b_start"]
    head = F.concat_ws(" ", F.lit("chain"), F.col("score").cast("string"), "chrom", F.lit(str(size)), F.lit("+"), first["b_start"], last["b_end"], "to_chrom", F.lit(str(size)), "strand", q(first), end(last), "chain_id")
    line = lambda x, i: F.concat_ws(" ", x["b_end"] - x["b_start"], F.get("b", i + 1)["b_start"] - x["b_end"], q(F.get("b", i + 1)) - end(x))
    text = F.concat(head, F.lit("\n"), F.array_join(F.transform("b", line), "\n"), F.lit("\n"))
    at = writers.put_lines(rows.select(text.alias("value")), f"{writers.shared_folder(spark)}/chains")
    return intervals.liftover(_parts(spark, sf_dir).withColumnRenamed("id", "locus_id"), binary.chain_blocks(spark, at)).drop("chrom", "start", "end")


@query(f"""WITH {PAIRS}, tr AS (SELECT * FROM pr WHERE bait <> 'NATION_3' AND prey <> 'NATION_3'), r AS (SELECT bf, pf, (sum(cooperative_signal) + 1.0::DOUBLE) / (count(*) + 2) AS rate FROM tr GROUP BY ALL)
SELECT bait, prey, round(rate, 9) AS probability FROM pr JOIN r USING (bf, pf) WHERE bait = 'NATION_3' OR prey = 'NATION_3'""")
def q120_family_rate(spark, sf_dir):
    p = nation_pairs(spark, sf_dir).withColumnsRenamed({"bf": "bait_family", "pf": "prey_family"})
    out = panel.BASELINES["family_rate"](*pairs.leave_one_out(p, "NATION_3"), "cooperative_signal")
    return out.select("bait", "prey", F.round("probability", 9).alias("probability"))


@query("""SELECT p_brand AS gene, round(avg(s), 6) AS mean_tpm, round(min(s), 6) AS minimum_replicate_tpm, min(s) >= 500 AS expression_supported FROM (SELECT p_brand, l_linenumber, sum(l_quantity) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) GROUP BY p_brand""")
def q121_expression_support(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = audit.expression_support(rows.select(F.col("p_brand").alias("gene"), F.col("l_linenumber").alias("replicate"), F.col("l_quantity").alias("tpm")), 500.0)
    return out.select("gene", F.round("mean_tpm", 6).alias("mean_tpm"), F.round("minimum_replicate_tpm", 6).alias("minimum_replicate_tpm"), "expression_supported")


@query("""WITH l AS (SELECT 'G' || (l_partkey % 50) AS gene, 'L' || (l_suppkey % 40) AS locus_id, l_linenumber = 1 AS direct FROM lineitem) SELECT count(*) FILTER (direct)::BIGINT AS direct_links, count(*) FILTER (NOT direct)::BIGINT AS distal_links, count(DISTINCT gene)::BIGINT AS genes FROM l""")
def q122_link_summary(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.format_string("G%s", F.col("l_partkey") % 50).alias("gene"), F.format_string("L%s", F.col("l_suppkey") % 40).alias("locus_id"), (F.col("l_linenumber") == 1).alias("direct"))
    return intervals.link_summary(links)
