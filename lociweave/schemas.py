"""Schemas of the tables that the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType()}


def schema(spec: str) -> T.StructType:
    """A schema from 'name:type' words; s string, l long, i int, d double, b boolean."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.rsplit(":", 1) for x in spec.split())])


#: The order and names of columns in the file formats.
NARROWPEAK = schema("chrom:s start:l end:l name:s score:d strand:s signal:d pvalue:d qvalue:d summit_offset:l")
MAGIX = schema("chr:s start:l stop:l name:s coefficient.br:d coefficient.ar:d full_LL:d reduced_LL:d pvalue:d fdr:d")
CHROM_SIZES = schema("chrom:s size:l")
LOCI = schema(
    "locus_id:s focal_tf:s chrom:s start:l end:l midpoint:l tile:l chip_source:b ght_source:b chip_count:l ght_count:l "
    "locus_universe:s selection_rule:s center_rule:s outcome_used_for_selection:b outcome_used_for_centering:b"
)
PROMOTERS = schema("chrom:s tss:l promoter_start:l promoter_end:l gene_id:s gene:s")
LOOPS = schema("chrom1:s start1:l end1:l chrom2:s start2:l end2:l loop_score:d")
LINKS = schema("gene:s locus_id:s direct:b loop_count:l loop_score:d")
RSEM = schema("gene:s tpm:d expected_count:d length:d")
DESEQ2 = schema("gene:s baseMean:d log2FoldChange:d lfcSE:d pvalue:d padj:d gcm1_dependence:d")
INTERACTIONS = schema("raw_bait:s raw_prey:s bait:s prey:s raw_value:s tested:b composite_motif:b spacing_or_orientation:b")
AUTOSOMES = [f"chr{n}" for n in range(1, 23)]
