"""Expressions over DNA, protein and symbol strings; all stay in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Aliases of factor symbols.
ALIASES = {"TP73L": "TP63", "RFXDC2": "RFX7", "RXF5": "RFX5", "POU5F1B": "POU5F1", "BHLHB2": "BHLHE40", "ZNF238": "ZBTB18"}
#: Tokens of truth.
TRUE_TOKENS = ("1", "true", "yes", "y", "+", "positive", "observed")
#: Prefixes and suffixes of symbols that name species and constructs.
SYMBOL_PREFIX, SYMBOL_SUFFIX = r"^(HUMAN|HS)[_:.-]", r"[-_](FULL|EDBD|DBD|ISOFORM\d+)$"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def normalize_symbol(x: Column, aliases: dict[str, str] | None = None) -> Column:
    """Upper-cased without spaces, species prefix and construct suffix, then the alias of the symbol: a given one, or else a built-in one."""
    s = F.regexp_replace(F.upper(F.trim(x)), " ", "")
    s = F.regexp_replace(F.regexp_replace(s, SYMBOL_PREFIX, ""), SYMBOL_SUFFIX, "")
    pairs = F.create_map(*[F.lit(v) for kv in (ALIASES | (aliases or {})).items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, s), s)


def reverse_complement(x: Column, upper: bool = True) -> Column:
    return F.reverse(F.translate(F.upper(x) if upper else x, "ACGTN", "TGCAN"))


def strand_invariant(x: Column) -> Column:
    """The lesser of a sequence and its reverse complement."""
    return F.least(F.upper(x), reverse_complement(x))


def canonical(x: Column) -> Column:
    """Upper-case with every letter besides ACGT as N."""
    return F.upper(F.regexp_replace(x, "[^ACGTacgt]", "N"))


def _count(x: Column, *parts: str) -> Column:
    """The letters in places of these parts, none of which overlap."""
    return reduce(add, (F.length(x) - F.length(F.replace(x, F.lit(p), F.lit(""))) for p in parts))


def gc_fraction(x: Column) -> Column:
    """Of canonical bases."""
    s = F.upper(x)
    return _count(s, "G", "C") / F.greatest(_count(s, *"ACGT"), F.lit(1))


def cpg_per_100bp(x: Column) -> Column:
    """CpG places on each 100 of the length less one."""
    return 100.0 * (_count(F.upper(x), "CG") / 2) / F.greatest(F.length(x) - 1, F.lit(1))


def n_fraction(x: Column) -> Column:
    s = F.upper(x)
    return (F.length(s) - _count(s, *"ACGT")) / F.greatest(F.length(x), F.lit(1))


def longest_canonical_run(x: Column) -> Column:
    return F.array_max(F.transform(F.split(F.upper(x), "[^ACGT]+"), F.length))


def pair_members(x: Column) -> Column:
    """[first, second] normalised symbols of 'A_B', null for a single one."""
    at = F.locate("_", x)
    both = F.array(normalize_symbol(F.substring_index(x, "_", 1)), normalize_symbol(F.substr(x, at + 1)))
    return F.when(at > 0, both)


def attributes(x: Column, pattern: str = r'(\w+) "([^"]+)"') -> Column:
    """A map of key "value" attributes; of repeated keys the last counts."""
    keys, values = (F.regexp_extract_all(x, F.lit(pattern), i) for i in (1, 2))

    def build(s: Column) -> Column:
        names = F.array_distinct(s["k"])
        return F.map_from_arrays(names, F.transform(names, lambda n: F.get(s["v"], (F.size(s["k"]) - F.array_position(F.reverse(s["k"]), n)).cast("int"))))

    # an array of one struct, so that the text is searched once and not for every key
    return F.transform(F.array(F.struct(keys.alias("k"), values.alias("v"))), build)[0]


def is_true(x: Column) -> Column:
    """1 for a token of truth, numbers by their value, else 0."""
    s = F.lower(F.trim(x.cast("string")))
    return F.when(s.isin(*TRUE_TOKENS) | (F.coalesce(s.try_cast("double"), F.lit(0.0)) == 1.0), 1).otherwise(0)


def implant(background: Column, motif: Column, start: Column | int) -> Column:
    """The background with the motif laid over it from the zero-based start."""
    return F.overlay(background, motif, (start if isinstance(start, Column) else F.lit(start)) + 1)


def rule_is_positive(gap: Column, period: int = 10, phases: tuple[int, ...] = (0, 1, 9)) -> Column:
    """Whether a gap's phase is allowed."""
    return F.pmod(gap, F.lit(period)).isin(*phases)


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def one_hot(x: Column) -> Column:
    """A row of A, C, G, T as 0 and 1 for each base; another letter is an error."""
    rows = F.transform(F.filter(F.split(F.upper(x), ""), lambda c: c != ""), lambda c: F.array(*[(c == b).cast("int") for b in "ACGT"]))
    return F.when(F.upper(x).rlike("^[ACGT]*$"), rows).otherwise(F.raise_error(F.lit("only A, C, G and T can be encoded")).cast("array<array<int>>"))


def one_hot_text(x: Column) -> Column:
    """The same rows as text, four digits for each base."""
    digits = F.upper(x)
    for k, base in enumerate("ACGT"):
        digits = F.replace(digits, F.lit(base), F.lit("0" * k + "1" + "0" * (3 - k)))
    return F.when(F.upper(x).rlike("^[ACGT]*$"), digits).otherwise(F.raise_error(F.lit("only A, C, G and T can be encoded")).cast("string"))


def ordered_pair(x: Column) -> Column:
    """A pair's normalised members in order, joined; null for a single one."""
    return F.array_join(F.array_sort(pair_members(x)), "_")
