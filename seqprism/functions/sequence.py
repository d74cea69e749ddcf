"""Expressions over DNA strings. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ten dinucleotides that remain when each stands for its reverse complement, too.
DIMERS = ["AA", "AC", "AG", "AT", "CA", "CC", "CG", "GA", "GC", "TA"]


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def kmer_code(kmer: Column) -> Column:
    """Base-4 number with A, C, G, T as digits, the first letter most significant."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def code_kmer(code: Column, k: Column) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, F.lit("0")), "0123", "ACGT")


def feature_index(kmer: Column, kmin: int) -> Column:
    """Place of a k-mer among all k-mers of length kmin and more, shorter ones first."""
    shorter = (F.pow(F.lit(4.0), F.length(kmer)) - 4.0**kmin) / 3
    return shorter.cast("long") + kmer_code(kmer)


def weight_table(pairs: Column, kmin: int, kmax: int) -> Column:
    """An array of the weights of all k-mers by feature_index() from an array of (kmer, weight): looked
    up in constant time, where a map of Spark is searched from its beginning."""
    known = F.map_from_entries(F.transform(pairs, lambda p: F.struct(feature_index(p["kmer"], kmin), p["weight"])))
    places = F.sequence(F.lit(0).cast("long"), F.lit(sum(4**k for k in range(kmin, kmax + 1)) - 1).cast("long"))
    return F.transform(places, lambda i: F.coalesce(F.element_at(known, i), F.lit(0.0)))


def kmer_weight(kmer: Column, k: int, kmin: int, table: Column) -> Column:
    """The weight of a k-mer of known length, by its canonical form."""
    return F.get(table, (kmer_code(canonical(kmer)) + (4**k - 4**kmin) // 3).cast("int"))


def kmer_places(seq: Column, kmin: int, kmax: int, any_letters: bool = False) -> Column:
    """Array of the feature_index() of the canonical form of every k-mer, shorter ones first.

    With any_letters the sequence may hold more than A, C, G, T; k-mers with such a letter are left out.
    """

    def of_length(k: int) -> Column:
        found = F.filter(windows(seq, k), lambda s: ~s.rlike("[^ACGT]")) if any_letters else windows(seq, k)
        return F.transform(found, lambda s: (kmer_code(canonical(s)) + (4**k - 4**kmin) // 3).cast("int"))

    return F.concat(*map(of_length, range(kmin, kmax + 1)))


def windows(seq: Column, size: int) -> Column:
    """Array of all substrings of a length, in order; empty if the sequence is shorter."""
    places = F.when(F.length(seq) >= size, F.sequence(F.lit(1), F.length(seq) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(seq, i, F.lit(size)))


def lower_case_share(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^a-z]", "")) / F.nullif(F.length(seq), F.lit(0))


def location(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def contains_dimer(kmer: Column, dimer: str) -> Column:
    """Whether a k-mer has the dinucleotide or its reverse complement."""
    other = dimer[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return kmer.contains(dimer) if other == dimer else kmer.contains(dimer) | kmer.contains(other)
