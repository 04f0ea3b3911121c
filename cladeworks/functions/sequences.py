"""Column functions on sequences: tokens, codons, k-mers, gaps, qualities. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The order of bases in codon tables, and the standard genetic code in that order.
BASES = "TCAG"
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = [a + b + c for a in BASES for b in BASES for c in BASES]


def symbols(s: Column) -> Column:
    """The characters of a string; none of an empty one."""
    return F.filter(F.split(s, ""), lambda x: x != "")


def token(symbol: Column, alphabet: str) -> Column:
    """The index of a symbol, as it is or else in the other case; -1 if it isn't in the alphabet."""
    exact = F.instr(F.lit(alphabet), symbol)
    other = F.when(symbol == F.lower(symbol), F.upper(symbol)).otherwise(F.lower(symbol))
    return F.when(exact > 0, exact - 1).otherwise(F.instr(F.lit(alphabet), other) - 1)


def tokenize(s: Column, alphabet: str) -> Column:
    return F.transform(symbols(s), lambda x: token(x, alphabet))


def detokenize(tokens: Column, alphabet: str, unknown: str = "*") -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.when(t >= 0, F.substring(F.lit(alphabet), t + 1, F.lit(1))).otherwise(F.lit(unknown))), "")


def validated(tokens: Column, size: int) -> Column:
    """Tokens with unknown ones replaced by the most frequent known one (the smallest of several). One pass counts all tokens."""
    none = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda t: F.lit(0))
    bump = lambda a, x: F.transform(a, lambda n, t: F.when(t == x, n + 1).otherwise(n))
    mode = F.aggregate(tokens, none, bump, lambda a: F.array_min(F.transform(a, lambda n, t: F.struct((-n).alias("n"), t.alias("t"))))["t"])
    return F.transform(F.arrays_zip(tokens.alias("x"), F.array_repeat(mode, F.size(tokens)).alias("m")), lambda z: F.when(z["x"] >= 0, z["x"]).otherwise(z["m"]))


def ungap(s: Column) -> Column:
    return F.regexp_replace(s, "[-.]", "")


def presence(s: Column) -> Column:
    """Whether each column of a gapped row has a residue."""
    return F.transform(symbols(s), lambda x: ~x.isin("-", "."))


def regap(residues: Column, path: Column) -> Column:
    """A gapped row from residues and presence by column, in one pass over the columns that keeps the number of residues so far."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))
    grown = lambda a, x: F.struct((a["n"] + x.cast("int")).alias("n"), F.concat(a["at"], F.array(F.when(x, a["n"] + 1).otherwise(0))).alias("at"))
    at = F.aggregate(path, start, grown, lambda a: a["at"])
    return F.array_join(F.transform(at, lambda k: F.when(k > 0, F.substring(residues, k, F.lit(1))).otherwise(F.lit("-"))), "")


def path_string(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: F.when(x, "*").otherwise("-")), "")


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "acgtuACGTU", "tgcaaTGCAA"))


def _frame(s: Column, frame: int) -> Column:
    """What a frame reads, in capitals, U as T; a frame of -1, -2 or -3 reads the reverse complement from its place 0, 1 or 2."""
    if frame < 0:
        s, frame = reverse_complement(s), -1 - frame
    return F.translate(F.upper(F.substring(s, frame + 1, 2**31 - 1)), "U", "T")


def codons(s: Column, frame: int = 0) -> Column:
    """Whole codons of a frame."""
    return F.regexp_extract_all(_frame(s, frame), F.lit(".{3}"), F.lit(0))


def codon_token(codon: Column) -> Column:
    """0 to 63 in the order of CODONS, -1 for anything else."""
    digits = [F.instr(F.lit(BASES), F.substring(codon, k, 1)) - 1 for k in (1, 2, 3)]
    return F.when(F.least(*digits) >= 0, digits[0] * 16 + digits[1] * 4 + digits[2]).otherwise(-1)


def codon_tokens(s: Column, frame: int = 0) -> Column:
    """Tokens of the codons of a frame; a stop codon at the end is dropped: the last three characters of the whole codons, if they are one."""
    stops = [c for c, a in zip(CODONS, GENETIC_CODE, strict=True) if a == "*"]
    up = _frame(s, frame)
    whole = F.length(up) - F.length(up) % 3
    n = F.when(F.substr(up, whole - 2, F.lit(3)).isin(stops), whole - 3).otherwise(whole)
    return F.transform(F.regexp_extract_all(F.substr(up, F.lit(1), n), F.lit(".{3}"), F.lit(0)), codon_token)


def codon_detokenize(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.when(t >= 0, F.substring(F.lit("".join(CODONS)), 3 * t + 1, F.lit(3))).otherwise(F.lit("NNN"))), "")


def translated(s: Column, frame: int = 0) -> Column:
    """Protein of a frame; X for codons with other letters."""
    acid = lambda c: F.when((t := codon_token(c)) >= 0, F.substring(F.lit(GENETIC_CODE), t + 1, F.lit(1))).otherwise(F.lit("X"))
    return F.array_join(F.transform(codons(s, frame), acid), "")


def kmers(s: Column, k: int) -> Column:
    """Substrings of k symbols in order of position: what a look-ahead captures at every place, in one pass."""
    return F.regexp_extract_all(s, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def kmer_code(kmer: Column, alphabet: str) -> Column:
    """The number of a k-mer in base |alphabet|, first symbol most significant."""
    return F.aggregate(tokenize(kmer, alphabet), F.lit(0).cast("long"), lambda a, t: a * len(alphabet) + t)


def kmer_text(code: Column, k: int, alphabet: str) -> Column:
    n = len(alphabet)
    return F.concat(*[F.substring(F.lit(alphabet), (F.floor(code / n ** (k - 1 - i)) % n + 1).cast("int"), F.lit(1)) for i in range(k)])


def quality_score(symbol: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(93), F.ascii(symbol) - 33))


def log_sum_exp(xs: Column) -> Column:
    top = F.array_max(xs)
    return F.when(top == float("-inf"), top).otherwise(top + F.log(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top))))


def log_inner_product(xs: Column, ys: Column, zs: Column | None = None) -> Column:
    """The log of the sum over places of products, of two or three arrays of logs."""
    both = F.zip_with(xs, ys, lambda x, y: x + y)
    return log_sum_exp(both if zs is None else F.zip_with(both, zs, lambda x, y: x + y))


def convert_wildcards(s: Column, wildcard: str, to: str) -> Column:
    return F.translate(s, wildcard, to)


def nexus_to_internal(s: Column) -> Column:
    """A Nexus row with its unknown residues as internal ones."""
    return F.translate(s, "?", "*")


def internal_to_nexus(s: Column) -> Column:
    return F.translate(s, "*", "?")


def residues(s: Column) -> Column:
    """How many residues a gapped row has."""
    return F.length(ungap(s))


def has_gaps(s: Column) -> Column:
    return s.rlike("[-.]")


def subalignment(s: Column, first: int, n: int) -> Column:
    """Columns first, first + 1, ... of a gapped row, n of them."""
    return F.substring(s, first + 1, n)


def alphabet_problems(s: Column, reserved: str = "-.") -> Column:
    """Symbols that an alphabet has twice, and reserved ones in it, sorted; none in a valid one."""
    own = symbols(s)
    twice = F.filter(F.array_distinct(own), lambda x: (F.size(F.filter(own, lambda y: y == x)) > 1) | F.lit(reserved).contains(x))
    return F.array_sort(twice)


def quality_symbol(score: Column) -> Column:
    return F.chr(F.greatest(F.lit(0), F.least(F.lit(93), score)) + 33)


def extended_tokens(s: Column, alphabet: list[str]) -> Column:
    """Tokens of an alphabet whose symbols may have several characters: at each place the shortest symbol that fits, -1 for a character that begins none.
    The text is split by one pattern, its alternatives from short to long."""
    import re

    by = sorted(range(len(alphabet)), key=lambda i: (len(alphabet[i]), alphabet[i]))
    parts = F.regexp_extract_all(s, F.lit("(?s)" + "|".join([*(re.escape(alphabet[i]) for i in by), "."])), F.lit(0))
    code = F.create_map(*[F.lit(x) for i, a in enumerate(alphabet) for x in (a, i)])
    return F.transform(parts, lambda p: F.coalesce(F.try_element_at(code, p), F.lit(-1)))


def extended_detokenize(tokens: Column, alphabet: list[str], unknown: str = "*") -> Column:
    names = F.array(*[F.lit(a) for a in alphabet])
    return F.array_join(F.transform(tokens, lambda t: F.when(t >= 0, F.get(names, t)).otherwise(F.lit(unknown))), "")


def xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(y))


def detect_format(text: Column) -> Column:
    """The kind of a file from its first line that isn't blank."""
    line = F.regexp_extract(text, r"^\s*([^\n]*)", 1)
    return (
        F.when(line.rlike(r"^# *STOCKHOLM"), "stockholm").when(F.upper(line).rlike(r"^#NEXUS"), "nexus").when(line.rlike(r"^\("), "newick")
        .when(line.rlike(r"^\{"), "json").when(line.rlike(r"^>"), F.when(text.rlike(r"\n[^>\n]*[-.]"), "gapped_fasta").otherwise("fasta")).when(line.rlike("^@"), "fastq").otherwise("unknown")
    )


def fasta(name: Column, seq: Column, width: int = 50) -> Column:
    """A FASTA record with lines of at most width symbols."""
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), r"\n$", ""), F.lit("\n"))
