"""Secret scan: fixed formats, and a randomness test battery over long tokens.

Fixed formats are matched as they stand. Beyond them, every token of MIN_LENGTH or
more characters of an encoding's alphabet is tested for looking like random data:
chi-squared uniformity over the alphabet, a runs test about its median, and lag-1
serial correlation, each exact in mean and variance for the token's length. Fisher's
method joins the three into one p-value that the token is uniformly random.

Short tokens of ordinary words may pass by chance, long ones hardly do, so the level
is set for each length class by false-discovery control: tokens that
are plain words (one case, letters only) serve as decoys, and the class takes the
lowest p-value (ALPHA at least) at which (1 + decoys at or above it) / tokens at or
above it is at most FDR. The counts cover all documents; they are a table of bounded size.

Everything runs as SQL functions. Defined results: a null text is an empty one; an
empty table gives an empty result; repeated rows each keep their row; without enough
tokens in a class to show the rate, the method adds nothing there.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from ixpanel.llm.common import cut, prepare, table, text_or_empty
from ixpanel.llm.spans import digest, labelled, with_spans, written

ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_LENGTH = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}"
LENGTHS = [20, 28, 40, 64]            # from which on a length class begins
FDR = 0.05
ALPHA = 0.001                         # below this p-value a token is not random at any rate
BINS = 30                             # of -10 log10 p, down to ALPHA; one more for what is below
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Encodings in the order they are tried: name, pattern, alphabet in the order of its values.
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64url", "^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("base64", "^", UPPER + LOWER + DIGITS + "+/"),
]
DECOY = "^[A-Za-z][a-z]+$"            # plain words
SKIP = "^[0-9]+$"                     # plain numbers are no tokens


def _case(of) -> str:
    return "case " + " ".join(f"when t.hit rlike '{p}' then {of(name, a)}" for name, p, a in ENCODINGS) + " end"


def _tail(z: str) -> str:
    """SQL of the two-sided normal tail beyond z (Abramowitz and Stegun 7.1.26)."""
    x = f"(abs({z}) / sqrt(2D))"
    t = f"(1D / (1D + 0.3275911D * {x}))"
    poly = f"({t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D)))))"
    return f"greatest(least({poly} * exp(-{x} * {x}), 1D), 1e-12)"


def _steps() -> list[str]:
    """The battery as a chain of transforms over an array column ``tokens`` of spans."""
    keep = "'start', t.start, 'end', t.end, 'enc', t.enc, 'decoy', t.decoy, 'n', t.n"
    k = "cast(length(t.abc) as double)"
    return [
        f"transform(filter(tokens, t -> not t.hit rlike '{SKIP}'), t -> named_struct('start', t.start, 'end', t.end, "
        f"'hit', t.hit, 'enc', {_case(lambda n, a: repr(n))}, 'abc', {_case(lambda n, a: repr(a))}, "
        f"'decoy', t.hit rlike '{DECOY}', 'n', cast(length(t.hit) as double)))",
        # values, and the sum of squared counts
        f"transform(tokens, t -> named_struct({keep}, 'k', {k}, "
        "'v', transform(split(t.hit, ''), c -> cast(locate(c, t.abc) - 1 as double)), "
        "'sq', aggregate(split(t.abc, ''), 0D, (s, c) -> s + pow(length(t.hit) - length(replace(t.hit, c, '')), 2))))",
        f"transform(tokens, t -> named_struct({keep}, 'k', t.k, 'sq', t.sq, "
        "'high', aggregate(t.v, 0D, (s, x) -> s + if(x >= t.k / 2, 1D, 0D)), "
        "'runs', 1D + aggregate(zip_with(slice(t.v, 1, size(t.v) - 1), slice(t.v, 2, size(t.v) - 1), "
        "(x, y) -> if((x >= t.k / 2) = (y >= t.k / 2), 0D, 1D)), 0D, (s, x) -> s + x), "
        "'lag', aggregate(zip_with(slice(t.v, 1, size(t.v) - 1), slice(t.v, 2, size(t.v) - 1), "
        "(x, y) -> (x - (t.k - 1) / 2) * (y - (t.k - 1) / 2)), 0D, (s, x) -> s + x)))",
        # z-values under uniform random symbols
        f"transform(tokens, t -> named_struct({keep}, "
        "'chi', (t.k / t.n * t.sq - t.n - (t.k - 1)) / sqrt(2 * (t.k - 1) * (t.n - 1) / t.n), "
        "'runs', if(t.high = 0 or t.high = t.n, 9D, (t.runs - 1 - 2 * t.high * (t.n - t.high) / t.n) / greatest(1e-9D, "
        "sqrt(greatest(0D, 2 * t.high * (t.n - t.high) / t.n * (2 * t.high * (t.n - t.high) / t.n - 1) / (t.n - 1))))), "
        "'lag', t.lag / ((t.n - 1) * (t.k * t.k - 1) / 12) * sqrt(t.n - 1)))",
        f"transform(tokens, t -> named_struct({keep}, 'x', "
        f"- ln({_tail('t.chi')}) - ln({_tail('t.runs')}) - ln({_tail('t.lag')})))",
        # Fisher: twice x is chi-squared with six degrees of freedom
        f"transform(tokens, t -> named_struct({keep}, 'p', exp(-t.x) * (1 + t.x + t.x * t.x / 2)))",
        "transform(tokens, t -> named_struct('start', t.start, 'end', t.end, 'enc', t.enc, 'decoy', t.decoy, 'p', t.p, "
        f"'class', {' + '.join(f'if(t.n >= {n}, 1, 0)' for n in LENGTHS)}, "
        f"'bin', cast(least({BINS + 1}D, greatest(0D, floor(-10 * log10(greatest(t.p, 1e-30D))))) as int)))",
    ]


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, the spans of the fixed formats
    (assign, access, hex) and the tested tokens with encoding, p-value and length class."""
    df = docs.select("doc_id", text_or_empty().alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("tokens", TOKEN)):
        df = with_spans(df, name, pattern)
    value = ASSIGN.replace("\\", "\\\\").replace("'", "\\'")
    df = df.withColumn("assign", F.expr(f"filter(assign, s -> length(regexp_extract(s.hit, '{value}', 1)) >= 6)"))
    for step in _steps():
        df = df.withColumn("tokens", F.expr(step))
    return df.drop("text")


def levels(scanned: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """The last bin (of -10 log10 p) that is taken, by length class."""
    counts = (scanned.select(F.explode("tokens").alias("t"))
              .groupBy("t.decoy", "t.class", "t.bin").count().collect())
    seen = defaultdict(int)
    for r in counts:                  # at most 2 x 4 x 32 rows
        seen[r["decoy"], r["class"], r["bin"]] += r["count"]
    out = {}
    for c in {r["class"] for r in counts}:
        tokens = decoys = 0
        for b in range(BINS + 1):     # what is below ALPHA is left out
            tokens += seen[False, c, b]
            decoys += seen[True, c, b]
            if tokens and (1 + decoys) / tokens <= fdr:
                out[c] = b
    return out


def find(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row per row of ``docs``: doc_id, assign, access, hex and random (arrays of spans; random
    ones have the encoding and p-value). A random span may be one of a fixed format, too."""
    prepare(docs.sparkSession)
    scanned = cut(scan(docs))
    taken = levels(scanned, fdr)
    ok = " or ".join(f"(t.class = {c} and t.bin <= {b})" for c, b in taken.items()) or "false"
    return scanned.withColumn("random", F.expr(f"filter(tokens, t -> not t.decoy and ({ok}))")).drop("tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [(k, k) for k in ("assign", "access", "hex", "random")]
    return (find(table(spark, sf_dir, "documents"))
            .withColumn("base", labelled(kinds[:3])).withColumn("every", labelled(kinds))
            .select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k, _ in kinds),
                    digest(written("base")).alias("base_sha256"), written("every").alias("spans")))
